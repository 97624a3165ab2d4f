"""A table stored by the hash of its key, which grows batch by batch and is looked up by key.

Every batch adds one run: a folder of Parquet files, cut into slots by the leading bits of
the key's hash. A run has about `slot_rows` rows a slot, so a small batch of keys reads a
few slots of each run, however large the table is. The newest runs that are not larger than
what is added are merged with it, so n batches leave about log2(n) runs and a row is
rewritten about log2(n) times.

What a batch leaves is a small catalog file, written last and renamed into place. It lists
the runs that make up the table. A batch reads the catalog of the batch before and the runs
that one names, which stay until a later batch is complete: one that failed anywhere (before,
in or after its merge) is done again from the same state and leaves the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.plans import files
from webcorpus.plans.skew import BROADCAST_BYTES, measured_bytes
from webcorpus.plans.storage import stage

#: Rows of a slot.
SLOT_ROWS = 1 << 20
#: Most bits of a slot number: a batch sends at most 2 ** bits of them to the driver.
MOST_BITS = 12
#: Number of the batch that stands for what the table began with.
BEGIN = -1

Run = dict


def _slot(key: Column, bits: int) -> Column:
    """The leading bits of the key's hash."""
    return F.expr("0L") if bits == 0 else F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


class KeyedStore:
    """Rows of `schema`, looked up by the column `key`, in a folder all executors reach.

    With `fold` a key has one row: what `fold` makes of its rows, a function of a DataFrame
    that gives the same rows whatever rows are folded first. Without it all rows stay.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: T.StructType,
        key: str,
        fold: Callable[[DataFrame], DataFrame] | None = None,
        slot_rows: int | None = None,
        broadcast_bytes: int = BROADCAST_BYTES,
    ):
        self.spark, self.folder, self.schema, self.key, self.fold = spark, folder.rstrip("/"), schema, key, fold
        self.slot_rows = SLOT_ROWS if slot_rows is None else slot_rows
        self.broadcast_bytes = broadcast_bytes

    # --- catalogs ---

    def _catalog(self, batch: int) -> str:
        return f"{self.folder}/catalog/{batch + 1:020d}.json"

    def _batches(self) -> list[int]:
        names = files.names(self.spark, f"{self.folder}/catalog")
        return sorted(int(n[:-5]) - 1 for n in names if n.endswith(".json"))

    def last(self) -> int | None:
        """The latest batch that is complete, None before `begin`."""
        return max(self._batches(), default=None)

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs that hold the rows of all batches, or of those before one."""
        known = [b for b in self._batches() if before is None or b < before]
        if not known:
            return []
        return json.loads(files.read_text(self.spark, self._catalog(known[-1])))["runs"]

    def _publish(self, batch: int, runs: list[Run]) -> None:
        files.write_text(self.spark, self._catalog(batch), json.dumps({"batch": batch, "runs": runs}))

    # --- writing ---

    def begin(self, rows: DataFrame | None = None) -> None:
        """Writes what the table has before batch 0, unless that was done."""
        if self.last() is not None:
            return
        runs = []
        if rows is not None:
            first = stage(self._folded(rows.select(*self.schema.fieldNames())), "store-rows")
            count = first.count()
            runs = [self._write(first, count, "begin")] if count else []
        self._publish(BEGIN, runs)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Adds the rows of a batch. A batch that is added again replaces what it left;
        later ones must not be there yet."""
        runs = self.runs(before=batch)
        if not self._batches() or batch <= BEGIN:
            raise ValueError("begin() comes before the first batch, and numbers start at 0")
        if (self.last() or 0) > batch:
            raise ValueError(f"{self.folder} holds batches after {batch}")
        new = stage(self._folded(rows.select(*self.schema.fieldNames())), "store-rows")
        size, first = new.count(), len(runs)
        if size:
            while first and runs[first - 1]["rows"] <= size:
                first -= 1
                size += runs[first]["rows"]
            name = f"run-{batch}"
            if first < len(runs):
                runs, old = runs[:first], self._read(runs[first:])
                new = old.unionByName(new)
                if self.fold is not None:
                    new = stage(self.fold(new), "store-merged")
                    size = new.count()
            runs = [*runs, self._write(new, size, name)]
        self._publish(batch, runs)
        self._remove_unread(batch)

    def _folded(self, rows: DataFrame) -> DataFrame:
        return rows if self.fold is None else self.fold(rows)

    def _write(self, rows: DataFrame, count: int, name: str) -> Run:
        """One run, written as a whole: what an earlier attempt left there goes."""
        # no more bits than the rows need, and no more slots than can be listed
        bits = min(max(0, (max(count - 1, 0) // self.slot_rows).bit_length()), MOST_BITS)
        folder = f"{self.folder}/runs/{name}"
        files.remove(self.spark, folder)
        cut = rows.withColumn("slot", _slot(F.col(self.key), bits))
        # rows of a slot are put together, and a slot with far more rows than others is split
        cut.hint("rebalance", F.col("slot")).write.partitionBy("slot").parquet(folder)
        held = [n[len("slot="):] for n in files.names(self.spark, folder) if n.startswith("slot=")]
        return {"name": name, "rows": count, "bits": bits, "slots": sorted(map(int, held))}

    def _remove_unread(self, batch: int) -> None:
        """Keeps what this batch reads if it is done again, and what it left."""
        kept = [b for b in self._batches() if b < batch][-1:] + [batch]
        read = {r["name"] for b in kept for r in json.loads(files.read_text(self.spark, self._catalog(b)))["runs"]}
        for b in self._batches():
            if b not in kept and b < batch:
                files.remove(self.spark, self._catalog(b))
        for name in files.names(self.spark, f"{self.folder}/runs"):
            if name not in read:
                files.remove(self.spark, f"{self.folder}/runs/{name}")

    # --- reading ---

    def _read(self, runs: list[Run], slots: set[int] | None = None) -> DataFrame:
        paths = self.paths(runs, slots)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def paths(self, runs: list[Run], slots: set[int] | None = None) -> list[str]:
        """Folders of the runs, or of the slots that begin like `slots` of `MOST_BITS` bits."""
        out = []
        for run in runs:
            wanted = None if slots is None else {s >> (MOST_BITS - run["bits"]) for s in slots}
            held = [s for s in run["slots"] if wanted is None or s in wanted]
            out += [f"{self.folder}/runs/{run['name']}/slot={s}" for s in held]
        return out

    def read(self, before: int | None = None) -> DataFrame:
        """All rows of the batches, or of those before one."""
        return self._folded(self._read(self.runs(before)))

    def _pieces(self, keys: DataFrame) -> Iterator[tuple[DataFrame, set[int]]]:
        """Keys in pieces small enough to be broadcast, with the slots they are in."""
        sized = keys.withColumn("__slot", _slot(F.col(self.key), MOST_BITS))
        size = F.sum(F.octet_length(F.col(self.key).cast("string")) + 32)
        # at most 2 ** MOST_BITS rows
        found = sorted(sized.groupBy("__slot").agg(size.alias("size")).collect())
        piece: list[int] = []
        held = 0
        for row in found:
            if piece and held + row["size"] > self.broadcast_bytes:
                yield sized.where(F.col("__slot").between(piece[0], piece[-1])).drop("__slot"), set(piece)
                piece, held = [], 0
            piece.append(row["__slot"])
            held += row["size"]
        if piece:
            yield sized.where(F.col("__slot").between(piece[0], piece[-1])).drop("__slot"), set(piece)

    def lookup(self, keys: DataFrame, columns: list[str] | None = None, before: int | None = None) -> DataFrame:
        """The stored rows whose key is in `keys`, a staged table of the key column.

        Only the slots of the keys are read, and stored rows are never shuffled to be met:
        the keys are broadcast, in pieces of `broadcast_bytes` by slot. NULL keys match nothing.
        """
        runs = self.runs(before)
        wanted = columns if self.fold is None and columns else self.schema.fieldNames()
        names = list(dict.fromkeys([self.key, *wanted]))
        distinct = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        found = self.spark.createDataFrame([], self.schema).select(*names)
        for piece, slots in self._pieces(distinct) if runs else ():
            # one slot may hold more keys than can be broadcast: those are shuffled
            small = measured_bytes(piece) <= 2 * self.broadcast_bytes if len(slots) == 1 else True
            stored = self._read(runs, slots).select(*names)
            found = found.unionByName(stored.join(F.broadcast(piece) if small else piece, self.key, "left_semi"))
        return self._folded(found).select(*(columns or self.schema.fieldNames()))
