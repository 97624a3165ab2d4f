import random
import re

import duckdb
from pyspark.sql import functions as F

from webcorpus.llm import rules

SCHEMA = "doc_id long, text string, source string"
WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def found(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    frame = frame.withColumns({n: F.lit("clash") for n in ("host", "row", "words", "kept", "few_words", "rejected")})
    frame.repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, rules.op13_quality_rules(spark, str(tmp_path)).collect()), key=str)


def by_sql(folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}'")
    return sorted(db.execute(rules.OP13_SQL).fetchall(), key=str)


def drawn(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", "\n", "\t "]) for w in words)


def test_counts_of_odd_texts(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "  \n\t\r\x0b\x0c", "one", "a b c d e f g", "x " * 8, "x " * 9, "x " * 60, "é ü ß 漢字 \U0001f600 " * 6,
             "#*$%&|<> # \n#\n#\n# \n", "same line\nsame line\n\n\nother\nsame line", "a\rb\x0bc\x0cd"]
    passage = drawn(rng, 12)
    texts += [passage + drawn(rng, 30) + passage, " ".join([passage, passage, "q", passage]), drawn(rng, 200, 3), drawn(rng, 50_000)]
    texts += [drawn(rng, rng.randrange(60), rng.choice([2, 3, 400])) for _ in range(60)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(1, "", None), (None, drawn(rng, 40), None)]
    got = found(spark, tmp_path, rows)
    want = sorted(((i, *base(t), not base(t)[-1]) for i, t, _ in rows), key=str)
    assert got == want
    assert got == by_sql(f"{tmp_path}/documents.parquet/*.parquet")


def test_a_bad_host_takes_its_documents_along(spark, tmp_path):
    rng = random.Random(5)
    good = [(i, drawn(rng, 60), f"host{i % 5}") for i in range(100)]
    junk = [(200 + i, "# % " * 30, "junk") for i in range(40)] + [(300, drawn(rng, 60), "junk")]
    alone = [(400, "# % & " + drawn(rng, 8) * 3, "once"), (401, drawn(rng, 60), "host0"), (402, drawn(rng, 60), None), (403, "short", "host1")]
    rows = good + junk + alone
    kept = {r[0]: (r[6], r[7]) for r in found(spark, tmp_path, rows)}
    assert kept[300] == (False, False)  # fine itself, from a host of junk
    assert kept[402] == (False, True) and kept[403] == (True, False)
    assert all(kept[i] == (False, True) for i, *_ in good)
    assert found(spark, tmp_path, rows) == by_sql(f"{tmp_path}/documents.parquet/*.parquet")


def test_rates_are_shrunk(spark):
    rows = [(f"h{h}", i < h) for h in range(6) for i in range(10)] + [("one", True), (None, True)]
    got = {r.host: r for r in rules.host_verdicts(spark.createDataFrame(rows, "host string, few_words boolean"), ["few_words"]).collect()}
    n, f = 61, 16
    ff = sum(h * h / 10 for h in range(6)) + 1
    mean, strength = rules._prior(7, n, 6 * 100 + 1, f, ff)
    assert abs(mean - f / n) < 1e-12 and 4 <= strength <= 1000
    assert abs(got["one"].rate_few_words - (1 + mean * strength) / (1 + strength)) < 1e-12
    assert mean < got["one"].rate_few_words < 1 and None not in got
    # alike hosts share nearly all evidence, unlike ones hardly any
    alike = rules._prior(10, 1000.0, 100_000.0, 500.0, 250.0)
    unlike = rules._prior(10, 1000.0, 100_000.0, 500.0, 500.0)
    assert alike == (0.5, 1000.0) and unlike == (0.5, 4.0)
    assert rules._prior(1, 50.0, 2500.0, 5.0, 0.5) == (0.1, 10.0) and rules._prior(0, 0.0, 0.0, 0.0, 0.0)[0] == 0.0


def test_empty_table(spark, tmp_path):
    assert found(spark, tmp_path, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = sorted(map(tuple, rules.op13_quality_rules(spark, folder).collect()), key=str)
    assert got == by_sql(f"{folder}/documents.parquet")


def test_no_python_in_the_plan(spark):
    plan = rules.op13_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan += rules.measured(docs, [F.col("doc_id")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[-1]
