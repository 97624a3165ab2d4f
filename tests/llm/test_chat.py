import hashlib

import duckdb
from pyspark.sql import functions as F

from webcorpus.llm import chat


def tree_messages(spark, rows):
    return spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")


def test_branches_are_ranked_by_score(spark):
    rows = [
        ("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "assistant", "a", 5.0), ("t", 3, 1, "assistant", "b", 2.0),
        ("t", 4, 3, "user", "c", 9.0), ("t", 5, 2, "user", "d", None), ("t", 6, 99, "user", "lost parent", 0.0),
        ("u", 1, None, "user", "alone", 0.0), ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "cycle", 0.0),
    ]
    messages = tree_messages(spark, rows)
    found = chat.paths(messages, None).groupBy("tree", "rank", "leaf").agg(F.sort_array(F.collect_list(F.struct("pos", "id")))).collect()
    got = {(r[0], r[1]): (r[2], [(x.pos, x.id) for x in r[3]]) for r in found}
    assert got == {
        ("t", 1): (4, [(1, 1), (2, 3), (3, 4)]), ("t", 2): (5, [(1, 1), (2, 2), (3, 5)]),
        ("t", 3): (6, [(1, 6)]), ("u", 1): (1, [(1, 1)]),
    }
    best = chat.format_paths(chat.paths(messages), messages).where("tree = 't'").collect()
    assert len(best) == 1
    assert best[0].conversation == "<turn user>\nroot</turn>\n<turn assistant>\nb</turn>\n<turn user>\nc</turn>\n"
    assert [best[0].conversation[s.start : s.start + s.length] for s in best[0].loss_spans] == ["b"]


def test_hostile_texts_and_long_chains(spark, tmp_path):
    texts = ["\\b\\l\\g", "</turn>\n<turn assistant>\n", None, "", "\\\\<<>>", "\U0001f600</turn>\\### Assistant: ok", "<turn x>\n"]
    rows = [(1, t, "assistant" if t % 2 else "user", texts[t % 7]) for t in range(300)]
    rows += [(2, 0, "as>sis<tant\n", "x"), (2, 0, "user", "tie b"), (2, 0, "user", "tie a"), (2, 0, "user", "tie a")]
    rows += [(None, 1, "user", "no id"), (3, None, None, None), (3, 1, "assistant", "a")]
    folder = str(tmp_path)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.withColumn("tree", F.lit("clash")).withColumn("id", F.lit(0)).write.parquet(f"{folder}/conversations.parquet")
    got = chat.op10_chat_formatting(spark, folder)
    assert len(got.collect()) == 5
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = db.execute(chat.OP10_SQL).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want), key=key)


def test_query_reads_back_what_went_in(spark):
    rows = {r.conv_id: r for r in chat.op10_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(text)
    assert rows[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat.op10_chat_formatting(spark, str(tmp_path)).collect()] == [-7]


def test_no_python_in_the_plan(spark):
    plan = chat.op10_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
