"""Texts of over a megabyte in operators that have no such test of their own."""

import hashlib

from pyspark.sql import functions as F

from cohortry.llm import chat, decontaminate, line_dedup, mixing, sharding

WORDS = " ".join(f"w{i}" for i in range(200_000))  # 1.3 MB


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "short </turn>"), (1, 1, "assistant", WORDS), (1, 2, "user", "again"), (1, 3, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(chat.read_chat(chat.format_chat(turns))).collect()
    whole = "".join(f"{role}\n{text}\n" for role, text in (("user", "short </turn>"), ("assistant", WORDS), ("user", "again"), ("assistant", "ok")))
    assert r.n_turns == 4 and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.loss_chars == len(WORDS) + 2


def test_sharding(spark):
    rows = [(i, WORDS if i % 50 == 7 else f"text {i}") for i in range(200)]
    out = sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.size for r in out} == {i: len(t) + 8 for i, t in rows}


def test_decontamination(spark):
    item = " ".join(f"bench{i}" for i in range(30))
    docs = spark.createDataFrame([(1, WORDS + " " + item + " " + WORDS), (2, WORDS), (3, item[:100])], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 3]


def test_line_dedup(spark):
    line = "this line is on every site there is, whoever wrote it"
    rows = [(i, f"s{i}", line + "\n" + (WORDS if i == 3 else f"own {i}")) for i in range(15)]
    out = line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {r.doc_id: r.n for r in out.select("doc.doc_id", F.length("clean").alias("n")).collect()}[3] == len(WORDS)


def test_mixing(spark):
    rows = [(1, "a", WORDS), (2, "a", "one two"), (3, "b", "three four five"), (4, None, WORDS)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).select("doc.doc_id", "n_tokens").collect()
    assert {r.doc_id: r.n_tokens for r in out} == {1: 200_000, 2: 2, 3: 3, 4: 200_000}
