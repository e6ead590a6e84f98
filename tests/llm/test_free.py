"""Operators 4 and 6, and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from cohortry.llm import decontaminate, sharding
from cohortry.llm.base import table
from cohortry.llm.decontaminate import contaminated, shingles_of

# sharding


def check_shards(rows, docs, shards=24, slack=None):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    sizes, slots, texts = Counter(), defaultdict(list), defaultdict(set)
    size_of, crc_of = defaultdict(set), defaultdict(set)
    for d, t in docs:
        size_of[d].add(len((t or "").encode()) + 8)
        crc_of[d].add(zlib.crc32((t or "").encode()))
    for r in rows:
        assert r.size in size_of[r.doc_id] and r.text_crc32 in crc_of[r.doc_id] and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        texts[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(sizes.values()) / shards
    slack = max(max(r.size for r in rows), mean / 50) if slack is None else slack
    assert all(abs(sizes[j] - mean) <= slack for j in range(shards)), sorted(sizes.values())
    return texts


def test_reshard_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for block in (20_000, 9):
        texts = check_shards(sharding.reshard(docs, block_rows=block).collect(), [(r.doc_id, r.text) for r in docs.collect()])
        assert all(len(x) == 1 for x in texts.values())


def test_reshard_edges(spark):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(3000)] + [(5000 + i, "a large group of copies " * 5) for i in range(1500)] + [(None, None), (None, ""), (1, "text 1 "), (1, "text 1 "), (9000, "é" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("unit", F.lit(0))
    check_shards(sharding.reshard(df).collect(), rows)
    assert sharding.reshard(df.where("doc_id < 0")).count() == 0
    check_shards(sharding.reshard(df.limit(1)).collect(), [(rows[0])], slack=10**9)
    out = sharding.with_shards(df).select("doc.doc_id", "doc.text", "doc.unit", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    assert len({(r.shard, r.slot) for r in out}) == len(rows)


def test_rewrite_leaves_other_shards(spark, tmp_path):
    rows = [(i, f"text {i}", i % 4) for i in range(400)] + [(1000 + i, f"more {i}", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, now int")
    even = spark.createDataFrame([(i, "same size", i % 4) for i in range(400)], "doc_id long, text string, now int").withColumn("text", F.concat("text", F.col("doc_id") + 1000))
    weights = [1.0] * 4
    rows_of = lambda d: sharding.sized(d).join(d.select("doc_id", F.col("now").alias("old_now")), "doc_id")
    groups, _, _ = sharding.plan(rows_of(even), old=F.col("old_now"), n_old=4, weights=weights)
    assert groups.where("old <> shard").count() == 0
    groups, _, _ = sharding.plan(rows_of(df), old=F.col("old_now"), n_old=4, weights=weights)
    moved = groups.where("old <> shard").agg(F.sum("bytes")).first()[0]
    by = Counter()
    for r in groups.collect():
        by[r.old] += r.bytes
    mean = sum(by.values()) / 4
    assert abs(moved - sum(max(0, x - mean) for x in by.values())) <= 4 * 20
    hit = sharding.rewrite(df, str(tmp_path / "out"), n_old=4, weights=weights)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(r[0] for r in back.select("shard").distinct().collect()) <= set(hit)


def test_query_rewrites_shards_and_reads_them(spark, sf_dir):
    from pathlib import Path

    from cohortry.llm.base import shared_dir
    from cohortry.llm.queries import QUERIES

    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.glob("shards-*"))
    rows = QUERIES["op4_min_cost_flow_resharding"](spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents")
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    (made,) = set(root.glob("shards-*")) - before
    files = spark.read.parquet(str(made))
    assert Counter(map(tuple, files.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert Counter((r.doc_id, r.shard, r.old_shard) for r in files.collect()) == Counter((r.doc_id, r.shard, r.old_shard) for r in rows)
    assert sharding.reshard_files(docs.where("doc_id < 0")).count() == 0
    ties = spark.createDataFrame([(None, None, 1), (None, "", 2), (1, "a", 3), (1, "a", 3)], "doc_id long, text string, old_shard int")
    assert Counter(r.doc_id for r in sharding.reshard_files(ties).collect()) == Counter([None, None, 1, 1])


def test_rewrite_deletes_emptied_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string").withColumn("shard", F.expr("pmod(xxhash64(text), 4)").cast("int"))
    df.write.partitionBy("shard").parquet(path)
    assert (tmp_path / "out/shard=3").exists()
    assert 3 in sharding.rewrite(df, path, n_old=4, weights=[1.0] * 3)
    assert not (tmp_path / "out/shard=3").exists()
    assert Counter(r.doc_id for r in spark.read.parquet(path).collect()) == Counter(range(400))


def test_rewrite_from_given_shards(spark, tmp_path):
    """Fewest bytes move, only touched shards' files are written, rows are whole, and equal texts come together."""
    path = tmp_path / "out"
    rows = [(i, f"text {i:04d}", i % 3, "k") for i in range(300)] + [(1000 + i, f"more {i:04d}", 1, "k") for i in range(150)]
    rows += [(2000 + i, "the same text", i % 2 * 2, "k") for i in range(9)] + [(3000, None, 2, "k"), (3000, None, 2, "k"), (3001, "a new row", None, "k")]
    # shards 3 and 4 are as full as all are to be, so they stay
    rows += [(4000 + i, f"text {i:04d}!", 3 + i % 2, "k") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, unit string")
    df.where("shard is not null").write.partitionBy("shard").parquet(str(path))
    before = {f.name: f.stat().st_mtime_ns for f in path.glob("shard=4/*")}
    size = lambda t: len((t or "").encode()) + 8
    total = Counter()
    for _, t, j, _ in rows:
        total[j] += size(t)
    goal = [total[j] for j in range(5)]
    rest = sum(total[j] for j in (0, 1, 2, None)) / 3
    weights = [rest, rest, rest, float(goal[3]), float(goal[4])]
    hit = sharding.rewrite(df, str(path), old=F.col("shard"), weights=weights)
    back = spark.read.parquet(str(path)).select("doc_id", "text", "unit", "shard").collect()
    assert Counter((r.doc_id, r.text, r.unit) for r in back) == Counter((d, t, u) for d, t, _, u in rows)
    assert len({r.shard for r in back if r.text == "the same text"}) == 1
    was = {d: j for d, _, j, _ in rows}
    moved = sum(size(r.text) for r in back if was[r.doc_id] is not None and was[r.doc_id] != r.shard)
    over = sum(max(0, total[j] - rest) for j in range(3))
    together = 4 * size("the same text")
    assert over - 60 <= moved <= over + together + 60
    assert hit == [0, 1, 2]
    assert {f.name: f.stat().st_mtime_ns for f in path.glob("shard=4/*")} == before
    out = sharding.reshard(df, old=F.col("shard")).collect()
    check_shards(out, [(d, t) for d, t, _, _ in rows])
    assert Counter((r.doc_id, r.old_shard) for r in out) == Counter((d, j) for d, _, j, _ in rows)


@pytest.mark.parametrize("seed", range(6))
def test_flow_costs_least(seed):
    import random

    rng = random.Random(seed)
    supply = [rng.randint(0, 4) for _ in range(3)]
    demand = [0, 0, 0]
    for _ in range(sum(supply)):
        demand[rng.randrange(3)] += 1
    cost = [[float(rng.randint(0, 5)) for _ in range(3)] for _ in range(3)]
    flow = sharding.min_cost_flow(supply, demand, cost)
    assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == demand
    spend = lambda f: sum(f[i][j] * cost[i][j] for i in range(3) for j in range(3))
    splits = lambda n: [x for x in product(range(n + 1), repeat=3) if sum(x) == n]
    least = min(spend(f) for f in product(*map(splits, supply)) if [sum(c) for c in zip(*f, strict=True)] == demand)
    assert abs(spend(flow) - least) < 1e-9


# decontamination


def brute_items(docs, items):
    sets = [(i, shingles_of(t)) for i, t in items]
    out = []
    for d, t in docs:
        own = shingles_of(t)
        out += [(d, i, len(own & s), len(s)) for i, s in sets if s and 100 * len(own & s) >= 75 * len(s)]
    return sorted(out, key=str)


def test_contaminated_whole_table(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = brute_items([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for most in (decontaminate.MAX_ITEM_HASHES, 1500):
        assert sorted(map(tuple, contaminated(docs, items, max_hashes=most).collect()), key=str) == want
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns
    bad = {x[0] for x in want}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in bad)


def test_contaminated_edges(spark):
    item = " ".join(f"q{i}" for i in range(40))
    part = lambda k: " ".join(f"q{i}" for i in range(k))
    filler = " ".join(f"f{i}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, filler + " " + item.upper() + "\n" + filler), (4, part(31)), (5, part(30)), (None, item), (6, "two words"), (6, "Two\twords"), (7, "x two words"), (3, item)]
    items = [(1, item), (2, "two words"), (3, None), (4, " "), (None, item), (5, item + " more of it"), (1, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("row", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contaminated(d, b).collect()), key=str) == brute_items(docs, items)
    left = Counter((r.doc_id, r.text) for r in decontaminate.decontaminate(d, b).collect())
    assert left == Counter([(1, None), (2, ""), (5, part(30)), (7, "x two words")])
    assert contaminated(d, b.where("item_id = 99")).count() == 0 and contaminated(d.where("doc_id = 99"), b).count() == 0


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    docs = table(spark, sf_dir, "documents")
    columns, at = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        from cohortry.llm.base import saved

        at = saved(stage(spark, at, sf_dir), "test-" + name)
        seen[name] = at
        if name != "shard":
            assert at.columns == columns
    ids = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    assert all(len(words(r.text)) > 0 for r in seen["quality"].collect())
    assert set(ids["decontaminate"]) <= set(ids["near_dedup"]) <= set(ids["quality"])
    assert max(ids["near_dedup"].values()) == 1
    assert set(ids["mix"]) == set(ids["decontaminate"]) and sum(ids["mix"].values()) > len(ids["mix"])
    assert ids["shard"] == ids["mix"]
    bad = {x[0] for x in brute_items([(r.doc_id, r.text) for r in seen["near_dedup"].collect()], [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])}
    assert set(ids["decontaminate"]) == set(ids["near_dedup"]) - bad


def test_stages_take_nulls_ties_and_clashing_names(spark, sf_dir):
    import corpus_pipeline
    from cohortry.llm.base import saved

    good = lambda k: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(15)) for i in range(5))
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    rows = [(1, good(1), "en", "a"), (2, good(1), "en", "a"), (2, good(1), "en", "a"), (None, good(2), None, None), (3, None, "en", "a"), (4, "", None, "b"), (5, good(3) + "\n" + item, "en", "b"), (6, "z " * 60_000, "en", "a"), (7, " ".join(good(k) for k in range(100, 400)), "de", "c"), (8, good(4), "en", "b"), (8, good(5), "en", "b")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 7, 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tag string, shard int, kept double")
    at = saved(df, "edges")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = saved(stage(spark, at, sf_dir), name)
        assert at.columns == df.columns and at.where("tag = 'k' and shard = 7 and kept = 1.5").count() == at.count()
    assert {(r.doc_id, r.text) for r in at.collect()} == {(1, good(1)), (None, good(2)), (7, rows[8][1]), (8, good(4)), (8, good(5))}
    last = corpus_pipeline.shard_stage(spark, at, sf_dir)
    assert last.count() == at.count() and last.select("shard", "slot").distinct().count() == at.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("doc_id = 99"), sf_dir).count() == 0
