"""Minimum-cost-flow resharding: from old shard sizes to new capacities with the fewest bytes moved.

Old shards are what the caller says of each row (a column; rows without one are new and have none to stay in), or by a hash. Sizes
are UTF-8 bytes plus 8 a row. A group of equal texts in several old shards counts as in the one that holds most of it (ties: the
first), since the rest of it moves in any case. Rows of equal text form a group that stays together unless it outgrows a shard; then its
rows are groups of their own. Groups of over 1/200 of a shard (at most 200 for each shard, by that bound) are placed first,
largest first, where they lie if there is room. Then the remaining capacities are levelled so that all shards come out equal
in proportion to their weights, and a minimum-cost flow from the old shards' bytes to those capacities, at one unit for each
byte that leaves its shard, says how many bytes go where. The flow is realised by cutting each old shard's sequence of blocks of
groups at the flow's amounts: prefix sums over blocks, then over the groups in a block, each group going where its middle falls.
Slots are numbered the same way, by counts of buckets and a rank in the bucket. Planning shuffles no text; rewriting the affected
shards' files does, once.

Law `bytes`: shard sizes near equal (within about 1/100 of a shard where no single row is larger).
Null texts have no bytes (size 8, crc 0). Null ids, repeated rows and ties are ordered by id and text; an empty table gives an
empty result; other columns are ignored unless carried. Very long texts are rows like others: one over a shard's share makes that shard
larger. A caller's columns named shard and old_shard don't go into files, which have their own.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .base import cut, saved, shared_dir

OLD, NEW = 16, 24
LARGE = 200
BLOCK_ROWS = 20_000


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[float]]) -> list[list[int]]:
    """flow[i][j] of least total cost with row sums `supply` and column sums `demand` (equal totals).

    Successive shortest augmenting paths with potentials on the bipartite graph of shards.
    """
    n, m = len(supply), len(demand)
    assert sum(supply) == sum(demand), "supply and demand differ"
    flow = [[0] * m for _ in range(n)]
    left, want = list(supply), list(demand)
    potential = [0.0] * (n + m)
    while any(left):
        best = [float("inf")] * (n + m)
        back = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                best[i] = 0.0
                heap.append((0.0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u] + 1e-12:
                continue
            steps = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                to = d + c + potential[u] - potential[v]
                if to < best[v] - 1e-12:
                    best[v], back[v] = to, u
                    heapq.heappush(heap, (to, v))
        end = min((n + j for j in range(m) if want[j]), key=lambda v: best[v])
        far = best[end]
        for v in range(n + m):
            potential[v] += min(best[v], far)
        path, v = [end], end
        while back[v] >= 0:
            v = back[v]
            path.append(v)
        path.reverse()
        amount = min(left[path[0]], want[end - n], *(flow[v][u - n] for u, v in zip(path, path[1:], strict=False) if u >= n))
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        want[end - n] -= amount
    return flow


def level(total: int, taken: list[int], weights: list[float]) -> list[int]:
    """What each shard gets of `total` besides `taken` so that all end up in proportion to weights, or as near as may be."""
    open_, whole = list(range(len(taken))), total
    while True:
        height = (whole + sum(taken[j] for j in open_)) / sum(weights[j] for j in open_)
        over = [j for j in open_ if taken[j] > height * weights[j]]
        if not over:
            break
        open_ = [j for j in open_ if j not in over]
    out = [0] * len(taken)
    for j in open_:
        out[j] = int(height * weights[j] - taken[j])
    for k in range(total - sum(out)):
        out[open_[k % len(open_)]] += 1
    return out


def place_large(groups: list[tuple[int, int, int]], room: list[float]) -> tuple[dict[int, int], list[int]]:
    """Shard of each (group, bytes, old shard), and the bytes taken in each shard."""
    taken, out = [0] * len(room), {}
    for group, size, old in sorted(groups, key=lambda g: (-g[1], g[0])):
        j = old if old < len(room) and taken[old] + size <= room[old] else max(range(len(room)), key=lambda j: (room[j] - taken[j], -j))
        out[group] = j
        taken[j] += size
    return out, taken


def sized(docs: DataFrame, *carried: Column | str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.xxhash64("doc_id", text).alias("row_hash"), *carried,
    )


def plan(rows: DataFrame, old: Column | None = None, n_old: int | None = None, weights: list[float] | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unit, old, shard, bytes) of each group of `sized` rows, the rows with their unit and old shard, and (unit, old, bytes) of each
    group's part in each old shard. old: of rows, else by hash in n_old shards."""
    weights = weights or [1.0] * NEW
    by_text = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total, count, most = rows.agg(F.sum("size"), F.count("*"), F.max(F.lit(0) if old is None else old)).first()
    total = total or 0
    shard_bytes = total / len(weights)
    n_old = n_old or (OLD if old is None else int(most or 0) + 1)
    # groups that outgrow a shard are at most as many as the shards
    outgrown = [r.text_hash for r in by_text.where((F.col("bytes") > shard_bytes) & (F.col("n") > 1)).select("text_hash").collect()]
    unit = F.when(F.col("text_hash").isin(outgrown), F.col("row_hash")).otherwise(F.col("text_hash")) if outgrown else F.col("text_hash")
    blocks = max(1, -(-count // block_rows))  # as many in each old shard as if it held all rows
    new = max(n_old, len(weights))  # stands for the old shard of rows without one
    own = F.pmod(unit, F.lit(n_old)) if old is None else F.coalesce(old, F.lit(new))
    rows = rows.withColumn("unit", unit).withColumn("old", own.cast("int"))
    cells = cut(rows.groupBy("unit", "old").agg(F.sum("size").alias("bytes")))
    n_old = new + 1
    groups = cut(cells.groupBy("unit").agg(F.sum("bytes").alias("bytes"), F.max_by("old", F.struct("bytes", -F.col("old"))).alias("old")))
    large_at = shard_bytes / LARGE
    large = groups.where(F.col("bytes") > large_at)
    room = [total * w / sum(weights) for w in weights]
    placed, taken = place_large([(r.unit, r.bytes, r.old) for r in large.collect()], room)
    spark = rows.sparkSession
    placed = F.broadcast(spark.createDataFrame(list(placed.items()), T.StructType([T.StructField("unit", T.LongType()), T.StructField("shard", T.IntegerType())])))
    small = groups.where(F.col("bytes") <= large_at)
    small = small.withColumn("block", F.pmod(F.shiftright("unit", 17), F.lit(blocks)).cast("int"))
    sizes = cut(small.groupBy("old", "block").agg(F.sum("bytes").alias("bytes")))
    by_old = {r.old: r.bytes for r in sizes.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [by_old.get(i, 0) for i in range(n_old)]
    demand = level(sum(supply), taken, weights)
    flow = min_cost_flow(supply, demand, [[0.0 if i == j else 1.0 for j in range(len(weights))] for i in range(n_old)])
    cuts = []
    for i, row in enumerate(flow):
        end, parts = 0, []
        for j in sorted((j for j in range(len(weights)) if row[j]), key=lambda j: (j != i, j)):
            end += row[j]
            parts.append((float(end), j))
        cuts.append((i, parts or [(0.0, min(i, len(weights) - 1))]))
    cuts = F.broadcast(spark.createDataFrame(cuts, "cut_old int, cuts array<struct<end: double, shard: int>>"))
    starts = sizes.select(F.col("old").alias("start_old"), F.col("block").alias("start_block"), F.coalesce(F.sum("bytes").over(W.partitionBy("old").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = W.partitionBy("old", "block").orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
    small = small.withColumn("before", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    small = small.join(starts, (F.col("old") == F.col("start_old")) & (F.col("block") == F.col("start_block"))).join(cuts, F.col("old") == F.col("cut_old"))
    middle = F.col("start") + F.col("before") + F.col("bytes") / 2
    at = F.coalesce(F.get(F.filter("cuts", lambda c: middle < c["end"]), F.lit(0)), F.element_at("cuts", -1))
    small = small.select("unit", "old", at["shard"].alias("shard"), "bytes")
    return small.unionByName(large.join(placed, "unit").select("unit", "old", "shard", "bytes")), *(x.withColumn("old", F.nullif("old", F.lit(new))) for x in (rows, cells))


def slots(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (with shard, row_hash and doc_id) with slot: 0, 1, ... in each shard."""
    per_shard = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("bucket", F.pmod("row_hash", F.lit(per_shard)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("shard").alias("of_shard"), F.col("bucket").alias("of_bucket"), offset.alias("offset"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("row_hash", "doc_id")))
    rows = rows.join(counts, (F.col("shard") == F.col("of_shard")) & (F.col("bucket") == F.col("of_bucket")))
    return rows.withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long")).drop("of_shard", "of_bucket", "offset", "rank", "bucket")


def _placed(docs: DataFrame, old: Column | None, how: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`plan` of docs' rows; old: of docs."""
    rows = saved(sized(docs, *([] if old is None else [old.cast("int").alias("old")])), "sized")
    return plan(rows, None if old is None else F.col("old"), **how)


def reshard(docs: DataFrame, old: Column | None = None, **how) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: `bytes` depends on all rows), old_shard of each row."""
    groups, rows, _ = _placed(docs, old, how)
    out = slots(saved(rows.join(groups.select("unit", "shard"), "unit"), "sharded"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def with_shards(docs: DataFrame, **how) -> DataFrame:
    """docs with shard and slot, all of docs' columns kept inside the struct doc."""
    slim = reshard_rows(docs, **how)
    full = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("row_hash"))
    # copies of one row share a shard, and take its slots in any order
    nth = W.partitionBy("row_hash").orderBy("row_hash")
    slim = slim.withColumn("nth", F.row_number().over(nth))
    full = full.withColumn("nth", F.row_number().over(nth))
    return full.join(slim, ["row_hash", "nth"]).select("doc", "shard", "slot")


def reshard_rows(docs: DataFrame, old: Column | None = None, **how) -> DataFrame:
    """row_hash, shard, slot of each row."""
    groups, rows, _ = _placed(docs, old, how)
    return slots(saved(rows.join(groups.select("unit", "shard"), "unit"), "sharded")).select("row_hash", "shard", "slot")


def rewrite(docs: DataFrame, path: str, every: bool = False, old: Column | None = None, **how) -> list[int]:
    """Writes the shards whose rows change as Parquet under path/shard=N; returns their numbers. The others' files stay, and
    folders of shards that are left without rows go. With `every`, all shards are written: no file of the old layout is there.

    docs must not read from path itself. Files have docs' columns and old_shard (null: new). Rows are written where the join leaves
    them, so text is shuffled once.
    """
    return _rewrite(docs, path, every, old, how)[1]


def _rewrite(docs: DataFrame, path: str, every: bool, old: Column | None, how: dict) -> tuple[DataFrame, list[int]]:
    """The rows written, and the shards' numbers."""
    groups, rows, cells = _placed(docs, old, how)
    groups = cut(groups)
    held = {r[0] for r in groups.select("shard").distinct().collect()}
    moved = cells.join(groups.select("unit", "shard"), "unit").where(~F.col("old").eqNullSafe(F.col("shard")))
    hit = sorted(held if every else {r[0] for r in moved.select("shard").union(moved.select("old").where("old is not null")).distinct().collect()})
    names = ("row_hash", "unit", "old")
    where = rows.select(*names).distinct().join(groups.where(F.col("shard").isin(hit)).select("unit", "shard"), "unit")
    own = F.xxhash64("doc_id", F.col("text").cast("string")).alias("row_hash")
    full = docs.select(F.struct("*").alias("doc"), own, F.lit(None).cast("int").alias("own") if old is None else old.cast("int").alias("own"))
    # copies of a row may lie in several old shards, and each comes from its own
    where = where.select("row_hash", "shard", F.col("old").alias("old_shard")) if old is None else where.groupBy("row_hash").agg(F.first("shard").alias("shard"))
    full = full.join(where, "row_hash")
    full = full if old is None else full.withColumn("old_shard", F.col("own"))
    full = full.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("shard", "old_shard")], "old_shard", "shard")
    full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    spark = docs.sparkSession
    for j in set(hit) - held:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={j}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return full, hit


def reshard_files(docs: DataFrame, old: Column | None = None, **how) -> DataFrame:
    """What `reshard` returns, with the shards written to the shared folder and each column taken from the files read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    full, _ = _rewrite(docs, path, True, old, how)
    files = spark.read.schema(full.schema).parquet(path)
    out = slots(saved(sized(files, "shard", "old_shard"), "sharded"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def shard_of_source(n: int = OLD, source: str = "source") -> Column:
    """An old layout in which each source lies in one shard, as unequal as the sources are."""
    return F.pmod(F.xxhash64(F.col(source).cast("string")), F.lit(n)).cast("int")
