"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights. A source with n tokens of all N has the share n / N; at exponent x its weight is share**x, normalised. x = 1 leaves the
shares, x = 0 makes sources equal. The exponent is bisected over distributed sums on the table of sources (one row each), `POINTS`
exponents a round in one aggregation, until the weights' entropy reaches a target, or until no source is repeated more than a limit;
only sums reach the driver.

Budget. None: the fewest tokens with which every document is used once at least (so nothing is lost, and smaller sources
repeat). Otherwise a number of tokens.

Realisation. A source's quota is its weight times the budget. Epoch e permutes the source's blocks, and the documents in each
block, by hashes of (seed, epoch); whole epochs are emitted and the last is cut where its tokens reach the quota. Offsets are
prefix sums over blocks, then within a block, so no task sees more than one block of documents; copies of one row travel as one row with a count. Everything is DataFrame functions.

Null sources are a source. Null or word-less texts have no tokens: they come once in each epoch that reaches their place; a
source without tokens comes once. Repeated rows are rows of their own and ties are broken by text and id. An empty table gives
an empty result. Other columns are passed through inside a struct and may have any name. A very long text is one row, whose tokens
may pass a source's quota by themselves; a quota's end lies within its last row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import cut, meet, n_words, saved

#: Exponents looked at in a round, and how near to the right one is near enough.
POINTS, NEAR = 100, 1e-6
BLOCK_DOCS = 20_000
#: The plan of sources may be broadcast up to this size; beyond, rows meet it in so many parts for each source.
BROADCAST_BYTES, SOURCE_PARTS = 16 << 20, 32
MAX_REPEATS = 2.0
SEED = 17


def slim_rows(docs: DataFrame, source: str = "source") -> DataFrame:
    """source, name (of the id and the text), n_tokens, copies: docs without their texts, counted once."""
    rows = docs.select(F.col(source).cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("name"), n_words(F.col("text").cast("string")).alias("n_tokens"))
    return rows.groupBy("source", "name", "n_tokens").agg(F.count("*").alias("copies"))


def source_totals(slim: DataFrame) -> DataFrame:
    """source, tokens, docs of each source."""
    return slim.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("docs"))


def _sums(totals: DataFrame, xs: list[float]) -> list[tuple[float, float, float, float]]:
    """For each exponent the entropy of its weights, their normaliser, the largest weight over share over the least, and the least."""
    p = F.col("share")
    each = [(F.sum(F.pow(p, F.lit(x))), F.sum(F.pow(p, F.lit(x)) * F.log(p)), F.max(F.pow(p, F.lit(x - 1))), F.min(F.pow(p, F.lit(x - 1)))) for x in xs]
    row = totals.agg(*[c.alias(f"c{i}_{k}") for i, cs in enumerate(each) for k, c in enumerate(cs)]).first()
    out = []
    for i, x in enumerate(xs):
        z, zl, most, least = row[4 * i : 4 * i + 4]
        out.append((math.log(z) - x * zl / z, z, most / least, least))
    return out


def solve(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None) -> tuple[float, DataFrame, float]:
    """(exponent, totals with share and weight, budget in tokens); the smallest exponent that meets each condition given.

    Entropy falls as the exponent grows from 0 to 1, and so do repeats of the smallest source. A target above the highest
    entropy gives 0; one below that of the shares gives 1.
    """
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    totals = totals.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    full = totals.where("tokens > 0")
    if not total:
        return 1.0, totals.withColumn("weight", F.lit(0.0)), 0.0

    def fits(entropy: float, z: float, spread: float, least: float) -> bool:
        repeats = spread if budget is None else budget / total * spread * least / z
        return (max_repeats is None or repeats <= max_repeats) and (target_entropy is None or entropy <= target_entropy)

    low, high = 0.0, 1.0
    if fits(*_sums(full, [low])[0]):
        high = low
    while high - low > NEAR:
        # the first point that fits is the new high, the one before it the new low
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        first = next((i for i, s in enumerate(_sums(full, points)) if fits(*s)), POINTS)
        points = [low, *points, high]
        low, high = points[first], points[first + 1]
    _, z, _, least = _sums(full, [high])[0]
    weighted = totals.withColumn("weight", F.when(F.col("tokens") > 0, F.pow("share", F.lit(high)) / z).otherwise(0.0))
    return high, weighted, float(budget) if budget is not None else total * z / least


def _rank(*parts: Column | int | str) -> Column:
    return F.xxhash64(*[F.lit(x) if isinstance(x, (int, str)) else x for x in parts])


def mix(docs: DataFrame, source: str = "source", target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, seed: int = SEED, block_docs: int = BLOCK_DOCS, broadcast_bytes: int | None = None) -> DataFrame:
    """doc (all columns of docs as a struct), n_tokens, epoch, block, position (tokens before it in its source's epoch)."""
    slim = saved(slim_rows(docs, source), "slim")
    totals = cut(source_totals(slim))
    _, weighted, tokens = solve(totals, target_entropy, max_repeats, budget)
    # a source's number of blocks follows its documents
    plan = weighted.select(
        F.col("source").alias("of"), F.col("tokens").alias("pass"), F.greatest(F.ceil(F.col("docs") / block_docs), F.lit(1)).alias("blocks"),
        F.greatest(F.when(F.col("tokens") > 0, F.round(F.col("weight") * tokens)).otherwise(1.0).cast("long"), F.col("tokens") if budget is None else F.lit(0)).alias("quota"),
    )
    plan = cut(plan.withColumn("epochs", F.greatest(F.ceil(F.col("quota") / F.greatest("pass", F.lit(1))), F.lit(1)).cast("int")).where("quota > 0"))
    slim = meet(slim, plan.withColumnRenamed("of", "source"), "source", F.col("name"), BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes, SOURCE_PARTS).where("quota > 0")
    slim = slim.withColumn("block", F.pmod(_rank(seed, "block", F.col("name")), F.col("blocks")).cast("long"))
    slim = slim.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    # where each block of each epoch starts, from the sums of the blocks
    sizes = slim.groupBy("source", "block", "epoch").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("size"))
    order = W.partitionBy("source", "epoch").orderBy(_rank(seed, F.col("epoch"), F.col("block")), "block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("source").alias("of"), F.col("epoch").alias("of_epoch"), F.col("block").alias("of_block"), F.coalesce(F.sum("size").over(order), F.lit(0)).alias("start"))
    within = W.partitionBy("source", "block", "epoch").orderBy(_rank(seed, F.col("epoch"), F.col("name")), "name").rowsBetween(W.unboundedPreceding, -1)
    slim = slim.withColumn("before", F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(within), F.lit(0)))
    slim = slim.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")) & (F.col("epoch") == F.col("of_epoch"))).drop("of")
    slim = slim.withColumn("position", F.col("start") + F.col("before"))
    # of the copies of a row as many as start before the quota's end; whole epochs keep all
    left = F.col("quota") - F.col("epoch") * F.col("pass") - F.col("position")
    fit = F.when(left >= F.col("n_tokens") * F.col("copies"), F.col("copies")).when(F.col("n_tokens") > 0, F.ceil(left / F.col("n_tokens"))).otherwise(0)
    fit = F.when((F.col("pass") == 0) & (F.col("epoch") == 0), F.col("copies")).otherwise(F.least(F.greatest(fit, F.lit(0)), F.col("copies")))
    slim = slim.withColumn("fit", fit.cast("long")).where("fit > 0")
    use = slim.groupBy(F.col("source").alias("of"), F.col("name").alias("of_name"), "n_tokens", "copies", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "position", "fit"))).alias("uses"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(source).cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("name"))
    found = rows.join(use, F.col("source").eqNullSafe(F.col("of")) & (F.col("name") == F.col("of_name")))
    # which of several copies a row is matters only where some of them don't fit
    short = F.exists("uses", lambda u: u["fit"] < F.col("copies"))
    alone = W.partitionBy("source", "name").orderBy("n_tokens")
    found = found.where(~short).withColumn("nth", F.lit(0).cast("long")).union(found.where(short).withColumn("nth", F.row_number().over(alone).cast("long") - 1))
    out = found.select("doc", "n_tokens", "block", "nth", F.explode("uses").alias("use")).where(F.col("nth") < F.col("use.fit"))
    return out.select("doc", "n_tokens", F.col("use.epoch").alias("epoch"), "block", (F.col("use.position") + F.col("nth") * F.col("n_tokens")).alias("position"))
