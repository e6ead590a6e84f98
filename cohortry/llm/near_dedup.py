"""Near-duplicate documents: HyperMinHash sketches, banding, estimates, then exact verification.

Signature. One pass hashes each text's shingle set. The top bits of a hash name one of 128 buckets; of the smallest remainder
in each bucket a 16-bit register keeps the leading-zero count and ten mantissa bits. Empty registers are filled from other
buckets in a fixed random order for banding only.

Candidates. Texts with equal sets collapse to one class first. Classes of over `SMALL` shingles are banded: 40 keys of four
registers each; of 16,000 simulated pairs at the threshold none lacked a common key. Classes of up to `PREFIX` shingles
emit the n - ceil(0.75 n) + 1 smallest hashes instead, which misses no pair that has a set of up to `SMALL` shingles. Both
kinds of key are joined to the smallest class that has the key (no pairs within a group); estimates prune, full sets confirm,
components merge. Keys whose classes are then in several components are compared in blocks: pairs across
components that pass the estimate are verified in place, and only links that join what wasn't joined leave the block. Every candidate pair is thus either within a
component already, or estimated far below the threshold, or verified.

Null or word-less texts link with nothing. Repeated rows, equal ids and null ids are kept as rows; a null id never names a
component that has another id. An empty table gives an empty result. Extra columns play no part. A very long text is sketched
and verified whole, in memory in proportion to its words; pairs at exactly the threshold are links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import cut, discard, saved
from .components import connected_components
from .decontaminate import sets_sql
from .shingles import U, mix, set_of, shingle_sets, slices

THRESHOLD = 75
BUCKETS, BUCKET_BITS, MANTISSA = 128, 7, 10
BANDS, ROWS = 40, 4
SMALL, PREFIX = 96, 128
#: Estimates below this don't go to verification: five standard deviations or more under the threshold.
PRUNE = 0.5
#: Rows, and their shingles, in a block of a key.
BLOCK, BLOCK_SHINGLES = 512, 500_000


def _orders(seed: int, rows: int) -> np.ndarray:
    """For each of rows, a fixed random order of the buckets."""
    return np.argsort(mix(np.arange(rows * BUCKETS, dtype=U) + U(seed << 32)).reshape(rows, BUCKETS), axis=1)


_FILL = _orders(1, BUCKETS)
_BAND = _orders(2, BANDS)[:, :ROWS]


def registers(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each row's sorted hashes: (leading zeros + 1) << 10 | mantissa; 0 where empty."""
    out = np.zeros((len(n), BUCKETS), np.uint16)
    row = np.repeat(np.arange(len(n)), n)
    slot = row * BUCKETS + (hashes >> U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    left = (hashes[first] << U(BUCKET_BITS)) >> U(11)
    m, e = np.frexp(left.astype(np.float64))
    zeros = np.where(left == 0, 53, 53 - e)
    kept = np.where(left == 0, 0, m * (2 << MANTISSA) - (1 << MANTISSA)).astype(np.int64)
    out.reshape(-1)[slot[first]] = ((zeros + 1) << MANTISSA | kept).astype(np.uint16)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """regs with each empty register taken from the first full one in the bucket's fixed order."""
    out = regs.copy()
    for t in range(BUCKETS):
        row, col = np.nonzero(out == 0)
        if not len(row):
            break
        out[row, col] = regs[row, _FILL[col, t]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers: equal ones over those full in either, less the collisions expected by chance."""
    either = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    # two unequal minima agree in their zeros with a probability of about 1/3, and then in the mantissa with about 2**-10
    chance = 1 / (3 * (1 << MANTISSA))
    raw = equal / np.maximum(either, 1)
    return np.clip((raw - chance) / (1 - chance), 0, 1)


def passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which pairs go to verification.

    Where two registers differ, an element is in one of the sets alone; sets at the threshold have at most (na + nb) * (100 - t) / (100 + t)
    such elements, so pairs with more registers that differ are below it for certain. Small sets fill few registers, so their other
    pairs go without an estimate.
    """
    alone = (a != b).sum(-1)
    return (alone * (100 + THRESHOLD) <= (na + nb) * (100 - THRESHOLD)) & ((np.maximum(na, nb) <= PREFIX) | (estimate(a, b, na, nb) >= PRUNE))


def keys(hashes: np.ndarray, n: np.ndarray, regs: np.ndarray) -> list[np.ndarray]:
    """The candidate keys of each row."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(n)
    many = np.flatnonzero(n > SMALL)
    if len(many):
        full = filled(regs[many]).astype(U)
        packed = np.zeros((len(many), BANDS), U)
        for i in range(ROWS):
            packed |= full[:, _BAND[:, i]] << U(16 * i)
        packed = mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=U)))
        for i, x in zip(many, packed, strict=True):
            out[i] = x.view(np.int64)
    ends = np.cumsum(n)
    for i in np.flatnonzero((n > 0) & (n <= PREFIX)):
        some = mix(hashes[ends[i] - n[i] : ends[i]][: n[i] - -(-n[i] * THRESHOLD // 100) + 1] ^ U(0xA5A5A5A5))
        out[i] = np.concatenate([out[i], some.view(np.int64)])
    return out


def prints(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row's set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes ^ U(3)), dtype=U)])
    at = np.concatenate([[0], np.cumsum(n)])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ n.astype(U)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column("text")):
            h, n = shingle_sets(data, offsets)
            regs = registers(h, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("tag").slice(i, j - i), pa.array(n, pa.int64()), pa.array(prints(h, n)),
                 pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(keys(h, n, regs), pa.list_(pa.int64()))],
                ["doc_id", "tag", "n", "node", "regs", "keys"],
            )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with the name of its set."""
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(prints(*shingle_sets(data, offsets))), batch.column(0).slice(i, j - i)], ["node", "text"])


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate passes."""
    for batch in batches:
        side = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b")]
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        fits = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * THRESHOLD
        yield batch.select(["a", "b"]).filter(pa.array(fits & passes(*side, na, nb)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    last: tuple = (None, None)
    for batch in batches:
        yes = []
        for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
            if last[0] != a:
                last = a, set_of(x.as_py())
            one, other = last[1], set_of(y.as_py())
            both = len(np.intersect1d(one, other, assume_unique=True))
            yes.append(100 * both >= THRESHOLD * (len(one) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join components, of one block pair of a key: pairs of rows of different components that pass the estimate are
    verified on their full sets in place; of the links found only those that join what wasn't joined yet come out."""
    regs = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(-1, BUCKETS)
    node, n, part = (pdf[c].to_numpy() for c in ("node", "n", "part"))
    comp = pdf["component"].to_numpy().copy()
    same_block = bool(pdf["x"].iloc[0] == pdf["y"].iloc[0])
    left = np.arange(len(pdf)) if same_block else np.flatnonzero(part == pdf["x"].iloc[0])
    right = left if same_block else np.flatnonzero(part == pdf["y"].iloc[0])
    near = {}
    for i in left:
        others = right[(comp[right] != comp[i]) & ((node[right] > node[i]) | (not same_block))]
        others = others[np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * THRESHOLD]
        if len(others):
            others = others[passes(regs[others], regs[i][None], n[others], n[i])]
            if len(others):
                near[i] = others
    if not near:
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    used = np.unique(np.concatenate([np.fromiter(near, np.int64), *near.values()]))
    texts = pdf["text"].to_numpy()
    sets = [set_of(texts[i]) for i in used]
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    starts = ends - [len(x) for x in sets]
    at = dict(zip(used.tolist(), range(len(used)), strict=True))
    mark, found = np.zeros(len(values), bool), []
    for i, others in near.items():
        others = others[comp[others] != comp[i]]
        if not len(others):
            continue
        own = flat[starts[at[i]] : ends[at[i]]]
        mark[own] = True
        for j in others:
            if comp[j] != comp[i]:
                other = flat[starts[at[j]] : ends[at[j]]]
                both = int(np.count_nonzero(mark[other]))
                if 100 * both >= THRESHOLD * (len(own) + len(other) - both):
                    found.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        mark[own] = False
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")


def row_name() -> Column:
    """A name for a row by its id and text."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, tag (row_name), n_shingles, group (names the component), component_id (its smallest id, or null) of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_name().alias("tag"))
    rows = saved(docs.mapInArrow(_sketch, "doc_id long, tag long, n long, node long, regs binary, keys array<long>"), "sketches")
    unique = saved(rows.where("n > 0").select("node", "n", "regs", "keys").dropDuplicates(["node"]), "classes")
    sketch = unique.select("node", "n", "regs")

    keyed = unique.select(F.explode("keys").alias("key"), "node")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub < most").drop("most")
    members = saved(keyed.join(hubs, "key"), "members")
    # as texts may be long, only those of classes that share a key are kept, once each
    shared = members.select("node").distinct()
    texts = saved(docs.select("text").mapInArrow(_named, "node long, text string").join(shared, "node", "left_semi").dropDuplicates(["node"]), "texts")

    stars = members.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tested = stars.join(sketch.toDF("b", "nb", "regs_b"), "b").join(sketch.toDF("a", "na", "regs_a"), "a").mapInArrow(_passing, "a long, b long")
    links = saved(_confirm(tested, texts), "links")
    label = connected_components(links)

    placed = members.join(label, "node", "left").join(unique.select("node", "n"), "node").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    # a key of two classes had its only pair tested; of keys with the same classes one is enough
    open_keys = placed.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum("n").alias("shingles"))
    open_keys = open_keys.where("least < most and size > 2").groupBy("who", "size").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    spread = placed.join(open_keys.select("key", parts.alias("parts")), "key")
    spread = spread.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = spread.select("key", "node", "component", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    more = saved(spread.join(sketch, "node").join(texts, "node").groupBy("key", "x", "y").applyInPandas(_across, "a long, b long"), "links")
    label = cut(connected_components(links.union(more)))
    discard(unique, members, texts, links, more)

    held = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"))
    held = held.join(label, "node", "left").select("node", "id", F.coalesce("component", "node").alias("group"))
    least = held.groupBy("group").agg(F.min("id").alias("component_id"))
    out = rows.select("doc_id", "tag", "n", "node").join(held.join(least, "group").select("node", "group", "component_id"), "node", "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id", "tag", F.col("n").alias("n_shingles"), F.when(empty, F.col("tag")).otherwise(F.col("group")).alias("group"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    component_id is the smallest id among the rows linked, null if none of them has one; kept: the row's id is that.
    """
    out = groups(docs).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, that of the smallest id (null only if none has one); texts without words all stay."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag"))
    winners = groups(docs).groupBy("group", F.col("n_shingles") == 0).agg(first.alias("w")).select(F.col("w.tag").alias("tag"))
    full = docs.select(F.struct("*").alias("doc"), row_name().alias("tag")).join(winners, "tag", "left_semi")
    full = full.withColumn("nth", F.row_number().over(W.partitionBy("tag").orderBy("tag"))).where("nth = 1")
    return full.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


#: Links are found by joining all sets' shingles; each row's id is carried along them to those that it reaches.
SQL = f"""
WITH RECURSIVE {sets_sql("d", "documents", "doc_id")},
n AS (SELECT rid, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS s FROM d a JOIN d b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * s >= {THRESHOLD} * (x.n + y.n - s)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT rid, rid FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT r.a AS rid, min(doc_id) AS component_id FROM r JOIN dw ON dw.rid = r.b GROUP BY 1),
o AS (SELECT doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE component_id END AS component_id FROM dw LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
      UNION ALL SELECT doc_id, 0, doc_id FROM documents WHERE text IS NULL)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""
