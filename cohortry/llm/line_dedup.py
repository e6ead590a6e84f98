"""Cross-site line dedup: lines that many distinct sites share are boilerplate and go.

Each distinct normalised line (lower case, white space as one space) of at least `MIN_CHARS` gets a HyperLogLog sketch of the sites
that hold it, in one aggregation: each task builds its own sketches before the shuffle, which merges them, so a line on a third of
all pages travels as one sketch a task. Lines whose estimate is clear of the threshold by three standard errors are decided by it; those
near it get an exact distinct count of their sites. Lines on `sites` or more distinct sites go from every document; the
texts that remain keep their order.

Documents don't travel with their lines: only hashes do, and each document meets the hashes of its own lines that go. Tables of
lines are broadcast where their measured size allows; beyond that they meet rows in parts, so that no line is one task.

Null texts stay null and hold no lines; a null site is no site; rows with one id and text are treated alike; null ids are rows;
an empty table gives an empty result; other columns are passed through inside a struct and may have any name. A line on exactly
`sites` sites goes. A very long text takes memory in proportion to its lines, in its own row's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, meet, saved

SITES, MIN_CHARS = 10, 1
#: Lines that may be broadcast, and the parts in which more of them meet rows.
BROADCAST_BYTES, LINE_PARTS = 16 << 20, 32
LG_K = 12
#: White space that isn't one space already.
SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: Three standard errors of a sketch of 2**12 registers, and one site.
ERROR = 3 * 1.04 / 64


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(norm(line))


def held_lines(docs: DataFrame, site: str = "source", min_chars: int = MIN_CHARS) -> DataFrame:
    """name (of a row's id and text), site, line (hash): each distinct line of each row."""
    text = F.col("text").cast("string")
    each = F.array_distinct(F.transform(F.filter(F.transform(lines(text), norm), lambda x: F.length(x) >= min_chars), lambda x: F.xxhash64(x)))
    return docs.where(text.isNotNull()).select(F.xxhash64("doc_id", text).alias("name"), F.col(site).cast("string").alias("site"), F.explode(each).alias("line"))


def held_by(held: DataFrame, some: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of held whose line is in some (line)."""
    marked = some.select("line", F.lit(1).cast("long").alias("here"))
    return meet(held, marked, "line", F.xxhash64(*held.columns), most, LINE_PARTS).where("here = 1").drop("here")


def spread(held: DataFrame, sites: int = SITES, most: int = BROADCAST_BYTES) -> DataFrame:
    """line, n_sites (estimated, or exact near the threshold), exact: of each line on enough sites."""
    held = held.where("site is not null").select("site", "line")
    sketched = held.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"))
    sketched = cut(sketched.select("line", F.hll_sketch_estimate("sites").alias("n")).where(F.col("n") >= sites * (1 - ERROR) - 1))
    clear = F.col("n") > sites * (1 + ERROR) + 1
    pairs = held_by(held, sketched.where(~clear), most).distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= sites)
    return sketched.where(clear).select("line", F.col("n").alias("n_sites"), F.lit(False).alias("exact")).union(exact.select("line", "n_sites", F.lit(True)))


def remove_lines(docs: DataFrame, site: str = "source", sites: int = SITES, min_chars: int = MIN_CHARS, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc (all columns of docs as a struct), n_lines (with a word), n_removed, clean."""
    held = saved(held_lines(docs, site, min_chars), "lines")
    common = cut(spread(held, sites, most).select("line"))
    # the hashes of the lines that go, gathered by row
    go = held_by(held, common, most).groupBy("name").agg(F.collect_set("line").alias("go"))
    full = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("name")).join(go, "name", "left").drop("name")
    own = F.col("doc.text").cast("string")
    bad = lambda x: (F.length(norm(x)) >= min_chars) & F.array_contains(F.col("go"), line_hash(x))
    full = full.withColumn("gone", F.when(F.col("go").isNotNull(), F.size(F.filter(lines(own), bad))).otherwise(0).cast("long"))
    clean = F.when(F.col("gone") > 0, F.array_join(F.filter(lines(own), lambda x: ~bad(x)), "\n")).otherwise(own)
    n_lines = F.coalesce(F.size(F.filter(lines(own), lambda x: F.length(norm(x)) >= min_chars)), F.lit(0)).cast("long")
    return full.select("doc", F.when(own.isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.col("gone").alias("n_removed"), clean.alias("clean"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d WHERE text IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
common AS (SELECT norm FROM n WHERE length(norm) >= 1 GROUP BY norm HAVING count(DISTINCT source) >= 10),
r AS (SELECT rid, sum(CASE WHEN length(norm) >= 1 THEN 1 ELSE 0 END)::BIGINT AS n_lines, sum(CASE WHEN norm IN (SELECT norm FROM common) THEN 1 ELSE 0 END)::BIGINT AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE norm NOT IN (SELECT norm FROM common)), '') AS clean FROM n GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(clean)::BIGINT AS clean_chars, md5(clean) AS clean_md5
FROM d LEFT JOIN r USING (rid)
"""
