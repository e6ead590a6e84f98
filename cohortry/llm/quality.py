"""Quality rules: base measures of each text, and lines that too many documents of a host share.

Everything on the way is a DataFrame function. Measures are computed inside the row, so no text is shuffled; only (host, line
hash, text hash) rows are, summed up before they travel.

Repeated windows. Each window of three words has a 64-bit hash. Where all hashes of a text differ, so do its windows; in the other
texts windows are sorted by hash and words and neighbours compared word by word, so the number is exact for texts of any length.

A line is normalised (lower case, digits as 0, white space as one space) and hashed. Copies of a text, near ones too, are one document
to the count: documents of a host count once for each longest line (as it stands; of equally long ones the greatest), so a group of
copies doesn't make its own lines common, while boilerplate is seldom the longest line. A line is common if at least `least` documents of the
host hold it and more than `share` of its documents: the first number rules on hosts of up to `least / share` documents, the second
on larger ones. Common lines go. A document is depleted if over `depleted` of its characters in lines go, or if lines go and it
is left with fewer words than the base rule asks for. All limits are parameters.

Null texts count as empty (and fail the base rules), null hosts are a host, rows with one id are judged each by itself, a line on
exactly the share of documents stays, an empty table gives an empty result, other columns are left alone and may have any name.
A very long text takes memory in proportion to its words, in its own row's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import GAP, cut, meet

SYMBOLS = r"[#*$%&|<>]"
#: White space inside a line that isn't one space already; line breaks with what is around them; lines without a word.
GAPS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
BREAKS = r" ?\n[ \n]*"
BLANK = r"\n[\x20\x09\x0B-\x0D]++(?=\n|\z)"
MIN_WORDS, MAX_REPEATED = 50, 50
LEAST_DOCS, SHARE_OF_HOST, DEPLETED = 5, 0.02, 0.70
#: Common lines of all hosts may be broadcast up to this size; beyond, documents meet them in so many parts for each host.
BROADCAST_BYTES, HOST_PARTS = 16 << 20, 32


def lines_of(text: Column) -> Column:
    """The lines of a text that have a word, as they are."""
    return F.array_remove(F.split(F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), BLANK, "\n"), "\n"), "")


def _level(text: Column) -> Column:
    """Lower case, digits as 0, white space inside lines as one space."""
    same = F.regexp_replace(F.lower(text), "[1-9]", "0")
    some = F.contains(text, F.lit("  "))
    for space in "\t\x0b\x0c\r":
        some |= F.contains(text, F.lit(space))
    return F.when(some, F.regexp_replace(same, GAPS, " ")).otherwise(same)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(_level(line)))


def level_lines(text: Column) -> Column:
    """A text's lines with a word, normalised all at once."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.concat(F.lit("\n"), _level(text)), BREAKS, "\n")), "\n"), "")


def _after(array: Column, k: int) -> Column:
    """An array without its first k elements."""
    return F.slice(array, F.lit(k + 1), F.greatest(F.size(array) - k, F.lit(0)))


def repeated_words(df: DataFrame) -> DataFrame:
    """df (with words) and n_repeat_words: the words in windows of three that its words hold twice or more.

    Steps are columns of their own, so that each is computed once.
    """
    words = F.col("words")
    df = df.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))
    two = F.zip_with("hashes", _after(F.col("hashes"), 1), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, _after(F.col("hashes"), 2), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("hashes", F.slice(three, F.lit(1), F.greatest(F.size("hashes") - 2, F.lit(0))))
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    at = F.sequence(F.lit(0), F.size("hashes") - 1)
    names = [c.alias(k) for k, c in {"h": F.col("hashes"), "a": words, "b": _after(words, 1), "c": _after(words, 2), "at": at}.items()]
    df = df.withColumn("windows", F.when(again, F.sort_array(F.arrays_zip(*names))))
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    both = F.zip_with("windows", _after(F.col("windows"), 1), lambda x, y: F.when(same(x, y), F.array(x["at"], y["at"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("places", F.sort_array(F.array_distinct(F.flatten(both))))
    # a window covers three words, or those up to the next one's start
    steps = F.zip_with("places", _after(F.col("places"), 1), lambda x, y: F.least(F.coalesce(y - x, F.lit(3)), F.lit(3)))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))).drop("hashes", "windows", "places")


def measures(docs: DataFrame) -> DataFrame:
    """doc, a struct of all columns of docs, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.struct("*").alias("doc"), text.alias("t"), F.array_remove(F.split(text, GAP), "").alias("words"))
    out = repeated_words(out).withColumn("lines", lines_of(F.col("t")))
    out = out.select(
        "doc", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def common_lines(docs: DataFrame, host: str, least: int = LEAST_DOCS, share: float = SHARE_OF_HOST) -> DataFrame:
    """host, lines: the hashes of each host's common lines; hosts without any are absent.

    A host has fewer than (its mean of lines a document) / share of them, however many documents it holds.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))))
    held = docs.select(F.col(host).cast("string").alias("host"), F.xxhash64(longest["line"]).alias("doc"), level_lines(text).alias("lines")).where(F.size("lines") > 0)
    # each document holds the null line too, whose count is that of the host's documents: one reading for both
    each = F.array_append(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))), F.lit(None).cast("long"))
    counted = cut(held.select("host", "doc", F.explode(each).alias("line")).groupBy("host", "line").agg(F.count_distinct("doc").alias("n")).where((F.col("n") >= least) | F.col("line").isNull()))
    total = counted.where("line IS NULL").select("host", F.col("n").alias("docs"))
    both = counted.where("line IS NOT NULL").alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return both.where(F.col("n") > share * F.col("docs")).groupBy(F.col("c.host").alias("host")).agg(F.collect_set("line").alias("lines"))


def quality(docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: float = SHARE_OF_HOST, depleted: float = DEPLETED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc (all columns of docs as a struct), the measures, base_failed, n_common_lines, clean (the text without them), kept."""
    common = cut(common_lines(docs, host, least, share))
    out = measures(docs).withColumn("host", F.col(f"doc.{host}").cast("string"))
    out = meet(out, common.toDF("host", "common"), "host", F.xxhash64("doc.text"), broadcast_bytes, HOST_PARTS).drop("host")
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    full = lines_of(text)
    go = F.filter(full, lambda x: F.array_contains(F.col("common"), line_hash(x)))
    out = out.withColumn("go", F.when(F.col("common").isNotNull(), go).otherwise(F.array().cast("array<string>"))).drop("common")
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("go"), x)), "\n")
    some = F.size("go") > 0
    gone = F.aggregate("go", F.lit(0).cast("long"), lambda s, x: s + F.size(F.array_remove(F.split(x, GAP), "")))
    spent = F.when(some, (chars(F.col("go")) > depleted * chars(full)) | (F.col("n_words") - gone < MIN_WORDS)).otherwise(False)
    found = F.struct(F.size("go").cast("long").alias("n_common_lines"), F.when(some, left).otherwise(F.col("doc.text")).alias("clean"), (~F.col("base_failed") & ~spent).alias("kept"))
    # a generated row: filters on the verdict stay above it, so no step below is computed twice
    return out.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.inline(F.array(found)))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT rid, i, list_slice(ws, i, i + 2) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
l AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT rid, source, t, line, trim(regexp_replace(translate(lower(line), '0123456789', '0000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY rid),
k AS (SELECT rid, source, max({'n': length(line), 'l': line}) AS key FROM l GROUP BY rid, source HAVING count_if(regexp_matches(line, '[^\x20\x09-\x0D]')) > 0),
hosts AS (SELECT source, count(DISTINCT key) AS docs FROM k GROUP BY source),
common AS (SELECT c.source, c.norm FROM (SELECT ln.source, norm, count(DISTINCT key) AS n FROM ln JOIN k USING (rid) GROUP BY ln.source, norm) c
           JOIN hosts h ON h.source IS NOT DISTINCT FROM c.source WHERE c.n >= 5 AND c.n > 0.02 * h.docs),
gone AS (SELECT ln.rid, sum(length(line)) AS total, sum(CASE WHEN common.norm IS NULL THEN 0 ELSE length(line) END) AS lost,
                sum(CASE WHEN common.norm IS NULL THEN 0 ELSE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) END) AS words
         FROM ln LEFT JOIN common ON common.source IS NOT DISTINCT FROM ln.source AND common.norm = ln.norm GROUP BY ln.rid),
m AS (SELECT d.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(words > 0 AND (lost > 0.7 * total OR n_words - words < 50), false) AS kept
FROM m LEFT JOIN gone USING (rid)
"""
