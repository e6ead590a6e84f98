"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so their Jaccard similarity is tiny; containment of the item is what counts. Items are
dealt into partitions by size (powers of two of their shingles). An item's sketch is its k smallest shingle hashes; with k =
n - ceil(threshold * n) + 1 for the largest n that its partition holds, a document that contains the threshold of the item's
shingles holds one of the sketch at least, whatever its own size: the search misses nothing. The sketches of all partitions make
one sorted table. A document's shingles are looked up in it, in one pass without a shuffle; (document, item) candidates are
verified by counting the item's shingles in the document, and then by the shingles' words themselves.

The item tables go to the executors only if they hold up to `MAX_ITEM_HASHES` hashes; beyond that, items are dealt into runs of
that size and documents are read once for each run, so memory stays bounded however many items there are.

Shingles are five words (`base.WORD`, A-Z lower-cased); items and documents of fewer words are one shingle, so such an item is
found only as the whole of a document. Items or documents without words, and null texts, match nothing. Repeated rows and null ids
are rows like others; empty tables give an empty result; other columns play no part. A document that holds exactly the threshold is
found. A very long text is searched whole, in memory in proportion to its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import LOWER, UPPER, WORD
from .shingles import set_of, shingle_sets, slices

THRESHOLD = 75
MAX_ITEM_HASHES = 4_000_000
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long"
_FOLD = str.maketrans(UPPER, LOWER)


def shingles_of(text: str | None) -> set[tuple[str, ...]]:
    w = re.findall(WORD, (text or "").translate(_FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


class Items:
    """Sketches and full sets of test items as flat sorted arrays."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: int = THRESHOLD) -> None:
        sets = [set_of(t) for _, t in items]
        self.ids, self.texts, self.threshold = [i for i, _ in items], [t for _, t in items], threshold
        self.n = np.array([len(s) for s in sets], np.int64)
        top = (1 << np.ceil(np.log2(np.maximum(self.n, 1))).astype(np.int64)).astype(np.int64)
        k = np.minimum(self.n, np.where(self.n > 0, top - -(-top * threshold // 100) + 1, 0))
        # k of the partition's largest size covers every smaller one
        self.sketch, self.of = self._table([s[:x] for s, x in zip(sets, k, strict=True)])
        self.full, self.full_of = self._table(sets)

    @staticmethod
    def _table(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([*sets, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(h, kind="stable")
        return h[order], of[order]

    @staticmethod
    def _hits(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into hashes, index into table) of equal values."""
        low, high = np.searchsorted(table, hashes, "left"), np.searchsorted(table, hashes, "right")
        n = high - low
        return np.repeat(np.arange(len(hashes)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def search(self, hashes: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shared) of verified containment in rows of sorted distinct hashes."""
        row = np.repeat(np.arange(len(n)), n)
        near = np.isin(hashes, self.sketch)
        rows = np.unique(row[near])
        if not len(rows):
            return []
        i, j = self._hits(self.sketch, hashes[near])
        wanted = set(zip(row[near][i].tolist(), self.of[j].tolist(), strict=True))
        mine = np.isin(row, rows)
        i, j = self._hits(self.full, hashes[mine])
        pair, shared = np.unique(row[mine][i] * len(self.n) + self.full_of[j], return_counts=True)
        found = zip((pair // len(self.n)).tolist(), (pair % len(self.n)).tolist(), shared.tolist(), strict=True)
        return [(r, x, s) for r, x, s in found if 100 * s >= self.threshold * self.n[x] and (r, x) in wanted]


def _scan(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out = batch.column("doc_id"), batch.column("text"), []
            for i, _, data, offsets in slices(texts):
                last: tuple = (None, set())
                for row, item, _ in items.search(*shingle_sets(data, offsets)):
                    if last[0] != row:
                        last = row, shingles_of(texts[i + row].as_py())
                    own = shingles_of(items.texts[item])
                    shared = len(own & last[1])
                    if 100 * shared >= items.threshold * len(own):
                        out.append((ids[i + row].as_py(), items.ids[item], shared, len(own)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_shared", "n_item"])

    return scan


def _clean(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    find = _scan(items)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), batch.column("text")], ["doc_id", "text"])
            bad = [x for found in find(iter([rows])) for x in found.column("doc_id").to_pylist()]
            keep = np.ones(len(batch), bool)
            keep[bad] = False
            yield batch.filter(pa.array(keep))

    return clean


def _runs(items: DataFrame, threshold: int = THRESHOLD, max_hashes: int = MAX_ITEM_HASHES) -> Iterator[Items]:
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # characters bound the words, and so the hashes
    n = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    runs = max(1, -(-n // (2 * max_hashes)))
    for i in range(runs):
        some = items if runs == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(runs)) == i)
        yield Items([(r.item_id, r.text) for r in some.collect()], threshold)


def contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, n_shared, n_item of each document row that contains the threshold (percent) of an item's shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return reduce(DataFrame.union, [docs.mapInArrow(_scan(x), SCHEMA) for x in _runs(items, **how)])


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) that contain no item, as they are."""
    for found in _runs(items, **how):
        docs = docs.mapInArrow(_clean(found), docs.schema)
    return docs


def sets_sql(name: str, table: str, key: str) -> str:
    """SQL of the distinct shingles of each row of a table, as the rows (rid, key, g)."""
    fold = f"translate(text, '{UPPER}', '{LOWER}')"
    return rf"""{name}w AS (SELECT row_number() OVER () AS rid, {key}, regexp_extract_all({fold}, '[^\x20\x09-\x0D]+') AS w FROM {table} WHERE text IS NOT NULL),
{name} AS (SELECT DISTINCT rid, {key}, g FROM (SELECT rid, {key}, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, chr(10))] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(10))) END) AS g FROM {name}w WHERE len(w) > 0))"""


SQL = f"""
WITH {sets_sql("d", "documents", "doc_id")}, {sets_sql("i", "benchmark", "item_id")},
n AS (SELECT rid, count(*) AS n FROM i GROUP BY 1),
c AS (SELECT d.rid AS dr, i.rid AS ir, doc_id, item_id, count(*) AS s FROM d JOIN i USING (g) GROUP BY ALL)
SELECT doc_id, item_id, s AS n_shared, n AS n_item FROM c JOIN n ON n.rid = c.ir WHERE 100 * s >= {THRESHOLD} * n
"""
