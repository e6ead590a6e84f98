"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece BPE (B) cover the same bytes, and how often.

A encodes a space and the text, B the text (it adds the space itself). Byte offsets at which a token of A and one of B both end cut
the tokens into groups; each token of A is linked with each of B in its group. An id pair's count is the number of documents
that hold it linked.

1. Documents are encoded and aligned once. Their token ids are kept; each task adds up in how many of its documents a pair occurs.
2. The distinct pairs, dealt by their hash into parts, get a minimal perfect hash for each part, built in one task each, and a
   dense vector of the keys in the hash's order.
3. Each task turns its sums into dense count vectors in that order, which are summed up as a tree: by branch, then in all.
4. A second pass aligns the kept ids again, looks each pair's number up, compares the key there, and adds up counts.

Steps 3 and 4 hold `RUN` pairs at most, so they read their input once for every so many distinct pairs; the pairs are bounded by
the product of the vocabularies. In a long group the distinct ids of either side meet, with the numbers of their occurrences,
`CHUNK` pairs at a time, so the many links of a long stretch without a common end are counted, not listed.

Texts that are null or empty, or whose tokens' bytes aren't a space and the text (a literal U+2581, for one), have no tokens. Very
long texts are encoded whole. Repeated rows are documents of their own; an empty table gives an empty result; other columns
are left alone. Of ties for an A id's highest count all pairs are best.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, saved
from .perfect_hash import Hash, build
from .shingles import mix

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are aligned at once, links of a group that are listed one by one, pairs of long groups at a time.
SLICE_BYTES, LISTED, CHUNK = 2 << 20, 1 << 12, 1 << 20
#: Distinct pairs of a part (about), of a run of parts (at most, but for one part), and in a task's sums before it hands them on.
PART, RUN, HELD = 1 << 18, 8 << 20, 4 << 20
#: Tasks whose vectors are summed first.
BRANCHES = 16
#: Fixed value: how A cuts a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How B's marks of spaces and bytes are written.
SPACE, BYTE = "▁", "<0x{:02X}>"


def byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers from the bytes of their files.

    Texts of Latin-1 characters are encoded by a quicker encoder that merges the same vocabularies in the same order; tests hold it
    against the libraries. All others, and all of B's if its vocabulary isn't of that kind, go through the libraries.
    """

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken

        spec, of = json.loads(a), byte_of()
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.a[i] = token.encode() if token in special else bytes(of[c] for c in token)
        self.quick_a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={self.a[i]: i for token, i in vocab.items() if token not in special}, special_tokens={})
        self._file, self._full = a, None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        names = [self.pieces.IdToPiece(i) for i in range(self.pieces.GetPieceSize())]
        self.b = [bytes([int(p[3:5], 16)]) if self.pieces.IsByte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.quick_b, self.b_of = self._ranked(names), None
        if self.quick_b:
            self.b_of = np.array(self._ids)
            whole = " a  b c "  # a normaliser that changes white space would show
            if self._quick_b(whole).tolist() != self.pieces.encode(whole):
                self.quick_b = None
        self.size_a, self.size_b = np.array([len(x) for x in self.a]), np.array([len(x) for x in self.b])

    def _ranked(self, names: list[str]):
        """B as an encoder of bytes: characters first, then pieces from the best score on; None if a piece holds a space after another character."""
        import tiktoken

        p = self.pieces
        plain = {name: i for i, name in enumerate(names) if not (p.IsByte(i) or p.IsControl(i) or p.IsUnknown(i) or p.IsUnused(i))}
        if any(SPACE in name.lstrip(SPACE) for name in plain) or not all(BYTE.format(k) in names for k in range(256)):
            return None
        ids = {bytes([k]): names.index(BYTE.format(k)) for k in range(256)}
        chars = {c: plain[SPACE if c == " " else c] for c in map(chr, range(256)) if (SPACE if c == " " else c) in plain}
        ids |= {c.encode(): i for c, i in chars.items()}
        merged = sorted((-p.GetScore(i), i, name) for name, i in plain.items() if len(name) > 1)
        ids |= {name.replace(SPACE, " ").encode(): i for _, i, name in merged}
        self._ids = list(ids.values())
        return tiktoken.Encoding("b", pat_str=r" +[^ ]*|[^ ]+", mergeable_ranks={token: k for k, token in enumerate(ids)}, special_tokens={})

    def _quick_b(self, text: str) -> np.ndarray:
        return self.b_of[self.quick_b.encode_ordinary(" " + text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts on either side, and how many each text has; none for empty texts and those whose bytes differ."""
        ids_a, ids_b, plain = [], [], []
        other = [x for x in texts if x and not (self.quick_b and _plain(x))]
        pieces = iter(self.pieces.encode(other, num_threads=1) if other else [])
        for text in texts:
            whole = " " + text
            if not text:
                a, b = [], []
            elif self.quick_b and _plain(text):  # merging bytes leaves them as they are
                a, b = self.quick_a.encode_ordinary(whole), self.quick_b.encode_ordinary(whole)
            else:
                b, raw = next(pieces), whole.encode()
                a = self._slow_a(whole) if b"".join([self.b[i] for i in b]) == raw else []
                if not a or b"".join([self.a[i] for i in a]) != raw:
                    a, b = [], []
            plain.append(bool(text and self.quick_b and _plain(text)))
            ids_a.append(a)
            ids_b.append(b)
        (a, n_a), (b, n_b) = _flat(ids_a), _flat(ids_b)
        if self.quick_b:
            quick = np.repeat(plain, n_b)
            b[quick] = self.b_of[b[quick]]
        return a, b, n_a, n_b

    def _slow_a(self, text: str) -> list[int]:
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_buffer(self._file)
            self._full.encode_special_tokens = True
        return self._full.encode(text, add_special_tokens=False).ids


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, n.sum()), n


def _plain(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to most - 1 as eight bytes each, and how many each has; ids have seven at most."""
    text = [str(i).encode() for i in range(most)]
    return np.frombuffer(b"".join(x.ljust(8, b"\0") for x in text), "<u8"), np.array([len(x) for x in text])


class Groups:
    """The groups of some documents at once; ids of either side one document after the other, with the number of each document's."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b, self.size_a, self.size_b = a.astype(np.int64), b.astype(np.int64), n_a, n_b, size_a, size_b
        ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        size = int(ends_a[-1]) + 1 if len(a) else 1
        is_a, is_b = np.zeros(size, bool), np.zeros(size, bool)
        is_a[ends_a], is_b[ends_b] = True, True
        last_a, last_b = is_b[ends_a], is_a[ends_b]
        self.group_a, self.group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        self.groups = int(last_a.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        doc_a = np.repeat(np.arange(len(n_a)), n_a)
        self.doc = doc_a[last_a]  # of each group
        self.n_groups = np.bincount(self.doc, minlength=len(n_a))
        self.n_links = np.zeros(len(n_a), np.int64)
        np.add.at(self.n_links, self.doc, self.in_a * self.in_b)

    def texts(self) -> list[bytes]:
        """`a,a|b;a|b,b` for each document, nothing without tokens."""
        before_a, before_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        at_a = np.arange(len(self.a)) + before_b[self.group_a]
        at_b = np.arange(len(self.b)) + (before_a + self.in_a)[self.group_b]
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        ends = before_a + before_b + self.in_a
        mark[ends - 1], mark[ends + self.in_b - 1] = ord("|"), ord(";")
        cells, width = _decimals(max(len(self.size_a), len(self.size_b)))
        width = width[ids]
        flat = (cells[ids] | mark.astype(np.uint64) << (8 * width).astype(np.uint64)).view(np.uint8)
        flat = flat[flat > 0]
        out, text, at = [], flat.tobytes(), 0
        size = np.concatenate([[0], np.cumsum(width + 1)])
        tokens = np.cumsum(self.n_a + self.n_b)
        for end, some in zip(size[tokens].tolist(), (self.n_a > 0).tolist(), strict=True):
            out.append(text[at : end - 1] if some else b"")
            at = end
        return out

    def links(self, of_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(document, pair as a * of_b + b, number of links) of all links; the number is None where each row is one link."""
        listed = self.in_a * self.in_b <= LISTED
        first_b = np.cumsum(self.in_b) - self.in_b
        own = np.flatnonzero(listed[self.group_a])
        each = self.in_b[self.group_a[own]]
        step = max(1, (4 * CHUNK) // max(1, int(each.max(initial=1))))
        for i in range(0, len(own), step):
            some, n = own[i : i + step], each[i : i + step]
            g = np.repeat(self.group_a[some], n)
            k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
            yield self.doc[g], np.repeat(self.a[some], n) * of_b + self.b[first_b[g] + k], None
        first_a = np.cumsum(self.in_a) - self.in_a
        for g in np.flatnonzero(~listed).tolist():
            ua, ca = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            ub, cb = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            step = max(1, CHUNK // len(ub))
            for i in range(0, len(ua), step):
                pairs = (ua[i : i + step, None] * of_b + ub[None]).ravel()
                yield np.full(len(pairs), self.doc[g]), pairs, (ca[i : i + step, None] * cb[None]).ravel()


def _first(key: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value for the first time."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def in_docs(links: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, number of links) for each document's distinct pairs; span: above all pairs."""
    keys, n = [], []
    for doc, pair, times in links:
        key = np.sort(doc * span + pair) if times is None else doc * span + pair
        if times is None:
            first = _first(key)
            key, times = key[first], np.diff(np.append(first, len(key)))
        keys.append(key)
        n.append(times)
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, n = _summed(np.concatenate(keys), np.concatenate(n)) if len(keys) > 1 else (keys[0], n[0])
    return key // span, key % span, n


def _summed(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers (None: one each)."""
    if n is None:
        key = np.sort(key)
        first = _first(key)
        return key[first], np.diff(np.append(first, len(key)))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = _first(key)
    return key[first], np.add.reduceat(n, first) if len(first) else n[:0]


def part_of(pairs: np.ndarray, parts: int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


ALIGNED = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids_a binary, ids_b binary, pair long, n long"
_FIELDS = pa.schema([(x, pa.string() if x == "groups_sha256" else pa.binary() if x.startswith("ids") else pa.int64()) for x in (c.split()[0] for c in ALIGNED.split(", "))])


def _rows(**given) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS)


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to so many bytes, one row at least."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _kind(ids: int) -> str:
    return "<u4" if ids > 65536 else "<u2"


def _packed(ids: np.ndarray, n: np.ndarray, most: int) -> list[bytes]:
    """Each document's ids as bytes."""
    raw, size = ids.astype(_kind(most)).tobytes(), int(_kind(most)[2])
    ends = (np.cumsum(n) * size).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encoder(files: Broadcast):
    """Rows of documents -> their ids, groups and digests, and then rows (pair, n): in how many of the task's documents a pair is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(*files.value)
        of_b, span = len(t.b), len(t.a) * len(t.b)
        held, fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

        def settled() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(held, *fresh, strict=True))) if fresh else held

        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch["text"]).fill_null(0)).astype(np.int64)
            for i, j in _cuts(sizes, SLICE_BYTES):
                some = batch.slice(i, j - i)
                a, b, n_a, n_b = t.encode([x or "" for x in some["text"].to_pylist()])
                g = Groups(a, b, n_a, n_b, t.size_a, t.size_b)
                _, pairs, _ = in_docs(g.links(of_b), span)
                fresh.append(_summed(pairs, None))
                if sum(len(x) for x, _ in fresh) > HELD:
                    held, fresh = settled(), []
                    if len(held[0]) > HELD:
                        yield _rows(pair=held[0], n=held[1])
                        held = held[0][:0], held[1][:0]
                yield _rows(
                    rid=some["rid"], doc_id=some["doc_id"], n_a=n_a, n_b=n_b, n_groups=g.n_groups, n_links=g.n_links,
                    groups_sha256=[hashlib.sha256(x).hexdigest() if x else "" for x in g.texts()], ids_a=_packed(a, n_a, len(t.a)), ids_b=_packed(b, n_b, len(t.b)),
                )
        held = settled()
        for i in range(0, len(held[0]), 1 << 17):
            yield _rows(pair=held[0][i : i + (1 << 17)], n=held[1][i : i + (1 << 17)])

    return run


def _hash_part(table: pa.Table) -> pa.Table:
    keys = np.asarray(table["pair"]).astype(np.int64)
    made = build(keys)
    ordered = np.empty(len(keys), "<i8")
    ordered[Hash(made)(keys)] = keys
    return pa.table({"part": table["part"][:1], "size": pa.array([len(keys)], pa.int64()), "made": pa.array([made], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary())})


def _add_up(key: tuple, tables: pa.Table) -> pa.Table:
    total = reduce(np.add, (np.frombuffer(x, "<i8") for x in tables["counts"].to_pylist()))
    return pa.table({"part": tables["part"][:1], "branch": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def count_vectors(sums: DataFrame, hashes: DataFrame, runs: list[list[int]], parts: int) -> DataFrame:
    """part, counts: for each part a dense vector of counts in the order of its hash, summed by tasks, branches, and in all."""
    spark, out = sums.sparkSession, []
    for run in runs:
        made = spark.sparkContext.broadcast({r["part"]: bytes(r["made"]) for r in hashes.where(F.col("part").isin(run)).select("part", "made").collect()})

        def dense(batches: Iterator[pa.RecordBatch], made: Broadcast = made) -> Iterator[pa.RecordBatch]:
            of, vectors, branch = {}, {}, uuid.uuid4().int % BRANCHES
            for batch in batches:
                pairs, n = np.asarray(batch["pair"]), np.asarray(batch["n"])
                part = part_of(pairs, parts)
                for p in np.unique(part).tolist():
                    if p not in made.value:
                        continue
                    if p not in of:
                        of[p] = Hash(made.value[p])
                        vectors[p] = np.zeros(of[p].size, "<i8")
                    own = part == p
                    np.add.at(vectors[p], of[p](pairs[own]), n[own])
            for p, v in vectors.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([branch], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["part", "branch", "counts"])

        shape = "part long, branch int, counts binary"
        each = sums.mapInArrow(dense, shape)
        out.append(each.groupBy("part", "branch").applyInArrow(_add_up, shape).groupBy("part").applyInArrow(_add_up, shape).select("part", "counts"))
    return saved(reduce(DataFrame.union, out), "pair-counts")


def best_counts(hashes: DataFrame, counts: DataFrame, of_b: int, ids: int) -> np.ndarray:
    """Each A id's highest count, 0 for ids without a link; as many rows as A has ids at most reach the driver."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(ids, np.int64)
        for batch in batches:
            for k, c in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                np.maximum.at(best, np.frombuffer(k, "<i8") // of_b, np.frombuffer(c, "<i8"))
        a = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best[a])], ["a", "best"])

    found = hashes.select("part", "keys").join(counts, "part").mapInArrow(most, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toPandas()
    out = np.zeros(ids, np.int64)
    out[found["a"].to_numpy(np.int64)] = found["best"].to_numpy(np.int64)
    return out


def looked_up(docs: DataFrame, tables: Broadcast, best: Broadcast, files: Broadcast, parts: int) -> DataFrame:
    """rid, n_best, count_sum over the links whose pairs are in the parts of tables (part -> hash, keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_b, size_a, size_b = files.value["of_b"], files.value["size_a"], files.value["size_b"]
        span = len(size_a) * of_b
        of = {p: (Hash(made), np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8")) for p, (made, keys, counts) in tables.value.items()}
        all_parts = len(of) == parts
        for batch in batches:
            sizes = np.asarray(batch["n_a"]) * 4
            for i, j in _cuts(sizes, SLICE_BYTES):
                some = batch.slice(i, j - i)
                a, b = (np.frombuffer(b"".join(some[c].to_pylist()), _kind(n)) for c, n in (("ids_a", len(size_a)), ("ids_b", len(size_b))))
                g = Groups(a, b, np.asarray(some["n_a"]), np.asarray(some["n_b"]), size_a, size_b)
                doc, pair, times = in_docs(g.links(of_b), span)
                if not all_parts:
                    own = np.isin(part_of(pair, parts), list(of))
                    doc, pair, times = doc[own], pair[own], times[own]
                keys, back = np.unique(pair, return_inverse=True)
                part, count = part_of(keys, parts), np.zeros(len(keys), np.int64)
                for p in np.unique(part).tolist():
                    own = np.flatnonzero(part == p)
                    at = of[p][0](keys[own])
                    if not np.array_equal(of[p][1][at], keys[own]):
                        raise ValueError("a pair without a number: the kept ids have changed")
                    count[own] = of[p][2][at]
                is_best = count == best.value[keys // of_b]
                n_best, total = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                np.add.at(n_best, doc, times * is_best[back])
                np.add.at(total, doc, times * count[back])
                yield pa.RecordBatch.from_arrays([some["rid"], pa.array(n_best), pa.array(total)], ["rid", "n_best", "count_sum"])

    return docs.select("rid", "n_a", "n_b", "ids_a", "ids_b").mapInArrow(run, "rid long, n_best long, count_sum long")


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, part: int = PART, run: int = RUN) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The driver reads both tokenizers' files and sends their bytes along, so executors need none.
    """
    spark = docs.sparkSession
    raw = tuple(open(path, "rb").read() for path in (byte_bpe, piece_bpe))
    t = Tokenizers(*raw)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = saved(rows.mapInArrow(encoder(spark.sparkContext.broadcast(raw)), ALIGNED), "aligned")
    sums, own = aligned.where("pair IS NOT NULL").select("pair", "n"), aligned.where("rid IS NOT NULL")

    pairs = sums.select("pair").distinct()
    parts = max(1, -(-pairs.count() // part))
    deal = F.pandas_udf(lambda x: x.__class__(part_of(x.to_numpy(), parts)), "long")
    hashes = saved(pairs.withColumn("part", deal("pair")).groupBy("part").applyInArrow(_hash_part, "part long, size long, made binary, keys binary"), "pair-hashes")
    runs, room = [[]], run
    for p, size in sorted((r["part"], r["size"]) for r in hashes.select("part", "size").collect()):
        if runs[-1] and size > room:
            runs.append([])
            room = run
        runs[-1].append(p)
        room -= size
    counts = count_vectors(sums, hashes, runs, parts)
    best = spark.sparkContext.broadcast(best_counts(hashes, counts, len(t.b), len(t.a)))
    shape = spark.sparkContext.broadcast({"of_b": len(t.b), "size_a": t.size_a, "size_b": t.size_b})
    every = hashes.join(counts, "part")
    found = []
    for some in runs:
        held = {r["part"]: (bytes(r["made"]), bytes(r["keys"]), bytes(r["counts"])) for r in every.where(F.col("part").isin(some)).select("part", "made", "keys", "counts").collect()}
        found.append(looked_up(own, spark.sparkContext.broadcast(held), best, shape, parts))
    looked = saved(reduce(DataFrame.union, found).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "looked-up")
    discard(hashes, counts)
    return own.join(looked, "rid").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
