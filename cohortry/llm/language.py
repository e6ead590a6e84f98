"""Language mixtures: expectation-maximisation over words' n-gram likelihoods, with the language set by penalised likelihood.

Training counts, for each language, the byte trigrams (hashed to `BINS`) of all words of all training rows; each partition sends
its sums only. A word is a run of letters; the trigrams of a lower-cased word run from a space before to a space after it.

A word's likelihood under a language is the product of its trigrams' smoothed probabilities. A document's words are a mixture of
languages; expectation-maximisation finds the proportions. Starting from all languages, the least is dropped and the rest refitted
until one is left; of these nested sets the one with the highest log-likelihood less `PENALTY` * (languages - 1) * log(words)
is the document's. The language predicted is that of the largest proportion, the score its proportion in the set.

A text with more words than are held at once (some 8 million for four languages) goes through the rounds in runs of words, so its
likelihoods under all languages are never held together. Documents are read twice, without a shuffle of text; the model is (languages x BINS) numbers, whatever the corpus. All labels are
learnt. Beyond `AT_ONCE` of them, training sends the sums of each run of words, and prediction takes fewer words at a time, so
that memory besides the model doesn't follow the number of labels. Null or letterless texts are `und` with
score 0, as is every text if no row can be learnt from. Ties go to the first language by name. Null ids are rows like others
(their remainder is taken as 0, so not held out); repeated rows are predicted each; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import slices, word_spans

BINS = 1 << 14
#: Languages for which words are held as below; of more languages, fewer words.
AT_ONCE = 64
SMOOTH = 0.5
PENALTY = 1.0
ROUNDS, MINOR = 8, 0.02
#: Words whose trigrams are held at once.
WORDS_AT_ONCE = 50_000
#: Words or rows of a run whose likelihoods are held, at up to AT_ONCE languages.
HELD = 1 << 19
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SAME = np.arange(256, dtype=np.uint8)


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, word) of each trigram of the words at data[start:end], in order of words."""
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    mid = data[at].astype(np.int64)
    before = np.where(at == start[word], 32, data[np.maximum(at - 1, 0)]).astype(np.int64)
    after = np.where(at == end[word] - 1, 32, data[np.minimum(at + 1, len(data) - 1)]).astype(np.int64)
    return ((before << 16 | mid << 8 | after) * 0x9E3779B1 >> 13) % BINS, word


def _runs(n: int, k: int = 1) -> Iterator[slice]:
    """Runs of n words, shorter where there are more than AT_ONCE languages."""
    size = max(1, WORDS_AT_ONCE * AT_ONCE // max(k, AT_ONCE))
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def _row_runs(words: np.ndarray, k: int, held: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows that hold up to `held` words and rows for AT_ONCE of k languages, one row at least."""
    if k <= AT_ONCE:
        yield 0, len(words)
        return
    ends = np.cumsum(np.maximum(words, 1))
    i = 0
    while i < len(words):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + held * AT_ONCE // k, "right")))
        yield i, j
        i = j


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def sums(lang: np.ndarray, bins: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bins, pa.int32()), pa.array(n, pa.int64())], ["l", "bin", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = len(languages) <= AT_ONCE
        total = np.zeros((len(languages) if dense else 0, BINS), np.int64)
        for batch in batches:
            of = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            for i, j, data, offsets in slices(_lower(batch.column("text")), _SAME):
                start, end, row = word_spans(data, offsets, _GAP)
                for x in _runs(len(start)):
                    bins, word = trigrams(data, start[x], end[x])
                    lang = of[i:j][row[x]][word]
                    good = lang >= 0
                    at = lang[good] * BINS + bins[good]
                    if dense:
                        total += np.bincount(at, minlength=total.size).reshape(total.shape)
                    else:
                        at, n = np.unique(at, return_counts=True)
                        yield sums(at // BINS, at % BINS, n)
        lang, bins = np.nonzero(total)
        yield sums(lang, bins, total[lang, bins])

    return count


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of BINS trigrams for each) from all of rows (text, lang)."""
    rows = rows.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((0, BINS), np.float32)
    counts = np.zeros((len(languages), BINS))
    sums = rows.mapInArrow(_count(languages), "l int, bin int, n long").groupBy("l", "bin").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():
        counts[r.l, r.bin] = r.n
    # the bins of all languages together back up those that a language lacks
    back = SMOOTH * (counts.sum(0) > 0) + 1e-3
    table = np.empty(counts.shape, np.float32)
    for i, own in enumerate(counts):
        backed = own + back
        table[i] = np.log(backed / backed.sum())
    return languages, table


def _fit(like: np.ndarray, row: np.ndarray, n_rows: int, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each row; like: words' likelihoods, each word's largest being 1."""
    share = allowed / allowed.sum(1, keepdims=True)
    words = np.maximum(np.bincount(row, minlength=n_rows), 1)[:, None]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rows = row[first]
    for _ in range(rounds):
        part = like * share[row]
        whole = np.maximum(part.sum(1, keepdims=True), 1e-30)
        part /= whole
        share = np.zeros_like(share)
        share[rows] = np.add.reduceat(part, first, axis=0)
        share /= words
    whole = np.maximum((like * share[row]).sum(1), 1e-30)
    return share, np.bincount(row, np.log(whole), minlength=n_rows)


def mixture(log_like: np.ndarray, row: np.ndarray, n_rows: int, penalty: float = PENALTY) -> np.ndarray:
    """The proportions of each row's chosen language set; log_like: (words, languages), row: sorted, n_rows over all of them."""
    k = log_like.shape[1]
    like = np.exp(log_like - log_like.max(1, keepdims=True))
    share, fit = _fit(like, row, n_rows, np.ones((n_rows, k)), ROUNDS)
    return _nested(like, row, share, fit, k, penalty)


def _nested(like: np.ndarray, row: np.ndarray, share: np.ndarray, fit: np.ndarray, k: int, penalty: float) -> np.ndarray:
    """The best of the nested sets below the whole one of k languages, which share and fit are of; like may hold only the
    languages of the largest set that is compared."""
    n_rows = len(share)
    words = np.bincount(row, minlength=n_rows)
    allowed = np.ones(share.shape)
    best, best_score = share.copy(), fit - penalty * (k - 1) * np.log(np.maximum(words, 2))
    live = np.arange(n_rows)
    keep = row >= 0
    for size in range(_largest(k), 0, -1):
        # the least goes; languages of hardly any share go at once, down to the set's next size
        order = np.argsort(np.where(allowed[live] > 0, share, -1), axis=1, kind="stable")
        nxt = allowed[live].copy()
        np.put_along_axis(nxt, order[:, : share.shape[1] - size], 0, axis=1)
        allowed[live] = nxt
        if size > 1 and k > 2:
            # a row whose larger set already gives one language everything needs only the last comparison
            wide = np.flatnonzero((share > MINOR).sum(1) >= size)
            index = np.full(n_rows, -1)
            index[live[wide]] = np.arange(len(wide))
            use = keep & (index[row] >= 0)
            if not len(wide) or not use.any():
                continue
            got, fit = _fit(like[use], index[row[use]], len(wide), nxt[wide], ROUNDS)
            score = fit - penalty * (size - 1) * np.log(np.maximum(words[live[wide]], 2))
            better = score >= best_score[live[wide]]
            best[live[wide][better]], best_score[live[wide][better]] = got[better], score[better]
            share = share.copy()
            share[wide] = got
        else:
            got, fit = _fit(like, row, n_rows, allowed, 0)
            better = fit >= best_score
            best[better] = got[better]
    return best


def _largest(k: int) -> int:
    """The largest set below the whole one that is compared: in larger ones not every language can have over MINOR."""
    return min(k - 1, int(1 / MINOR) + 1)


def mixture_of_long(blocks: Callable[[], Iterator[np.ndarray]], k: int, penalty: float = PENALTY) -> np.ndarray:
    """`mixture` of one row whose likelihoods aren't held for all k languages: blocks() gives them anew, in runs of words."""

    def likelihoods() -> Iterator[np.ndarray]:
        for x in blocks():
            yield np.exp(x - x.max(1, keepdims=True))

    share = np.full(k, 1 / k)
    for _ in range(ROUNDS):
        whole, words = np.zeros(k), 0
        for like in likelihoods():
            part = like * share
            whole += (part / np.maximum(part.sum(1, keepdims=True), 1e-30)).sum(0)
            words += len(like)
        share = whole / words
    top = np.sort(np.argsort(share, kind="stable")[k - _largest(k) :])
    fit, held = 0.0, []
    for like in likelihoods():
        fit += np.log(np.maximum(like @ share, 1e-30)).sum()
        held.append(like[:, top])
    few = np.concatenate(held)
    out = np.zeros((1, k))
    out[0, top] = _nested(few, np.zeros(len(few), np.int64), share[None, top], np.array([fit]), k, penalty)[0]
    return out


def _predict(languages: list[str], table: np.ndarray, held: int = HELD):
    k = len(languages)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bin = np.ascontiguousarray(table.T)

        def likelihoods(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
            for x in _runs(len(start), k):
                bins, word = trigrams(data, start[x], end[x])
                yield np.add.reduceat(by_bin[bins], np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), axis=0)

        for batch in batches:
            some = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offsets in slices(_lower(batch.column("text")), _SAME):
                n = j - i
                start, end, row = word_spans(data, offsets, _GAP)
                pred, score = np.array(["und"] * n, object), np.zeros(n)
                if len(start) and languages:
                    words = np.bincount(row, minlength=n)
                    ends = np.r_[0, np.cumsum(words)]
                    for a, b in _row_runs(words, k, held):
                        first, last = ends[a], ends[b]
                        blocks = partial(likelihoods, data, start[first:last], end[first:last])
                        if first == last:
                            continue
                        if (last - first) * k > held * AT_ONCE:
                            share = mixture_of_long(blocks, k)
                        else:
                            share = mixture(np.concatenate(list(blocks())), row[first:last] - a, b - a)
                        top = share.argmax(1)
                        has = np.flatnonzero((words[a:b] > 0) & some[i + a : i + b])
                        pred[a + has] = np.array(languages, object)[top[has]]
                        score[a + has] = np.clip(share[has, top[has]], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(languages, table), "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, learnt from the labelled rows that aren't held out."""
    languages, table = train(docs.where(~held_out()))
    return predict(docs, languages, table).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
