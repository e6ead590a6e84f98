"""Product codes against plain k-means over all entries."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from cohortry.llm import vector_codes

NAN, INF = float("nan"), float("inf")


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    if not kept:
        return []
    x = np.array([[int(np.floor(np.float64(v) * 1024)) for v in r[1]] for r in kept], object).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[list(x[i, p]) for i in first] for p in range(parts)]
    def nearest(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p])) for v in x[:, p]]
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v, (_, e) in zip(x[:, p], nearest(p), strict=True):
                own[e].append(v)
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [nearest(p) for p in range(parts)]
    error = [sum(found[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        by[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{found[p][i][1]:02x}" for p in range(parts)), error[i], by[r[2]], digest) for i, r in enumerate(kept))


def check(spark, rows, entries=256, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, part string, near int").repartition(3)
    got = [(str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compress(df, entries=entries, **how).collect()]
    assert sorted(got) == brute(rows, entries=entries)


def test_ties_and_odd_rows(spark):
    random.seed(2)
    grid = [0.0, 0.001, -0.001, 0.5, -0.5, 2.0]
    rows = [(i, [random.choice(grid) for _ in range(8)], random.choice([None, 1, 2])) for i in range(200)]
    rows += [(5, None, 1), (6, [1.0] * 7 + [None], 1), (7, [NAN] * 8, 1), (8, [INF] + [0.0] * 7, 1), (None, [0.25] * 8, 2), (3, rows[3][1], 2), (3, rows[3][1], 2), (900, rows[0][1], None)]
    check(spark, [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows], entries=40, near=6)


def test_large_components_and_few_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 9000], 1) for i in range(60)]
    check(spark, [(i, [max(-16000.0, min(16000.0, x)) for x in v], k) for i, v, k in rows])
    check(spark, [(4, [1.0, 2.0, 3.0, 4.0], None)])


def test_empty_and_errors(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], shape)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], shape)).count() == 0
    for bad in ([(1, [1.0, 2.0], 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1e9] * 4, 1)]):
        with pytest.raises(Exception, match="vectors|components"):
            vector_codes.compress(spark.createDataFrame(bad, shape)).collect()


def test_bounds_spare_distances():
    """Over rounds the states are those of measuring all, while fewer parts are measured against all entries."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (64, 8))
    x = centres[rng.integers(0, 64, 20_000)] + rng.integers(-120, 120, (20_000, 8))
    book = x[:64].copy()
    s, full = vector_codes.measured(x, book, 8), []
    for _ in range(6):
        new = np.array([x[s.near[:, 0] == e].sum(0) // max(1, (s.near[:, 0] == e).sum()) if (s.near[:, 0] == e).any() else book[e] for e in range(64)])
        moves = vector_codes._up(np.sqrt(((new - book) ** 2).sum(1)))
        book = new
        s, depth = vector_codes.assigned(x, book, vector_codes.moved(s, moves))
        plain = vector_codes.distances(x, book)
        assert np.array_equal(s.near[:, 0], plain.argmin(1))
        assert (s.upper.astype(float) ** 2 >= plain.min(1)).all()
        full.append((depth == s.near.shape[1]).mean())
        s = vector_codes.shrunk(s, vector_codes._enough(np.bincount(depth, minlength=9), s.near.shape[1]))
        kept = np.take_along_axis(plain, s.near[:, 1:], 1)
        assert (np.maximum(s.lower[:, :-1], 0).astype(float) ** 2 <= kept).all()
    assert full[-1] < 0.5
