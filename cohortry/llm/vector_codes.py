"""Vector code compression: product codes of integer vectors by k-means with Drake and Hamerly's adaptive bounds.

Each component x becomes floor(1024 * x); vectors are cut into equal consecutive parts, each with a codebook of its own, which starts
as that part of the vectors of smallest id. Each round assigns every part to its nearest entry (ties to the lower index) and replaces
entries by the floored means of their parts.

A vector keeps, for each part, its b closest entries in order: an upper bound on the distance of the first (which it is assigned to), a
lower bound on each other's, and one outer lower bound on those of all entries that it doesn't keep. Entries move each round, so
upper bounds grow and lower ones shrink by how far. A part whose upper bound is below all lower ones keeps its entry without any
distance; else the upper bound is made exact; else the kept entries whose lower bounds don't clear it are measured and put in order
again; only if the outer bound doesn't clear it either are all entries measured. Bounds are single floats rounded outwards, and all that
they leave open, ties included, is settled on exact integers. After each round b shrinks, for each part, to the depth that all but
one vector in 200 were settled within.

One pass a round: a task writes its vectors' new states and, in the same table, its sums by entry, which Spark adds up; only these
sums (as many as the codebooks have components) and the codebooks go through the driver. A state is read and written once a round
and deleted when the next one stands.

Rows whose vector is null or holds null or non-finite components are dropped. Null ids come after all others in the start, repeated
ids in the order of their vectors; repeated rows are vectors of their own. Fewer vectors than entries make smaller codebooks; an empty
table gives an empty result; other columns are left alone. Vectors of different lengths, or of a length that isn't a multiple of
the number of parts, and components beyond 16384 either way are errors, since no part or exact distance of them is defined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, meet, saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that a vector keeps for each part at first and at least; the share of vectors that may need more than it keeps.
NEAR, LEAST_NEAR, OPEN = 16, 2, 1 / 200
#: Integers up to this size have exact squared distances in 64 bits, whatever the length; rows that are measured at once.
LIMIT, ROWS = 1 << 24, 4096
#: Sums by label up to this size may be broadcast; beyond, each label's rows meet theirs in so many parts.
BROADCAST_BYTES, LABEL_PARTS = 16 << 20, 32


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row from each entry."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # every step is exact in floats
        a, c = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in entries], 1)


@dataclass
class State:
    """Of one part of some vectors: kept entries (the first is the assigned one), upper bounds, lower ones (of the others, then the outer)."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def measured(x: np.ndarray, entries: np.ndarray, b: int) -> State:
    """The state of parts after measuring all entries."""
    n, k = len(x), len(entries)
    b = min(b, k)
    near, upper, lower = np.empty((n, b), np.int64), np.empty(n, np.float32), np.full((n, b), np.inf, np.float32)
    for i in range(0, n, ROWS):
        d = distances(x[i : i + ROWS], entries)
        order = np.argsort(d, 1, kind="stable")[:, : b + 1]  # stable: ties to the lower index
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        near[i : i + ROWS], upper[i : i + ROWS] = order[:, :b], _up(root[:, 0])
        lower[i : i + ROWS, : root.shape[1] - 1] = _down(root[:, 1:])
    return State(near, upper, lower)


def moved(s: State, moves: np.ndarray) -> State:
    """The bounds after entries have moved by these distances at most."""
    lower = s.lower.copy()
    lower[:, :-1] = _down(lower[:, :-1] - moves[s.near[:, 1:]])
    lower[:, -1] = _down(lower[:, -1] - moves.max(initial=0))
    return State(s.near, _up(s.upper + moves[s.near[:, 0]]), np.minimum.accumulate(lower[:, ::-1], 1)[:, ::-1])


def _to_entries(x: np.ndarray, entries: np.ndarray, near: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - entries[near]) ** 2).sum(2)


def assigned(x: np.ndarray, entries: np.ndarray, s: State) -> tuple[State, np.ndarray]:
    """The state with each part at its nearest entry, and how many of its lower bounds each part didn't clear (b: all of them)."""
    b = s.near.shape[1]
    depth = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(s.upper >= s.lower[:, 0])
    if len(open_):
        s.upper[open_] = _up(np.sqrt(_to_entries(x[open_], entries, s.near[open_, :1])[:, 0].astype(np.float64)))
        depth[open_] = (s.lower[open_] <= s.upper[open_, None]).sum(1)
    below, width = 0, 1
    while below < b - 1:
        width = min(width, b - 1)
        rows = np.flatnonzero((depth > below) & (depth <= width))
        step = max(1, (ROWS * 64) // (width + 1))
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            near = s.near[own, : width + 1]
            d = _to_entries(x[own], entries, near)
            order = np.lexsort((near, d), axis=1)
            root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            s.near[own, : width + 1] = np.take_along_axis(near, order, 1)
            s.upper[own] = _up(root[:, 0])
            s.lower[own, :width] = _down(root[:, 1:])
        below, width = width, 2 * width
    rest = np.flatnonzero(depth == b)
    if len(rest):
        new = measured(x[rest], entries, b)
        s.near[rest], s.upper[rest], s.lower[rest] = new.near, new.upper, new.lower
    return s, depth


def shrunk(s: State, b: int) -> State:
    """The state with fewer kept entries; what is let go is under the outer bound."""
    if b >= s.near.shape[1]:
        return s
    lower = s.lower[:, :b].copy()
    lower[:, -1] = s.lower[:, b - 1 :].min(1)
    return State(s.near[:, :b], s.upper, lower)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def integers(column: pa.Array, length: int) -> np.ndarray:
    """The integers of some vectors."""
    if not all(n == length for n in pc.list_value_length(column).to_pylist()):
        raise ValueError(f"vectors of other lengths than {length}")
    x = np.floor(np.asarray(pc.list_flatten(column)).astype(np.float64) * SCALE).reshape(len(column), length)
    if x.size and np.abs(x).max() > LIMIT:
        raise ValueError(f"components beyond {LIMIT // SCALE} have no exact distances in 64 bits")
    return x.astype(np.int64)


def _pass(codebooks: np.ndarray, last: np.ndarray | None, near: list[int], kept: list[int], names: list[str], final: bool) -> Callable:
    """A round over vectors (last None: new ones) or states: states and the task's sums; in the final one codes and errors.

    codebooks, last: (part, entry, component), now and in the round before; near: the entries kept so far, kept: from now on.
    """
    parts, entries, width = codebooks.shape
    moves = None if last is None else _up(np.sqrt(((codebooks - last) ** 2).sum(2).astype(np.float64)))
    code = "<u1" if entries <= 256 else "<u4"

    def passed(types: dict[str, pa.DataType], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, depths = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, 1 + max(near)), np.int64)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                x = integers(batch["vector"], parts * width) if last is None else _matrix(batch["ints"], "<i4").astype(np.int64)
                x = x.reshape(len(batch), parts, width)
                bounds = None if last is None else _matrix(batch["bounds"], "<f4")
                held = None if last is None else _matrix(batch["near"], code).astype(np.int64)
                states, error, a, c = [], np.zeros(len(batch), np.int64), 0, 0
                for p in range(parts):
                    if last is None:
                        s = measured(x[:, p], codebooks[p], near[p])
                    else:
                        b = near[p]
                        s = shrunk(State(held[:, a : a + b], bounds[:, c], bounds[:, c + 1 : c + 1 + b]), kept[p])
                        a, c = a + b, c + 1 + b
                        s, depth = assigned(x[:, p], codebooks[p], moved(s, moves[p]))
                        depths[p] += np.bincount(depth, minlength=depths.shape[1])
                    if final:
                        error += _to_entries(x[:, p], codebooks[p], s.near[:, :1])[:, 0]
                    else:
                        np.add.at(sums[p], s.near[:, 0], x[:, p])
                        counts[p] += np.bincount(s.near[:, 0], minlength=entries)
                    states.append(s)
                some = [batch[c] for c in names]
                if final:
                    codes = np.stack([s.near[:, 0] for s in states], 1)
                    yield pa.RecordBatch.from_arrays([*some, pa.array(["".join(f"{i:02x}" for i in row) for row in codes.tolist()], pa.string()), pa.array(error)], [*names, "code", "error"])
                else:
                    ints = x.reshape(len(batch), -1).astype("<i4")
                    bounds = np.concatenate([np.concatenate([s.upper[:, None], s.lower], 1) for s in states], 1).astype("<f4")
                    made = [_binary(ints), _binary(np.concatenate([s.near for s in states], 1).astype(code)), _binary(bounds)]
                    yield pa.RecordBatch.from_arrays([*some, *made, *(pa.nulls(len(batch), t) for t in _TALLY.values())], [*names, "ints", "near", "bounds", *_TALLY])
        if not final:
            p, e = np.nonzero(counts)
            rows = [p, e, counts[p, e], list(sums[p, e])]
            if last is not None:
                rows = [np.append(p, np.arange(parts)), np.append(e, np.full(parts, -1)), np.append(rows[2], np.zeros(parts, np.int64)), [*rows[3], *depths]]
            tally = [pa.array(v, t) for v, t in zip(rows, _TALLY.values(), strict=True)]
            blank = [pa.nulls(len(rows[0]), t) for t in [*(types[c] for c in names), *[pa.binary()] * 3]]
            yield pa.RecordBatch.from_arrays([*blank, *tally], [*names, "ints", "near", "bounds", *_TALLY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches := iter(batches), None)
        if first is not None:
            yield from passed({f.name: f.type for f in first.schema}, chain([first], batches))

    return run


_TALLY = {"part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64())}
STATE = "ints binary, near binary, bounds binary, part int, entry int, n long, sums array<long>"


def _means(state: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The new codebooks from all tasks' sums, and how many vectors didn't clear so many lower bounds, by part."""
    sums = state.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "x"))
    out, depths = codebooks.copy(), {}
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("at").collect():
        if r["entry"] < 0:
            depths.setdefault(r["part"], []).append(r["x"])
        elif r["at"] is not None:
            out[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return out, {p: np.array(x) for p, x in depths.items()}


def _enough(depths: np.ndarray, b: int) -> int:
    """The fewest entries to keep for all but a share of the vectors to be settled among them."""
    beyond = depths.sum() - np.cumsum(depths)  # vectors that didn't clear more than i bounds
    return int(min(b, max(LEAST_NEAR, 1 + np.argmax(beyond <= OPEN * depths.sum()))))


def compress(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, near: int = NEAR) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of df with a whole vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector).isNotNull() & finite).select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    kinds = dict(rows.dtypes)
    out = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    if not first:
        return df.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    length = len(first[0]["vector"])
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    start = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), length)
    now, last = start.reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy(), None
    state, names = rows, ["vec_id", "label"]
    held = [min(near, len(first))] * parts
    kept = held
    for _ in range(rounds):
        new = saved(state.mapInArrow(_pass(now, last, held, kept, names, False), f"{out}, {STATE}"), "codes")
        if state is not rows:
            discard(old)
        old, held = new, kept
        means, depths = _means(new, now)
        kept = [_enough(depths[p], b) if p in depths else b for p, b in enumerate(held)]
        last, now, state = now, means, new.where("part IS NULL").select("vec_id", "label", "ints", "near", "bounds")
    done = saved(state.mapInArrow(_pass(now, last, held, kept, names, True), f"{out}, code string, error long"), "codes")
    if state is not rows:
        discard(old)
    digest = hashlib.sha256(",".join(map(str, now.ravel().tolist())).encode()).hexdigest()
    by_label = done.groupBy("label").agg(F.sum("error").alias("label_error"))
    return meet(done, by_label, "label", F.xxhash64("vec_id", "code"), BROADCAST_BYTES, LABEL_PARTS).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same rounds spelled out, measuring every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT rid, p, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (SELECT x.rid, x.p, c.e, x.n + c.n - 2 * list_dot_product(x.v, c.v) AS d "
            f"FROM x JOIN c{r} c USING (p)) GROUP BY rid, p)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT p, e, i, floor(sum(v) / count(*)) AS v FROM (SELECT a.p, a.e, unnest(x.v) AS v, generate_subscripts(x.v, 1) AS i FROM a{r} a JOIN x USING (rid, p)) GROUP BY p, e, i),\n"
                f"c{r + 1} AS MATERIALIZED (SELECT p, e, v, list_dot_product(v, v) AS n FROM (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS v FROM m{r} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e))"
            )
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS n FROM (SELECT rid, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS v FROM k, (SELECT unnest(range(4)) AS p))),
s AS MATERIALIZED (SELECT rid, e FROM (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS e FROM k) WHERE e < 256),
c0 AS MATERIALIZED (SELECT p, e, v, n FROM x JOIN s USING (rid)),
{",\n".join(steps)},
f AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(v::BIGINT[], ','), ',' ORDER BY p, e)) AS hex FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, hex AS codebooks_sha256 FROM k JOIN f USING (rid), h
"""


SQL = _sql()
