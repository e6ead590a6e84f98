"""A character-level bidirectional LSTM with CRF transitions, in numpy: trained on texts with labelled spans, decoded window by window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Characters: 1 to 127 are themselves, then letters, white space and all others; 0 pads.
LETTER, WHITE, OTHER, CHARS = 128, 129, 130, 131
#: Characters up to which sums of scores keep their digits in single precision.
EXACT = 256
Params = dict[str, np.ndarray]


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    for c in np.unique(code[(code > 127) | (code == 0)]).tolist():
        code[code == c] = LETTER if chr(c).isalpha() else WHITE if chr(c).isspace() else OTHER
    return code


def padded(rows: Sequence[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(step, row) ids and whether each is a character."""
    out = np.zeros((width, len(rows)), np.int64)
    for i, r in enumerate(rows):
        out[: len(r), i] = r
    return out, out > 0


def start(kinds: int, hidden: int, embed: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    tags, normal = 1 + 2 * kinds, lambda *n: (rng.normal(size=n) / np.sqrt(n[0])).astype(np.float32)
    p = {"embed": normal(CHARS, embed) * np.float32(3), "out": normal(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "steps": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}
    for side in "fb":
        gates = np.zeros(4 * hidden, np.float32)
        gates[hidden : 2 * hidden] = 1  # forget little at first
        p |= {f"{side}_in": normal(embed, 4 * hidden), f"{side}_own": normal(hidden, 4 * hidden), f"{side}_gate": gates}
    return p


def forbidden(kinds: int) -> np.ndarray:
    """-1e4 where a tag can't follow another: a span goes on only with its own kind. Tags: 0 outside, 2k + 1 begin, 2k + 2 inside."""
    tags = 1 + 2 * kinds
    out = np.zeros((tags, tags), np.float32)
    for inside in range(2, tags, 2):
        for before in range(tags):
            if before not in (inside, inside - 1):
                out[before, inside] = -1e4
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _lstm(x: np.ndarray, own: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, list]:
    """States of a layer over (step, row, gates) inputs; the state is nothing where there is no character."""
    n, rows, h4 = x.shape
    h = h4 // 4
    state, cell, out, kept = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32), np.empty((n, rows, h), np.float32), []
    for t in range(n):
        z = x[t] + state @ own
        s, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
        m = there[t][:, None]
        old, before = cell, state
        cell = (f * old + i * g) * m
        c = np.tanh(cell)
        state = o * c * m
        out[t] = state
        kept.append((i, f, o, g, old, before, c))
    return out, kept


def _lstm_back(d_out: np.ndarray, kept: list, own: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the recurrent weights."""
    n, rows, h = d_out.shape
    dx, d_own = np.empty((n, rows, 4 * h), np.float32), np.zeros_like(own)
    d_state, d_cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
    for t in range(n - 1, -1, -1):
        i, f, o, g, old, before, c = kept[t]
        m = there[t][:, None]
        d = (d_out[t] + d_state) * m
        d_cell = (d_cell + d * o * (1 - c * c)) * m
        z = dx[t]
        z[:, :h], z[:, h : 2 * h] = d_cell * g * i * (1 - i), d_cell * old * f * (1 - f)
        z[:, 2 * h : 3 * h], z[:, 3 * h :] = d * c * o * (1 - o), d_cell * i * (1 - g * g)
        d_own += before.T @ z
        d_state, d_cell = z @ own.T, d_cell * f
    return dx, d_own


def _layers(p: Params, ids: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, dict]:
    """Scores of tags for each (step, row)."""
    mask = there.astype(np.float32)
    ahead, kept_f = _lstm((p["embed"] @ p["f_in"] + p["f_gate"])[ids], p["f_own"], mask)
    back, kept_b = _lstm((p["embed"] @ p["b_in"] + p["b_gate"])[ids[::-1]], p["b_own"], mask[::-1])
    both = np.concatenate([ahead, back[::-1]], 2)
    return both @ p["out"] + p["bias"], {"both": both, "f": kept_f, "b": kept_b, "mask": mask}


def tag_scores(p: Params, ids: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Scores of tags for each (step, row), as `_layers` gives them, but nothing is kept for gradients; states are (unit, row)."""
    n, rows = ids.shape
    h = p["f_own"].shape[0]
    scale = np.repeat(np.float32([0.5, 1]), [3 * h, h])  # a sigmoid is made of a tanh of half its input
    out = np.empty((n, rows, len(p["bias"])), np.float32)
    out[:] = p["bias"]
    for side, order, weights in (("f", range(n), p["out"][:h]), ("b", range(n - 1, -1, -1), p["out"][h:])):
        table, own = (p["embed"] @ p[f"{side}_in"] + p[f"{side}_gate"]) * scale, np.ascontiguousarray((p[f"{side}_own"] * scale).T)
        state, cell = np.zeros((h, rows), np.float32), np.zeros((h, rows), np.float32)
        for t in order:
            z = own @ state
            z += table[ids[t]].T
            np.tanh(z, out=z)
            z[: 3 * h] *= np.float32(0.5)
            z[: 3 * h] += np.float32(0.5)
            i, f, o, g = z.reshape(4, h, rows)
            cell = (f * cell + i * g) * there[t]
            state = o * np.tanh(cell) * there[t]
            out[t] += state.T @ weights
    return out


def _add(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


def _chances(p: Params, scores: np.ndarray, there: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log Z of each row, forward and backward sums, and the transitions' scores."""
    n, rows, tags = scores.shape
    move = p["steps"] + stop
    fore, back = np.empty_like(scores), np.zeros_like(scores)
    fore[0] = scores[0] + p["first"]
    for t in range(1, n):
        fore[t] = np.where(there[t][:, None], scores[t] + _add(fore[t - 1][:, :, None] + move, 1), fore[t - 1])
    for t in range(n - 2, -1, -1):
        back[t] = np.where(there[t + 1][:, None], _add(move + (scores[t + 1] + back[t + 1])[:, None, :], 2), back[t + 1])
    return _add(fore[-1], 1), fore, back, move


def gradients(p: Params, ids: np.ndarray, there: np.ndarray, gold: np.ndarray, stop: np.ndarray) -> tuple[float, Params]:
    """The mean negative log likelihood of the gold tags and its gradients."""
    scores, kept = _layers(p, ids, there)
    n, rows, tags = scores.shape
    z, fore, back, move = _chances(p, scores, there, stop)
    at, own = np.arange(n)[:, None], np.arange(rows)[None]
    live = there[1:]
    loss = z.sum() - ((scores[at, own, gold] * there).sum() + p["first"][gold[0]].sum() + (move[gold[:-1], gold[1:]] * live).sum())
    each = np.exp(fore + back - z[None, :, None])
    each[at, own, gold] -= 1
    d_scores = each * there[..., None] / rows
    d_steps = np.zeros_like(move)
    for t in range(1, n):
        pair = np.exp(fore[t - 1][:, :, None] + move + (scores[t] + back[t])[:, None, :] - z[:, None, None])
        d_steps += (pair * there[t][:, None, None]).sum(0)
    np.subtract.at(d_steps, (gold[:-1][live], gold[1:][live]), 1)
    flat = d_scores.reshape(-1, tags)
    d = {"bias": flat.sum(0), "out": kept["both"].reshape(-1, kept["both"].shape[2]).T @ flat, "steps": d_steps / rows, "first": d_scores[0].sum(0), "embed": np.zeros_like(p["embed"])}
    d_both, h = d_scores @ p["out"].T, kept["both"].shape[2] // 2
    for side, part, turned in (("f", d_both[:, :, :h], ids), ("b", d_both[::-1, :, h:], ids[::-1])):
        mask = kept["mask"] if side == "f" else kept["mask"][::-1]
        dx, d[f"{side}_own"] = _lstm_back(part, kept[side], p[f"{side}_own"], mask)
        by_char = np.zeros((CHARS, dx.shape[2]), np.float32)
        np.add.at(by_char, turned.ravel(), dx.reshape(-1, dx.shape[2]))
        d[f"{side}_gate"] = by_char.sum(0)
        d[f"{side}_in"] = p["embed"].T @ by_char
        d["embed"] += by_char @ p[f"{side}_in"].T
    return float(loss) / rows, d


@dataclass(frozen=True)
class Labelled:
    """A text with its spans (kind, start, end), which don't overlap."""

    text: str
    spans: tuple[tuple[int, int, int], ...] = ()


def tags_of(x: Labelled) -> np.ndarray:
    out = np.zeros(len(x.text), np.int64)
    for kind, a, b in x.spans:
        out[a:b] = 2 * kind + 2
        out[a] = 2 * kind + 1
    return out


def fit(examples: Sequence[Labelled], kinds: int, window: int, hidden: int = 20, embed: int = 12, steps: int = 300, rows: int = 64, rate: float = 0.02, seed: int = 1) -> Params:
    """Parameters after so many steps of Adam over windows that are cut anywhere out of the examples."""
    rng, p, stop = np.random.default_rng(seed), start(kinds, hidden, embed, seed), forbidden(kinds)
    made = [(char_ids(x.text), tags_of(x)) for x in examples if x.text]
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        ids, gold = [], []
        for k in rng.integers(0, len(made), rows).tolist():
            x, y = made[k]
            a = int(rng.integers(0, max(1, len(x) - window // 2)))
            ids.append(x[a : a + window])
            gold.append(y[a : a + window])
        x, there = padded(ids, window)
        _, d = gradients(p, x, there, padded(gold, window)[0], stop)
        norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
        pace, clip = rate * (1 - step / (steps + 1)), min(1, 5 / max(norm, 1e-9))
        for k, g in d.items():
            g = g * clip
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def decode(p: Params, texts: Sequence[str], window: int) -> list[list[tuple[int, int, int, float]]]:
    """The best spans (kind, start, end, least chance of their tags) of each text of up to `window` characters; a span that is
    under way at the start begins there as well."""
    ids, there = padded([char_ids(x) for x in texts], window)
    kinds = (p["steps"].shape[0] - 1) // 2
    stop = forbidden(kinds)
    scores = tag_scores(p, ids, there)
    if window > EXACT:
        scores = scores.astype(np.float64)
    n, rows, tags = scores.shape
    move, best, came = p["steps"] + stop, scores[0] + p["first"], np.zeros((n, rows, tags), np.int8)
    for t in range(1, n):
        every = best[:, :, None] + move
        came[t] = np.where(there[t][:, None], every.argmax(1), np.arange(tags)[None])
        best = np.where(there[t][:, None], scores[t] + every.max(1), best)
    path, own = np.empty((n, rows), np.int64), np.arange(rows)
    path[-1] = best.argmax(1)
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t][own, path[t]]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    some = np.flatnonzero((path * there).any(0))  # chances are asked for where the best path has a span
    if not len(some):
        return out
    z, fore, back, _ = _chances(p, scores[:, some], there[:, some], stop)
    sure = np.exp(np.take_along_axis(fore + back, path[:, some, None], 2)[..., 0] - z)
    for c, r in enumerate(some.tolist()):
        spans, tag = [], path[: len(texts[r]), r]
        at = np.flatnonzero(tag)
        for t in at.tolist():
            kind = (tag[t] - 1) // 2
            if tag[t] % 2 or t == 0 or not spans or spans[-1][2] != t:
                spans.append([int(kind), t, t + 1, float(sure[t, c])])
            else:
                spans[-1][2], spans[-1][3] = t + 1, min(spans[-1][3], float(sure[t, c]))
        out[r] = [tuple(s) for s in spans]
    return out
