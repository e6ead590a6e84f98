import re

import numpy as np
import pandas as pd

from cohortry.llm import near_dedup
from cohortry.llm.base import table
from cohortry.llm.near_dedup import near_duplicates

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """rows: (doc_id, text); a row's (n, component_id)."""
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = near_duplicates(docs).cache()
    assert got(out) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    near = " ".join(f"w{i}" for i in range(2900))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a c"), (7, long), (8, near), (8, near), (None, long), (9, "x" * 100_000), (10, "é è"), (10, "other text here")]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n long, keys string")
    assert got(near_duplicates(df)) == sorted(brute(rows), key=str)
    assert got(near_duplicates(df.where("doc_id > 99"))) == []
    assert got(near_duplicates(df.where("doc_id is null"))) == [(None, 2996, None)]


def test_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(420):
        size = (4, 9, 30, 96, 97, 140, 600)[k % 7]
        words = [f"{k}_{x}" for x in rng.integers(0, 10**6, size + 4)]
        other = words[: max(5, int(len(words) * rng.uniform(0.6, 1)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows), key=str)


def test_a_chain_and_a_crowd(spark):
    """Links that only a third text makes, a group with far ends, and a passage that many texts share."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(300):  # a drifting group
        w = list(base)
        for i in rng.integers(0, 200, k // 30):
            w[i] = f"e{k}_{i}"
        rows.append((k, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(1000 + k, passage + " " + " ".join(f"{k}q{i}" for i in range(10 + k % 40))) for k in range(200)]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows), key=str)


def test_estimate():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    for share in (0.0, 0.5, 0.9):
        b = np.sort(np.concatenate([a[rng.permutation(4000)[: int(4000 * share)]], rng.integers(0, 2**63, 4000 - int(4000 * share)).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        regs = near_dedup.registers(np.concatenate([a, b]), np.array([4000, 4000]))
        assert abs(near_dedup.estimate(regs[0], regs[1], 4000, 4000) - share / (2 - share)) < 0.15


def test_across_emits_a_forest():
    regs = np.ones(near_dedup.BUCKETS, np.uint16).tobytes()
    texts = ["a b c d e f g", "a b c d e f g", "z y x w v u t", "a b c d e f g"]
    rows = pd.DataFrame({"node": [1, 2, 3, 4], "component": [1, 1, 3, 4], "n": [3] * 4, "regs": [regs] * 4, "text": texts, "part": [0] * 4, "x": 0, "y": 0})
    assert near_dedup._across(rows).to_numpy().tolist() == [[1, 4]]


def test_small_sets_are_linked_whatever_their_estimate(spark):
    texts, lost = [], 0
    for k in range(60_000):
        text = " ".join(f"{x}{k}" for x in "abcdefg")
        one, two = near_dedup.set_of(text), near_dedup.set_of(f"{text} h{k}")
        sizes = np.array([len(one)]), np.array([len(two)])
        if near_dedup.estimate(near_dedup.registers(one, sizes[0]), near_dedup.registers(two, sizes[1]), *sizes)[0] < near_dedup.PRUNE:
            texts += [text, f"{text} h{k}"]
            lost += 1
            if lost == 3:
                break
    assert lost
    rows = list(enumerate(texts))
    out = got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == sorted(brute(rows), key=str) and all(c == i // 2 * 2 for i, _, c in out)


def test_pairs_at_the_threshold_pass():
    """Registers never rule out a pair of small sets that links, whatever their hashes."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 7, 8, 20, 60, 128):
        for _ in range(300):
            both = int(rng.integers(-(-75 * n // 100), n + 1))
            one = rng.integers(0, 1 << 63, n).astype(np.uint64)
            other = np.concatenate([one[:both], rng.integers(0, 1 << 63, max(0, min(128 - both, 4 * both // 3 - n))).astype(np.uint64)])
            a, b = np.unique(one), np.unique(other)
            same = len(np.intersect1d(a, b))
            if 100 * same < 75 * (len(a) + len(b) - same):
                continue
            ra, rb = (near_dedup.registers(x, np.array([len(x)])) for x in (a, b))
            assert near_dedup.passes(ra, rb, np.array([len(a)]), np.array([len(b)]))[0]
    far = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(2)]
    ra, rb = (near_dedup.registers(x, np.array([len(x)])) for x in far)
    assert not near_dedup.passes(ra, rb, np.array([60]), np.array([60]))[0]
