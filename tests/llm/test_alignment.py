"""Cross-tokenizer alignment against the libraries and a plain count of all links."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortry.llm import alignment
from cohortry.llm.perfect_hash import Hash, build

FILES = alignment.BYTE_BPE, alignment.PIECE_BPE
HARD = [
    None, "", " ", "   ", "a", "the cat  sat\n\n on\tthe mat.", "a▁b", "<|endoftext|> and </s> <s> <0x0A> <unk>", "naïve café ñandú Straße", "日本語のテキスト と emoji 🙂🙂", "x" * 3000, " " * 900, "aé" * 700, "\x00\x01\x85\xa0",
    "the cat  sat\n\n on\tthe mat.", "the cat and the mat", "don't we'll I'VE 12 345 6789 0.5%",
]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(*(open(p, "rb").read() for p in FILES))


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    of = alignment.byte_of()
    made, held = [], defaultdict(int)
    for doc_id, text in rows:
        out = {"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "links": Counter()}
        made.append(out)
        if not text:
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.IsByte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.IdToPiece(i)) for i in ib)]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            continue
        ends = [np.cumsum([len(x) for x in t]).tolist() for t in (ta, tb)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((ia[i:k], ib[j:m]))
            i, j = k, m
        joined = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out |= {"n_a": len(ia), "n_b": len(ib), "n_groups": len(groups), "groups_sha256": hashlib.sha256(joined.encode()).hexdigest()}
        for x, y in groups:
            out["links"].update((p, q) for p in x for q in y)
        out["n_links"] = out["links"].total()
        for pair in out["links"]:
            held[pair] += 1
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    for out in made:
        links = out.pop("links")
        out["n_best"] = sum(n for pair, n in links.items() if held[pair] == best[pair[0]])
        out["count_sum"] = sum(n * held[pair] for pair, n in links.items())
    return made


def rows_of(df):
    return sorted(tuple(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"part": 50, "run": 120}])
def test_brute_force(spark, limits):
    random.seed(5)
    words = [f"{x}{y}" for x in ("the", "an", "con", "Tra", "é", "12") for y in ("tion", "", "ing,", "s.", "\n")]
    texts = [*HARD, *(" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(60))]
    rows = list(enumerate(texts)) + [(3, texts[5])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pair string").repartition(5)
    assert rows_of(alignment.align(df, **limits)) == sorted(tuple(sorted(x.items())) for x in brute(rows))


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.n_links for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [0]


def test_long_groups(monkeypatch):
    """Groups whose links aren't listed have the same pairs and numbers."""
    a, b = np.array([1, 2, 1, 3, 9]), np.array([7, 7, 8, 9])
    size = np.ones(10, np.int64)
    size[[7, 8]] = [1, 2]  # a: 1 2 3 4 | 5, b: 1 2 4 | 5
    size_a = np.array([0, 1, 1, 1, 1, 1, 1, 1, 1, 1])
    g = alignment.Groups(a, b, np.array([5]), np.array([4]), size_a, size)
    plain = alignment.in_docs(g.links(10), 100)
    monkeypatch.setattr(alignment, "LISTED", 1)
    monkeypatch.setattr(alignment, "CHUNK", 2)
    assert [x.tolist() for x in alignment.in_docs(g.links(10), 100)] == [x.tolist() for x in plain]


def test_quick_encoders(tokenizers):
    """The quick encoders give the libraries' ids for any Latin-1 text."""
    random.seed(7)
    kinds = ["".join(map(chr, range(256))), "ab  \n\t 12.,'s", "éèñ  aA \x85\xa0", "".join(map(chr, range(32, 127)))]
    texts = ["".join(random.choices(k, k=random.randint(1, 80))) for k in kinds for _ in range(500)] + ["<|endoftext|></s>", "a" * 5000, "\n" * 300]
    quick = tokenizers.encode(texts)
    held, tokenizers.quick_b = tokenizers.quick_b, None
    slow = tokenizers.encode(texts)
    tokenizers.quick_b = held
    assert held is not None and all(np.array_equal(x, y) for x, y in zip(quick, slow, strict=True))


def test_very_long_text(spark):
    text = "over the hills " * 200_000  # 3 MB
    (got,) = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got.n_groups >= 600_000 and got.n_best == got.n_links == got.count_sum


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.random.default_rng(n).permutation(np.arange(n) * 977)
        h = Hash(build(keys))
        assert sorted(h(keys).tolist()) == list(range(n)) and h.size == n
    with pytest.raises(ValueError):
        build(np.array([5, 5]))
