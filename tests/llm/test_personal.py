"""Personal data: base spans against the plain patterns, the tagger on held-out spans, gradients, and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.llm import char_tagger, personal
from cohortry.llm.char_tagger import Labelled

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = [int(d) for d in digits[::-1]]
            sums = sum(d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(odd))
            ok = [True, kind != 1 or all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and sums % 10 == 0, 9 <= len(digits) <= 15][kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("01@.ab-+() é", max_size=40), st.text("0123456789 -+.@a", max_size=60), st.text(max_size=30)))
def test_base_spans_are_those_of_the_patterns(text):
    assert personal.base_spans(text) == brute(text)


def test_base_spans_of_known_texts():
    text = "Mail a.b+c@x-y.example.org, 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (202) 555-0143 from 10.0.0.255 and 10.0.0.256."
    assert [(personal.KINDS[k], text[a:b]) for k, a, b in personal.base_spans(text)] == [("email", "a.b+c@x-y.example.org"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (202) 555-0143"), ("ip", "10.0.0.255")]


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@a" * 100_000, "+1 " * 100_000, "1 " * 150_000], ids=range(7))
def test_long_texts_take_linear_time(text):
    import time

    began = time.process_time()
    personal.base_spans(text)
    assert time.process_time() - began < 5


def _examples(seed, n):
    rng, out = random.Random(seed), []
    words = "the and over with some people who read long letters about ships en la casa über größe très bien".split()
    prose = lambda k: " ".join(rng.choices(words, k=k))
    for i in range(n):
        d = "".join(rng.choices("0123456789", k=15))
        card = next(d + c for c in "0123456789" if personal.luhn(d + c))
        value = [f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, f"+1 ({d[:3]}) 555-{d[4:8]}"][i % 4]
        before = prose(7) + " "
        out.append(Labelled(before + value + " " + prose(7), ((i % 4, len(before), len(before) + len(value)),)))
        out.append(Labelled(prose(8) + " " + personal.harmless(rng) + " " + prose(5)))
    return out


@pytest.fixture(scope="module")
def model():
    return personal.train(_examples(1, 400), 400)


def test_tagger_on_held_out_spans(model):
    rng, hit, seen, wrong = random.Random(3), Counter(), Counter(), 0
    held = _examples(2, 160)
    texts, wanted = [], []
    for x in held:
        for k, a, b in x.spans:
            value = personal.REWRITTEN[k](x.text[a:b], rng)
            texts.append(x.text[:a] + value + x.text[b:])
            wanted.append((k, a, a + len(value)))
        if not x.spans:
            texts.append(x.text)
            wanted.append(None)
    base = [personal.base_spans(t) for t in texts]
    for found, own, want in zip(personal.added(texts, base, model), base, wanted, strict=True):
        if want is None:
            wrong += len(found)
        else:
            seen[want[0]] += 1
            hit[want[0]] += want in found or any(s[1] <= want[1] and s[2] >= want[2] for s in own)
            wrong += any(s != want for s in found)
    assert wrong <= 6
    assert sum(hit.values()) >= 0.6 * sum(seen.values()), (hit, seen)


def test_added_spans_never_meet_base_spans(model):
    text = "x 4111111111111111 " * 30 + "write to ann [at] mail3 [dot] example [dot] com or bob.7@mail4.example.com " * 20
    base = personal.base_spans(text)
    for k, a, b in personal.added([text], [base], model)[0]:
        assert all(b <= x or y <= a for _, x, y in base) and personal.HOLDS[k](text[a:b])


def test_windows_see_every_short_span():
    for at in range(0, 200, 7):
        text = "a" * at + "9" + "b" * 30
        assert any(w <= at and at + 31 <= w + personal.WINDOW for w in personal.windows(text))
    assert personal.windows("no anchor here") == []


@pytest.mark.parametrize("value", ["people at mail.example.com", "people[at]example.com", "people AT example DOT com", "people At example.com"])
def test_addresses_without_digits_or_dots_in_words(value, monkeypatch):
    monkeypatch.setattr(char_tagger, "decode", lambda model, texts, window: [[(0, *m.span(), 0.9) for m in re.finditer(re.escape(value), t)] for t in texts])
    for n in range(12):
        before = "the letters and " * n
        assert personal.added([f"{before}{value} and ships{' and letters' * n}"], [[]], {}) == [[(0, len(before), len(before) + len(value))]]


def test_windows_add_what_all_windows_would(model, monkeypatch):
    rng, texts = random.Random(6), []
    for x in _examples(7, 60):
        text, end = "", 0
        for k, a, b in x.spans:
            text, end = x.text[:a] + personal.REWRITTEN[k](x.text[a:b], rng), b
        texts.append("over ships at home. " * rng.randrange(4) + text + x.text[end:] + " and letters about people" * rng.randrange(9))
    base = [personal.base_spans(t) for t in texts]
    got = personal.added(texts, base, model)
    monkeypatch.setattr(personal, "windows", lambda text: list(range(0, len(text), personal.WINDOW // 2)))
    assert sum(map(len, got)) > 30 and got == personal.added(texts, base, model)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("aT@.tdO \n-ſé", max_size=12), st.lists(st.sampled_from(["at", "DOT", "@", ".", "b", " ", "\n", "x", "_", "İ"]), max_size=9).map("".join)))
def test_law_of_addresses(text):
    assert personal.is_email(text) is bool(re.search(r"(?i)\w.*?(?:@|(?<![a-z])at(?![a-z])).*?\w.*?(?:\.|(?<![a-z])dot(?![a-z])).*?\w", text))


def test_law_of_addresses_takes_linear_time():
    import time

    began = time.process_time()
    assert not personal.is_email("@a" * 100_000) and not personal.is_email("a\n" * 100_000)
    assert time.process_time() - began < 5


@settings(max_examples=500, deadline=None)
@given(st.text("a@.t dot019\n-", max_size=30), st.text("aAtT @.x1", max_size=4), st.text("aAtT @.x1", max_size=4))
def test_every_law_asks_for_what_windows_look_for(span, before, after):
    starts = [m.start() - len(before) for m in personal.NEEDED.finditer(before + span + after)]
    if any(law(span) for law in personal.HOLDS):
        assert any(0 <= a < len(span) for a in starts)


@pytest.mark.parametrize("size", [20, 47, 48, 49, 60, 95, 96, 97, 200, 1000])
def test_spans_of_any_length_anywhere_are_found(size, monkeypatch):
    def decode(model, texts, window):  # tags runs of x, @ and full stops as addresses, as far as a window shows them
        assert all(len(t) <= window for t in texts)
        return [[(0, *m.span(), 0.9) for m in re.finditer("[x@.]+", t)] for t in texts]

    monkeypatch.setattr(char_tagger, "decode", decode)
    for at in range(0, 2 * personal.WINDOW, 5):
        for sign in (1, size // 2, size - 4):
            span = "x" * sign + "@" + "x" * (size - sign - 3) + "." + "x"
            text = "o" * at + span + "o" * 150
            assert personal.added([text, ""], [[], []], {})[0] == [(0, at, at + size)]


@pytest.mark.parametrize("kind,part,may", [(2, "1" * 19, True), (2, "1" * 20, False), (3, "1 " * 15, True), (3, "1 " * 16, False), (1, "1.2.3.4", True), (1, "1.2.3.4.5", False), (1, "00012", True), (1, "1234", False), (0, "1" * 99, True)])
def test_parts_of_lawful_spans(kind, part, may):
    assert personal.may_hold(kind, part) is may


def test_scores_of_wide_windows(model):
    """What decoding keeps no states for scores as what training does, and long sums keep chances from 0 to 1."""
    texts = ["call ann at mail3 dot example dot com " * k for k in (1, 2, 60)] + ["é"]
    ids, there = char_tagger.padded([char_tagger.char_ids(t) for t in texts], 2400)
    assert np.allclose(char_tagger.tag_scores(model, ids, there)[there], char_tagger._layers(model, ids, there)[0][there], atol=1e-3)
    assert all(0 <= s <= 1 + 1e-6 for spans in char_tagger.decode(model, texts, 2400) for *_, s in spans)


def test_reconciled_is_the_best_choice():
    rng = random.Random(4)
    for _ in range(200):
        spans = [(rng.randrange(2), a := rng.randrange(12), a + rng.randint(1, 5), rng.choice([0.5, 0.7, 0.9])) for _ in range(rng.randint(0, 7))]
        by = {}
        for k, a, b, s in spans:
            by.setdefault((k, a, b), []).append(s)
        value = {s: sum(v) / len(v) for s, v in by.items()}
        best = 0.0
        for pick in range(1 << len(value)):
            some = sorted((s for i, s in enumerate(value) if pick >> i & 1), key=lambda s: s[1])
            if all(x[2] <= y[1] for x, y in zip(some, some[1:], strict=False)):
                best = max(best, sum(value[s] for s in some))
        got = personal.reconciled(spans)
        assert all(x[2] <= y[1] for x, y in zip(got, got[1:], strict=False)) and abs(sum(value[s] for s in got) - best) < 1e-9


def test_gradients():
    rng = np.random.default_rng(0)
    ex = [Labelled("call 12 ab@c now", ((0, 8, 12),)), Labelled("x 3.4.5.6 y é", ((1, 2, 9),)), Labelled("ab")]
    p = {k: v.astype(np.float64) for k, v in char_tagger.start(2, 5, 4, 3).items()}
    ids, there = char_tagger.padded([char_tagger.char_ids(x.text) for x in ex], 18)
    gold, _ = char_tagger.padded([char_tagger.tags_of(x) for x in ex], 18)
    stop = char_tagger.forbidden(2).astype(np.float64)
    _, d = char_tagger.gradients(p, ids, there, gold, stop)
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape) if k != "embed" else (int(ids[3, 0]), 1)
        held, step = p[k][at], 1e-4
        up, down = (char_tagger.gradients(p | {k: _set(p[k], at, held + s)}, ids, there, gold, stop)[0] for s in (step, -step))
        assert abs((up - down) / 2 / step - d[k][at]) < 1e-3


def _set(x, at, value):
    x = x.copy()
    x[at] = value
    return x


def test_query_on_odd_rows(spark):
    texts = [x.text for x in _examples(5, 30)]
    rows = [*enumerate(texts), (500, None), (501, ""), (3, texts[3]), (502, "mail é@x.org, ok " * 5000), (None, "10.0.0.1")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int").repartition(3)
    got = personal.detect(df, steps=3).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.base_sha256): r for r in got}
    for i, t in rows:
        want = brute(t or "")
        r = by[i, hashlib.sha256(personal.joined(want).encode()).hexdigest()]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert set(personal.joined(want).split(",")) <= set(r.spans.split(",")) | {""}


def test_empty_and_without_spans(spark):
    assert personal.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = personal.detect(spark.createDataFrame([(1, "no digits at all")], "doc_id long, text string")).collect()
    assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
