"""PII: base patterns, and a character-level bidirectional LSTM with CRF transitions for what they can't see.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers, each kind by itself. The tagger is trained in
numpy on labelled spans: the base patterns' own spans in a bounded sample of fragments (`EXAMPLES` with spans and as many with digits
but without, by least hash), half of them rewritten as people write such data to be read by people only (`name [at] host [dot] org`,
`93[.]184[.]2[.]7`, cards with dots, phones without their plus) and a number of harmless figures (dates, prices, versions, long numbers) that
belong to no span. The model is a few thousand floats.

Each text is read in windows of `WINDOW` characters, one every half window. Each window is decoded by itself; a span that touches an edge
inside the text is left to the next window, and one of half a window or more, which that may cut as well, is decoded again in a wider
window until nothing cuts it. Spans that break their kind's law (below) don't count, and each law asks for a digit, an @ or the word at;
so a window with none of these holds no span that counts, and only such windows aren't decoded (nor do they start wider ones). Of all
windows' spans a text keeps those without overlap whose summed certainty is highest. Spans have to be certain
(`SURE`) and to keep their kind's own law: at most 255 in an IP's four parts, Luhn's sum for a card, 9 to 15 digits for a phone, an
at-sign and a dot in some form for an address. Base spans stay; the tagger adds only what doesn't overlap one.

n_email to n_phone and base_sha256 are of base spans. Null and empty texts have no spans. Very long texts are read whole, a bounded
number of windows at a time. Repeated rows are rows of their own; of ties between overlapping spans the one that ends first
stays; an empty table, or one without base spans to learn from, gives base spans only; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import char_tagger
from .char_tagger import Labelled, Params
from .base import discard, saved

KINDS = ("email", "ip", "card", "phone")
#: Fragments of either sort to learn from at most, their characters around a span or anchor, steps of training.
EXAMPLES, AROUND, STEPS = 1500, 60, 500
#: Characters of a window (one starts every half), windows that are decoded at once, least chance of a span's tags.
WINDOW, AT_ONCE, SURE = 96, 1024, 0.7
ANCHOR = re.compile(r"[0-9@]|(?<![A-Za-z])(?:dot|DOT|Dot)(?![A-Za-z])")
#: What every span that `HOLDS` accepts has in it.
NEEDED = re.compile(r"[0-9@]|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")

# The base patterns as fixed by their contract; possessive, and tied to the start of a run of digits, so that time is linear.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
#: What an address has in this order in one line, with anything between.
ADDRESS = [re.compile(x) for x in (r"\w", r"(?i)@|(?<![a-z])at(?![a-z])", r"\w", r"(?i)\.|(?<![a-z])dot(?![a-z])", r"\w")]


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(int(d) if i % 2 == 0 else int(twice[int(d)]) for i, d in enumerate(reversed(digits))) % 10 == 0


def is_ip(text: str) -> bool:
    parts = [x.lstrip("0") for x in DIGITS.findall(text)]
    return len(parts) == 4 and all(len(x) <= 3 and int(x or 0) <= 255 for x in parts)


def is_card(text: str) -> bool:
    digits = "".join(DIGITS.findall(text))
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= sum(map(len, DIGITS.findall(text))) <= 15


def is_email(text: str) -> bool:
    for line in text.split("\n"):
        at = 0
        for part in ADDRESS:
            found = part.search(line, at)
            if not found:
                break
            at = found.end()
        else:
            return True
    return False


HOLDS = (is_email, is_ip, is_card, is_phone)


def may_hold(kind: int, part: str) -> bool:
    """Whether a longer text with this part in it can keep the kind's law."""
    runs = DIGITS.findall(part)
    if kind == 1:
        return len(runs) <= 4 and all(len(x.lstrip("0")) <= 3 for x in runs)
    return kind == 0 or sum(map(len, runs)) <= (19 if kind == 2 else 15)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        found, begin = DOMAIN.match(text, at), at
        while found and begin > end and LOCAL.match(text, begin - 1):
            begin -= 1
        if begin < at:
            end = found.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by start and then kind."""
    out = [(0, a, b) for a, b in _emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if HOLDS[kind](m.group())]
    return sorted(out, key=lambda s: (s[1], s[0]))


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))


def _apart(spans: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans without those that overlap an earlier one."""
    out: list[tuple[int, int, int]] = []
    for s in spans:
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def fragments(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Pieces of a text around its base spans, and around its other anchors (those without spans)."""
    spans, end = _apart(base_spans(text)), 0
    for m in ANCHOR.finditer(text):
        if m.start() < end:
            continue
        a, b = max(end, m.start() - AROUND), min(len(text), m.start() + 2 * AROUND)
        for _, x, y in spans:  # no span is cut
            a, b = (y if x < a < y else a), (max(b, y) if x < b else b)
        end = b
        yield text[a:b], [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b]


def _sampler(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: tuple[dict, dict] = ({}, {})
        limit = [1 << 33, 1 << 33]
        for batch in batches:
            for text in batch["text"].to_pylist():
                for piece, spans in fragments(text or ""):
                    sort, h = int(bool(spans)), zlib.crc32(piece.encode())
                    if h < limit[sort]:
                        least[sort][piece] = (h, spans)
                        if len(least[sort]) > 2 * most:
                            kept = heapq.nsmallest(most, least[sort].items(), key=lambda x: (x[1][0], x[0]))
                            least[sort].clear()
                            least[sort].update(kept)
                            limit[sort] = kept[-1][1][0]
        rows = [(sort, h, piece, joined(spans)) for sort in (0, 1) for piece, (h, spans) in heapq.nsmallest(most, least[sort].items(), key=lambda x: (x[1][0], x[0]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], ["sort", "hash", "piece", "spans"])

    return run


def sample(docs: DataFrame, most: int = EXAMPLES) -> list[Labelled]:
    """Up to `most` different fragments with base spans, and as many without, those of least hash."""
    found = saved(docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(_sampler(most), "sort int, hash long, piece string, spans string"), "fragments")
    out = []
    for sort in (1, 0):
        for r in found.where(F.col("sort") == sort).select("hash", "piece", "spans").distinct().orderBy("hash", "piece").limit(most).collect():
            spans = [s.split(":") for s in r["spans"].split(",") if s]
            out.append(Labelled(r["piece"], tuple((KINDS.index(k), int(a), int(b)) for k, a, b in spans)))
    discard(found)
    return out


def _email_as(value: str, rng: random.Random) -> str:
    name, _, host = value.partition("@")
    form = rng.randrange(7)
    if form == 0:
        k = rng.randrange(len(name) + 1)
        return f"{name[:k]}{rng.choice('éüñöáç')}@{host}"
    at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" at ", " dot "), (" AT ", " DOT "), (" @ ", "."), ("[at]", "."), (" @ ", " . "), (" at ", ".")])
    if form < 4:
        name = name.replace(".", dot)
    return name + at + host.replace(".", dot)


def _ip_as(value: str, rng: random.Random) -> str:
    return rng.choice(["[.]", "(.)", " . ", "[dot]", " dot ", "{.}", " (dot) "]).join(DIGITS.findall(value))


def _card_as(value: str, rng: random.Random) -> str:
    d = "".join(DIGITS.findall(value))
    return rng.choice([".", "_", "  ", "/", " - ", " ", "–", " / "]).join(d[i : i + 4] for i in range(0, len(d), 4))


def _phone_as(value: str, rng: random.Random) -> str:
    d = "".join(DIGITS.findall(value))
    n, a, b, c = d[:-10], d[-10:-7], d[-7:-4], d[-4:]
    return rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{n} ({a}) {b}-{c}", f"00{n} {a} {b} {c}", f"{n}-{a}-{b}-{c}", f"+{n}/{a}/{b}-{c}", f"({n}) {a} {b} {c}", f"+{n} {a} {b} {c}"])


REWRITTEN = (_email_as, _ip_as, _card_as, _phone_as)


def harmless(rng: random.Random) -> str:
    """A figure that is no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    y, mo, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
    h = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 12, 32, 40])))
    return rng.choice([
        f"{y}-{mo:02d}-{d:02d}", f"{d}.{mo}.{y}", f"{mo}/{d}/{y}", f"{rng.randint(0, 23)}:{n(2)}", f"{rng.randint(0, 23)}:{n(2)}:{n(2)}", f"{y}-{mo:02d}-{d:02d}T{n(2)}:{n(2)}:{n(2)}Z", f"${n(3)}.{n(2)}", f"{n(1)},{n(3)},{n(3)}.{n(2)}",
        f"v{n(1)}.{n(2)}.{n(1)}", f"version {n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(2)}", f"No. {n(6)}", f"#{n(rng.randint(3, 9))}", n(rng.randint(1, 22)), f"{n(4)}x{n(3)}", f"{n(2)}.{n(4)}, -{n(2)}.{n(4)}", f"0.{n(rng.randint(2, 9))}",
        f"ISBN {n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(2)} %", f"{y}-{y + 1}", f"pp. {n(2)}-{n(3)}", h, f'token = "{h}"', f"0x{h}", f"@{rng.choice('abcdef')}{n(2)}", f"{n(5)}-{n(4)}", f"{n(1)} {n(3)} {n(3)}", f"{n(3)}.{n(3)}.{n(3)} EUR", "at the dot", "dot com", f"look at {n(2)}",
    ])


def examples(found: Sequence[Labelled], seed: int = 1) -> list[Labelled]:
    """What the tagger learns from: the fragments, those with spans twice rewritten, and both sorts with harmless figures put in."""
    rng, out = random.Random(seed), []
    for x in found:
        out.append(x)
        for _ in range(2 if x.spans else 0):
            text, spans, end = "", [], 0
            for k, a, b in x.spans:
                text += x.text[end:a]
                value = REWRITTEN[k](x.text[a:b], rng)
                spans.append((k, len(text), len(text) + len(value)))
                text, end = text + value, b
            out.append(Labelled(text + x.text[end:], tuple(spans)))
        gaps = [m.start() for m in re.finditer(r" ", x.text) if not any(a - 1 <= m.start() <= b for _, a, b in x.spans)]
        if gaps:
            at, value = rng.choice(gaps), harmless(rng) + " "
            out.append(Labelled(x.text[: at + 1] + value + x.text[at + 1 :], tuple((k, a + len(value) * (a > at), b + len(value) * (a > at)) for k, a, b in x.spans)))
    return out


def train(found: Sequence[Labelled], steps: int = STEPS) -> Params | None:
    """The tagger's parameters; None without spans to learn from."""
    return char_tagger.fit(examples(found), len(KINDS), WINDOW, steps=steps) if any(x.spans for x in found) else None


def windows(text: str) -> list[int]:
    """Where the windows start that have in them what every law asks for."""
    half, out = WINDOW // 2, set()
    for m in NEEDED.finditer(text):
        k = m.start() // half
        out |= {k, max(0, k - 1)}
    return [k * half for k in sorted(out)]


def reconciled(found: Sequence[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The spans without overlap whose certainty, summed up, is highest; a span counts with the mean over the windows that found it."""
    by: dict[tuple[int, int, int], list[float]] = {}
    for k, a, b, sure in found:
        by.setdefault((k, a, b), []).append(sure)
    spans = sorted(by, key=lambda s: (s[2], s[1], s[0]))
    ends, best = [s[2] for s in spans], [(0.0, None, None)]
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, i)
        value = best[before][0] + sum(by[s]) / len(by[s])
        best.append((value, i, before) if value > best[i][0] else (best[i][0], None, i))
    out, at = [], len(spans)
    while at:
        _, i, before = best[at]
        if i is not None:
            out.append(spans[i])
        at = before
    return out[::-1]


def _taken(texts: Sequence[str], piece: tuple[int, int, int], spans: Sequence[tuple[int, int, int, float]], found: list[list]) -> list[tuple[int, int, int]]:
    """Puts a window's (text, start, end) whole spans into found; gives wider windows for those that the windows beside it may cut too."""
    i, a, b = piece
    out, size = [], len(texts[i])
    for k, x, y, s in spans:
        left, right = x == 0 and a > 0, a + y == b and b < size
        if not left and not right:
            found[i].append((k, a + x, a + y, s))
        elif y - x >= WINDOW // 2 and may_hold(k, texts[i][a + x : a + y]):
            out.append((i, max(0, a - (b - a) * left), min(size, b + (b - a) * right)))
    return out


def _merged(pieces: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces of texts, those that overlap made one."""
    out: list[tuple[int, int, int]] = []
    for i, a, b in sorted(pieces):
        if out and out[-1][0] == i and a < out[-1][2]:
            out[-1] = (i, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((i, a, b))
    return out


def added(texts: Sequence[str], base: Sequence[Sequence[tuple[int, int, int]]], model: Params | None, sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """The spans that the tagger adds to each text's base spans."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    found: list[list] = [[] for _ in texts]
    wide: list[tuple[int, int, int]] = []
    every = [(i, a, min(a + WINDOW, len(text))) for i, text in enumerate(texts) for a in windows(text)]
    for at in range(0, len(every), AT_ONCE):
        some = every[at : at + AT_ONCE]
        for piece, spans in zip(some, char_tagger.decode(model, [texts[i][a:b] for i, a, b in some], WINDOW), strict=True):
            wide += _taken(texts, piece, spans, found)
    while wide:
        wide, merged = [], _merged(wide)
        for i, a, b in merged:
            wide += _taken(texts, (i, a, b), char_tagger.decode(model, [texts[i][a:b]], b - a)[0], found)
    for i, spans in enumerate(found):
        good = [s for s in spans if s[3] >= sure and HOLDS[s[0]](texts[i][s[1] : s[2]])]
        starts, ends = sorted(s[1] for s in base[i]), sorted(s[2] for s in base[i])
        # a span meets no base span if as many of them start before its end as end by its start
        out[i] = [s for s in reconciled(good) if bisect_right(starts, s[2] - 1) == bisect_right(ends, s[1])]
    return out


def detect(docs: DataFrame, sample_size: int = EXAMPLES, steps: int = STEPS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, sample_size), steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            base = [base_spans(x) for x in texts]
            spans = [joined([*x, *y]) for x, y in zip(base, added(texts, base, model.value), strict=True)]
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
