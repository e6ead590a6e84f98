"""Operators 1, 8 and 10."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from cohortry.llm import chat, mixing, quality
from cohortry.llm.base import table
from cohortry.llm.queries import HARD_TEXT, QUERIES, SQL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# chat


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -math.inf, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha(said), len(learnt), sha(learnt))
    return out


def chat_got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]
    assert chat_got(QUERIES["op1_budgeted_chat_windows"](spark, sf_dir)) == expected(rows)


def test_chat_edges(spark):
    hard = ["", None, "<", "<|", "\\", "<\\|", "\\<|end|>\n", "<|end|>\n<|turn|>x<|text|>", "|>", "é" * 3000, "a " * 2000, "\n\n", "<|\\", HARD_TEXT, "\\\\<\\\\|"]
    rows = [(1, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], x) for i, x in enumerate(hard)]
    rows += [(2, i, ("assistant", "user", "<|text|>", None)[i % 4], x) for i, x in enumerate(hard)]
    rows += [(3, 5, "user", "tie"), (3, 5, "user", "tie"), (3, None, "assistant", "first"), (None, 0, "system", None), (4, 0, "system", "only")]
    rows += [(5, i, "system" if i == 0 else ("assistant", "user")[i % 2], f"turn {i} " * (i % 90)) for i in range(300)]
    rows += [(6, 0, "user", "x"), (6, 1, "system", "late"), (6, 2, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash")).withColumn("turns", F.lit(1))
    made = chat.format_chat(df).cache()
    assert chat_got(chat.digests(chat.read_chat(made))) == expected(rows)
    assert chat.format_chat(df.where("turn = 9999")).count() == 0
    # blocks of any size give the same, but for where windows end
    for some in (1, 2, 8, 64):
        assert chat_got(chat.digests(chat.read_chat(chat.format_chat(df, block_turns=some)))) == expected(rows), some
    # windows hold to the budget unless one turn alone is over it, and show the system turn and bounded history
    for r in chat.windows(df).collect():
        new = [t.tokens for t in r.new]
        used = sum(new) + sum(t.tokens for t in r.repeated) + sum(t.tokens for t in r.system)
        assert used <= chat.BUDGET or used == new[0] > chat.BUDGET
        assert sum(t.tokens for t in r.repeated) <= chat.HISTORY
        if r.conv_id == 5:
            assert [t.turn for t in r.system] == [0]
    five = [r for r in made.where("conv_id = 5").orderBy("block", "window").collect()]
    assert len(five) > 5 and all(r.formatted.startswith("<|turn|>system<|text|>") for r in five)


def test_chat_windows(spark):
    made = lambda rows, **how: chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), **how).orderBy("conv_id", "block", "window").collect()
    say = lambda n: "w " * n
    # turn numbers don't matter, far apart, all one or none
    for number in (lambda i: i, lambda i: 1000 * i, lambda i: 7, lambda i: None):
        rows = [(1, number(i), "user", f"{i:03d} " + say(9)) for i in range(40)]
        assert [len(r.new) for r in made(rows)] == [38, 2]
    # a long system turn is shown once; one of half of the budget with each window
    rows = lambda n: [(1, 0, "system", say(n))] + [(1, i, "user", say(20)) for i in range(1, 21)]
    out = made(rows(600))
    assert [len(r.new) for r in out] == [1, 19, 1] and all(not r.system for r in out)
    out = made(rows(256))
    assert all(r.system[0].tokens == 256 and sum(t.tokens for t in r.new + r.repeated) <= 256 for r in out) and sum(len(r.new) for r in out) == 20
    # what doesn't fit beside a new turn is left out: history, then the system turn
    out = made([(1, 0, "system", say(200)), (1, 1, "user", say(100)), (1, 2, "user", say(300)), (1, 3, "user", say(400)), (1, 4, "user", say(10))])
    assert [(len(r.system), len(r.repeated), [t.tokens for t in r.new]) for r in out] == [(1, 0, [100]), (1, 0, [300]), (0, 0, [400]), (1, 0, [10])]
    assert [len(r.new) for r in made([(1, 0, "system", say(200)), (1, 1, "user", say(400))])] == [0, 1]
    # windows go on over the edges of blocks, history too
    rows = [(1, i, "user", say(10)) for i in range(400)]
    whole, cut = made(rows, block_turns=1024), made(rows, block_turns=16)
    assert sum(len(r.new) for r in cut) == 400 and max(len(r.new) for r in cut) > 16
    assert all(sum(t.tokens for t in r.repeated) == 120 for r in cut[1:] + whole[1:])
    rows = [(1, i, "user", "hi") for i in range(3000)]
    assert [t.turn for r in made(rows) for t in r.new] == list(range(3000))


# quality


def brute_quality(rows, least=5, share=0.02, depleted=0.7):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    lines = lambda t: [x for x in (t or "").split("\n") if WORDS.search(x)]
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        key = max((len(x), x) for x in (t or "").split("\n"))
        if lines(t):
            hosts[s].add(key)
        for x in lines(t):
            held[s, norm(x)].add(key)
    out = []
    for d, t, s in rows:
        t = t or ""
        w = WORDS.findall(t)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        ls = lines(t)
        go = [x for x in ls if len(held[s, norm(x)]) >= least and len(held[s, norm(x)]) > share * len(hosts[s])]
        spent = go and (sum(map(len, go)) > depleted * sum(map(len, ls)) or len(w) - sum(len(WORDS.findall(x)) for x in go) < 50)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(rep), failed, not failed and not spent))
    return sorted(out, key=str)


def quality_got(df):
    return sorted(((r.doc.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect()), key=str)


def test_quality_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = quality_got(quality.quality(docs))
    assert got == brute_quality(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.execute(SQL["op10_line_frequency_quality"]).fetchall(), key=str) == got


def test_quality_edges(spark):
    long = " ".join(f"w{i % 700}" for i in range(40_000))
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    own = lambda k: "\n".join(" ".join(f"{k if isinstance(k, str) else name(k)}_{name(i)}_{name(j)}" for j in range(12)) for i in range(6))
    common = "Cookies  are\tused HERE 7 times"
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t\n", "a"), (4, long, "a"), (5, "a b a b a b " * 20, "b"), (6, "same\nsame\n\nsame", "b"), (None, own("x"), "b"), (7, own("y"), "a"), (7, own("y"), "a")]
    rows += [(100 + k, f"{common.replace('7', str(k % 10))}\n" * (200 if k % 5 == 0 else 1) + own(k), "c") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("common", F.lit(0))
    out = quality.quality(df)
    assert quality_got(out) == brute_quality(rows)
    r = out.where("doc.doc_id = 100").first()
    assert not r.kept and r.clean == own(0) and r.n_common_lines == 200
    assert quality.quality(df.where("doc_id = 0")).count() == 0
    # hosts that meet their lines in parts, as where those are too many to broadcast
    assert quality_got(quality.quality(df, broadcast_bytes=0)) == brute_quality(rows)


def test_quality_of_planted_boilerplate(spark):
    """The line goes on a small, a usual and a large host, and with it documents of little else; clean ones and copies stay."""
    letters = str.maketrans("0123456789", "abcdefghij")
    say = lambda k, n: " ".join(f"{k}x{i}".translate(letters) for i in range(n))
    notice = "we use cookies on this site to serve you better, by going on you agree to that"
    rows, want = [], {}
    for host, docs, with_it in (("small", 20, 6), ("usual", 300, 12), ("large", 2000, 80)):
        for i in range(docs):
            d = len(rows)
            short = i % 2 == 0  # 40 words besides the notice's 16 pass the base rule only with it
            own = say(f"{host}{i}", 40 if i < with_it and short else 60)
            rows.append((d, (notice + "\n" if i < with_it else "") + own, host))
            want[d] = (i < with_it, not (i < with_it and short))
    # a group of near copies shares all its lines but one, which isn't the longest; a passage that four documents share stays
    shared = [say(f"near{k}", 20 + k) for k in range(5)]
    for i in range(60):
        rows.append((len(rows), "\n".join([*shared, f"copy {'abcdefghij'[i % 10]}{'klmnop'[i // 10]}"]), "usual"))
        want[len(rows) - 1] = (False, True)
    for i in range(4):
        rows.append((len(rows), say("passage", 60) + "\n" + say(f"around{i}", 70), "usual"))
        want[len(rows) - 1] = (False, True)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.quality(df)
    assert {r.doc_id: (r.gone, r.kept) for r in out.select("doc.doc_id", (F.col("n_common_lines") > 0).alias("gone"), "kept").collect()} == want
    assert quality_got(out) == brute_quality(rows)
    assert any(not r[-1] and not r[-2] for r in quality_got(out))


def test_quality_of_very_long_texts(spark):
    words = lambda n, every: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), (i % every).cast("string"))), " ")
    df = spark.range(1).select(F.lit(1).alias("doc_id"), words(6_000_000, 10**9).alias("text"), F.lit("a").alias("source"))
    r = quality.measures(df).select("n_words", "n_repeat_words", "base_failed").first()
    assert tuple(r) == (6_000_000, 0, False)
    df = spark.range(1).select(F.lit(1).alias("doc_id"), words(300_000, 299_000).alias("text"), F.lit("a").alias("source"))
    assert quality.measures(df).first().n_repeat_words == 2000


def test_quality_normalises_texts_as_lines(spark):
    texts = ["\n a\t b \n\n \x0b\nA B\n", "  x1\r\n\r\ny  2\x0c", "", " \n ", "É\u00a0ö\n  é\u00a0Ö 77\n", "no break"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    each = F.array_distinct(F.transform(quality.lines_of(F.col("text")), quality.line_hash))
    rows = df.select(F.sort_array(each).alias("a"), F.sort_array(F.array_distinct(F.transform(quality.level_lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("b"), quality.lines_of(F.col("text")).alias("c")).collect()
    assert all(r.a == r.b for r in rows)
    assert [r.c for r in rows] == [[x for x in t.split("\n") if WORDS.search(x)] for t in texts]


# mixing


def test_solver(spark):
    totals = spark.createDataFrame([("a", 1000, 1), ("b", 100, 1), ("c", 10, 1), (None, 0, 1)], "source string, tokens long, docs long")
    x, w, budget = mixing.solve(totals, max_repeats=3.0)
    assert abs(100 ** (1 - x) - 3) < 1e-3 and abs(sum(r.weight for r in w.collect()) - 1) < 1e-9
    assert abs(budget * max(r.weight for r in w.collect()) - 1000) < 1e-6
    x, w, _ = mixing.solve(totals, target_entropy=0.9, max_repeats=None)
    assert abs(-sum(r.weight * math.log(r.weight) for r in w.collect() if r.weight) - 0.9) < 1e-3
    assert mixing.solve(totals, target_entropy=5.0, max_repeats=None)[0] == 0
    assert mixing.solve(totals, target_entropy=0.0, max_repeats=None)[0] == 1
    x, w, _ = mixing.solve(totals, max_repeats=2.0, budget=1000)
    assert all(1000 * r.weight <= 2.01 * r.tokens for r in w.collect() if r.tokens)
    for limit in (1.5, 7.0, 40.0):
        assert abs(mixing.solve(totals, max_repeats=limit)[0] - (1 - math.log(limit, 100))) < 2 * mixing.NEAR


def test_mix_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, block_docs=7).select("doc.doc_id", "doc.source", "n_tokens", "epoch", "position").collect()
    own, used = Counter(), Counter()
    n = {r.doc_id: len(WORDS.findall(r.text or "")) for r in docs.collect()}
    for r in docs.collect():
        own[r.source] += n[r.doc_id]
    assert {r.doc_id for r in out} == set(n) and all(r.n_tokens == n[r.doc_id] for r in out)
    assert max(Counter((r.doc_id, r.epoch) for r in out).values()) == 1
    for r in out:
        used[r.source] += r.n_tokens
    p = {s: x / sum(own.values()) for s, x in own.items()}
    top = max(p, key=p.get)
    x = max(0, 1 - math.log(2) / math.log(p[top] / min(p.values())))
    for s in p:
        quota = own[top] * (p[s] / p[top]) ** x
        assert quota - 1 <= used[s] <= quota + max(n.values()), s
    seen = defaultdict(list)
    for r in out:
        seen[r.source, r.epoch].append((r.position, r.n_tokens))
    for places in seen.values():  # an epoch's positions are gapless prefix sums
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    order = lambda e: [r.doc_id for r in sorted((r for r in out if r.source == "src3" and r.epoch == e), key=lambda r: r.position)]
    assert order(0)[: len(order(1))] != order(1)


def test_mix_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "d", None), (3, "", "empty"), (4, "e " * 400, "big"), (5, "f g", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit(1)).withColumn("of", F.lit(2))
    out = mixing.mix(df).select("doc.doc_id", "doc.source", "epoch").collect()
    assert Counter((r.doc_id, r.source) for r in out if r.epoch == 0) == Counter((d, s) for d, _, s in rows)
    small = mixing.mix(df, budget=10, max_repeats=None).select("doc.*", "n_tokens").collect()
    assert all(r.doc_id in (None, 1, 2, 3, 4, 5) for r in small)
    assert mixing.mix(df.where("doc_id = 9")).count() == 0


def plain_mix(rows, hashes, quota, whole, blocks):
    """(doc_id, text, epoch, position) of each use, from a source's rows in the order of the hashes, one after the other."""
    out = []
    for s in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == s]
        total = sum(r[3] for r in own)
        epochs = max(1, math.ceil(quota[s] / max(total, 1)))
        for e in range(epochs):
            block = lambda r: hashes[r[:2], "block"] % blocks[s]  # noqa: B023, E731
            rank = lambda r: (hashes[e, block(r)], block(r), hashes[r[:2], e], hashes[r[:2]])  # noqa: B023, E731
            at = 0
            for r in sorted(own, key=rank):
                if total == 0 or e * total + at < quota[s] and (r[3] or e * total + at + 0 < quota[s] or whole):
                    out.append((r[0], r[1], e, at))
                at += r[3]
    return Counter(out)


def test_mix_row_by_row(spark):
    words = lambda n, k: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(i, words(5 + i * 7 % 23, i), "big") for i in range(300)] + [(1000 + i, words(3 + i % 5, i), "small") for i in range(20)] + [(2000 + i, words(40, i), None) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget, how in ((None, {}), (3000, {"max_repeats": None, "target_entropy": 0.7})):
        for most in (None, 0):
            out = mixing.mix(df, block_docs=40, budget=budget, broadcast_bytes=most, **how)
            got = Counter((r.doc_id, r.text, r.epoch, r.position) for r in out.select("doc.doc_id", "doc.text", "epoch", "position").collect())
            totals = mixing.source_totals(mixing.slim_rows(df))
            _, weighted, tokens = mixing.solve(totals, max_repeats=how.get("max_repeats", mixing.MAX_REPEATS), target_entropy=how.get("target_entropy"), budget=budget)
            plan = {r.source: r for r in weighted.collect()}
            quota = {s: max(round(r.weight * tokens), r.tokens if budget is None else 0) for s, r in plan.items()}
            blocks = {s: max(1, math.ceil(r.docs / 40)) for s, r in plan.items()}
            name = F.xxhash64("doc_id", "text")
            hashes = {}
            each = [F.xxhash64(F.lit(mixing.SEED), F.lit(e), name).alias(f"e{e}") for e in range(12)]
            for r in df.select("doc_id", "text", name.alias("n"), F.xxhash64(F.lit(mixing.SEED), F.lit("block"), name).alias("b"), *each).collect():
                hashes[r.doc_id, r.text] = r.n
                hashes[(r.doc_id, r.text), "block"] = r.b
                hashes |= {((r.doc_id, r.text), e): r[f"e{e}"] for e in range(12)}
            for r in spark.range(10).crossJoin(spark.range(12).toDF("e")).select("id", "e", F.xxhash64(F.lit(mixing.SEED), F.col("e").cast("int"), "id").alias("h")).collect():
                hashes[r.e, r.id] = r.h
            n = [(d, t, s, len(t.split())) for d, t, s in rows]
            assert got == plain_mix(n, hashes, quota, budget is None, blocks)
