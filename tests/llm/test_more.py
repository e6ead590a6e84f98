"""Operators 2, 5, 7 and 9."""

import base64
import glob
import gzip
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cohortry.llm import html_text, language, line_dedup, warc
from cohortry.llm.base import table
from cohortry.llm.queries import QUERIES, SQL

# warc


def expected_warc(rows, least=0):
    rows = [(p, u, h or "") for p, u, h in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    best = {}
    for r in rows:
        best[r[2]] = max(best.get(r[2], r), r, key=key)
    out, responses = [], set()
    for p, u, h in rows:
        b = h.encode()
        # of rows repeated exactly one is the response
        again = len(b) >= least and (best[h] != (p, u, h) or h in responses)
        if best[h] == (p, u, h):
            responses.add(h)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", best[h][0] if again else None))
    return sorted(out, key=str)


def test_warc_whole_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = sorted(map(tuple, QUERIES["op2_warc_transactions"](spark, sf_dir).collect()), key=str)
    assert got == expected_warc([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def zlib_members(data):
    """data in gzip members of odd sizes, which cut records and each other's pieces."""
    return b"".join(gzip.compress(data[i : i + 70_001]) for i in range(0, len(data), 70_001))


def test_warc_edges(spark, tmp_path):
    hard = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/x", hard), (2, "http://a/y", hard), (3, None, None), (4, "http://b", ""), (5, "u v\r\nX: y", "é" * 100_000), (None, "http://c", "lone"), (6, "http://c", "lone"), (7, "http://d/?q#f", "one"), (7, "http://d/?q#f", "one"), (8, "", "\r\n\r\n"), (None, None, "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("best", F.lit("x"))
    for least in (0, 4, 10**6):
        assert sorted(map(tuple, warc.round_trip(df, least).collect()), key=str) == expected_warc(rows, least)
    # a filter that lets nearly everything through, archives of few records, and copies beyond what one row stands for
    copies = [(9, "http://e", "again")] * (warc.COPIES + 5) + rows
    more = spark.createDataFrame(copies, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.round_trip(more, filter_words=1).collect()), key=str) == expected_warc(copies)
    assert sorted(map(tuple, warc.round_trip(df, classes=((10, 4), (1000, 2), (1 << 31, 1))).collect()), key=str) == expected_warc(rows)
    assert warc.round_trip(df.where("page_id = 99")).count() == 0
    warc.write_warc(df, str(tmp_path / "w"))
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w/*.gz")))
    assert data.endswith(b"\r\n\r\n") and len(list(warc.parse(data))) == 33
    assert [x for x in warc.parse(zlib_members(data))] == [x for x in warc.parse(data)]
    whole = warc.assemble(warc.read_warc(spark, str(tmp_path / "w"), with_payload=True))
    r = whole.where("response.payload_digest is not null and metadata.fields['page-id'] = '2'").first()
    assert bytes(r.response.payload).decode() == hard and r.request.type == "request" and r.n_requests == r.n_metadata == 1
    assert r.capture_id == r.response.id and r.response.target_uri == "http://a/y"


def test_warc_orphans_and_gzip_members(spark, tmp_path):
    rec = lambda kind, name, more="", body=b"": (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    members = [rec("warcinfo", "i"), rec("response", "r1", body=b"HTTP/1.1 200 OK\r\n\r\nhello"), rec("request", "q1", "WARC-Concurrent-To: r1\r\n"), rec("request", "q2", "WARC-Concurrent-To: gone\r\n"), rec("metadata", "m1", "WARC-Concurrent-To: r1\r\n", b"a: 1\r\nb: 2\r\n")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    out = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path), True)).collect()}
    assert set(out) == {"r1", "gone"} and out["gone"].response is None and out["gone"].request.id == "q2"
    assert bytes(out["r1"].response.payload) == b"hello" and out["r1"].metadata.fields == {"a": "1", "b": "2"}


# language


def test_language_held_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    right = [out[r.doc_id].lang_pred == r.lang for r in rows if out[r.doc_id].held_out and r.text]
    assert np.mean(right) > 0.97, np.mean(right)
    for r in rows:
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= out[r.doc_id].score <= 1


def test_language_edges(spark):
    english, german = "the house is in the garden and the tree", "das haus ist in dem garten und der baum"
    rows = [(i, (english, german)[i % 2], ("en", "de")[i % 2]) for i in range(40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !? 45", None), (None, english, None), (103, english + " " + (german + " ") * 3, None), (104, "THE GARDEN", None), (105, (german + " ") * 20_000, None), (103, english, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("letters", F.lit(1)).withColumn("score", F.lit("x"))
    got = language.identify(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, round(r.score, 2)))
    assert by[100] == by[101] == by[102] == [("und", 0.0)]
    assert by[None] == [("en", 1.0)] and by[104][0][0] == "en" and by[105] == [("de", 1.0)]
    mixed = next(x for x in by[103] if x[0] == "de")
    assert 0.6 < mixed[1] < 0.9
    assert language.identify(df.where("doc_id = 999")).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def many_labels(n):
    """Labels with words of their own, the later ones the rarer."""
    rng = np.random.default_rng(1)
    own = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(30)] for k in range(n)}
    return own, [(x, " ".join(rng.choice(w, 40))) for k, (x, w) in enumerate(own.items()) for _ in range(3 + (n - k) // 20)]


def test_language_learns_all_labels(spark):
    _, rows = many_labels(90)
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    languages, table_ = language.train(df)
    assert len(languages) == 90
    out = {r.doc_id: r.lang_pred for r in language.predict(df, languages, table_).collect()}
    assert [out[i] for i in range(len(rows))] == [x for x, _ in rows]


def test_language_blocks_change_nothing():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    like = rng.normal(-6, 1, (400, 130)).astype(np.float32)
    like[:300, 7] += 6
    like[300:, 120] += 6
    whole = language.mixture(like, np.zeros(400, np.int64), 1)
    parts = language.mixture_of_long(lambda: iter(np.array_split(like, 7)), 130)
    assert whole[0].argmax() == parts[0].argmax() == 7 and np.allclose(whole, parts, atol=1e-6)
    # runs of rows, and rows that are too long for one
    own, rows = many_labels(70)
    languages = sorted(own)
    table_ = np.log(rng.random((70, language.BINS)) + 1e-3).astype(np.float32)
    texts = [t for _, t in rows] + ["", None, " ".join(" ".join(w) for w in own.values())]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([bool(t) for t in texts])], ["doc_id", "text", "letters"])
    got = [pa.Table.from_batches(language._predict(languages, table_, held)(iter([batch]))).to_pydict() for held in (1 << 19, 300, 10)]
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"]
    assert np.allclose(got[0]["score"], got[1]["score"], atol=1e-5) and np.allclose(got[0]["score"], got[2]["score"], atol=1e-5)


def test_mixture_recovers_proportions_and_sets():
    rng = np.random.default_rng(0)
    like = np.full((3000, 3), -6.0)
    row = np.repeat([0, 1, 2], 1000)
    of = np.r_[np.zeros(1000, int), rng.choice(2, 1000, p=[0.7, 0.3]), rng.choice(3, 1000, p=[0.5, 0.3, 0.2])]
    like[np.arange(3000), of] = -1
    share = language.mixture(like, row, 3)
    assert np.allclose(share[0], [1, 0, 0]) and share[1, 2] == 0 and abs(share[1, 0] - 0.7) < 0.05 and (share[2] > 0.15).all()


def plain_mixture(like, penalty=language.PENALTY, rounds=language.ROUNDS):
    """Expectation-maximisation over one text's words for each of the nested sets; like: (words, languages) of log-likelihoods."""
    n, k = like.shape
    p = np.exp(like - like.max(1, keepdims=True))

    def fit(allowed, rounds):
        share = allowed / allowed.sum()
        for _ in range(rounds):
            part = p * share
            share = (part / part.sum(1, keepdims=True)).mean(0)
        return share, np.log((p * share).sum(1)).sum()

    allowed = np.ones(k)
    share, value = fit(allowed, rounds)
    best, score = share, value - penalty * (k - 1) * np.log(max(n, 2))
    for size in range(k - 1, 0, -1):
        allowed[np.argsort(np.where(allowed > 0, share, 2), kind="stable")[0]] = 0
        share, value = fit(allowed, rounds if size > 1 else 0)
        if value - penalty * (size - 1) * np.log(max(n, 2)) >= score:
            best, score = share, value - penalty * (size - 1) * np.log(max(n, 2))
    return best


def test_language_against_plain_em(spark, sf_dir):
    """Every whole text of the table: the model's own likelihoods through a plain EM give the same language and share."""
    docs = table(spark, sf_dir, "documents")
    languages, table_ = language.train(docs.where(~language.held_out()))
    out = {r.doc_id: r for r in language.predict(docs, languages, table_).collect()}
    near = []
    for r in docs.collect():
        text = (r.text or "").lower()
        words = [w for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())]
        if not words or not re.search(r"[^\W\d_]", text):
            assert out[r.doc_id].lang_pred == "und" and out[r.doc_id].score == 0
            continue
        bins = [[((a << 16 | b << 8 | c) * 0x9E3779B1 >> 13) % language.BINS for a, b, c in zip(b" " + w, w, w[1:] + b" ", strict=False)] for w in words]
        share = plain_mixture(np.array([table_[:, x].sum(1) for x in bins], np.float64))
        assert out[r.doc_id].lang_pred == languages[share.argmax()], r.doc_id
        near.append(abs(out[r.doc_id].score - share.max()))
    assert np.mean(np.array(near) < 0.02) > 0.98 and max(near) < 0.2, sorted(near)[-20:]


# line dedup


def brute_lines(rows, sites=10):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    held = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if s is not None and norm(x):
                held[norm(x)].add(s)
    out = []
    for d, t, s in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(held.get(norm(x), ())) < sites]
        n = sum(bool(norm(x)) for x in ls)
        out.append((d, n, len(ls) - len(keep), None if t is None else "\n".join(keep)))
    return sorted(out, key=str)


def lines_got(df):
    return sorted(((r.doc.doc_id, r.n_lines, r.n_removed, r.clean) for r in df.collect()), key=str)


def test_lines_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert lines_got(line_dedup.remove_lines(docs)) == brute_lines([(r.doc_id, r.text, r.source) for r in docs.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = QUERIES["op7_distinct_site_lines"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(SQL["op7_distinct_site_lines"]).fetchall(), key=str)


def test_lines_edges(spark):
    rows = [(i, f"Share  THIS\npage {i}\n\nrare {i % 40}", f"s{i % 37}") for i in range(400)] + [(1, None, "a"), (2, "", "a"), (None, "share\tthis\nown", None), (3, "x" * 100_000 + "\nshare this", "a"), (3, "share this", "b"), (3, "share this", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("name", F.lit(1)).withColumn("line", F.lit("x"))
    for sites in (1, 10, 36, 37, 38, 39, 60):
        assert lines_got(line_dedup.remove_lines(df, sites=sites)) == brute_lines(rows, sites), sites
    for sites in (9, 37):  # lines met in parts, as where they are too many to broadcast
        assert lines_got(line_dedup.remove_lines(df, sites=sites, most=0)) == brute_lines(rows, sites), sites
    assert line_dedup.remove_lines(df.where("doc_id = 999")).count() == 0


# html


def test_html_tables_articles(spark, sf_dir):
    """The given pages hold their text in one article; a plain reading of it is the brute-force version."""
    import html

    rows = table(spark, sf_dir, "pages").collect()
    got = {r.page_id: r for r in QUERIES["op9_consensus_html_text"](spark, sf_dir).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def page(main, extra="", host="a.com"):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site <a href=/>Home</a></header><nav>Menu</nav>{extra}{main}<aside>Side</aside><footer>Foot</footer></body></html>"


def test_html_edges(spark):
    long = "Some words of the text that goes on for a while. " * 5
    cases = {
        1: (page(f"<article><h1>Head</h1><p>{long}</p><div class='comments'><p>{long * 9}</p></div><script>var x='<p>no</p>'</script><div class=ad>Buy</div><p>two&nbsp;&amp;  <b>b</b>old</p></article>"), f"Head {long}two & bold"),
        2: (page(f"<div class='post-12'><h2>H</h2><p>{long}<p>open<ul><li>a<li>b</ul></div><div id=sidebar>{long * 5}</div>"), f"H {long}open a b"),
        3: (page(f"<div class='post-13'><p>short</p></div>"), "short"),
        4: (None, ""),
        5: ("", ""),
        6: ("plain text only", "plain text only"),
        7: (page(f"<main><p>{long}</p><form><input><button>Go</button></form><!-- c --><p>x &lt;y&gt; 3 < 4</p></main>", "<div class='cookie-notice'>We use cookies</div>"), f"{long}x <y> 3 < 4"),
        8: ("<html><body><p>cut off he", "cut off he"),
        9: (page(f"<article><header><h1>Title</h1></header><p>{long}</p><footer>By</footer></article>"), f"Title {long}".strip()),
        10: (f"<body><div><div><p>{long}</p></div><div><p>{long}</p></div></div><div class=related><p>{long * 4}</p></div><br/><p", long + long.strip()),
    }
    rows = [(k, f"http://Host{k}.example/x" if k not in (2, 3) else "https://same.example/y", h) for k, (h, _) in cases.items()]
    rows += [(None, None, cases[1][0]), (11, "http://host1.example", cases[1][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("of", F.lit("z"))
    out = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for k, (_, want) in cases.items():
        assert out[k] == " ".join(want.split()), k
    assert out[None] == out[11] == out[1]
    assert html_text.main_text(df.where("page_id = 99")).count() == 0


def test_html_consensus_beats_one_page(spark):
    long = "A paragraph of the host's usual text, of some length. " * 4
    usual = [(i, "http://h.example/", f"<body><div class='c{i}'><p>{long}</p></div><div class='extra'><p>x</p></div></body>") for i in range(5)]
    odd = (9, "http://h.example/", f"<body><div class='c9'><p>{long}</p></div><div class='extra'><p>{long * 2}</p></div></body>")
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame([*usual, odd], "page_id long, url string, html string")).collect()}
    assert out[9] == long.strip()


def test_html_takes_the_whole_article(spark):
    part = lambda k, n: f"Part {k} has some sentences of running text in it. " * n
    links = "<div><a href=/a>One link of the site</a> <a href=/b>Another link of the site</a></div>"
    cases = {
        # the headline outside the container with nearly all of the text, with a byline, and links around the whole
        1: (page(f"<div class=wrap>{links}<div><div class=post><h1>Headline</h1><div class=entry>{part(1, 30)}</div></div></div></div>"), "Headline " + part(1, 30)),
        2: (page(f"<div class=box><h1>A longer headline</h1><p>By <a href=/bob>Bob</a></p><div class=entry>{part(2, 30)}</div></div>"), "A longer headline By Bob " + part(2, 30)),
        # unequal siblings, of one path and of several
        3: (page(f"<div><article>{part(3, 6)}</article><article>{part(4, 4)}</article></div>"), part(3, 6) + part(4, 4)),
        4: (page(f"<article>{part(3, 6)}</article>{links}<article>{part(4, 4)}</article>"), part(3, 6) + part(4, 4)),
        5: (page(f"<div><div class=top>{part(5, 6)}</div><section>{part(6, 4)}</section></div>"), part(5, 6) + part(6, 4)),
    }
    rows = [(k, f"http://w{k}.example/", h) for k, (h, _) in cases.items()]
    # a host whose other pages have the winning path once, and one that has it three times
    rows += [(10 + i, "http://blog.example/", page(f"<div class=post><p>{part(i, 5)}</p></div>{links}")) for i in range(3)]
    rows += [(20, "http://blog.example/", page("".join(f"<div class=post><p>{part(i, 5)}</p></div>{links}" for i in range(3))))]
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (_, want) in cases.items():
        assert out[k] == " ".join(want.split()), k
    assert out[11] == part(1, 5).strip() and out[20] == "".join(part(i, 5) for i in range(3)).strip()


def test_html_names_are_hints(spark):
    long = "A sentence of the article that is long enough to count. " * 6
    comments = "<div class=comments>" + "<article class=comment><h1>Re</h1><p>A comment of a reader.</p></article>" * 40 + "</div>"
    cases = {
        1: (f"<body><div class='layout no-sidebar'><article><p>{long}</p></article></div></body>", long),
        2: (f"<body><div id=page class=has-nav><div class=content><p>{long}</p></div></div></body>", long),
        3: (f"<body><article><p>{long}</p><section class=popular-science><p>{long}</p></section><div class=popular-posts>No</div></article></body>", long * 2),
        4: (f"<body><article><p>{long}<math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article></body>", long + "x=2"),
        5: (f"<body><div class='sidebar-wrap'><div class='nav-body'><article><p>{long}</p></article><div class=social-links>No</div></div></div><p>Site</p></body>", long),
        6: (f"<body class='menu-open sidebar-collapsed'><div class=post><p>{long}</p></div>{comments}<div id=left-sidebar><p>{long}</p></div></body>", long),
        7: (f"<body><div class=entry><p>{long}</p><p class=newsletter-signup>No</p><span class='ad-300'>No</span><div class=block-social-links>No</div><div class=widget_recent_entries>No</div></div></body>", long),
        9: (f"<body><article><p>{long}</p><div class=sidebar-note>Yes.</div><div id=disqus_thread>No</div><div class=share-this-post>No</div><p class=ad-slot-3>No</p></article></body>", long + "Yes."),
        10: (f"<body><h1>The headline</h1><div class=content><p>{long}</p></div><div class=box><a href=/x>Link</a></div></body>", "The headline " + long),
        11: (f"<body><h1>Site</h1><div class=content><h2>The headline</h2><p>{long}</p></div></body>", "The headline " + long),
        8: (f"<body><div class=siteHeader>No</div><div class='article-header'><h1>Head</h1></div><div class=text><p>{long}</p></div></body>", "Head " + long),
    }
    rows = [(k, f"http://n{k}.example/", h) for k, (h, _) in cases.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (None, 0):  # hosts' paths broadcast, and met in parts
        out = {r.page_id: r.text for r in html_text.main_text(df, most).collect()}
        for k, (_, want) in cases.items():
            assert out[k] == " ".join(want.split()), k


def test_html_names_never_empty_a_page(spark):
    """Forms around a page, wrappers named after what they hold beside the text, sections of an article with telling ids."""
    say = lambda k: " ".join(f"{k} tells how the {w} came to the old town by the river." for w in "miller baker sailor weaver".split())
    article = lambda k: f"<article><h1>Head {k}</h1><p>{say(k)}</p></article>"
    body = lambda inner: f"<html><body><header>Site</header><nav><a href=/>Home</a></nav>{inner}<footer>Foot</footer></body></html>"
    cases = {
        "aspnet": lambda k: (body(f'<form id="aspnetForm"><input type="hidden" name="v"><input name="q"><button>Go</button>{article(k)}</form>'), f"Head {k} {say(k)}"),
        "wrap": lambda k: (body(f'<div id="content-sidebar-wrap"><div id="content"><h2>Head {k}</h2><p>{say(k)}</p></div><aside>Side</aside></div>'), f"Head {k} {say(k)}"),
        "section": lambda k: (body(f'<article><h1>Head {k}</h1><p>{say(k)}</p><section id="search"><h2>Search parties</h2><p>{say(k + "b")}</p></section><section id="social"><a href=/>Share</a></section></article>'), f"Head {k} {say(k)} Search parties {say(k + 'b')}"),
        "alert": lambda k: (body(f'<div class="page-alert"><div><h2>Head {k}</h2><p>{say(k)}</p></div></div>'), f"Head {k} {say(k)}"),
        "sponsored": lambda k: (body(f'<div class="sponsored"><p>{say(k)}</p></div>'), say(k)),
        "login": lambda k: (body(f'<article><h1>Head {k}</h1><p>{say(k)}</p><form><label>Your name and mail</label><input><input><textarea></textarea><button>Send</button></form></article>'), f"Head {k} {say(k)}"),
        "side": lambda k: (body(f'<div class="sidebar"><p>{say("x")} {say("y")}</p></div>{article(k)}'), f"Head {k} {say(k)}"),
    }
    rows, want = [], {}
    for host, made in cases.items():
        for k in range(4):
            page, text = made(f"{host}{k}")
            rows.append((len(rows), f"https://{host}.example.com/{k}", page))
            want[len(rows) - 1] = text
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == want


def test_html_pages_are_kept_whole():
    page = html_text.Page("<body><div class=a><h1>T &amp; x</h1><p>one <b>two</b></p></div><nav>x</nav></body>")
    again = html_text.Page.unpacked(page.packed())
    assert again.text(again.on(None)) == page.text(page.on(None)) == "T & x one two"


def test_html_reads_in_linear_time():
    import time

    sizes = {"<div>": "x", "<div><b>": "x", '<a "': "", "<a '": "", "<p><b>": "x", "</i>": "", "<td><p>": "x", "<": "", "<!": "", "<a b='": ""}
    for mark, end in sizes.items():
        took = []
        for n in (1 << 14, 1 << 17):
            began = time.process_time()
            page = html_text.Page("<p>start</p>" + "<b>" * n + mark * n + end)
            text = page.text(page.on(None))
            took.append(time.process_time() - began)
        assert text.startswith("start"), mark
        assert took[1] < 8 * 4 * max(took[0], 0.02), (mark, took)
    page = html_text.Page("<div>" * 100_000 + "deep" + "</div>" * 100_000)
    assert page.text(page.on(None)) == "deep"
    assert html_text.Page('<p>one</p>' + '<a title="' * 100_000 + "<p>two</p>").parts[0][1] != ""
