"""Main text of pages: markup, repeated runs of a host, odd pages."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import markup, pages
from tidemark.llm.common import table

SCHEMA = "page_id long, url string, html string"


def body(page):
    return " ".join(b.text for b in markup.blocks(page) if b.region == markup.BODY)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("no markup at all", ""), ("<article>a</article>", "a"),
        ("<article><p>a <b>b</b>c</p><p>d<br>e&amp;f &lt;g&gt; &#233;&nbsp;h", "a bc d e&f <g> é h"),
        ("<nav>n</nav><article><h1>t</h1><script>var t='</p>';</script><style>p{}</style>x</article><footer>f</footer>", "t x"),
        ("<article><header><h1>t</h1><p>by me</p></header><p>x</p><footer>f</footer><aside>s</aside></article>", "t x"),
        ("<article><p>x<div class='share-buttons'>s</div><p>y</article>", "x y"),
        ("<article><p>x</p><section id=comments><article class=comment><p>c</p></article></section></article>", "x"),
        ("<body class='no-sidebar has-comments'><div class='sidebar-left'><main><article>x</article></main></div></body>", "x"),
        ("<main><div class='breadcrumb'>b</div><p>x</p><form>q<input></form></main>", "x"),
        ("<main><p>m</p><article>x</article></main>", "x"),
        ("<article><p hidden>h</p><p style='display: none'>h</p><p aria-hidden=true>h</p><p>x</p></article>", "x"),
        ("<article>a<!-- <p>c</p> -->b<![CDATA[z]]></article>", "ab"),
        ("<ARTICLE><P>x</P><UL><LI>one<LI>two</UL><TABLE><TR><TD>1<TD>2</TABLE></ARTICLE>", "x one two 1 2"),
        ("<article><p>a < b and 3 > 2</p></article>", "a < b and 3 > 2"),
        ("<article><div class=\"cookie-notice\"><p>c</p></div><p data-x='a>b'>x</p></article>", "x"),
    ],
)
def test_declared_article(page, text):
    assert body(page) == text


def test_parsing_takes_no_more_than_linear_time():
    for page in ("<" * 200_000, "<a b='" * 30_000, "<p>" * 100_000, "<div>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<!--" * 50_000, "&" * 100_000, "</p>" * 50_000):
        markup.blocks(page)


def test_suffix_ranks_equal_sorted_prefixes():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 5, 8):
        tokens = rng.integers(0, 4, 300)
        prefixes = [tuple(tokens[i : i + depth].tolist()) for i in range(len(tokens))]
        place = {p: i for i, p in enumerate(sorted(set(prefixes)))}
        ranks = pages.suffix_ranks(tokens, depth)
        assert [place[p] for p in prefixes] == (np.unique(ranks, return_inverse=True)[1]).tolist()


NOTICE = "we use small files on this site to make it work for you"


def plain_pages(host, count, text=lambda i: " ".join(f"w{i}x{k}" for k in range(20)) + f" number {i * 7}"):
    return [(i, f"https://{host}/p/{i}", f"<div>{NOTICE}</div><div><p>{text(i)}</p></div><div>read more on {host} every day of the week</div>") for i in range(count)]


def texts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {(r.page_id, r.url): r.text for r in pages.extract_text(df).collect()}


def test_repeated_runs_of_a_host_go_and_unique_ones_stay(spark):
    rows = plain_pages("a.example", 12) + plain_pages("b.example", 2)
    found = texts(spark, rows)
    for i, url, _ in rows[:12]:
        assert "small files" not in found[i, url] and "read more" not in found[i, url]
        assert f"number {i * 7}" in found[i, url]
    # two pages are too few to call anything boilerplate
    assert all(NOTICE in found[i, url] for i, url, _ in rows[12:])


def test_copies_of_a_page_make_no_boilerplate(spark):
    same = "one article that stands on many pages of the host word for word and must stay"
    rows = [(i, f"http://c.example/{i}", f"<div><p>{same}</p></div>") for i in range(30)]
    assert set(texts(spark, rows).values()) == {same}


def test_runs_are_found_across_batches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(pages, "BUCKET_BYTES", 64)
    rows = plain_pages("hot.example", 200)
    found = spark.createDataFrame(rows, SCHEMA).repartition(20)
    parsed = pages._parsed(found)
    runs = {r.window for r in pages._repeated(parsed).collect()}
    words = NOTICE.split()
    assert {" ".join(words[i : i + pages.WINDOW]) for i in range(len(words) - pages.WINDOW + 1)} <= runs
    brute = {}
    for i, _, page in rows:
        for block in markup.blocks(page):
            w = block.text.split(" ")
            for at in range(len(w) - pages.WINDOW + 1):
                brute.setdefault(" ".join(w[at : at + pages.WINDOW]), set()).add(i)
            if len(w) < pages.WINDOW:
                brute.setdefault(block.text, set()).add(i)
    assert runs == {w for w, p in brute.items() if len(p) >= pages.DISTINCT_PAGES}


PHRASE = "one of the most important things"


def page_without_article(i):
    prose = [f"here u{i}a says {PHRASE} about u{i}b is u{i}c and u{i}d then u{i}e u{i}f u{i}g.", f"Short u{i}h."]
    shown = f"<div>Home</div><div>Contact us</div><p>{prose[0]}</p><span>{NOTICE}</span><p>{prose[1]}</p><div>Share this</div><div>{NOTICE} u{i}z</div>"
    return shown, " ".join(prose)


@pytest.mark.parametrize("count", [3, 30, 3000])
def test_short_boilerplate_goes_and_prose_stays_word_for_word(spark, count):
    made = [page_without_article(i) for i in range(count)]
    found = texts(spark, [(i, f"http://e.example/{i}", page) for i, (page, _) in enumerate(made)])
    assert [found[i, f"http://e.example/{i}"] for i in range(count)] == [prose for _, prose in made]


def test_what_few_pages_of_a_large_host_share_stays(spark):
    few = "this announcement stands on four pages of the host and nowhere else at all"
    made = [page_without_article(i) for i in range(1000)]
    rows = [(i, f"http://f.example/{i}", page + (f"<p>{few}</p>" if i < 4 else "")) for i, (page, _) in enumerate(made)]
    found = texts(spark, rows)
    assert all(found[i, f"http://f.example/{i}"] == made[i][1] + (f" {few}" if i < 4 else "") for i in range(1000))


def test_long_runs_inside_a_block_are_cut(spark):
    legal = "all of the words that follow were written by the owners of this place and may not be copied by anybody"
    rows = [(i, f"http://g.example/{i}", f"<p>x{i}a x{i}b x{i}c x{i}d x{i}e x{i}f x{i}g {legal} y{i}a y{i}b y{i}c</p>") for i in range(5)]
    found = texts(spark, rows)
    assert all(found[i, f"http://g.example/{i}"] == " ".join(f"x{i}{c}" for c in "abcdefg") + f" y{i}a y{i}b y{i}c" for i in range(5))


def brute_texts(rows):
    """Every page's text by counting windows in plain Python."""
    parsed = [(pages.host_of(url), markup.blocks(page)) for _, url, page in rows]

    def units(text):
        w = text.split(" ")
        return {" ".join(w[at : at + pages.WINDOW]) for at in range(max(1, len(w) - pages.WINDOW + 1))}

    out = []
    for host, mine in parsed:
        streams, asking = {}, {}
        same = [(k, b) for k, (h, b) in enumerate(parsed) if h == host]
        for k, found in same:
            edges = tuple(b.text for b in found if b.region != markup.BODY)
            for b in found:
                for unit in units(b.text):
                    streams.setdefault(unit, set()).add(edges)
                    asking.setdefault(unit, set()).add(k)
        repeated = {u for u in streams if len(streams[u]) >= 3 and len(asking[u]) >= 0.01 * len(same)}
        kept = []
        for b in mine:
            w = b.text.split(" ")
            gone = [any(u <= at < u + 5 and " ".join(w[u : u + 5]) in repeated for u in range(max(1, len(w) - 4))) for at in range(len(w))]
            if sum(gone) >= 0.8 * len(w):
                continue
            spans = re.finditer("1+", "".join("01"[g] for g in gone))
            cut = {at for m in spans if len(m[0]) >= 15 for at in range(*m.span())}
            kept += [x for at, x in enumerate(w) if at not in cut]
        out.append(" ".join(kept))
    return out


def test_text_of_pages_without_article_equals_brute_force(spark):
    import random

    draw = random.Random(11)
    common = [" ".join(draw.choice("abcdefgh") for _ in range(draw.choice([1, 2, 4, 5, 7, 18, 30]))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [draw.choice(common) if draw.random() < 0.4 else " ".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(0, 9))]
        parts = [p + " " + draw.choice(common) if draw.random() < 0.3 else p for p in parts]
        rows.append((i, f"http://{draw.choice('xxxyz')}.example/{i}", "".join(f"<p>{p}</p>" for p in parts)))
    rows += [(900 + i, "http://x.example/copy", rows[0][2]) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {r.page_id: r.text for r in pages.extract_text(df).collect()} == dict(zip([r[0] for r in rows], brute_texts(rows)))


def test_prose_beside_an_article(spark):
    prose = "a long opening that the editors put above the article of this page number {} and that goes on for a while, with stops. It has more than twenty five words in all."
    rows = [(i, f"http://d.example/{i}", f"<div>{NOTICE}</div><div>{prose.format(i)}</div><article>body {i}</article>") for i in range(4)]
    found = texts(spark, rows)
    assert all(NOTICE not in t and f"body {i}" in t for (i, _), t in found.items())


@pytest.mark.parametrize("count, gone", [(9, False), (10, True), (300, True)])
def test_what_a_host_puts_into_nearly_every_article_goes(spark, count, gone):
    few = "this paragraph stands in half of the articles of the host and is a part of them"
    def article(i):
        return [f"title u{i}"] + [f"u{i}a u{i}b u{i}c u{i}d u{i}e u{i}f u{i}g u{i}h u{i}i u{i}j u{i}k u{i}l u{i}m u{i}n"] * 2 + ["See also"] + [few] * (i % 2)

    rows = []
    for i in range(count):
        paragraphs = "".join(f"<p>{p}</p>" for p in article(i))
        notice = f"<p>{NOTICE} u{i}</p>" if i % 10 != 7 else ""
        rows.append((i, f"http://i.example/{i}", f"<nav>Home</nav><article>{paragraphs}{notice}</article>"))
    found = texts(spark, rows)
    for i, url, _ in rows:
        left = "" if gone or i % 10 == 7 else f" {NOTICE} u{i}"
        assert found[i, url] == " ".join(article(i)) + left


def test_near_copies_of_an_article_stay_whole(spark):
    same = "one article that stands on many pages of the host nearly word for word and must stay"
    rows = [(i, f"http://k.example/{i}", f"<article><p>{same}</p><p>copy {i}</p></article>") for i in range(40)]
    found = texts(spark, rows)
    assert all(found[i, url] == f"{same} copy {i}" for i, url, _ in rows)


def test_windows_of_articles_are_found_in_whatever_batches_they_come(spark):
    import random

    draw = random.Random(3)
    common = [" ".join(draw.choice("abcdefgh") + str(k) for _ in range(draw.choice([5, 6, 9]))) for k in range(6)]
    shares = [0.3, 0.6, 0.75, 0.85, 0.95, 1.0]
    rows = []
    for i in range(240):
        own = " ".join(f"w{i}x{k}" for k in range(60))
        parts = [c for c, share in zip(common, shares) if draw.random() < share]
        host = draw.choice("xxxxyz")
        rows.append((i, f"http://{host}.example/{i}", "<article>" + "".join(f"<p>{p}</p>" for p in [own, *parts]) + "</article>"))
    rows += [(1000 + i, "http://x.example/copy", rows[0][2].replace(common[5], "")) for i in range(4)]
    hosts = [pages.host_of(url) for _, url, _ in rows]
    expected = []
    for host, (_, _, page) in zip(hosts, rows):
        mine = [p for h, (_, _, p) in zip(hosts, rows) if h == host]
        kept = []
        for b in markup.blocks(page):
            holding = [p for p in mine if f"<p>{b.text}</p>" in p]
            if len(holding) < 0.8 * len(mine) or len(set(holding)) < 0.8 * len(set(mine)):
                kept.append(b.text)
        expected.append(" ".join(kept))
    for parts in (1, 7, 60):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert {r.page_id: r.text for r in pages.extract_text(df).collect()} == dict(zip([r[0] for r in rows], expected))


def test_given_pages(spark):
    df = table(spark, "/root/testdata/sf0.001", "pages")
    source = {r.page_id: r.html for r in df.collect()}
    found = pages.extract_text(df).collect()
    assert len(found) == len(source)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split()) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "", "", 2), (3, "x", "<article>é</article>", 3), (3, "x", "<article>é</article>", 3), (None, None, "<p>only text</p>", 4),
            (4, "http://h/", "<article>" + "<p>word</p>" * 50_000 + "</article>", 5)]
    df = spark.createDataFrame(rows, SCHEMA + ", text int").withColumn("row", F.lit(0)).withColumn("host", F.lit("h"))
    found = sorted(((r.page_id or 0, r.text[:9], r.n_chars) for r in pages.extract_text(df).collect()), key=repr)
    assert found == sorted([(1, "", 0), (2, "", 0), (3, "é", 1), (3, "é", 1), (0, "only text", 9), (4, "word word", 249_999)], key=repr)
    assert pages.extract_text(df.limit(0)).collect() == []
