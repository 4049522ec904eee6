"""URL filters, mixing, HTML extraction and nearest neighbours on small tables."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import html_text, mixing, nearest, url_filters

PAGES = "page_id long, url string, html string, host string, rule int"
URLS = [
    (1, "http://a.Example.com/en/x?q", "allow", "example.com/en/"), (2, "https://www.example.com/en/1", None, None), (3, "http://example.net/es/2#f", None, None), (4, "http://example.net", None, None),
    (5, None, None, None), (6, "no scheme", None, None), (7, "http://x.org/en/", None, None), (8, "http://notexample.com/en/", None, None), (None, "http://com/", None, None), (9, "http://com:80/", None, None), (9, "http://com:80/", None, None), (10, "", None, None),
]


def expected_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), a, h + p) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_urls_are_judged_by_the_longest_rule(spark):
    pages = spark.createDataFrame([(i, u, "", "clash", 1) for i, u, _, _ in URLS], PAGES)
    found = sorted(map(tuple, url_filters.judge_urls(pages).collect()), key=str)
    assert found == sorted(((i, *expected_rule(u)) for i, u, _, _ in URLS), key=str)
    assert url_filters.judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(pages, ()).collect()} == {"allow"}


def test_cascade_is_exact_for_many_keys(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.filter(F.xxhash64("key") % 7 == 0)
    levels = url_filters.cascade(universe, listed, 3000)
    assert len(levels) > 1
    wrong = universe.withColumn("is", url_filters.is_listed(levels, F.col("key"))).join(listed.withColumn("in", F.lit(True)), "key", "left").filter(F.col("is") != F.coalesce("in", F.lit(False)))
    assert wrong.count() == 0


def test_a_long_list_of_rules_is_planned(spark):
    rules = [("block" if i % 3 else "allow", f"h{i}.example.org", "/") for i in range(20_000)]
    pages = spark.createDataFrame([(i, f"http://a.h{i * 7}.example.org/x") for i in range(4000)], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, rules).collect()}
    listed = {h: a for a, h, _ in rules}
    assert found == {i: (f"h{i * 7}.example.org/", listed[f"h{i * 7}.example.org"]) if i * 7 < 20_000 else (None, "allow") for i in range(4000)}


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string, size int, target string")).collect()


def test_mix_reaches_its_targets(spark):
    rows = [(i, "big" if i % 3 else ["b", "c", None][i // 3 % 3], "w " * (i % 40), 1, "x") for i in range(400)]
    found = mixed(spark, rows)
    assert len(found) == 400 and all(r["taken"] <= 2 * r["size"] for r in found)
    sources, sizes, targets, taken = {r[0]: r[1] for r in rows}, {}, {}, {}
    for r in found:
        s = sources[r["doc_id"]]
        sizes[s], targets[s] = r["source_size"], r["target"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= 1 and targets[s] <= 2 * sizes[s] for s in sizes)
    key = lambda r: (r["doc_id"], r["size"])
    assert sorted(found, key=key) == sorted(mixed(spark, rows), key=key)
    assert all((r["slot"] is None and r["slot_again"] is None) == (r["taken"] == 0) for r in found)


def test_mix_of_odd_tables(spark):
    assert mixed(spark, []) == []
    assert [tuple(r) for r in mixed(spark, [(1, None, None, 1, ""), (2, "a", "\t ", 1, "")])] in ([(1, 0, 0, 0.0, 0, None, None), (2, 0, 0, 0.0, 0, None, None)], [(2, 0, 0, 0.0, 0, None, None), (1, 0, 0, 0.0, 0, None, None)])
    twins = mixed(spark, [(7, "a", "x y z", 1, "")] * 3 + [(None, "a", "x", 1, "")])
    assert len(twins) == 4 and sum(r["taken"] for r in twins) == 15  # the target, 1.5 * 10
    copies = mixing.mixed_documents(spark.createDataFrame([(i, "a" if i % 2 else "b", "w " * 50, i) for i in range(100)], "doc_id long, source string, text string, keep int"))
    assert copies.columns == ["doc_id", "source", "text", "keep"] and 145 <= copies.count() <= 155
    # sources take turns in the order of the slots: no stretch of a tenth has only one
    order = [r["source"] for r in copies.collect()]
    assert all({"a", "b"} == set(order[i : i + 15]) for i in range(0, 135, 15))


HTML = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">home</a></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &eacute;</h1></header><p>Some <i>it</i>alic text, x<p>Short<form><label>Name</label></form><pre>a
b</pre><div class="ad">Buy</div><p>end &amp;<div id="comments"><p>Nice post!</div></article><aside>side</aside></main><script>var a="<p>x</p>"</script><footer>f</footer></body>"""


LONG = "words of an article " * 12


@pytest.mark.parametrize(
    "page, text",
    [(f"<div><p>{LONG}<div class=ad>Buy</div><p>The end.</div>", LONG + "The end."),
     (f"<article><p><a href=/>Headline</a><p>{LONG}<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p><a href=s>Source</a></article>", f"Headline {LONG}One Two Source"),
     (f"<p><a href=/>Headline</a><p>{LONG}<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ul><p>End<p><a href=s>Source</a>", f"Headline {LONG}One Two Three Four End Source"),
     (f"<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><a href=1>A</a> | <a href=2>B</a></div><p>{LONG}<ul><li><a href=3>About</a></ul>", LONG),
     (f"<p><a name=x>{LONG}", LONG), (f"<p><a id=x/>{LONG}", LONG), (f"<ul><li><a href=x>Home</ul><ul><li>{LONG}<li>b</ul>", LONG + "b"),
     (f"<article>Teaser</article><div><p>{LONG}</div>", LONG), (f"<article>{LONG}</article><div><p>Teaser</div>", LONG)],
)
def test_the_whole_article_is_kept(page, text):
    assert html_text.main_text(page) == text.strip()


@pytest.mark.parametrize(
    "page, text",
    [(HTML, "Title é Some italic text, x Short a b end &"), ("<div><p>Hello world</p><p>b</p></div>", "Hello world b"), ("just text &amp; more <b", "just text & more"), ("", ""), (None, ""), ("<nav>only menu</nav>", ""),
     ("<p>a<a href='x>y</a></p>", "ay"), ("<!-- open comment <p>x", ""), ("<p>" + "long word " * 20000 + "</p>", ("long word " * 20000).strip()), ("<article><p>x</article>" * 1, "x")],
)
def test_main_text(spark, page, text):
    assert (html_text.main_text(page) if page else "") == text


_A = LONG.strip()


@pytest.mark.parametrize(
    "page, text",
    [(f"<div>Skip to content, friends</div><article><p>{LONG}</p></article>", _A), (f"<p>Intro note</p><main><p>{LONG}</p></main>", _A),
     (f"<body><div class='page has-sidebar'><h1>T</h1><p>{LONG}</p></div></body>", "T " + _A), (f"<body><div class='comments-open'><p>{LONG}</p></div></body>", _A),
     (f"<body><form id=aspnet><div><h1>T</h1><p>{LONG}</p></div></form></body>", "T " + _A), (f"<body><div class=sidebar><nav>n</nav><p>{LONG}</p></div><p>x</p></body>", _A),
     (f"<article><p title='a hidden gem'>{LONG}</p><p data-hidden='false'>x</p></article>", _A + " x"),
     (f"<article><div class='entry-header'>E</div><p class=follow-up>f</p><p class=share-price>s</p><p class=notice-period>n</p><p id='ad-1787'>a</p><p>{LONG}</p></article>", "E f s n a " + _A),
     (f"<main><article><p>{LONG}</p></article><article><p>{LONG}2</p></article></main>", f"{_A} {_A} 2"),
     (f"<body><div><a href=1>Home</a><a href=2>News</a></div><div>Buy now, cheap</div><div id=c><h1>T</h1><p>{LONG}</p><p>The end.</p></div><div>© 2024 Example</div></body>", f"T {_A} The end."),
     (f"<article><p>{LONG}</p><ul><li><a href=1>R1</a><li><a href=2>R2</a><li><a href=2>R3</a></ul><p><a href=3>one link</a></p></article>", _A + " R1 R2 R3 one link"),
     (f"<article><p>{LONG}</p><div class=comments><p>{LONG}</p><p>{LONG}</p></div></article>", _A), (f"<p>{LONG}<p>Short<p>© 2020 me", _A + " Short"),
     (f"<div><h1>Title</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div></div>", f"Title {_A} {_A}"), (f"<div hidden>x</div><p>{LONG}<span class=sr-only>no</span></p>", _A)],
)
def test_pages_of_other_templates(page, text):
    assert html_text.main_text(page) == text


def brute_dense(weights):
    """The dense lines by their definition, window by window."""
    letters = sorted(w for w in weights for _ in range(w))
    threshold = min(letters[len(letters) // 2] / 2, 80) if letters else 0
    out = set()
    for i in range(len(weights)):
        window = range(i, min(i + 3, len(weights)))
        if sum(weights[j] for j in window) > threshold:
            out |= {j for j in window if weights[j] and weights[j] >= threshold / 2}
    return sorted(out)


def test_dense_lines_are_those_of_the_definition():
    draw = random.Random(7)
    for _ in range(500):
        weights = [draw.choice((0, draw.randint(0, 9), draw.randint(0, 400))) for _ in range(draw.randint(0, 30))]
        assert html_text.dense_lines(weights) == brute_dense(weights)


ARTICLE = " ".join(["The council met on Monday to talk about the bridge, and nobody left early."] * 6)


@pytest.mark.parametrize(
    "before, after",
    [
        ("", '<div class="post-comments"><p>What a great piece of writing this is, thank you for it, says a reader at length.</p></div>'),
        ('<div class="cc-window cc_banner"><p>We use cookies to give you the best experience on this site, read on to learn more.</p></div>', ""),
        ("", '<div class="sponsored-content"><p>Buy the new mattress with its seven zones of comfort, now half of its usual price.</p></div>'),
        ("", '<div id="ft"><p>All of this was made in the city by people who like bridges and other things.</p></div>'),
        ('<div class="site_breadcrumbs_wrap">Home and News and Local and Bridges over rivers and roads</div>', '<section id="user_replies"><p>I was there too, and it was as dull as you would expect from them, I am afraid.</p></section>'),
    ],
)
def test_boilerplate_by_a_word_of_its_name(before, after):
    page = f"<html><body>{before}<div class='entry'><p>{ARTICLE}</p><p>{ARTICLE}</p></div>{after}</body></html>"
    assert html_text.main_text(page) == f"{ARTICLE} {ARTICLE}"
    inside = f"<html><body><article><p>{ARTICLE}</p>{before}<p>{ARTICLE}</p>{after}</article></body></html>"
    assert html_text.main_text(inside) == f"{ARTICLE} {ARTICLE}"


def test_a_wrapper_with_such_a_name_is_kept():
    page = f"<html><body><div class='content-sidebar-wrap has-comments'><div><p>{ARTICLE}</p></div><div class='post-footer'><p>Filed under bridges, by the staff of this paper.</p></div></div></body></html>"
    assert html_text.main_text(page) == ARTICLE


def test_articles_come_back_from_pages_put_together():
    draw = random.Random(9)
    sentence = lambda n: " ".join(draw.choices(["rain", "falls", "é", "on", "plains", "&lt;b&gt;"], k=n))
    for _ in range(200):
        lines = [sentence(draw.randint(2, 8)), *(sentence(draw.randint(20, 90)) for _ in range(draw.randint(2, 9))), sentence(3)]
        inner = f"<h1>{lines[0]}</h1>" + "".join(draw.choice((f"<p>{x}</p>", f"<p>{x}", f"<div class=text>{x}</div>", f"<p><b>{x}</b></p>\n")) + draw.choice(("", "<script>p('<p>')</script>", "<div class=ad>buy</div>", "<!-- <p> -->")) for x in lines[1:-1]) + f"<p>{lines[-1]}</p>"
        menu = "".join(f"<li><a href='/{i}'>{sentence(1)}</a>" for i in range(draw.randint(2, 9)))
        before = draw.choice((f"<nav><ul>{menu}</ul></nav>", f"<ul>{menu}</ul>", f"<header>{sentence(5)}</header>", f"<div class='cookie-notice'>{sentence(40)}</div>", ""))
        after = draw.choice((f"<footer>{sentence(6)}</footer>", f"<aside>{sentence(30)}</aside>", f"<div id=comments><p>{sentence(60)}</p></div>", f"<ul>{menu}</ul>", ""))
        tag = draw.choice(("article", "main", "div", "section"))
        assert html_text.main_text(f"<html><body>{before}<{tag}>{inner}</{tag}>{after}</body></html>") == " ".join(lines).replace("&lt;", "<").replace("&gt;", ">")


@pytest.mark.parametrize("broken", ["<i>" * 8000 + "x</b>" * 8000, "<b><div>" * 8000 + "x</b>" * 8000, "<span class=ad>" * 8000 + "<div><b class=ad></span>" * 8000, "<blockquote>x" * 16000, "<li>x<ul>" * 16000, "<p a='" * 50000])
def test_broken_markup_takes_linear_time(broken):
    began = time.process_time()
    html_text.main_text(broken)
    assert time.process_time() - began < 3


def test_extraction_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", HTML, "h", 1), (1, "u", HTML, "h", 1), (None, None, None, None, None)], PAGES)
    found = html_text.extract_text(pages).collect()
    assert sorted(r["n_chars"] for r in found) == [0, len("Title é Some italic text, x Short a b end &"), len("Title é Some italic text, x Short a b end &")]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def brute_nearest(rows, every, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in rows:
        if q % every == 0:
            scored = sorted((-math.fsum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [50, 10_000])
def test_nearest_is_exact_at_factor_one(spark, shard_rows):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(600, 6)).astype(np.float32)
    vectors[100:300] = vectors[7]  # one very common vector
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1001, [0.0] * 6, 0), (1002, [float("nan")] * 6, 0), (1020, [None] * 6, 0), (1040, [1.0, 2.0], 0), (1041, [2.0, 2.0], 0), (None, [1.0] * 6, 0), rows[20]]
    found = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), relax=1.0, shard_rows=shard_rows).collect()
    assert sorted(map(tuple, found)) == brute_nearest([r[:2] for r in rows], 20, 20)


def test_nearest_recall_of_the_query(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(2000, 32)).astype(np.float32))]
    found = {tuple(r)[:3:2] for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=500).collect()}
    wanted = {r[:3:2] for r in brute_nearest(rows, 20, 20)}
    assert len(found & wanted) >= 0.9 * len(wanted)
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_slots_of_a_mix_are_not_broadcast(spark):
    rows = [(i, f"s{i % 3}", "w " * 300) for i in range(60)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert mixed.count() == 60 and mixed.agg(F.max("slot")).first()[0] > 10_000
    mixed.collect()
    sent = []

    def walk(plan):
        if plan.nodeName() == "BroadcastExchange":
            sent.append(plan.metrics().get("numOutputRows").get().value())
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        below += [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        for p in below:
            walk(p)

    walk(mixed._jdf.queryExecution().executedPlan())
    assert max(sent, default=0) < 1_000
