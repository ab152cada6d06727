import random
import time
from html import escape

import pytest

from reviewmine.llm import html_text as h

CASES = {
    "<p>a  b\n<p>c &amp; d</p>": "a b\nc & d",
    "<body><nav>menu</nav><article><h1>T</h1><p>x<br>y</p></article><footer>f</footer>": "T\nx y",
    "<article><p>one<script>var a='</p>';</script> two<!-- no --></p><form><label>f</label></form></article><aside>s</aside>": "one two",
    "<div class='site-header'>h</div><p>text</p><div id=comments><p>reader</p></div>": "text",
    "<body class='has-sidebar'><p>text</p><div class='SideBar sidebar-left'>s</div></body>": "text",
    "<article><header><h1>T</h1></header><div class='cookie-notice'>c</div><p>a < b &lt; c</p></article>": "T\na < b < c",
    "<main><p>m</p><section class=comments><article class=comment>c</article></section></main>": "m",
    "<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>": "a\nb\n1\n2\n3",
    "<p>no <b>end <i>tags": "no end tags",
    "<div style='display: none'>x</div><p hidden>y</p><p>z &#233;&nbsp;&copy;</p>": "z é ©",
    "<nav><ul><li>x<article><p>a</p></article>": "a",
    "plain text": "plain text",
    "<a title='>'>link</a> end": "link end",
    "<p>x</p></div></p>y": "x\ny",
    "<p>a<span hidden>x</span>b <button>k</button> c</p>": "ab c",
    "<article><p class='share-price'>12</p><p class=related-work>w</p><ul class=menu><li>soup</ul></article>": "12\nw\nsoup",
    "<main><div id='search-results'>found</div><div class='comment-list'>c</div></main>": "found",
    "&#99999999999;&#0000000065;&#x0041;": "\ufffdAA",
    "<b ' >x</b>y": "xy",
}


@pytest.mark.parametrize("html", CASES)
def test_blocks(html):
    assert "\n".join(h.Page(html).read()[0]) == CASES[html]


def test_what_a_site_repeats_goes(spark):
    share = "<div><p>Read more on our site</p></div>"
    pages = [(i, f"https://A.example.org/{i}", f"<body><div><p>Story {i}</p></div>{share}</body>", 1) for i in range(20)]
    pages += [(100 + i, f"https://b.example.org:80/{i}", f"<p>Other {i}</p>{share}", 1) for i in range(2)]
    # copies of one page are no template of each other, nor is a paragraph of an article
    pages += [(200 + i, "https://c.example.org/x", "<div><p>Copied story</p></div>", 1) for i in range(30)]
    pages += [(300 + i, "https://d.example.org/", f"<article><p>Same words</p><p>{i}</p></article>", 1) for i in range(20)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, host int")
    got = {r.page_id: r.text for r in h.main_text(df).select("row.page_id", "text").collect()}
    assert got == {
        **{i: f"Story {i}" for i in range(20)},
        **{100 + i: f"Other {i}\nRead more on our site" for i in range(2)},
        **{200 + i: "Copied story" for i in range(30)},
        **{300 + i: f"Same words\n{i}" for i in range(20)},
    }


def render(tree) -> str:
    if isinstance(tree, str):
        return tree
    tag, *inside = tree
    return f"<{tag}>{''.join(map(render, inside))}</{tag}>"


def test_recurring_subtrees_by_brute_force(spark):
    """Random trees of few words; every subtree is looked for in all pages of its host."""
    rng = random.Random(5)

    def tree(depth):
        if depth == 0:
            return ("p", rng.choice("abcdefghij") + " " + rng.choice("klmnopqr"))
        return (rng.choice(["div", "section", "ul"]), *(tree(depth - 1) for _ in range(rng.randint(1, 3))))

    pages = [(i, f"http://h{i % 3}/", [tree(rng.randint(0, 3)) for _ in range(4)]) for i in range(120)]

    def subtrees(one):
        return {one}.union(*(subtrees(t) for t in one[1:] if not isinstance(t, str)))

    def texts(one, gone):
        if isinstance(one, str):
            return [one]
        return [] if one in gone else [text for part in one[1:] for text in texts(part, gone)]

    want, changed = {}, 0
    for i, host, trees in pages:
        known = {}
        for _, other, theirs in pages:
            if other == host:
                content = tuple(text for t in theirs for text in texts(t, ()))
                for one in set().union(*map(subtrees, theirs)):
                    known.setdefault(one, set()).add(content)
        gone = {one for one, on in known.items() if len(on) >= 4}
        want[i] = "\n".join(text for t in trees for text in texts(t, gone))
        changed += want[i] != "\n".join(text for t in trees for text in texts(t, ()))
    rows = [(i, host, "".join(map(render, trees))) for i, host, trees in pages]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    for rules in (True, False):
        found = h.main_text(df, min_pages=4, rules=rules).select("row.page_id", "text").collect()
        assert {r.page_id: r.text for r in found} == want
    assert 60 < changed and any(want.values())


def test_the_count_alone_finds_parts_of_the_given_sites(spark):
    """Menus, adverts and footers that three pages of a host share go without any rule; articles stay whole."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    plain = {r.page_id: r.text for r in h.main_text(pages, min_pages=10**9, rules=False).select("row.page_id", "text").collect()}
    counted = {r.page_id: r.text for r in h.main_text(pages, rules=False).select("row.page_id", "text").collect()}
    ruled = {r.page_id: r.text for r in h.main_text(pages).select("row.page_id", "text").collect()}
    changed = sum(plain[i] != counted[i] for i in plain)
    assert changed > 0.5 * len(plain), changed
    assert sum(len(t) for t in ruled.values()) <= sum(len(t) for t in counted.values()) < sum(len(t) for t in plain.values())


LONG = {
    "open tags": "<a " * 350_000,
    "nested": "<div>a" * 170_000,
    "ends": "<div>" * 100_000 + "</p></li>" * 50_000,
    "items": "<li><ul>" + "<div>" * 60_000 + "<li></li>" * 60_000,
    "quotes": "<a \"'>x" * 150_000 + '<b "',
    "comments": "<!-- " * 200_000,
    "hidden": "<span hidden>" * 70_000 + "<p>x</p>" * 10_000,
}


@pytest.mark.parametrize("name", LONG)
def test_a_long_broken_page_takes_seconds(name):
    start = time.process_time()
    h.Page(LONG[name]).read()
    assert time.process_time() - start < 10


def test_runs_that_are_left():
    for trial in range(200):
        rng = random.Random(trial)
        total = rng.randint(0, 12)
        cuts = [sorted(rng.sample(range(total + 1), 2)) for _ in range(rng.randint(0, 4)) if total]
        runs = h._left([a for a, _ in cuts], [b for _, b in cuts], total)
        left = [i for run in runs for i in range(run["start"] - 1, run["start"] - 1 + run["length"])]
        assert left == [i for i in range(total) if not any(a <= i < b for a, b in cuts)]


def test_articles_of_the_given_pages(spark):
    """The pages' articles hold a heading and paragraphs, told apart here by plain splitting."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = h.main_text(pages).select("row.html", "text").collect()
    assert len(rows) == pages.count()
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", article))
        assert row.text == "\n".join(part for part in parts if part)


def test_messy_rows(spark):
    long = "<p>" + escape("word & ") * 100_000
    rows = [(1, None, None), (1, "no url", ""), (None, "http://x/", "<<<>&;<p"), (2, "http://x/", long), (2, "http://x/", long), (3, "http://x/", "<div>" * 5000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as out", "3 as row")
    got = [(r.page_id, len(r.text)) for r in h.main_text(df).select("row.page_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (None, len("<<<>&;<p")), (2, 699_999), (2, 699_999), (3, 4)], key=str)
    assert h.main_text(df.limit(0)).count() == 0
