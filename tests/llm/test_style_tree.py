"""Style trees on copies, telling names and boilerplate within articles."""

import random
import time

import pytest

from quillspark.llm import style_tree

from .test_operators import prose


def texts(spark, pages):
    df = spark.createDataFrame([(i, "http://s.com/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in style_tree.main_texts(df).orderBy("page_id").collect()]


def test_copies_of_a_page_count_once(spark):
    page = "<body><div class=c1><p>One story</p></div><div class=c2><p>told twice</p></div></body>"
    assert texts(spark, [page]) == ["One story\ntold twice"]
    assert texts(spark, [page] * 4) == ["One story\ntold twice"] * 4


def test_names_are_weak_and_whole():
    story = prose(random.Random(5), 60)

    def blocks(page):
        return style_tree.main_blocks(page, {})

    for wrap in ("class=with-sidebar", "id=page-header-fixed", "class=sidebar", "class=ads", "role=banner"):
        assert blocks(f"<div {wrap}><article><p>{story}</p></article></div>") == [story]
    for head in ("article-header", "header"):
        assert blocks(f"<article><div class={head}><h1>Title</h1></div><p>{story}</p></article>") == ["Title", story]
    for name in ("related", "notice", "side", "share", "social", "search", "alert"):
        assert blocks(f"<article><p>Begin</p><section class={name}><p>{story}</p></section></article>") == ["Begin", story]
        assert blocks(f"<article><p>Begin</p><div class={name}>Share this</div></article>") == ["Begin"]
    assert blocks(f"<article><p>{story}</p><div class=ad>{story}</div></article>") == [story]


def test_tree_decides_within_articles(spark):
    rng = random.Random(6)
    page = "<body><article><h1>{}</h1><p>{}</p><div class=x7>Our house rules apply to all stories</div></article></body>"
    told = [(prose(rng, 4), prose(rng, 30)) for _ in range(12)]
    assert texts(spark, [page.format(*t) for t in told]) == ["\n".join(t) for t in told]
    few = [page.format(*t) for t in told[:3]]  # too little is known
    assert all(t.endswith("all stories") for t in texts(spark, few))
    same = "<body><div>{}</div><article><p>The one story</p></article></body>"  # nothing would be left
    assert texts(spark, [same.format(i) for i in range(9)]) == ["The one story"] * 9


def test_large_hosts_give_the_same_texts(spark):
    """Importances joined to pages by their own nodes, instead of in a row per host."""
    rng = random.Random(8)
    menu = "<div class=m><p>Home</p><p>Contact</p></div>"
    pages = [f"<body>{menu if i % 4 else ''}<div id=s{i % 3}><p>{prose(rng, 30)}</p><p>{prose(rng, 12)}</p></div><div class=f>All rights reserved</div></body>" for i in range(30)]
    rows = [(i, f"http://h{i % 2}.com/{i}", h) for i, h in enumerate(pages + pages[:3] + [None, ""])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted((r.page_id, r.text) for r in style_tree.main_texts(df, n).collect()) for n in (500, 4, 0)]
    assert got[0] == got[1] == got[2]
    assert len(got[0]) == 35 and not any("All rights" in t or "Contact" in t for _, t in got[0])


def plain_importances(pages):
    """(node, importance) of one host, by the formulas over whole pages."""
    import math
    from collections import Counter

    shown, told = {}, {}
    for page in set(pages):
        for path, kind, value in style_tree.page_features(page):
            (shown if kind == "p" else told).setdefault(path, Counter())[value] += 1
    out = {}
    for path, kinds in shown.items():
        m = sum(kinds.values())
        if m > 1 and path in told:
            out[path] = 1 - sum(math.log(c, m) for c in told[path].values()) / len(told[path])
        elif m > 1:
            out[path] = max(0.0, -sum(c / m * math.log(c / m, m) for c in kinds.values()))
    return {k: v for k, v in out.items() if v < 0.999}


def test_tree_equals_a_plain_one_and_decides(spark):
    """Without landmarks or telling names the tree alone finds the article: menus and notes that a site repeats go."""
    rng = random.Random(9)
    notes = [prose(rng, 9) for _ in range(2)]
    told = [[prose(rng, 5), prose(rng, 40), prose(rng, 25)] for _ in range(24)]
    pages = [f"<body><div class=a1><ul><li>Start</li><li>Archive</li></ul></div><div class=a2><h1>{t[0]}</h1><p>{t[1]}</p><p>{t[2]}</p></div><div class=a3>{notes[i % 2]}</div></body>" for i, t in enumerate(told)]
    df = spark.createDataFrame([("s.com", p) for p in pages + pages[:2]], "host string, html string")
    got = {r.node: r.importance for r in style_tree.node_importances(df).collect()}
    want = plain_importances(pages)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert texts(spark, pages) == ["\n".join(t) for t in told]
    assert all("Archive" in "\n".join(style_tree.main_blocks(p, {})) for p in pages)  # taking the tree out changes results


def test_any_column_name(spark):
    """Columns that are named like inner ones come through as they are; a column named text is replaced."""
    names = "row host nodes many _host _nodes _many node importance spans kept score predicted a.b".split()
    pages = spark.createDataFrame([(1, "http://s.com/", "<p>One</p>", *names, "old"), (2, None, None, *names, None)], "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in names) + ", text string")
    got = sorted(style_tree.main_texts(pages).collect())
    assert [tuple(r) for r in got] == [(1, "http://s.com/", "<p>One</p>", *names, "One"), (2, None, None, *names, "")]
    assert [r.text for r in style_tree.page_digest(pages).orderBy("page_id").collect()] == ["One", ""]


def test_broken_pages_take_time_in_proportion():
    """Quotes and elements that don't end, many times over: what follows is still text."""
    many = 20_000
    for bad in ("<p title='x>a", '<p title="x>a', "<button>b", "<svg>c", "</b <i ", "<!x", "<p it's>d"):
        began = time.process_time()
        blocks = style_tree.main_blocks(bad * many + "<p>end", {})
        assert time.process_time() - began < 5, bad
        assert blocks or bad in ("</b <i ", "<!x"), bad
    assert style_tree.main_blocks('<p>one</p><p title="x>two</p>', {}) == ["one", "two"]
    assert style_tree.main_blocks("<p it's>one</p><p>it's two</p>", {}) == ["one", "it's two"]


@pytest.mark.parametrize(
    "page, blocks",
    [
        ('<article><div data-note="it is hidden now"><p>Text a</p></div></article>', ["Text a"]),
        ('<article><div title="see id=nav class=ad here" alt=\'role="form"\'><p>Text b</p></div></article>', ["Text b"]),
        ("<article><p>Kept</p><div hidden><p>no</p></div><div data-x=1 class='ad'><p>no</p></div></article>", ["Kept"]),
        ("<body><form action=/x><input name=state><h1>Head</h1><p>" + "word " * 40 + "</p></form></body>", ["Head", " ".join(["word"] * 40)]),
        ("<p>" + "word " * 40 + "</p><form><p>Your name</p></form>", [" ".join(["word"] * 40)]),
    ],
)
def test_attributes_by_name_and_forms_by_what_they_hold(page, blocks):
    assert style_tree.main_blocks(page, {}) == blocks
