"""Main texts: made-up pages, pages in disguise, and messages against all labellings."""

import html as html_module
import itertools
import re

import numpy as np
import pytest

from credsift.llm import html_content as hc
from credsift.llm import page_tree
from credsift.llm.common import table

LONG = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt. "
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip."
)

PAGES = {
    "frames": (
        f"<body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><main><article><h1>Title"
        f"</h1><p>{LONG}</p><aside class=related><p>{LONG}</p></aside><p>tail &amp; end</p></article>"
        f"<section id='comments'><h2>Comments</h2><div class='comment'><p>{LONG}</p></div></section>"
        f"</main><aside class='sidebar'><p>{LONG}</p></aside><footer>f</footer>",
        f"Title {LONG} tail & end",
    ),
    "names": (
        f"<div id=header>My Site</div><div class='main-menu'><ul><li><a href=a>A</a><li><a href=b>B"
        f"</a></ul></div><div id=content class='no-sidebar'><h2>Head</h2><p>{LONG}<p>Second {LONG}"
        f"<div class='adBox'>Buy now, really cheap things for everyone.</div><table><tr><td>cell one"
        f"<td>cell two</table></div><div class='cookie-notice'>We use cookies.</div>"
        f"<div id=footer>c 2020</div>",
        f"Head {LONG} Second {LONG} cell one cell two",
    ),
    "looks": (
        f"<div><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><p>{LONG}</p>"
        f"<p>{LONG}</p><p>{LONG}</p></div><div>Copyright</div></div>",
        f"{LONG} {LONG} {LONG}",
    ),
    "inline": (
        "<article><h1>T</h1><p>a<b>b</b>c <i>d</i>\n\t e<br>f</p><form><label>Name</label><input>"
        "<button>Go</button></form><p>x<span class='ad'>AD</span>&nbsp;q&lt;&am</p>"
        "<noscript>NO</noscript><textarea>t</textarea><!-- no --><script>var t='</p>';</script>"
        "<style>p{}</style><ul><li>one<li>two <a href=q>link</a> end</ul><pre>u\n  v</pre></article>",
        "T abc d e f x q<&am one two link end u v",
    ),
    "broken": ("<article><p>a < b and <3 c<p>d<script>if (a<b) '</p>'", "a < b and <3 c d"),
    "unended tag": ("<article><p>text</p><a href='x", "text"),
    "hidden": (f"<article><p>{LONG}</p><p style='display: none'>h</p><p hidden>h</p></article>", LONG),
    "empty": ("", ""),
    "null": (None, ""),
    "nothing": ("<nav><a href=a>A</a></nav>", ""),
}


@pytest.fixture(scope="module")
def model(spark):
    return hc.train(table(spark, "/root/testdata/sf0.01", "pages"))


def marked_text(html):
    inside = re.search(r"(?s)<article>(.*)</article>", html)[1]
    inside = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))
    return " ".join(html_module.unescape(inside).split())


@pytest.mark.parametrize("name", PAGES)
def test_made_up_pages(model, name):
    html, want = PAGES[name]
    assert hc.extract([html], model) == [want]


def test_pages_of_one_batch_do_not_mix(model):
    got = hc.extract([html for html, _ in PAGES.values()], model)
    assert got == [want for _, want in PAGES.values()]


def test_held_out_pages_in_disguise(spark, model):
    """Pages that taught nothing, without the tags and names that tell their parts."""
    rows = table(spark, "/root/testdata/sf0.1", "pages").filter("page_id >= 2000").collect()
    plain = [r.html for r in rows]
    hidden = [
        re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", h).replace(' class="ad"', "") for h in plain
    ]
    want = [marked_text(h) for h in plain]
    assert hc.extract(plain, model) == want
    right = sum(a == b for a, b in zip(hc.extract(hidden, model), want, strict=True))
    assert right >= 0.98 * len(rows)


def test_messages_give_the_exact_marginals(model):
    """Against the sum over all labellings of small trees."""
    for html in ("<div><p>Some words.</p><a href=x>y</a></div><p>z", "<nav>n</nav><article>t<p>u",
                 "<header><h1>a</h1></header><form>b</form>"):
        trees = hc.Trees([html])
        n = len(trees.kind)
        score = sum(t[v] for t, v in zip(model.node, trees.features(trees.kind), strict=True))
        weight, content = 0.0, np.zeros(n)
        for labels in itertools.product(range(3), repeat=n - 1):
            labels = (hc.NEUTRAL, *labels)
            total = sum(score[i, labels[i]] for i in range(n))
            total += sum(
                model.edge[trees.kind[i], labels[trees.parent[i]], labels[i]] for i in range(1, n)
            )
            weight += np.exp(total)
            content += np.exp(total) * (np.array(labels) == hc.CONTENT)
        np.testing.assert_allclose(model.marginals(trees), content / weight, atol=1e-9)


def test_deep_and_long_pages_end(model):
    deep = "<div>" * 30_000 + "x" + "</p>" * 1000
    long = f"<article>{'<p>' + LONG + '<b>' * 5:}" + "<b>" * 20_000 + "</i>" * 20_000 + "<a <" * 5000
    ads = "<article>" + "<p class='a b" + " c" * 50_000 + "'>t"
    assert hc.extract([deep, long, ads], model)[1:] == [LONG, "t"]


def test_rows_nulls_and_other_columns(spark):
    rows = [(1, "u", PAGES["frames"][0], 7), (1, "u", PAGES["frames"][0], 8), (None, None, None, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = hc.pages_digest(df).collect()
    want = PAGES["frames"][1]
    assert [tuple(r) for r in got] == [(1, "u", want, len(want))] * 2 + [(None, None, "", 0)]
    assert hc.pages_digest(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "tag, attributes, kind",
    [
        ("div", "", None), ("nav", "", "menu"), ("div", 'class="main-menu"', "menu"),
        ("div", "id=sideBar", None), ("div", "id=sidebar", "side"),
        ("div", "class='content no-sidebar'", "main"), ("div", "role=banner", "header"),
        ("article", "class='post comments-open'", "article"),
        ("article", "class=comment", "comment"), ("span", "class=content", None),
        ("span", "class='ad'", "advert"), ("body", "class=menu", None), ("p", "hidden", "notice"),
        ("div", "data-class='menu'", None),
    ],
)
def test_kinds(tag, attributes, kind):
    assert page_tree.name_kind(tag, " " + attributes) == (None if kind is None else
                                                          page_tree.KIND[kind])
