from __future__ import annotations

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import html_extract as he
from quernstone.llm.queries import op10_html_extraction

PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>More</a></ul></nav><article class=story><h1>Title &amp; so</h1><p>First, one.<p>Second <b>two</b>.</article><script>x='</p>'</script><footer>Imprint</footer></body></html>"


def test_parser_tolerates_what_there_is():
    nodes = he.parse(PAGE)
    assert [n.tag for n in nodes].count("p") == 2 and [n.tag for n in nodes].count("li") == 2
    for text in ("", "plain", "<", "<p", "</p>", "<p><p></div></p>", "<!-- open", "<a b='c>d'>e</a>", "<script>never ends", "<br/><br>", "\x00<x:y z>"):
        nodes = he.parse(text)
        assert nodes[0].tag == "#root" and all(n.parent < k for k, n in enumerate(nodes))
        he.extract(text, None)
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert he.extract(deep, None) == "x"


def test_parsing_takes_time_in_proportion():
    for piece in ("<a ", '<a "', "<a<b ' ", "<!x", "<script></script ", '</p "', "<div>", "<p><td><h1>", "<a x='\"' ", "<b></i>"):
        for end in ("", ">", '">', "'>"):
            began = time.perf_counter()
            he.parse(piece * 100_000 + end)
            assert time.perf_counter() - began < 10, (piece, end)
    began = time.perf_counter()
    he.extract("<a " * 400_000, None)
    assert time.perf_counter() - began < 4


class Tree(HTMLParser):
    """Another parser's elements: (tag, number of the parent), and all its text outside of silent elements."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.words = [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in he._ENDS.get(tag, ()):
                del self.open[k:]
                break
            if self.open[k] in he._STOP:
                break
        self.found.append((tag, len(self.open)))
        if tag not in he._VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        if not set(self.open) & he._SILENT:
            self.words += re.findall(r"\w+", data)


def test_same_elements_and_words_as_another_parser(table):
    pages = [r.html for r in table("pages").collect() if r.html]
    assert len(pages) > 100
    for page in pages:
        other = Tree(page)
        nodes = he.parse(page)
        assert [(n.tag, n.depth - 1) for n in nodes[1:]] == other.found
        assert re.findall(r"\w+", he._text(nodes, [0])) == other.words


def test_all_hints_are_features():
    x, _, _ = he.features(he.parse("<div class=content><p id=nav>x</p></div><div>y</div>"))
    assert x.shape[1] == he.N_FEATURES == 25
    assert x[1, -1] == 1 and x[2, -1] == 1 and x[2, -6] == 1 and x[3, -7:].sum() == 0


def test_without_trees_all_text_of_the_body():
    assert he.extract(PAGE, None).split("\n") == ["Home", "More", "Title & so", "First, one.", "Second two.", "Imprint"]


def test_decoding_is_best_and_without_contradictions():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 9)
        nodes = [he.Node("#root", -1, 0)] + [he.Node("div", rng.randrange(k), 1) for k in range(1, n)]
        gain = np.array([rng.choice((-2.0, -1.0, 0.5, 1.0, 3.0)) for _ in nodes])

        def within(a, b, nodes=nodes):
            while b >= 0:
                b = nodes[b].parent
                if b == a:
                    return True
            return False

        best = max(sum(gain[list(c)]) for r in range(n + 1) for c in combinations(range(n), r) if not any(within(a, b) or within(b, a) for a, b in combinations(c, 2)))
        chosen = he.decode(nodes, gain)
        assert not any(within(a, b) or within(b, a) for a, b in combinations(chosen, 2))
        assert abs(gain[chosen].sum() - best) < 1e-9


def test_trees_fit():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(int)
    trees = he.Boosted.fit(x, y, np.ones(len(y)))
    assert ((trees.margin(x) > 0) == y).mean() > 0.95


def _words(text):
    return Counter(re.findall(r"\w+", text or ""))


def test_held_out_pages(table):
    """Against the text of the article or main element, on pages that the trees weren't fitted on."""
    pages = table("pages", "0.1")
    held = F.xxhash64(F.lit(3), "page_id") % 4 == 0
    trees = he.fit(pages.filter(~held))
    got = {r.page_id: r.text for r in he.main_texts(pages.filter(held), trees).collect()}
    same = other = missing = 0
    for r in pages.filter(held).collect():
        nodes = he.parse(r.html or "")
        content = [k for k, v in enumerate(nodes) if v.tag in ("article", "main")]
        if content:
            a, b = _words(got[r.page_id]), _words(he._text(nodes, content[:1]))
            same, other, missing = same + (a & b).total(), other + (a - b).total(), missing + (b - a).total()
    assert same and 2 * same / (2 * same + other + missing) >= 0.95


def test_query(spark, table):
    got = op10_html_extraction(spark, "/root/testdata/sf0.01")
    pages = {r.page_id: r.html for r in table("pages").collect()}
    trees = he.fit(table("pages"))
    rows = got.collect()
    assert len(rows) == len(pages) and all(r.text == he.extract(pages[r.page_id], trees) for r in rows)


def test_odd_rows(spark):
    long = "<html><body><article>" + "<p>words and words, again.</p>" * 20_000 + "</article></body></html>"
    rows = [(1, PAGE), (1, PAGE), (None, PAGE), (2, None), (3, ""), (4, "no markup"), (5, "<<<>>>"), (6, long)]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, html string, text string, page string")
    got = [tuple(r) for r in he.main_texts(pages, he.fit(pages)).collect()]
    assert Counter(k for k, _ in got) == Counter(k for k, _ in rows)
    by = dict(got)
    assert by[2] is None and by[3] == "" and by[6].count("words and words") == 20_000
    assert he.main_texts(pages.limit(0), he.fit(pages.limit(0))).count() == 0
    plain = [tuple(r) for r in he.main_texts(pages.filter("page_id = 4"), None).collect()]
    assert plain == [(4, "no markup")]


def test_sample_is_of_pages_that_say_where_their_content_is(spark):
    plain = PAGE.replace("article", "div")
    hidden = plain.replace("x='</p>'", "x='<article>'").replace("<nav>", "<!-- <main> --><nav>")
    rows = [(n, PAGE if n in (777, 1234) else hidden if n % 2 else plain) for n in range(2000)]
    for _, page in rows[:2] + [rows[777]]:
        assert he.says(page) == (he.labels_of(he.parse(page)) is not None)
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert he.fit(pages, max_pages=4) is not None
    assert he.fit(pages.filter("page_id not in (777, 1234)"), max_pages=4) is None
