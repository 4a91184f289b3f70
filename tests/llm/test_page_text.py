import random
from html.parser import HTMLParser

import pytest

from threadwise.llm import page_text


def text(source):
    return "\n".join(block for block, _ in page_text.Page(source).main_blocks())


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("<p>a &amp b &am c &eacute;&#233;&nbsp;&copy; x</p>", "a & b &am c éé © x"),
        ("<article><p><b>one<br><p>two \n\t three</article>tail", "one\ntwo three"),
        ("<article><p>a<!-- <p>no --> b</p></article>", "a b"),
        ("<article><script>if (a<b) '</p>'</script><p>x</p><style>p{}</style></article>", "x"),
        ("<main><h1>T</h1><ul><li>a<li>b</ul></main><p>out</p>", "T\na\nb"),
        ("<article><p>x</p><div class='ad'>buy</div><aside>s</aside><p>y</p></article>", "x\ny"),
        ("<article><p>x</p><section id=comments><p>nice</p></section></article>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>", "T\nx"),
        ("<form><nav><a>m</a><article><p>x</p></article></form>", "x"),
        ("<body class='sidebar-left'><p>x</p><div id='cookie-notice'>c</div></body>", "x"),
        ("<div hidden><p>h</p></div><div style='display: none'>n</div><p>x</p>", "x"),
        ("<div role='navigation'>n</div><div><p>x</p></div>", "x"),
        ("<article><p>long enough text here</p></article><article><p>t</p></article>",
         "long enough text here\nt"),
        ("<article><div><p>x</div></div><p>y</article><footer>f</footer>", "x\ny"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article><p>1 < 2 and <b>3</b>4</p><p title=\"a>b\">5</p></article>", "1 < 2 and 34\n5"),
        ("plain <unclosed", "plain"),
        ("<article><p>cut <b", "cut"),
    ],
)
def test_structure(source, want):
    assert text(source) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("<div class='layout has-sidebar'><p>x</p></div>", "x"),
        ("<div class='page no-sidebar'><p>x</p></div>", "x"),
        ("<div class='wrap nav-open'><article><p>x</p></article></div>", "x"),
        ("<div class='page-with-menu'><main><p>x</p></main></div>", "x"),
        ("<div class='sidebar-right'><i>m</i><main><p>x</p></main>y</div>", "x"),
        ("<section id='nav'><div>m</div><article><p>x</p></article></section>", "x"),
        ("<main><div class='sidebar-left'><b>m</b><article>x</article></div></main>", "x"),
        ("<article class='post comments-open'><p>x</p></article>", "x"),
        ("<main class='has-comments'><p>x</p></main>", "x"),
        # What the class names is left out as before.
        ("<article class='comment-body'><p>c</p></article><p>x</p>", "x"),
        ("<p>x</p><div id=comments><article><p>c</p></article></div>", "x"),
        ("<article><p>x</p></article><div class='sidebar'><article>teaser</article></div>", "x"),
        ("<main><p>x</p></main><div class='sidebar'><article>teaser</article></div>", "x"),
        ("<article><p>x</p><div class='menu'><article>other</article></div></article>", "x"),
        ("<p>x</p><div class='sidebar'><p>s</p></div><div class='nav-bar'>n</div>", "x"),
    ],
)
def test_classes_of_wrappers(source, want):
    assert text(source) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><h2 id='search'>Search</h2><p id='alerts'>a</p></article>", "Search\na"),
        ("<article><h2 id='related-work'>Related</h2><p class='notice'>x</p></article>", "Related\nx"),
        ("<article><section id='notification-settings'><p>x</p></section></article>", "x"),
        ("<article><div class='social-policy'><p>x</p></div></article>", "x"),
        ("<article><p>x</p><div class='share-buttons'>s</div><ul class='ads'><li>a</ul></article>", "x"),
        ("<article><p>x</p><div class='hidden'>s</div><div id='respond'>r</div></article>", "x"),
        ("<div class='entry-header'><h1>Title</h1></div><p>x</p>", "Title\nx"),
        ("<div class='site-header'>Brand</div><p>x</p>", "x"),
        ("<div class='banner'><h1>Title</h1><i>Brand</i></div><p>x</p>", "Title\nx"),
    ],
)
def test_names_inside_an_article(source, want):
    assert text(source) == want


@pytest.mark.parametrize(
    "source, want",
    [
        # Parts of one article, a teaser beside an article, and a page of nothing but teasers.
        ("<article><h1>T</h1><p>long</p></article><article><h2>Next</h2><p>s</p></article>",
         "T\nlong\nNext\ns"),
        ("<article><h1>T</h1><p>x</p></article><article><h3><a href='/o'>O</a></h3><p>e</p></article>",
         "T\nx"),
        ("<main><article><p>x</p></article><article><h3><a href='/o'>O</a></h3></article></main>", "x"),
        ("<article><h2><a href='/a'>A</a></h2>a</article><article><h2><a href='/b'>B</a></h2>b</article>",
         "A\na\nB\nb"),
        ("<article><h1>Read <a href='/o'>this</a></h1>x</article><article>y</article>", "Read this\nx\ny"),
    ],
)
def test_teasers(source, want):
    assert text(source) == want


@pytest.mark.parametrize(
    "source",
    [
        "".join(f"<div>word{i} " for i in range(36_000)),
        "<span>" * 60_000 + "<hr>" * 60_000,
        "<p><table>" + "<b>" * 60_000 + "<hr>" * 60_000,
        "<i><table>" + "<b>" * 60_000 + "</i>" * 60_000,
        "<nav><div>" + "<article>" * 30_000 + "x",
        "<ul>" + "<li><ul>" * 20_000 + "x",
    ],
)
def test_work_grows_with_the_page_only(source):
    """Half a megabyte of nested blocks, with text and without."""
    import time
    import tracemalloc

    start = time.process_time()
    found = page_text.Page(source).found()
    assert time.process_time() - start < 8
    tracemalloc.start()
    page_text.Page(source).found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000 and len(found["hashes"]) == len(found["parents"]) <= 60_000


class Plain(HTMLParser):
    """The text of well-formed pages without classes: what is in the article and in no dropped element."""

    def __init__(self):
        super().__init__()
        self.stack, self.lines, self.now = [], [], []

    def flush(self):
        line = " ".join("".join(self.now).split())
        self.lines += [line] if line else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in page_text.BLOCKS:
            self.flush()
        if tag not in page_text.VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in page_text.BLOCKS:
            self.flush()
        self.stack.pop()

    def handle_data(self, data):
        kept = not (set(self.stack) & (page_text.DROPPED | page_text.RAW))
        if kept and ("article" in self.stack):
            self.now.append(data)


def test_equals_a_plain_reading_of_random_pages():
    rng = random.Random(8)
    inline, boxes = ["b", "i", "a", "em"], ["div", "section", "ul", "blockquote"]

    def piece(depth):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            return rng.choice(["word ", " two  words", "&amp; ", "x\n y", "<br>", "1 "])
        if kind < 0.55:
            tag = rng.choice(inline)
        elif kind < 0.75:
            tag = rng.choice(["h2", "pre"])
            return f"<{tag}>{rng.choice(['Head', 'A b'])}</{tag}>"
        elif kind < 0.9:
            tag = rng.choice(boxes)
        else:
            tag = rng.choice(["nav", "aside", "footer", "script", "style", "form"])
            if tag in ("script", "style"):
                return f"<{tag}>var x</{tag}>"
        return f"<{tag}>" + "".join(piece(depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(300):
        inner = "".join(piece(0) for _ in range(8))
        source = f"<html><body><nav>menu</nav><div>{piece(3)}</div><article>{inner}</article></body></html>"
        plain = Plain()
        plain.feed(source)
        plain.flush()
        assert text(source) == "\n".join(plain.lines), source


def test_templates_in_nested_boxes(spark):
    """A box goes with all that lies in it; what surrounds it stays."""
    rows = [
        (i, f"https://h.example/{i}",
         f"<article><div><p>own {i}</p><div><section><p>a</p><p>b</p></section>join</div></div></article>", None)
        for i in range(9)
    ]
    found = page_text.with_text(pages(spark, rows)).collect()
    assert {r.text for r in found} == {f"own {i}" for i in range(9)}


def test_blocks_of_links_stay_without_an_article():
    source = "<h1><a href='/t'>Title</a></h1><p>one</p><p><a href='/s'>Source</a></p><nav><a>m</a></nav>"
    assert text(source) == "Title\none\nSource"


def test_deep_and_long_pages():
    assert text("<div>" * 3000 + "x") == "x"
    assert text("<article>" + "<p>ab</p>" * 5000 + "</article>") == "\n".join(["ab"] * 5000)
    assert text("<" * 20_000 + " x") == "<" * 20_000 + " x"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_templates(spark):
    rows = [
        (i, f"https://h.example/{i}",
         f"<div>Welcome to the site</div><div><p>Own text {i} of page</p><p>shared</p></div>", "own")
        for i in range(12)
    ]
    rows += [(100 + i, "https://other.example/", "<div>Welcome to the site</div>", "x") for i in range(9)]
    found = {r.page_id: r for r in page_text.with_text(pages(spark, rows)).collect()}
    assert found[3].text == "Own text 3 of page"
    assert found[3].n_chars == len("Own text 3 of page")
    # Copies of one page count once, so its text is no template.
    assert found[100].text == "Welcome to the site"


def test_limit_grows_slower_than_the_host(spark):
    def box(i):
        return "<div>Buy now</div>" * (i < 76) + "<div>Rare box</div>" * (i < 19)

    rows = [
        (i, f"https://h.example/{i}", f"<article><p>own {i}</p>{box(i)}</article>", None)
        for i in range(400)
    ]
    found = {r.page_id: r.text for r in page_text.with_text(pages(spark, rows)).collect()}
    # On 76 of 400 pages, 19 %; and on 19, less than the square root of 400.
    assert found[50] == "own 50"
    assert found[3] == "own 3\nRare box"


def test_article_passages_stay_but_boxes_go(spark):
    rows = [
        (i, "https://h.example/x",
         f"<article><p>same line</p><p>own {i}</p><div><p>join us</p></div></article>", None)
        for i in range(10)
    ]
    found = page_text.with_text(pages(spark, rows)).collect()
    assert {r.text for r in found} == {f"same line\nown {i}" for i in range(10)}


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, None, None), (None, "no host", "<p>x</p>", None), (2, "http://h/", "", None)]
    rows += [(3, "http://h/", "<p>y</p>", None)] * 2
    found = page_text.with_text(pages(spark, rows)).collect()
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in found)
    assert got == [("1", "", 0), ("2", "", 0), ("3", "y", 1), ("3", "y", 1), ("None", "x", 1)]
    assert page_text.with_text(pages(spark, [])).count() == 0
