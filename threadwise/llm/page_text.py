"""Main text of web pages: structure tells what is no article, templates are found per host.

A page is parsed once into the blocks of its main part, each with the hashes of the element subtrees
that hold it. Menus, headers, footers, sidebars, notices, adverts, forms, comments and code are left
out by what their elements are and say they are. Subtrees that remain are counted per host, over
pages that differ in their text, and a subtree that recurs across many of a host's pages is site
template: its blocks are deleted.

Inside an article, passages (headings, paragraphs, list items) are never templates, only the boxes
around them can be: sites repeat sentences, too. Pages without an article or main element take the
whole body, where every block element can be a template.

Defined results: null html is the empty page, with empty text; a page whose url has no host is
counted under an empty host; pages with the same text count once for templates; equal rows give
equal texts; an empty table gives an empty table. Input columns named like a column the operator
adds are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import drop_columns
from threadwise.session import cut_lineage

# A subtree is template from this many differing pages of a host on. Where that many are less than
# this share of the host's pages, the limit grows with the square root of the pages.
MIN_PAGES = 5
MIN_SHARE = 0.2

# --- what is no article ------------------------------------------------------------------------

VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source track"
    " wbr".split()
)
RAW = frozenset("script style noscript template iframe svg math textarea xmp title object".split())
DROPPED = frozenset(
    "head nav aside footer form button select option datalist fieldset label dialog menu canvas"
    " audio video map applet".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav"
    " ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
PASSAGES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr".split())
# A new element of the key closes an open one of these, up to the nearest element that scopes it.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset(
    "html body main article section nav aside header footer form div ul ol dl table td th"
    " blockquote".split()
)
# An end tag of another kind does not reach beyond these.
WALLS = frozenset("html body main article nav aside header footer form section table".split())

NO_ARTICLE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar"
    " toolbar form status tablist".split()
)
# Words of a class or id that name what is no article.
NO_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?"
    r"|sidebar\w*|rail|widgets?|foot(?:er)?|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?"
    r"|notifications?|alerts?|popup|modal|overlay|newsletter|subscri\w+|signup|login|search\w*"
    r"|shar(?:e|ing)|social|related|recommend\w*|pagination|pager|comments?|commentlist|disqus\w*"
    r"|respond|repl(?:y|ies)|skip|hidden|sr-only|visually-hidden)(?:$|[\s_-]|\d)"
)
# Inside an article only tokens made of nothing but such words and these decide.
NEUTRAL = frozenset(
    "area bar block box btn button buttons column container content group inline inner item items"
    " left links list main mid post right row section site slot tools top unit wrap wrapper zone".split()
)
# A page's header, not the one of its article.
HEADER = re.compile(
    r"(?:^|\s)(?:(?:site|page|global|main|top|blog|sticky|fixed|mobile|desktop)[_-]?)*header"
    r"(?:[_-](?:area|bar|box|container|inner|nav|top|wrap|wrapper))*\d*(?:$|\s)"
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS_ID = re.compile(r"^(?:comments?|commentlist|disqus\w*|respond)$")
COMMENT = re.compile(r"(?:^|[\s_-])comment(?:s|list|body|text)?(?:$|[\s_-]|\d)")
# Classes that say what a page or wrapper has or how it stands, not what the element is.
MODIFIER = re.compile(
    r"(?:^|[_-])(?:has|have|no|not|with|without|show|hide)[_-]|^(?:category|tag)-"
    r"|[_-](?:open|opened|closed|collapsed|expanded|active|visible|enabled|disabled)$"
)
# Boxes of other pages' articles and of comments: an article inside is not the page's.
OTHERS = re.compile(r"comment|disqus|respond|repl(?:y|ies)|related|recommend|promo|sponsor|advert|widget")

# --- one page ----------------------------------------------------------------------------------

MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|$)"
    r"|<[!?/][^>]*(?:>|$)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(
    r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.DOTALL
)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for match in ATTRIBUTE.finditer(text):
        found.setdefault(match[1].lower(), html.unescape(match[2] or match[3] or match[4] or ""))
    return found


def named_by(pattern: re.Pattern, named: str) -> bool:
    """Whether a class or id that is no modifier matches."""
    return bool(pattern.search(named)) and any(
        pattern.search(token) and not MODIFIER.search(token) for token in named.split()
    )


def named(given: dict[str, str]) -> str:
    return f"{given.get('class', '')} {given.get('id', '')}".lower()


def wholly_named_by(pattern: re.Pattern, tokens: str) -> bool:
    """Whether a token consists of words that match and neutral ones, with a match among them."""
    for token in tokens.split():
        words = [word for word in re.split(r"[_-]+|\d+", token) if word]
        found = [bool(pattern.search(word)) for word in words]
        if any(found) and all(f or word in NEUTRAL for f, word in zip(found, words)):
            return not MODIFIER.search(token)
        if pattern.fullmatch(token):
            return True
    return False


def is_by_kind(name: str, given: dict[str, str], in_article: bool) -> bool:
    """The element's tag, role or style tells that it is no article."""
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if name in ("html", "body"):
        return False
    if given:
        if "hidden" in given or given.get("aria-hidden") == "true":
            return True
        if HIDDEN_STYLE.search(given.get("style", "").lower()):
            return True
        if NO_ARTICLE_ROLES & set(given.get("role", "").lower().split()):
            return True
    return False


def is_by_name(name: str, given: dict[str, str], in_article: bool) -> bool:
    """The element's class or id tells that it is no article."""
    if name in ("html", "body") or not (given.get("class") or given.get("id")):
        return False
    if name == "main" or (name == "article" and not in_article):
        return named_by(COMMENT, named(given))
    if in_article:
        # Ids are made from headings there, and passages are the article's own. Only what holds the
        # readers' comments is known by its id.
        if name in PASSAGES:
            return False
        return wholly_named_by(NO_ARTICLE, given.get("class", "").lower()) or wholly_named_by(
            COMMENTS_ID, given.get("id", "").lower()
        )
    return named_by(NO_ARTICLE, named(given)) or named_by(HEADER, named(given))


class Element:
    """An open element: what it holds so far, and whether its text counts.

    ``parts`` are the texts and the hashes of the elements in it, ``node`` its number among the
    subtrees that may be template and ``above`` that of the nearest one around it. ``wrapper`` is the
    class and id of an element that was dropped for nothing else, ``saved`` whether it lies in an
    article found inside of such an element, ``piece`` the innermost article element.
    """

    __slots__ = (
        "name", "parts", "node", "above", "blocks", "dropped", "article", "piece", "wrapper",
        "saved", "plain", "for_main", "for_article", "within", "wrapped", "chars", "linked",
    )

    def __init__(self, name: str, around: "Element | None" = None):
        self.name, self.parts, self.blocks, self.node = name, [], 0, -1
        self.dropped, self.wrapper, self.chars, self.linked = False, "", 0, 0
        self.article, self.piece, self.saved, self.above = -1, -1, False, -1
        # Of the drops around: whether all are forms, headers or menus that may hold the page, and
        # whether a main element or an article may be the page's all the same.
        self.plain = self.for_main = self.for_article = True
        self.within = self.wrapped = False
        if around:
            self.article, self.piece, self.saved = around.article, around.piece, around.saved
            self.above = around.node if around.node >= 0 else around.above
            self.dropped, self.plain = around.dropped, around.plain
            self.for_main, self.for_article = around.for_main, around.for_article
            self.within, self.wrapped = around.within, around.wrapped

    def drop(self, wrapper: str) -> None:
        self.dropped, self.wrapper = True, wrapper
        plain = self.name in ("form", "header", "nav")
        self.plain &= plain
        self.for_main &= plain or bool(wrapper)
        self.for_article &= plain or bool(wrapper and not OTHERS.search(wrapper))
        self.wrapped |= bool(wrapper)


class Page:
    """Reads a page into ``blocks``: (text, node, article or -1, piece or -1, saved).

    ``hashes`` and ``parents`` tell of every node, a subtree that may be template, its hash and the
    number of the nearest node around it, or -1. An element's hash is made from those of its
    children when it closes, so the work grows with the page and not with its depth.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.hashes: list[int] = []
        self.parents: list[int] = []
        self.pending: list[str] = []
        self.articles = self.open_articles = self.pieces = self.links = 0
        self.titles: dict[int, bool] = {}
        self.stack = [Element("")]
        self.heading: Element | None = None
        self.titled = False
        # Names of the open elements, within the nearest scope and within the nearest wall.
        self.in_scope, self.in_wall, self.open = [Counter()], [Counter()], Counter()
        self.scopes = [""]
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            match = MARKUP.search(source, at)
            self._text(source[at : match.start() if match else len(source)])
            if not match:
                break
            at = match.end()
            name = (match["name"] or "").lower()
            if not name:
                continue
            if match["end"]:
                self._end(name)
                continue
            self._start(name, match["attributes"])
            if name in RAW and not match["attributes"].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.IGNORECASE)
                found = close.search(source, at)
                at = found.start() if found else len(source)
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if text and not top.dropped:
            self.pending.append(html.unescape(text) if "&" in text else text)
            if self.heading and not text.isspace():
                self.heading.chars += 1
                self.heading.linked += self.links > 0

    def _flush(self) -> None:
        if self.pending:
            text = " ".join("".join(self.pending).split())
            if text:
                top = self.stack[-1]
                node = top.node if top.node >= 0 else top.above
                self.blocks.append((text, node, top.article, top.piece, top.saved))
                top.parts.append(text)
                top.blocks += 1
            self.pending = []

    def _start(self, name: str, given: str) -> None:
        if name in BLOCKS:
            self._flush()
            if name != "br":
                self._close_open({"p"} | CLOSES.get(name, set()))
        elif name in CLOSES:
            self._close_open(CLOSES[name])
        if name in VOID:
            return
        element = Element(name, self.stack[-1])
        values = attributes(given) if given.strip(" /\n\t\r") else {}
        # A page may be wrapped in a form, leave its menu open or stand in a box whose class only
        # sounds like a menu: its main part and its title are still found.
        if element.dropped and name in ("main", "article") and self._only_wrapped(element, name):
            element.dropped = False
            # Articles in such a box may be another page's: they count if there are no others.
            element.saved = name == "article" and element.wrapped
        elif element.dropped and name == "h1" and not self.titled and element.for_article:
            element.dropped = element.plain and not element.wrapped
        if not element.dropped:
            in_article = element.article >= 0
            if name in RAW or is_by_kind(name, values, in_article):
                element.drop("")
            elif is_by_name(name, values, in_article):
                element.drop(named(values))
        if not element.dropped:
            self._count_in(element, values)
        self._push(element)

    def _only_wrapped(self, element: Element, name: str) -> bool:
        # Boxes in an article are no wrappers of the page.
        if element.within:
            return element.plain
        return element.for_main if name == "main" else element.for_article

    def _count_in(self, element: Element, values: dict[str, str]) -> None:
        """Number the article, the piece and the node that the element begins."""
        name = element.name
        if name == "article":
            element.within = True
            element.piece = self.pieces
            self.pieces += 1
            self.open_articles += not element.saved
        if element.article < 0 and not element.saved and (
            name in ("article", "main") or "main" in values.get("role", "").split()
        ):
            self.articles += 1
            element.article = self.articles
        if name in HEADINGS and self.heading is None:
            self.heading = element
            self.titled |= name == "h1"
        if (
            name in BLOCKS
            and name not in ("html", "body", "article", "main")
            and not (element.article >= 0 and name in PASSAGES)
        ):
            element.node = len(self.hashes)
            self.hashes.append(0)
            self.parents.append(element.above)

    def _push(self, element: Element) -> None:
        name = element.name
        self.stack.append(element)
        self.links += name == "a"
        self.open[name] += 1
        self.in_scope[-1][name] += 1
        self.in_wall[-1][name] += 1
        if name in SCOPES:
            self.in_scope.append(Counter())
            self.scopes.append(name)
        if name in WALLS:
            self.in_wall.append(Counter())

    def _close_open(self, names: set[str]) -> None:
        """Close an open element of these names, unless a scope lies in between."""
        counts = self.in_scope[-1]
        # The scope itself can be meant as well.
        if self.scopes[-1] not in names and not any(counts[name] for name in names):
            return
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].name in names:
                while len(self.stack) > place:
                    self._pop()
                return

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if not (self.open if name in WALLS else self.in_wall[-1])[name]:
            return
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].name == name:
                while len(self.stack) > place:
                    self._pop()
                return

    def _pop(self) -> None:
        element = self.stack[-1]
        name = element.name
        if name in BLOCKS:
            self._flush()
        self.stack.pop()
        if name in SCOPES:
            self.in_scope.pop()
            self.scopes.pop()
        if name in WALLS:
            self.in_wall.pop()
        self.links -= name == "a"
        for counts in (self.open, self.in_scope[-1], self.in_wall[-1]):
            counts[name] -= 1
        if element is self.heading:
            self.heading = None
            if element.chars:
                self.titles.setdefault(element.piece, element.linked == element.chars)
        around = self.stack[-1]
        around.blocks += element.blocks
        number = xxhash.xxh64_intdigest("\x1f".join([name, *element.parts]))
        around.parts.append(f"<{number:x}")
        if element.node >= 0 and element.blocks:
            self.hashes[element.node] = number - (1 << 63)

    def main_blocks(self) -> list[tuple[str, int]]:
        """The article's blocks, each with its node; without an article, all blocks.

        An article whose title links to another page is a teaser of it, if another article of the
        page has a title of its own or none.
        """
        counted = {block[3] for block in self.blocks if not block[4]} - {-1}
        teasers = {piece for piece in counted if self.titles.get(piece)}
        if teasers == counted:
            teasers = set()
        return [
            (text, node)
            for text, node, article, piece, saved in self.blocks
            if not (saved and (self.open_articles or (article < 0 and self.articles)))
            and (article >= 0 or not self.articles)
            and piece not in teasers
        ]

    def found(self) -> dict:
        """The main blocks and the nodes around them, as a row."""
        blocks = self.main_blocks()
        kept: dict[int, int] = {}
        for _, node in blocks:
            while node >= 0 and node not in kept:
                kept[node] = 0
                node = self.parents[node]
        order = sorted(kept)
        kept = {node: place for place, node in enumerate(order)}
        return {
            "blocks": [{"text": text, "node": kept.get(node, -1)} for text, node in blocks],
            "hashes": [self.hashes[node] for node in order],
            "parents": [kept.get(self.parents[node], -1) for node in order],
        }


def without_templates(blocks, hashes, parents, template) -> str:
    """The text of the blocks that lie in no subtree of ``template``."""
    gone: list[bool] = []
    unwanted = set(template)
    for number, parent in zip(hashes, parents):
        # A node stands before those inside of it.
        gone.append(number in unwanted or (parent >= 0 and gone[parent]))
    return "\n".join(b["text"] for b in blocks if b["node"] < 0 or not gone[b["node"]])


# --- Spark -------------------------------------------------------------------------------------

PARSED = (
    "blocks array<struct<text: string, node: int>>, hashes array<long>, parents array<int>"
)
ADDED = (
    "page", "page_blocks", "page_host", "page_nodes", "page_parents", "page_key", "template",
    "text", "n_chars",
)


def parsed(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """Add ``page_host``, ``page_blocks``, and ``page_nodes``, the subtrees that may be template.

    A block names its innermost subtree, and ``page_parents`` the subtree around each.
    """

    @F.pandas_udf(PARSED)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            yield pd.DataFrame(
                [Page(s or "").found() for s in sources], columns=["blocks", "hashes", "parents"]
            )

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\w+://([^/?#]*)", 1))
    return (
        drop_columns(pages, *ADDED)
        .withColumn("page", parse(F.coalesce(F.col(source), F.lit(""))))
        .withColumn("page_host", host)
        .withColumns(
            {
                "page_blocks": F.col("page.blocks"),
                "page_nodes": F.col("page.hashes"),
                "page_parents": F.col("page.parents"),
            }
        )
        .drop("page")
    )


def templates(
    parsed_pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """(host, subtree hash) of the subtrees that recur across many differing pages of a host.

    (Subtree, page) pairs are made distinct before they are counted, so the pages of a host that
    has most of all pages are spread over many tasks.
    """
    content = parsed_pages.select(
        "page_host", F.xxhash64("page_blocks.text").alias("content"), "page_nodes"
    )
    pages = (
        content.select("page_host", "content").distinct().groupBy("page_host")
        .agg(F.count("*").alias("pages"))
    )
    found = (
        content.select("page_host", "content", F.explode(F.array_distinct("page_nodes")).alias("node"))
        .distinct()
        .groupBy("page_host", "node")
        .agg(F.count("*").alias("found"))
        .filter(F.col("found") >= min_pages)
    )
    return (
        found.join(pages, "page_host")
        .filter(F.col("found") * F.col("found") >= min_pages * min_share * F.col("pages"))
        .select("page_host", "node")
    )


def _joined(blocks) -> Column:
    return F.array_join(F.transform(blocks, lambda block: block["text"]), "\n")


def with_text(
    pages: DataFrame,
    url: str = "url",
    source: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """The input's columns but the html, with ``text`` and ``n_chars``.

    Pages are parsed once and their blocks written. Only pages that hold a subtree which could be
    template are joined with the templates found.
    """
    stored = cut_lineage(
        parsed(pages, url, source)
        .drop(source)
        .withColumn("page_key", F.monotonically_increasing_id())
    )
    maybe = stored.filter(F.size("page_nodes") > 0)
    removed = (
        maybe.select("page_key", "page_host", F.explode(F.array_distinct("page_nodes")).alias("node"))
        .join(templates(stored, min_pages, min_share), ["page_host", "node"])
        .groupBy("page_key")
        .agg(F.collect_set("node").alias("template"))
    )

    @F.pandas_udf("string")
    def rest(
        blocks: pd.Series, hashes: pd.Series, parents: pd.Series, template: pd.Series
    ) -> pd.Series:
        rows = zip(blocks, hashes, parents, template)
        return pd.Series([without_templates(*row) for row in rows], dtype=object)

    # Most pages hold no template: theirs are joined without a pass through Python.
    joined = cut_lineage(maybe.join(removed, "page_key", "left"))
    with_template = joined.filter("template IS NOT NULL").withColumn(
        "text", rest("page_blocks", "page_nodes", "page_parents", "template")
    )
    cleaned = with_template.unionByName(
        joined.filter("template IS NULL").withColumn("text", _joined("page_blocks"))
    )
    others = stored.filter(F.size("page_nodes") == 0).withColumn("text", _joined("page_blocks"))
    names = [name for name in stored.columns if name not in ADDED]
    return (
        cleaned.select(*names, "text")
        .unionByName(others.select(*names, "text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
