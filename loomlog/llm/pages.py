"""Main text of web pages by two-pass block rules (operator 5).

A page is read once from start to end into blocks of text. Each knows its length, the share of its characters inside links, the
share of stop words among its words, and where it stands: inside an article, or inside something that is never main text (menus,
scripts, adverts, comments ...). The first pass decides blocks by these; short ones that say too little stay open. The second pass gives an open
block the label of its nearest decided neighbours.

A form around an article, and a part of an article that is called like a notice or a share bar in one word of a longer name, may also hold the article itself. Such doubtful
containers are weighed as a whole: one that holds an article element, or reads like main text (long, many stop words,
few links), is left to the rules of its blocks; any other is never main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import documents as docs
from loomlog.llm import text as T

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "nav", "footer", "aside", "button", "select", "option", "dialog", "menu", "svg", "math", "canvas", "audio", "video", "datalist"}
DOUBTFUL = {"form", "label", "map", "object"}
ARTICLE = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Words of a class, id or role that mark a container as no part of the main text.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie",
    "cookies", "dialog", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "outbrain", "pagination", "popup", "privacy", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "widget", "complementary", "contentinfo",
}
#: Marks that may also name parts of an article when they are one word of a longer name (``share-content``, ``notice-board``).
MILD_MARKS = {"banner", "disclaimer", "notice", "privacy", "promo", "promotion", "related", "search", "share", "sharing", "skip", "social", "toolbar", "widget"}
#: An article's headings and paragraphs are its own, whatever they are called.
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
#: Marks that an article's own parts carry as well; they count outside articles only.
OUTER_MARKS = {"header", "top", "bottom", "left", "right", "site"}
STOP_WORDS = {
    *"a about after all also an and are as at be been but by can do for from had has have he her his i if in into is it its no not of on one or our she so that the their them there they this to up was we were what which who will with would you your".split(),
    *"aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist ja kein man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn werden wie wir wird zu zum zur".split(),
    *"au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me ne nous on ou où par pas plus pour qu que qui sa se ses son sur un une vous y".split(),
    *"al como con de del donde el ella en entre era es esta este están fue ha hay la las le les lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también todo un una y ya".split(),
}

LONG, SHORT = 200, 70
ARTICLE_LONG = 40
FEW_STOPS, MANY_STOPS = 0.20, 0.30
MANY_LINKS, ARTICLE_LINKS = 0.33, 0.80

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    article: int  # number of the article it stands in, 0 for none
    never: bool
    doubt: int = 0  # number of the innermost doubtful container it stands in, 0 for none
    label: bool | None = None

    def stops(self) -> float:
        found = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


@dataclass
class _Open:
    name: str
    article: int
    never: bool
    link: bool
    doubt: int = 0


@dataclass
class _Reader:
    """State of one run over a page."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    articles: int = 0
    breaks: int = 0
    around: list[int] = field(default_factory=lambda: [0])  # for each doubtful container the one around it
    whole: set[int] = field(default_factory=set)  # those that hold an article element

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", 0, False, False)

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append((html.unescape(raw), self.top().link))
            if raw.strip():
                self.breaks = 0

    def cut(self) -> None:
        """End the block that is being read."""
        words = " ".join("".join(p for p, _ in self.parts).split())
        if words:
            links = sum(len(" ".join(p.split())) for p, link in self.parts if link)
            self.blocks.append(Block(words, min(links, len(words)), self.top().article, self.top().never, self.top().doubt))
        self.parts, self.breaks = [], 0

    def open(self, name: str, rest: str) -> None:
        if name == "br":
            self.breaks += 1
            self.parts.append((" ", False))
            if self.breaks > 1:
                self.cut()
            return
        if name not in INLINE:
            self.cut()
        if name in VOID:
            return
        if name in ENDS_PARAGRAPH:
            self.leave({"p"}, {"div", "section", "article", "main", "td", "li", "body", "blockquote"})
        if name in CLOSES_ITSELF and name != "p":
            self.leave({name, "p"}, {"ul", "ol", "dl", "table", "select", "div"})
        above = self.top()
        article = above.article
        if name in ARTICLE and not article:
            self.articles += 1
            article = self.articles
            holder = above.doubt
            while holder:
                self.whole.add(holder)
                holder = self.around[holder]
        mark = _marked(rest, bool(above.article), name) if rest.strip() else 0
        never = above.never or name in NEVER or mark == _CERTAIN or (name == "form" if above.article else name == "header")
        doubt = above.doubt
        if not never and (name in DOUBTFUL or mark == _MILD):
            self.around.append(doubt)
            doubt = len(self.around) - 1
        self.stack.append(_Open(name, article, never, above.link or name == "a", doubt))

    def leave(self, names: set[str], limits: set[str]) -> None:
        """Close the innermost of ``names``, with all it holds, unless one of ``limits`` comes first."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name in names:
                del self.stack[i:]
                return
            if self.stack[i].name in limits:
                return

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.cut()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                return
            if name in INLINE and self.stack[i].name not in INLINE:
                return  # an inline end tag closes nothing beyond its block


_MILD, _CERTAIN = 1, 2


def _marked(rest: str, in_article: bool, name: str) -> int:
    """Whether attributes mark an element as no main text: certainly, mildly (inside an article, by one word of a longer name), or not."""
    if name in ("body", "html"):
        return 0
    own: dict[str, str] = {}
    for attribute, value in _ATTRIBUTE.findall(rest):
        own.setdefault(attribute.lower(), value.strip("\"'").lower())
    if "hidden" in own or own.get("aria-hidden") == "true":
        return _CERTAIN
    if in_article and name in TEXT:
        return 0
    mild = 0
    for attribute in ("class", "role") if in_article else ("class", "id", "role"):
        found = set(re.split(r"[^a-z]+", own.get(attribute, "")))
        hits = found & MARKS
        if hits and in_article and hits <= MILD_MARKS and not hits & set(own[attribute].split()):
            mild = _MILD
        elif hits or (found & OUTER_MARKS and not in_article and "content" not in found):
            return _CERTAIN
    return mild


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, not yet labelled."""
    reader, at = _Reader(), 0
    while True:
        found = _MARKUP.search(page, at)
        if found is None:
            reader.text(page[at:])
            break
        reader.text(page[at : found.start()])
        at = found.end()
        if found["cdata"]:
            reader.text(found["cdata"].replace("&", "&amp;"))
        elif found["name"]:
            name = found["name"].lower()
            if found["end"]:
                reader.close(name)
            elif name in RAW:
                reader.cut()
                end = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
                at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            else:
                reader.open(name, found["rest"])
    reader.cut()
    _weigh(reader)
    return reader.blocks


def _weigh(reader: _Reader) -> None:
    """Blocks of doubtful containers that don't read like main text are never such."""
    n = len(reader.around)
    size, links, words, stops = ([0] * n for _ in range(4))
    for b in reader.blocks:
        holder = b.doubt
        if holder and not b.never:
            found = _WORD.findall(b.text.lower())
            hits = sum(w in STOP_WORDS for w in found)
            while holder:
                size[holder] += len(b.text)
                links[holder] += b.links
                words[holder] += len(found)
                stops[holder] += hits
                holder = reader.around[holder]
    kept = [True] * n
    for c in range(1, n):  # a container comes after the one around it
        reads = size[c] > LONG and links[c] <= MANY_LINKS * size[c] and stops[c] >= MANY_STOPS * max(words[c], 1)
        kept[c] = kept[reader.around[c]] and (c in reader.whole or reads)
    for b in reader.blocks:
        b.never = b.never or not kept[b.doubt]


def _decide(b: Block) -> bool | None:
    """First pass: True for main text, False for none, None for open."""
    n, links = len(b.text), b.links / len(b.text)
    if b.never:
        return False
    if b.article:
        if links > ARTICLE_LINKS:
            return False if n >= ARTICLE_LONG else None
        return True if n >= ARTICLE_LONG else None
    if links > MANY_LINKS:
        return False
    if n < SHORT:
        return False if b.links else None
    stops = b.stops()
    if stops >= MANY_STOPS:
        return True if n > LONG else None
    return None if stops >= FEW_STOPS else False


def label(found: list[Block]) -> list[Block]:
    """Both passes. An open block looks at its own article first, and belongs to it if nothing in it is decided."""
    for b in found:
        b.label = _decide(b)
    decided = [b.label for b in found]
    near_before = _nearest(found, decided, range(len(found)))
    near_after = _nearest(found, decided, range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        if b.label is not None:
            continue
        before, after = near_before[i], near_after[i]
        if before is None and after is None:
            b.label = bool(b.article) or all(x.label is not False or x.never for x in found)
        elif before is None or after is None:
            b.label = decided[after if before is None else before]
        elif decided[before] == decided[after]:
            b.label = decided[before]
        else:
            closer = before if i - before <= after - i else after
            b.label = decided[closer]
    return found


def _nearest(found: list[Block], decided: list[bool | None], order: range) -> list[int | None]:
    """For each block the last decided one met in this order, in the same article (or outside of all)."""
    out: list[int | None] = [None] * len(found)
    last: dict[int, int] = {}
    for i in order:
        out[i] = last.get(found[i].article)
        if decided[i] is not None and not found[i].never:  # menus and the like say nothing about text beside them
            last[found[i].article] = i
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks joined by line feeds; empty for null, for no markup at all the whole text."""
    return "\n".join(b.text for b in label(blocks(page or "")) if b.label)


def extract(df: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row of pages.

    Null and empty pages give an empty text; pages are read whole, each by itself, repeated rows repeatedly; other columns are not read.
    """
    few = df.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html_column).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in T.portions(whole, "html"):
                found = [main_text(v.as_py()) for v in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return few.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5(spark: SparkSession, path: str) -> DataFrame:
    return extract(docs.table(spark, path, "pages"))


docs.register("op5_main_text", op5)
