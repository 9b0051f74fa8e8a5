"""Main text of web pages, without what a site repeats.

Every element of a page gets a hash of its subtree. Spark counts, for each host, on how many
different texts a subtree occurs; those on many of them are the site's template and go. What the
names of elements, classes and roles say is no part of an article goes too, also on hosts of a few
pages. If a page marks its article, the text is that of the article, in which a repeated paragraph
is no template: a site may hold many copies of one text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import join_groups
from dayledger.session import kept

#: A subtree is a template if it is on this part of a host's different texts, and on so many at least.
#: On hosts of more than 100 texts, this times the root of their number is enough.
SHARE = 0.3
PAGES = 5
ROOTS = 3.0
#: Elements whose text tells one article from another.
BODY = set("p pre blockquote".split())

#: Elements without an end, elements that stand in a line of text, elements whose
#: start ends an open paragraph, and what an open element of the same kind is ended by.
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements, roles, classes and ids that are no part of an article.
NO_TEXT = set(
    "head script style noscript template nav footer aside form button select textarea iframe object "
    "svg canvas audio video dialog menu".split()
)
NO_ROLE = set("navigation banner contentinfo complementary search dialog alertdialog alert form".split())
NO_CLASS = set(
    "ad ads advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs "
    "consent cookie cookies footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pagination popup promo related share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may follow those in a class or id without changing what it says, words
#: before them that tell of a state of what is named, and names of what readers write.
NEUTRAL = set(
    "area article articles bar block body bottom box button buttons column container content desktop entry "
    "feed float form global icon icons inner item items label left link links list main mobile news outer "
    "page panel pane post posts right row section site slot stories story strip text title tool tools top "
    "unit wrap wrapper".split()
)
STATES = set("has is no not with without".split())
READERS = set("comment comments commentlist disqus replies reply respond".split())
#: Elements that hold the paragraphs of an article.
PROSE = set("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
NAMES = re.compile("[^a-z]+")


@dataclass
class Element:
    tag: str
    start: int
    end: int
    number: int = 0
    out: bool = False
    main: bool = False
    inside: bool = False
    prose: bool = False
    #: Whether only a class or id says that it is no part of an article, and that readers wrote it.
    by_name: bool = False
    readers: bool = False


def named_out(names: str, inside: bool = False) -> str:
    """The word by which a class or id names what is no part of an article, or nothing.

    The last word decides that does not just say where or how: user-comments, google-ads-top and
    related-articles, but not related-work. Not what has or lacks something (has-sidebar), nor the
    header of an article or of what is in it.
    """
    for token in names.lower().split():
        words = [w for w in NAMES.split(token) if len(w) > 1]
        if not words or words[0] in STATES:
            continue
        owner = set(words[:-1])
        while len(words) > 1 and words[-1] in NEUTRAL:
            words.pop()
        head = words[-1]
        if head == "header" and (inside or owner & {"article", "entry", "post", "story"}):
            continue
        if head in NO_CLASS or head in READERS:
            return head
    return ""


class Reader(HTMLParser):
    """Text pieces of a page in order, None where a block begins or ends, and the elements' places."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str | None] = []
        self.elements: list[Element] = []
        self.open: list[tuple[Element, xxhash.xxh64]] = []
        #: How many open elements there are of each kind, so that most ends are found at once.
        self.depth: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P and self.depth.get("p"):
            self.close_until({"p"}, {"button", "table", "td", "th"})
        if tag in ENDS:
            self.close_until(*ENDS[tag])
        if tag not in INLINE:
            self.pieces.append(None)
        if tag in EMPTY:
            return
        named = {k: v or "" for k, v in attrs}
        names = named.get("class", "") + " " + named.get("id", "")
        role = named.get("role", "").lower()
        inside = bool(self.open) and (self.open[-1][0].inside or self.open[-1][0].main)
        element = Element(tag, len(self.pieces), -1, inside=inside)
        name = named_out(names, inside)
        # Comments of readers are often marked as articles, too.
        element.main = (tag in ("article", "main") or role == "main") and name not in READERS
        element.out = (
            tag in NO_TEXT or role in NO_ROLE or "hidden" in named
            or named.get("aria-hidden") == "true" or (tag == "header" and not inside)
        )
        element.by_name = bool(name) and not element.out and not element.main and tag not in ("html", "body")
        element.readers = element.by_name and name in READERS
        element.out |= element.by_name
        element.prose = tag in PROSE
        self.elements.append(element)
        self.open.append((element, xxhash.xxh64(f"<{tag} {names}>".encode("utf-8", "replace"))))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.depth.get(tag):
            self.close_until({tag}, set())
        if tag not in INLINE:
            self.pieces.append(None)

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if self.open:
            self.open[-1][1].update(" ".join(data.split()).encode("utf-8", "replace"))

    def close_until(self, tags: set[str], bounds: set[str]) -> None:
        """Close the innermost open element of ``tags``, and all in it, unless a bound is nearer."""
        for back in range(len(self.open) - 1, -1, -1):
            if self.open[back][0].tag in bounds:
                return
            if self.open[back][0].tag in tags:
                while len(self.open) > back:
                    self.close_one()
                return

    def close_one(self) -> None:
        element, digest = self.open.pop()
        self.depth[element.tag] -= 1
        element.end = len(self.pieces)
        element.number = digest.intdigest() - (1 << 63)
        if self.open:
            parent, above = self.open[-1]
            above.update(digest.digest())
            parent.prose |= element.prose

    def finish(self) -> None:
        self.close()
        while self.open:
            self.close_one()
        if any(e.by_name for e in self.elements):
            self.spare()

    def covered(self, which: Callable[[Element], bool]) -> bytearray:
        """Which pieces are in an element that ``which`` picks."""
        found = bytearray(len(self.pieces))
        for e in self.elements:
            if which(e):
                found[e.start : e.end] = b"\1" * (e.end - e.start)
        return found

    def spare(self) -> None:
        """Keep what only its name puts out if the page's article is in it, or most of the prose.

        If a marked article lies in nothing that is named so, that is the page's article, and nothing
        around other articles is kept. Else it is the marked article with the most prose. Prose keeps
        nothing that is named for readers' comments or holds articles within the article.
        """
        gone, named = self.covered(lambda e: e.out and not e.by_name), self.covered(lambda e: e.by_name)
        prose = self.covered(lambda e: e.tag in PROSE)
        upto = [0, *accumulate(
            len(x.strip()) if x and p and not g else 0
            for x, p, g in zip(self.pieces, prose, gone, strict=True)
        )]

        def size(e: Element) -> int:
            return upto[e.end] - upto[e.start]

        marked = [e for e in self.elements if e.main and not e.inside and e.start < len(gone) and not gone[e.start]]
        free = [e for e in marked if not named[e.start]]
        article = max(marked, key=size, default=None) if not free else None
        nested = sorted(e.start for e in self.elements if e.inside and e.tag == "article")
        whole = sum(map(size, free)) if free else upto[-1]
        for e in self.elements:
            if not e.by_name:
                continue
            if article is not None:
                e.out = not e.start <= article.start < e.end
            elif free and not e.inside:
                e.out = True
            else:
                holds = bisect_left(nested, e.start) < bisect_left(nested, e.end)
                e.out = e.readers or holds or 2 * size(e) <= whole


def read(html: str | None) -> Reader:
    reader = Reader()
    reader.feed(html or "")
    reader.finish()
    return reader


def may_be_template(element: Element) -> bool:
    """Whole pages are no template, nor is a line's part, nor the prose of an article."""
    if element.tag in ("html", "body") or element.tag in INLINE or element.main:
        return False
    return not (element.inside and element.prose)


def candidates(reader: Reader) -> list[int]:
    shown = [0, *accumulate(bool(p) and not p.isspace() for p in reader.pieces)]
    return sorted({
        e.number for e in reader.elements
        if may_be_template(e) and not e.out and shown[e.end] > shown[e.start]
    })


def body(reader: Reader, html: str | None) -> int:
    """A hash of the paragraphs of a page, the same for copies whatever is around them; without any,
    of the page."""
    shown = bytearray(len(reader.pieces))
    for e in reader.elements:
        if e.tag in BODY:
            shown[e.start : e.end] = b"\1" * (e.end - e.start)
    for e in reader.elements:
        if e.out:
            shown[e.start : e.end] = bytes(e.end - e.start)
    own = " ".join("".join(
        " " if p is None else p if s else "" for p, s in zip(reader.pieces, shown, strict=True)
    ).split())
    return xxhash.xxh64_intdigest((own or html or "").encode("utf-8", "replace")) - (1 << 63)


def main_text(html: str | None, templates: set[int]) -> str:
    reader = read(html)
    out = bytearray(len(reader.pieces))
    for e in reader.elements:
        if e.out or (e.number in templates and may_be_template(e)):
            out[e.start : e.end] = b"\1" * (e.end - e.start)
    marked = [e for e in reader.elements if e.main and not e.inside and not all(out[e.start : e.end])]
    article = [e for e in marked if e.tag == "article"] or marked
    if article:
        shown = bytearray(len(reader.pieces))
        for e in article:
            shown[e.start : e.end] = b"\1" * (e.end - e.start)
        out = bytearray(o or not s for o, s in zip(out, shown, strict=True))
    text = "".join(" " if p is None else "" if gone else p for p, gone in zip(reader.pieces, out, strict=True))
    return " ".join(text.split())


def site_templates(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """host and its template subtrees, from pages (host, html).

    Pages of a host with the same paragraphs count once, whatever is around them. A subtree is a
    template on ``share`` of the host's texts or on ``ROOTS`` times the root of their number, if that
    is less; so a host's list grows no faster than that root times the size of a page.
    """
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(body(r, h), candidates(r)) for h, r in ((h, read(h)) for h in batch["html"])]
            yield pd.DataFrame({
                "host": batch["host"], "body": [b for b, _ in rows], "numbers": [n for _, n in rows],
            })

    read_pages = kept(
        pages.where("host IS NOT NULL").select("host", "html")
        .mapInPandas(found, "host string, body bigint, numbers array<bigint>"),
        "subtrees",
    )
    sizes = read_pages.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    counted = read_pages.select("host", "body", F.explode("numbers").alias("number")).distinct().groupBy(
        "host", "number"
    ).agg(F.count("*").alias("n"))
    often = F.greatest(
        F.lit(float(least)), F.least(share * F.col("texts"), ROOTS * F.sqrt(F.col("texts")))
    )
    return join_groups(counted.where(F.col("n") >= least), sizes, ["host"]).where(
        F.col("n") >= often
    ).groupBy("host").agg(F.collect_list("number").alias("templates"))


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    share: float = SHARE, least: int = PAGES,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have the empty text; pages without a readable host have no templates;
    repeated rows are read alike; other columns are not read; an empty table gives an empty result.
    """
    host = F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST")))
    own = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"),
    )
    templates = kept(site_templates(own, share, least), "templates")
    known = own.join(templates.withColumnRenamed("host", "__host"), F.col("host") == F.col("__host"), "left")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                main_text(h, set() if t is None else set(t))
                for h, t in zip(batch["html"], batch["templates"], strict=True)
            ]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    read_texts = known.select("page_id", "url", "html", "templates").mapInPandas(
        extract, "page_id bigint, url string, text string"
    )
    return read_texts.withColumn("n_chars", F.length("text").cast("bigint"))
