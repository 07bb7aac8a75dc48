"""HTML extraction (operator 12): line-block distribution.

1. ``lines`` strips the markup of a page. Each block of text (between block
   tags or line ends) is a line; its weight is its length without link texts.
   The borders of containers leave an empty line. Regions that are no article
   by their element or by their names (menus, headers, footers, sidebars,
   notices, adverts, forms, comments) leave empty lines only, scripts and
   styles nothing. If a page marks its article (``article``, ``main``), lines
   outside weigh nothing.
2. ``distribution`` sums the weights over sliding windows of ``WINDOW`` lines.
3. ``surges`` finds where the sums rise from zero (surge) and fall back to it
   (dive). A stretch counts if its highest sum exceeds ``THRESHOLD``, or, on a
   page of short lines, if it is the highest.
4. The lines between surge and dive are the text. Where the page doesn't mark
   its article, the stretches that share the container of the heaviest one do.

Pages are independent, so there is no shuffle. A page is worked on as a whole in
its task and never cut; the time grows with its length.

Defined results: null html counts as empty, and an empty page, or one without
article text, gives an empty text with n_chars 0; an unclosed tag, comment or
script at the end is markup; repeated rows give repeated results; other columns
are kept, those called ``text`` or ``n_chars`` replaced. A line break element
ends a line. White space is what Unicode calls so (no-break spaces too).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.session import ship_package

#: Lines of a window.
WINDOW = 3
#: A stretch of text has a window with more characters than this.
THRESHOLD = 86

# Elements by what they do to lines.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINERS = {
    "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "fieldset", "table",
    "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "ol", "dl", "menu", "dialog", "details", "figure", "center",
}
_ENDS_LINE = _CONTAINERS | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "br", "hr", "address", "caption",
    "figcaption", "summary", "option", "html", "head", "legend", "hgroup", "search",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements without article text, and roles that say the same.
_NO_TEXT = {
    "nav", "footer", "aside", "menu", "dialog", "noscript", "template", "button", "select", "datalist", "object",
    "svg", "math", "canvas", "audio", "video", "head", "search",
}
_NO_TEXT_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert",
    "menu", "menubar", "toolbar", "tablist", "note", "status",
}
#: Words in a class, id or label that name something else than the article.
_NAMES = {
    "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead",
    "sidebar", "sidenav", "aside", "rail", "ad", "ads", "adv", "advert", "adverts", "advertisement",
    "advertisements", "advertising", "adsense", "adbox", "banner", "sponsor", "sponsored", "promo", "promos",
    "promotion", "promoted", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert",
    "disclaimer", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "signin",
    "login", "comment", "comments", "commentlist", "disqus", "replies", "respond",
    "guestbook", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "widget",
    "toolbar", "pagination", "pager", "copyright", "form", "searchform", "searchbox", "search", "skip", "hidden",
}
#: Of these, names that an article element can have without being the article.
_OTHER_ARTICLES = {
    "ad", "ads", "advert", "advertisement", "sponsored", "promo", "promoted", "comment", "comments", "related",
    "recommended", "sidebar", "teaser",
}
#: ``with-sidebar`` says what stands beside it.
_BESIDE = {"has", "have", "with", "no", "not", "without", "show", "hide"}
_NEVER_NAMED = {"html", "body", "main"}
#: Elements that end where the next of them begins.
_ITEMS = {"p", "li", "dt", "dd", "option"}

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_NAMING = re.compile(r"class|id\s*=|role|aria|hidden|style|itemprop", re.I)


class Line(NamedTuple):
    text: str
    #: Characters outside links; 0 for an empty line.
    weight: int
    #: Number of the innermost container around it, or 0.
    container: int
    #: Number of the article around it, or 0.
    article: int


EMPTY = Line("", 0, 0, 0)


def _tag_end(html: str, at: int) -> int:
    """Place after the tag that begins at ``at``; ``>`` in quotes doesn't end it."""
    end = html.find(">", at)
    if end < 0:
        return len(html)
    while True:
        inner = html[at:end]
        if '"' not in inner and "'" not in inner:
            return end + 1
        open_quote = ""
        for c in inner:
            if open_quote:
                if c == open_quote:
                    open_quote = ""
            elif c in "\"'":
                open_quote = c
        if not open_quote:
            return end + 1
        close = html.find(open_quote, end)
        after = html.find(">", close) if close >= 0 else -1
        # A quote that stays open, or closes far behind other tags, is a slip.
        if after < 0 or "<" in html[end:close] and "=" in html[end:close]:
            return end + 1
        end = after


def _attributes(tag: str, name_end: int) -> dict[str, str]:
    return {a.lower(): (b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(tag, name_end)}


def _named_otherwise(name: str, attributes: dict[str, str]) -> bool:
    """Whether the names of an element say that it isn't the article."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if attributes.get("role", "").lower() in _NO_TEXT_ROLES:
        return True
    for key in ("class", "id", "aria-label", "data-role"):
        for one in attributes.get(key, "").split():
            words = [w.lower() for w in _WORDS.findall(one)]
            if words and words[0] in _BESIDE:
                continue
            if name == "article":
                if key == "class" and any(w in _OTHER_ARTICLES for w in words):
                    return True
            elif any(w in _NAMES and not _harmless(w, words, name) for w in words):
                return True
    return False


def _harmless(word: str, words: list[str], name: str) -> bool:
    """A heading may be a header; page builders call every part some widget."""
    return word == "header" and name in _HEADINGS or word == "widget" and words[0] != "widget"


class _Open(NamedTuple):
    """An open element, and what held before it."""

    name: str
    drops: bool
    #: A header within the article, whose headings belong to it.
    heads: bool
    container: int
    article: int
    marked_by: str


def lines(html: str, forms: bool = False) -> tuple[list[Line], list[int]]:
    """Lines of a page, and the container around each container (a container's
    number is its place; number 0 is the page). ``forms``: read forms too."""
    out: list[Line] = []
    parents = [0]
    stack: list[_Open] = []
    open_names: Counter[str] = Counter()
    dropping = heading_only = links = heading = 0
    container = article = articles = 0
    marked_by = ""
    words: list[str] = []
    linked = 0

    def end_line() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append(Line(text, max(0, len(text) - linked), container, article))
            words.clear()
        linked = 0

    def close(upto: int) -> None:
        """End the elements from ``upto`` on."""
        nonlocal dropping, heading_only, container, article, marked_by
        while len(stack) > upto:
            o = stack.pop()
            open_names[o.name] -= 1
            if o.drops:
                dropping -= 1
                if not dropping:
                    out.extend([EMPTY] * WINDOW)
            heading_only -= o.heads
            container, article, marked_by = o.container, o.article, o.marked_by

    at, n = 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        stop = m.start() if m else n
        read = not dropping and (not heading_only or heading)
        if stop > at and read:
            part = html[at:stop]
            if "&" in part:
                part = unescape(part)
            words.append(part)
            if links:
                linked += len(part.strip())
        if not m:
            break
        at = stop
        if html.startswith("<!--", at):
            over = html.find("-->", at + 4)
            at = n if over < 0 else over + 3
            continue
        if html.startswith("<![CDATA[", at):
            over = html.find("]]>", at)
            at = n if over < 0 else over + 3
            continue
        named = _TAG_NAME.match(html, at)
        if not named:  # doctype, processing instruction, or </ before no name
            over = html.find(">", at)
            at = n if over < 0 else over + 1
            continue
        name = named.group(1).lower()
        at = _tag_end(html, at)
        tag = html[stop:at]
        if name in _ENDS_LINE:
            end_line()
        if tag[1] == "/":
            if name == "a":
                links = max(0, links - 1)
            elif name in _HEADINGS:
                heading = max(0, heading - 1)
            if open_names[name]:
                end_line()
                upto = len(stack) - 1
                while stack[upto].name != name:
                    upto -= 1
                close(upto)
            if name in _CONTAINERS:
                out.append(EMPTY)
            continue
        if name in _RAW:
            # Its content is text up to its own end tag.
            end_tag = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            if not end_tag:
                break
            at = _tag_end(html, end_tag.start())
            continue
        if name in _VOID or tag.endswith("/>") and name not in _ENDS_LINE:
            continue
        # A paragraph ends where the next block begins, an item at the next item.
        if name in _ENDS_LINE and stack and (
            stack[-1].name == "p" or stack[-1].name == name and name in ("li", "dt", "dd", "option")
        ):
            close(len(stack) - 1)
        if name == "a":
            links += 1
        elif name in _HEADINGS:
            heading += 1
        attributes = _attributes(tag, len(named.group(0))) if _NAMING.search(tag) else {}
        drops = name in _NO_TEXT or name in ("form", "fieldset") and not forms
        drops = drops or name not in _NEVER_NAMED and _named_otherwise(name, attributes)
        marks = (
            name in ("article", "main")
            or attributes.get("role", "").lower() in ("main", "article")
            or "articlebody" in attributes.get("itemprop", "").lower()
        )
        heads = False
        if name == "header" or drops and article and attributes.get("class", "").lower().endswith("header"):
            # The header of the page goes; that of an article holds its title.
            heads = bool(article)
            drops = not heads
        if name == "article" and marked_by == "article":
            drops, marks = True, False  # an article in an article is a comment on it
        if not (dropping or drops or heads or marks or name in _CONTAINERS or name in _ITEMS):
            continue
        stack.append(_Open(name, drops, heads, container, article, marked_by))
        open_names[name] += 1
        if drops:
            end_line()
            if not dropping:
                out.extend([EMPTY] * WINDOW)
            dropping += 1
        heading_only += heads
        if name in _CONTAINERS:
            out.append(EMPTY)
            parents.append(container)
            container = len(parents) - 1
        if marks and not dropping and (not article or name == "article"):
            articles += 1
            article, marked_by = articles, name
    end_line()
    return out, parents


def distribution(weights: list[int], window: int = WINDOW) -> list[int]:
    """Sum of the weights of each ``window`` lines, by the first of them."""
    sums, total = [], sum(weights[: window - 1])
    for i in range(len(weights)):
        total += weights[i + window - 1] if i + window - 1 < len(weights) else 0
        sums.append(total)
        total -= weights[i]
    return sums


def surges(sums: list[int], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(surge, dive) of the stretches whose highest sum exceeds the threshold;
    where none does, of the highest (the first, of equals)."""
    stretches: list[tuple[int, int, int]] = []
    start = top = -1
    for i, s in enumerate([*sums, 0]):
        if s and start < 0:
            start, top = i, s
        elif s:
            top = max(top, s)
        elif start >= 0:
            stretches.append((start, i, top))
            start = -1
    kept = [(a, b) for a, b, t in stretches if t > threshold]
    if not kept and stretches:
        best = max(stretches, key=lambda s: s[2])
        kept = [best[:2]]
    return kept


def article_text(html: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of a page."""
    if not html:
        return ""
    found, parents = lines(html)
    if not any(line.text for line in found) and "<form" in html.lower():
        found, parents = lines(html, forms=True)  # a page wrapped in a form
    # The marked article with the most text, if there is one.
    mass: Counter[int] = Counter()
    for line in found:
        mass[line.article] += len(line.text) if line.article else 0
    marked = max(mass, key=lambda a: (mass[a], -a), default=0)
    if marked:
        # All of it is article: its links count, and so do all its stretches.
        weights = [len(line.text) if line.article == marked else 0 for line in found]
        stretches = surges(distribution(weights, window), 0)
    else:
        weights = [line.weight for line in found]
        stretches = _of_one_container(found, parents, weights, surges(distribution(weights, window), threshold))
    kept = [
        line.text
        for a, b in stretches
        for line in found[a:b]
        if line.text and (line.article == marked if marked else line.weight * 2 > len(line.text))
    ]
    return "\n".join(kept)


def _of_one_container(
    found: list[Line], parents: list[int], weights: list[int], stretches: list[tuple[int, int]]
) -> list[tuple[int, int]]:
    """The stretches with text in the innermost container around the heaviest."""
    if len(stretches) < 2:
        return stretches
    heaviest = max(stretches, key=lambda s: sum(weights[s[0] : s[1]]))
    held = [0] * len(parents)
    for i in range(*heaviest):
        held[found[i].container] += weights[i]
    for c in range(len(parents) - 1, 0, -1):  # a container opens after the one around it
        held[parents[c]] += held[c]
    around = max(c for c in range(len(parents)) if held[c] == held[0])
    within = [c == around for c in range(len(parents))]
    for c in range(1, len(parents)):
        within[c] = within[c] or within[parents[c]]
    return [s for s in stretches if any(weights[i] and within[found[i].container] for i in range(*s))]


def with_text(pages: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars`` (code points) of the main text of
    column ``html``; ``html`` itself is not returned."""
    ship_package(pages.sparkSession)
    columns = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    kept = pages.select(*(f"`{c}`" for c in columns))
    schema = kept.withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [article_text(h, window, threshold) for h in b.column("html").to_pylist()]
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), *new], names=[*columns, "text", "n_chars"]
            )

    return pages.select(*(f"`{c}`" for c in columns), "html").mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per page."""
    return with_text(pages.select("page_id", "url", "html"))
