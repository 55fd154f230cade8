"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each by where it stands (menu,
advert, form, article and the like, from tag names and the words of class, id and role), by its share of
link text, its length and its share of stop words; a long block with few stop words is good if it is poor in
links, whatever its language; short blocks outside an article stay ambiguous. Words of class, id and role never mark the page, its articles or what holds them, and
in what they mark a long block that is rich in stop words and poor in links is good (but for adverts, notices of cookies and
comments). A form is marked like that, unless it holds an article or most of the page's text; its controls are dropped. In the second pass an ambiguous block takes the class of its nearest decided
neighbour. The text of the good blocks is the page's text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from string import punctuation

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, whole_text

#: A comment, a declaration, or a tag with its attributes; at the end of the page a tag may be cut off.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
                     |<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["']""")
#: What an element's attributes must hold somewhere before they are taken apart.
SOME = re.compile("hidden|display|class|id|role", re.I)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset("head script style noscript template svg math canvas object iframe audio video map select option button textarea "
                    "title xmp noembed noframes nav footer aside dialog menu label input datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
                   "thead tr ul caption head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends an open element of the same group, up to the nearest of the group's containers.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of class, id or role that mark what is no article.
MARKS = frozenset("ad ads adbox adslot adunit adsense advert advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu "
                  "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
                  "newsletter subscribe subscription signup login search share sharing social related recommended recommendations widget "
                  "comment comments disqus discussion reply replies respond responses toolbar pagination pager copyright legal disclaimer skip paywall contentinfo "
                  "complementary dialog form".split())
HEADER_MARKS = frozenset(("header", "topbar", "top"))
#: Words beside a mark in one class token that leave it a mark (site-footer, ad-slot); any other does not (has-sidebar, tag-social).
BESIDE = frozenset("area bar block blocks body bottom box btn button buttons container content global icon icons inner item items left link links list main "
                   "outer page panel post posts primary right row secondary section site slot title top unit wrap wrapper".split())
#: Marks of readers' comments, which are often articles of their own.
COMMENTS = frozenset("comment comments disqus discussion reply replies respond responses".split())
#: Marks of what is never part of an article, however long its text, unless an article is inside.
NEVER = COMMENTS | frozenset("cookie cookies consent gdpr newsletter ad ads adbox adslot adunit advert advertisement advertising sponsor sponsored".split())
#: Letters of scripts that write a word in one or two of them, without blanks between words.
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
#: Function words of English, French, German and Spanish: the default of ``Rules.stop_words``.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his i if in is it its not of on or she so that the their "
    "they this to was we were which will with would you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur ne ou par pas pour qu que qui sa se ses son sont sur un une "
    "aber als am auch auf aus bei das dem den der des die ein eine einer es für hat ich ihr im ist mit nach nicht noch oder sich sie "
    "sind über um und von war wie wird zu zum zur "
    "al como con del el era esta este fue ha las lo los más no o para pero por se sin su sus también una y ya".split())

GOOD, BAD, AMBIGUOUS = 1, 0, None


@dataclass
class Rules:
    """Limits of the first pass: link share of a bad block, length in characters and stop-word share of a good one;
    the marked ones are for blocks in an element that a class, id or role marks. Stop words are those of the pages'
    languages; blocks in others are decided by length and link share."""

    link_share: float = 0.4
    length: int = 70
    stop_share: float = 0.15
    marked_length: int = 200
    marked_stop_share: float = 0.3
    stop_words: frozenset[str] = STOP_WORDS


@dataclass
class Block:
    text: str
    linked: int
    marked: bool
    in_article: bool
    heading: bool
    wrapped: bool = False
    never: bool = False


class Wrap:
    """An element marked by the words of its class, id or role, or a form, and the one around it. An article inside
    lifts the mark, as does most of the page's text inside a form: some servers put one around the whole page."""

    __slots__ = ("comments", "never", "form", "lifted", "around", "chars", "longest")

    def __init__(self, marks: set[str], form: bool, around: Wrap | None) -> None:
        self.comments, self.never, self.form = bool(marks & COMMENTS), bool(marks & NEVER), form and not marks
        self.lifted, self.around, self.chars, self.longest = 0, around, 0, 0

    def lift(self, by: int) -> None:
        """An article (1) or a main element (2) is inside."""
        wrap: Wrap | None = self
        while wrap is not None and wrap.lifted < by:
            if by == 2 or not wrap.comments:
                wrap.lifted = by
            wrap = wrap.around


def _attributes(attributes: str) -> dict[str, str]:
    """Names in small letters, and values; the first of a name counts."""
    out: dict[str, str] = {}
    if attributes and SOME.search(attributes):
        for name, value in ATTRIBUTE.findall(attributes):
            if name:
                out.setdefault(name.lower(), value.strip("\"'"))
    return out


def _left_out(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article) or "hidden" in attributes:
        return True
    return attributes.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(attributes.get("style", "")))


def _marks(attributes: dict[str, str], in_article: bool) -> set[str]:
    """The marks among the whole tokens of class, id and role."""
    out: set[str] = set()
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").lower().split():
            pieces = [w for w in SPLIT.split(token) if len(w) > 1]
            found = {w for w in pieces if w in MARKS or (not in_article and w in HEADER_MARKS)}
            if found and all(w in found or w in BESIDE for w in pieces):
                out |= found
    return out


def _place(found: list[Block], wraps: list[Wrap | None], length: int) -> None:
    """Which blocks are in something marked, and in what never counts."""
    total = 0
    for b, wrap in zip(found, wraps):
        if b.marked:
            continue
        total += len(b.text) - b.linked
        if wrap is not None:
            wrap.chars += len(b.text) - b.linked
            wrap.longest = max(wrap.longest, len(b.text) - b.linked)
    known: dict[int, Wrap] = {}
    for wrap in wraps:
        while wrap is not None and id(wrap) not in known:
            known[id(wrap)] = wrap
            wrap = wrap.around
    depth: dict[int, int] = {}
    for wrap in known.values():
        chain = []
        while wrap is not None and id(wrap) not in depth:
            chain.append(wrap)
            wrap = wrap.around
        for w in reversed(chain):
            depth[id(w)] = depth[id(w.around)] + 1 if w.around is not None else 0
    order = sorted(known.values(), key=lambda w: depth[id(w)])
    for w in reversed(order):  # what is inside counts for what is around
        if w.around is not None:
            w.around.chars += w.chars
            w.around.longest = max(w.around.longest, w.longest)
    state: dict[int, tuple[bool, bool]] = {}
    for w in order:
        held, never = state[id(w.around)] if w.around is not None else (False, False)
        lifted = w.lifted or (w.form and 2 * w.chars >= total and w.longest >= length)
        state[id(w)] = (held or not lifted, never or (w.never and not lifted))
    for b, wrap in zip(found, wraps):
        b.wrapped, b.never = state[id(wrap)] if wrap is not None else (False, False)


def blocks(html: str, length: int = 70) -> list[Block]:
    """The blocks of a page that have text, in page order, with references decoded and blanks collapsed."""
    out: list[Block] = []
    wraps: list[Wrap | None] = []
    # tag, what it is in (0: nothing left out, 1: something left out, 2: the same inside a line, 3: something marked inside a line),
    # in an article, in a link, the innermost marked element
    stack: list[tuple[str, int, bool, bool, Wrap | None]] = []
    parts: list[tuple[str, bool, bool, bool, Wrap | None]] = []
    heading = False
    n_open: Counter[str] = Counter()  # of each tag on the stack

    def end_block() -> None:
        if parts:
            text = " ".join("".join(t for t, *_ in parts).split())
            if text:
                linked = len(" ".join("".join(t for t, a, *_ in parts if a).split()))
                _, _, marked, in_article, wrap = next(x for x in parts if x[0].strip())
                out.append(Block(text, linked, marked, in_article, heading))
                wraps.append(wrap)
            parts.clear()

    def pop_to(at: int) -> None:
        outside = bool(at) and stack[at - 1][1] == 1
        if any(t in BLOCKS or (m == 1) != outside for t, m, *_ in stack[at:]):
            end_block()
        n_open.subtract(x[0] for x in stack[at:])
        del stack[at:]

    def add(text: str) -> None:
        _, marked, in_article, link, wrap = stack[-1] if stack else ("", 0, False, False, None)
        if text and marked < 2:
            parts.append((unescape(text), link, marked == 1, in_article, wrap))

    at = 0
    while True:
        m = TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if n_open[tag] > 0:
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag in BLOCKS:
                end_block()
            heading = False if tag in HEADINGS else heading
            continue
        if tag in BLOCKS:
            # a block ends an open paragraph; an item ends the one before it
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or (stack[k][0] in BLOCKS)), None)
            if k is not None and stack[k][0] == "p":
                pop_to(k)
            if tag in SIBLINGS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag or (tag in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                        pop_to(k)
                        break
                    if stack[k][0] in SIBLINGS[tag]:
                        break
            end_block()
            heading = tag in HEADINGS
        elif tag == "br":
            add(" ")
        if tag in VOID:
            continue
        _, marked, in_article, link, wrap = stack[-1] if stack else ("", 0, False, False, None)
        now, attributes = marked, _attributes(m[3])
        if marked in (0, 3):
            if _left_out(tag, attributes, in_article):
                now = 1 if tag in BLOCKS else 2  # inside a line its text is left out and the line goes on
            else:
                now = 0 if tag in BLOCKS else marked
                found = _marks(attributes, in_article) if attributes and tag not in ("html", "body", "main") else set()
                # an article in an article is marked like any element; of the others only one of comments is
                own = tag == "article" and not n_open["article"]
                if (found and (not own or found & COMMENTS)) or tag == "form":
                    wrap = Wrap(found, tag == "form", wrap)
                    now = 0 if tag in BLOCKS else 3
                if wrap is not None and (tag == "main" or own):
                    wrap.lift(2 if tag == "main" else 1)
        elif marked == 2 and tag in BLOCKS:
            now = 1
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if (m[3] or "").rstrip().endswith("/") and tag in ("svg", "math", "path"):
            continue
        n_open[tag] += 1
        stack.append((tag, now, in_article or tag in ("article", "main"), link or tag == "a", wrap))
    end_block()
    _place(out, wraps, length)
    return out


def _stop_share(text: str, stop_words: frozenset[str]) -> float:
    found = text.lower().split()
    return sum(w.strip(punctuation) in stop_words for w in found) / len(found)


def _length(text: str) -> int:
    """Characters; a letter that stands for about half a word counts three."""
    return len(text) if text.isascii() else len(text) + 2 * len(DENSE.findall(text))


def classify(block: Block, rules: Rules) -> int | None:
    """First pass, of a block by itself."""
    if block.marked or block.never:
        return BAD
    n = len(block.text)
    if block.linked > rules.link_share * n and not (block.in_article and block.heading):
        return BAD
    if block.wrapped:
        return GOOD if n >= rules.marked_length and _stop_share(block.text, rules.stop_words) >= rules.marked_stop_share else BAD
    if block.in_article:
        return GOOD
    if block.heading or _length(block.text) < rules.length:
        return AMBIGUOUS
    return GOOD if _stop_share(block.text, rules.stop_words) >= rules.stop_share else AMBIGUOUS


def first_pass(found: list[Block], rules: Rules) -> list[int | None]:
    """The classes of a page's blocks. A long block that has few stop words (another language, a table, code, names)
    is good if it is poor in links, at most half the link share of a bad block; only other blocks may inherit."""
    out = [classify(b, rules) for b in found]
    for i, b in enumerate(found):
        if out[i] is AMBIGUOUS and not b.heading and b.linked <= rules.link_share / 2 * len(b.text) and _length(b.text) >= rules.length:
            out[i] = GOOD
    return out


def inherit(classes: list[int | None], headings: list[bool]) -> list[int]:
    """Second pass: the nearest decided neighbour's class. At equal distance a heading takes the next one's,
    any other block the one's before it; without any decided block all are good."""
    n = len(classes)
    before, after = [n + 1] * n, [n + 1] * n
    for i in range(n):
        before[i] = 0 if classes[i] is not None else (before[i - 1] + 1 if i else n + 1)
    for i in range(n - 1, -1, -1):
        after[i] = 0 if classes[i] is not None else (after[i + 1] + 1 if i < n - 1 else n + 1)
    out = []
    for i in range(n):
        if min(before[i], after[i]) > n:
            out.append(GOOD)
        elif before[i] < after[i] or (before[i] == after[i] and not headings[i]):
            out.append(classes[i - before[i]])
        else:
            out.append(classes[i + after[i]])
    return out


def main_text(html: str, rules: Rules = Rules()) -> tuple[str, int, int]:
    """The text of the good blocks joined by line ends, the number of good blocks and of all."""
    found = blocks(html, rules.length)
    kept = inherit(first_pass(found, rules), [b.heading for b in found])
    good = [b.text for b, k in zip(found, kept) if k]
    return "\n".join(good), len(good), len(found)


def extract_html(pages: DataFrame, html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """``pages`` with ``text``, ``n_chars`` (its code points), ``n_blocks_kept`` and ``n_blocks``.

    Null and empty pages have the empty text, as have pages of markup only. Markup may be broken, cut off or
    nested wrongly anywhere. Columns by the names of the new ones are replaced.
    """
    @F.pandas_udf("text string, n_blocks_kept bigint, n_blocks bigint")
    def extract(col: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in col:
            yield pd.DataFrame([main_text(h, rules) for h in html], columns=["text", "n_blocks_kept", "n_blocks"])

    at = fresh(pages, "extracted_")
    out = pages.withColumn(at, extract(whole_text(html_col))).drop("text", "n_chars", "n_blocks_kept", "n_blocks")
    found = {c: F.col(f"{at}.{c}") for c in ("text", "n_blocks_kept", "n_blocks")}
    return out.withColumns({"text": found["text"], "n_chars": F.length(found["text"]).cast("long"),
                            "n_blocks_kept": found["n_blocks_kept"], "n_blocks": found["n_blocks"]}).drop(at)
