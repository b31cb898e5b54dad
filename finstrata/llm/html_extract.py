"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Lines in a block, and the text length at which a block surges.
BLOCK_LINES, SURGE = 3, 86
#: Share of a surge that a line must have to be what surged.
HEAVY = 1 / 3

# Elements of HTML by their role.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = set("nav footer aside form head title button select option dialog menu iframe object svg canvas audio video template noscript textarea".split())
NOISE_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond share sharing social related recommended widget toolbar pagination pager login signup search".split())
HEADER_NAMES = {"header", "masthead", "topbar"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)?/?)>|</?[a-zA-Z][^>]*>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile("[a-z0-9]+")
#: Elements that are part of a run of text, not containers of their own.
FLOW = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th hr address summary details caption".split())
#: Words before a noise word that tell what a page has or lacks.
MODIFIERS = set("no not has have with without hide show is".split())
#: Words that say nothing of what is in an element.
PLAIN_NAMES = set("left right top bottom layout wrapper wrap container page site content main body column columns col row grid inner outer slot box bar block list item items link links unit area zone panel "
                  "pane icon icons button buttons text title heading head posts post articles stories news more field section region holder module count group primary secondary first last".split())
#: Beginnings that make a longer word noise too (``commentlist``).
BEGINNINGS = ("comment", "sidebar", "footer", "navbar", "advert", "breadcrumb", "cookie", "newsletter")
_SURE, _MAYBE = 2, 1


def _noisy(markup: str, names: set[str]) -> int:
    """How sure class, id or role tokens are that the element is noise: _SURE if a token says nothing else, _MAYBE if it has other words too, else 0."""
    out = 0
    for token in " ".join("".join(v) for v in _NAMES.findall(markup)).lower().split():
        words, noise, other = _WORD.findall(token), False, False
        for i, w in enumerate(words):
            if w in names or w.startswith(BEGINNINGS) and w != "commentary":
                noise = noise or not (i and words[i - 1] in MODIFIERS)
            elif w not in PLAIN_NAMES and not w.isdigit():
                other = True
        if noise:
            out = max(out, _MAYBE if other else _SURE)
    return out


class Line:
    """A run of text between two block tags."""

    __slots__ = ("box", "inside", "linked", "named", "noise", "text")

    def __init__(self, text: str, linked: int, noise: bool, inside: bool, named: tuple[int, ...], box: int):
        self.text, self.linked = text, linked  # linked: length inside links
        self.noise, self.inside = noise, inside  # in an element that is noise whatever it holds; in an article or main element
        self.named, self.box = named, box  # elements around it that may be noise; its container


def _lines(page: str) -> tuple[list[Line], list[int]]:
    """The page's lines, and how sure each element that may be noise is of it."""
    lines, parts, stack = [], [], []  # stack: (tag, noise, main, may be noise)
    sure, named, boxes = [], [], [0]
    noise = main = links = linked = n_boxes = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, linked, noise > 0, main > 0, tuple(named), boxes[-1]))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal noise, main, links
        for tag, n, m, own in stack[to:]:
            noise, main, links = noise - n, main - m, links - (tag == "a")
            if own:
                named.pop()
            if tag not in INLINE and tag not in FLOW:
                boxes.pop()
        del stack[to:]

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)

    at = 0
    for m in _MARKUP.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
        else:
            end()
        if m[2]:
            to = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if to is not None:
                pop(to)
        elif tag not in VOID and not (m[4] or "").endswith("/"):
            if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):  # their end tags may be left out
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            is_main = tag in ("article", "main")
            bad, level = tag in NOISE_TAGS and tag != "form" or tag == "header" and not main, _SURE if tag == "form" else 0
            if m[4] and not bad and not is_main and tag not in ("html", "body"):
                level = max(level, _noisy(m[4], NOISE_NAMES if main else NOISE_NAMES | HEADER_NAMES))
            own = level > 0 and not bad
            if own:
                named.append(len(sure))
                sure.append(level)
            if tag not in INLINE and tag not in FLOW:
                n_boxes += 1
                boxes.append(n_boxes)
            stack.append((tag, bad, is_main, own))
            noise, main, links = noise + bad, main + is_main, links + (tag == "a")
    text(page[at:])
    end()
    return lines, sure


def _surges(weight: list[int]) -> tuple[list[int], int]:
    """The sums over windows of BLOCK_LINES lines, and what sum is a surge."""
    block = [sum(weight[i:i + BLOCK_LINES]) for i in range(len(weight))]
    return block, min(SURGE, max(block, default=0))


def _noise(lines: list[Line], sure: list[int]) -> list[bool]:
    """Whether each line is noise.

    What an element's name says counts unless the element holds over half of the page's running text, or of the
    article's, or is the only way to an article; and a name with other words in it only if its lines nowhere surge.
    Where there is an article elsewhere, names count in any case.
    """
    running = [0 if x.noise or 2 * x.linked > len(x.text) else len(x.text) for x in lines]
    plain = [w if not any(sure[k] == _SURE for k in x.named) else 0 for x, w in zip(lines, running, strict=True)]
    held, inside, open_article = [0] * len(sure), [0] * len(sure), False
    total, of_article = sum(running), sum(w for x, w in zip(lines, running, strict=True) if x.inside)
    most = [0] * len(sure)
    for i, (x, w) in enumerate(zip(lines, running, strict=True)):
        open_article = open_article or x.inside and plain[i] > 0
        for k in x.named:
            held[k] += w
            inside[k] += w if x.inside else 0
            if sure[k] == _MAYBE:
                near = [w2 for x2, w2 in zip(lines[i:i + BLOCK_LINES], running[i:i + BLOCK_LINES], strict=True) if k in x2.named]
                most[k] = max(most[k], sum(near))
    wraps = {k for k in range(len(sure)) if (inside[k] or not open_article) and (2 * held[k] > total or of_article and 2 * inside[k] > of_article or sure[k] == _MAYBE and most[k] >= SURGE)}
    if not open_article:  # all articles are inside elements named as noise
        around = [set(x.named) for x in lines if x.inside and not x.noise]
        wraps |= set.intersection(*around) if around else set()
    return [x.noise or any(k not in wraps for k in x.named) for x in lines]


def main_text(page: str | None) -> str:
    """The text between surge and dive points of the page's line blocks, lines joined by one space.

    A line weighs as much as its text; noise (menus, page headers, footers, sidebars, notices, adverts, forms,
    comments; see :func:`_noise`) and lines of links weigh nothing. A block is a window of *BLOCK_LINES* lines. Text
    surges at a heavy line whose block reaches SURGE (or the page's greatest block, if less) and dives at the first
    line whose block doesn't. Lines between surge and dive are kept, and before and after them those of a container
    that a heavy line of theirs stands in: an article's heading, its short lines and its end, but not a notice beside it.

    Where text surges inside an article or main element, or nowhere else, all lines in it that weigh anything are kept,
    lines of links too, and none outside.
    """
    lines, sure = _lines(page or "")
    noise = _noise(lines, sure)
    plain = [0 if bad else len(x.text) for x, bad in zip(lines, noise, strict=True)]
    article = [w if x.inside else 0 for x, w in zip(lines, plain, strict=True)]
    weight = [0 if 2 * x.linked > len(x.text) else w for x, w in zip(lines, plain, strict=True)]
    outside = [0 if x.inside else w for x, w in zip(lines, weight, strict=True)]
    if any(article) and (max(_surges(article)[0]) >= SURGE or max(_surges(outside)[0]) < SURGE):
        return " ".join(x.text for x, w in zip(lines, article, strict=True) if w)
    block, surge = _surges(weight)
    between, on = [], False
    for w, b in zip(weight, block, strict=True):
        on = b >= surge and (on or w >= HEAVY * surge)
        between.append(on and w > 0)
    boxes = {x.box for x, w, k in zip(lines, weight, between, strict=True) if k and w >= HEAVY * surge}
    return " ".join(x.text for x, w, k in zip(lines, weight, between, strict=True) if k or w and x.box in boxes)


def _main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text`` (main text of the whole html) and ``n_chars`` (its code points) to each row of *df*.

    Null or empty html and pages without text give an empty text and 0. Rows stay as they are, repeated ones too;
    columns of *df* named like the added ones are replaced.
    """
    main_text_of = pandas_udf(_main_texts, StringType())
    return df.withColumn("text", main_text_of(html)).withColumn("n_chars", F.length("text").cast("long"))
