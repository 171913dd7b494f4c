"""Main text of web pages by tag-path ratios.

Every block of text has a root-to-leaf path of open elements.  Text length and punctuation are added up per path of a page
and divided by the number of its blocks; a path of article text has much of both, menus and notices have little.  Along
the page the ratios are smoothed with a Gaussian, so that a heading between paragraphs rises and a stray sentence in a
menu sinks.  Length, punctuation, the share of text outside links and what the elements themselves say (an article, a
footer, a class "advert") are fused into one score per path, and paths above a threshold are content.  A page is one row,
so pages are scored where they lie, without a shuffle: a task cuts a batch of pages into blocks and does the sums over all
paths of the batch at once.

Defined cases: NULL or empty html, or html without content, gives an empty text; unclosed elements, comments and tags end
with the page; repeated pages, NULL ids and clashing or further columns change nothing, as each row is judged by its html
alone.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cloudframe.llm.common import C

# Elements of HTML by their role, and what class, id and role attributes say about an element.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var wbr img button label select option svg canvas object output picture audio video input map math".split())
BOILERPLATE = set("nav header footer aside form script style noscript button select option textarea template iframe object canvas svg head title "
                  "dialog menu input label".split())
MAIN = {"article", "main"}
BAD_WORDS = set("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion nav navbar navigation "
                "menu menubar footer sidebar aside breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notification alert banner "
                "popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion "
                "share sharing social related recommended widget toolbar search masthead complementary contentinfo tooltip hidden".split())
GOOD_WORDS = set("article articlebody main maincontent content post postbody entry story".split())
HEADER_WORDS = {"header", "head", "masthead"}
SAYS_NOTHING = {"has", "no", "with", "without", "is", "js"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
P_ENDS_AT = {"table", "td", "th", "button", "object"}
#: Elements whose start ends an open element of the same group.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡«»\"“”]")

#: Standard deviation of the smoothing in blocks; least share of the page's best score, in pages that mark no main part and in a main part.
SIGMA, THRESHOLD, MAIN_THRESHOLD = 1.0, 0.25, 0.001
_KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)


class _Element:
    __slots__ = ("tag", "path", "bad", "main")

    def __init__(self, tag: str, path: int, bad: bool, main: bool):
        self.tag, self.path, self.bad, self.main = tag, path, bad, main


def _tokens(value: str) -> Iterator[list[str]]:
    """The words of each name in a class, id or role; names like ``no-sidebar`` say nothing about their element."""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in SAYS_NOTHING:
            yield [name.lower(), *words]


def _opened(tag: str, attributes: str, parent: _Element, paths: dict[tuple[int, str], int]) -> _Element:
    """The element with its path (inline elements are no part of it), and whether it or one around it is boilerplate or main."""
    words, hides = set(), False
    if "=" in attributes or "hidden" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role", "itemprop"):
                words.update(w for token in _tokens(value) for w in token)
            hides |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", ""))
    page, named = tag in ("html", "body"), bool(words & BAD_WORDS)
    main = parent.main or tag in MAIN or (tag not in INLINE and not page and not named and bool(words & GOOD_WORDS))
    bad = parent.bad or hides or (named and not page and tag not in MAIN)
    # The header of an article holds its title; any other is the page's.
    if tag in BOILERPLATE and not (tag == "header" and parent.main):
        bad = True
    if words & HEADER_WORDS and not main and not page and tag not in HEADINGS:
        bad = True
    path = parent.path if tag in INLINE else paths.setdefault((parent.path, tag), len(paths) + 1)
    return _Element(tag, path, bad, main and not bad)


def blocks(page: str) -> list[tuple[int, str, bool, bool, int, bool]]:
    """``path, text, boilerplate, main, characters in links, heading`` of each block of text, in page order; paths are numbers."""
    out, parts, linked = [], [], 0
    stack, opened = [_Element("", 0, False, False)], Counter()
    paths: dict[tuple[int, str], int] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = next(e for e in reversed(stack) if e.tag not in INLINE)
                out.append((at.path, text, at.bad, at.main, min(linked, len(text)), at.tag in HEADINGS))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if opened["bad inline"]:
            return  # a button in a paragraph
        text = references.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if opened["a"]:
            linked += len(text.strip())

    def start(element: _Element) -> None:
        stack.append(element)
        opened[element.tag] += 1
        opened["bad inline"] += element.bad and element.tag in INLINE

    def end(k: int, all_above: bool = True) -> None:
        gone = stack[k:] if all_above else stack[k:k + 1]
        if all_above:
            flush()
        for e in gone:
            opened[e.tag] -= 1
            opened["bad inline"] -= e.bad and e.tag in INLINE
        del stack[k:k + len(gone)]

    def innermost(tags: set[str], borders: set[str]) -> int:
        """Place of the innermost open element of ``tags``, 0 if there is none within ``borders``."""
        if any(opened[tag] for tag in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return k
                if stack[k].tag in borders:
                    return 0
        return 0

    at, size = 0, len(page)
    while at < size:
        sign = page.find("<", at)
        if sign < 0:
            say(page[at:])
            break
        token = _TOKEN.match(page, sign)
        if token is None:  # a lone sign
            say(page[at:sign + 1])
            at = sign + 1
            continue
        if sign > at:
            say(page[at:sign])
        at = token.end()
        if token[2] is None or token[4] != ">":
            continue
        tag = token[2].lower()
        if tag == "br":
            parts.append(" ")
        elif token[1]:
            if k := innermost({tag}, set()):
                end(k, tag not in INLINE)
        else:
            if tag in ENDS and (k := innermost(*ENDS[tag])):
                end(k)
            if tag == "a" and (k := innermost({"a"}, set())):
                end(k, False)
            if tag not in INLINE:
                flush()
                if k := innermost({"p"}, P_ENDS_AT):
                    end(k)
                if tag in HEADINGS and stack[-1].tag in HEADINGS:
                    end(len(stack) - 1)
            if tag in RAW:
                closing = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = closing.end() if closing else size
            elif tag not in VOID:
                start(_opened(tag, token[3], stack[-1], paths))
    flush()
    return out


def _chosen(page: np.ndarray, path: np.ndarray, length: np.ndarray, punctuation: np.ndarray, linked: np.ndarray, bad: np.ndarray,
            main: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """Which blocks of a batch of pages are content; ``page`` rises, ``path`` numbers the paths of each page."""
    count = np.maximum(np.bincount(path), 1)
    ratio = lambda values: (np.bincount(path, values) / count)[path]
    text, points = ratio(length), ratio(punctuation)
    # Smoothing along the blocks of a page; weights that fall off its ends are left out.
    smooth = []
    for values in (text, points):
        total, weight = np.zeros(len(values)), np.zeros(len(values))
        for shift, k in zip(range(-3, 4), _KERNEL):
            if abs(shift) >= len(values):
                continue
            a, b = (slice(max(0, -shift), len(values) - max(0, shift)), slice(max(0, shift), len(values) - max(0, -shift)))
            same = page[a] == page[b]
            total[a] += k * values[b] * same
            weight[a] += k * same
        smooth.append(total / weight)
    free = 1 - np.bincount(path, linked)[path] / np.maximum(np.bincount(path, length)[path], 1)
    fused = lambda values: np.log1p(values[0]) * (0.5 + np.log1p(values[1]))
    around = ratio(fused(smooth))
    # A heading is judged by what is around it, any other path by that and by itself.
    score = np.where(heading, around, np.sqrt(around * fused((text, points)))) * np.where(free > 0.5, free, 0.0) * ~bad
    # Where a page marks its main part, what lies beside it is none of it.
    marked = np.zeros(page.max() + 1, bool)
    marked[page[main & (score > 0)]] = True
    score = np.where(marked[page] & ~main, 0.0, score)
    best = np.zeros(page.max() + 1)
    np.maximum.at(best, page, score)
    return (score > 0) & (score >= np.where(marked, MAIN_THRESHOLD, THRESHOLD)[page] * best[page])


def extract(rows: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the blocks of content of every page, joined by line breaks, and their code points."""
    kinds = [rows.schema[c].dataType.simpleString() for c in (page_id, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts([h or "" for h in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["_id", "_url", "text", "n_chars"])

    found = rows.select(C(page_id).alias("_id"), C(url).alias("_url"), C(html).alias("_html")).mapInArrow(
        run, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars bigint")
    return found.select(C("_id").alias(page_id), C("_url").alias(url), "text", "n_chars")


def _texts(pages: list[str]) -> list[str]:
    owner, names, found = [], [], []
    for i, page in enumerate(pages):
        for block in blocks(page):
            owner.append(i)
            names.append(block[0])
            found.append(block)
    if not found:
        return [""] * len(pages)
    numbers: dict[tuple[int, int, bool, bool], int] = {}
    # A path is one of its page; boilerplate and content under the same elements are told apart.
    path = np.array([numbers.setdefault((i, b[0], b[2], b[3]), len(numbers)) for i, b in zip(owner, found)])
    length = np.array([len(b[1]) for b in found], float)
    punctuation = np.array([len(_PUNCTUATION.findall(b[1])) for b in found], float)
    linked, bad, main, heading = (np.array([b[k] for b in found], kind) for k, kind in ((4, float), (2, bool), (3, bool), (5, bool)))
    chosen = _chosen(np.array(owner), path, length, punctuation, linked, bad, main, heading)
    kept: list[list[str]] = [[] for _ in pages]
    for i, b, yes in zip(owner, found, chosen):
        if yes:
            kept[i].append(b[1])
    return ["\n".join(k) for k in kept]
