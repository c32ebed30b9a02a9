"""Main text of HTML pages by tag-path ratios.

A page is walked once and gives blocks in page order, each with its root-to-leaf path (tag and first class per
step, inline tags left out). Per path the text length, link length, punctuation and number of blocks are
aggregated. Fused, they say how much running text a block of the path holds; the values are smoothed along the
page and averaged per path, and paths below the threshold (the standard deviation over the page, at most the
mean) go. All paths of all pages are judged so. What the markup states is fused in as weight: a block inside
<article> or <main> gains the greatest value of the page times its share of text outside links, so running text in
there passes (with a linked headline), link lists in there and text beside it pass by their ratios alone. Menus, page
headers, footers, asides, forms, adverts, notices and comment lists never pass, but an <article> or <main> that only
the name of a wrapper (sidebar, header, modal, ...) puts there is judged like any other. A class, id or role marks by
its whole name: site-footer does, has-sidebar and entry-header do not.

A page is one row and is handled alone, so nothing is shuffled and tasks hold one batch of pages.

Defined cases: null, empty or text-free html gives "". Broken markup (missing or crossed end tags, an open
comment or tag at the end) is read as browsers do in the main: a block closes an open paragraph, an end tag
without start is skipped. Repeated rows give repeated results; ids and urls are carried as they are, null
too; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+>|[^>]*>)|<[!?/][^>]*>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WHITE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Elements whose content is never main text.
DROPPED = frozenset(
    "head title script style noscript template svg math canvas iframe object audio video map nav footer aside form button select textarea option dialog menu".split()
)
CONTENT = frozenset("article main".split())
#: Elements of headlines, which may be links to the page itself; not those in lists.
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that mark what is not main text, wherever it is.
NEVER = frozenset(
    "ad ads adv banner cookie cookies consent gdpr comment comments commentlist replies reply disqus related newsletter subscribe subscription".split()
)
#: Words of places beside the main text; an <article> or <main> that such a place holds is main text all the same.
BESIDE = frozenset(
    "notice notices alert menu nav navbar navigation sidebar side footer header masthead share sharing social widget breadcrumb breadcrumbs popup modal overlay login signup search contentinfo complementary hidden".split()
)
NEVER_FROM = re.compile(r"(?:advert|sponsor|promo|recommend)[^\W\d_]*")
#: Words that may stand beside marking ones in a name, as in site-footer; any other word makes it another name (has-sidebar).
PLAIN = frozenset("site page main top bottom left right global primary secondary bar box slot unit wrapper list block area section container links buttons icons item items".split())
#: Names that mark main text.
STATED = frozenset("main main-content content-main articlebody article-body post-content entry-content post-body entry-body".split())
#: How a place is left out: not, unless <article> or <main> is in it, in any case.
TAKEN, ASIDE, OUT = 0, 1, 2
#: What a start tag closes, up to the nearest of the tags named second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def mark(names: list[str]) -> int:
    """How an element with these names (classes, id, role) is left out. A name counts as a whole: its words mark
    something or are plain."""
    found = TAKEN
    for name in names:
        own = TAKEN
        for word in re.split(r"[-_\d]+", name):
            if word in NEVER or NEVER_FROM.fullmatch(word):
                own = OUT
            elif word in BESIDE:
                own = max(own, ASIDE)
            elif word and word not in PLAIN:
                break
        else:
            found = max(found, own)
    return found


class Block:
    __slots__ = ("path", "parts", "links", "content", "headline")

    def __init__(self, path: int, content: bool, headline: bool) -> None:
        self.path, self.content, self.headline = path, content, headline
        self.parts: list[str] = []
        self.links = 0


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, without what is left out."""
    found: list[Block] = []
    # open elements: tag, path of blocks, in content, how left out, in a link
    stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, TAKEN, False)]
    # paths are numbered by (path above, element and class), so a deep one costs no more than a short one
    paths: dict[tuple[int, str], int] = {}
    headline, in_list = [False], [False]
    fresh = True  # the next text begins a block
    at = 0

    def text(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        _, path, content, dropped, link = stack[-1]
        if dropped:  # an inline element that is left out takes its own text along and not its block's
            return
        if fresh:
            if raw.isspace():
                return
            found.append(Block(path, content, headline[path]))
            fresh = False
        block = found[-1]
        raw = entities.unescape(raw) if "&" in raw else raw
        block.parts.append(raw)
        if link:
            block.links += len(raw)

    def close(names: set[str], until: set[str]) -> None:
        nonlocal fresh
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in until:
                return
            if stack[k][0] in names:
                del stack[k:]
                fresh = True
                return

    last = page.rfind(">") + 1  # a tag that begins behind it never ends
    while m := TOKEN.search(page, at, last):
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)  # a comment that never ends
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            if tag not in INLINE:
                fresh = True
            continue
        if tag == "br":
            if not fresh:
                text("\n")
            continue
        if tag not in INLINE:
            fresh = True
            if tag not in VOID:
                close({"p"}, {"article", "section", "div", "td", "th", "li", "body", "main", "aside", "blockquote"})
            if tag in CLOSES:
                close(*CLOSES[tag])
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        _, path, content, dropped, link = stack[-1]
        if m[3] == ">":
            names, first, out = [], "", TAKEN
        else:
            given: dict[str, str] = {}
            for a in ATTRIBUTE.findall(m[3]):
                given.setdefault(a[0].lower(), a[1] or a[2] or a[3])
            names = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".lower().split()
            first = given.get("class", "").split(" ", 1)[0]
            unseen = "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true"
            out = OUT if unseen or re.search(r"display\s*:\s*none", given.get("style", ""), re.I) else TAKEN
        states = tag in CONTENT or (tag not in INLINE and not STATED.isdisjoint(names))
        if states and dropped == ASIDE:
            dropped = TAKEN
        if tag not in ("html", "body"):
            if tag in DROPPED:
                out = OUT
            elif names:
                out = max(out, mark([n for n in names if not (content and n == "header")]))
            if tag == "header" and not content:
                out = max(out, ASIDE)
        dropped = max(dropped, out)
        content = content or states
        if tag not in INLINE:
            above, path = path, paths.setdefault((path, f"{tag}.{first}" if first else tag), len(paths) + 1)
            if path == len(headline):
                in_list.append(in_list[above] or tag == "li")
                headline.append(tag in HEADLINES and not in_list[path])
        if not (m[3].endswith("/>") and tag in ("svg", "path")):
            stack.append((tag, path, content, dropped, link or tag == "a"))
    text(page[at:].split("<!--", 1)[0])
    return found


def selected(values: np.ndarray, paths: list[int], stated: np.ndarray) -> np.ndarray:
    """Which blocks pass: the values, smoothed along the page and fused with what the path has by itself and with what
    the markup states (0 to 1), reach the threshold in the mean of the path, or by the stated weight of the block."""
    padded = np.pad(values, 1, mode="edge")
    fused = np.sqrt(values * (0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]))
    fused += fused.max() * stated
    threshold = min(fused.std(), fused.mean())
    _, which = np.unique(paths, return_inverse=True)
    mean = np.bincount(which, fused) / np.bincount(which)
    return (mean[which] >= threshold) | ((stated > 0) & (fused >= threshold))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = []
    for b in blocks(page):
        own = WHITE.sub(" ", "".join(b.parts)).strip()
        if own:
            found.append((b, own))
    if not found:
        return ""
    # an id may make content of one of two equal paths
    paths = [2 * b.path + b.content for b, _ in found]
    sums: dict[int, list[float]] = {}
    stated = []
    for path, (b, own) in zip(paths, found, strict=True):
        links = 0 if b.content and b.headline else min(b.links, len(own))
        s = sums.setdefault(path, [0, 0, 0, 0])
        s[0] += len(own)
        s[1] += links
        s[2] += len(PUNCTUATION.findall(own))
        s[3] += 1
        stated.append((len(own) - links) / len(own) if b.content else 0.0)
    ratio = {path: (length - links) / n * (1 + marks / n) for path, (length, links, marks, n) in sums.items()}
    kept = selected(np.array([ratio[path] for path in paths]), paths, np.array(stated))
    return "\n\n".join(own for (_, own), passes in zip(found, kept, strict=True) if passes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low : low + 1000]
                out = [main_text(h) if isinstance(h, str) else "" for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64").array, "url": part["url"].array, "text": out, "n_chars": [len(t) for t in out]})

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInPandas(texts, "page_id long, url string, text string, n_chars long")
