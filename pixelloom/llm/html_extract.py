"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf tag path. For every
path the text length and the punctuation are summed over its nodes; ratios per node are
smoothed over the path's neighbours in the tree, fused (a geometric mean), and paths above a
threshold select the content nodes. Parts that are never article text (scripts, menus,
forms, notices, adverts, reader comments) are left out before anything is counted.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Elements that stand in a line of text without ending its block.
IN_LINE = INLINE | frozenset("audio button canvas img input iframe label link map area meter noscript object output picture progress script select source style svg template textarea track video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split())
CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "h1": {"h1"}, "h2": {"h2"}, "h3": {"h3"}}
SCOPE = frozenset("table ul ol dl article section main aside div body html".split())
# Elements and roles that never hold article text, and words that name such parts.
LEFT_OUT = frozenset("head script style noscript template iframe svg canvas object nav footer aside form button select textarea option dialog menu audio video map math".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar rail footer colophon masthead comment comments commentlist discussion replies reply respond disqus "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations trending widget toolbar pagination pager copyright disclaimer skip hidden".split()
)
# Words that go with such a name and leave its meaning (as in ad-box); any other word changes it (has-sidebar).
NEUTRAL = frozenset("area bar block bottom box btn button container form global group head header heading holder icon inline inner item items left link links list main module outer page panel primary right row secondary section site slot text title top unit wrap wrapper".split())
BODY = frozenset("article main content body entry post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、»«”“]")
#: Of the best path's fused ratio: a path from here on is content.
THRESHOLD = 0.15
#: Steps between two paths; at more the weight exp(-d * d / 4) is 0.0 as a double.
REACH = 54
#: Factor of paths outside of every article and main element.
UNNAMED = 0.5


class Page:
    """The text nodes of a page: their block, path and chain of open elements."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, tuple[str, ...], tuple[int, ...], str]] = []
        self.block = 0
        self._open: list[tuple[str, str, int, bool]] = []  # name, label, element, left out
        self._count = 0
        self._read(source)

    def _text(self, raw: str) -> None:
        if raw and not (self._open and self._open[-1][3]):
            path = tuple(x[1] for x in self._open)
            self.nodes.append((self.block, path, tuple(x[2] for x in self._open), html.unescape(raw)))

    def _close(self, name: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == name:
                del self._open[i:]
                return
            if name in INLINE and self._open[i][0] not in INLINE:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i][0] == "p":
                    del self._open[i:]
                    break
                if self._open[i][0] not in INLINE:
                    break
        if like := CLOSED_BY_LIKE.get(name):
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i][0] in like:
                    del self._open[i:]
                    break
                if self._open[i][0] in SCOPE:
                    break
        label, out = name, bool(self._open and self._open[-1][3])
        out = out or name in LEFT_OUT
        inside = any(x[0] in ("article", "main") for x in self._open)
        out = out or (name == "header" and not inside)
        if attributes.strip():
            given = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
            tokens = [set(NAME.findall(CAMEL.sub(r"\1-\2", x).lower())) for x in f"{given.get('class', '')} {given.get('id', '')}".split()]
            names = set().union(*tokens)
            named = any(x & NAMES and x <= NAMES | NEUTRAL for x in tokens)
            if given.get("class"):
                label = f"{name}.{given['class'].split()[0] if given['class'].split() else ''}"
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""))
            part = named or ("header" in names and not inside and not names & BODY)
            if name not in ("html", "body", "article", "main") and (part or given.get("role", "").lower() in ROLES or hidden):
                out = True
        if name not in VOID:
            self._count += 1
            self._open.append((name, label, self._count, out))

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            self._text(source[at : m.start() if m else len(source)])
            if not m:
                # A tag cut off by the end of the page is no text.
                if self.nodes and (cut := re.search(r"<[/!?a-zA-Z][^<>]*$", source[at:])):
                    block, path, chain, _ = self.nodes[-1]
                    if not (self._open and self._open[-1][3]):
                        self.nodes[-1] = (block, path, chain, html.unescape(source[at:][: cut.start()]))
                return
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if ending:
                self._close(name)
            # What stands inside a part that is left out ends no block of the text around it.
            if name not in IN_LINE and not (self._open and self._open[-1][3]):
                self.block += 1
            if not ending:
                self._start(name, attributes)
                if name in RAW and not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?|$", re.I).search(source, at)
                    if name == "noscript" or name == "title" or not end:
                        pass
                    at = end.end()
                    self._close(name)


def path_scores(nodes: list[tuple[int, tuple[str, ...], tuple[int, ...], str]]) -> dict[tuple[str, ...], float]:
    """Fused, smoothed text and punctuation ratios of every tag path.

    Sums by distance go up the tree of paths and down again, so every path weighs in at any
    number of paths; they are integers (tenths of signs), so the order of adding is of no matter.
    """
    sums: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0, 0])
    for _, path, _, text in nodes:
        if bare := text.strip():
            share = 1 if "a" in path else 10  # text of links counts little
            at = sums[path]
            at[0] += len(bare) * share
            at[1] += len(PUNCTUATION.findall(bare)) * share
            at[2] += 1
    if not sums:
        return {}
    child: dict[tuple[int, str], int] = {}
    parent, levels, ends = [0], [[0]], []
    for path in sums:
        at = 0
        for depth, name in enumerate(path, 1):
            if (step := child.get((at, name))) is None:
                step = child[at, name] = len(parent)
                parent.append(at)
                if depth == len(levels):
                    levels.append([])
                levels[depth].append(step)
            at = step
        ends.append(at)
    reach = min(REACH, 2 * (len(levels) - 1))
    over = np.array(parent)
    below = np.zeros((len(parent), reach + 1, 3), np.int64)
    below[ends, 0] = list(sums.values())
    for level in map(np.array, reversed(levels[1:])):
        np.add.at(below[:, 1:], over[level], below[level, :-1])
    around = below.copy()
    for level in map(np.array, levels[1:]):
        around[level, 1:] += around[over[level], :-1]
        around[level, 2:] -= below[level, :-2]
    weight = np.exp(-(np.arange(reach + 1) ** 2) / 4.0)
    total = np.einsum("d,pds->ps", weight, around[ends])
    text, marks = total[:, 0] / total[:, 2] / 10, total[:, 1] / total[:, 2] / 10
    return dict(zip(sums, np.sqrt(text * (marks + 0.1)).tolist(), strict=True))


def headings_of_chosen(nodes: list[tuple[int, tuple[str, ...], tuple[int, ...], str]], keep: set[int]) -> set[int]:
    """Nodes of headings that chosen text follows before a heading of the same or a higher rank."""
    found: set[int] = set()
    waiting: list[tuple[str, int, list[int]]] = []  # rank, element, nodes
    for node in nodes:
        rank, element = next(((x.split(".")[0], e) for x, e in zip(node[1], node[2], strict=True) if x.split(".")[0] in HEADINGS), ("", 0))
        if rank:
            if not waiting or waiting[-1][1] != element:
                waiting = [w for w in waiting if w[0] < rank]
                waiting.append((rank, element, []))
            waiting[-1][2].append(id(node))
        elif id(node) in keep:
            found.update(x for w in waiting for x in w[2])
            waiting = []
    return found


def main_text(source: str | None) -> str:
    """The article of one page: blocks in page order, one to a line; empty if none."""
    nodes = Page(source or "").nodes
    nodes = [n for n in nodes if n[3]]
    score = path_scores(nodes)
    if not score:
        return ""
    # Being named as the article is one more signal: text outside of it must score higher.
    fused = {p: v if any(x.split(".")[0] in ("article", "main") for x in p) else v * UNNAMED for p, v in score.items()}
    least = THRESHOLD * max(fused.values())
    chosen = [n for n in nodes if n[3].strip() and fused.get(n[1], 0.0) >= least]
    # All that is chosen stays, wherever it stands. Besides it, only inline parts of chosen
    # blocks and headings: those in an article or main with chosen text, or else in the
    # smallest element that holds all chosen text.
    mass: dict[int, int] = defaultdict(int)
    articles: set[int] = set()
    for _, path, chain, _ in chosen:
        for name, element in zip(path, chain, strict=True):
            mass[element] += 1
            if name.split(".")[0] in ("article", "main"):
                articles.add(element)
    zone = max((e for e in mass if mass[e] == len(chosen)), default=0)
    keep = {id(n) for n in chosen}
    blocks = {n[0] for n in chosen}

    def inline_of_chosen(node: tuple[int, tuple[str, ...], tuple[int, ...], str]) -> bool:
        path = node[1]
        while path and path[-1].split(".")[0] in INLINE:
            path = path[:-1]
        return len(path) < len(node[1]) and (node[0] in blocks or fused.get(path, 0.0) >= least)

    kept_heading = headings_of_chosen(nodes, keep)
    out, block, parts = [], None, []
    for node in nodes:
        at, path, chain, text = node
        inside = zone in chain or not zone or not articles.isdisjoint(chain)
        wanted = id(node) in keep or (inside and (not text.strip() or id(node) in kept_heading or inline_of_chosen(node)))
        if not wanted:
            continue
        if at != block:
            out.append(SPACE.sub(" ", "".join(parts)).strip())
            block, parts = at, []
        parts.append(text)
    out.append(SPACE.sub(" ", "".join(parts)).strip())
    return "\n".join(x for x in out if x)


def extract_text(pages: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every page; no shuffle, one page at a time.

    A null or empty page, or one without article text, has an empty text. Broken markup
    (open elements, cut tags, odd nesting) is read as browsers do, near enough. Repeated
    rows and null keys pass as they are; other columns are not read.
    """
    fields = [pages.schema[k] for k in keep]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, source).mapInArrow(run, schema)
