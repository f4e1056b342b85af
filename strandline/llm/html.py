"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path. Per path, the text length
and the punctuation per node are two ratios; both are smoothed over the sequence
of nodes, fused, and the paths whose fused ratio passes a threshold are content.
A path of content makes the box that it stands in (the nearest article or main
above it, else the nearest section, division or cell) content, with all short
headings and items that are in it; every such box is kept. Elements that say by
their name, class or role that they are boilerplate are left out beforehand.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp", "noembed", "noframes")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
BOXES = frozenset("html body main article section div td".split())
#: With boxes, the elements beyond which a start tag ends nothing.
LISTS = frozenset("table ul ol".split())
#: Elements that a start tag of the key ends, if they are open within the nearest box.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Never content, whatever their ratios.
APART = frozenset("nav footer header aside form button select option menu dialog head".split())
#: Words of class, id or role that name the same.
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar aside related recommended share sharing social comment comments reply replies respond disqus footer header masthead toolbar widget widgets pagination pager complementary contentinfo search skip".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[,.;:!?。，、；：！？…·¿¡]")
GAP = re.compile(r"\s+")

#: Deviation of the smoothing in nodes, and the share of the standard deviation that the threshold takes.
SIGMA, SHARE = 1.0, 0.5


def _apart(name: str, attributes: str) -> bool:
    if name in APART:
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and m[0].lower() == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if name not in ("html", "body", "main", "article", "h1") and not HINTS.isdisjoint(WORD.findall(value)):
            return True
    return False


class Paths:
    """Tag paths as numbers: equal paths have equal numbers, and 0 is the root above all elements."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, str], int] = {}
        self.parent = [0]
        #: The path of the box that holds a path: the nearest article or main above it, else the nearest box.
        self.box = [0]
        self.firm = [False]

    def below(self, parent: int, name: str) -> int:
        found = self.ids.get((parent, name))
        if found is None:
            found = self.ids[parent, name] = len(self.parent)
            own = name == "article" or name in BOXES and not self.firm[parent]
            self.parent.append(parent)
            self.box.append(found if own else self.box[parent])
            self.firm.append(self.firm[parent] or name in ("article", "main"))
        return found

    def within(self, tops: set[int]) -> list[bool]:
        """Of each path, whether it is one of ``tops`` or below one; parents have smaller numbers."""
        out = [0 in tops]
        for k in range(1, len(self.parent)):
            out.append(k in tops or out[self.parent[k]])
        return out


class Open:
    """The open elements; where those of a name and the boundaries stand is known, so no tag looks through all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.boxes: list[int] = [0]
        self.bounds: list[int] = [0]

    def push(self, name: str, path: int, apart: bool) -> None:
        at = len(self.stack)
        self.stack.append((name, path, apart))
        self.places[name].append(at)
        if name in BOXES:
            self.boxes.append(at)
        if name in BOXES or name in LISTS:
            self.bounds.append(at)

    def cut(self, at: int) -> None:
        """Ends the elements from place ``at`` on."""
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()
        for marks in (self.boxes, self.bounds):
            while marks[-1] >= at:
                marks.pop()

    def end(self, name: str) -> None:
        """An end tag; one that has no start, or only outside the box that an inline element is in, ends nothing."""
        places = self.places.get(name)
        if places and (name in BLOCK or places[-1] >= self.boxes[-1]):
            self.cut(places[-1])

    def implied(self, names: set[str] | frozenset[str]) -> None:
        """Ends what a start tag ends that may not stand within ``names``, up to the nearest boundary."""
        bound = self.bounds[-1]
        first = [p[bisect_left(p, bound)] for n in names if (p := self.places.get(n)) and p[-1] >= bound]
        if first:
            self.cut(min(first))


def nodes(source: str, paths: Paths) -> Iterator[tuple[int, str, bool, bool]]:
    """(path, raw text, apart, new) of every text node: apart marks boilerplate, new that a block begins or ends before it."""
    tree = Open()
    new, at = True, 0
    while at < len(source):
        m = TAG.search(source, at)
        _, path, apart = tree.stack[-1]
        if text := source[at : m.start() if m else len(source)]:
            yield path, text, apart, new
            new = False
        if not m:
            return
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            new = True
        if name == "br" and not new:
            yield path, " ", apart, False
        if source.startswith("</", m.start()):
            tree.end(name)
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in VOID:
            if closes := ENDS.get(name, frozenset()) | ({"p"} if name in BLOCK else set()):
                tree.implied(closes)
            _, path, apart = tree.stack[-1]
            tree.push(name, paths.below(path, name), apart or _apart(name, m[2] or m[4] or ""))


def _smooth(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def content_paths(found: list[tuple[int, str, bool, bool]], sigma: float = SIGMA, share: float = SHARE) -> dict[int, float]:
    """The fused ratio of each path that passes the threshold."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    order = []
    for path, text, apart, _ in found:
        if apart or text.isspace():
            continue
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
        order.append(path)
    if not order:
        return {}
    by_text = _smooth([length[p] / count[p] for p in order], sigma)
    by_marks = _smooth([1 + marks[p] / count[p] for p in order], sigma)
    fused = defaultdict(float)
    for p, a, b in zip(order, by_text, by_marks, strict=True):
        fused[p] += a * b / count[p]
    values = list(fused.values())
    mean = sum(values) / len(values)
    least = share * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return {p: v for p, v in fused.items() if v >= least}


def main_text(source: str) -> str:
    """Blocks of the main text in page order, joined by an empty line; empty if there is none."""
    paths = Paths()
    found = list(nodes(source, paths))
    inside = paths.within({paths.box[path] for path in content_paths(found)})
    blocks: list[list[str]] = [[]]
    for path, text, apart, new in found:
        if new:
            blocks.append([])
        if not apart and inside[path]:
            blocks[-1].append(text)
    clean = (GAP.sub(" ", entities.unescape("".join(b))).strip() for b in blocks if b)
    return "\n\n".join(b for b in clean if b)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    A null, empty or unreadable html gives an empty text. Rows are independent;
    null ids and urls and repeated rows stay as they are. Tags left open, cut
    or nested wrongly are read as browsers do for the usual cases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).alias("__html"))
    return slim.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
