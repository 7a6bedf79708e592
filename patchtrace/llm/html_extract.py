"""HTML extraction: the maximum-scoring run of a page's tokens.

A page becomes a sequence of tokens. A tag costs its weight; a stretch of text gains or
loses its number of words times the score of the elements that it lies in. One linear scan
finds the contiguous run with the largest total, the content region. The region then grows
to the innermost container that holds it (never to the whole body, if anything smaller
does), and text in it whose own score is negative (adverts, comments, forms ...) goes.

The weights come from labelled pages (``labelled_pages``, or any others): for each feature
of an element (tag name, class, id and role words) the log odds of content words over other
words under such elements; for each tag the log odds of standing outside of content.

Text: character references are decoded after the markup is cut; block elements and line
breaks end a block; white space inside a block becomes one space; blocks are joined in page
order by one space. Scripts, styles, comments and the like are never text.

Defined results: null or empty html and pages without content give the empty text; open
ends (a comment, tag or script without its end) run to the end of the page; repeated rows
get one result each.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from patchtrace.llm.common import pick, strings, text_slices
from patchtrace.llm.labelled_pages import PAGES

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select button head".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong "
                   "sub sup time tt u var wbr img object svg g text tspan math mrow mi mn mo ms mtext mspace mfrac msqrt "
                   "mroot msub msup msubsup munder mover munderover mfenced menclose mstyle semantics annotation".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--(?P<note>.*?)(?:-->|$)|<[!?][^>]*(?:>|$)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
                    r"(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Weight of words under no telling element, strength from which an element decides alone.
NEUTRAL, DECIDES = 0.5, 1.0
MAIN, END_MAIN = "main", "/main"


@dataclass
class Piece:
    """A stretch of text (with the number of its innermost open element) or, with ``tag``, a tag."""

    text: str
    at: int
    tag: str | None
    block: int
    labelled: bool = False


@dataclass
class Page:
    pieces: list[Piece]
    features: list[tuple[str, ...]]  # of each element, numbered in page order
    parents: list[int]

    def holders(self, element: int) -> list[int]:
        """The element and those around it, outermost first."""
        out = []
        while element >= 0:
            out.append(element)
            element = self.parents[element]
        return out[::-1]

    def shared(self, elements: list[int]) -> list[int]:
        """Elements around all of these. Numbers are in page order, so these lie around the first and the last."""
        first = min(elements)
        return [e for e in self.holders(max(elements)) if e <= first]

    def end(self, element: int) -> int:
        """Number of the last element inside an element."""
        out = element
        for e in range(element + 1, len(self.parents)):
            if self.parents[e] < element:
                break
            out = e
        return out


def parse(page: str, labels: bool = False) -> Page:
    """Cut a page into pieces with a tolerant stack of open elements; linear, however deep they lie."""
    pieces, features, parents = [], [()], [-1]
    names, path = ["#page"], [0]
    places: dict[str, list[int]] = {}    # of each name on the stack
    firm = [0]                           # elements up to here that are neither inline nor p
    at, block, inside = 0, 0, False
    lower = None

    def text(raw: str):
        if raw and (raw.strip() or raw):
            pieces.append(Piece(html_lib.unescape(raw) if "&" in raw else raw, path[-1], None, block, inside))

    def close(cut: int):
        while len(names) > cut:
            places[names.pop()].pop()
            path.pop()
            firm.pop()

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return Page(pieces, features, parents)
        text(page[at:m.start()])
        at = m.end()
        note, name = m["note"], m["name"]
        if name is None:
            if labels and note is not None and note.strip() in (MAIN, END_MAIN):
                inside = note.strip() == MAIN
            continue
        name = name.lower()
        if name not in INLINE:
            block += 1
        pieces.append(Piece("", path[-1], name, block, inside))
        if m["close"]:
            if places.get(name):
                close(places[name][-1])
            continue
        if name in ENDS_P and places.get("p") and firm[-1] == firm[places["p"][-1]]:
            close(places["p"][-1])
        if name in ("li", "option", "dt", "dd", "tr", "td", "th") and names[-1] == name:
            close(len(names) - 1)
        if name in VOID or m["attrs"].endswith("/"):
            continue
        if name in RAW:
            if lower is None:
                lower = page.lower()
            end = re.compile("</" + re.escape(name) + r"(?=[\s/>])").search(lower, at)
            at = end.start() if end else len(page)
            if end:
                at = (page.find(">", at) + 1) or len(page)
            continue
        parts = {"<" + name}
        if m["attrs"]:
            for a, b, c in _NAMED.findall(m["attrs"]):
                parts.update(x.lower() for x in _PART.findall(a or b or c))
        features.append(tuple(sorted(parts)))
        parents.append(path[-1])
        places.setdefault(name, []).append(len(names))
        firm.append(firm[-1] + (name != "p" and name not in INLINE))
        names.append(name)
        path.append(len(features) - 1)


@dataclass(frozen=True)
class Weights:
    feature: dict[str, float]
    tag: dict[str, float]
    default_tag: float


def learn(pages: list[str] = PAGES) -> Weights:
    """Log odds from labelled pages."""
    words: dict[str, list[float]] = {}
    tags: dict[str, list[float]] = {}
    total, total_tags = [0.0, 0.0], [0.0, 0.0]
    for page in pages:
        parsed = parse(page, labels=True)
        for p in parsed.pieces:
            if p.tag:
                tags.setdefault(p.tag, [0.0, 0.0])[p.labelled] += 1
                total_tags[p.labelled] += 1
                continue
            n = len(p.text.split())
            total[p.labelled] += n
            for f in {x for e in parsed.holders(p.at) for x in parsed.features[e]}:
                words.setdefault(f, [0.0, 0.0])[p.labelled] += n
    base = math.log((total[1] + 1) / (total[0] + 1))
    feature = {f: math.log((c[1] + 2) / (c[0] + 2)) - base for f, c in words.items()}
    base = math.log((total_tags[1] + 1) / (total_tags[0] + 1))
    tag = {t: min(-0.05, 0.3 * (math.log((c[1] + 1) / (c[0] + 1)) - base) - 0.3) for t, c in tags.items()}
    return Weights(feature, tag, -0.3)


class Extractor:
    def __init__(self, weights: Weights):
        self.weights = weights

    def element_scores(self, page: Page) -> list[tuple[float, float]]:
        """For each element its most telling weight, and the same without inline tags' own."""
        w = self.weights.feature
        out = []
        for own in page.features:
            known = [f for f in own if f in w]
            firm = [w[f] for f in known if f[0] != "<" or f[1:] not in INLINE]
            out.append((max((w[f] for f in known), key=abs, default=0.0), max(firm, key=abs, default=0.0)))
        return out

    def word_scores(self, page: Page, own: list[tuple[float, float]]) -> list[float]:
        """Score of a word directly in each element: an element around it that tells against content
        decides, else one that tells for it; where none does, links and the like weigh, too.
        The least and greatest weights are handed from each element to those in it."""
        out, held = [], []
        for (every, firm), parent in zip(own, page.parents, strict=True):
            a, b, c, d = held[parent] if parent >= 0 else (firm, firm, every, every)
            held.append((min(a, firm), max(b, firm), min(c, every), max(d, every)))
            a, b, c, d = held[-1]
            out.append(-1.0 if a <= -DECIDES else 1.0 if b >= DECIDES else NEUTRAL + 0.2 * (min(1.0, d) + c))
        return out

    def region(self, page: Page) -> tuple[int, int, list[float]]:
        """First and last piece of the best run (last before first: none), and the words' scores."""
        word, scores = self.word_scores(page, self.element_scores(page)), []
        best = (0.0, 0, -1)
        run, start = 0.0, 0
        for i, p in enumerate(page.pieces):
            if p.tag:
                gain = self.weights.tag.get(p.tag, self.weights.default_tag)
                scores.append(0.0)
            else:
                scores.append(word[p.at])
                gain = word[p.at] * len(p.text.split())
            if run <= 0:
                run, start = 0.0, i
            run += gain
            if run > best[0]:
                best = (run, start, i)
        return best[1], best[2], scores

    def extract(self, html: str) -> str:
        page = parse(html)
        first, last, scores = self.region(page)
        if last < first:
            return ""
        pieces = page.pieces
        held = [p.at for p, s in zip(pieces[first:last + 1], scores[first:last + 1], strict=True)
                if not p.tag and s > 0 and p.text.strip()]
        inner = [e for e in (page.shared(held) if held else [])
                 if page.features[e] and not {"<body", "<html"} & set(page.features[e])]
        if inner:  # grow to the container that holds the whole run
            # a container's own parts may be inline or a block: take the outermost that tells for content
            own = self.element_scores(page)
            box = next((e for e in inner if own[e][1] >= DECIDES), inner[-1])
            end = page.end(box)
            inside = [i for i, p in enumerate(pieces) if box <= p.at <= end]
            first, last = min(first, inside[0]), max(last, inside[-1])
        blocks: list[list[str]] = []
        number = None
        for p, s in zip(pieces[first:last + 1], scores[first:last + 1], strict=True):
            if p.tag or s <= 0:
                continue
            if p.block != number:
                blocks.append([])
                number = p.block
            blocks[-1].append(p.text)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return " ".join(x for x in lines if x)


def extract_pages(pages: DataFrame, weights: Weights | None = None, *, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars."""
    held = weights or learn()

    def run(batches):
        own = Extractor(held)
        for b in text_slices(batches, "html"):
            text = [own.extract(h) for h in strings(b.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    src = pick(pages, id=id_col, url=url_col, html=html_col)
    kind = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
            .withColumnRenamed("id", id_col).withColumnRenamed("url", url_col))
