"""HTML extraction by a maximum-scoring subsequence of words and tags.

A page becomes its sequence of words and tags. A word scores by the elements around it: the sum of
weights of their tag names, of the words of their class and id and of the kinds of part these name, learnt from
labelled pages so that words of articles score positive; every tag scores negative, with a weight learnt likewise.
An element that holds the page's main heading (or is its body) and half of its words or more is no part beside the
article, whatever its class says of the page's layout: only names of main text count there. One linear
scan finds the contiguous region with the largest sum. Runs of words inside it that score negative
themselves (an advert or a form within the article) are left out.

The labelled pages are made by ``labelled_pages``: layouts of articles, menus, adverts, comments and so
on, with the part of every text known. Weights are fitted once a process; pages are read in one pass
without a shuffle. Time and memory of a page are linear in its length, however deep its elements nest.

Defined results: a null or empty page gives the empty text; a page without a positive word gives the
empty text; an unclosed comment, script or style runs to the end of the page; a head, button, select or drawing
that isn't closed ends where an element starts that can't be in it; a ``<`` that starts no tag is text; repeated rows are extracted alike, one result each; an empty table gives an empty result; other
columns pass through, and result columns replace input columns of the same name.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 256
#: weight of words that are not main text against words that are, in the scan
FOREIGN = 0.1

# fixed values: element classes of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: their content is never text of the page
SKIPPED = frozenset("script style noscript template title svg math canvas iframe object select textarea button head".split())
#: any other element, and words, end an open head
#: elements that can't be in these end them
CLOSED_BY_BLOCKS = ("button", "select", "svg", "math")
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "button": ("button",)}
BARRIERS = frozenset("ul ol dl table tr tbody".split())

# fixed values: words that sites commonly use in class and id names of each kind of part
PARTS = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs pagination pager tabs toolbar dropdown topbar skip links",
    "header": "header masthead banner branding logo sitename top",
    "footer": "footer foot bottom copyright legal colophon",
    "aside": "sidebar side aside widget related recommended popular trending tags tagcloud teaser more rail complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense partner commercial dfp",
    "notice": "cookie cookies notice consent gdpr alert warning popup modal overlay newsletter subscribe subscription signup paywall disclaimer message dialog",
    "form": "form search login register contact input",
    "comment": "comment comments reply replies discussion respond disqus feedback reviews",
    "share": "share sharing social follow like buttons author bio byline meta",
}
MAIN = "article content main post entry story body text page single"
#: the kinds of part that a class word names
_KINDS = {w: tuple(f"~{kind}" for kind, names in (*PARTS.items(), ("main", MAIN)) if w in names.split()) for names in (*PARTS.values(), MAIN) for w in names.split()}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>(?:.*?</(?P=raw)\s*>|.*)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)|[^>]*)>|<[!?][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@lru_cache(maxsize=65536)
def _features(attr: str) -> tuple[str, ...]:
    """The words of an element's class, id and role, and the kinds of part that they name."""
    named = [m.group(1) or m.group(2) or m.group(3) or "" for m in _NAMED.finditer(attr)] if attr else []
    words = {w for x in named for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())}
    return tuple(sorted({f for w in words for f in (f".{w}", *_KINDS.get(w, ()))}))


class Run:
    """Words between tags: their element and block, and the tags since the run before."""

    __slots__ = ("block", "element", "tags_before", "text", "words")

    def __init__(self, text: str, element: int, block: int, tags_before: int):
        self.text, self.element, self.block, self.tags_before = html.unescape(text), element, block, tags_before
        self.words = len(self.text.split())


class Page:
    """A page's elements in order of their starts (the first is the page itself), and its runs of text."""

    def __init__(self, page: str):
        self.names, self.attrs, self.parents, self.holders = [""], [""], [-1], [""]
        self.runs: list[Run] = []
        self._open = [0]
        self._places: dict[str, list[int]] = {}
        self._skipped = 0
        self._read(page)

    def _close(self, name: str, within: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of a name and all inside it, unless one of ``within`` is between."""
        places = self._places.get(name)
        if not places or any(self._places.get(other, [0])[-1:] > places[-1:] for other in within):
            return
        at = places[-1]
        while len(self._open) > at:
            ended = self.names[self._open.pop()]
            self._places[ended].pop()
            self._skipped -= ended in SKIPPED

    def _start(self, name: str, attr: str) -> None:
        above = self._open[-1]
        self._places.setdefault(name, []).append(len(self._open))
        self._open.append(len(self.names))
        self._skipped += name in SKIPPED
        self.names.append(name)
        self.attrs.append(attr)
        self.parents.append(above)
        self.holders.append(self.holders[above] if name in INLINE else name)

    def _read(self, page: str) -> None:
        block, tags = 0, 0
        for m in _TOKEN.finditer(page):
            text = m.group("text")
            if text is not None:
                if self._skipped and self.names[self._open[-1]] == "head" and text.strip():
                    self._close("head")
                if not self._skipped:
                    self.runs.append(Run(text, self._open[-1], block, tags))
                    tags = 0
                continue
            name = m.group("name")
            if name is None:
                block += m.group("raw") is not None and m.group("raw").lower() not in ("noscript",)
                continue
            name = name.lower()
            tags += 1
            if name not in IN_HEAD and not m.group("end"):
                self._close("head")
            if name == "br":
                self.runs.append(Run(" ", self._open[-1], block, 0))
                continue
            if name not in INLINE:
                block += 1
            if m.group("end"):
                self._close(name)
                continue
            if name in CLOSES_PARAGRAPH:
                self._close("p", BARRIERS)
                if self._skipped:
                    for closed in CLOSED_BY_BLOCKS:
                        self._close(closed)
            for sibling in SIBLINGS.get(name, ()):
                self._close(sibling, BARRIERS - {name, "tr"} if name in ("td", "th", "tr") else BARRIERS)
            if not (name in VOID or m.group("attr").endswith("/") and name in ("path", "use")):
                self._start(name, m.group("attr"))

    def wrappers(self) -> list[bool]:
        """Which elements are the page's body or hold its heading and half of its words or more."""
        words, heading = [0] * len(self.names), [n in ("h1", "main") for n in self.names]
        for run in self.runs:
            words[run.element] += run.words
        for k in range(len(words) - 1, 0, -1):
            words[self.parents[k]] += words[k]
            heading[self.parents[k]] |= heading[k]
        return [n in ("", "html", "body") or (h and 2 * w >= words[0]) for n, h, w in zip(self.names, heading, words, strict=True)]

    def walk(self) -> Iterator[tuple[int, tuple[str, ...]]]:
        """Elements in order with the features that each adds to those of the elements around it."""
        wraps = self.wrappers()
        added: list[tuple[str, ...]] = []
        active: set[str] = set()
        path: list[int] = []
        for k, (name, attr) in enumerate(zip(self.names, self.attrs, strict=True)):
            while path and path[-1] != self.parents[k]:
                active.difference_update(added[path.pop()])
            if name == "a":  # a link in running text differs from one in a list or on its own
                tag = f"<a>@{self.holders[self.parents[k]]}"
            elif name == "header" and "~main" in active:  # an article's own heading, not the site's
                tag = "<header>@main"
            else:
                tag = "~main" if name in ("article", "main") else f"<{name}>"
            words = _features(attr)
            own = {tag, *(f for f in words if f == "~main")} if wraps[k] else {tag, *words}
            added.append(tuple(own - active))
            active.update(added[k])
            path.append(k)
            yield k, added[k]

    def features(self) -> list[frozenset[str]]:
        """All features around the text of each element; for pages that don't nest deep."""
        out: list[frozenset[str]] = []
        for k, own in self.walk():
            out.append(frozenset(own) | (out[self.parents[k]] if k else frozenset()))
        return out

    def totals(self, weights: dict[str, float]) -> list[float]:
        """Sums of the weights of the features around the text of each element."""
        out: list[float] = []
        for k, own in self.walk():
            out.append((out[self.parents[k]] if k else 0.0) + sum(weights.get(f, 0.0) for f in own))
        return out


# ---- labelled pages ------------------------------------------------------------------------------

_NATIVE = {"nav": ("nav", "menu"), "header": ("header",), "footer": ("footer",), "aside": ("aside",), "form": ("form",)}


def labelled_pages(n: int = 400, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Pages as lists of (fragment, whether its words are main text), in varied layouts."""
    random = np.random.default_rng(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(random.choice(list("aeioulnrst"), random.integers(2, 9))) for _ in range(random.integers(low, high)))

    def part(kind: str) -> list[tuple[str, bool]]:
        native = _NATIVE.get(kind)
        named = random.choice(PARTS[kind].split())
        if native and random.random() < 0.6:
            tag, attr = random.choice(native), f' class="{named}"' if random.random() < 0.5 else ""
        else:
            tag, attr = random.choice(["div", "section", "div", "ul" if kind == "nav" else "div", "aside" if kind == "ad" else "div", "p" if kind in ("ad", "notice") else "div"]), f' {random.choice(["class", "id"])}="{named}"'
        if kind in ("nav", "share") or kind == "aside" and random.random() < 0.5:
            inner = "".join(f"<li><a href='/x'>{words(1, 4)}</a></li>" for _ in range(random.integers(3, 9)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name='q'><label>{words(2, 8)}</label>" if random.random() < 0.4 else f"{words(2, 12)} <input name='q'> <p>{words(2, 9)}</p>"
        elif kind == "comment":
            shape = random.choice(["<div class='comment'><p>{}</p></div>", "<article><p>{}</p></article>", "<article class='comment'><header>{}</header><p>{}</p></article>", "<li><blockquote>{}</blockquote></li>", "<p>{}</p>", "<div><b>{}</b> {}</div>"])
            inner = "".join(shape.format(words(5, 40), words(5, 40)) for _ in range(random.integers(1, 8)))
        else:
            inner = "".join(f"<p>{words(3, 30)}</p>" for _ in range(random.integers(1, 3))) if random.random() < 0.5 and tag != "p" else words(3, 30)
        return [(f"<{tag}{attr}>{inner}</{tag}>", False)]

    def article() -> list[tuple[str, bool]]:
        tag = random.choice(["article", "article", "main", "div", "section", "div", "td"])
        attr = f' class="{random.choice(MAIN.split())}"' if tag in ("div", "section", "td") and random.random() < 0.8 else ""
        out = [(f"<table><tr><td{attr}>" if tag == "td" else f"<{tag}{attr}>", True), (f"<h1>{words(3, 10)}</h1>" if random.random() < 0.6 or tag not in ("article", "main") else f"<header><h1>{words(3, 10)}</h1></header>", True)]
        for _ in range(random.integers(2, 14)):
            kind = random.random()
            if kind < 0.62:
                out.append((f"<p>{words(10, 80)}</p>" if random.random() < 0.8 else f"<p>{words(5, 20)} <a href='/y'>{words(1, 4)}</a> <b>{words(1, 5)}</b><br>", True))
            elif kind < 0.7:
                out.append((f"<h2>{words(2, 8)}</h2>", True))
            elif kind < 0.76:
                out.append((random.choice(["<ul><li>{}</li><li>{}</li></ul>", "<ol><li>{}</li><li>{}</li></ol>"]).format(words(6, 20), words(6, 20)), True))
            elif kind < 0.82:
                out.append((f"<blockquote><p>{words(8, 30)}</p></blockquote>", True))
            else:
                out += part(random.choice(["ad", "ad", "share", "form", "notice", "aside", "nav"]))
        return [*out, ("</td></tr></table>" if tag == "td" else f"</{tag}>", True)]

    pages = [[(words(5, 60) + "\n" + words(5, 60), True)] for _ in range(n // 20)] + [[("<body>", True), *[(f"<p>{words(10, 60)}</p>", True) for _ in range(4)]] for _ in range(n // 20)]
    for _ in range(n):
        page = [("<body>", True)]
        for kind in ("notice", "header", "nav", "ad", "aside", "form"):
            if random.random() < 0.6:
                page += part(kind)
        page += article()
        for kind in ("share", "ad", "comment", "comment", "aside", "form", "footer"):
            if random.random() < 0.6:
                page += part(kind)
        pages.append([*page, ("</body>", True)])
    return pages


class Weights:
    """Word weights by features around, and the tag weight."""

    def __init__(self, bias: float, by_feature: dict[str, float], tag: float):
        self.bias, self.by_feature, self.tag = bias, by_feature, tag

    def words(self, page: Page) -> list[float]:
        """Score of a word of each run: bounded, and positive where main text is likelier than not; foreign words count less, as they are left out anyway."""
        scores = [math.tanh((self.bias + total) / 2) for total in page.totals(self.by_feature)]
        return [s if s > 0 else FOREIGN * s for s in (scores[run.element] for run in page.runs)]


@lru_cache(maxsize=4)
def learn(n: int = 400, seed: int = 7, rounds: int = 400, penalty: float = 1e-4) -> Weights:
    """Logistic regression of "main text" on the features around each run, and the tag weight that their densities give."""
    rows: dict[tuple[frozenset[str], bool], float] = {}
    tags_in = tags_out = words_in = words_out = 0.0
    for page in labelled_pages(n, seed):
        bounds = np.cumsum([len(fragment) for fragment, _ in page])
        marks = [main for _, main in page]
        whole = "".join(fragment for fragment, _ in page)
        at = 0
        read = Page(whole)
        around = read.features()
        for run in read.runs:
            if not run.words:
                continue
            at = whole.index(run.text, at)
            main = marks[int(np.searchsorted(bounds, at, side="right"))]
            at += len(run.text)
            count, key = run.words, (around[run.element], main)
            rows[key] = rows.get(key, 0.0) + np.sqrt(count)
            if main:
                words_in, tags_in = words_in + count, tags_in + run.tags_before
            else:
                words_out, tags_out = words_out + count, tags_out + run.tags_before
    names = sorted({f for held, _ in rows for f in held})
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for k, (held, _) in enumerate(rows):
        x[k, [place[f] for f in held]] = 1
    x[:, -1] = 1
    y = np.array([main for _, main in rows], float)
    w = np.array(list(rows.values()))
    w /= w.sum()
    theta, first, second = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, rounds + 1):
        grad = x.T @ (w * (y - 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30))))) - penalty * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    # log ratio of tags to words outside and inside articles, spread over the tags of a menu's length
    tag = -min(0.5, max(0.05, np.log((tags_out / words_out) / (tags_in / words_in)) / 10))
    return Weights(float(theta[-1]), dict(zip(names, theta[:-1].tolist(), strict=True)), float(tag))


# ---- extraction ----------------------------------------------------------------------------------


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, by one scan; empty if no sum is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, best_at = total, (start, k + 1)
    return best_at


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page: its blocks in order, two line breaks between."""
    if not page:
        return ""
    read = Page(page)
    words = weights.words(read)
    lo, hi = region([score for run, word in zip(read.runs, words, strict=True) for score in (weights.tag * run.tags_before, word * run.words)])
    blocks: dict[int, list[str]] = {}
    for run, word in zip(read.runs[lo // 2 : hi // 2], words[lo // 2 : hi // 2], strict=True):
        if word > 0:
            blocks.setdefault(run.block, []).append(run.text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def extract_pages(pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) with ``text`` and ``n_chars``."""
    weights = learn()
    passed = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in passed] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [extract(p, weights) for p in part.column("__page").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*passed, F.col(column).cast("string").alias("__page")).mapInArrow(apply, schema)
