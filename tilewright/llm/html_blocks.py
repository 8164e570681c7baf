"""Main text of HTML pages by a recurrent block labeller.

A page is cut into blocks: the text between two block-level tags, with the path of open block-level elements (their names and the words of
their classes and ids). A bidirectional LSTM in numpy reads the blocks of a page in order, each as the sum of its path's vectors, the mean of
its hashed words' vectors and a few measures, and labels each one as main text or not, so that all of a page bears on each of its blocks.

It is trained here, on a bounded sample of the given pages (``rows``) and on generated pages of many layouts, made of the sample's own texts. What
boxes are called labels the blocks in training, where it says something. But in half of the lessons a page's names are hidden or replaced by meaningless ones
and its boxes are all alike, so the labels have to be found from words, links, length, place and what stands around. Labelling is one pass
without a shuffle.

Defined cases: a null or empty page has an empty text; tags that are never closed end with what surrounds them, a tag or comment that the
page's end cuts off with the page; a quote that is never closed is no quote; scripts, styles, the head and its title, and comments of the
markup are no blocks; a character reference is decoded once; pages without main text have an empty one; very long pages are read whole; repeated
rows get the same text. Other columns are passed through; columns called like those added are an error.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.jobs import bounded_sample, numbered, refuse_columns, widened
from tilewright.llm.textkit import NON_SPACE, rows_of, slices, utf8, word_hashes, word_spans

PATHS, WORDS, PATH_DIM, WORD_DIM, HIDDEN, MEASURES = 1 << 11, 1 << 12, 24, 12, 16, 5

#: Elements that stand inside a line of text, elements whose content is never text, and elements without content.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = ("script", "style", "title", "noscript", "template", "textarea", "svg", "iframe")
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Names in a path that tell what is below it.
SIDE = {"nav", "navbar", "menu", "header", "masthead", "footer", "aside", "sidebar", "form", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "cookie", "consent", "notice", "popup", "newsletter", "subscribe", "share", "social", "related", "breadcrumb", "breadcrumbs", "comment", "comments", "reply", "replies", "discussion", "button", "select", "login", "search", "copyright"}
MAIN = {"article", "main", "content", "post", "entry", "story", "body-text"}

#: Elements that keep their name where a page's boxes are made alike.
PLAIN = {"html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption"}
#: Words that turn a name into one about something else on the page.
ABOUT = {"has", "no", "with", "without", "hide", "show", "toggle"}

#: A quote opens a value only behind an equals sign, and closes it only before white space or the tag's end.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in (*RAW, "head")}


@functools.lru_cache(1 << 16)
def bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


class Path:
    """An open element and those above it: its tag, then the words of its names with a dot before. Going down costs what the element adds, however deep it is."""

    __slots__ = ("above", "names", "kinds")

    def __init__(self, above: Path | None, names: tuple[str, ...]):
        self.above, self.names = above, names
        own, over = {bucket(n, PATHS) for n in names}, above.kinds if above else frozenset()
        self.kinds = over if own <= over else over | own

    def __iter__(self) -> Iterator[str]:
        levels, at = [], self
        while at is not None:
            levels.append(at.names)
            at = at.above
        return (n for names in reversed(levels) for n in names)


def path_kinds(path: Path | tuple[str, ...] | None) -> list[int]:
    """The buckets of a path: of all its names, of the last one as such, and of any path."""
    if isinstance(path, Path):
        kinds, last = path.kinds, path.names[-1]
    else:
        kinds, last = {bucket(n, PATHS) for n in path or ()}, path[-1] if path else ""
    return sorted({bucket("/", PATHS), *kinds, bucket(">" + last, PATHS)})


@dataclass
class Block:
    """path: the open elements, the words of their names with a dot before; told: whether it is main text as the names say, -1 if they don't."""

    path: Path | tuple[str, ...]
    text: str
    linked: int
    told: int = -1


@dataclass
class _Open:
    tag: str
    path: Path
    told: int


def _told(tag: str, attributes: str, above: int) -> tuple[tuple[str, ...], int]:
    """The words of an element's names, and what they and those above it say. What is beside the main text stays so; a header within it belongs to it."""
    each = [_NAME.findall(name) for g in _NAMED.findall(attributes) for name in "".join(g).lower().split()]
    names = tuple(w for words in each for w in words)
    if above == 0 or tag in ("html", "body"):
        return names, above
    said = {tag, *[w for words in each if not ABOUT.intersection(words) for w in words]}
    side = said & SIDE - ({"header", "masthead"} if above == 1 else set())
    return names, 0 if side else 1 if said & MAIN else above


def blocks_of(page: str | None) -> list[Block]:
    out: list[Block] = []
    if not page:
        return out
    stack: list[_Open] = []
    standing: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, at, heads_end = 0, 0, 0, True

    def close() -> str:
        tag = stack.pop().tag
        standing[tag] -= 1
        return tag

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1].path if stack else (), text, linked, stack[-1].told if stack else -1))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in _ENDS and not closing:
            if tag == "head" and heads_end or tag != "head" and not m.group(3).endswith("/"):
                end = _ENDS[tag].search(page, at)
                if end is None and tag == "head":
                    heads_end = False  # nor will there be one for those that follow
                    continue
                at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            continue
        flush()
        in_link = 0
        if closing:
            if standing[tag]:
                while close() != tag:
                    pass
        elif tag not in EMPTY:
            if stack and (stack[-1].tag == "p" or stack[-1].tag == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
                close()
            names, told = _told(tag, m.group(3), stack[-1].told if stack else -1)
            stack.append(_Open(tag, Path(stack[-1].path if stack else None, (tag, *["." + w for w in names])), told))
            standing[tag] += 1
    flush()
    return out


def made_alike(page: list[Block], random: np.random.Generator) -> list[Block]:
    """The page with its boxes alike, and their names gone or, half of the time, replaced by meaningless ones."""
    renamed: dict[str, str] = {}
    named = random.random() < 0.5

    def path(own: tuple[str, ...]) -> Iterator[str]:
        for name in own:
            if not name.startswith("."):
                yield name if name in PLAIN else "div"
            elif named:
                if name not in renamed:
                    renamed[name] = f".x{int(random.integers(1 << 20))}"
                yield renamed[name]

    return [Block(tuple(path(b.path)), b.text, b.linked, b.told) for b in page]


@dataclass
class Batch:
    """Blocks of some pages: flat features, and the blocks of each page."""

    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray
    counts: np.ndarray
    labels: np.ndarray | None = None


def features(pages: list[list[Block]]) -> Batch:
    flat = [b for p in pages for b in p]
    counts = np.array([len(p) for p in pages])
    known: dict[Path | tuple[str, ...], list[int]] = {}
    path, lengths = [], []
    for b in flat:
        own = known.get(b.path)
        if own is None:
            own = known[b.path] = path_kinds(b.path)
        path += own
        lengths.append(len(own))
    text, offsets = utf8(pa.array([b.text for b in flat], pa.string()), lower=True)
    starts, ends, first = word_spans(text, offsets, NON_SPACE)
    word = (word_hashes(text, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    chars = np.diff(offsets).astype(float)
    place = np.concatenate([np.arange(c) / max(1, c - 1) for c in counts]) if len(flat) else np.zeros(0)
    stops = np.diff(np.concatenate([[0], np.cumsum(np.isin(text, np.frombuffer(b".,;:!?", np.uint8)))])[offsets])
    measures = np.stack([np.log1p(chars) / 4, np.array([b.linked for b in flat]) / np.maximum(1, chars), place, np.log1p(np.diff(first)) / 3, np.minimum(1, 10 * stops / np.maximum(1, chars))], 1) if flat else np.zeros((0, MEASURES))
    return Batch(np.array(path, np.int64), np.repeat(np.arange(len(flat)), lengths), word, rows_of(first), measures, counts)


@dataclass
class Net:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Net:
        r = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + MEASURES
        w = {"path": r.normal(0, 0.3, (PATHS, PATH_DIM)), "word": r.normal(0, 0.1, (WORDS, WORD_DIM)), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in ("f", "b"):
            w[f"in_{side}"] = r.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN))
            w[f"rec_{side}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w[f"off_{side}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        return Net(w)

    def inputs(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(batch.measures)
        w = self.weights
        paths = 1 / np.sqrt(np.maximum(1, np.bincount(batch.path_of, minlength=n)))
        words = 1 / np.maximum(1, np.bincount(batch.word_of, minlength=n))
        out = np.zeros((n, PATH_DIM + WORD_DIM + MEASURES))
        for d in range(PATH_DIM):
            out[:, d] = np.bincount(batch.path_of, w["path"][batch.path, d], n) * paths
        for d in range(WORD_DIM):
            out[:, PATH_DIM + d] = np.bincount(batch.word_of, w["word"][batch.word, d], n) * words
        out[:, PATH_DIM + WORD_DIM :] = batch.measures
        return out, paths, words

    def run(self, x: np.ndarray, counts: np.ndarray, keep: bool = False):
        """Logits of all blocks. keep: what the way back needs, too."""
        n, longest = len(counts), int(counts.max()) if len(counts) else 0
        first = np.cumsum(counts) - counts
        logits, kept = np.full(len(x), self.weights["bias"][0]), []
        for k, side in enumerate("fb"):
            drive = x @ self.weights[f"in_{side}"] + self.weights[f"off_{side}"]
            rec, out = self.weights[f"rec_{side}"], self.weights["out"][k * HIDDEN : (k + 1) * HIDDEN]
            h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            steps = []
            for t in range(longest):
                on = np.flatnonzero(counts > t)
                at = first[on] + (t if side == "f" else counts[on] - 1 - t)
                z = drive[at] + h[on] @ rec
                gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
                new = np.tanh(z[:, 3 * HIDDEN :])
                c_old, h_old = c[on], h[on]
                cell = gates[:, :HIDDEN] * c_old + gates[:, HIDDEN : 2 * HIDDEN] * new
                flat = np.tanh(cell)
                c[on], h[on] = cell, gates[:, 2 * HIDDEN :] * flat
                logits[at] += h[on] @ out
                if keep:
                    steps.append((on, at, gates, new, c_old, h_old, flat, h[on]))
            kept.append(steps)
        return (logits, kept) if keep else logits

    def learn(self, batch: Batch, squares: dict[str, np.ndarray], rate: float) -> float:
        w = self.weights
        x, paths, words = self.inputs(batch)
        logits, kept = self.run(x, batch.counts, keep=True)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        told = batch.labels >= 0
        error = np.where(told, p - batch.labels, 0) / max(1, told.sum())
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["bias"][0] = error.sum()
        back_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            out = w["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((len(batch.counts), HIDDEN)), np.zeros((len(batch.counts), HIDDEN))
            for on, at, gates, new, c_old, h_old, flat, h in reversed(kept[k]):
                f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                grad["out"][k * HIDDEN : (k + 1) * HIDDEN] += error[at] @ h
                d = dh[on] + error[at][:, None] * out
                cell = dc[on] + d * o * (1 - flat**2)
                z = np.concatenate([cell * c_old * f * (1 - f), cell * new * i * (1 - i), d * flat * o * (1 - o), cell * i * (1 - new**2)], 1)
                grad[f"rec_{side}"] += h_old.T @ z
                grad[f"in_{side}"] += x[at].T @ z
                grad[f"off_{side}"] += z.sum(0)
                back_x[at] += z @ w[f"in_{side}"].T
                dh[on], dc[on] = z @ w[f"rec_{side}"].T, cell * f
        np.add.at(grad["path"], batch.path, (back_x[:, :PATH_DIM] * paths[:, None])[batch.path_of])
        np.add.at(grad["word"], batch.word, (back_x[:, PATH_DIM : PATH_DIM + WORD_DIM] * words[:, None])[batch.word_of])
        for name, g in grad.items():
            squares[name] += g**2
            w[name] -= rate * g / np.sqrt(squares[name])
        return float(-np.log(np.where(batch.labels == 1, p, 1 - p)[told] + 1e-12).mean()) if told.any() else 0.0


@dataclass
class Texts:
    """What generated pages are made of: short and longer texts, of the main text and beside it."""

    main: list[str]
    heads: list[str]
    side: list[str]
    links: list[str]


def texts_of(pages: list[list[Block]], random: np.random.Generator) -> Texts:
    """From blocks whose label is told; made-up words where there are none."""
    soup = lambda low, high: " ".join(f"word{int(k)}" for k in random.integers(0, 400, int(random.integers(low, high))))
    some = lambda told, short, low, high: [b.text for p in pages for b in p if b.told == told and (len(b.text.split()) < 6) == short][:4000] or [soup(low, high) + ("" if short else ".") for _ in range(200)]
    return Texts(some(1, False, 6, 80), some(1, True, 2, 6), some(0, False, 6, 25), some(0, True, 1, 5))


def generated_page(random: np.random.Generator, texts: Texts) -> str:
    """A page of a random layout, whose names tell the labels."""
    pick = lambda *options: options[int(random.integers(len(options)))]
    text = lambda of: html.escape(of[int(random.integers(len(of)))])

    def box(name: str, inner: str) -> str:
        if name in ("nav", "header", "footer", "aside", "form", "article", "main"):
            return f"<{name}>{inner}</{name}>"
        tag = pick("div", "section")
        return f'<{tag} {pick("class", "id")}="{pick("", "site-", "page-")}{name}">{inner}</{tag}>'

    menu = lambda: "<ul>" + "".join(f'<li><a href="#">{text(texts.links)}</a></li>' for _ in range(int(random.integers(2, 9)))) + "</ul>"
    lines = lambda of, low, high: "".join(f"<p>{text(of)}</p>" for _ in range(int(random.integers(low, high))))
    paragraphs = lambda low, high: "".join(f"<{t}>{text(texts.heads if t == 'h2' else texts.main)}</{t}>" for t in [pick("p", "p", "p", "p", "h2", "blockquote", "li") for _ in range(int(random.integers(low, high)))])
    side = {
        "menu": lambda: box(pick("nav", "navbar", "menu", "breadcrumbs"), menu()),
        "header": lambda: box(pick("header", "masthead", "banner"), f"<h1>{text(texts.links)}</h1>" + lines(texts.side, 0, 2)),
        "ad": lambda: box(pick("ad", "ads", "advert", "promo", "sponsored"), text(texts.side)),
        "notice": lambda: box(pick("cookie", "notice", "consent", "popup", "newsletter"), f"<p>{text(texts.side)}</p><button>{text(texts.links)}</button>"),
        "aside": lambda: box(pick("aside", "sidebar", "related", "social", "share"), f"<h3>{text(texts.links)}</h3>" + pick(menu, lambda: lines(texts.side, 1, 3))()),
        "form": lambda: box(pick("form", "search", "login", "subscribe"), f"<label>{text(texts.links)}</label><input><button>{text(texts.links)}</button>"),
        "comments": lambda: box(pick("comments", "comment", "discussion", "replies"), f"<h3>{text(texts.links)}</h3>" + lines(texts.side, 1, 6)),
        "footer": lambda: box(pick("footer", "copyright"), f"<p>{text(texts.side)}</p>"),
    }
    title = f"<h1>{text(texts.heads)}</h1>"
    body = pick(title, f"<header>{title}</header>") + paragraphs(1, 14)
    if random.random() < 0.3:
        body += side[pick("ad", "aside", "notice", "comments")]() + paragraphs(0, 5)
    head = [side[k]() for k in ("menu", "header", "notice", "ad", "form", "aside") if random.random() < 0.45]
    tail = [side[k]() for k in ("aside", "ad", "form", "comments", "notice") if random.random() < 0.4]
    return f"<html><body>{''.join(head)}{box(pick('article', 'main', 'content', 'post', 'entry', 'story'), body)}{''.join(tail)}{side['footer']()}</body></html>"


def fit(pages: list[list[Block]], generated: int = 240, epochs: int = 24, rate: float = 0.12, seed: int = 19) -> Net:
    """Trains on the pages and as many generated ones as said."""
    random = np.random.default_rng(seed)
    texts = texts_of(pages, random)
    every = [*pages, *[blocks_of(generated_page(random, texts)) for _ in range(generated)]]
    every = [p for p in every if p]
    net = Net.fresh(seed)
    squares = {k: np.full_like(v, 1e-3) for k, v in net.weights.items()}
    for _ in range(epochs):
        order = random.permutation(len(every))
        for at in range(0, len(order), 16):
            some = [made_alike(every[i], random) if random.random() < 0.5 else every[i] for i in order[at : at + 16]]
            batch = features(some)
            batch.labels = np.array([b.told for p in some for b in p])
            net.learn(batch, squares, rate)
    net.weights = {k: v.astype(np.float32) for k, v in net.weights.items()}
    return net


def train(pages: DataFrame, rows: int = 200, key_col: str = "page_id", html_col: str = "html", blocks: int = 400) -> Net:
    """Fits on about ``rows`` of the pages; those of more than ``blocks`` blocks are passed over in training alone."""
    chosen = bounded_sample(pages.select(F.col(key_col).cast("string").alias("key"), F.col(html_col).cast("string").alias("html")).filter("html IS NOT NULL"), "key", rows)
    got = sorted((r["key"] or "", r["html"]) for r in chosen.collect())
    cut = [blocks_of(page) for _, page in got]
    return fit([p for p in cut if len(p) <= blocks])


def label(net: Net, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page which of its blocks are main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        to = min(len(order), at + 256)
        while to > at + 1 and (to - at) * len(pages[order[to - 1]]) > 60_000:
            to = at + (to - at) // 2
        batch = features([pages[i] for i in order[at:to]])
        main = net.run(net.inputs(batch)[0].astype(np.float32), batch.counts) > 0
        ends = np.cumsum(batch.counts)
        for i, a, b in zip(order[at:to], (ends - batch.counts).tolist(), ends.tolist(), strict=True):
            out[i] = main[a:b]
        at = to
    return out


def extract(pages: DataFrame, net: Net, html_col: str = "html", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """The columns ``keep`` (all but the html, if None), the main text as ``out``, and n_blocks and n_main int."""
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    refuse_columns(pages.select(*[F.col(f"`{c}`") for c in keep]), out, "n_blocks", "n_main")
    narrow, names = numbered(pages, keep, F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = widened(narrow.drop("__html"), **{out: "string", "n_blocks": "int", "n_main": "int"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("__html"), 2 << 20, 1024):
                cut = [blocks_of(page) for page in batch.column("__html").slice(a, b - a).to_pylist()]
                flags = label(net, cut)
                texts = ["\n".join(x.text for x, f in zip(p, on.tolist(), strict=True) if f) for p, on in zip(cut, flags, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in names], pa.array(texts, pa.string()), pa.array([len(p) for p in cut], pa.int32()), pa.array([int(f.sum()) for f in flags], pa.int32())], schema.names
                )

    return narrow.mapInArrow(run, schema).toDF(*keep, *schema.names[len(keep) :])
