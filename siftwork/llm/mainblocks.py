"""HTML main-text extraction with a recurrent block labeller.

A page is read into blocks, the runs of text between block-level tags, each with its tag path: open tags with their class, id and role
words. A block's input is a hashed vector of its path, a hashed vector of its words and a few shape numbers. A bidirectional LSTM reads
the sequence of a page's blocks forwards and backwards, so every block is classified in the light of the whole document; the blocks
labelled main are joined. Path and word vectors are fixed hashes, the LSTM and its output layer are trained here, in numpy.

Training needs no hand labels: for at most ``MAX_PAGES`` pages (smallest hashed ids), blocks get the label their own markup declares
(inside ``article`` or ``main`` and not inside menus, footers and the like), and the pages are varied: containers are renamed to other
usual ones, and side blocks (headers, sidebars, notices, adverts, forms, reader comments) made from the page's own words are put in.
Pages are learned in stretches of ``STRETCH`` blocks, and of all stretches of these pages at most ``MAX_STRETCHES`` (smallest hashes).

Whole pages are read; nothing is cut or capped. The model, a few thousand numbers, is broadcast; pages are scored where they lie.

Nulls and edges: null and empty html give empty text; unclosed, unopened and crossed tags are closed as they come; text outside any
block tag is a block; a head ends at the first tag or text that cannot stand in it, closed or not; scripts, styles, templates, fallbacks
for browsers without scripts and comments are no text; ties between stretches keep any; repeated rows and null ids are handled like others; a table
without pages, or without declared main blocks to learn from, is learned from a built-in page. Extra columns are kept by ``extract``.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PAGES, PATH, WORDS, HIDDEN = 240, 64, 16, 16
SHAPE = 5
STRETCH, MAX_STRETCHES = 400, 300
#: The element names of the HTML standard that start a block, that have no content, and whose content is no text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript title head svg iframe select textarea button".split())
#: The elements that can stand in a head.
HEAD_PARTS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements an opening tag of the key closes when it is still open, within the nearest of the given containers.
ENDS = {"p": ({"p"}, {"div", "article", "section", "main", "li", "td", "body", "blockquote"}), "li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}

#: Names that declare a part of a page; the teacher reads them, and training pages are varied with them.
MAIN_PARTS = ("article", "main", "div.article", "div.post", "div.entry-content", "div.content", "section.story", "div.post-content", "div.article-body", "div.text", "main.page", "section.main")
SIDE_PARTS = ("nav", "footer", "header", "aside", "form", "div.ad", "div.ads", "div.advert", "div.banner", "div.sidebar", "div.menu", "div.navbar", "ul.nav", "div.footer", "div.header", "div.cookie", "div.cookie-notice", "div.notice", "div.newsletter", "div.comments", "section.comments", "div.comment", "ol.commentlist", "div.related", "div.share", "div.social", "div.promo", "div.sponsored", "div.breadcrumb", "div.login", "aside.sidebar", "div.popup", "div.subscribe", "div.widget", "div.copyright", "div.replies")
_MAIN = {x for p in MAIN_PARTS for x in [p.split(".")[-1]]}
_SIDE = {x for p in SIDE_PARTS for x in [p.split(".")[-1]]}
Block = tuple[tuple[str, ...], str]  # path ("div.ad", ...), text


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.silent = 0
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.blocks: list[tuple[tuple[str, ...], str, float]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((tuple(n for _, n in self.stack), text, self.linked / max(1, len("".join(self.parts)))))
        self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.stack[at:]

    def _end_head(self) -> None:
        heads = [i for i, (t, _) in enumerate(self.stack) if t == "head"]
        if heads:
            self.flush()
            self._pop(heads[0])

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body" or tag not in HEAD_PARTS and self.stack and self.stack[-1][0] == "head":
            self._end_head()
        if tag in BLOCKS:
            self.flush()
            within = ENDS.get(tag)
            if within:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] in within[0]:
                        self._pop(i)
                        break
                    if self.stack[i][0] in within[1]:
                        break
        elif tag in ("br", "img"):
            self.parts.append(" ")
        if tag not in VOID:
            named = [w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in v.split()]
            self.stack.append((tag, ".".join([tag, *named])))
            self.silent += tag in SILENT
            self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                break
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                break

    def handle_data(self, data: str) -> None:
        if self.silent and self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            self.linked += len(data) * (self.links > 0)


def read_blocks(html: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of linked text) of every block, in page order."""
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


@lru_cache(1 << 16)
def _slot(word: str, size: int, salt: int) -> tuple[int, float]:
    h = zlib.crc32(f"{salt}{word}".encode("utf-8", "replace"))
    return h % size, 1.0 if h & 1 << 20 else -1.0


@lru_cache(1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, np.float32)
    for depth, part in enumerate(path):
        for word in {w for x in part.split(".") for w in [x, *re.split(r"[-_]", x)] if w}:
            i, sign = _slot(word, PATH, 1)
            out[i] += sign * 2.0
    if path:
        i, sign = _slot(path[-1].split(".")[0], PATH, 2)
        out[i] += sign
    return out


def vectors(blocks: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    out = np.zeros((len(blocks), PATH + WORDS + SHAPE), np.float32)
    for row, (path, text, linked) in zip(out, blocks):
        row[:PATH] = _path_vector(path)
        words = text.lower().split()
        for w in words:
            i, sign = _slot(w, WORDS, 3)
            row[PATH + i] += sign
        row[PATH:PATH + WORDS] /= max(1.0, len(words)) ** 0.5
        row[PATH + WORDS:] = np.log1p(len(words)) / 4, linked, min(1.0, sum(text.count(c) for c in ".!?,;:") / max(1, len(words))), text[:1].isupper(), len(path) / 10
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """x: (time, rows, inputs) -> hidden states, and what the backward pass needs."""
    h = c = np.zeros((x.shape[1], HIDDEN))
    states, memory = [], []
    for step in x:
        joined = np.concatenate([step, h], 1)
        z = joined @ w + b
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        before, c = c, f * c + i * g
        tanh_c = np.tanh(c)
        h = o * tanh_c
        states.append(h)
        memory.append((joined, i, f, o, g, before, tanh_c))
    return np.stack(states), memory


def _lstm_back(grad: np.ndarray, memory: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, db = np.zeros_like(w), np.zeros(w.shape[1])
    dh = dc = 0.0
    for t in range(len(memory) - 1, -1, -1):
        joined, i, f, o, g, before, tanh_c = memory[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tanh_c ** 2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g ** 2)], 1)
        dw += joined.T @ dz
        db += dz.sum(0)
        dh = dz @ w[-HIDDEN:].T
        dc = dc * f
    return dw, db


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first ``lengths`` steps in reverse order, the padding left at the end."""
    t = np.arange(x.shape[0])[:, None]
    return np.take_along_axis(x, np.where(t < lengths, lengths - 1 - t, t)[:, :, None], 0)


Model = dict[str, np.ndarray]


def _forward(x: np.ndarray, lengths: np.ndarray, m: Model):
    ahead, mem1 = _lstm(x, m["w1"], m["b1"])
    behind, mem2 = _lstm(_turned(x, lengths), m["w2"], m["b2"])
    both = np.concatenate([ahead, _turned(behind, lengths), x], 2)
    return both, both @ m["v"] + m["c"], mem1, mem2


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.01, batch: int = 24) -> Model:
    """Bidirectional LSTM by Adam on the block labels of ``pages`` (vectors, labels)."""
    rng = np.random.default_rng(3)
    inputs = PATH + WORDS + SHAPE
    shape = (inputs + HIDDEN, 4 * HIDDEN)
    m: Model = {"w1": rng.normal(0, 0.08, shape), "b1": np.zeros(4 * HIDDEN), "w2": rng.normal(0, 0.08, shape), "b2": np.zeros(4 * HIDDEN), "v": rng.normal(0, 0.08, 2 * HIDDEN + inputs), "c": np.zeros(1)}
    for b in ("b1", "b2"):
        m[b][HIDDEN:2 * HIDDEN] = 1.0
    first, second = ({k: np.zeros_like(x) for k, x in m.items()} for _ in range(2))
    t = 0
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
    groups = [order[i:i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, lengths = _padded([pages[i][0] for i in groups[k]])
            y, _ = _padded([pages[i][1][:, None] for i in groups[k]])
            live = np.arange(x.shape[0])[:, None] < lengths
            both, z, mem1, mem2 = _forward(x, lengths, m)
            dz = (_sigmoid(z) - y[:, :, 0]) * live / live.sum()
            g = {"v": np.tensordot(dz, both, ([0, 1], [0, 1])), "c": dz.sum(keepdims=True).ravel()}
            dh = dz[:, :, None] * m["v"]
            g["w1"], g["b1"] = _lstm_back(dh[:, :, :HIDDEN], mem1, m["w1"])
            g["w2"], g["b2"] = _lstm_back(_turned(dh[:, :, HIDDEN:2 * HIDDEN], lengths), mem2, m["w2"])
            t += 1
            size = np.sqrt(sum((v * v).sum() for v in g.values()))
            for n, v in g.items():
                v = v / max(1.0, size)
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.999 * second[n] + 0.001 * v * v
                m[n] = m[n] - rate * (0.5 if epoch > epochs // 2 else 1.0) * first[n] / (1 - 0.9 ** t) / (np.sqrt(second[n] / (1 - 0.999 ** t)) + 1e-8)
    return m


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((lengths.max(), len(rows), rows[0].shape[1]))
    for i, r in enumerate(rows):
        out[:len(r), i] = r
    return out, lengths


def label(pages: list[np.ndarray], m: Model) -> list[np.ndarray]:
    """Probability of main text for each block of each page; pages of similar length go together."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
    at = 0
    while at < len(order):
        step = max(1, min(256, 40_000 // len(pages[order[min(at + 255, len(order) - 1)]])))
        part = order[at:at + step]
        at += step
        x, lengths = _padded([pages[i] for i in part])
        z = _forward(x, lengths, m)[1]
        for column, i in enumerate(part):
            out[i] = _sigmoid(z[:lengths[column], column])
    return out


def declared(path: tuple[str, ...]) -> bool:
    """The teacher: does the markup itself say that this is main text? The innermost named part decides."""
    for part in reversed(path):
        words = set(part.split("."))
        if words & _SIDE:
            return False
        if words & _MAIN:
            return True
    return False


def variations(blocks, rng: np.random.Generator, copies: int) -> Iterator[tuple[list, np.ndarray]]:
    """Training pages from one page: the page itself, then versions with other containers and more side blocks."""
    yield blocks, np.array([declared(p) for p, _, _ in blocks], float)
    words = [w for _, t, _ in blocks for w in t.split()] or ["x"]
    pick = lambda names: names[rng.integers(len(names))]

    def extra(main: str | None) -> list:
        side = pick(SIDE_PARTS)
        base = ("html", "body", *([main] if main else []), side)
        inner = pick([("p",), ("ul", "li"), ("div", "p"), (), ("h3",), ("label",), ("div.item", "p")])
        out = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.choice([1, 2, 4, 12, 40]))
            start = int(rng.integers(len(words)))
            out.append(((*base, *inner), " ".join(words[start:start + n]), float(rng.random() < 0.3)))
        return out
    for _ in range(copies):
        rename: dict[str, str] = {}
        main_name = pick(MAIN_PARTS)
        out, y = [], []
        main_now = [p for p, _, _ in blocks if declared(p)]
        inside = main_now[len(main_now) // 2] if main_now else None
        for path, text, linked in blocks:
            is_main = declared(path)
            new = []
            for part in path:
                named = set(part.split("."))
                if named & _SIDE:
                    part = rename.setdefault(part, pick(SIDE_PARTS))
                elif named & _MAIN:
                    part = main_name
                new.append(part)
            if rng.random() < 0.08:
                add = extra(main_name if is_main and rng.random() < 0.7 else None)
                out += add
                y += [0.0] * len(add)
            out.append((tuple(new), text, linked))
            y.append(float(is_main))
        for where in (0, None):
            if rng.random() < 0.7:
                add = extra(main_name if where is None and inside is not None and rng.random() < 0.4 else None)
                out, y = (add + out, [0.0] * len(add) + y) if where == 0 else (out + add, y + [0.0] * len(add))
        if rng.random() < 0.3:  # wrappers that say nothing
            out = [((*p[:2], "div", *p[2:]), t, l) for p, t, l in out]
        yield out, np.array(y)


#: A page to learn from where a table has none.
EXAMPLE = "<html><body><header>Site name</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class=ad>Buy one now.</div><article><h1>A title of some words</h1><p>First sentence of the text, which goes on for a while. Then a second one.<p>Another paragraph with more words in it, and an end.</article><aside>Read more</aside><div class=comments><p>Nice text, thanks!</div><footer>All rights reserved</footer></body></html>"


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, copies: int = 5) -> Model:
    """Trains in one task on at most ``max_pages`` pages."""
    sample = pages.where(F.col("html").isNotNull()).select("html", F.xxhash64("html").alias("h")).orderBy("h").limit(max_pages).select("html")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(5)
        made = [b for f in frames for b in map(read_blocks, sorted(f.html)) if any(declared(p) for p, _, _ in b)] or [read_blocks(EXAMPLE)]
        made.append(read_blocks(EXAMPLE))
        parts = [page[i:i + STRETCH] for page in made for i in range(0, len(page), STRETCH)]
        if len(parts) > MAX_STRETCHES:
            named = sorted((zlib.crc32("\n".join(t for _, t, _ in part).encode("utf-8", "replace")), i) for i, part in enumerate(parts))
            parts = [parts[i] for i in sorted(i for _, i in named[:MAX_STRETCHES])]
        rows = [(vectors(b), y) for part in parts for b, y in variations(part, rng, copies)]
        m = train(rows)
        yield pd.DataFrame({"name": list(m), "shape": [list(x.shape) for x in m.values()], "value": [x.ravel().tolist() for x in m.values()]})
    found = sample.repartition(1).mapInPandas(learn, "name string, shape array<int>, value array<double>").collect()
    return {r["name"]: np.reshape(r["value"], r["shape"]) for r in found}


def extract(pages: DataFrame, model: Model, out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html``: main blocks joined by line feeds."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    plain = pages.drop(out)
    target = T.StructType([*plain.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                read = [read_blocks(h) for h in b.column(b.schema.get_field_index("html")).to_pylist()]
                marks = label([vectors(x) for x in read], shared.value)
                texts = ["\n".join(t for (_, t, _), p in zip(x, y) if p >= 0.5) for x, y in zip(read, marks)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[f.name for f in target.fields])
    return plain.mapInArrow(run, target)
