"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks: the text between block-level tags. A bidirectional LSTM reads, per block, a
vector of its tag path (hashed tag names and words of class and id), a vector of its hashed words and a
few counts, and labels every block in the light of all the others. Content blocks are the text.

The network is numpy, trained on the driver on at most `SAMPLE` pages (those with the smallest hash of
their html) whose semantic tags say what is content. Copies of these pages with other tag names, and with
menus, comments, notices, forms and adverts added, teach it pages without such tags. Where no page of the sample has such
tags, labels come from the density of text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import hashed_sample
from tickloom.session import ship_by_value

SAMPLE = 1_000
STEPS = 400
HIDDEN = 16
PATHS, WORDS = 1_024, 2_048  # hash buckets
DIM = 12
COUNTS = 7

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_SIBLING = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
NOT_IN_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s>/]*+)((?>[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tag names and words of class and id of the nearest elements around it, outermost first
    linked: int
    main: bool = False  # some element around it is one of CONTENT
    other: bool = False  # some element around it is one of OTHER


NEAREST, NAMED = 16, 16


@dataclass(frozen=True)
class Element:
    name: str
    names: tuple[str, ...]
    main: bool
    other: bool


def blocks(page: str | None) -> list[Block]:
    """Non-empty blocks in page order, white space collapsed, character references decoded.

    A block names its NEAREST elements, with NAMED words of class and id each, and what the outer ones hand down is two flags: time and
    space stay in proportion to the page, however deep it nests.
    """
    found: list[Block] = []
    stack: list[Element] = []
    open_names: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else Element("", (), False, False)
            found.append(Block(text, tuple(x for e in stack[-NEAREST:] for x in e.names), linked, top.main, top.other))
        parts.clear()
        linked = 0

    def pop() -> Element:
        gone = stack.pop()
        open_names[gone.name] -= 1
        return gone

    def pop_to(name: str) -> None:
        if open_names.get(name):
            while pop().name != name:
                pass

    def push(name: str, names: tuple[str, ...]) -> None:
        above = stack[-1] if stack else Element("", (), False, False)
        stack.append(Element(name, names, above.main or bool(CONTENT & set(names)), above.other or bool(OTHER & set(names))))
        open_names[name] = open_names.get(name, 0) + 1

    at, page = 0, page or ""
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            linked += len(piece) * (in_link > 0)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            in_link = max(0, in_link + (-1 if m[2] else 1)) if name == "a" else in_link
            if name in ("br", "img", "wbr"):
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if m[2]:
            pop_to(name)
            continue
        if name in CLOSED_BY_SIBLING:
            last = stack[-1].name if stack else ""
            if last in CLOSED_BY_SIBLING[name].split():
                pop()
        if name in NOT_IN_P and stack and stack[-1].name == "p":
            pop()
        if name not in VOID and not m[4].endswith("/"):
            words = [w for g in NAMES.findall(m[4]) for w in re.split(r"[^a-z]+", "".join(g).lower()) if w]
            push(name, (name, *(f".{w}" for w in words[:NAMED])))
    parts.append(page[at:])
    flush()
    return found


def hashed(token: str, size: int) -> int:
    return crc32(token.encode("utf-8", "replace")) % size


def features(found: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Path buckets and word buckets of each block, and its counts."""
    paths = [np.array([hashed(t, PATHS) for t in b.path] or [0]) for b in found]
    words = [np.array([hashed(w, WORDS) for w in WORD.findall(b.text.lower())] or [0]) for b in found]
    n = max(1, len(found))
    counts = np.array([
        (np.log1p(len(b.text)) / 5, np.log1p(b.text.count(" ")) / 4, b.linked / max(1, len(b.text)), sum(map(b.text.count, ".!?,;")) / (1 + b.text.count(" ")), i / n, len(b.path) / 10, 1.0)
        for i, b in enumerate(found)], np.float32).reshape(len(found), COUNTS)
    return paths, words, counts


class Labeller:
    """Embeddings, one LSTM in each direction, a logistic output. Gates: input, forget, output, candidate."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = 2 * DIM + COUNTS
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"paths": draw(PATHS, DIM) * 8, "words": draw(WORDS, DIM) * 8, "out": draw(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.w[f"x{way}"], self.w[f"h{way}"] = draw(size, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            self.w[f"c{way}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)

    def inputs(self, pages) -> tuple[np.ndarray, np.ndarray]:
        """(steps, pages, size), and which steps are real."""
        steps = max(len(p[0]) for p in pages)
        x = np.zeros((steps, len(pages), 2 * DIM + COUNTS), np.float32)
        real = np.zeros((steps, len(pages)), bool)
        for k, (paths, words, counts) in enumerate(pages):
            n = len(paths)
            for lo, name, lists in ((0, "paths", paths), (DIM, "words", words)):
                sizes = np.array([len(v) for v in lists])
                rows = self.w[name][np.concatenate(lists)]
                x[:n, k, lo : lo + DIM] = np.add.reduceat(rows, np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]
            x[:n, k, 2 * DIM :] = counts
            real[:n, k] = True
        return x, real

    def forward(self, x, real, keep: bool = False):
        steps, pages, _ = x.shape
        both, tape = np.zeros((steps, pages, 2 * HIDDEN), np.float32), {}
        for w, way in enumerate("fb"):
            h = c = np.zeros((pages, HIDDEN), np.float32)
            z = x @ self.w[f"x{way}"] + self.w[f"c{way}"]
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                g = z[t] + h @ self.w[f"h{way}"]
                gates = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN].clip(-30, 30)))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                u = np.tanh(g[:, 3 * HIDDEN :])
                new = f * c + i * u
                live = real[t][:, None]
                if keep:
                    tape[way, t] = (h, c, i, f, o, u, new, live)
                c = np.where(live, new, c)
                h = np.where(live, o * np.tanh(new), h)
                both[t, :, w * HIDDEN : (w + 1) * HIDDEN] = h
        return 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["bias"])[..., 0].clip(-30, 30))), both, tape

    def gradients(self, pages, labels) -> dict[str, np.ndarray]:
        x, real = self.inputs(pages)
        p, both, tape = self.forward(x, real, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        d = np.where(real, p - labels, 0).astype(np.float32)[..., None] / max(1, real.sum())
        g["out"], g["bias"] = np.einsum("tph,tpo->ho", both, d), d.sum((0, 1))
        dboth, dx = d @ self.w["out"].T, np.zeros_like(x)
        for w, way in enumerate("fb"):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1) if way == "f" else range(len(x)):
                h, c, i, f, o, u, new, live = tape[way, t]
                total = dboth[t, :, w * HIDDEN : (w + 1) * HIDDEN] + dh
                th = np.tanh(new)
                dnew = np.where(live, total * o * (1 - th**2) + dc, 0)
                dz = np.where(live, np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), total * th * o * (1 - o), dnew * i * (1 - u**2)], 1), 0)
                g[f"x{way}"] += x[t].T @ dz
                g[f"h{way}"] += h.T @ dz
                g[f"c{way}"] += dz.sum(0)
                dx[t] += dz @ self.w[f"x{way}"].T
                dh = np.where(live, dz @ self.w[f"h{way}"].T, total)
                dc = np.where(live, dnew * f, dc)
        for k, (paths, words, _) in enumerate(pages):
            for lo, name, lists in ((0, "paths", paths), (DIM, "words", words)):
                sizes = np.array([len(v) for v in lists])
                np.add.at(g[name], np.concatenate(lists), np.repeat(dx[: len(lists), k, lo : lo + DIM] / sizes[:, None], sizes, axis=0))
        return g

    def fit(self, pages, labels, steps: int = STEPS, batch: int = 32, rate: float = 0.01, seed: int = 3) -> "Labeller":
        """Adam, the same number of steps for any number of pages."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        while step < steps:
            order = np.argsort([len(p[0]) + rng.random() * 8 for p in pages])
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for at in rng.permutation(len(groups)):
                some = [pages[i] for i in groups[at]]
                wanted = np.zeros((max(len(p[0]) for p in some), len(some)), np.float32)
                for k, i in enumerate(groups[at]):
                    wanted[: len(labels[i]), k] = labels[i]
                g, step = self.gradients(some, wanted), step + 1
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, pages) -> list[np.ndarray]:
        """Content or not, for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p[0])), key=lambda i: len(pages[i][0]))
        at = 0
        while at < len(order):  # pages of like length together; a batch stays under a fixed size
            size = max(1, min(256, 20_000 // len(pages[order[min(at + 255, len(order) - 1)]][0])))
            some = order[at : at + size]
            p, _, _ = self.forward(*self.inputs([pages[i] for i in some]))
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i][0]), k] >= 0.5
            at += size
        return out


# fixed values: element names, and words of class and id, that say what a part of a page is
CONTENT = frozenset(("article", "main"))
OTHER = frozenset(
    "nav header footer aside form head title button select label fieldset menu dialog .ad .ads .advert .advertisement .sponsored .promo .banner .menu .nav .navbar .navigation "
    ".header .footer .sidebar .widget .comment .comments .reply .replies .respond .cookie .cookies .consent .notice .alert .popup .modal .newsletter .subscribe .signup .login "
    ".share .social .related .breadcrumb .breadcrumbs .pagination .copyright".split())
INSTEAD = [("main",), ("div", ".content"), ("div", ".post"), ("div", ".entry", ".content"), ("section", ".story"), ("div", ".main"), ("div", ".article", ".body"), ("main", "article"), ("div",)]
ADDED = [
    ("aside",), ("aside", ".sidebar"), ("div", ".sidebar"), ("div", ".widget"), ("section", ".comments", "div", ".comment"), ("div", ".comments", "article", ".comment"), ("ol", ".comment", ".list", "li"),
    ("div", ".cookie", ".notice"), ("div", ".consent", ".banner"), ("div", ".notice"), ("form",), ("form", "label"), ("form", ".search"), ("div", ".newsletter", "form"), ("header",), ("header", ".site", ".header"),
    ("div", ".header"), ("div", ".menu", "ul", "li"), ("ul", ".menu", "li"), ("nav", "ul", "li"), ("div", ".footer"), ("footer",), ("div", ".advert"), ("div", ".ads"), ("div", ".sponsored"), ("div", ".promo"),
    ("div", ".related", "ul", "li"), ("div", ".share"), ("div", ".breadcrumbs"), ("div", ".popup"), ("div", ".alert"),
]


def silver(found: list[Block]) -> np.ndarray:
    """Content as the semantic tags have it."""
    return np.array([b.main and not b.other for b in found], bool)


DENSE_WORDS, LINKED = 10, 0.3


def dense(found: list[Block]) -> np.ndarray:
    """Content as the density of text has it, for pages whose tags say nothing: sentences that are no links, and what stands short between two of them."""
    full = np.array([
        not b.other and b.text.count(" ") + 1 >= DENSE_WORDS and b.linked <= LINKED * len(b.text) and any(c in b.text for c in ".!?。！？؟।") for b in found], bool)
    out = full.copy()
    for i in range(1, len(found) - 1):
        out[i] |= full[i - 1] and full[i + 1] and not found[i].other and found[i].linked <= LINKED * len(found[i].text)
    # a heading right before the first sentences belongs to them
    for i in range(len(found) - 1):
        out[i] |= bool(full[i + 1]) and found[i].path[-1:] in {("h1",), ("h2",), ("h3",)} and not found[i].other
    return out


def varied(found: list[Block], labels: np.ndarray, others: list[str], rng) -> tuple[list[Block], np.ndarray]:
    """The page in other clothes: other names for its main part, and parts that are not content."""
    name = INSTEAD[rng.integers(len(INSTEAD))]
    out = []
    for b, y in zip(found, labels):
        path = tuple(x for t in b.path for x in (name if t in CONTENT else (t,)))
        out.append((Block(b.text, path[-NEAREST * (NAMED + 1) :], b.linked), y))
    for _ in range(rng.integers(1, 4)):
        extra = ADDED[rng.integers(len(ADDED))]
        inside = rng.random() < 0.3  # a part inside the main one
        ys = [y for _, y in out]
        places = [i for i in range(len(out) + 1) if (0 < i < len(out) and ys[i - 1] and ys[i]) == inside]
        at = places[rng.integers(len(places))] if places else len(out)
        base = ("html", "body", *(name if inside else ()))
        texts = [others[rng.integers(len(others))] for _ in range(rng.integers(1, 5))]
        tail = ("p",) if rng.random() < 0.5 else ()
        out[at:at] = [(Block(t, (*base, *extra, *tail), len(t) if "li" in extra else 0), False) for t in texts]
    return [b for b, _ in out], np.array([y for _, y in out], bool)


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """A labeller from at most `sample` pages, of which the first 200,000 characters and 400 blocks are learnt; without any page, an untrained one.

    Pages whose tags name no main part say nothing and are not learnt from; where none does, the density of text is what is learnt.
    """
    some = hashed_sample(pages.select(F.substring(html_col, 1, 200_000).alias("h")), "h", sample)
    rng, seen = np.random.default_rng(11), [b for b in (blocks(h)[:400] for h in some) if b]
    if not seen:
        return Labeller()
    texts = [b.text for page in seen for b in page]
    pairs = [(b, y) for b, y in ((b, silver(b)) for b in seen) if y.any()] or [(b, dense(b)) for b in seen]
    pairs += [varied(b, y, texts, rng) for b, y in pairs]
    return Labeller().fit([features(b) for b, _ in pairs], [y for _, y in pairs])


def extract(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars in place of columns of those names.

    Content blocks joined by a new line, "" if there are none or the page is null. Every block
    of every page is labelled, however long the page.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    at = rest.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [blocks(h) for h in part.column(at).to_pylist()]
                labels = shared.value.label([features(b) for b in found])
                texts = ["\n".join(b.text for b, y in zip(page, ys) if y) for page, ys in zip(found, labels)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*rest).mapInArrow(run, pages.select(*rest).schema.add("text", "string").add("n_chars", "long"))


ship_by_value(__name__)
