"""HTML extraction by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags.
Each block gets a vector of its tag path (tags, classes and ids of all open
elements, hashed), its words (hashed) and a few sizes. A bidirectional LSTM in
numpy reads the whole sequence of a page's blocks, so that each is judged with
the document before and behind it, and labels every block as article or not.
Blocks that are labelled article are joined in page order by an empty line.

The weights are trained by ``html_train`` on generated layouts and lie beside
this file; ``WEIGHTS`` can be replaced by a path parameter.

Defined results: null and empty pages, and pages without an article, have the
empty text; unclosed tags and truncated pages are read as far as they go;
character references are decoded, white space (Unicode) inside a block becomes
one space; pages of any length are read whole; repeated rows give equal
results; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.llm.common import slices

PATH_DIM, WORD_DIM, SIZE_DIM, HIDDEN = 96, 32, 8, 24
INPUT = PATH_DIM + WORD_DIM + SIZE_DIM
WEIGHTS = Path(__file__).with_name("html_weights.npz")
#: Characters of HTML whose blocks are in memory at once (and one page, if longer).
PART = 2_000_000

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mspace mtable mtr mtd maction semantics"
INLINE = frozenset(f"{MATH} a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
UNREAD = frozenset("script style template noscript textarea title svg iframe object canvas select annotation annotation-xml".split())
#: Only these are empty when they close themselves; "/" has no meaning in other start tags of UNREAD.
FOREIGN = frozenset("svg annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?=[a-zA-Z/])[^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in UNREAD}


class Block:
    __slots__ = ("path", "pieces", "linked")

    def __init__(self, path):
        self.path, self.pieces, self.linked = path, [], 0


def element(tag: str, attributes: str) -> tuple[str, ...]:
    """An open element as its tag and the name parts of its class, id and role."""
    if "=" not in attributes:
        return (tag,)
    names = " ".join(next(x for x in m if x is not None) if any(m) else "" for m in (tuple(g or None for g in f) for f in NAMES.findall(attributes)))
    return (tag, *dict.fromkeys(PARTS.findall(names.lower())))


def blocks(page: str | None) -> list[tuple[tuple, str, int]]:
    """(path, text, linked characters) of each leaf block that has text, in page order."""
    out: list[tuple[tuple, str, int]] = []
    if not page:
        return out
    stack: list[tuple[str, ...]] = []
    current = Block(())
    links = 0

    def cut():
        nonlocal current
        if current.pieces:
            text = " ".join(html.unescape("".join(current.pieces)).split())
            if text:
                out.append((current.path, text, current.linked))
        current = Block(None)

    def add(text: str):
        if current.path is None or not current.pieces:
            current.path = tuple(stack)
        current.pieces.append(text)
        if links:
            current.linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            if at < n:
                add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE or any(e[0] not in INLINE for e in stack[k:]):
                        cut()
                    links -= sum(e[0] == "a" for e in stack[k:])
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # a stray inline end tag does not close a block
            continue
        if tag in UNREAD:
            if tag in FOREIGN and m[3].endswith("/"):
                continue
            end = END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            if current.pieces:
                current.pieces.append(" ")
            continue
        if tag not in INLINE:
            cut()
            if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th"):
                for k in range(len(stack) - 1, -1, -1):
                    name = stack[k][0]
                    if name == tag and tag in ("li", "dt", "dd", "tr", "td", "th") or name == "p" and tag in CLOSES_P:
                        links -= sum(e[0] == "a" for e in stack[k:])
                        del stack[k:]
                        break
                    if name not in INLINE and name != "p":
                        break
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(element(tag, m[3]))
            links += tag == "a"
    cut()
    return out


def bucket(text: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    return (h >> 1) % dim, 1.0 if h & 1 else -1.0


class Vectors:
    """Block vectors, with bounded memories for paths and words."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, tuple[int, float]] = {}

    def path(self, path: tuple) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            found = np.zeros(PATH_DIM, np.float32)
            inner = len(path) - 1
            for depth, names in enumerate(path):
                for k, name in enumerate(names):
                    i, sign = bucket(f"{'t' if k == 0 else 'n'}:{name}", PATH_DIM)
                    found[i] += sign
                    if depth == inner:
                        i, sign = bucket(f"last:{k == 0}:{name}", PATH_DIM)
                        found[i] += sign
            if len(self.paths) >= 20_000:
                self.paths.clear()
            self.paths[path] = found
        return found

    def vector(self, path: tuple, text: str, linked: int, place: float) -> np.ndarray:
        out = np.zeros(INPUT, np.float32)
        out[:PATH_DIM] = self.path(path)
        words = text.lower().split()
        known = self.words
        for w in words:
            f = known.get(w)
            if f is None:
                if len(known) >= 200_000:
                    known.clear()
                f = known[w] = bucket(w.strip(".,:;!?()\"'"), WORD_DIM)
            out[PATH_DIM + f[0]] += f[1]
        bag = out[PATH_DIM : PATH_DIM + WORD_DIM]
        np.clip(bag / (max(1.0, len(words) ** 0.5) * 2), -1, 1, out=bag)
        stops = text.count(".") + text.count("!") + text.count("?")
        out[PATH_DIM + WORD_DIM :] = (
            np.log1p(len(words)) / 3, np.log1p(len(text)) / 5, min(1.0, linked / max(1, len(text))), min(2.0, 8 * stops / max(1, len(words))),
            place, len(path) / 8, float(text[-1] in ".!?:\"'"), 1.0,
        )
        return out

    def page(self, found) -> np.ndarray:
        n = len(found)
        return np.array([self.vector(p, t, k, i / n) for i, (p, t, k) in enumerate(found)], np.float32).reshape(n, INPUT)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output, over padded batches of pages."""

    NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "v", "c")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(weights[k], np.float32) for k in self.NAMES}

    @classmethod
    def load(cls, path=WEIGHTS) -> "Labeller":
        with np.load(path) as f:
            return cls({k: f[k] for k in cls.NAMES})

    def direction(self, x: np.ndarray, lengths: np.ndarray, w, u, b) -> np.ndarray:
        """Hidden states of steps x pages; pages are sorted by falling length."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        inputs = x @ w + b
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # pages longer than the step
        for t in range(steps):
            k = live[t]
            gates = inputs[t, :k] + h[:k] @ u
            i, f, o = np.split(sigmoid(gates[:, : 3 * HIDDEN]), 3, axis=1)
            c[:k] = f * c[:k] + i * np.tanh(gates[:, 3 * HIDDEN :])
            h[:k] = o * np.tanh(c[:k])
            out[t, :k] = h[:k]
        return out

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of article for each block of each page."""
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        result: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [i for i in order if len(pages[i])]
        at = 0
        while at < len(order):
            longest = len(pages[order[at]])
            some = order[at : at + max(1, min(512, 60_000 // longest))]
            at += len(some)
            lengths = np.array([len(pages[i]) for i in some])
            x = np.zeros((longest, len(some), INPUT), np.float32)
            back = np.zeros_like(x)
            for k, i in enumerate(some):
                x[: lengths[k], k], back[: lengths[k], k] = pages[i], pages[i][::-1]
            hf = self.direction(x, lengths, self.w["wf"], self.w["uf"], self.w["bf"])
            hb = self.direction(back, lengths, self.w["wb"], self.w["ub"], self.w["bb"])
            for k, i in enumerate(some):
                n = lengths[k]
                result[i] = sigmoid(np.concatenate([hf[:n, k], hb[:n, k][::-1]], axis=1) @ self.w["v"] + self.w["c"])[:, 0]
        return result


def main_texts(pages: list[str | None], model: Labeller, vectors: Vectors, bound: float = 0.5) -> list[str]:
    found = [blocks(p) for p in pages]
    chances = model.label([vectors.page(f) for f in found])
    return ["\n\n".join(text for (_, text, _), c in zip(f, p) if c >= bound) for f, p in zip(found, chances)]


def extract(pages: DataFrame, weights=WEIGHTS) -> DataFrame:
    """page_id, url, text and n_chars of every page; one pass without a shuffle."""
    import pyarrow as pa

    shared = pages.sparkSession.sparkContext.broadcast(Labeller.load(weights))  # 0.1 MB

    def run(batches):
        model, vectors = shared.value, Vectors()
        for batch in batches:
            htmls = batch.column(2).to_pylist()
            for a, b in slices([len(x or "") for x in htmls], PART):
                texts = main_texts(htmls[a:b], model, vectors)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
