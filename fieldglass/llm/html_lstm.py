"""Main text of web pages by a bidirectional LSTM over leaf blocks.

A page becomes its sequence of leaf blocks.  Each block is read as a hashed vector of its tag path, a
hashed vector of its words and a few numbers; a numpy LSTM in both directions classifies every block
with the whole page in view.  The network is trained here, on a bounded sample of pages whose blocks
are labelled by their semantic elements, with parts of pages renamed, moved in and left out so that
it does not lean on one convention.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 256  # pages that the network is trained on, at most
PATH, WORDS, EXTRA, HIDDEN = 48, 24, 6, 16
_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*(?:>|$)""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
# Fixed values of the HTML language.
HIDDEN_TAGS = {"script", "style", "head", "title", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "canvas", "video", "audio"}
RAW_TAGS = {"script", "style", "title", "textarea", "noscript", "iframe", "template"}
INLINE_TAGS = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements and class words that mark a block as no main text, for the training labels (fixed values).
ASIDE_TAGS = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "header"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "cookie", "consent", "disqus", "footer", "header", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "reply", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
}
MAIN_TAGS = {"article", "main"}


def blocks(page: str | None) -> list[tuple[tuple, str, int]]:
    """Leaf blocks in page order: (path of (tag, names), text, characters inside links)."""
    page = page or ""
    stack: list[tuple[str, tuple]] = []
    found, parts, linked = [], [], 0
    state = {"hidden": 0, "links": 0}

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            path = tuple(s for s in stack if s[0] not in INLINE_TAGS)
            found.append((path, text, min(linked, len(text))))
        parts, linked = [], 0

    def pop_to(depth):
        for tag, _ in stack[depth:]:
            state["hidden"] -= tag in HIDDEN_TAGS
            state["links"] -= tag == "a"
        del stack[depth:]

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text and not state["hidden"]:
            parts.append(text)
            linked += len(text) if state["links"] else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br" and not state["hidden"]:
            parts.append(" ")
        elif tag not in INLINE_TAGS:
            flush()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
            continue
        if tag not in INLINE_TAGS:
            closes = CLOSES.get(tag, set())
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or stack[depth][0] in closes:
                    pop_to(depth)
                    break
                if stack[depth][0] not in INLINE_TAGS:
                    break
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        names = tuple(w for n in _NAMES.findall(m[3]) for w in re.split(r"[^a-z0-9]+", "".join(n).lower()) if w) if "=" in m[3] else ()
        stack.append((tag, names))
        state["hidden"] += tag in HIDDEN_TAGS
        state["links"] += tag == "a"
        if tag in RAW_TAGS:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return found


@lru_cache(maxsize=100_000)
def _bucket(token: str, size: int) -> tuple[int, float]:
    value = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return value % size, 1.0 if value >> 31 else -1.0


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple) -> np.ndarray:
    out = np.zeros(PATH)
    for depth, (tag, names) in enumerate(reversed(path)):
        for token in (tag, *(f".{n}" for n in names)):
            for salt in "xyz":  # three places each, so that two tokens rarely share all
                place, sign = _bucket(salt + token, PATH)
                out[place] += sign * (1.0 if depth < 6 else 0.3)
    return out / 2


def inputs(found: list) -> np.ndarray:
    """(blocks, PATH + WORDS + EXTRA) of a page."""
    out = np.zeros((len(found), PATH + WORDS + EXTRA))
    for row, (path, text, linked) in enumerate(found):
        words = text.split(" ")
        out[row, :PATH] = _path_vector(path)
        places = np.array([_bucket(w[:32], WORDS) for w in words])
        head = np.bincount(places[:, 0].astype(int), weights=places[:, 1], minlength=WORDS)
        out[row, PATH:PATH + WORDS] = head / np.sqrt(len(words))
        out[row, PATH + WORDS:] = (
            np.log1p(len(words)) / 3, linked / len(text), text[-1] in ".!?…\"'”", row / len(found), (len(found) - row) / len(found), len(path) / 8,
        )
    return out


def teacher(path: tuple, text: str, has_main: bool) -> float:
    """Training label of a block from its elements."""
    inside = False
    for tag, names in path:
        inside |= tag in MAIN_TAGS or bool({"article", "main", "content"} & set(names)) and tag != "body"
        if (tag in ASIDE_TAGS and not (tag == "header" and inside)) or ASIDE_WORDS & set(names):
            return 0.0
    return float(inside) if has_main else float(len(text) > 80)


def _with_main(found) -> bool:
    return any(tag in MAIN_TAGS for path, _, _ in found for tag, _ in path)


def _varied(found: list, labels: list, random) -> tuple[list, list]:
    """A page with asides inserted and some elements renamed; labels stay true."""
    asides = [(("aside", ()),), (("header", ()),), (("form", ()),), (("section", ("comments",)), ("p", ())), (("div", ("comments",)), ("div", ("comment",)), ("p", ())), (("div", ("cookie", "notice")), ("p", ())),
              (("div", ("sidebar",)), ("p", ())), (("footer", ()), ("p", ())), (("div", ("notice",)),), (("div", ("ad",)),), (("nav", ()), ("ul", ()), ("li", ())), (("div", ("newsletter",)), ("form", ())), (("div", ("menu",)), ("a", ())), (("button", ()),), (("aside", ("related",)), ("ul", ()), ("li", ()))]
    body = (("html", ()), ("body", ()))
    texts = [t for _, t, _ in found] or ["x"]
    out, marks = [], []
    swap = random.random() < 0.3
    for (path, text, linked), mark in zip(found, labels):
        if swap:
            path = tuple(("div", ("article",)) if tag == "article" else (("main", ()) if tag == "section" else (tag, names)) for tag, names in path)
        out.append((path, text, linked))
        marks.append(mark)
    for _ in range(random.integers(0, 6)):
        at = int(random.integers(0, len(out) + 1))
        near = out[min(at, len(out) - 1)][0] if out else body
        base = tuple(s for s in near if s[0] in ("html", "body", "article", "main")) if random.random() < 0.5 else body
        text = texts[int(random.integers(len(texts)))]
        for _ in range(int(random.integers(1, 4))):
            out.insert(at, (base + asides[int(random.integers(len(asides)))], text, len(text) if random.random() < 0.3 else 0))
            marks.insert(at, 0.0)
    return out, marks


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 1):
        random = np.random.default_rng(seed)
        wide = PATH + WORDS + EXTRA
        self.weights = {}
        for side in "fb":
            self.weights[f"x{side}"] = random.normal(0, 1 / np.sqrt(wide), (wide, 4 * HIDDEN))
            self.weights[f"h{side}"] = random.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.weights[f"c{side}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.weights["out"] = random.normal(0, 0.3, 2 * HIDDEN)
        self.weights["bias"] = np.zeros(1)

    def _scan(self, x, mask, side, keep=None):
        """Hidden states along axis 1; padded steps hold still."""
        w, u, b = self.weights[f"x{side}"], self.weights[f"h{side}"], self.weights[f"c{side}"]
        gates_in = x @ w + b
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((n, steps, HIDDEN))
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates_in[:, t] + h @ u
            i, f, o, g = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN:2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN:3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            grown = f * c + i * g
            if keep is not None:
                keep[side][t] = (h, c, i, f, o, g, np.tanh(grown))
            h, c = np.where(m, o * np.tanh(grown), h), np.where(m, grown, c)
            out[:, t] = h
        return out

    def forward(self, x, mask, keep=None):
        both = np.concatenate([self._scan(x, mask, "f", keep), self._scan(x, mask, "b", keep)], axis=2)
        return _sigmoid(both @ self.weights["out"] + self.weights["bias"]), both

    def gradients(self, x, mask, y):
        keep = {"f": {}, "b": {}}
        p, both = self.forward(x, mask, keep)
        error = (p - y) * mask / mask.sum()
        grad = {"out": np.einsum("nt,nth->h", error, both), "bias": np.array([error.sum()])}
        for at, side in enumerate("fb"):
            w, u = self.weights[f"x{side}"], self.weights[f"h{side}"]
            into = error[:, :, None] * self.weights["out"][at * HIDDEN:(at + 1) * HIDDEN]
            gz = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            gu = np.zeros_like(u)
            for t in range(x.shape[1] - 1, -1, -1) if side == "f" else range(x.shape[1]):
                h, c, i, f, o, g, th = keep[side][t]
                m = mask[:, t, None]
                dh = dh + into[:, t]
                live, dgrown = np.where(m, dh, 0), np.where(m, dc, 0)
                dgrown = dgrown + live * o * (1 - th ** 2)
                z = np.concatenate([dgrown * g * i * (1 - i), dgrown * c * f * (1 - f), live * th * o * (1 - o), dgrown * i * (1 - g ** 2)], axis=1)
                gz[:, t] = z
                gu += h.T @ z
                dh = np.where(m, 0, dh) + z @ u.T
                dc = np.where(m, dgrown * f, dc)
            grad[f"x{side}"] = np.einsum("ntd,ntg->dg", x, gz)
            grad[f"h{side}"], grad[f"c{side}"] = gu, gz.sum(axis=(0, 1))
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 0.02, seed: int = 2, batch: int = 16):
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = sorted(random.permutation(len(pages)), key=lambda i: len(pages[i][0]) // 16)
            groups = [order[i:i + batch] for i in range(0, len(order), batch)]
            for g in random.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[g]])
                y = padded([pages[i][1][:, None] for i in groups[g]])[0][:, :, 0]
                step += 1
                for k, v in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.weights[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
        return self

    def main_blocks(self, pages: list[list]) -> list[np.ndarray]:
        """For each page which of its blocks are main text.  Pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        start = 0
        while start < len(order):
            longest = len(pages[order[min(start + 63, len(order) - 1)]])
            group = order[start:start + max(1, min(64, 20_000 // longest))]
            x, mask = padded([inputs(pages[i]) for i in group])
            p, _ = self.forward(x, mask)
            for row, i in enumerate(group):
                out[i] = p[row, :len(pages[i])] >= 0.5
            start += len(group)
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), steps, rows[0].shape[1])), np.zeros((len(rows), steps), dtype=bool)
    for i, r in enumerate(rows):
        x[i, :len(r)], mask[i, :len(r)] = r, True
    return x, mask


def fit(pages: DataFrame, seed: int = 1) -> Labeller:
    """Train on at most FIT_PAGES pages, the first by hash of id and url; two varied versions of each."""
    picked = pages.where(F.length("html") > 0).orderBy(F.xxhash64("page_id", "url", F.lit(seed)), "page_id", "url").limit(FIT_PAGES)
    random = np.random.default_rng(seed)
    examples = []
    for row in picked.select("html").toLocalIterator():
        found = blocks(row["html"])[:400]
        if found:
            labels = [teacher(path, text, _with_main(found)) for path, text, _ in found]
            for version in range(3):
                part, marks = _varied(found, labels, random) if version else (found, labels)
                examples.append((inputs(part), np.array(marks)))
    return Labeller(seed).train(examples) if examples else Labeller(seed)


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    Main blocks are joined by newlines in page order.  A null or empty html, or a page without main
    blocks, has an empty text.  Unclosed and truncated markup is read as far as it goes; pages of any
    length are read whole.  Repeated rows give equal results; extra columns are ignored; an empty table
    gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(labeller or fit(rows))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [blocks(p.as_py()) for p in part.column(2)]
                texts = ["\n".join(text for (_, text, _), main in zip(f, marks) if main) for f, marks in zip(found, shared.value.main_blocks(found))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
