"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between block-level
tags). A block is read as a tag-path vector (sum of learned vectors of the hashed
tags, classes, ids and roles on its path), a hashed-word vector (mean of learned
vectors of its words) and a few measures of its shape. A bidirectional LSTM in
numpy runs over all blocks of the page and labels each as article or not, so a
label depends on the whole document. The article blocks, in page order, are the
text. The network is trained by backpropagation through time on pages written
by ``training_page``, a generator of layouts whose labels are known.

Head, scripts, styles, templates, comments and markup are never text. Character
references are decoded, white space inside a block becomes one blank.

Null and empty html give an empty text, as do pages without an article block.
Broken markup is read as far as it goes (an unclosed comment, script or tag
swallows the rest). Repeated rows are extracted row by row, extra columns are
ignored, null ids and urls are kept, an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.session import ship_package

PATH_BUCKETS, WORD_BUCKETS, WIDTH, HIDDEN, SHAPES = 1024, 2048, 16, 16, 6
TRAIN_PAGES, EPOCHS, PAGE_BATCH = 900, 4, 24
CELLS = 1 << 13

# HTML element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|svg|math|iframe|object|canvas"
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup
option p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
CLOSES_P = BLOCK - set("body button caption head html label legend optgroup option title".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    rf"<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|"
    r"<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)|"
    r"(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


@lru_cache(maxsize=50_000)
def _marks(tag: str, attrs: str) -> tuple[int, ...]:
    """Buckets of an element: its tag, and each word of its class, id and role."""
    marks = [tag]
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            marks += [f".{w}" for w in _NAME.findall(value)]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "none" in value):
            marks.append("!hidden")
    return tuple(_bucket(x, PATH_BUCKETS) for x in marks)


class Block:
    __slots__ = ("text", "marks", "linked", "heading")

    def __init__(self, text: str, marks: list[int], linked: int, heading: bool):
        self.text, self.marks, self.linked, self.heading = text, marks, linked, heading


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    held: list[tuple[str, bool]] = []
    path: list[tuple[str, tuple[int, ...]]] = []

    def flush() -> None:
        if held:
            text = " ".join(_html.unescape("".join(t for t, _ in held)).split())
            if text and not any(t == "head" for t, _ in path):
                linked = sum(len(t) for t, a in held if a)
                out.append(Block(text, [m for _, ms in path for m in ms], linked, bool(path) and path[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")))
            held.clear()

    for m in _TOKEN.finditer(page):
        if m["text"]:
            if not held:
                path = list(stack)
            held.append((m["text"], any(t == "a" for t, _ in stack)))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue  # comments and raw elements stand inside a block
        if tag in BLOCK:
            flush()
        elif tag == "br":
            held and held.append((" ", False))
        if m["end"] or m["end2"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
        elif tag not in VOID:
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            if attrs.endswith("/"):
                continue
            if tag in CLOSES_P or tag in SIBLING:
                for i in range(len(stack) - 1, -1, -1):
                    t = stack[i][0]
                    if t in SIBLING.get(tag, ()) or (t == "p" and tag in CLOSES_P):
                        del stack[i:]
                        break
                    if t in BLOCK and t != "p":
                        break
            if tag == "body":
                stack[:] = [s for s in stack if s[0] == "html"]
            stack.append((tag, _marks(tag, attrs)))
    flush()
    return out


@lru_cache(maxsize=200_000)
def _word(w: str) -> int:
    return _bucket(re.sub(r"\d", "0", w.lower().strip(".,;:!?()\"'")), WORD_BUCKETS)


def inputs(page: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Path buckets, word buckets and shape of each block."""
    shape = np.zeros((len(page), SHAPES), np.float32)
    for i, b in enumerate(page):
        n = len(b.text)
        shape[i] = (np.log1p(n) / 6, b.linked / max(1, n), float(b.heading), min(1.0, sum(map(b.text.count, ".!?")) / 5),
                    i / len(page), float(n > 1 and b.text[-1] in ".!?\"'»”"))
    return [np.array(b.marks or [0]) for b in page], [np.array([_word(w) for w in b.text.split()]) for b in page], shape


class LSTM:
    """One direction over padded sequences of input vectors."""

    def __init__(self, rng: np.random.Generator, width: int, hidden: int):
        self.h = hidden
        self.W = rng.normal(0, width ** -0.5, (width, 4 * hidden)).astype(np.float32)
        self.U = rng.normal(0, hidden ** -0.5, (hidden, 4 * hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden:2 * hidden] = 1  # forget gates begin open

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, k = x.shape[0], x.shape[1], self.h
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, tape = np.empty((n, steps, k), np.float32), []
        a = x @ self.W + self.b
        for t in range(steps):
            g = a[:, t] + h @ self.U
            i, f, o = (0.5 + 0.5 * np.tanh(0.5 * g[:, j * k:(j + 1) * k]) for j in range(3))
            z = np.tanh(g[:, 3 * k:])
            m = live[:, t, None]
            c2 = np.where(m, f * c + i * z, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                tape.append((h, c, i, f, o, z, tc, m))
            h, c = h2, c2
            out[:, t] = h
        return out, tape

    def backward(self, x: np.ndarray, tape: list, dout: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of W, U, b through time, and of the inputs."""
        dU = np.zeros_like(self.U)
        da = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
        dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, z, tc, m = tape[t]
            dh = dh + dout[:, t]
            d = np.where(m, dh, 0)
            dcell = dc + d * o * (1 - tc * tc)
            g = np.concatenate([dcell * z * i * (1 - i), dcell * c * f * (1 - f), d * tc * o * (1 - o), dcell * i * (1 - z * z)], 1)
            g = np.where(m, g, 0)
            da[:, t] = g
            dU += h.T @ g
            dh = np.where(m, g @ self.U.T, dh)
            dc = np.where(m, dcell * f, dc)
        flat = da.reshape(-1, da.shape[2])
        return [x.reshape(-1, x.shape[2]).T @ flat, dU, flat.sum(0)], da @ self.W.T


class BlockLabeller:
    """Vectors, two LSTMs and a logistic layer."""

    def __init__(self, seed: int = 1, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        width = 2 * WIDTH + SHAPES
        self.paths = rng.normal(0, 0.2, (PATH_BUCKETS, WIDTH)).astype(np.float32)
        self.words = rng.normal(0, 0.05, (WORD_BUCKETS, WIDTH)).astype(np.float32)
        self.ahead, self.back = LSTM(rng, width, hidden), LSTM(rng, width, hidden)
        self.v = rng.normal(0, 0.1, 2 * hidden).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.paths, self.words, self.ahead.W, self.ahead.U, self.ahead.b, self.back.W, self.back.U, self.back.b, self.v, self.c]

    def _forward(self, pages: list[tuple], keep: bool):
        n = np.array([len(p[2]) for p in pages])
        steps = int(n.max())
        live = np.arange(steps) < n[:, None]
        at = np.flatnonzero(live)
        marks, words = [m for p in pages for m in p[0]], [w for p in pages for w in p[1]]
        nm, nw = (np.array([len(a) for a in s]) for s in (marks, words))
        fm, fw = np.concatenate(marks), np.concatenate(words)
        em = np.add.reduceat(self.paths[fm], np.cumsum(nm) - nm) / 3
        ew = np.add.reduceat(self.words[fw], np.cumsum(nw) - nw) / nw[:, None]
        x = np.zeros((len(pages) * steps, 2 * WIDTH + SHAPES), np.float32)
        x[at] = np.concatenate([em, ew, np.concatenate([p[2] for p in pages])], 1)
        x = x.reshape(len(pages), steps, -1)
        turn = np.where(live, n[:, None] - 1 - np.arange(steps), np.arange(steps))[:, :, None]
        y = np.take_along_axis(x, turn, 1)
        f, tape_f = self.ahead.forward(x, live, keep)
        g, tape_g = self.back.forward(y, live, keep)
        both = np.concatenate([f, np.take_along_axis(g, turn, 1)], 2)
        p = 1 / (1 + np.exp(-(both @ self.v + self.c[0])))
        return p, live, (x, y, turn, tape_f, tape_g, both, at, fm, fw, nm, nw)

    def gradients(self, pages: list[tuple], labels: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        p, live, (x, y, turn, tape_f, tape_g, both, at, fm, fw, nm, nw) = self._forward(pages, True)
        t = np.zeros_like(p)
        t.ravel()[at] = np.concatenate(labels)
        total = np.float32(live.sum())
        loss = -(np.log(np.where(t > 0, p, 1 - p) + 1e-9) * live).sum() / total
        d = ((p - t) * live / total).astype(np.float32)
        dboth = d[:, :, None] * self.v
        k = self.ahead.h
        ga, dx = self.ahead.backward(x, tape_f, dboth[:, :, :k])
        gb, dy = self.back.backward(y, tape_g, np.take_along_axis(dboth[:, :, k:], turn, 1))
        dx = (dx + np.take_along_axis(dy, turn, 1)).reshape(-1, x.shape[2])[at]
        dpaths, dwords = np.zeros_like(self.paths), np.zeros_like(self.words)
        np.add.at(dpaths, fm, np.repeat(dx[:, :WIDTH] / 3, nm, axis=0))
        np.add.at(dwords, fw, np.repeat(dx[:, WIDTH:2 * WIDTH] / nw[:, None], nw, axis=0))
        return float(loss), [dpaths, dwords, *ga, *gb, np.einsum("nt,ntk->k", d, both), np.array([d.sum()], np.float32)]

    def fit(self, pages: list[tuple], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = PAGE_BATCH, seed: int = 2) -> "BlockLabeller":
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters]
        order = np.argsort([len(l) for l in labels], kind="stable")
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        t, steps = 0, epochs * len(groups)
        for _ in range(epochs):
            for j in rng.permutation(len(groups)):
                t += 1
                _, grads = self.gradients([pages[i] for i in groups[j]], [labels[i] for i in groups[j]])
                rate = 0.01 * (1 - 0.9 * t / steps) * np.sqrt(1 - 0.99 ** t) / (1 - 0.9 ** t)
                for p, g, (m, v) in zip(self.parameters, grads, moment):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of being article text for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if pages[i]]
        at = 0
        while at < len(order):
            end, widest = at + 1, len(pages[order[at]])
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= CELLS:
                end += 1
            group = order[at:end]
            p, _, _ = self._forward([inputs(pages[i]) for i in group], False)
            for r, i in enumerate(group):
                out[i] = p[r, :len(pages[i])]
            at = end
        return out


# Names that page layouts use, by the part of the page.
_ARTICLE = "article content post entry story main text body single-post article-body entry-content post-content page-content story-body".split()
_PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu toc pagination tabs".split(),
    "header": "header site-header masthead top banner logo branding topbar".split(),
    "footer": "footer site-footer bottom copyright legal colophon imprint".split(),
    "sidebar": "sidebar side aside widget widgets related recommended popular trending tags archive more-stories".split(),
    "notice": "cookie cookies consent notice alert gdpr privacy newsletter subscribe modal popup overlay paywall".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor adbox banner-ad ad-slot".split(),
    "form": "search login signup contact subscribe-form search-form register".split(),
    "comments": "comments comment comment-list replies discussion respond commentlist reader-comments responses".split(),
    "share": "share social sharing share-buttons follow byline-share".split(),
}
_STOCK = {
    "nav": ["Home", "About", "Contact", "News", "Next", "Previous", "Menu", "Login", "Accueil", "Startseite", "Inicio"],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Impressum", "©", "·"],
    "notice": ["We use cookies.", "Accept", "Subscribe to our newsletter", "Sign up", "This site uses cookies to improve your visit."],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer"],
    "comments": ["Reply", "Comments", "Leave a comment", "said:", "Report"],
    "share": ["Share", "Tweet", "Print", "Email"],
    "sidebar": ["Related articles", "Most read", "Recommended", "Tags"],
}


def training_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page with a random layout, and the label of each of its blocks."""
    out: list[str] = []
    labels: list[int] = []
    syllables = ["the", "on", "er", "an", "re", "de", "la", "en", "ch", "ei", "ung", "ción", "ar", "é", "eau", "is", "st", "ou", "ti", "ß", "ä", "os", "que", "ing"]

    def words(n: int, dot: bool = True) -> str:
        w = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(max(1, n))]
        text = " ".join(x + ("." if rng.random() < 0.1 else "," if rng.random() < 0.1 else "&amp;" if rng.random() < 0.02 else "###" if rng.random() < 0.01 else "") for x in w)
        return text.capitalize() + ("." if dot and rng.random() < 0.8 else "")

    def leaf(tag: str, text: str, label: int, attrs: str = "") -> None:
        if rng.random() < 0.15:
            text = f"<{(t := str(rng.choice(['b', 'i', 'em', 'span', 'strong'])))}>{text}" + (f"</{t}>" if rng.random() < 0.7 else "")
        out.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.8 else "<br>"))
        labels.append(label)

    def named(kind: str) -> str:
        name = str(rng.choice(_PARTS[kind]))
        return f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", " box", " wrap clearfix", "-1"])}"'

    def part(kind: str) -> None:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
        if kind == "comments" and rng.random() < 0.4:
            tag = "section"
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        if not bare and rng.random() < 0.6 and kind != "form":
            tag = "section" if rng.random() < 0.2 else "div"
        out.append(f"<{tag}{'' if bare else named(kind)}>")
        before = len(labels)
        if kind in ("nav", "sidebar") and rng.random() < 0.7:
            if kind == "sidebar" and rng.random() < 0.5:
                leaf(str(rng.choice(["h2", "h3", "h4"])), words(2, False), 0)
            out.append("<ul>")
            for _ in range(rng.integers(2, 8)):
                leaf("li", f'<a href="/{rng.integers(99)}">{rng.choice(_STOCK["nav"]) if rng.random() < 0.3 else words(rng.integers(1, 7), False)}</a>', 0)
            out.append("</ul>")
        elif kind == "form":
            leaf("label", words(2, False), 0)
            out.append("<input type=text>")
            if rng.random() < 0.5:
                leaf("p", words(rng.integers(3, 14)), 0)
            leaf("button", words(1, False), 0)
        elif kind == "comments":
            if rng.random() < 0.7:
                leaf("h3", words(2, False), 0)
            for _ in range(rng.integers(1, 6)):
                out.append(f'<{(c := str(rng.choice(["div", "li", "article"])))} class="{rng.choice(["comment", "reply", "comment-body", ""])}">')
                for _ in range(rng.integers(1, 3)):
                    leaf("p", words(rng.integers(3, 40)), 0)
                out.append(f"</{c}>")
        else:
            for _ in range(rng.integers(1, 4)):
                text = str(rng.choice(_STOCK[kind])) if kind in _STOCK and rng.random() < 0.4 else words(rng.integers(1, 25))
                if rng.random() < 0.35 or len(labels) > before:
                    leaf(str(rng.choice(["p", "div", "span", "h2"] if kind != "header" else ["div", "h1", "p"])).replace("span", "div"), text, 0)
                else:
                    out.append(text)
                    labels.append(0)
                    break
        out.append(f"</{tag}>")

    def article() -> None:
        tag = str(rng.choice(["article", "article", "article", "main", "div", "div", "section"]))
        attrs = f' {rng.choice(["class", "id"])}="{rng.choice(_ARTICLE)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
        out.append(f"<{tag}{attrs}>")
        title = words(rng.integers(2, 14), False)
        if rng.random() < 0.85:
            leaf("h1", title, 1)
        if rng.random() < 0.3:
            leaf("p", title, 1)
        for _ in range(int(rng.choice([0, 1, 2, 3, 5, 8, 14, 25]))):
            r = rng.random()
            if r < 0.82:
                stock = str(rng.choice(_STOCK[str(rng.choice(list(_STOCK)))]))  # an article may say such things too
                leaf("p", stock if rng.random() < 0.1 else words(int(rng.choice([1, 2, 3, 4, 8, 20, 45, 90]))), 1)
            elif r < 0.87:
                leaf(str(rng.choice(["h2", "h3"])), words(4, False), 1)
            elif r < 0.91:
                out.append("<ul>")
                for _ in range(rng.integers(1, 5)):
                    leaf("li", words(rng.integers(1, 15)), 1)
                out.append("</ul>")
            elif r < 0.93:
                leaf("blockquote", words(20), 1)
            else:
                part(str(rng.choice(["ad", "share", "sidebar", "form", "notice"])))
        if rng.random() < 0.15:
            part("comments")
        out.append(f"</{tag}>")

    out.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
    wrap = rng.random() < 0.25
    if wrap:
        out.append(f'<div {rng.choice(["id", "class"])}="{rng.choice(["page", "wrapper", "container", "site", "layout"])}">')
    for kind, chance in (("notice", 0.25), ("header", 0.45), ("nav", 0.75), ("form", 0.15), ("ad", 0.4), ("sidebar", 0.15)):
        if rng.random() < chance:
            part(kind)
    if rng.random() < 0.97:
        article()
    for kind, chance in (("share", 0.2), ("comments", 0.35), ("sidebar", 0.35), ("ad", 0.25), ("form", 0.15), ("nav", 0.15), ("footer", 0.8), ("notice", 0.15)):
        if rng.random() < chance:
            part(kind)
    out.append("</div>" * wrap + "</body></html>")
    return "".join(out), labels


def train_labeller(pages: int = TRAIN_PAGES, seed: int = 20) -> BlockLabeller:
    """A labeller fitted on ``pages`` generated pages."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    while len(xs) < pages:
        page, labels = training_page(rng)
        found = blocks(page)
        if found and len(found) == len(labels):
            xs.append(inputs(found))
            ys.append(np.array(labels, np.float32))
    return BlockLabeller().fit(xs, ys)


def extract_text(pages: DataFrame, labeller: BlockLabeller) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                found = [blocks(h) if h else [] for h in b.column("html").to_pylist()]
                texts = ["\n".join(x.text for x, p in zip(page, label) if p >= 0.5) for page, label in zip(found, shared.value.label(found))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
