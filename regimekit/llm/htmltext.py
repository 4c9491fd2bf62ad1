"""Main-text extraction by a recurrent block labeller.

A page is cut into its leaf blocks (runs of text between block-level tags).  Each block is a vector of
its tag path, its hashed words and a few numbers; a bidirectional LSTM reads a page's sequence of
blocks and labels every block as article or not, so a block's neighbours on both sides count.
The network is plain NumPy.  It is trained on generated pages of many layouts, whose labels are
known, with fixed seeds; nothing of the input table is needed for that.
"""

from __future__ import annotations

import collections
import functools
import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

PATH_DIM, WORD_DIM, EXTRA_DIM, HIDDEN = 192, 48, 7, 24
INPUT_DIM = 2 * PATH_DIM + WORD_DIM + EXTRA_DIM

#: Elements of HTML by how they shape text.  Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mrow ms mspace msqrt mroot mstyle msub msubsup msup mtext munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea iframe".split())
HIDDEN_TEXT = frozenset("noscript template svg object canvas audio video select".split())
NO_BLOCKS = frozenset("svg select".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@functools.lru_cache(maxsize=100_000)
def _slot(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_DIM


@functools.lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[tuple[int, ...], str | None]:
    """Path slots of an element (its tag, and each word of class, id and role), and its training label."""
    slots, label = [_slot(tag)], None
    for name, *values in _ATTR.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "data-label":
            label = value
        else:
            slots.extend(_slot("." + w) for w in _SPLIT.split(value) if w)
    return tuple(slots), label


class Block:
    __slots__ = ("parts", "path", "last", "linked", "label")

    def __init__(self, outer: Open):
        self.parts: list[str] = []
        self.path, self.last, self.label = outer.path, outer.last, outer.label
        self.linked = 0


class Open:
    """An open element with what it inherits, so that a block costs the same at any depth."""

    __slots__ = ("tag", "path", "last", "label", "linked", "hidden")

    def __init__(self, tag: str = "", slots: tuple[int, ...] = (), label: str | None = None, outer: Open | None = None):
        self.tag = tag
        block = outer is not None and tag not in INLINE
        self.path: int = outer.path if outer else 0  # a bit for each slot of the path
        for s in slots if block else ():
            self.path |= 1 << s
        self.last = slots if block else outer.last if outer else ()
        self.label = label if block and label is not None else outer.label if outer else None
        self.linked = tag == "a" or (outer is not None and outer.linked)
        self.hidden = tag in HIDDEN_TEXT or (outer is not None and outer.hidden)


@functools.lru_cache(maxsize=20_000)
def _slots(path: int) -> list[int]:
    return [s for s in range(PATH_DIM) if path >> s & 1]


def blocks(page: str) -> list[tuple[str, Block]]:
    """(text, block) of each leaf block with text, in page order.

    Block-level tags end a block, inline ones do not, ``br`` is white space.  An unclosed paragraph ends
    where the next block-level tag begins; an end tag closes what is open inside its element.  Only raw text (scripts,
    styles) runs to the end of the page if it is not closed.  Other elements without visible text end with
    the element around them, pictures and choices also at a block-level tag, and one that is closed nowhere hides nothing.
    """
    out: list[tuple[str, Block]] = []
    stack: list[Open] = [Open()]
    opened: collections.Counter[str] = collections.Counter()
    block: Block | None = None
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal block
        if block is not None:
            text = " ".join("".join(block.parts).split())
            if text:
                out.append((text, block))
            block = None

    def add(raw: str) -> None:
        nonlocal block
        inner = stack[-1]
        if not raw or inner.hidden:
            return
        if block is None:
            if not raw.strip():
                return
            block = Block(inner)
        text = html_lib.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if inner.linked:
            block.linked += len(text)

    def close(tags: tuple[str, ...] | frozenset[str], within: tuple[str, ...] = ()) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                opened.subtract(e.tag for e in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in within:
                return

    def closed_later(tag: str, at: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last_end[tag] >= at

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            close((tag,))
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if closed_later(tag, at) else None
            at = end.end() if end else n
            continue
        if tag in HIDDEN_TEXT and (attributes.rstrip().endswith("/") or not closed_later(tag, at)):
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE and tag not in HIDDEN_TEXT:
            flush()
            if tag in CLOSES_P:
                close(NO_BLOCKS)
                close(("p",), ("td", "th", "li", "div", "article", "section", "body"))
            if tag in SAME_LEVEL:
                close(SAME_LEVEL[tag], ("ul", "ol", "dl", "table"))
        if tag not in VOID:
            stack.append(Open(tag, *_element(tag, attributes), stack[-1]))
            opened[tag] += 1
    flush()
    return out


def vectors(pages: list[list[tuple[str, Block]]]) -> np.ndarray:
    """blocks x INPUT_DIM of all pages in order."""
    flat = [b for p in pages for b in p]
    n = len(flat)
    x = np.zeros((n, INPUT_DIM))
    if not n:
        return x
    for r, (_, b) in enumerate(flat):
        x[r, _slots(b.path)] = 1.0
        x[r, [PATH_DIM + s for s in b.last]] = 1.0
    texts = pa.array([t for t, _ in flat], type=pa.large_string())
    words = np.zeros((n, WORD_DIM))
    count = np.zeros(n)
    for i, j, raw, offsets in K.chunks(texts):
        h, first = K.words(raw, offsets)
        row = np.repeat(np.arange(i, j), np.diff(first))
        np.add.at(words, (row, (h % K.U64(WORD_DIM)).astype(np.int64)), 1.0)
        count[i:j] = np.diff(first)
    x[:, 2 * PATH_DIM : 2 * PATH_DIM + WORD_DIM] = np.log1p(words) / np.sqrt(1 + count)[:, None]
    chars = np.array([len(t) for t, _ in flat], dtype=float)
    sizes = [len(p) for p in pages]
    place = np.concatenate([(np.arange(s) + 0.5) / s for s in sizes if s])
    ends = np.array([t[-1] in ".!?…。" for t, _ in flat], dtype=float)
    marked = np.array(["©" in t for t, _ in flat], dtype=float)
    linked = np.array([b.linked for _, b in flat]) / np.maximum(chars, 1)
    x[:, -EXTRA_DIM:] = np.stack([np.log1p(chars) / 8, np.log1p(count) / 6, np.minimum(linked, 1), place, ends, marked, np.ones(n)], axis=1)
    return x


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * v))


def _run_lstm(gates_in: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """steps x pages x HIDDEN outputs of one direction; padded steps leave the state as it is."""
    steps, pages, _ = gates_in.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out = np.zeros((steps, pages, HIDDEN))
    for t in range(steps):
        z = gates_in[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        th = np.tanh(c_new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, th))
        c = np.where(m, c_new, c)
        h = np.where(m, o * th, h)
        out[t] = h
    return out


class Labeller:
    """Bidirectional LSTM over block vectors with one logistic output a block."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.w = {}
        for d in ("f", "b"):
            self.w["x" + d] = r.normal(0, 0.1, (INPUT_DIM, 4 * HIDDEN))
            self.w["u" + d] = r.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.w["c" + d] = bias
            self.w["o" + d] = r.normal(0, 0.1, HIDDEN)
        self.w["o"] = np.zeros(1)

    @staticmethod
    def _pad(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """steps x pages row numbers (0 where padded) and mask; forward order."""
        steps, first = max(sizes), np.concatenate([[0], np.cumsum(sizes)])[:-1]
        t = np.arange(steps)[:, None]
        mask = t < np.array(sizes)[None, :]
        return np.where(mask, first[None, :] + t, 0), mask

    def _forward(self, x: np.ndarray, sizes: list[int], keep: dict | None = None) -> np.ndarray:
        rows, mask = self._pad(x, sizes)
        z = np.full(len(x), self.w["o"][0])
        for d in ("f", "b"):
            order = rows if d == "f" else np.where(mask, np.array([sum(sizes[:k]) + s - 1 for k, s in enumerate(sizes)])[None, :] - np.arange(len(rows))[:, None], 0)
            gates = (x @ self.w["x" + d] + self.w["c" + d])[order]
            saved: list | None = [] if keep is not None else None
            h = _run_lstm(gates, self.w["u" + d], mask, saved)
            z[order[mask]] += h[mask] @ self.w["o" + d]
            if keep is not None:
                keep[d] = (order, mask, saved, h)
        return z

    def probabilities(self, x: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Of each block to be article text; pages of similar length are run together."""
        out = np.zeros(len(x))
        first = np.concatenate([[0], np.cumsum(sizes)])
        order = [k for k in sorted(range(len(sizes)), key=lambda k: sizes[k]) if sizes[k]]
        a = 0
        while a < len(order):
            b = a
            while b < len(order) and b - a < 256 and (b == a or (b - a + 1) * sizes[order[b]] <= 20_000):
                b += 1
            part = order[a:b]
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in part])
            out[rows] = _sigmoid(self._forward(x[rows], [sizes[k] for k in part]))
            a = b
        return out

    def gradients(self, x: np.ndarray, sizes: list[int], y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        p = _sigmoid(self._forward(x, sizes, keep))
        dz = (p - y) / len(sizes)
        grad = {"o": np.array([dz.sum()])}
        for d in ("f", "b"):
            order, mask, saved, h = keep[d]
            u = self.w["u" + d]
            grad["o" + d] = (h * np.where(mask, dz[order], 0.0)[..., None]).sum(axis=(0, 1))
            du, dgates = np.zeros_like(u), np.zeros((len(x), 4 * HIDDEN))
            dh, dc = np.zeros_like(h[0]), np.zeros_like(h[0])
            for t in range(len(saved) - 1, -1, -1):
                h0, c0, i, f, o, g, th = saved[t]
                m = mask[t][:, None]
                dh_t = dh + np.where(m, dz[order[t]][:, None] * self.w["o" + d], 0.0)
                dcn = dc + dh_t * o * (1 - th * th)
                dzt = np.concatenate([dcn * g * i * (1 - i), dcn * c0 * f * (1 - f), dh_t * th * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
                dzt = np.where(m, dzt, 0.0)
                du += h0.T @ dzt
                dgates[order[t][mask[t]]] = dzt[mask[t]]
                dh, dc = np.where(m, dzt @ u.T, dh_t), np.where(m, dcn * f, dc)
            grad["u" + d] = du
            grad["x" + d] = x.T @ dgates
            grad["c" + d] = dgates.sum(axis=0)
        return grad


# --- generated training pages -------------------------------------------------------------------

#: Names that sites give to their parts, and words that stand there.  Fixed values.
ARTICLE_NAMES = "article post entry content story body main text article-body post-content entry-content main-content page-content article-text".split()
OTHER_NAMES = {
    "nav": "nav navigation menu navbar topnav breadcrumbs breadcrumb main-menu site-nav pagination pager tabs",
    "header": "header masthead top banner site-header page-header logo branding",
    "footer": "footer bottom site-footer copyright page-footer legal colophon",
    "aside": "sidebar aside widget related recommended popular trending side-column rail more-stories tags newsletter subscribe share social author-box",
    "ad": "ad ads advert advertisement sponsored promo sponsor ad-slot adsbox banner-ad promoted",
    "notice": "cookie cookie-banner consent notice alert gdpr modal popup overlay paywall message",
    "comments": "comments comment comment-list responses discussion replies respond disqus reader-comments reviews",
    "form": "form login search search-form signup contact-form subscribe-form",
}
OTHER_WORDS = "home about contact login sign in register search menu share tweet follow subscribe newsletter cookies accept privacy policy terms copyright all rights reserved advertisement sponsored related read more next previous comments reply posted by tags categories".split()


def _words(r: np.random.Generator, n: int, pool: list[str]) -> str:
    w = [pool[k] for k in r.integers(0, len(pool), n)]
    w[0] = w[0].capitalize()
    for k in range(6, n, int(r.integers(5, 12))):
        w[k] += r.choice([",", "."])
    return " ".join(w)


def _pool(r: np.random.Generator) -> list[str]:
    """Made-up words of one page, so that no word as such tells anything."""
    parts = ["".join(r.choice(list("bcdfghklmnprstvwz"), 1)) + "".join(r.choice(list("aeiouäéèóü"), 1)) + ("n" if r.random() < 0.3 else "") for _ in range(40)]
    return ["".join(parts[k] for k in r.integers(0, 40, int(r.integers(1, 4)))) for _ in range(200)]


def _name(r: np.random.Generator, names: list[str]) -> str:
    return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", " wide", " inner"])}"'


def generated_page(r: np.random.Generator) -> str:
    """One page: boilerplate parts in any order around an article, tags closed or not."""
    pool = _pool(r)
    style = r.choice(["plain"] * 6 + ["upper", "bars", "marks", "stutter"])

    def line(n: int) -> str:
        t = _words(r, n, pool)
        if r.random() < 0.2 or style == "plain":
            return t
        if style == "upper":
            return t.upper().replace(" ", "!! ")
        if style == "stutter":
            return " ".join(w for w in t.split() for _ in range(int(r.integers(1, 6))))
        return t.replace(" ", " | ") if style == "bars" else t.replace(" ", str(r.choice(["*** ", "### ", "$$$ ", "&amp;&amp; "])))

    def inline(t: str) -> str:
        return t if r.random() < 0.7 else f"<{(k := r.choice(['b', 'em', 'a href=/x', 'span']))}>{t}</{k.split()[0]}>"

    def article() -> str:
        parts = [f"<h1>{line(int(r.integers(2, 12)))}</h1>"] if r.random() < 0.8 else []
        for _ in range(int(r.integers(1, 12))):
            kind = r.random()
            n = int(r.integers(1, 60)) if r.random() < 0.8 else int(r.integers(60, 300))
            if kind < 0.62:
                parts.append(f"<p>{inline(line(n))} {line(int(r.integers(1, 20)))}" + ("</p>" if r.random() < 0.8 else ""))
            elif kind < 0.72:
                parts.append(f"<p><b>{line(n)}<br>")
            elif kind < 0.8:
                parts.append(f"<h{(h := int(r.integers(2, 5)))}>{line(int(r.integers(1, 8)))}</h{h}>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{line(int(r.integers(1, 15)))}</li>" for _ in range(int(r.integers(1, 6)))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{line(n)}</blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{line(2)}</td><td>{line(2)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<pre>{line(n)}</pre>")
        body = "".join(parts)
        k = r.random()
        label = ' data-label="1"'
        if k < 0.55:
            return f"<article{label}{_name(r, ARTICLE_NAMES) if r.random() < 0.4 else ''}>{body}</article>"
        if k < 0.7:
            return f"<main><div{label}{_name(r, ARTICLE_NAMES)}>{body}</div></main>"
        if k < 0.8:
            return f"<main{label}>{body}</main>"
        return f"<div{label}{_name(r, ARTICLE_NAMES)}>{body}</div>"

    def other(kind: str) -> str:
        names = OTHER_NAMES[kind].split()
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and r.random() < 0.6 else r.choice(["div", "section", "div"])
        attributes = _name(r, names) if tag in ("div", "section") or r.random() < 0.3 else ""

        def words() -> str:
            own = line(int(r.integers(1, 8)))
            return own if r.random() < 0.6 else " ".join(OTHER_WORDS[k] for k in r.integers(0, len(OTHER_WORDS), int(r.integers(1, 4))))

        if kind == "nav" or (kind in ("footer", "aside", "header") and r.random() < 0.4):
            inner = "<ul>" + "".join(f'<li><a href="/x">{words()}</a></li>' for _ in range(int(r.integers(2, 9)))) + "</ul>"
        elif kind == "comments":
            inner = "".join(f"<{(t := r.choice(['div', 'p', 'li']))}>{line(int(r.integers(3, 60)))}</{t}>" for _ in range(int(r.integers(1, 6))))
            inner = (f"<h3>{words()}</h3>" if r.random() < 0.5 else "") + inner
        elif kind == "form":
            inner = f"<label>{words()}</label><input name=q><button>{words()}</button>" + (f"<p>{line(8)}</p>" if r.random() < 0.4 else "")
        elif kind == "footer":
            inner = f"{r.choice(['&copy; ', '© ', '', 'Copyright '])}{words()} {r.choice(['&middot; ', '| ', ''])}{line(int(r.integers(2, 14)))}"
            inner = inner if r.random() < 0.5 else f"<p>{inner}</p>"
        else:
            t = line(int(r.integers(2, 30)))
            inner = t if r.random() < 0.5 else f"<p>{t}</p>" + (f"<p>{words()}</p>" if r.random() < 0.4 else "")
        return f'<{tag} data-label="0"{attributes}>{inner}</{tag}>'

    before = [other(k) for k in r.permutation(["nav", "header", "ad", "notice", "form", "aside"])[: int(r.integers(0, 5))]]
    after = [other(k) for k in r.permutation(["footer", "aside", "comments", "ad", "notice", "nav", "form"])[: int(r.integers(0, 6))]]
    main = article()
    if r.random() < 0.3:  # something foreign inside the article
        cut = main.find("<p>", len(main) // 2)
        if cut > 0:
            main = main[:cut] + other(str(r.choice(["ad", "aside", "form", "notice"]))) + main[cut:]
    if r.random() < 0.5:
        before.sort(key=lambda x: 0 if "nav" in x[:40] or "header" in x[:40] else 1)
    wrap = r.random() < 0.3
    body = "".join(before) + ('<div class="container">' if wrap else "") + main + ("</div>" if wrap else "") + "".join(after)
    return f"<!DOCTYPE html><html><head><title data-label='0'>{line(6)}</title><style>p{{}}</style></head><body data-label='0'>{body}" + ("</body></html>" if r.random() < 0.9 else "")


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1500, epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 4) -> Labeller:
    """The labeller, fitted on ``pages`` generated pages by Adam; the same weights in every run."""
    r = np.random.default_rng(seed)
    made = [p for p in (blocks(generated_page(r)) for _ in range(pages)) if p]
    x = [vectors([p]) for p in made]
    y = [np.array([float(b.label == "1") for _, b in p]) for p in made]
    model = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(w) for k, w in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(made))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            grad = model.gradients(np.concatenate([x[k] for k in part]), [len(x[k]) for k in part], np.concatenate([y[k] for k in part]))
            step += 1
            lr = rate * (0.5 ** (epoch / 2))
            for k, g in grad.items():
                g = g + 1e-4 * model.w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.w[k] = model.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def extract_pages(pages: list[str], model: Labeller, batch: int = 512) -> list[str]:
    out: list[str] = []
    for a in range(0, len(pages), batch):
        cut = [blocks(p) for p in pages[a : a + batch]]
        sizes = [len(p) for p in cut]
        p = model.probabilities(vectors(cut), sizes)
        at = 0
        for page in cut:
            out.append(" ".join(t for k, (t, _) in enumerate(page) if p[at + k] >= 0.5))
            at += len(page)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: the blocks labelled as article, joined by one space.

    Character references are decoded, white space inside a block is one space, nothing else is changed or
    cut.  A null or empty page, and one without an article block, has an empty text.  Null ids and urls and repeated
    rows stay as they are; an empty table gives no rows; other columns are not read.
    """
    C.prepare(pages.sparkSession)
    weights = trained().w  # a few hundred kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller()
        model.w = weights
        for batch in batches:
            texts = extract_pages([x or "" for x in batch.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(K.tidy(run), "page_id long, url string, text string, n_chars long")
