"""HTML main-text extraction by a recurrent block labeller.

A page is read once into leaf blocks: runs of text between block-level tags, each with the path of open tags and their class
and id words. A numpy bidirectional LSTM reads the whole sequence of a page's leaves (hashed path and word vectors and a few
shape figures) and labels every leaf as article or not, so that each label sees the whole document. The main text is the
article leaves in page order.

There are no labelled pages, so the network is trained on pages that `page_examples` makes up: many layouts, tag and class
habits, with known labels. Training is deterministic and takes seconds; it happens once on the driver.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import with_columns

BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is code, form values or a stand-in, never text that the page shows.
SKIP = frozenset("script style noscript template iframe title textarea select".split())
_CLOSES_P = BLOCK - {"body", "html", "head", "button", "label", "option"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = frozenset("ul ol dl table td th div section article aside body main".split())
#: Quotes count only after an equals sign; elsewhere in a tag they are characters like any other.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
#: Of these, HTML takes all text to the page's end where the end tag is missing.
_RAW = frozenset("script style noscript iframe title textarea".split())
_END = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in SKIP}


PATHS = 1024


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return wordhash.word_hash(word) % PATHS


@dataclass(slots=True)
class Leaf:
    """path: the different buckets of the open tags' words, which leaves of one place share; inner: the last two of these words."""

    text: str
    path: tuple[int, ...]
    inner: tuple[str, ...]
    depth: int
    linked: int
    tag: str


class _Open:
    """The open tags, and how often each bucket of their words is among them: memory grows with the depth, not with its square."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[str] = []
        self.count: dict[int, int] = {}
        self.words = 0
        self.path: tuple[int, ...] | None = ()
        self.of_name: dict[str, list[int]] = {}

    def push(self, name: str, words: tuple[str, ...]) -> None:
        self.of_name.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, words))
        self.words += len(words)
        if name in BLOCK:
            self.blocks.append(name)
        for w in words:
            k = _bucket(w)
            n = self.count.get(k, 0)
            self.count[k] = n + 1
            if not n:
                self.path = None

    def pop(self) -> str:
        name, words = self.stack.pop()
        self.of_name[name].pop()
        self.words -= len(words)
        if name in BLOCK:
            self.blocks.pop()
        for w in words:
            k = _bucket(w)
            self.count[k] -= 1
            if not self.count[k]:
                del self.count[k]
                self.path = None
        return name

    def last(self, names: frozenset[str] | set[str]) -> int:
        """The place of the innermost open tag of these names, -1 without."""
        return max((at[-1] for n in names if (at := self.of_name.get(n))), default=-1)

    def leaf(self, text: str, linked: int) -> Leaf:
        if self.path is None:
            self.path = tuple(self.count)
        ends: list[str] = []
        for _, words in reversed(self.stack[-2:]):
            ends[:0] = words[-2:]
        return Leaf(text, self.path, tuple(ends[-2:]), self.words, min(linked, len(text)), self.blocks[-1] if self.blocks else "")


def leaves(page: str | None) -> list[Leaf]:
    """The page's leaf blocks in order, their references decoded and their white space folded."""
    out: list[Leaf] = []
    if not page:
        return out
    open_ = _Open()
    parts: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(open_.leaf(text, linked))
        linked = 0

    def close(k: int) -> None:
        nonlocal anchors
        if parts and any(n in BLOCK for n, _ in open_.stack[k:]):
            flush()
        while len(open_.stack) > k:
            anchors -= open_.pop() == "a"

    at, unclosed = 0, set()
    for m in _TAG.finditer(page):
        begin = m.start()
        if begin < at:
            continue
        if begin > at:
            said = page[at:begin]
            if "&" in said:
                said = html.unescape(said)
            parts.append(said)
            if anchors:
                linked += len(said.strip())
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            k = open_.last({name})
            if k >= 0:
                close(k)
            elif parts and name in BLOCK:
                flush()
            continue
        if name in SKIP:
            if not m[3].endswith("/"):
                end = None if name in unclosed else _END[name].search(page, at)
                if end:
                    at = end.end()
                elif name in _RAW:
                    at = len(page)
                else:
                    unclosed.add(name)
            if parts and name in BLOCK:
                flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            if name in _CLOSES_P and (k := open_.last({"p"})) > open_.last(_SCOPE):
                close(k)
            if (same := _SAME.get(name)) and (k := open_.last(same)) >= 0:
                # A row closes cells and rows up to its table, anything else what is open inside the innermost scope.
                scope = open_.last({"table"} if name == "tr" else _SCOPE - same)
                if k > scope:
                    close(min(x[-1] for n in same if (x := open_.of_name.get(n)) and x[-1] > scope) if name == "tr" else k)
            if parts:
                flush()
        if name in VOID:
            continue
        words = (name,)
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id", "role", "itemprop"):
                    words += tuple(f".{w}" for w in _NAME.findall(value))
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "none" in value):
                    words += (".hidden",)
        open_.push(name, words)
        anchors += name == "a"
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    return out


# --- made-up pages ---------------------------------------------------------------------------------------------------------


class _Maker:
    """Makes pages of many layouts; text that belongs to the article is put between two marks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = self.r.choice(["abcdefghilmnoprstu", "aáeéiíoóuúñlmrst", "äöüßaeinrstchu", "êéèçaeioustrnml", "bcdfgaeioulrst"])
        self.vocab = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 11))) for _ in range(300)]

    def words(self, a: int, b: int) -> str:
        r = self.r
        out: list[str] = []
        n = r.randint(a, b)
        while len(out) < n:
            s = [r.choice(self.vocab) for _ in range(r.randint(3, 16))]
            s[0] = s[0].capitalize()
            out += [*s[:-1], s[-1] + r.choice("...,!?")]
        return " ".join(out[:n])

    def link(self, a: int = 1, b: int = 3) -> str:
        return f'<a href="/{self.r.choice(self.vocab)}">{self.words(a, b)}</a>'

    def box(self, tag_choices: str, names: str, inner: str, named: float = 0.85) -> str:
        r = self.r
        tag = r.choice(tag_choices.split())
        attr = ""
        if r.random() < named or tag in ("div", "section", "span", "ul"):
            attr = f' {r.choice(["class", "class", "id"])}="{self.name(names)}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def name(self, names: str) -> str:
        r = self.r
        n = r.choice(names.split())
        return r.choice([n, n, f"{n}-{r.choice(['box', 'wrap', 'inner', 'area', 'top', '1'])}", f"{r.choice(['site', 'page', 'c', 'js'])}-{n}"])

    def menu(self) -> str:
        r = self.r
        items = [self.link() for _ in range(r.randint(3, 9))]
        inner = r.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{i}</div>" for i in items)])()
        return self.box("nav nav div ul", "nav menu navigation navbar topmenu breadcrumb links categories", inner)

    def ad(self) -> str:
        return self.box("div div aside ins", "ad ads advert advertisement sponsor sponsored promo banner adslot", self.r.choice([self.words(2, 20), f"<p>{self.words(3, 25)}</p>", self.link(2, 8), "Advertisement " + self.words(2, 9)]))

    def notice(self) -> str:
        r = self.r
        said = r.choice(["We use cookies.", "Subscribe to our newsletter.", "Sign up now.", "Please accept our terms.", ""]) + " " + self.words(5, 30)
        return self.box("div div section aside dialog", "cookie notice consent gdpr newsletter subscribe alert popup modal overlay paywall", r.choice([f"<p>{said}</p>", said, f"<p>{said}</p><button>OK</button>", f"<h4>{self.words(2, 4)}</h4><p>{said}</p>"]))

    def form(self) -> str:
        r = self.r
        return f'<form class="{self.name("search login contact signup subscribe")}"><label>{self.words(1, 3)}</label><input name="q"><p>{self.words(2, 14)}</p><button>{self.words(1, 2)}</button></form>' if r.random() < 0.7 else f"<form><fieldset><legend>{self.words(1, 3)}</legend><label>{self.words(1, 4)}<input></label></fieldset></form>"

    def sidebar(self) -> str:
        r = self.r
        parts = [f"<h3>{self.words(1, 4)}</h3>", "<ul>" + "".join(f"<li>{self.link(2, 6)}</li>" for _ in range(r.randint(2, 7))) + "</ul>", f"<p>{self.words(6, 50)}</p>", f"<div>{self.words(4, 30)}</div>"]
        return self.box("aside aside div section", "sidebar side rail widget related popular recent aside tags", "".join(r.sample(parts, r.randint(1, 4))))

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice([f'<li class="{self.name("comment reply")}"><b>{self.words(1, 2)}</b><p>{self.words(5, 70)}</p></li>', f'<div class="{self.name("comment reply reader")}"><p>{self.words(1, 3)}</p><p>{self.words(5, 70)}</p></div>', f"<p>{self.words(4, 60)}</p>"])
        return self.box("div section ol ul", "comments comment discussion responses replies disqus reader", f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))))

    def mark(self, s: str) -> str:
        return "\x01" + s

    def body(self) -> list[str]:
        r, out = self.r, []
        short = r.random() < 0.2
        kinds = r.choice([["p"], ["p", "p", "p", "h2", "list"], ["p", "p", "p", "quote", "h2", "pre", "table", "fig", "list", "div"]])
        for _ in range(r.randint(1, 3 if short else 14)):
            k = r.choice(kinds)
            text = self.mark(self.words(2 if short else 4, 20 if short else 130))
            if r.random() < 0.2:
                text += f" <a href='#'>{self.words(1, 3)}</a> {self.words(1, 12)}"
            if r.random() < 0.15:
                text = f"<b>{text}" + r.choice(["</b>", ""])
            if r.random() < 0.1:
                text += "<br>" + self.words(2, 20)
            out.append({
                "p": f"<p>{text}" + r.choice(["</p>", "</p>", "</p>", ""]),
                "div": f"<div>{text}</div>",
                "h2": f"<{r.choice(['h2', 'h3'])}>{self.mark(self.words(2, 8))}</h2>",
                "list": "<ul>" + "".join(f"<li>{self.mark(self.words(2, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                "quote": f"<blockquote><p>{text}</p></blockquote>",
                "pre": f"<pre>{self.mark(self.words(3, 30))}</pre>",
                "table": "<table>" + "".join(f"<tr><td>{self.mark(self.words(1, 3))}</td><td>{self.mark(self.words(1, 8))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>",
                "fig": f"<figure><img src=x><figcaption>{self.mark(self.words(3, 14))}</figcaption></figure>",
            }[k])
        return out

    def page(self) -> str:
        r = self.r
        blocks = self.body()
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), r.choice([self.ad, self.ad, self.notice, self.form, self.sidebar, self.menu])())
        head = [f"<h1>{self.mark(self.words(2, 14))}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.15:
            head = [f"<header>{x}</header>" for x in head]
        inside = "".join(head + blocks)
        if r.random() < 0.2:
            inside += self.box("div ul footer", "share social tags meta byline", "".join(f"<span>{self.link(1, 2)}</span> " for _ in range(r.randint(2, 5))))
        wrap = r.random()
        if wrap < 0.45:
            main = f"<article>{inside}</article>"
        elif wrap < 0.6:
            main = f"<main>{inside}</main>"
        elif wrap < 0.9:
            main = self.box("div div section td", "content post entry article story text main body page", inside, 1.0)
        else:
            main = inside
        if r.random() < 0.25:
            main = self.box("div main section", "wrapper container content main layout column", main)
        before, after = [], []
        if r.random() < 0.5:
            before.append(self.box("header header div", "header masthead top logo banner", r.choice([self.words(1, 6), f"<h2>{self.words(1, 4)}</h2>" + self.menu(), f"<p>{self.words(2, 10)}</p>"])))
        for f, a, b in ((self.menu, 0.75, 0.15), (self.notice, 0.25, 0.15), (self.ad, 0.45, 0.25), (self.form, 0.2, 0.15), (self.sidebar, 0.15, 0.4), (self.comments, 0.0, 0.35)):
            if r.random() < a:
                before.append(f())
            if r.random() < b:
                after.append(f())
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.box("footer footer footer div", "footer bottom copyright legal colophon", r.choice(["&copy; ", "", "© "]) + r.choice([self.words(2, 25), f"<p>{self.words(3, 40)}</p>", " &middot; ".join(self.link() for _ in range(3)), f"{self.words(2, 5)} &middot; {self.words(6, 30)}"])))
        return "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join([*before, main, *after]) + r.choice(["</body></html>", ""])


def page_examples(n: int, seed: int) -> list[tuple[list[Leaf], np.ndarray]]:
    """Made-up pages as leaves and labels."""
    out = []
    for k in range(n):
        found = leaves(_Maker(seed * 100_003 + k).page())
        label = np.array(["\x01" in x.text for x in found], float)
        for x in found:
            x.text = " ".join(x.text.replace("\x01", "").split())
        if found:
            out.append((found, label))
    return out


# --- features and network --------------------------------------------------------------------------------------------------

WORDS, SHAPE = 1024, 8


@dataclass
class Encoded:
    """Pages' leaves in a row: hashed path words and text words with offsets, and shape figures."""

    path: np.ndarray
    path_off: np.ndarray
    word: np.ndarray
    word_off: np.ndarray
    shape: np.ndarray


def encode(found: list[Leaf]) -> Encoded:
    """A path counts by its words, by its inner end and by its tag."""
    extra = [(_bucket("/".join(("in", *x.inner))), _bucket(f"tag {x.tag}")) for x in found]
    sizes = np.array([len(x.path) + 2 for x in found], np.int64)
    path = np.fromiter((b for x, e in zip(found, extra, strict=True) for b in (*x.path, *e)), np.int64, int(sizes.sum()))
    h, off = wordhash.words(pa.array([x.text for x in found], pa.string()))
    n = np.array([len(x.text) for x in found], float)
    stops = np.array([x.text.count(".") + x.text.count(",") + x.text.count("!") + x.text.count("?") for x in found], float)
    shape = np.column_stack([
        np.log1p(n) / 5,
        np.array([x.linked for x in found]) / np.maximum(n, 1),
        np.minimum(1, 8 * stops / np.maximum(n, 1)),
        np.array([x.text[-1:] in ".!?" for x in found], float),
        np.log1p(np.diff(off)) / 4,
        np.minimum(50, np.array([x.depth for x in found])) / 10,
        np.array([not x.path for x in found], float),
        np.ones(len(found)),
    ])
    return Encoded(path, np.concatenate(([0], np.cumsum(sizes))), (h >> np.uint64(54)).astype(np.int64), off.astype(np.int64), shape)


def _bag(table: np.ndarray, index: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean of the table's rows for each stretch of index."""
    n = np.diff(off)
    total = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[index], 0)]) if len(index) else np.zeros((1, table.shape[1]))
    return (total[off[1:]] - total[off[:-1]]) / np.maximum(n, 1)[:, None]


class Labeller:
    """Embeddings, two LSTMs (forward and backward) and a logistic output, with backpropagation through time in numpy."""

    def __init__(self, d_path: int = 24, d_word: int = 8, hidden: int = 16, seed: int = 5):
        g = np.random.default_rng(seed)
        self.h, self.dp, self.dw = hidden, d_path, d_word
        d = d_path + d_word + SHAPE
        self.p = {"path": g.normal(0, 0.3, (PATHS, d_path)), "word": g.normal(0, 0.3, (WORDS, d_word)), "out": g.normal(0, 0.2, (2 * hidden + d, 1)), "bias": np.zeros((1, 1))}
        for k in ("f", "b"):
            self.p["x" + k] = g.normal(0, 1 / np.sqrt(d), (d, 4 * hidden))
            self.p["r" + k] = g.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p["c" + k] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])[None, :]  # forget, input, output, candidate

    def inputs(self, e: Encoded) -> np.ndarray:
        return np.concatenate([_bag(self.p["path"], e.path, e.path_off), _bag(self.p["word"], e.word, e.word_off), e.shape], 1)

    def _run(self, k: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x (T, B, d) -> hidden states (T, B, h); masked steps carry the state on."""
        t, b, h = len(x), x.shape[1], self.h
        gates = x.reshape(t * b, -1) @ self.p["x" + k] + self.p["c" + k]
        gates = gates.reshape(t, b, 4 * h)
        s, c, out, tape = np.zeros((b, h)), np.zeros((b, h)), np.empty((t, b, h)), []
        for i in range(t):
            z = gates[i] + s @ self.p["r" + k]
            a = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            g = np.tanh(z[:, 3 * h :])
            c2 = a[:, :h] * c + a[:, h : 2 * h] * g
            tc = np.tanh(c2)
            s2 = a[:, 2 * h :] * tc
            m = mask[i][:, None]
            if keep:
                tape.append((s, c, a, g, tc))
            c, s = m * c2 + (1 - m) * c, m * s2 + (1 - m) * s
            out[i] = s
        return out, tape

    def _back(self, k: str, x: np.ndarray, mask: np.ndarray, tape: list, d_out: np.ndarray, grad: dict) -> np.ndarray:
        t, b, h = len(x), x.shape[1], self.h
        ds, dc, dz_all = np.zeros((b, h)), np.zeros((b, h)), np.empty((t, b, 4 * h))
        for i in range(t - 1, -1, -1):
            s, c, a, g, tc = tape[i]
            m = mask[i][:, None]
            ds = ds + d_out[i]
            d_s2, d_c2 = ds * m, dc * m
            d_c2 = d_c2 + d_s2 * a[:, 2 * h :] * (1 - tc * tc)
            dz = np.concatenate([d_c2 * c, d_c2 * g, d_s2 * tc], 1) * a * (1 - a)
            dz = np.concatenate([dz, d_c2 * a[:, h : 2 * h] * (1 - g * g)], 1)
            dz_all[i] = dz
            grad["r" + k] += s.T @ dz
            ds, dc = ds * (1 - m) + dz @ self.p["r" + k].T, dc * (1 - m) + d_c2 * a[:, :h]
        flat = dz_all.reshape(t * b, -1)
        grad["x" + k] += x.reshape(t * b, -1).T @ flat
        grad["c" + k] += flat.sum(0, keepdims=True)
        return (flat @ self.p["x" + k].T).reshape(x.shape)

    @staticmethod
    def _pad(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(T, B) row numbers forward and backward in each page's own order, and the mask."""
        t, start = int(lengths.max()), np.cumsum(lengths) - lengths
        i = np.arange(t)[:, None]
        mask = (i < lengths[None, :]).astype(float)
        ahead = start[None, :] + np.minimum(i, lengths[None, :] - 1)
        back = start[None, :] + np.maximum(lengths[None, :] - 1 - i, 0)
        return ahead, back, mask

    def logits(self, e: Encoded, lengths: np.ndarray, tape: dict | None = None) -> np.ndarray:
        x = self.inputs(e)
        ahead, back, mask = self._pad(lengths)
        hf, tf = self._run("f", x[ahead], mask, tape is not None)
        hb, tb = self._run("b", x[back], mask, tape is not None)
        states = np.zeros((len(x), 2 * self.h))
        on = mask > 0
        states[ahead[on], : self.h] = hf[on]
        states[back[on], self.h :] = hb[on]
        full = np.concatenate([states, x], 1)
        if tape is not None:
            tape.update(x=x, ahead=ahead, back=back, mask=mask, tf=tf, tb=tb, full=full)
        return (full @ self.p["out"] + self.p["bias"])[:, 0]

    def gradient(self, e: Encoded, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        tape: dict = {}
        z = np.clip(self.logits(e, lengths, tape), -30, 30)
        q = 1 / (1 + np.exp(-z))
        dz = ((q - y) / len(y))[:, None]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["bias"] = tape["full"].T @ dz, dz.sum(0, keepdims=True)
        d_full = dz @ self.p["out"].T
        on = tape["mask"] > 0
        dx = d_full[:, 2 * self.h :].copy()
        for k, rows, t, a in (("f", tape["ahead"], tape["tf"], 0), ("b", tape["back"], tape["tb"], self.h)):
            d_out = np.zeros((*rows.shape, self.h))
            d_out[on] = d_full[rows[on], a : a + self.h]
            d_in = self._back(k, tape["x"][rows], tape["mask"], t, d_out, grad)
            np.add.at(dx, rows[on], d_in[on])
        for name, index, off, a, b in (("path", e.path, e.path_off, 0, self.dp), ("word", e.word, e.word_off, self.dp, self.dp + self.dw)):
            n = np.diff(off)
            np.add.at(grad[name], index, np.repeat(dx[:, a:b] / np.maximum(n, 1)[:, None], n, 0))
        return float(-(y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12)).mean()), grad

    def train(self, pages: list[tuple[list[Leaf], np.ndarray]], epochs: int, batch: int = 24, rate: float = 0.01) -> list[float]:
        g = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, []
        by_size = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
        groups = [by_size[a : a + batch] for a in range(0, len(by_size), batch)]
        ready = [(encode([x for k in ks for x in pages[k][0]]), np.array([len(pages[k][0]) for k in ks]), np.concatenate([pages[k][1] for k in ks])) for ks in groups]
        for epoch in range(epochs):
            total = 0.0
            for k in g.permutation(len(ready)):
                loss, grad = self.gradient(*ready[k])
                total += loss
                step += 1
                for name, d in grad.items():
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d * d
                    self.p[name] -= rate * (0.5 if epoch >= epochs * 2 // 3 else 1) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(ready))
        return losses

    def _states(self, k: str, x: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The logits' share of one direction's hidden states, a stretch of steps at a time; rows (T, B) of x."""
        h = self.h
        w_in, w_on, bias = (self.p[c + k].astype(np.float32) for c in "xrc")
        out = self.p["out"][:h] if k == "f" else self.p["out"][h : 2 * h]
        got = np.zeros(len(x), np.float32)
        s = c = np.zeros((rows.shape[1], h), np.float32)
        for start in range(0, len(rows), 512):
            some = rows[start : start + 512]
            gates = x[some] @ w_in + bias
            for i in range(len(some)):
                z = gates[i] + s @ w_on
                a = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
                c = a[:, :h] * c + a[:, h : 2 * h] * np.tanh(z[:, 3 * h :])
                s = a[:, 2 * h :] * np.tanh(c)
                on = start + i < lengths  # a page that has ended keeps on reading its last leaf, to no effect
                got[some[i][on]] = (s @ out.astype(np.float32))[on, 0]
        return got

    def labels(self, pages: list[list[Leaf]], cells: int = 16_384) -> list[np.ndarray]:
        """Article (True) or not for every leaf of every page; pages of like length are read together, `cells` steps of pages at a time (one page at least)."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= cells:
                n += 1
            ks, order = order[:n], order[n:]
            lengths = np.array([len(pages[k]) for k in ks])
            flat = [x for k in ks for x in pages[k]]
            # Inputs are made of a stretch of leaves that has so many path buckets at most (one leaf at least).
            ends = np.cumsum([len(x.path) + 2 for x in flat]) // 400_000
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(flat)]
            x = np.concatenate([self.inputs(encode(flat[a:b])).astype(np.float32) for a, b in zip(cuts, cuts[1:], strict=False)])
            ahead, back, _ = self._pad(lengths)
            z = x @ self.p["out"][2 * self.h :].astype(np.float32)[:, 0] + np.float32(self.p["bias"][0, 0])
            z += self._states("f", x, ahead, lengths) + self._states("b", x, back, lengths)
            for k, part in zip(ks, np.split(z, np.cumsum(lengths)[:-1]), strict=True):
                out[k] = part > 0
        return out


@lru_cache(maxsize=1)
def trained(pages: int = 600, epochs: int = 6) -> Labeller:
    net = Labeller()
    net.train(page_examples(pages, 1), epochs)
    return net


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    found = [leaves(p) for p in pages]
    return ["\n\n".join(x.text for x, ok in zip(ls, on, strict=True) if ok) for ls, on in zip(found, net.labels(found), strict=True)]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text (the main text) and n_chars (its code points).

    A null or empty page, one without text, and one without an article leaf get the empty text. Columns of pages that bear a new
    name are replaced; repeated rows stay; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def make():
        net = shared.value
        return lambda texts: [pa.array(main_texts(texts.to_pylist(), net), pa.string())]

    out = with_columns(pages, html_col, [T.StructField("text", T.StringType())], make)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
