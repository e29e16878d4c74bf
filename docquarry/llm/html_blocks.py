"""Main text of web pages: a recurrent labeller of blocks.

A page becomes the sequence of its leaf blocks, each with the set of tags, classes and ids above it and its words.  Hashed into learned vectors, these are read by
a bidirectional LSTM in numpy, so a block is judged by what it is and by the whole page before and behind it.  The blocks that are judged to be
of the article are the main text, in page order.  The labeller is trained by `layouts`, a generator of pages whose blocks' kinds are known.
"""

from __future__ import annotations

import html as references
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import arrow_limits

# ---- fixed values: elements as HTML has them
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
HIDDEN = frozenset("audio canvas datalist head map math object svg template video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is open, up to the elements that hold it.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_P_ENDS_AT = tuple(BLOCKS - {"p", "label", "button"})

TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|(?P<open>\Z)))|[!?][^>]*>|/[^a-zA-Z>][^>]*>|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']+|"[^"<]*"|'[^'<]*'|["'])*+)>)""", re.DOTALL)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
LETTERS = re.compile(r"[a-z]+")

#: Sizes of the learned tables, of a cell, and the threshold.
PATHS, WORDS, PATH_DIM, WORD_DIM, PLAIN, CELL, SURE = 2048, 2048, 12, 6, 4, 16, 0.5
#: Pages that are read side by side; steps whose inputs are held at a time; pages and rounds of training.
SIDE, STEPS, PAGES, EPOCHS = 128, 4096, 2500, 8
#: Share of the pages in training whose words are shown, too.
HEARD = 0.3
#: Characters of html that a task labels at a time, about.
PIECE = 1 << 22


class Block:
    """A leaf: text, hashed path (ascending, each once), characters of its text in links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[int, ...], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


class Place:
    """Where an open element stands: the hashed names of it and of all above it, and the path that a leaf right in it has."""

    __slots__ = ("names", "path")

    def __init__(self, names: frozenset, leaf: int | None = None) -> None:
        self.names, self.path = names, tuple(sorted(names if leaf is None else names | {leaf}))


_NOWHERE = Place(frozenset())


@lru_cache(maxsize=8192)
def _element(name: str, attributes: str) -> tuple[frozenset, int]:
    """(hashed names of an element: its tag, and the words of its class, id and role; its tag as that of a leaf)."""
    found = {name}
    for kind, *values in NAMED.findall(attributes):
        for value in values:
            cut = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
            found.update(f"{'role' if kind.lower() == 'role' else 'name'}:{x}" for x in LETTERS.findall(cut))
    return frozenset(zlib.crc32(x.encode()) % PATHS for x in found), zlib.crc32(f"leaf:{name}".encode()) % PATHS


@lru_cache(maxsize=8192)
def _within(above: Place, name: str, attributes: str) -> Place:
    own, leaf = _element(name, attributes)
    return Place(above.names if own <= above.names else above.names | own, leaf)


def _ends(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE)


_RAW_ENDS = {x: _ends(x) for x in (*RAW, *HIDDEN)}


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks with text, in order: references decoded, white space as single blanks, trimmed.

    Elements that are left open are closed as HTML says where it matters for text; a comment, script or style without an end hides the rest; a
    tag without an end is dropped.  Null and empty pages have none.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []
    pieces: list[str] = []
    state = [0, False]  # characters in links; within a link

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, (stack[-1][1] if stack else _NOWHERE).path, state[0]))
            pieces.clear()
            state[0] = 0

    def close(names: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Pops up to the last open one of the names, unless one of `within` comes first."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    def say(text: str) -> None:
        text = references.unescape(text) if "&" in text else text
        pieces.append(text)
        if state[1]:
            state[0] += len(text.strip())

    at, last = 0, page.rfind(">") + 1
    while at < last:
        m = TAG.search(page, at, last)
        if m is None:
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            at = len(page) if m["open"] is not None else at
            continue
        name, ending = m["name"].lower(), m["end"]
        if name in RAW or name in HIDDEN:
            if not ending and not (name in HIDDEN and m["more"].endswith("/")):
                if name == "head":
                    continue
                end = _RAW_ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            state[1] = not ending
        elif name == "br":
            pieces.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        state[1] = state[1] and not ending
        if ending:
            if name == "p":
                close(("p",), _P_ENDS_AT)
            else:
                close((name,), ("table", "td", "th", "caption") if name not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("table",) if name != "table" else ())
            continue
        if stack and stack[-1][0] == "p" and name not in ("button", "label", "select", "option", "optgroup"):
            stack.pop()
        if name in CLOSED_BY:
            close(*CLOSED_BY[name])
        elif name in HEADINGS and stack and stack[-1][0] in HEADINGS:
            stack.pop()
        if name not in VOID:
            stack.append((name, _within(stack[-1][1] if stack else _NOWHERE, name, m["more"])))
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag without an end
        say(rest[: cut.start()] if cut else rest)
    flush()
    return out


class _Hashed(dict):
    """Words' hashes; those asked for before are looked up."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = got = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return got


_HASHED = _Hashed()


class Inputs:
    """Blocks as numbers: hashed paths and words one after the other with where each block's begin, and the plain columns."""

    def __init__(self, found: list[Block]) -> None:
        words, self.word_n = [], np.zeros(len(found), dtype=np.int64)
        for i, b in enumerate(found):
            said = b.text.lower().split()
            words += map(_HASHED.__getitem__, said)
            self.word_n[i] = len(said)
        self.word, self.path = np.array(words, dtype=np.int64), np.array([x for b in found for x in b.path], dtype=np.int64)
        self.path_n = np.array([len(b.path) for b in found], dtype=np.int64)
        size = np.array([len(b.text) for b in found], dtype=np.float64)
        linked = np.array([b.linked for b in found], dtype=np.float64)
        ends = np.array([b.text[-1] in ".!?:;\"')" for b in found], dtype=np.float64)
        self.plain = np.stack((np.log1p(self.word_n) / 4, np.minimum(1, linked / np.maximum(size, 1)), ends, self.word_n < 4), axis=1) if found else np.zeros((0, PLAIN))

    def vectors(self, w: dict[str, np.ndarray]) -> np.ndarray:
        """A row for each block: the sum of its path's vectors, the mean of its words', the plain columns."""
        return np.concatenate((_summed(w["path"], self.path, self.path_n), _summed(w["word"], self.word, self.word_n) / np.maximum(self.word_n, 1)[:, None], self.plain.astype(w["path"].dtype)), axis=1)


def _summed(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    out = np.zeros((len(sizes), table.shape[1]), dtype=table.dtype)
    stops = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        begin = stops[row] - sizes[row]
        to = max(row + 1, int(np.searchsorted(stops, begin + at_once, side="right")))
        some = np.flatnonzero(sizes[row:to])
        if len(some):
            out[row + some] = np.add.reduceat(table[ids[begin : stops[to - 1]]], (stops - sizes)[row + some] - begin, axis=0)
        row = to
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def read_way(x: np.ndarray, live: np.ndarray, w: dict[str, np.ndarray], way: str, keep: bool = False) -> tuple[np.ndarray, list]:
    """(states by step and page, what the way back needs) of an LSTM over x (steps, pages, inputs); steps that aren't live leave state and cell at zero."""
    n, pages, _ = x.shape
    h, c = np.zeros((pages, CELL), x.dtype), np.zeros((pages, CELL), x.dtype)
    out, held = np.empty((n, pages, CELL), x.dtype), []
    for t in range(n):
        if t % STEPS == 0:
            given = x[t : t + STEPS] @ w[f"in_{way}"] + w[f"bias_{way}"]
        z = given[t % STEPS] + h @ w[f"own_{way}"]
        i, f, o = (_sigmoid(z[:, k * CELL : (k + 1) * CELL]) for k in range(3))
        g = np.tanh(z[:, 3 * CELL :])
        before, before_c = h, c
        c = (f * c + i * g) * live[t]
        s = np.tanh(c)
        h = o * s
        out[t] = h
        if keep:
            held.append((i, f, o, g, s, before, before_c))
    return out, held


def scores(found: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The log odds of each block, page by page; found: vectors of each page's blocks."""
    out: list = [None] * len(found)
    order = sorted(range(len(found)), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        # pages side by side are about as long as each other
        mine = [order[at]]
        while len(mine) < SIDE and at + len(mine) < len(order) and len(found[order[at + len(mine)]]) <= 8 + 1.3 * len(found[order[at]]):
            mine.append(order[at + len(mine)])
        at += len(mine)
        x, live = padded([found[i] for i in mine])
        z = read_way(x, live, w, "on")[0] @ w["out_on"] + read_way(x[::-1], live[::-1], w, "back")[0][::-1] @ w["out_back"] + w["bias_out"]
        for k, i in enumerate(mine):
            out[i] = z[: len(found[i]), k]
    return out


def padded(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, inputs) and which steps are live."""
    n = max(len(v) for v in found)
    x, live = np.zeros((n, len(found), PATH_DIM + WORD_DIM + PLAIN), np.float32), np.zeros((n, len(found), 1), np.float32)
    for k, v in enumerate(found):
        x[: len(v), k], live[: len(v), k] = v, 1
    return x, live


def new_weights(seed: int) -> dict[str, np.ndarray]:
    r, inputs = np.random.default_rng(seed), PATH_DIM + WORD_DIM + PLAIN
    w = {"path": r.normal(0, 0.3, (PATHS, PATH_DIM)), "word": r.normal(0, 0.1, (WORDS, WORD_DIM)), "bias_out": np.zeros(())}
    for way in ("on", "back"):
        bias = np.zeros(4 * CELL)
        bias[CELL : 2 * CELL] = 1
        w |= {f"in_{way}": r.normal(0, inputs**-0.5, (inputs, 4 * CELL)), f"own_{way}": r.normal(0, CELL**-0.5, (CELL, 4 * CELL)), f"bias_{way}": bias, f"out_{way}": r.normal(0, CELL**-0.5, CELL)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def gradient(found: list[Inputs], labels: list[np.ndarray], w: dict[str, np.ndarray], heard: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """(mean loss of a block, its gradient): back through time on both ways, down to the hashed tables.

    heard: 0 for the pages whose words and plain columns are hidden, so that paths are learned to suffice.
    """
    x, live = padded([f.vectors(w) for f in found])
    heard = np.ones(len(found), np.float32) if heard is None else heard.astype(np.float32)
    x[:, :, PATH_DIM:] *= heard[None, :, None]
    want = np.zeros(x.shape[:2], np.float32)
    for k, y in enumerate(labels):
        want[: len(y), k] = y
    states, total = {}, live.sum()
    for way, s in (("on", 1), ("back", -1)):
        states[way] = read_way(x[::s], live[::s], w, way, keep=True)
    z = states["on"][0] @ w["out_on"] + states["back"][0][::-1] @ w["out_back"] + w["bias_out"]
    p = _sigmoid(z)
    loss = float((-np.log(np.where(want > 0, p, 1 - p) + 1e-7) * live[:, :, 0]).sum() / total)
    dz = (p - want) * live[:, :, 0] / total
    got = {"bias_out": dz.sum()}
    dx = np.zeros_like(x)
    for way, s in (("on", 1), ("back", -1)):
        out, held = states[way]
        back, own = dz[::s], w[f"own_{way}"]
        got[f"out_{way}"] = np.einsum("tp,tpc->c", back, out)
        dgate = np.zeros((*x.shape[:2], 4 * CELL), np.float32)
        d_own, dh, dc = np.zeros_like(own), np.zeros_like(out[0]), np.zeros_like(out[0])
        for t in range(len(out) - 1, -1, -1):
            i, f, o, g, sc, before, before_c = held[t]
            dh = dh + back[t][:, None] * w[f"out_{way}"]
            dc = (dc + dh * o * (1 - sc * sc)) * live[::s][t]
            d = np.concatenate((dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * sc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dgate[t] = d
            d_own += before.T @ d
            dh, dc = d @ own.T, dc * f
        got |= {f"own_{way}": d_own, f"in_{way}": np.einsum("tpi,tpg->ig", x[::s], dgate), f"bias_{way}": dgate.sum(axis=(0, 1))}
        dx += (dgate @ w[f"in_{way}"].T)[::s]
    got |= {"path": np.zeros_like(w["path"]), "word": np.zeros_like(w["word"])}
    for k, f in enumerate(found):
        d = dx[: len(f.path_n), k]
        d[:, PATH_DIM:] *= heard[k]
        np.add.at(got["path"], f.path, np.repeat(d[:, :PATH_DIM], f.path_n, axis=0))
        np.add.at(got["word"], f.word, np.repeat(d[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(f.word_n, 1)[:, None], f.word_n, axis=0))
    return loss, got


# ---- pages to learn from

MARK = "\x01"
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ll ed ción para os que ment eau è é ich sch ung ver über ß ñ lo la com mi tos na ko shi ra %%% &amp;&amp; $$ ### 12 7 2024 x1".split()
_PHRASES = {
    "menu": "Home|About us|Contact|News|Sports|Login|Sign in|Products|Categories|Inicio|Startseite|Accueil|Skip to content|Menu|Search|Next page|Previous|FAQ|Archive",
    "ad": "Advertisement|Sponsored|Buy now and save 20%|Anzeige|Publicidad|Special offer, only today|Promoted by our partners",
    "header": "Daily Herald|Welcome to our site|The home of news|Your account|Cart (0)",
    "footer": "&copy; 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Impressum|Powered by WordPress|&copy; example.com &middot; all rights reserved|Mentions légales",
    "side": "Related articles|Most read|Recent posts|You may also like|Trending now|Tags|Popular|Archives|Follow us on Twitter",
    "notice": "We use cookies to improve your experience.|Accept all|By continuing you agree to our cookie policy.|This site uses cookies|Please enable JavaScript|Subscribe to our newsletter|You have 3 free articles left",
    "form": "Your email|Password|Submit|Send|Name|Subscribe|Remember me|Leave a message|Search",
    "comments": "Comments (12)|Reply|Leave a reply|Great article, thanks!|I don't agree with this at all.|John says:|2 days ago|Report|Show more comments",
    "share": "Share on Facebook|Tweet|Share this|Print|Email this|Pin it",
}
_HOLDERS = {
    "menu": "nav|nav|nav class=main-nav|div class=menu|div id=navbar|div class=navigation|ul class=nav|div class=breadcrumbs|nav id=top|div class=topnav|div role=navigation|menu",
    "ad": "div class=ad|div class=ad|div class=ads|div class=advert|div class=advertisement|div id=ad-top|aside class=sponsored|div class=banner-ad|div class=promo|section class=ad-slot|div class=sponsor|aside class=ad",
    "header": "header|header class=site-header|div id=header|div class=masthead|div class=top-bar|div role=banner|header id=top",
    "footer": "footer|footer|div class=footer|div id=footer|div class=copyright|footer class=site-footer|div role=contentinfo|section class=footer",
    "side": "aside|aside class=sidebar|div class=sidebar|div id=sidebar|div class=widget|div class=related|section class=related-posts|div class=recommended|aside class=related|div role=complementary|div id=right-column",
    "notice": "div class=cookie|div class=cookie-notice|div id=cookie-banner|div class=consent|div class=alert|div class=notice|div class=gdpr|section class=newsletter|div class=popup|div role=alert|div class=paywall|aside class=notice|div class=disclaimer|div class=banner|div role=dialog|dialog|p class=notice|p class=cookie",
    "form": "form|form|form class=search|form id=login|form class=newsletter|div class=login|form action=/subscribe|fieldset",
    "comments": "section class=comments|section id=comments|div id=comments|div class=comments|div class=comment-list|ol class=commentlist|div class=user-comments|aside class=comments|div id=disqus|section class=replies|div class=discussion|article class=comment|div class=comment",
    "share": "div class=share|div class=social|ul class=share-links|div class=share-buttons|div class=tags|aside class=share",
}
_MAIN = "article|article|article|article class=post|main|main|main/article|div id=content/article|div class=content|div id=main|div class=post|div class=entry-content|div class=article-body|section class=article|div id=article|div class=story|div role=main|div class=container/div class=text|div id=wrapper/main id=main/article class=entry|section|div"


class _Maker:
    """One page of known blocks: those of the article begin with MARK."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def prose(self, most: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(1, max(1, most))):
            out.append("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."]))
        return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!", "&amp;"])

    def inline(self, text: str) -> str:
        if self.r.random() > 0.25:
            return text
        kind, words = self.r.choice(["b", "i", "em", "strong", "a href=/x", "span", "code"]), text.split(" ")
        at = self.r.randrange(len(words))
        words[at] = f"<{kind}>{words[at]}</{kind.split()[0]}>"
        return " ".join(words)

    def held(self, holder: str, inner: str) -> str:
        for x in reversed(holder.split("/") if not holder.startswith("form action") else [holder]):
            name, _, rest = x.partition(" ")
            key, _, value = rest.partition("=")
            inner = f"<{name}{f' {key}={chr(34)}{value}{chr(34)}' if key else ''}>{inner}</{name}>"
        return inner

    def boilerplate(self, kind: str) -> str:
        r = self.r
        said = lambda most: r.choice(_PHRASES[kind].split("|")) if r.random() < 0.4 else self.prose(most)
        if kind == "menu":
            items = [f'<a href="/{i}">{said(3)}</a>' for i in range(r.randint(2, 9))]
            inner = r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", " ".join(items), "".join(f"<div>{x}</div>" for x in items)])
        elif kind == "form":
            inner = f"<label>{said(3)}</label><input><p>{said(12)}</p><button>{said(2)}</button>" if r.random() < 0.7 else f"{said(8)}<select><option>{said(1)}<option>{said(1)}</select><textarea>{said(3)}</textarea><button>{said(2)}</button>"
        elif kind == "comments":
            each = ["article class=comment", "div class=comment", "li", "p", "div class=reply", "article"]
            shape = r.choice(each)
            inner = (f"<h{r.choice('234')}>{said(4)}</h3>" if r.random() < 0.6 else "") + "".join(self.held(shape, (f"<p>{said(40)}</p>" if shape != "p" and r.random() < 0.6 else said(40))) for _ in range(r.randint(1, 5)))
        elif kind == "side":
            inner = (f"<h{r.choice('234')}>{said(4)}</h3>" if r.random() < 0.6 else "") + r.choice(["<ul>" + "".join(f'<li><a href="/{i}">{said(8)}</a></li>' for i in range(r.randint(1, 6))) + "</ul>", f"<p>{said(25)}</p>", f"<p>{said(15)}</p><p>{said(15)}</p>", said(12)])
        elif kind == "header":
            inner = r.choice([f"<h1>{said(4)}</h1><p>{said(8)}</p>", f"<a href=/>{said(3)}</a>", f"<p>{said(6)}</p>", f"<div>{said(3)}</div>" + (self.boilerplate("menu") if r.random() < 0.5 else "")])
        else:
            inner = r.choice([said(25), f"<p>{said(40)}</p>", f"<p>{said(12)}</p><p>{said(12)}</p>", f"<div>{said(10)}</div>", f'{said(12)} <a href="/z">{said(3)}</a>', f"<h{r.choice('234')}>{said(4)}</h3><p>{said(25)}</p>", f"<p>{said(20)}</p><button>{said(2)}</button>"])
        return self.held(r.choice(_HOLDERS[kind].split("|")), inner)

    def article(self, plain: bool) -> str:
        r = self.r
        # what an article says is no sign: it may sound like a menu, repeat itself or be very short
        phrases, again = [x for kind in _PHRASES.values() for x in kind.split("|")], self.prose(r.choice([1, 3, 40]))
        odd = r.choice([0, 0.1, 0.1, 0.5, 0.9])

        def words(most: int) -> str:
            if r.random() < odd:
                return r.choice([again, r.choice(phrases), self.prose(2)])
            return self.prose(most)

        own = lambda most: MARK + self.inline(words(most))
        out = [f"<h1>{own(12)}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.12:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14, 20, 30])):
            x = r.random()
            if x < 0.55:
                out.append(f"<p>{own(r.choice([2, 6, 20, 60]))}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif x < 0.7:
                out.append(f"<p><b>{MARK}{words(30)}<br>" + r.choice(["", "</p>"]))
            elif x < 0.76:
                out.append(f"<h{r.choice('23')}>{own(6)}</h2>")
            elif x < 0.81:
                kind = r.choice(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(f"<li>{own(12)}</li>" for _ in range(r.randint(1, 6))) + f"</{kind}>")
            elif x < 0.84:
                out.append(f"<blockquote>{r.choice([f'<p>{own(25)}</p>', own(20)])}</blockquote>")
            elif x < 0.86:
                out.append(f"<pre>{own(20)}</pre>")
            elif x < 0.88:
                out.append("<table>" + "".join(f"<tr><td>{own(3)}</td><td>{own(3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.9:
                out.append(f"<figure><img src=x><figcaption>{own(8)}</figcaption></figure>")
            elif x < 0.93:
                out.append(f"<{r.choice(['div', 'section'])}><p>{own(30)}</p></div>" if plain else f"<div>{own(30)}</div>")
            elif not plain:
                out.append(self.boilerplate(r.choice(["ad", "ad", "side", "share", "notice", "form"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: "".join(self.boilerplate(k) for k in kinds if r.random() < p)
        before = ["header", "menu", "ad", "notice", "side", "form"]
        behind = ["share", "comments", "side", "ad", "form", "notice", "menu", "footer"]
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(behind)
        holder = r.choice(_MAIN.split("|")) if r.random() < 0.93 else ""
        bare = not holder or holder in ("div", "section")
        own = self.article(bare)
        inside = some(["comments", "share", "side"], 0.12) if holder and not bare else ""
        main = self.held(holder, own + inside) if holder else own
        script, comment = "<script>var t='</p>';</script>" if r.random() < 0.5 else "", "<!-- ad -->" if r.random() < 0.5 else ""
        body = some(before, 0.4) + comment + main + some(behind, 0.4)
        if r.random() < 0.25:
            body = self.held(r.choice(["div id=page", "div class=wrapper", "div", "div class=container"]), body)
        if r.random() < 0.1:
            body = body[: r.randrange(len(body) // 2, len(body))]  # cut short
        return f"<!DOCTYPE html><html><head><title>{self.prose(6)}</title><style>p{{}}</style>{script}</head><body>{body}" + r.choice(["</body></html>", ""])


def layouts(seed: int, pages: int) -> Iterator[tuple[list[Block], np.ndarray]]:
    """(blocks, 1 for those of the article) of made pages."""
    for i in range(pages):
        found = blocks(_Maker(seed * 1_000_003 + i).page())
        labels = np.array([b.text.startswith(MARK) for b in found], dtype=np.float32)
        for b in found:
            b.text = b.text.replace(MARK, "") or "."
        if found:
            yield found, labels


@lru_cache(maxsize=1)
def trained(seed: int = 5, pages: int = PAGES, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """The labeller's weights: the same for the same arguments, learned once in a driver (about ten seconds, whatever the corpus)."""
    w, r = new_weights(seed), np.random.default_rng(seed)
    data = sorted(((Inputs(b), y) for b, y in layouts(seed, pages)), key=lambda x: len(x[1]))
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        rate = 0.015 if epoch < epochs - 3 else 0.004
        for i in r.permutation(len(batches)):
            step += 1
            _, got = gradient([x for x, _ in batches[i]], [y for _, y in batches[i]], w, r.random(len(batches[i])) < HEARD)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in got.values())))
            for k, g in got.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


def labelled(pages: list[str | None], w: dict[str, np.ndarray]) -> list[list[tuple[str, float]]]:
    """Each page's blocks as (text, probability that it is of the article)."""
    found = [blocks(p) for p in pages]
    some = [i for i, f in enumerate(found) if f]
    if not some:
        return [[] for _ in pages]
    vectors = Inputs([b for i in some for b in found[i]]).vectors(w)
    ends = np.cumsum([len(found[i]) for i in some])
    out: list[list[tuple[str, float]]] = [[] for _ in pages]
    for i, z in zip(some, scores(np.split(vectors, ends[:-1]), w), strict=True):
        out[i] = [(b.text, float(p)) for b, p in zip(found[i], _sigmoid(z), strict=True)]
    return out


def _pieces(batch: pa.RecordBatch, html: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about PIECE characters of html, a page at least."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(html)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), PIECE)))
        yield batch.slice(at, n)
        at += n


def _shared(pages: DataFrame) -> Broadcast:
    arrow_limits(pages.sparkSession)
    return pages.sparkSession.sparkContext.broadcast(trained())


def label_blocks(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, blocks): a row per row of pages; of each block the text and the probability that it is of the article."""
    shared, kind = _shared(pages), dict(pages.dtypes)[page_id]
    blocks_type = pa.list_(pa.struct([("text", pa.string()), ("probability", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, "html"):
                found = [[{"text": t, "probability": p} for t, p in page] for page in labelled(batch.column("html").to_pylist(), shared.value)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, blocks_type)], names=["page_id", "url", "blocks"])

    return _own(pages, page_id, url, html).mapInArrow(of, f"page_id {kind}, url string, blocks array<struct<text: string, probability: double>>")


def _own(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): a row per row of pages; text: the blocks of the article in page order, two line ends between them.

    Null and empty pages, and pages without a block of an article, have an empty text.  Repeated rows give repeated results; ids and urls may be null; an empty
    table gives no row; further columns are ignored.  A page is read whole, in its own row: no shuffle.
    """
    shared, kind = _shared(pages), dict(pages.dtypes)[page_id]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, "html"):
                texts = ["\n\n".join([t for t, p in page if p > SURE]) for page in labelled(batch.column("html").to_pylist(), shared.value)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = _own(pages, page_id, url, html).mapInArrow(of, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
