"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM in numpy over a page's leaf blocks.

A page is cut into leaf blocks at block-level tags and line breaks; scripts, styles and comments are no text. Each block
has a vector of its tag path (every element's tag, class and id words, hashed to fixed random signs), one of its words
(hashed likewise, averaged) and a few numbers (length, link share, marks). The LSTM reads all blocks of a page in both
directions, so each decision uses the whole page. It is trained here, on pages made by `make_page` from the usual
layouts with known labels, as the corpus has none; training is deterministic and takes a fixed time.

Pages are cut by one scan that never goes back: tags end at the first > outside quotes (or, where quotes are left open, at the
first >); a page in which such a search fails once has all its tag ends found together, from its end. A block's path is
carried as a running sum, so nesting of any depth costs the same for each block.

Edge cases. A null or empty page, or one without main blocks, gives the empty text; unclosed comments, scripts and styles end with
the page; a < without a > behind it is text; only scripts, styles, comments and text areas (form fields) are left out by their
names, while svg, template, noscript and iframe are elements like others, whose blocks the labeller judges; pages of any length
are read whole; ids may be null or repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, chunks, on_leave, table

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 32, 8, 4, 16
INPUT = PATH_DIM + WORD_DIM + NUMBERS
PAGES, EPOCHS = 700, 10
#: Elements by how HTML treats them.
SIBLINGS = frozenset("p li option dt dd tr td th".split())  # their end tags may be left out
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea".split())
_START = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s>/]*)")
_REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


class _Ends:
    """Where tags end: the first > outside quotes after a place, or -1; found for a whole page from its end."""

    def __init__(self, page: str):
        code = np.frombuffer(page.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.flatnonzero((code == 0x3E) | (code == 0x22) | (code == 0x27))
        kind, at = code[self.at].astype(np.uint8).tobytes(), self.at.tolist()
        self.end = np.empty(len(at), np.int64)
        plain = double = single = -1
        for i in range(len(at) - 1, -1, -1):
            c = kind[i]
            if c == 0x3E:
                plain = at[i]
            elif c == 0x22:
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.end[i] = plain

    def after(self, place: int) -> int:
        i = int(np.searchsorted(self.at, place))
        return int(self.end[i]) if i < len(self.end) else -1


def tags(page: str):
    """(place, end, whether it closes, name, attributes) of every tag; comments and the like have no name. What lies between is
    text. The caller sends the place to go on from, if it isn't the tag's end."""
    last, at, ends = page.rfind(">"), 0, None
    while m := _START.search(page, at):
        here = m.start()
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            at = end + 3 if end >= 0 else len(page)
            yield here, at, False, "", ""
            continue
        if here > last:
            return
        named = _NAME.match(page, here)
        if not named:  # <! or <?
            at = page.index(">", here) + 1
            yield here, at, False, "", ""
            continue
        body = named.end()
        if ends is None and (m := _REST.match(page, body)):
            close = m.end() - 1
        else:
            ends = ends or _Ends(page)
            close = ends.after(body)
            if close < 0:
                close = page.find(">", body)
        at = close + 1
        at = (yield here, at, bool(named[1]), named[2].lower(), page[body:close]) or at


class Blocks:
    """Leaf blocks of a page in order: text, characters inside links, and the vector of the tag path."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.linked = array("q")
        self.paths = array("f")
        self._elements: list[np.ndarray] = []  # of the open elements, and their running sum
        self._sums = np.zeros((64, PATH_DIM), np.float32)
        self._cut(page)
        del self._elements, self._sums

    def __len__(self) -> int:
        return len(self.texts)

    def _add(self, text: str, linked: int) -> None:
        depth = len(self._elements)
        path = self._sums[depth] + sum(0.3 * e for e in self._elements[-3:]) if depth else self._sums[0]
        self.texts.append(text)
        self.linked.append(min(linked, len(text)))
        self.paths.frombytes((path / np.sqrt(PATH_DIM / 4)).astype(np.float32).tobytes())

    def _open(self, element: str) -> None:
        depth = len(self._elements)
        if depth + 1 == len(self._sums):
            self._sums = np.concatenate([self._sums, np.zeros_like(self._sums)])
        own = _element_vector(element)
        self._sums[depth + 1] = self._sums[depth] + 0.7 * own
        self._elements.append(own)

    def _cut(self, page: str) -> None:
        names: list[str] = []
        still: dict[str, int] = {}  # how often a name is open
        held: list[str] = []
        linked = links = at = 0

        def flush():
            nonlocal linked
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                if text:
                    self._add(text, linked)
                held.clear()
            linked = 0

        def pop():
            still[names.pop()] -= 1
            self._elements.pop()

        found, jump = tags(page), None
        while True:
            try:
                here, end, closing, name, attrs = found.send(jump) if jump else next(found)
            except StopIteration:
                break
            jump = None
            if here > at:
                held.append(page[at:here])
                linked += (here - at) * links
            at = end
            if not name:
                continue
            if name in RAW:
                if not closing and not attrs.rstrip().endswith("/"):
                    closes = _END[name].search(page, at)
                    at = jump = closes.end() if closes else len(page)
                continue
            if name in INLINE:
                if name == "a":
                    links = 0 if closing else 1
                continue
            flush()
            links = 0
            if closing:
                if still.get(name):
                    while names[-1] != name:
                        pop()
                    pop()
            elif name not in VOID and not attrs.rstrip().endswith("/"):
                if names and (names[-1] == "p" or names[-1] == name and name in SIBLINGS):
                    pop()
                own = " ".join(_PART.findall(" ".join(v.strip("\"'") for v in _ATTR.findall(attrs)).lower())) if attrs else ""
                names.append(name)
                still[name] = still.get(name, 0) + 1
                self._open(f"{name} {own}".strip())
        if at < len(page):
            held.append(page[at:])
            linked += (len(page) - at) * links
        flush()


def blocks(page: str) -> Blocks:
    return Blocks(page)


@lru_cache(maxsize=200_000)
def _signs(word: str, dim: int) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(word.encode())).choice([-1.0, 1.0], dim).astype(np.float32)


@lru_cache(maxsize=50_000)
def _element_vector(element: str) -> np.ndarray:
    return sum((_signs(word, PATH_DIM) for word in element.split()), np.zeros(PATH_DIM, np.float32))


on_leave(__name__, lambda: (_signs.cache_clear(), _element_vector.cache_clear()))
_WORDS = np.random.default_rng(7).choice([-1.0, 1.0], (1024, WORD_DIM)).astype(np.float32)


def page_vectors(page: Blocks) -> np.ndarray:
    x = np.zeros((len(page), INPUT), np.float32)
    x[:, :PATH_DIM] = np.frombuffer(page.paths, np.float32).reshape(-1, PATH_DIM) if len(page) else 0
    for i, (text, linked) in enumerate(zip(page.texts, page.linked, strict=True)):
        words = text.encode().split()
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = _WORDS[[zlib.crc32(w) & 1023 for w in words]].sum(0) / len(words) if words else 0
        x[i, -NUMBERS:] = np.log1p(len(words)) / 3, linked / len(text), text[-1] in ".!?…:\"", len(words) < 4
    return x


def _sigmoid(z):
    return 0.5 + 0.5 * np.tanh(0.5 * z)


def _run(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """LSTM over x (time, batch, input): outputs and, if it is to keep it, what the backward pass needs."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.zeros((t, n, HIDDEN), np.float32), []
    for k in range(t):
        z = x[k] @ w[:INPUT] + b + h @ w[INPUT:]
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            kept.append((h, c, i, f, o, g, tc))
        c, h = new, o * tc
        out[k] = h
    return out, kept


def _back(x: np.ndarray, w: np.ndarray, kept: list, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
    dh, dc = np.zeros_like(d[0]), np.zeros_like(d[0])
    for k in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = kept[k]
        dh = dh + d[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw[:INPUT] += x[k].T @ dz
        dw[INPUT:] += h.T @ dz
        db += dz.sum(0)
        dh, dc = dz @ w[INPUT:].T, dc * f
    return dw, db


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, page, input) forward, the same backward, and the mask. A page alone isn't copied."""
    if len(pages) == 1:
        x = pages[0][:, None, :]
        return x, x[::-1], np.ones((len(x), 1), bool)
    t = max(map(len, pages))
    x, y = np.zeros((t, len(pages), INPUT), np.float32), np.zeros((t, len(pages), INPUT), np.float32)
    mask = np.zeros((t, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], y[: len(p), j], mask[: len(p), j] = p, p[::-1], True
    return x, y, mask


def _turned(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Undo the backward order of each page."""
    if a.shape[1] == 1 and mask.all():
        return a[::-1]
    n = mask.sum(0)
    at = np.where(mask, n[None, :] - 1 - np.arange(len(a))[:, None], np.arange(len(a))[:, None])
    return np.take_along_axis(a, at[:, :, None], 0)


class Labeller:
    def __init__(self, params: list[np.ndarray]):
        self.params = params  # forward w, b; backward w, b; output w, b

    def logits(self, pages: list[np.ndarray], keep: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
        w1, b1, w2, b2, w3, b3 = self.params
        x, y, mask = _padded(pages)
        a, kept1 = _run(x, w1, b1, keep)
        b, kept2 = _run(y, w2, b2, keep)
        b = _turned(b, mask)
        if not keep:
            return a @ w3[:HIDDEN] + b @ w3[HIDDEN : 2 * HIDDEN] + x @ w3[2 * HIDDEN :] + b3, mask, ()
        both = np.concatenate([a, b, x], 2)
        return both @ w3 + b3, mask, (x, y, kept1, kept2, both)

    def main(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages are batched by length."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            size = 256
            own = order[at : at + size]
            while len(own) > 1 and len(pages[own[-1]]) * len(own) > 20_000:
                own = own[: len(own) // 2]
            z, mask, _ = self.logits([pages[i] for i in own])
            for j, i in enumerate(own):
                out[i] = z[: len(pages[i]), j, 0] > 0
            at += len(own)
        return out


_SYLLABLES = "th an on er in re le la de que tion ment ie sch ung ar os ci ll ou ea st nd ti".split()
_LAYOUT = {
    "nav": ["nav", 'div class="menu"', 'ul class="nav navbar"', 'div id="navigation"', 'div class="breadcrumb"', 'div role="navigation"'],
    "header": ["header", 'div id="header"', 'div class="site-header masthead"', 'div role="banner"'],
    "footer": ["footer", 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"'],
    "aside": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related posts"',
        'section class="related"', 'div role="complementary"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"',
        'div class="promo"', 'div id="ad banner"', 'section class="ad"', 'p class="ad"', 'ins class="adsbygoogle"', 'div class="sponsor"',
        'aside class="ad"'],
    "notice": ['div class="cookie notice"', 'div id="cookie banner"', 'div class="gdpr consent"', 'div class="notice"',
        'div role="alert"', 'div class="popup modal"', 'div class="newsletter subscribe"', 'div class="paywall"',
        'section class="notice"', 'p class="notice"', 'div class="alert"', 'div class="disclaimer"'],
    "form": ["form", 'form class="search"', 'form id="login"', 'div class="form"'],
    "comments": ['section id="comments"', 'div class="comments"', 'div id="comments"', 'ol class="commentlist"', 'ul class="comments"',
        'div class="disqus thread"', 'section class="reader comments"', 'div class="comment"'],
    "share": ['div class="share social"', 'ul class="share"', 'div class="tags"', 'div class="pagination"'],
    "main": ["article", "main", 'div class="content"', 'div id="content"', 'div class="post body"', 'div class="entry content"',
        'section class="article"', 'div role="main"', 'div class="article body"', 'div class="story"'],
}


def make_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of a random layout, and for each leaf block whether it is main text."""
    out: list[str] = []
    labels: list[bool] = []
    pick = lambda a: a[int(rng.integers(len(a)))]

    def words(low: int, high: int, end: bool = False) -> str:
        w = ["".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(low, high)))]
        return " ".join(w).capitalize() + ("." if end and rng.random() < 0.9 else "")

    def leaf(tag: str, text: str, main: bool) -> None:
        close = tag.split()[0]
        out.append(f"<{tag}>{text}" + (f"</{close}>" if close != "p" or rng.random() < 0.8 else ""))
        labels.append(main)

    def side(kind: str) -> None:
        tag = pick(_LAYOUT[kind])
        out.append(f"<{tag}>")
        if kind in ("nav", "share") or kind == "footer" and rng.random() < 0.4:
            for _ in range(int(rng.integers(2, 9))):
                leaf("li", f'<a href="/x">{words(1, 4)}</a>', False)
        elif kind == "form":
            for _ in range(int(rng.integers(1, 4))):
                leaf(pick(["p", "button", "div", "legend", "option"]), words(1, 9), False)
        elif kind == "comments":
            if rng.random() < 0.7:
                leaf("h3", words(1, 4), False)
            for _ in range(int(rng.integers(1, 7))):
                leaf(pick(["p", "li", 'div class="comment"', 'p class="comment"', "div"]), words(2, 50, True), False)
        elif rng.random() < 0.5:
            out.append(words(1, 35, True))
            labels.append(False)
        else:
            for _ in range(int(rng.integers(1, 4))):
                leaf(pick(["p", "h3", "li", "div", "h1", "h2"]), words(1, 30,
                    True) if rng.random() < 0.6 else f'<a href="/x">{words(1, 6)}</a>', False)
        out.append(f"</{tag.split()[0]}>")

    leaf("title", words(2, 9), False)
    before = [k for k, p in (("header", 0.5), ("nav", 0.8), ("notice", 0.4), ("ad", 0.5), ("form", 0.3), ("aside",
        0.3)) if rng.random() < p]
    rng.shuffle(before)
    out.append("<body>")
    for k in before:
        side(k)
    tag = pick(_LAYOUT["main"])
    wrapped = rng.random() < 0.3
    out.append(("<main>" if wrapped else "") + f"<{tag}>")
    inside = rng.random() < 0.35
    if rng.random() < 0.9:
        leaf("h1", words(2, 12), True)
    if rng.random() < 0.15:
        leaf(pick(['p class="byline"', "p", 'div class="lead"', "h2"]), words(2, 20), True)
    for _ in range(int(rng.integers(1, 13))):
        u = rng.random()
        if u < 0.62:
            text = words(1, pick([3, 6, 30, 90, 90]), True)
            leaf(pick(["p", "p", "p", "p", "div"]), f"<b>{text}" if rng.random() < 0.1 else text, True)
            if rng.random() < 0.1:
                out.append("<br>" + words(2, 30, True))
                labels.append(True)
        elif u < 0.72:
            leaf(pick(["h2", "h3", "blockquote", "pre", "figcaption"]), words(2, 12), True)
        elif u < 0.84:
            out.append("<ul>")
            for _ in range(int(rng.integers(1, 6))):
                leaf("li", words(1, 16, rng.random() < 0.5), True)
            out.append("</ul>")
        elif u < 0.92:
            out.append("<table>")
            for _ in range(int(rng.integers(1, 4))):
                out.append("<tr>")
                for _ in range(int(rng.integers(1, 4))):
                    leaf(pick(["td", "th"]), words(1, 6), True)
                out.append("</tr>")
            out.append("</table>")
        elif inside:
            side(pick(["ad", "share", "notice", "aside", "form"]))
    if inside and rng.random() < 0.4:
        side("comments")
    out.append(f"</{tag.split()[0]}>" + ("</main>" if wrapped else ""))
    after = [k for k, p in (("share", 0.2), ("comments", 0.4), ("aside", 0.4), ("ad", 0.3), ("form", 0.2), ("notice",
        0.2)) if rng.random() < p]
    rng.shuffle(after)
    for k in after:
        side(k)
    if rng.random() < 0.85:
        side("footer")
    return "".join(out), labels


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 0) -> Labeller:
    rng = np.random.default_rng(seed)
    made = [make_page(rng) for _ in range(pages)]
    data = [(page_vectors(blocks(p)), np.array(y, np.float32)) for p, y in made]
    data = sorted((d for d in data if len(d[0]) == len(d[1])), key=lambda d: len(d[1]))
    size = INPUT + HIDDEN
    init = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
    params = [init(size, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32), init(size, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32),
        init(2 * HIDDEN + INPUT, 1), np.zeros(1, np.float32)]
    for b in (params[1], params[3]):
        b[HIDDEN : 2 * HIDDEN] = 1
    model = Labeller(params)
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    groups = [data[i : i + 16] for i in range(0, len(data), 16)]
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            z, mask, (x, y, kept1, kept2, both) = model.logits([d[0] for d in groups[k]], True)
            want = np.zeros(mask.shape, np.float32)
            for j, d in enumerate(groups[k]):
                want[: len(d[1]), j] = d[1]
            dz = ((_sigmoid(z[:, :, 0]) - want) * mask / mask.sum())[:, :, None].astype(np.float32)
            dboth = dz @ params[4].T
            d1, e1 = _back(x, params[0], kept1, dboth[:, :, :HIDDEN])
            d2, e2 = _back(y, params[2], kept2, _turned(dboth[:, :, HIDDEN : 2 * HIDDEN], mask))
            grads = [d1, e1, d2, e2, both.reshape(-1, both.shape[2]).T @ dz.reshape(-1, 1), dz.sum((0, 1))]
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return model


def extract(model: Labeller, pages: list[str]) -> list[str]:
    cut = [blocks(p) for p in pages]
    main = model.main([page_vectors(c) for c in cut])
    return [" ".join(t for t, keep in zip(c.texts, m, strict=True) if keep) for c, m in zip(cut, main, strict=True)]


def extract_pages(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model.params)

    def run(batches):
        own = Labeller(sent.value)
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = extract(own, [p or "" for p in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long")


def op1_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), train())
