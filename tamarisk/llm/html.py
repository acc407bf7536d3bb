"""Main text of web pages: a bidirectional LSTM labels every leaf block.

A page becomes a sequence of blocks (text between block-level tags) with their tag path, by a
scanner that reads it once (quotes count only after an equals sign, and what is never closed
swallows nothing but script and style). Each block is a vector: hashed elements, classes and ids of
its path, hashed words, lengths, and how much of the page's text its containers hold. A small LSTM in
numpy reads the sequence in both directions, so that each block is judged with the whole page
around it.

Training (``fit``): a bounded sample of whole pages (``max_pages``, a parameter) is labelled by
``teacher``: by what the markup says where it says something, by the container that holds most
text where it doesn't. The pages are varied: article containers are renamed and further menus,
notices, adverts, side bars and comments are put in, taken from the blocks of other pages. Half
of them are then made *nameless*: telling elements become ``div`` and classes and ids become meaningless, while the
labels stay, so that the network learns the article by structure, text and context as well.

Nulls: a null page is empty and has empty text; a null id or url comes back as it is. Repeated
rows give equal texts. A block whose chance is exactly a half is kept. Very long pages are read whole in time
that grows with their length; elements nested deeper than ``DEEPEST`` keep their text, but not
their names. Columns beyond page_id, url and html are not read, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import map_batches

#: A tag without quotes, the parts of a tag with some, and the named attributes that are kept.
_PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)([^>\"']*)>")
_TAG_NAME, _GAP, _ATTRIBUTE, _EQUALS, _UNQUOTED = map(re.compile, (r"(/?)([a-zA-Z][^\s/>]*)", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Elements that start a block, and elements without content (fixed values of HTML).
BLOCKS = frozenset(
    "html head body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset legend address hr details summary dialog menu select option button textarea label "
    "center".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY_SELF = frozenset("p li dt dd tr td th option".split())
#: Elements whose content is not text of the page; only the first two may end with the page (fixed values of HTML).
_SWALLOWED = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in "script style noscript template iframe title".split()}
_NEVER_CLOSED_TO_END = frozenset(("script", "style"))
#: A drawing ends with its tag, or where an element of the page stands in it.
_SWALLOWED["svg"] = re.compile(rf"</svg(?=[\s/>])|<(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.IGNORECASE)
#: Elements that hold blocks without being part of the running text.
CONTAINERS = frozenset("html body main article section nav aside header footer div form fieldset details dialog menu center".split())
DEEPEST = 256
#: Words in element names, classes and ids that mark what is not the article.
OTHER = frozenset(
    "nav navbar menu header masthead footer aside sidebar side form button select textarea dialog ad ads advert advertisement banner sponsor "
    "sponsored promo cookie cookies consent notice notices alert popup modal comment comments reply replies related share social subscribe "
    "newsletter breadcrumb breadcrumbs pagination pager widget login signup search disqus toc copyright".split()
)
MAIN = frozenset("article main content post entry story maincontent".split())
#: Elements that tell what they hold.
TELLING = frozenset("main article section nav aside header footer form menu dialog".split())
PATH_SLOTS, LEAF_SLOTS, WORD_SLOTS, N_SHAPE = 64, 16, 16, 15
N_IN, N_HIDDEN = PATH_SLOTS + LEAF_SLOTS + WORD_SLOTS + N_SHAPE, 12


class Block(NamedTuple):
    path: tuple[str, ...]  # element names with their classes and ids: div.ad#top
    text: str
    link_chars: int
    ids: tuple[int, ...] = ()  # a number for each element of the path; none where it is not known


class _Scanner:
    """Tags and text of a page from left to right; remembers what does not come any more."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, {}

    def find(self, what: str | re.Pattern, at: int) -> int:
        """Start of the next ``what``, -1 if there is none; a search that failed once is not made again."""
        if what in self.gone:
            return -1
        if isinstance(what, str):
            found = self.page.find(what, at)
        else:
            m = what.search(self.page, at)
            found = m.start() if m else -1
        if found < 0:
            self.gone[what] = True
        return found

    def after(self, what: str, at: int) -> int:
        """Place after the next ``what``, or the end of the page."""
        found = self.find(what, at)
        return found + len(what) if found >= 0 else len(self.page)

    def tag_end(self, at: int) -> int:
        """Place after the tag whose attributes begin at ``at``. A quote that is never closed ends with the tag."""
        page = self.page
        while at < len(page):
            at = _GAP.match(page, at).end()
            if page[at : at + 1] == ">":
                return at + 1
            at = _ATTRIBUTE.match(page, at).end()
            if m := _EQUALS.match(page, at):
                at = m.end()
                quote = page[at : at + 1]
                if quote and quote in "\"'":
                    close = self.find(quote, at + 1)
                    if close < 0:
                        return self.after(">", at)
                    at = close + 1
                else:
                    at = _UNQUOTED.match(page, at).end()
        return len(page)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with white space collapsed and references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    open_names: Counter = Counter()
    parts: list[str] = []
    links = serial = 0

    def flush() -> None:
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(tuple(x for _, x, _ in stack), text, links, tuple(i for *_, i in stack)))
            parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        parts.append(html.unescape(raw) if "&" in raw else raw)
        links += len(raw) if open_names["a"] else 0

    def drop_from(at: int) -> None:
        for name, *_ in stack[at:]:
            open_names[name] -= 1
        del stack[at:]

    scan, at, n = _Scanner(page), 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            say(page[at:start])
        if start == n:
            break
        at = start + 1
        m = _PLAIN_TAG.match(page, at)
        if m:
            end = m.end()
        elif m := _TAG_NAME.match(page, at):
            end = scan.tag_end(m.end())
        else:
            if page.startswith("!--", at):
                at = at + 4 if page.startswith(">", at + 3) else scan.after("-->", at + 1 if page.startswith("!-->", at) else at + 3)
            elif page[at : at + 1] in ("!", "?") or (page[at : at + 1] == "/" and at + 1 < n):
                at = scan.after(">", at)
            else:
                say("<")
            continue
        name, attributes, at = m[2].lower(), page[m.end(2) : end - 1], end
        closed = attributes.endswith("/")
        if name in BLOCKS:
            flush()
        if m[1]:
            if open_names[name] > 0:
                last = len(stack) - 1
                while stack[last][0] != name:
                    last -= 1
                drop_from(last)
        elif name in _SWALLOWED and not (closed and name == "svg"):
            stop = scan.find(_SWALLOWED[name], at)
            if stop >= 0 and page[stop + 1] == "/":
                at = scan.after(">", stop)
            elif stop < 0 and name in _NEVER_CLOSED_TO_END:
                at = n
        elif name in VOID or closed:
            if name == "br":
                parts.append("\n")
        else:
            if name in CLOSED_BY_SELF and open_names[name] > 0:
                drop_from(_closed_from(stack, name))
            if len(stack) < DEEPEST:
                kept = ""
                if "=" in attributes:
                    kept = "".join(f"{'#' if k.lower() == 'id' else '.'}{w.lower()}" for k, *v in _NAMES.findall(attributes) for w in "".join(v).split())
                serial += 1
                stack.append((name, name + kept, serial))
                open_names[name] += 1
    flush()
    return out


def _closed_from(stack: list[tuple[str, str, int]], name: str) -> int:
    """An element that can't contain itself ends the one that is open, within its list, table or section."""
    for at in range(len(stack) - 1, -1, -1):
        tag = stack[at][0]
        if tag == name:
            return at
        if tag in BLOCKS and tag not in CLOSED_BY_SELF:
            break
    return len(stack)


def tag_of(element: str) -> str:
    return re.split(r"[.#]", element, maxsplit=1)[0]


def containers(block: Block) -> list[int]:
    """Places in the block's path of the elements that hold blocks, outermost first."""
    return [i for i, element in enumerate(block.path) if tag_of(element) in CONTAINERS]


def held_words(page: list[Block]) -> tuple[list[list], list[int], Counter, Counter]:
    """For each block the keys of its containers and its words; for each container the words and blocks directly in it."""
    keys = [[b.ids[i] if b.ids else b.path[: i + 1] for i in containers(b)] or [()] for b in page]
    sizes = [len(b.text.split()) for b in page]
    words, counts = Counter(), Counter()
    for own, size in zip(keys, sizes, strict=True):
        words[own[-1]] += size
        counts[own[-1]] += 1
    return keys, sizes, words, counts


def names_in(path: tuple[str, ...]) -> list[str]:
    return [w for element in path for w in re.split(r"[.#_-]+", element) if w]


def teacher(page: list[Block]) -> list[int]:
    """1 for blocks in the article: where the markup names it, there; else in the container with most text outside links."""
    names = [set(names_in(b.path)) for b in page]
    if any(MAIN & own for own in names):
        return [int(not OTHER & own and bool(MAIN & own)) for own in names]
    keys = held_words(page)[0]
    held = Counter()
    for own, b, said in zip(keys, page, names, strict=True):
        if not OTHER & said:
            held[own[-1]] += max(0, len(b.text) - 2 * b.link_chars)
    best = max(held, key=lambda k: (held[k], str(k)), default=None)
    return [int(not OTHER & said and best in own and 2 * b.link_chars < len(b.text)) for own, b, said in zip(keys, page, names, strict=True)]


_path_vectors: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _path_vectors:
        if len(_path_vectors) > 50_000:
            _path_vectors.clear()
        v = np.zeros(PATH_SLOTS + LEAF_SLOTS, np.float32)
        for name in names_in(path):
            v[crc32(name.encode("utf-8", "replace")) % PATH_SLOTS] = 1
            v[crc32(b"~" + name.encode("utf-8", "replace")) % PATH_SLOTS] = 1
        if path:
            v[PATH_SLOTS + crc32(tag_of(path[-1]).encode("utf-8", "replace")) % LEAF_SLOTS] = 1
        _path_vectors[path] = v
    return _path_vectors[path]


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), N_IN), np.float32)
    low = PATH_SLOTS + LEAF_SLOTS
    keys, sizes, words, counts = held_words(page)
    total, most = max(1, sum(sizes)), max(words.values(), default=1)
    for i, b in enumerate(page):
        coded = b.text.encode("utf-8", "replace").split()
        out[i, :low] = path_vector(b.path)
        out[i, low : low + WORD_SLOTS] = np.bincount([crc32(w) % WORD_SLOTS for w in coded], minlength=WORD_SLOTS) / len(coded)
        own = keys[i]
        inner, outer = own[-1], own[-2] if len(own) > 1 else own[-1]
        out[i, low + WORD_SLOTS :] = (
            1, np.log1p(len(coded)) / 5, min(1, b.link_chars / max(1, len(b.text))), b.text[-1] in ".?!", i / len(page),
            words[inner] / total, words[inner] / most, words[outer] / total, words[outer] / most, np.log1p(counts[inner]) / 4,
            np.log1p(words[inner] / counts[inner]) / 5, i > 0 and keys[i - 1][-1] == inner, i + 1 < len(page) and keys[i + 1][-1] == inner,
            len(own) / 5, 2 * len(coded) / total,
        )
    return out


class Lstm(NamedTuple):
    """Weights of both directions, stacked: input, recurrent, bias; and of the output."""

    w: np.ndarray  # 2 x N_IN x 4H
    u: np.ndarray  # 2 x H x 4H
    b: np.ndarray  # 2 x 4H
    out: np.ndarray  # 2H + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(model: Lstm, d: int, x: np.ndarray, mask: np.ndarray, keep: bool):
    """One direction over time-major input; hidden states, and what back-propagation needs."""
    t_max, n, _ = x.shape
    h, c = np.zeros((n, N_HIDDEN), model.w.dtype), np.zeros((n, N_HIDDEN), model.w.dtype)
    hs = np.zeros((t_max, n, N_HIDDEN), model.w.dtype)
    kept = []
    z = x @ model.w[d] + model.b[d]
    for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
        g = z[t] + h @ model.u[d]
        gates = _sigmoid(g[:, : 3 * N_HIDDEN])
        i, f, o = np.split(gates, 3, axis=1)
        new = np.tanh(g[:, 3 * N_HIDDEN :])
        m = mask[t][:, None]
        c_next = f * c + i * new
        tanh_c = np.tanh(c_next)
        if keep:
            kept.append((t, h, c, i, f, o, new, tanh_c, m))
        c = np.where(m, c_next, c)
        h = np.where(m, o * tanh_c, h)
        hs[t] = h
    return hs, kept


def predict(model: Lstm, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probabilities of all blocks; pages of like length are run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        group = order[at : at + 256]
        while len(group) > 1 and len(group) * len(pages[group[-1]]) > 60_000:
            group = group[: len(group) // 2]
        at += len(group)
        x, mask = _pad([pages[i] for i in group])
        hs = np.concatenate([_run(model, d, x, mask, False)[0] for d in (0, 1)], axis=2)
        p = _sigmoid(hs @ model.out[:-1] + model.out[-1])
        for j, i in enumerate(group):
            out[i] = p[: len(pages[i]), j]
    return out


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), N_IN), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, True
    return x, mask


def loss(model: Lstm, x: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> float:
    """Mean negative log-likelihood of the labels."""
    hs = np.concatenate([_run(model, d, x, mask, False)[0] for d in (0, 1)], axis=2)
    p = _sigmoid(hs @ model.out[:-1] + model.out[-1])
    return float(-(np.log(np.where(gold > 0, p, 1 - p)) * mask).sum() / mask.sum())


def gradients(model: Lstm, x: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> list[np.ndarray]:
    """Gradients of the loss for all weights, by back-propagation through time."""
    runs = [_run(model, d, x, mask, True) for d in (0, 1)]
    hs = np.concatenate([r[0] for r in runs], axis=2)
    error = (_sigmoid(hs @ model.out[:-1] + model.out[-1]) - gold) * mask / mask.sum()
    grads = [np.zeros_like(p) for p in model]
    grads[3][:-1], grads[3][-1] = np.einsum("tn,tnh->h", error, hs), error.sum()
    for d in (0, 1):
        from_out = error[:, :, None] * model.out[d * N_HIDDEN : (d + 1) * N_HIDDEN]
        dh = dc = np.zeros((x.shape[1], N_HIDDEN), model.w.dtype)
        for t, h, c, i, f, o, new, tanh_c, m in reversed(runs[d][1]):
            dh_all = dh + from_out[t]
            d_h, d_c = np.where(m, dh_all, 0), np.where(m, dc, 0)
            d_c = d_c + d_h * o * (1 - tanh_c**2)
            dg = np.concatenate([d_c * new * i * (1 - i), d_c * c * f * (1 - f), d_h * tanh_c * o * (1 - o), d_c * i * (1 - new**2)], axis=1)
            grads[0][d] += x[t].T @ dg
            grads[1][d] += h.T @ dg
            grads[2][d] += dg.sum(0)
            dh = np.where(m, dg @ model.u[d].T, dh_all)
            dc = np.where(m, d_c * f, dc)
    return grads


def train(pages: list[np.ndarray], labels: list[list[int]], rounds: int = 20, rate: float = 0.03, seed: int = 7) -> Lstm:
    rng = np.random.default_rng(seed)
    model = Lstm(
        rng.normal(0, 0.15, (2, N_IN, 4 * N_HIDDEN)).astype(np.float32), rng.normal(0, 0.15, (2, N_HIDDEN, 4 * N_HIDDEN)).astype(np.float32),
        np.zeros((2, 4 * N_HIDDEN), np.float32), rng.normal(0, 0.15, 2 * N_HIDDEN + 1).astype(np.float32),
    )
    kept = [i for i in range(len(pages)) if len(pages[i])]
    moments = [[np.zeros_like(p) for p in model] for _ in range(2)]
    step = 0
    for _ in range(rounds if kept else 0):
        # Pages of like length go together, as all walk to the end of the longest.
        kept.sort(key=lambda i: len(pages[i]) * rng.uniform(0.8, 1.25))
        for low in rng.permutation(range(0, len(kept), 64)):
            group = kept[low : low + 64]
            x, mask = _pad([pages[i] for i in group])
            gold = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(group):
                gold[: len(pages[i]), j] = labels[i]
            grads = gradients(model, x, mask, gold)
            step += 1
            for p, g, a, b in zip(model, grads, *moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


#: Markup that varied pages get around blocks that are not the article.
VARIED = (
    ("div.sidebar", "p"), ("aside", "p"), ("div.notice", "p"), ("div.cookie", "p"), ("form", "label"), ("form", "button"), ("header", "p"),
    ("header", "h1"), ("div.comments", "div.comment", "p"), ("section#comments", "p"), ("div.ad",), ("div.advert", "p"), ("nav", "ul", "li", "a"),
    ("footer", "p"), ("ul.menu", "li"), ("div.related", "ul", "li"), ("div#footer",), ("div#header", "p"), ("aside.sidebar", "ul", "li"),
    ("nav", "a"), ("nav", "p", "a"), ("div.menu", "a"), ("div.banner",), ("div.popup", "p"), ("section.comments", "article.comment", "p"), ("div.newsletter", "form", "p"),
)


def varied(page: list[Block], other: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page with a renamed container and with blocks of another page put in as non-article parts."""
    labels = teacher(page)
    rename = (("article", x) for x in (["article"], ["main"], ["div.content"], ["main", "article"], ["div.post"], ["div#main", "article.post"]))
    old, new = list(rename)[rng.integers(6)]

    def renamed(b: Block) -> Block:
        pairs = [(y, 4 * i + j) for x, i in zip(b.path, b.ids, strict=True) for j, y in enumerate(new if tag_of(x) == old else [x])]
        return b._replace(path=tuple(y for y, _ in pairs), ids=tuple(i for _, i in pairs))

    page = [renamed(b) for b in page]
    within = next((b for b, y in zip(page, labels, strict=True) if y), None)
    fresh = 1 << 30
    for _ in range(rng.integers(0, 4)):
        if other:
            inside = containers(within)[-1] + 1 if within and rng.random() < 0.3 else 0
            choice = [x for x in VARIED if not inside or x[0] != "header"]  # a header within the article is its own
            path = choice[rng.integers(len(choice))]
            around = (within.path[:inside], within.ids[:inside]) if inside else (("html", "body"), (fresh, fresh + 1))
            n = int(rng.integers(1, 4))
            start = int(rng.integers(len(other)))
            at = int(rng.integers(len(page) + 1))
            # One container of its own for all that is added; what is no container in it is new for each block.
            added = []
            for k, b in enumerate(other[start : start + n]):
                ids = tuple(fresh + 10 + i + (0 if tag_of(x) in CONTAINERS else 10 * (k + 1)) for i, x in enumerate(path))
                added.append(Block((*around[0], *path), b.text, len(b.text) if path[-1] == "a" else 0, (*around[1], *ids)))
            fresh += 1000
            page, labels = page[:at] + added + page[at:], labels[:at] + [0] * len(added) + labels[at:]
    return page, labels


#: Markup that blocks of an article get in varied pages, and how many words of them are kept at most.
FORMS = (
    (("ul", "li"), 30), (("ul", "li"), 12), (("ol", "li"), 20), (("blockquote", "p"), 60), (("blockquote",), 40), (("table", "tr", "td"), 10), (("pre",), 40),
    (("h2",), 8), (("h3",), 6), (("figure", "figcaption"), 15), (("dl", "dd"), 25), (("section", "p"), 60), (("div", "p"), 60), (("p",), 10),
)


def reshaped(page: list[Block], labels: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page with other forms of text in its article: lists, tables, quotations, headings, an inner header, few blocks. Labels stay."""
    inside = [i for i, y in enumerate(labels) if y]
    if not inside:
        return page, labels
    page, gone = list(page), set()
    fresh = 1 << 40
    leaf = len(containers(page[inside[0]]))
    if rng.random() < 0.3:  # a short article
        gone = set(inside[int(rng.integers(2, 5)) :])
    for _ in range(rng.integers(0, 4)):
        form, most = FORMS[rng.integers(len(FORMS))]
        at = int(rng.integers(len(inside)))
        fresh += 1000
        for k, i in enumerate(inside[at : at + int(rng.integers(1, 5))]):
            b = page[i]
            depth = containers(b)[-1] + 1
            if depth > len(b.ids):
                continue
            words = b.text.split()
            text = " ".join(words[: max(1, min(most, len(words)))]) if rng.random() < 0.7 else b.text
            ids = tuple(fresh + j + (0 if j + 1 < len(form) else 10 * (k + 1)) for j in range(len(form)))
            page[i] = Block((*b.path[:depth], *form), text, min(b.link_chars, len(text)) // 2, (*b.ids[:depth], *ids))
    if rng.random() < 0.4:  # the title, and perhaps who wrote it, in a header of the article
        for k, i in enumerate(inside[: int(rng.integers(1, 4))]):
            b = page[i]
            depth = containers(b)[-1] + 1
            tag = ("h1", "p", "p.byline")[k] if leaf and rng.random() < 0.8 else "p"
            text = " ".join(b.text.split()[: int(rng.integers(3, 12))])
            page[i] = Block((*b.path[:depth], "header", tag), text, 0, (*b.ids[:depth], fresh + 500, fresh + 501 + k))
    kept = [i for i in range(len(page)) if i not in gone]
    return [page[i] for i in kept], [labels[i] for i in kept]


def nameless(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with telling elements as ``div`` and with meaningless classes and ids or none."""
    seed, how = int(rng.integers(1 << 30)), int(rng.integers(3))

    def hidden(element: str) -> str:
        tag, names = tag_of(element), re.split(r"[.#]", element)[1:]
        tag = "div" if tag in TELLING else tag
        if how == 0 or (how == 1 and not names and tag not in CONTAINERS):
            return tag
        return f"{tag}.x{crc32(f'{seed} {element}'.encode('utf-8', 'replace')) % 997}"

    return [b._replace(path=tuple(map(hidden, b.path))) for b in page]


def fit(pages: DataFrame, max_pages: int = 250) -> Lstm:
    """Train on at most ``max_pages`` whole pages, chosen by digest; the driver holds so many pages at a time."""
    lots = pages.where(F.col("html") != "").select("html", F.xxhash64("page_id", "url").alias("lot"))
    # The lots alone are sorted first, so that no task sends pages that aren't chosen.
    chosen = lots.select("lot").orderBy("lot").limit(max_pages).agg(F.max("lot")).first()[0]
    sample = lots.where(F.col("lot") <= chosen).orderBy("lot", "html").limit(max_pages).toLocalIterator() if chosen is not None else []
    rng = np.random.default_rng(3)
    plain = [blocks(r["html"]) for r in sample]
    both = []
    for p in plain:
        both.append((p, teacher(p)))
        for hide, reshape in ((False, False), (False, True), (True, False), (True, True)):
            one, labels = varied(p, plain[int(rng.integers(len(plain)))], rng)
            if reshape:
                one, labels = reshaped(one, labels, rng)
            both.append((nameless(one, rng) if hide else one, labels))
    return train([vectors(p) for p, _ in both], [y for _, y in both])


def extract(pages: DataFrame, model: Lstm, with_blocks: bool = False) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page (and all blocks with their probabilities)."""
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    if with_blocks:
        schema += ", blocks array<struct<path: string, text: string, p: double>>"

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.iloc[low : low + 1000]
                cut_up = [blocks(page or "") for page in batch["html"]]
                chances = predict(model, [vectors(p) for p in cut_up])
                texts = ["\n".join(b.text for b, p in zip(page, ps, strict=True) if p >= 0.5) for page, ps in zip(cut_up, chances, strict=True)]
                out = pd.DataFrame({"page_id": batch["page_id"].values, "url": batch["url"].values, "text": texts, "n_chars": list(map(len, texts))})
                if with_blocks:
                    out["blocks"] = [
                        [{"path": ">".join(b.path), "text": b.text, "p": float(p)} for b, p in zip(page, ps, strict=True)]
                        for page, ps in zip(cut_up, chances, strict=True)
                    ]
                yield out

    return map_batches(pages.select("page_id", "url", "html"), label, schema)
