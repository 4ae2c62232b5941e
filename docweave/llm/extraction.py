"""Main text of HTML pages by a recurrent block labeller.

A page becomes a sequence of blocks: runs of text between block-level tags, each with its tag path (ancestor tags and the parts of
their class, id and role) and its words. A bidirectional LSTM in numpy reads path and hashed-word vectors of the whole sequence,
so that every block is judged in the page's context, and keeps or drops each block.

No page comes labelled. The labeller is therefore fitted on the driver to pages that :func:`compose` puts together from the
blocks of at most about ``most_pages`` real pages (the bound is that parameter): articles between menus, headers, footers,
sidebars, notices, adverts, forms and comments in many arrangements, where each block's label is known by construction.

Defined cases: null or empty html, and pages without kept blocks, give the empty text; markup may be broken (unclosed or stray tags,
``>`` in quoted attributes, tags in script strings): a ``<`` that no ``>`` follows is text, and after the first quote that stays open quotes
count no more on that page; very long pages, deep nesting and many blocks take time and memory in proportion to the page; without
any page to learn from only arrangements with stock words are composed; repeated rows give equal texts; an empty table
gives an empty result; extra columns are left alone, and ``text`` and ``n_chars`` replace columns of these names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .staging import unpacked
from .words import Words, per_text, pieces

#: Fixed values of HTML: inline tags (text goes on across them), tags without content, and tags whose text is never shown.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title textarea iframe select head annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: What may stand in a head; other start tags and text end it, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag of the key ends an open element of the value.
CLOSES = {"p": "p", "li": "li", "td": "td", "th": "td", "tr": "tr", "option": "option", "dt": "dd", "dd": "dd"}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The rest of a tag: attributes with quoted values up to the closing sign; without backing up, so that a failure costs one pass.
_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
PATH_BITS, WORD_BITS = 12, 11


def slot(token: str, bits: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) * 2654435761 % (1 << 32) >> (32 - bits)


def element(tag: str, attributes: str, known: dict) -> tuple:
    """Slots of a tag and of the words in its class, id and role."""
    key = (tag, attributes)
    if key in known:
        return known[key]
    names = (a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ()
    out = (slot(tag, PATH_BITS), *(slot("." + w.lower(), PATH_BITS) for n in names for w in _PARTS.findall(n)))
    if len(attributes) < 200:
        if len(known) > 50_000:
            known.clear()
        known[key] = out
    return out


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag or "" with "/" first if it ends an element, attributes) in page order; comments and the like end the text before them.

    One pass: every search either moves on or is not tried again."""
    at, strict, cdata, last = 0, True, True, html.rfind(">")
    begin = 0
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            yield html[begin:at], "", ""
            at = begin = end + 3 if end >= 0 else len(html)
            continue
        if cdata and html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            if end >= 0:
                yield html[begin:at], "", ""
                yield html[at + 9 : end].replace("&", "&amp;"), "", ""
                at = begin = end + 3
                continue
            cdata = False
        if at > last:
            break
        name = _NAME.match(html, at + 1)
        if name is None:
            if html[at + 1] not in "!?":
                at += 1
                continue
            yield html[begin:at], "", ""
            at = begin = html.find(">", at) + 1
            continue
        rest = _REST.match(html, name.end()) if strict else None
        if rest is None:
            strict = False
        end = rest.end() if rest else html.find(">", name.end()) + 1
        yield html[begin:at], name[0].lower(), html[name.end() : end - 1]
        at = begin = end
        tag = name[0].lower()
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(html, at)
            end = html.find(">", close.end()) if close else -1
            at = begin = end + 1 if end >= 0 else len(html)
    yield html[begin:], "", ""


def scan(html: str, known: dict) -> tuple[list[tuple[str, int, float]], list[int]]:
    """Blocks (text, place in the steps, share of linked characters) of a page that hold text, and the steps: every slot + 1 that the tag
    path gains, negative where it loses it. A block's path is the sum of the steps before its place."""
    out: list[tuple[str, int, float]] = []
    steps: list[int] = []
    stack: list[tuple[str, tuple, int]] = []  # tag, slots, and where the nearest element that is not inline stands
    opened: Counter = Counter()
    text: list[str] = []
    linked = links = hidden = 0

    def flush() -> None:
        nonlocal linked
        if text:
            s = " ".join(unescape("".join(text)).split())
            if s:
                out.append((s, len(steps), min(1.0, linked / len(s))))
            text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links, hidden
        for tag, slots, _ in stack[to:]:
            opened[tag] -= 1
            links -= tag == "a"
            hidden -= tag in HIDDEN
            if tag not in INLINE:
                steps.extend(-x - 1 for x in slots)
        del stack[to:]

    def top() -> str:
        return stack[-1][0] if stack else ""

    for before, name, attributes in tokens(html):
        if before:
            if top() == "head" and before.strip():
                pop(len(stack) - 1)
            if not hidden:
                text.append(before)
                if links:
                    linked += len(before)
        if not name:
            continue
        tag = name.lstrip("/")
        if tag not in INLINE:
            flush()
        if name[0] == "/":
            if opened[tag]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if top() == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag in CLOSES:
            if opened[tag] or opened[CLOSES[tag]]:
                i = stack[-1][2]
                while i >= 0 and stack[i][0] == "p" != tag:
                    i = stack[i - 1][2] if i else -1
                if i >= 0 and stack[i][0] in (tag, CLOSES[tag]):
                    pop(i)
        elif tag not in INLINE and tag not in VOID and stack and stack[-1][2] >= len(stack) - 4 and stack[stack[-1][2]][0] == "p":
            pop(stack[-1][2])  # a block ends an open paragraph
        if tag not in VOID and tag not in RAW:
            if tag == "body":
                pop(0)
            slots = element(tag, attributes, known)
            if tag not in INLINE:
                steps.extend(x + 1 for x in slots)
            stack.append((tag, slots, len(stack) if tag not in INLINE else stack[-1][2] if stack else -1))
            opened[tag] += 1
            links += tag == "a"
            hidden += tag in HIDDEN
    flush()
    return out, steps


def blocks(html: str, known: dict) -> list[tuple[str, tuple, float]]:
    """(text, path slots, share of linked characters) of each block of a page that holds text; for pages of little depth."""
    found, steps = scan(html, known)
    out, path, at = [], Counter(), 0
    for text, place, share in found:
        for x in steps[at:place]:
            path[abs(x) - 1] += 1 if x > 0 else -1
        at = place
        out.append((text, tuple(path.elements()), share))
    return out


# Pages with known labels. KEEP and DROP mark blocks in composed pages; both are private-use characters.
KEEP, DROP = "\ue000", "\ue001"
#: Common names of page parts in class and id attributes.
NAMES = {
    "main": "content main-content article-body post-content entry-content story body-text post entry page-content text primary prose article__body blog-post single".split(),
    "menu": "menu nav navbar navigation main-menu topnav nav-links breadcrumb breadcrumbs pagination pager tabs toc skip-links site-nav".split(),
    "header": "header site-header masthead top-bar branding page-header logo banner-top tagline".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal footer-links credits".split(),
    "side": "sidebar side aside widget widget-area related related-posts recommended popular most-read trending tags author-box share social-share promo-box teaser".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall announcement toast".split(),
    "ad": "ad ads advert advertisement ad-slot sponsored sponsor banner promo promotion adsbygoogle commercial outbrain partner".split(),
    "form": "form search search-form login contact-form signup-form feedback poll survey".split(),
    "comments": "comments comment comment-list comment-body replies reply discussion disqus respond user-comments responses thread".split(),
}


def compose(rng: np.random.Generator, texts: list[list[str]]) -> str:
    """A page of random arrangement whose blocks start with KEEP or DROP."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    chance = lambda p: rng.random() < p
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def words(lo: int, hi: int) -> str:
        w, n = pick(texts), int(rng.integers(lo, hi + 1))
        i = int(rng.integers(max(1, len(w) - n + 1)))
        return escape(" ".join(w[i : i + n]))

    def named(kind: str) -> str:
        name = pick(NAMES[kind])
        return f' {pick(["class", "class", "id"])}="{name}{pick(["", "", "", " box", "-1", "-wrapper", " clearfix"])}"'

    def item(mark: str, tag: str, lo: int, hi: int) -> str:
        body = mark + words(lo, hi)
        return f"<{tag}>{body}</{tag}>" if tag != "p" or chance(0.8) else f"<p>{pick(['<b>', ''])}{body}<br>"

    def links(mark: str) -> str:
        each = lambda: f'<li><a href="/x">{mark}{words(1, 4)}</a></li>'
        if chance(0.25):
            return "".join(f'<a href="/x">{mark}{words(1, 3)}</a> | ' if k else f'<a href="/x">{mark}{words(1, 3)}</a> ' for k in range(rng.integers(2, 6)))
        return "<ul>" + "".join(each() for _ in range(rng.integers(2, 8))) + "</ul>"

    def noise(kind: str) -> str:
        tag = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section", "aside", "dialog"], "ad": ["div", "div", "aside", "section", "ins"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol"]}[kind]
        tag = pick(tag)
        bare = tag in ("nav", "header", "footer", "aside", "form", "dialog") and chance(0.6)
        head = f"<{tag}{'' if bare else named(kind)}>"
        if kind == "menu":
            body = links(DROP) if tag != "ul" else "".join(f'<li><a href="/x">{DROP}{words(1, 3)}</a></li>' for _ in range(rng.integers(2, 8)))
        elif kind == "header":
            body = pick(["", f'<a href="/">{DROP}{words(1, 4)}</a>']) + item(DROP, pick(["h1", "h2", "p", "div", "span"]), 1, 8) + pick(["", "<nav>" + links(DROP) + "</nav>"])
        elif kind == "footer":
            body = pick(["", "<p>"]) + DROP + pick(["&copy; ", "&#169; 2024 ", ""]) + words(1, 12) + pick([" &middot; ", " | ", ""]) + words(0, 8) + pick(["", "<nav>" + links(DROP) + "</nav>", links(DROP)])
        elif kind == "side":
            body = pick(["", item(DROP, pick(["h2", "h3", "h4"]), 1, 5)]) + pick([links(DROP), item(DROP, "p", 3, 40), item(DROP, "div", 2, 30) + item(DROP, "p", 3, 30)])
        elif kind == "form":
            body = f"<label>{DROP}{words(1, 4)}</label> <input type=text placeholder='x'>" + pick(["", item(DROP, "p", 2, 12)]) + f"<button>{DROP}{words(1, 3)}</button>" + pick(["", "<select><option>" + words(1, 3) + "<option>" + words(1, 3) + "</select>"])
        elif kind == "comments":
            inner = pick(["li", "div", "article"]) if tag != "ol" else "li"
            one = lambda: f"<{inner}{pick(['', named('comments')])}>" + pick(["", f"<h4>{DROP}{words(1, 3)}</h4>", f"<span>{DROP}{words(1, 3)}</span>"]) + item(DROP, "p", 3, 60) + pick(["", f'<a href="#r">{DROP}{words(1, 1)}</a>']) + f"</{inner}>"
            body = pick(["", item(DROP, "h3", 1, 4)]) + "".join(one() for _ in range(rng.integers(1, 5)))
        else:
            body = pick([DROP + words(2, 30), item(DROP, "p", 2, 40), item(DROP, "p", 2, 25) + f"<button>{DROP}{words(1, 2)}</button>", f'<a href="/x">{DROP}{words(1, 8)}</a>'])
        return head + body + ("" if tag == "ins" and chance(0.1) else f"</{tag}>")

    def article() -> str:
        tag = pick(["article", "article", "article", "main", "div", "section"])
        head = f"<{tag}{'' if tag in ('article', 'main') and chance(0.7) else named('main')}>"
        parts = [item(KEEP, "h1", 2, 12)] if chance(0.85) else []
        if chance(0.2):
            parts = [f"<header>{''.join(parts)}{item(KEEP, 'p', 3, 12) if chance(0.4) else ''}</header>"] if parts else parts
        for _ in range(rng.integers(0, 9)):
            r = rng.random()
            if r < 0.7:
                parts.append(item(KEEP, "p", 1, 120) if chance(0.9) else f'<p>{KEEP}{words(3, 20)} <a href="/y">{words(1, 4)}</a> {words(2, 20)}</p>')
            elif r < 0.76:
                parts.append(item(KEEP, pick(["h2", "h3"]), 1, 8))
            elif r < 0.82:
                kind = pick(["ul", "ol"])
                parts.append(f"<{kind}>" + "".join(item(KEEP, "li", 1, 25) for _ in range(rng.integers(2, 6))) + f"</{kind}>")
            elif r < 0.86:
                parts.append("<table>" + "".join("<tr>" + item(KEEP, "td", 1, 6) + item(KEEP, "td", 1, 6) + "</tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            elif r < 0.90:
                parts.append(pick([f"<blockquote>{item(KEEP, 'p', 3, 40)}</blockquote>", item(KEEP, "pre", 3, 30), f"<figure><img src=x>{item(KEEP, 'figcaption', 2, 12)}</figure>", f"<div>{item(KEEP, 'p', 3, 60)}</div>", f"<section>{item(KEEP, 'h2', 1, 6)}{item(KEEP, 'p', 3, 60)}</section>"]))
            else:
                parts.append(noise(pick(["ad", "side", "form", "notice", "menu"])))
        if chance(0.15):
            parts.append(noise("comments"))
        return head + "".join(parts) + f"</{tag}>"

    before = [noise(pick(["menu", "header", "ad", "notice", "form", "side"])) for _ in range(rng.integers(0, 4))]
    after = [noise(pick(["side", "ad", "comments", "form", "menu", "notice"])) for _ in range(rng.integers(0, 4))]
    middle = article()
    if chance(0.3):
        wrap = pick(["div", "main", "section"])
        middle = f"<{wrap}{pick(['', ' class=container', ' id=page', ' class=row', ' class=wrapper'])}>" + middle + (noise("side") if chance(0.4) else "") + f"</{wrap}>"
    body = (["<nav>" + links(DROP) + "</nav>"] if chance(0.5) else []) + before + [middle] + after + ([noise("footer")] if chance(0.85) else [])
    return "<html><head><title>x</title></head><body>" + "".join(body) + pick(["</body></html>", ""])


HID, PATH_DIM, WORD_DIM = 16, 24, 8
#: Cells (pages times blocks) that are labelled at a time; a page with more blocks is taken alone.
CELLS = 1 << 14
WIDE = PATH_DIM + WORD_DIM + 4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def packed(pages: list[list[tuple]], steps_of: list[list[int]] | None = None) -> dict:
    """A batch of pages, padded to the longest: slots of paths and words with the cell (page, block) of each, and four numbers a cell.

    Blocks hold their paths; with ``steps_of``, places in the steps of their pages."""
    n, steps = len(pages), max(map(len, pages))
    sizes = np.array([len(p) for p in pages])
    within = np.concatenate([np.arange(k) for k in sizes])
    cell = np.repeat(np.arange(n) * steps, sizes) + within
    texts, paths, linked = zip(*(b for p in pages for b in p))
    w = Words(pa.array(texts, pa.string()), lower=True)
    count = np.maximum(1, w.counts())
    if steps_of is None:
        ids = np.fromiter(chain.from_iterable(paths), np.int64)
        path = ids, np.repeat(cell, [len(p) for p in paths]), np.ones(len(ids), np.float32)
    else:
        begin = np.cumsum([0, *map(len, steps_of)])[:-1]
        path = np.fromiter(chain.from_iterable(steps_of), np.int64), cell, np.repeat(begin, sizes), np.array(paths)
    word = (w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), cell[w.text_of_word()]
    long = np.diff(w.offsets)
    numbers = np.zeros((n * steps, 4), np.float32)
    numbers[cell] = np.stack([np.log1p(long) / 5, np.array(linked), (within + 1) / np.repeat(sizes, sizes), per_text(_STOPS[w.raw], w.offsets) / (1 + long) * 10], 1)
    mask = np.zeros(n * steps, np.float32)
    mask[cell] = 1
    return {
        "shape": (n, steps), "numbers": numbers.reshape(n, steps, 4), "mask": mask.reshape(n, steps),
        "path": path, "word": (*word, np.repeat(1 / count, w.counts()).astype(np.float32)),
    }


@dataclass
class Labeller:
    p: dict

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        p = {"path": rng.normal(0, 0.3, (1 << PATH_BITS, PATH_DIM)), "word": rng.normal(0, 0.1, (1 << WORD_BITS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HID), "out0": np.zeros(1)}
        for d in ("f", "b"):
            p[d] = rng.normal(0, (WIDE + HID) ** -0.5, (WIDE + HID, 4 * HID))
            p[d + "0"] = np.concatenate([np.zeros(HID), np.ones(HID), np.zeros(2 * HID)])  # forget gates start open
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, b: dict) -> np.ndarray:
        n, steps = b["shape"]
        x = np.zeros((n * steps, WIDE), np.float32)
        for name, lo, dim in (("path", 0, PATH_DIM), ("word", PATH_DIM, WORD_DIM)):
            if len(b[name]) == 4:  # sums of steps before a block, less those before its page
                ids, cells, begin, place = b[name]
                total = np.zeros((len(ids) + 1, dim))
                np.cumsum(self.p[name][np.abs(ids) - 1] * np.sign(ids)[:, None], axis=0, out=total[1:])
                x[cells, lo : lo + dim] = total[begin + place] - total[begin]
                continue
            ids, cells, w = b[name]
            if not len(ids):
                continue
            begin = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            x[cells[begin], lo : lo + dim] = np.add.reduceat(self.p[name][ids] * w[:, None], begin)
        x[:, -4:] = b["numbers"].reshape(-1, 4)
        return x.reshape(n, steps, WIDE)

    def forward(self, b: dict, traced: bool = True) -> tuple[np.ndarray, dict]:
        """Scores of all cells, and what :meth:`gradients` needs if ``traced``."""
        x, mask = self.inputs(b), b["mask"]
        n, steps = mask.shape
        trace, outs = {"x": x}, {}
        for d in ("f", "b"):
            w, h, c = self.p[d], np.zeros((n, HID), np.float32), np.zeros((n, HID), np.float32)
            pre = x.reshape(-1, WIDE) @ w[:WIDE] + self.p[d + "0"]
            pre, hs, log = pre.reshape(n, steps, -1), np.zeros((n, steps, HID), np.float32), []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z = pre[:, t] + h @ w[WIDE:]
                g = sigmoid(z[:, : 3 * HID])
                i, f, o, u = g[:, :HID], g[:, HID : 2 * HID], g[:, 2 * HID :], np.tanh(z[:, 3 * HID :])
                m = mask[:, t, None]
                new = f * c + i * u
                tc = np.tanh(new)
                if traced:
                    log.append((t, i, f, o, u, c, tc, h, m))
                c, h = m * new + (1 - m) * c, m * (o * tc) + (1 - m) * h
                hs[:, t] = h
            outs[d], trace[d] = hs, log
        both = np.concatenate([outs["f"], outs["b"]], 2)
        trace["both"] = both
        return both @ self.p["out"] + self.p["out0"], trace

    def gradients(self, b: dict, y: np.ndarray) -> dict:
        z, trace = self.forward(b)
        mask, x = b["mask"], trace["x"]
        n, steps = mask.shape
        d = (sigmoid(z) - y) * mask / mask.sum()
        g = {"out": np.einsum("nt,nth->h", d, trace["both"]), "out0": np.array([d.sum()])}
        back, dx = d[..., None] * self.p["out"], np.zeros_like(x)
        for k, name in enumerate(("f", "b")):
            w = self.p[name]
            dw, db = np.zeros_like(w), np.zeros(4 * HID, np.float32)
            dh, dc = np.zeros((n, HID), np.float32), np.zeros((n, HID), np.float32)
            for t, i, f, o, u, c, tc, h, m in reversed(trace[name]):
                dh = dh + back[:, t, k * HID : (k + 1) * HID]
                own = dh * m
                dn = dc * m + own * o * (1 - tc**2)
                dz = np.concatenate([dn * u * i * (1 - i), dn * c * f * (1 - f), own * tc * o * (1 - o), dn * i * (1 - u**2)], 1)
                dw[:WIDE] += x[:, t].T @ dz
                dw[WIDE:] += h.T @ dz
                db += dz.sum(0)
                dx[:, t] += dz @ w[:WIDE].T
                dh, dc = dz @ w[WIDE:].T + dh * (1 - m), dn * f + dc * (1 - m)
            g[name], g[name + "0"] = dw, db
        dx = dx.reshape(-1, WIDE)
        for name, lo, dim in (("path", 0, PATH_DIM), ("word", PATH_DIM, WORD_DIM)):
            ids, cells, w = b[name]
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], ids, dx[cells, lo : lo + dim] * w[:, None])
        return g

    def keep(self, scans: list[tuple[list, list]]) -> list[np.ndarray]:
        """Which blocks of each page to keep; pages of like length are taken together, in batches of bounded cells and steps."""
        out: list = [np.zeros(0, bool)] * len(scans)
        part: list[int] = []
        steps = 0

        def judge() -> None:
            z, _ = self.forward(packed([scans[i][0] for i in part], [scans[i][1] for i in part]), traced=False)
            for row, i in enumerate(part):
                out[i] = z[row, : len(scans[i][0])] > 0

        for i in sorted((i for i in range(len(scans)) if scans[i][0]), key=lambda i: len(scans[i][0])):
            if part and ((len(part) + 1) * len(scans[i][0]) > CELLS or steps + len(scans[i][1]) > 4 * CELLS):
                judge()
                part, steps = [], 0
            part.append(i)
            steps += len(scans[i][1])
        if part:
            judge()
        return out


#: Stock words for composing where no page can be read.
STOCK = ["one two three four five six seven eight nine ten. eleven twelve, thirteen fourteen fifteen"]


def fit(texts: list[str], composed: int = 1500, epochs: int = 8, rate: float = 5e-3, batch: int = 32, seed: int = 5) -> Labeller:
    """Adam over composed pages. Path words are dropped at random, so that no single name decides alone."""
    rng = np.random.default_rng(seed)
    net, known, data, words = Labeller.fresh(rng), {}, [], [t.split() for t in texts or STOCK]
    for _ in range(composed):
        page = blocks(compose(rng, words), known)
        y = np.array([t[:1] == KEEP for t, _, _ in page], np.float32)
        page = [(t.replace(KEEP, "").replace(DROP, "") or "x", p, a) for t, p, a in page]
        if page:
            data.append((page, y))
    data.sort(key=lambda d: len(d[1]))
    groups = []
    for part in (data[i : i + batch] for i in range(0, len(data), batch)):
        b = packed([d[0] for d in part])
        y = np.zeros(b["shape"], np.float32)
        for i, (_, own) in enumerate(part):
            y[i, : len(own)] = own
        groups.append((b, y))
    m, v, t = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    total = epochs * len(groups)
    for _ in range(epochs):
        for k in rng.permutation(len(groups)):
            b, y = groups[k]
            ids, cells, w = b["path"]
            b = b | {"path": (ids, cells, w * (rng.random(len(w)) > 0.1))}
            t += 1
            lr = rate * (1 - (t - 1) / total)
            for name, g in net.gradients(b, y).items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g**2 - v[name])
                net.p[name] -= (lr * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def learn(pages: DataFrame, html: str = "html", page_id: str = "page_id", most_pages: int = 300) -> Labeller:
    """Fit to pages composed from the blocks of a bounded sample, drawn by a hash of the id."""
    n = pages.count()
    draw = F.pmod(F.xxhash64(page_id, F.lit("pages")), F.lit(1 << 30)) / (1 << 30)
    rows = pages.where((draw < min(1.0, most_pages / max(1, n))) & F.col(html).isNotNull()).select(F.col(page_id).alias("id"), F.col(html).alias("html")).toArrow()
    known: dict = {}
    texts = [t for h in rows.sort_by("id")["html"].to_pylist() for t, _, _ in scan(h, known)[0]]
    return fit(texts)


def extract(pages: DataFrame, net: Labeller, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``pages`` with the main text and its length in code points."""
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    rows = pages.select(F.struct(*keep).alias("row"), F.col(html).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for b in pieces(batch, "html"):
                parsed = [scan(h or "", known) for h in b.column(1).to_pylist()]
                texts = [" ".join(x[0] for x, k in zip(page, kept) if k) for (page, _), kept in zip(parsed, shared.value.keep(parsed))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    return unpacked(rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long"), "text", "n_chars")
