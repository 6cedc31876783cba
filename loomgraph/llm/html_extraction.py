"""Main text of HTML pages by a linear-chain conditional random field.

A page becomes a sequence of leaf blocks (texts between block-level tags).  Each block has binary
features of its ancestors (tags, class and id words), its text and its place; the chain has two
states, main text and the rest, and is decoded by Viterbi.  Weights are fitted by maximum
likelihood on labelled pages: the caller's (html with the labels of its blocks), by default
generated ones in which every block's origin is known.

Defined results: null or empty html has an empty text; unclosed and stray tags are tolerated;
rows with null or repeated page_id are extracted like others; an empty table gives no rows;
further columns are ignored.  Pages of any length and with any markup take time in proportion to
their length: they are scanned once, and quotes that are never closed hide nothing."""

from __future__ import annotations

import functools
import html as html_
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, table, trimmed

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: elements whose content is never text of the page
RAW_TAGS = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: the same, but with ordinary markup inside
SKIPPED_TAGS = frozenset("template svg object canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an open element of the first kind ends where one of the second begins
ENDS = {"p": BLOCK_TAGS - {"button", "label", "noscript"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
#: the rest of a tag; only a value's quotes hide a `>`
_REST = re.compile(r"(?>[^>=\"']+|=\s*+(?>\"[^\"]*\"|'[^']*')?|[\"'])*+>")
_SKIPPED = re.compile(r"<(?:template|svg|object|canvas|audio|video)\b", re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Leaf:
    """A block: its text, the innermost and all tags above it, their attributes' words, characters of
    its links."""

    text: str
    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: int


def _names(attributes: str) -> frozenset[str]:
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "")
        out.update(_WORD.findall(value.lower()))
    return frozenset(out)


class Tags:
    """Scans a page once, from left to right.  A tag that no `>` outside quotes ends shows that a
    quote is never closed: from there on quotes hide nothing, so that no part is scanned again."""

    def __init__(self, page: str):
        self.page, self.at, self.quotes = page, 0, True

    def next(self) -> tuple[int, str, bool, str] | None:
        """Where the next tag starts, its name, whether it closes, its attributes; comments and
        declarations have no name.  `at` is then behind it."""
        page, at = self.page, self.at
        while m := _START.search(page, at):
            start, head = m.start(), m.end()
            if not m[2]:
                mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                # an empty comment may be closed by its own dashes
                end = page.find(mark, head - 2 if m[0] == "<!--" else head)
                self.at = len(page) if end < 0 else end + len(mark)
                return start, "", False, ""
            end = _REST.match(page, head) if self.quotes else None
            if end is None:
                self.quotes = False
                stop = page.find(">", head)
                if stop < 0:
                    break
                self.at = stop + 1
            else:
                self.at = end.end()
            return start, m[2].lower(), bool(m[1]), page[head : self.at - 1]
        self.at = len(page)
        return None

    def skip_raw(self, tag: str) -> None:
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(self.page, self.at)
        self.at = end.end() if end else len(self.page)


def _closed(page: str) -> set[int]:
    """Where those skipped elements start that have an end tag."""
    out: set[int] = set()
    if not _SKIPPED.search(page):
        return out
    scan, opened = Tags(page), {t: [] for t in SKIPPED_TAGS}
    while (found := scan.next()) is not None:
        start, name, closing, rest = found
        if name in RAW_TAGS and not closing and not rest.endswith("/"):
            scan.skip_raw(name)
        elif name in SKIPPED_TAGS:
            if not closing and not rest.endswith("/"):
                opened[name].append(start)
            elif closing and opened[name]:
                out.add(opened[name].pop())
    return out


def leaves(page: str | None, known: frozenset[str] | None = None) -> list[Leaf]:
    """Blocks with text, in page order; references decoded, white space made single spaces.  known:
    the attribute words to keep, of which a page may have any number.  A skipped element without an
    end tag ends with the element around it, or where a block begins that ends that element, or below
    body where any block begins."""
    page = page or ""
    out: list[Leaf] = []
    stack: list[tuple[str, frozenset[str], bool]] = []  # tag, names, whether it is skipped to its end tag
    skipped: list[int] = []  # places of skipped elements in the stack
    open_tags: Counter[str] = Counter()
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link = 0, False
    closed, scan, at = _closed(page), Tags(page), 0

    def pop_to(place: int) -> None:
        while len(stack) > place:
            tag, names, _ = stack.pop()
            if tag in SKIPPED_TAGS:
                skipped.pop()
            for counts, items in ((open_tags, (tag,)), (open_names, names)):
                for x in items:
                    counts[x] -= 1
                    if not counts[x]:
                        del counts[x]

    def push(tag: str, names: frozenset[str] = frozenset(), has_end: bool = False) -> None:
        if tag in SKIPPED_TAGS:
            skipped.append(len(stack))
        stack.append((tag, names, has_end))
        open_tags[tag] += 1
        open_names.update(names)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_.unescape("".join(parts)).split())
        if text:
            place = skipped[0] if skipped else len(stack)
            out.append(Leaf(text, stack[place - 1][0] if place else "", frozenset(open_tags), frozenset(open_names), linked))
        parts.clear()
        linked = 0

    while True:
        found = scan.next()
        if not skipped:
            raw = page[at : found[0] if found else len(page)]
            parts.append(raw)
            linked += len(raw) * in_link
        if found is None:
            break
        start, tag, closing, rest = found
        empty = rest.endswith("/")
        if tag in RAW_TAGS and not closing and not empty:
            scan.skip_raw(tag)
        at = scan.at
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif closing and open_tags[tag]:
            place = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
            if tag in BLOCK_TAGS and (not skipped or place < skipped[0]):
                flush()
                in_link = False
            pop_to(place)
        elif tag in SKIPPED_TAGS and not closing and not empty:
            push(tag, has_end=start in closed)
        elif tag in BLOCK_TAGS:
            if skipped and not closing and not stack[skipped[0]][2]:
                around = stack[skipped[0] - 1][0] if skipped[0] else "body"
                if around in ("html", "body") or tag in ENDS.get(around, ()):
                    pop_to(skipped[0])
            if not skipped:
                flush()
            if closing or tag in VOID_TAGS:
                continue
            while stack and tag in ENDS.get(stack[-1][0], ()):
                pop_to(len(stack) - 1)
            if not empty:
                names = frozenset() if skipped or not rest else _names(rest)
                push(tag, names if known is None else names & known)
    flush()
    return out


def _size(n: int) -> str:
    return str(min(9, n.bit_length()))


def features(leaf: Leaf, place: int, count: int) -> list[str]:
    text = leaf.text
    words = text.split(" ")
    out = ["bias", f"tag:{leaf.tag}", f"words:{_size(len(words))}", f"links:{min(4, 5 * leaf.linked // max(1, len(text)))}"]
    out += [f"in:{t}" for t in leaf.tags]
    out += [f"name:{n}" for n in leaf.names]
    out.append(f"end:{text[-1] if text[-1] in '.!?:;,…' else 'other'}")
    stops = sum(text.count(c) for c in ".,;!?")
    out.append(f"stops:{min(4, 20 * stops // max(1, len(words)))}")
    if "©" in text:
        out.append("copyright")
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    if len(words) <= 12:
        out += [f"word:{w}" for w in {w.strip(".,:;!?").lower() for w in words} if w.isascii()]
    return out


@dataclass
class Chain:
    """weights: of state 1 against state 0 by feature; moves[a][b]: from state a to b; starts."""

    weights: dict[str, float]
    moves: list[list[float]]
    starts: list[float]

    @functools.cached_property
    def names(self) -> frozenset[str]:
        """Attribute words that have a weight."""
        return frozenset(f[5:] for f in self.weights if f.startswith("name:"))

    def decode(self, blocks: list[Leaf]) -> list[int]:
        """Likeliest states, by Viterbi."""
        get, n, back = self.weights.get, len(blocks), []
        (m00, m01), (m10, m11) = self.moves
        a = b = 0.0
        for i, leaf in enumerate(blocks):
            s = sum(get(f, 0.0) for f in features(leaf, i, n))
            if i == 0:
                a, b = self.starts[0], self.starts[1] + s
                continue
            x, y = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if x else 1, 0 if y else 1))
            a, b = (a + m00 if x else b + m10), (a + m01 if y else b + m11) + s
        state = int(b > a)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1][:n]


def fit(pages: list[tuple[list[Leaf], list[int]]], rounds: int = 150, rate: float = 0.15, l2: float = 2e-4, least: int = 3) -> Chain:
    """Maximum likelihood with a quadratic penalty; forward and backward sums run over all pages
    at once.  Features of fewer than `least` blocks are left out."""
    pages = [p for p in pages if p[0]]
    found = [[features(leaf, i, len(blocks)) for i, leaf in enumerate(blocks)] for blocks, _ in pages]
    seen: dict[str, int] = {}
    for page in found:
        for fs in page:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    names = {f: j for j, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    n, t = len(pages), max(len(p[0]) for p in pages)
    cell, col = [], []
    mask, label = np.zeros((n, t), bool), np.zeros((n, t), np.int64)
    for i, page in enumerate(found):
        mask[i, : len(page)] = True
        label[i, : len(page)] = pages[i][1]
        for k, fs in enumerate(page):
            for f in fs:
                if f in names:
                    cell.append(i * t + k)
                    col.append(names[f])
    cell, col = np.array(cell), np.array(col)
    d = len(names)
    z = np.zeros(d + 6)  # weights, moves, starts
    first, second = np.zeros_like(z), np.zeros_like(z)
    pair = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.bincount((label[:, :-1] * 2 + label[:, 1:])[pair], minlength=4)
    gold_starts = np.bincount(label[:, 0], minlength=2)
    gold_weights = np.bincount(col, label.reshape(-1)[cell], minlength=d)
    blocks = mask.sum()

    def lse(x):
        m = x.max(axis=1, keepdims=True)
        return m[:, 0] + np.log(np.exp(x - m).sum(axis=1))

    for step in range(1, rounds + 1):
        w, m, s = z[:d], z[d : d + 4].reshape(2, 2), z[d + 4 :]
        node = np.zeros((n, t, 2))
        node[:, :, 1] = np.bincount(cell, w[col], minlength=n * t).reshape(n, t)
        fore, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fore[:, 0] = s + node[:, 0]
        for k in range(1, t):
            new = lse(fore[:, k - 1][:, :, None] + m) + 0
            fore[:, k] = np.where(mask[:, k, None], new + node[:, k], fore[:, k - 1])
        for k in range(t - 2, -1, -1):
            new = lse(np.swapaxes(m[None] + (node[:, k + 1] + back[:, k + 1])[:, None, :], 1, 2))
            back[:, k] = np.where(mask[:, k + 1, None], new, 0.0)
        logz = lse(fore[:, -1])
        p = np.exp(fore + back - logz[:, None, None]) * mask[:, :, None]
        joint = fore[:, :-1, :, None] + m + (node[:, 1:] + back[:, 1:])[:, :, None, :] - logz[:, None, None, None]
        q = (np.exp(np.minimum(joint, 0)) * pair[:, :, None, None]).sum(axis=(0, 1))
        g = np.concatenate([np.bincount(col, p[:, :, 1].reshape(-1)[cell], minlength=d) - gold_weights, q.reshape(-1) - gold_moves, p[:, 0].sum(axis=0) - gold_starts]) / blocks + l2 * z
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        z = z - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Chain({f: float(z[j]) for f, j in names.items()}, z[d : d + 4].reshape(2, 2).tolist(), z[d + 4 :].tolist())


# --- labelled pages -------------------------------------------------------------------------


class PageMaker:
    """Random pages with known main text.  Words are made of random syllables, so only the frame of
    a page tells; short boilerplate uses the words that such places have."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.mark = "\ue000"  # in front of every main block, taken out again

    def word(self) -> str:
        return "".join(self.r.choice("aeiouàéöñ") + self.r.choice("bcdfghlmnprst") for _ in range(self.r.randint(1, 3)))

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        return (" ".join(words)).capitalize() + self.r.choice("....!?")

    def paragraph(self) -> str:
        text = " ".join(self.sentence(2, 18) for _ in range(self.r.choice([1, 1, 1, 2, 3, 6])))
        if self.r.random() < 0.12:  # some end in the middle of a sentence
            words = text.split(" ")
            text = " ".join(words[: self.r.randint(1, len(words))]).rstrip(".!?")
        if self.r.random() < 0.2:
            text = text.replace(" ", f" <a href='/{self.word()}'>{self.word()}</a> ", 1)
        if self.r.random() < 0.15:
            text = "<b>" + text + "<br>"
        return text

    def attribute(self, *names: str) -> str:
        k = self.r.choice(["class", "class", "id"])
        return f' {k}="{self.r.choice(names)}"' if self.r.random() < 0.85 else ""

    def item(self) -> str:
        r, m = self.r, self.mark
        kind = r.random()
        if kind < 0.72:
            return f"<p>{m}{self.paragraph()}" + ("</p>" if r.random() < 0.8 else "")
        if kind < 0.80:
            h = r.choice(["h2", "h3"])
            return f"<{h}>{m}{self.sentence(2, 6).rstrip('.')}</{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{m}{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.90:
            return f"<blockquote><p>{m}{self.paragraph()}</p></blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{m}{self.sentence(1, 5)}</td><td>{m}{self.sentence(1, 5)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        if kind < 0.97:
            return f"<pre>{m}{self.sentence(3, 15)}</pre>"
        return self.advert()

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.word().capitalize()}</a></li>' for _ in range(n)) + "</ul>"

    def advert(self) -> str:
        text = self.r.choice(["Advertisement", "Sponsored", "", self.sentence(2, 12), self.paragraph()])
        tag = self.r.choice(["div", "div", "aside", "section"])
        return f'<{tag}{self.attribute("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot")}>{text}</{tag}>'

    def notice(self) -> str:
        tag = self.r.choice(["div", "div", "section", "dialog"])
        text = self.r.choice(["We use cookies. ", "Cookie notice. ", "Privacy. ", ""]) + self.sentence(3, 15)
        inner = f"<p>{text}</p><button>{self.r.choice(['Accept', 'OK', 'Close', 'Decline'])}</button>" if self.r.random() < 0.6 else text
        if self.r.random() < 0.15:
            return f"<noscript>{self.r.choice(['Please enable JavaScript. ', 'JavaScript is disabled. ', ''])}{self.sentence(3, 9)}</noscript>"
        return f'<{tag}{self.attribute("cookie", "cookie-notice", "consent", "notice", "gdpr", "banner", "popup", "modal")}>{inner}</{tag}>'

    def form(self) -> str:
        label = self.r.choice(["Subscribe", "Sign up", "Search", "Email", "Login", "Newsletter"])
        return f'<form{self.attribute("form", "newsletter", "search", "subscribe", "login")}><label>{label}</label><input type="text"><p>{self.sentence(2, 10)}</p><button>{label}</button></form>'

    def comments(self) -> str:
        tag = self.r.choice(["section", "div", "div"])
        name = self.attribute("comments", "comment-list", "comments-area", "discussion", "responses", "replies")
        one = self.r.choice(["<div class='comment'><p>{}</p></div>", "<p>{}</p>", "<li class='comment'>{}</li>", "<article class='comment'><p>{}</p></article>"])
        head = self.r.choice(["<h2>Comments</h2>", f"<h3>{self.r.randint(1, 99)} comments</h3>", ""])
        return f"<{tag}{name if name or head else ' class=comments'}>{head}" + "".join(one.format(self.paragraph()) for _ in range(self.r.randint(1, 5))) + f"</{tag}>"

    def side(self) -> str:
        tag = self.r.choice(["aside", "aside", "div"])
        name = self.attribute("sidebar", "side", "related", "widget", "recommended") if tag == "aside" else f' class="{self.r.choice(["sidebar", "related", "widget", "recommended"])}"'
        return f"<{tag}{name}><h3>{self.sentence(1, 3).rstrip('.')}</h3>{self.links(self.r.randint(2, 6))}" + (f"<p>{self.sentence(3, 14)}</p>" if self.r.random() < 0.5 else "") + f"</{tag}>"

    def page(self) -> tuple[list[Leaf], list[int]]:
        r, m = self.r, self.mark
        out = ["<!DOCTYPE html><html><head><title>x</title></head><body>"]
        if r.random() < 0.4:
            out.append(f'<header{self.attribute("header", "masthead", "top")}><h1>{self.word()}</h1>' + (f"<p>{self.sentence(2, 8)}</p>" if r.random() < 0.5 else "") + "</header>")
        if r.random() < 0.9:
            out.append(r.choice(["<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', "<nav class='breadcrumb'>{}</nav>"]).format(self.links(r.randint(2, 8))))
        for make, chance in ((self.notice, 0.3), (self.advert, 0.6), (self.form, 0.15), (self.side, 0.15)):
            if r.random() < chance:
                out.append(make())
        opening, closing = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section class="story">', "</section>"), ("<div>", "</div>")])
        out.append(opening + f"<h1>{m}{self.sentence(2, 9).rstrip('.')}</h1>")
        out += [self.item() for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14]))]
        if r.random() < 0.2:
            out.append(r.choice([self.comments, self.side, self.form])())
        out.append(closing)
        if r.random() < 0.04:  # pages whose article is there for readers without scripts
            begin = next(k for k in range(len(out)) if out[k].startswith(opening))
            out[begin], out[-1] = "<noscript>" + out[begin], closing + "</noscript>"
        for make, chance in ((self.comments, 0.35), (self.side, 0.3), (self.advert, 0.25), (self.form, 0.2), (self.notice, 0.1)):
            if r.random() < chance:
                out.append(make())
        if r.random() < 0.9:
            text = r.choice([f"&copy; {self.word()}.com &middot; {self.sentence(2, 8)}", f"<p>&copy; {self.sentence(1, 6)}</p>", f"<p>{self.sentence(2, 10)}</p>{self.links(3)}", self.sentence(2, 8)])
            out.append(r.choice(["<footer>{}</footer>"] * 3 + ['<div class="footer">{}</div>']).format(text))
        out.append("</body></html>" if r.random() < 0.9 else "")
        blocks = leaves("".join(out))
        labels = [int(m in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(m, "")
        return blocks, labels


@functools.cache
def default_chain(pages: int = 500, seed: int = 7) -> Chain:
    maker = PageMaker(seed)
    return fit([maker.page() for _ in range(pages)])


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaves(page, chain.names)
    return " ".join(b.text for b, s in zip(blocks, chain.decode(blocks), strict=True) if s) if blocks else ""


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """pages: page_id, url, html.  Rows (page_id, url, text, n_chars)."""
    chain = chain or default_chain()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for some in slices(batch, "html"):
                texts = [main_text(h, chain) for h in some.column("html").to_pylist()]
                cols = [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
