"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A block is the text between two boundaries of block elements. Its features are the tags of its ancestors, what
their class, id and role names say, and traits of the text that no language decides: length, share of linked
words, final punctuation, marks such as the copyright sign. The field has two labels, article and other, and is
trained on labelled pages; `labelled_pages` writes such pages in many layouts. Viterbi decodes all blocks of a
page together.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, table
from .hashing import slices

BLOCKS = frozenset(
    "html body p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 article section header footer nav aside main table thead tbody tfoot tr td th caption form fieldset legend label select option optgroup button textarea blockquote pre figure figcaption address hr details summary dialog menu center iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title textarea iframe".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: A start tag of these ends an open element of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody thead select".split())
KINDS = {
    "ads": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense adbox dfp", "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip", "head": "header masthead top topbar logo branding sitename",
    "foot": "footer foot copyright bottom contentinfo legal colophon", "side": "sidebar side aside widget related recommended trending popular more complementary teaser", "comment": "comment comments reply replies discussion disqus respond commentlist",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe signup gdpr dialog paywall overlay toast warning", "form": "form login search searchbox register contact", "share": "share sharing social follow",
    "text": "content article post entry story main body text articlebody maincontent prose",
}
KIND_OF = {word: kind for kind, words in KINDS.items() for word in words.split()}
#: A tag's name, what parts attributes, an attribute's name, the sign before a value, and a value without quotes.
TAG_NAME, GAP, ATTRIBUTE, SIGN, BARE = (re.compile(x) for x in (r"[A-Za-z][^\s/>]*", r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
#: Open elements at most; deeper ones take the place of the last.
DEPTH = 512
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
DIGIT = re.compile(r"\d")


class Scanner:
    """Texts and tags of a page from left to right, in time linear in its length.

    Values in quotes may hold any character; a quote inside a value without quotes is part of it. A quote that is never
    closed ends its tag at the next >. A tag or comment that the page cuts off is dropped; a < that begins no tag is text."""

    def __init__(self, page: str):
        self.page, self.at, self.raw_end = page, 0, {}
        self.last = {c: page.rfind(c) for c in "<>'\""}

    def find(self, c: str, at: int) -> int:
        """The next c from at on, -1 if there is none; a miss costs nothing."""
        return self.page.find(c, at) if at <= self.last[c] else -1

    def skip_raw(self, tag: str) -> None:
        """To the end tag of a script or the like; to the end of the page without one."""
        found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(self.page, self.at)
        self.at = found.start() if found else len(self.page)

    def __iter__(self) -> Iterator[tuple[str, str, bool, dict[str, str], bool]]:
        """(text, tag, whether an end tag, attributes, whether closed in itself); either text or tag is empty."""
        page, n = self.page, len(self.page)
        while self.at < n:
            at = self.find("<", self.at)
            if at != self.at:
                to = n if at < 0 else at
                text, self.at = page[self.at : to], to
                yield text, "", False, {}, False
                continue
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2) if at + 4 < n else -1
                self.at = n if end < 0 else end + 3
                continue
            end_tag = page.startswith("/", at + 1)
            name = TAG_NAME.match(page, at + 1 + end_tag)
            if name:
                attributes, closed = self._attributes(name.end())
                if self.at <= n:
                    yield "", name[0].lower(), end_tag, attributes, closed
                continue
            if page[at + 1 : at + 2] in ("!", "?", "/") and page[at + 1 : at + 2]:  # declarations and the like
                end = self.find(">", at + 2)
                self.at = n if end < 0 else end + 1
                continue
            self.at = at + 1
            yield "<", "", False, {}, False

    def _attributes(self, at: int) -> tuple[dict[str, str], bool]:
        """Class, id and role of the tag whose attributes begin at `at`; self.at is behind the tag, beyond the page if it is cut off."""
        page, n, begin, out = self.page, len(self.page), at, {}
        while True:
            gap = GAP.match(page, at)
            at = gap.end()
            if at >= n:
                self.at = n + 1
                return out, False
            if page[at] == ">":
                self.at = at + 1
                return out, gap[0].endswith("/")
            name = ATTRIBUTE.match(page, at)
            at, value = name.end(), ""
            sign = SIGN.match(page, at)
            if sign:
                at = sign.end()
                quote = page[at : at + 1]
                if quote in ("'", '"') and quote:
                    end = self.find(quote, at + 1)
                    if end < 0:
                        end = self.find(">", begin)
                        self.at = n + 1 if end < 0 else end + 1
                        return out, False
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = BARE.match(page, at)[0]
                    at += len(value)
            if len(name[0]) < 6 and name[0].lower() in ("class", "id", "role"):
                out.setdefault(name[0].lower(), value)


def _kinds(attributes: dict[str, str]) -> set[str]:
    return {"kind:" + KIND_OF[part] for value in attributes.values() for part in map(str.lower, PART.findall(value)) if part in KIND_OF}


def blocks(page: str) -> list[tuple[str, frozenset, int, int]]:
    """(text, features of the ancestors, words, linked words) of each leaf block with text, in page order."""
    out: list[tuple[str, frozenset, int, int]] = []
    stack: list[tuple[str, frozenset]] = [("", frozenset())]
    held: list[tuple[str, bool]] = []
    open_tags: Counter[str] = Counter()
    links = hidden = 0

    def flush() -> None:
        if held:
            raw = html.unescape("".join(t for t, _ in held))
            words = raw.split()
            if words:
                linked = sum(len(html.unescape(t).split()) for t, a in held if a)
                tag = next((t for t, _ in reversed(stack) if t in BLOCKS), "")
                out.append((" ".join(words), stack[-1][1] | {"leaf:" + tag}, len(words), linked))
            held.clear()

    def pop(to: int) -> None:
        nonlocal links, hidden
        for tag, _ in stack[to:]:
            open_tags[tag] -= 1
            links -= tag == "a"
            hidden -= tag in HIDDEN
        del stack[to:]

    scanner = Scanner(page)
    for text, tag, is_end, attributes, closed in scanner:
        if not tag:
            if not hidden:
                held.append((text, links > 0))
            continue
        if is_end:
            if open_tags[tag] > 0:
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if any(t in BLOCKS for t, _ in stack[i:]):
                    flush()
                pop(i)
            continue
        if tag == "br":
            held.append((" ", False))
        if tag in BLOCKS:
            flush()
            closes = ENDS.get(tag, set()) | ({"p"} if tag not in ("label", "button") else set())
            if any(open_tags[t] > 0 for t in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        pop(i)
                        break
                    if stack[i][0] in SCOPE or (stack[i][0] in BLOCKS and stack[i][0] != "p" and "p" in closes and len(closes) == 1):
                        break
        if tag in VOID or (closed and tag not in BLOCKS):
            continue
        if tag == "body" and hidden:
            pop(1)
        if len(stack) >= DEPTH:
            pop(DEPTH - 1)
        stack.append((tag, stack[-1][1] | _kinds(attributes) | ({"in:" + tag} if tag in BLOCKS else set())))
        open_tags[tag] += 1
        links += tag == "a"
        hidden += tag in HIDDEN
        if tag in RAW:
            scanner.skip_raw(tag)
    flush()
    return out


def features(block: tuple[str, frozenset, int, int], i: int, n: int) -> list[str]:
    text, around, words, linked = block
    share = linked / words
    out = [*around, f"words:{min(6, words.bit_length())}", f"links:{0 if not linked else 1 + int(share > 0.3) + int(share > 0.8)}", "end:" + ("stop" if text[-1] in ".!?…:\"'”»)" else "none")]
    out.append(f"place:{0 if i < 3 else 2 if i >= n - 3 else 1}")
    low = text.lower()
    if "©" in text or "copyright" in low or "rights reserved" in low:
        out.append("mark:copyright")
    if "·" in text:
        out.append("mark:dot")
    if "cookie" in low or "subscribe" in low or "newsletter" in low:
        out.append("mark:notice")
    if len(DIGIT.findall(low)) * 5 > len(low):
        out.append("mark:digits")
    if "," in text:
        out.append("mark:comma")
    return out


# --- labelled pages ---------------------------------------------------------------------------------------------


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages of many layouts and the label of each of their blocks (1: article)."""
    rng = random.Random(seed)
    parts = "ba ke lo mi nu ra se ti vo en er on st th ung ción é ä ou 日 на ко".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 4, b: int = 40) -> str:
        text = words(a, b)
        if rng.random() < 0.5:
            text = text.replace(" ", ", ", 1)
        return text.capitalize() + rng.choice(("." * 6 + "!?:") if rng.random() < 0.9 else " ")

    def attr(*names: str) -> str:
        if rng.random() < 0.25:
            return ""
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}{rng.choice(("", "", "-" + words(1, 1), " " + words(1, 1)))}"'

    pages = []
    for _ in range(n):
        out: list[str] = []
        labels: list[int] = []

        def put(raw: str, label: int, out=out, labels=labels) -> None:
            out.append(raw)
            labels.append(label)

        def menu(out=out, put=put) -> None:
            tag = rng.choice(("nav", "nav", "div", "ul", "header"))
            name = attr("nav", "menu", "navigation", "breadcrumbs", "navbar") or (' class="menu"' if tag in ("div", "ul") else "")
            out.append(f"<{tag}{name}>" + ("<ul>" if rng.random() < 0.6 and tag != "ul" else ""))
            for _ in range(rng.randint(2, 9)):
                put(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>', 0)
            out.append(f"</{tag}>")

        def other(kind: str, out=out, put=put) -> None:
            tag, names = {
                "ads": (rng.choice(("div", "div", "aside", "section")), ("ad", "ads", "advert", "sponsored", "banner", "promo")), "head": (rng.choice(("header", "header", "div")), ("header", "masthead", "topbar")),
                "side": (rng.choice(("aside", "aside", "div")), ("sidebar", "widget", "related", "trending")), "comment": (rng.choice(("section", "div", "ol")), ("comments", "comment", "replies", "discussion", "respond")),
                "notice": (rng.choice(("div", "dialog", "section")), ("cookie", "cookies", "consent", "notice", "newsletter", "modal", "alert")), "share": ("div", ("share", "social")),
                "form": ("form", ("login", "search", "signup")), "foot": (rng.choice(("footer", "footer", "div")), ("footer", "copyright", "legal")),
            }[kind]
            name = attr(*names)
            if tag in ("div", "section", "ol") and not name and (kind != "notice" or rng.random() < 0.7):
                name = f' class="{rng.choice(names)}"'
            out.append(f"<{tag}{name}>")
            for i in range(rng.randint(1, 4)):
                inner = rng.choice(("p", "p", "div", "li", "span")) if kind not in ("form",) else rng.choice(("label", "p", "button"))
                if kind == "side" and rng.random() < 0.5:
                    put(f"<div><a href='#'>{words(2, 7)}</a></div>", 0)
                elif kind == "foot" and i == 0:
                    put(f"<p>&copy; {words(1, 2)} &middot; {sentence(2, 9)}</p>", 0)
                elif kind == "notice" and rng.random() < 0.5:
                    told = rng.choice(("cookie", "cookies", "subscribe", "newsletter"))
                    put(f"<p>{words(1, 8)} {told} {sentence(2, 20)}</p>", 0)
                elif kind == "foot" and rng.random() < 0.3:
                    put(f"<p>{rng.randint(100, 999)} {rng.randint(1000, 9999)} {words(0, 1)}</p>", 0)
                elif kind == "foot" and rng.random() < 0.2:
                    put(f"<div>{sentence(5, 40)} {rng.choice(('Copyright', 'All rights reserved'))} {words(0, 3)}</div>", 0)
                elif kind in ("comment", "ads", "notice") and rng.random() < 0.6:
                    put(f"<{inner}>{sentence(2, 30)}</{inner}>" if inner != "span" else f"<p><span>{sentence(2, 30)}</span></p>", 0)
                elif inner == "span":
                    put(f"<div><span>{words(1, 5)}</span></div>", 0)
                else:
                    put(f"<{inner}>{words(1, 8)}</{inner}>", 0)
            out.append(f"</{tag}>")

        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var t='</p>';</script><style>p{{}}</style></head><body>")
        bare = rng.random()
        if bare < 0.85:
            for kind in rng.sample(("head", "ads", "notice", "form"), rng.randint(0, 3)):
                other(kind)
            if rng.random() < 0.9:
                menu()
            for kind in rng.sample(("ads", "side", "share", "notice"), rng.randint(0, 2)):
                other(kind)
        tag = rng.choice(("article", "article", "article", "main", "div", "section", "td"))
        name = attr("content", "post", "entry", "story", "article-body", "main-content")
        if bare >= 0.85:
            tag, name = rng.choice((("div", ""), ("article", ""), ("main", "")))
        out.append(("<main>" if tag == "article" and rng.random() < 0.2 else "") + ("<table><tr>" if tag == "td" else "") + f"<{tag}{name}>")
        if rng.random() < 0.85:
            put(f"<h1>{sentence(1, 12) if rng.random() < 0.5 else words(1, 12)}</h1>", 1)
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13, 20))):
            x = rng.random()
            if x < 0.05:
                put(f"<h2>{words(1, 7)}</h2>", 1)
            elif x < 0.1:
                put(f"<blockquote>{sentence()}</blockquote>", 1)
            elif x < 0.16:
                out.append("<ul>")
                for _ in range(rng.randint(1, 5)):
                    put(f"<li>{sentence(1, 15)}</li>", 1)
                out.append("</ul>")
            elif x < 0.2:
                put(f"<pre>{words(3, 20)}</pre>", 1)
            elif x < 0.22:
                put(f"<p>{rng.randint(1, 9999)}, {sentence(1, 20)} {rng.randint(1, 99)}.</p>", 1)
            elif x < 0.3:
                put(f"<p>{words(1, 6)}</p>", 1)
            elif x < 0.4:
                put(f"<p>{sentence()} <a href='#'>{words(1, 3)}</a> {sentence()}</p>", 1)
            elif x < 0.5:
                put(f"<p><b>{sentence(1, 10)}<br></b></p>", 1)
            else:
                put(f"<p>{sentence(1, 60)} {sentence() if rng.random() < 0.5 else ''}", 1)
            if rng.random() < 0.04:
                other(rng.choice(("ads", "side", "share")))
        if rng.random() < 0.15:
            other("comment")
        out.append(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))
        if bare < 0.85:
            for kind in rng.sample(("comment", "side", "ads", "share", "form", "notice"), rng.randint(0, 3)):
                other(kind)
            if rng.random() < 0.9:
                other("foot")
        pages.append(("".join(out) + "</body></html>", labels))
    return pages


# --- the field --------------------------------------------------------------------------------------------------


def _scores(pages: list[list[list[int]]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pages, blocks, 2) scores and the mask of real blocks."""
    most = max((len(p) for p in pages), default=0)
    out, mask = np.zeros((len(pages), most, 2)), np.zeros((len(pages), most), dtype=bool)
    for i, page in enumerate(pages):
        for j, own in enumerate(page):
            out[i, j] = weights[own].sum(axis=0)
        mask[i, : len(page)] = True
    return out, mask


def train(pages: list[tuple[str, list[int]]] | None = None, rounds: int = 120, ridge: float = 0.02) -> dict:
    """Feature weights and transition scores that maximise the conditional likelihood (AdaGrad, L2), from pages of (html, labels of the blocks)."""
    pages = labelled_pages() if pages is None else pages
    number: dict[str, int] = {}
    coded, gold = [], []
    for page, labels in pages:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError("a page has not as many blocks as labels")
        coded.append([[number.setdefault(f, len(number)) for f in features(b, i, len(found))] for i, b in enumerate(found)])
        gold.append(labels)
    flat = [(i, j, f) for i, p in enumerate(coded) for j, own in enumerate(p) for f in own]
    pi, bj, fk = (np.array(x) for x in zip(*flat, strict=True))
    weights, moves = np.zeros((len(number), 2)), np.zeros((2, 2))
    sums = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    _, mask = _scores(coded, weights)
    truth = np.zeros((*mask.shape, 2))
    for i, labels in enumerate(gold):
        truth[i, np.arange(len(labels)), labels] = 1
    pairs = mask[:, 1:]
    seen = np.einsum("pba,pbc->ac", truth[:, :-1] * pairs[..., None], truth[:, 1:])
    for _ in range(rounds):
        s = np.zeros((*mask.shape, 2))
        np.add.at(s, (pi, bj), weights[fk])
        # forward and backward sums in logs, all pages together
        a, b = s.copy(), np.zeros_like(s)
        for t in range(1, s.shape[1]):
            step = np.logaddexp.reduce(a[:, t - 1, :, None] + moves, axis=1) + s[:, t]
            a[:, t] = np.where(mask[:, t, None], step, a[:, t - 1])
        for t in range(s.shape[1] - 2, -1, -1):
            step = np.logaddexp.reduce(moves[None] + (s[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            b[:, t] = np.where(mask[:, t + 1, None], step, 0)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        p = np.exp(np.minimum(0, a + b - z[:, None, None])) * mask[..., None]
        joint = np.exp(np.minimum(0, a[:, :-1, :, None] + moves + (s + b)[:, 1:, None, :] - z[:, None, None, None])) * pairs[..., None, None]
        g = np.zeros_like(weights)
        np.add.at(g, fk, (truth - p)[pi, bj])
        for value, grad, total in ((weights, g / len(pages) - ridge * weights / 10, sums[0]), (moves, (seen - joint.sum(axis=(0, 1))) / len(pages) - ridge * moves / 10, sums[1])):
            total += grad**2
            value += 0.5 * grad / np.sqrt(total)
    return {"number": number, "weights": weights, "moves": moves}


def decode(model: dict, found: list[tuple]) -> list[int]:
    """The labels of a page's blocks on the best path."""
    number, weights, moves = model["number"], model["weights"], model["moves"].tolist()
    if not found:
        return []
    known = number.get
    best, back = None, []
    for i, block in enumerate(found):
        own = [k for k in map(known, features(block, i, len(found))) if k is not None]
        s0, s1 = weights[own].sum(axis=0).tolist() if own else (0.0, 0.0)
        if best is None:
            best = (s0, s1)
            continue
        to0 = (best[0] + moves[0][0], best[1] + moves[1][0])
        to1 = (best[0] + moves[0][1], best[1] + moves[1][1])
        back.append((int(to0[1] > to0[0]), int(to1[1] >= to1[0])))
        best = (max(to0) + s0, max(to1) + s1)
    labels = [int(best[1] >= best[0])]
    for b in reversed(back):
        labels.append(b[labels[-1]])
    return labels[::-1]


def article(model: dict, page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, label in zip(found, decode(model, found), strict=True) if label)


def text_rows(model, html_col: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html_col, 4 << 20):
                texts = [article(model.value, page) for page in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    return run


def extract(pages: DataFrame, model: dict, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns, text and n_chars (code points) of each page.

    Character references are decoded, white space within a block becomes one space, blocks of the article are joined
    in page order by one newline. What is never shown (head, script, style, template) is no block.

    Null and empty pages, and pages without an article, have an empty text. Unclosed and stray tags are allowed; a tag that the page
    cuts off is dropped. Time is linear in the page's length.
    Rows are judged alone, so repeated rows are alike; columns in keep named text or n_chars give way.
    """
    limit_batches(pages.sparkSession)
    keep = [c for c in keep if c not in ("text", "n_chars")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema], "text string"])
    source = pages.select(*keep, F.col(html_col).alias("__html"))
    out = source.mapInArrow(text_rows(pages.sparkSession.sparkContext.broadcast(model), "__html", keep), schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return extract(table(spark, sf_dir, "pages"), train())
