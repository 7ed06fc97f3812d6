"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page, decoded by Viterbi."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that part blocks, that have no end, and whose content is no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend "
    "li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that say what they hold; others do so by their names only.
LANDMARKS = frozenset("article aside body footer form header main menu nav search".split())
RAW = frozenset("script style template svg math noembed noframes object audio video canvas map".split())
#: Elements that an opening tag closes, where nothing but such elements stands between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"),
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*+>?", re.S)
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMES = re.compile(r"""[\s"'](?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。]")

#: Words of a page's own furniture; a block's feature when it has one.
FURNITURE = frozenset(
    "cookie cookies copyright subscribe newsletter login register share comment comments reply replies menu search privacy policy terms rights reserved advertisement sponsored related previous next home contact "
    "follow accept password email posted".split()
)


@dataclass(frozen=True)
class Block:
    text: str
    features: tuple[str, ...]


def _names(attributes: str) -> set[str]:
    found = set()
    for match in _NAMES.finditer(attributes):
        found.update(f"c:{part}" for part in _PART.findall((match[1] or match[2] or match[3] or "").lower()))
    return found


def _size(n: int) -> int:
    return min(n.bit_length(), 8)


def _shape(text: str, linked: int) -> list[str]:
    """Features of a block's text: words, sentence marks, links, capitals, digits, how it begins and ends, words of furniture."""
    words = text.split()
    n, chars = len(words), len(text)
    found = [f"w:{_size(n)}", f"s:{_size(len(_SENTENCE.findall(text)))}", f"l:{4 * linked // chars}", f"e:{text[-1] if not text[-1].isalnum() else 'a'}"]
    if linked:
        found.append("link")
    head = text[0]
    found.append("b:" + ("u" if head.isupper() else "d" if head.isdigit() else "a" if head.isalpha() else head))
    if n <= 40:
        digits = sum(c.isdigit() for c in text)
        found.append(f"d:{4 * digits // chars}")
        own = {w.strip(".,:;!?()").lower() for w in words} & FURNITURE
        if own:
            found.append("furniture")
            found += [f"k:{w}" for w in sorted(own)]
    if "©" in text or "\N{WHITE BULLET}" in text or " | " in text:
        found.append("mark")
    return found


def leaf_blocks(html: str) -> list[Block]:
    """The page's leaf blocks in order: text between tags of block elements, references decoded, white space one space.

    Features name all tags, classes, ids and roles that enclose a block, those of the nearest element that is named or says what it holds, the
    block's own element, and the shape of its text. Unclosed and
    misplaced tags are taken as browsers take them where that decides about blocks; anything can be parsed, in linear time.
    """
    blocks: list[Block] = []
    open_: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []  # element, sorted features of it and of all around it, the nearest landmark's
    count: Counter[str] = Counter()
    pieces: list[str] = []
    linked, in_link, broken = 0, False, False
    at, end = 0, len(html)
    lower = ""

    def close() -> None:
        nonlocal linked, in_link
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                tag, around, nearest = open_[-1] if open_ else ("", (), ())
                blocks.append(Block(text, (*around, *nearest, f"p:{tag}", *_shape(text, min(linked, len(text))))))
            pieces.clear()
        linked, in_link = 0, False

    def pop_to(names: tuple[str, ...]) -> None:
        while open_:
            tag = open_.pop()[0]
            count[tag] -= 1
            if tag in names:
                return

    while at < end:
        match = _TAG.search(html, at)
        if match is None:
            pieces.append(html[at:])
            break
        if match.start() > at:
            piece = html[at : match.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        rest = None if broken else _REST.match(html, at)
        begin = at
        if rest is None:  # a quote is never closed: from here on tags end at the next >
            broken = True
            at = html.find(">", at) + 1 or end
        else:
            at = rest.end()
        if match[1]:
            if name in BLOCKS:
                close()
                if count[name]:
                    pop_to((name,))
            elif name == "a":
                in_link = False
            continue
        if name in RAW:
            lower = lower or html.lower()
            if len(lower) != end:  # some capitals have longer small forms
                lower = re.sub("[A-Z]", lambda m: m[0].lower(), html)
            stop = lower.find(f"</{name}", at)
            at = stop if stop >= 0 else end
            continue
        if name == "a":
            in_link = True
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCKS:
            close()
            if count["p"] and open_[-1][0] == "p":
                pop_to(("p",))
            for other in CLOSES.get(name, ()):
                if count[other]:
                    k = len(open_) - 1
                    while k >= 0 and open_[k][0] != other and (open_[k][0] == "p" or open_[k][0] in CLOSES[name]):
                        k -= 1
                    if k >= 0 and open_[k][0] == other:
                        pop_to((other,))
            if name not in VOID:
                _, around, nearest = open_[-1] if open_ else ("", (), ())
                named = _names(html[begin - 1 : at]) if at - begin > 4 else set()
                if named or name in LANDMARKS:
                    nearest = (f"n:{name}", *(f"n{x}" for x in sorted(named)))
                own = named | {f"a:{name}"}
                open_.append((name, around if own.issubset(around) else tuple(sorted(own.union(around))), nearest))
                count[name] += 1
    close()
    return blocks


@dataclass(frozen=True)
class Extractor:
    """Weights for main text (label 1) against the rest: of features, of the first and last block, and of pairs of labels in a row."""

    weights: dict[str, float]
    ends: np.ndarray  # (2, 2): first and last block, by label
    steps: np.ndarray  # (2, 2): from label to label

    def labels(self, blocks: list[Block]) -> list[int]:
        """The most likely labels (Viterbi); of equal ones the rest comes first."""
        return viterbi([sum(self.weights.get(f, 0.0) for f in b.features) for b in blocks], self.ends, self.steps)


def viterbi(scores: list[float], ends: np.ndarray, steps: np.ndarray) -> list[int]:
    if not scores:
        return []
    (s00, s01), (s10, s11) = steps.tolist()
    (first, last), back = ends.tolist(), []
    a, b = first[0], first[1] + scores[0]
    for score in scores[1:]:
        to0, to1 = b + s10 > a + s00, b + s11 > a + s01
        back.append((to0, to1))
        a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + score
    label = b + last[1] > a + last[0]
    out = [int(label)]
    for steps_back in reversed(back):
        label = steps_back[label]
        out.append(int(label))
    return out[::-1]


def chances(scores: np.ndarray, ends: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(each block's chance of the labels, of the pairs of labels in a row, the logarithm of the sum over all labellings)."""
    n = len(scores)
    unary = np.stack([np.zeros(n), scores], 1)
    unary[0] += ends[0]
    unary[-1] += ends[1]
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = unary[0]
    for i in range(1, n):
        forward[i] = unary[i] + np.logaddexp(forward[i - 1, 0] + steps[0], forward[i - 1, 1] + steps[1])
    for i in range(n - 2, -1, -1):
        after = unary[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(steps[:, 0] + after[0], steps[:, 1] + after[1])
    total = float(np.logaddexp(*forward[-1]))
    pairs = np.exp(forward[:-1, :, None] + steps + (unary + backward)[1:, None, :] - total)
    return np.exp(forward + backward - total), pairs, total


def train_crf(pages: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = 12, rate: float = 0.1, l2: float = 1e-5) -> Extractor:
    """Maximum likelihood by gradient steps with running moments (Adam), a page at a time, in the given order, `epochs` times; the rate falls to 0."""
    names = {f: k for k, f in enumerate(sorted({f for blocks, _ in pages for own in blocks for f in own}))}
    coded = [([np.array([names[f] for f in own]) for own in blocks], np.array(labels)) for blocks, labels in pages if blocks]
    n = len(names)
    values = np.zeros(n + 8)  # weights of features, then ends and steps
    mean, square = np.zeros(n + 8), np.zeros(n + 8)
    turn, turns = 0, epochs * len(coded)
    for _ in range(epochs):
        for blocks, labels in coded:
            w, ends, steps = values[:n], values[n : n + 4].reshape(2, 2), values[n + 4 :].reshape(2, 2)
            sizes, every = [len(own) for own in blocks], np.concatenate(blocks)
            chance, pairs, _ = chances(np.add.reduceat(w[every], np.cumsum([0, *sizes[:-1]])), ends, steps)
            wrong = np.eye(2)[labels] - chance
            real = np.zeros((2, 2))
            np.add.at(real, (labels[:-1], labels[1:]), 1)
            grad = np.concatenate([np.bincount(every, np.repeat(wrong[:, 1], sizes), n), wrong[0], wrong[-1], (real - pairs.sum(0)).ravel()]) - l2 * values
            turn += 1
            mean += (grad - mean) * 0.1
            square += (grad * grad - square) * 0.001
            values += rate * (1 - turn / turns) * mean / (1 - 0.9**turn) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    return Extractor({f: float(values[k]) for f, k in names.items() if values[k]}, values[n : n + 4].reshape(2, 2), values[n + 4 :].reshape(2, 2))


def fit_extractor(labelled: DataFrame, max_train_pages: int = 400) -> Extractor:
    """The model from at most `max_train_pages` labelled pages: html, and main, the page's main text with a line a block.

    A block is main text where its text is one of main's lines, in order. Pages are taken in the order of a checksum of their html;
    those with null in either column are left out, and without pages all blocks count as rest. Their blocks are cut and
    named in tasks; only the features of the bounded sample reach the driver.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [leaf_blocks(h.as_py()) for h in batch.column(0)]
            marks = [mark_blocks(own, m.as_py()) for own, m in zip(cut, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([[list(b.features) for b in own] for own in cut], pa.list_(pa.list_(pa.string()))), pa.array(marks, pa.list_(pa.int32()))], names=["features", "labels"])

    order = F.crc32(F.col("html").cast("binary"))
    sample = labelled.where("html is not null and main is not null").select("html", "main", order.alias("turn")).orderBy("turn", "html").limit(max_train_pages)
    rows = sample.select("html", "main").mapInArrow(blocks, "features array<array<string>>, labels array<int>").collect()
    return train_crf([([tuple(own) for own in r["features"]], r["labels"]) for r in rows])


def mark_blocks(blocks: list[Block], main: str) -> list[int]:
    """1 for the blocks whose texts are, one after the other, the lines of main; where they can be aligned in several ways, the last.

    So a heading is main text, and not the page's title before it.
    """
    lines = [x for x in (" ".join(x.split()) for x in main.split("\n")) if x]
    out = []
    for block in reversed(blocks):
        hit = bool(lines) and block.text == lines[-1]
        out.append(int(hit))
        if hit:
            lines.pop()
    return out[::-1]


def extract_main(pages: DataFrame, model: Extractor) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html): the blocks that the model holds for main text, a line each.

    Null and empty pages, and pages without main text, give an empty text. Rows are judged apart, so repeated rows and ids give equal
    results; null ids and urls pass through; other columns are left out, so none can clash. A page is parsed whole, in linear
    time and memory. The model, of bounded size, travels with the task.
    """
    plain = (model.weights, model.ends.tolist(), model.steps.tolist())  # no class of the library, which executors may lack
    shipped = pages.sparkSession.sparkContext.broadcast(plain)  # features of a bounded sample of pages

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, ends, steps = shipped.value
        own = Extractor(weights, np.array(ends), np.array(steps))
        for batch in batches:
            texts = []
            for html in batch.column(2):
                blocks = leaf_blocks(html.as_py() or "")
                texts.append("\n".join(b.text for b, label in zip(blocks, own.labels(blocks), strict=True) if label))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())], names=["page_id", "url", "text"])

    found = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


# Names of parts of pages, as authors of pages choose them, for the labelled pages.
_MAIN = ["content", "post", "entry", "story", "body", "text", "main", "article-body", "post-content", "entry-content", "page", "single"]
_FURNITURE = {
    "menu": (["nav", "div", "ul"], ["menu", "nav", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "toc", "topbar", "pagination", "pager"], ["navigation", "menubar"]),
    "header": (["header", "div"], ["header", "masthead", "site-header", "banner", "branding", "logo", "tagline", "top"], ["banner"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "legal", "bottom", "colophon", "credits"], ["contentinfo"]),
    "side": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recent-posts", "tags", "archive", "recommended", "popular", "more"], ["complementary"]),
    "notice": (["div", "section", "p"], ["cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "message", "warning", "disclaimer"], ["alert", "dialog"]),
    "advert": (["div", "aside", "section", "p"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adsbox", "banner-ad", "ad-slot"], ["complementary"]),
    "form": (["form", "div", "fieldset"], ["newsletter", "subscribe", "search", "login", "signup", "contact-form", "form"], ["search", "form"]),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "comment", "responses", "replies", "discussion", "disqus", "reply", "reader-comments"], ["feed"]),
    "share": (["div", "ul", "p"], ["share", "social", "share-buttons", "follow", "toolbar", "meta"], ["toolbar"]),
}
_SAYINGS = {
    "notice": ["We use cookies to improve this site.", "By reading on you accept our cookie policy.", "This page is kept in our archive.", "Accept"],
    "footer": ["© 2024 All rights reserved.", "Privacy policy · Terms", "Copyright the authors."],
    "form": ["Email", "Password", "Search", "Subscribe", "Subscribe to our newsletter."],
    "comments": ["3 comments", "Reply", "posted at 12:30"],
    "share": ["Share", "Follow us", "Print | Email"],
}


class _Layout:
    """One labelled page: a layout drawn from a checksum's digits, filled with given sentences."""

    def __init__(self, seed: int, sentences: list[str]):
        self.draw = np.random.default_rng(seed)
        self.sentences, self.main, self.said = sentences, [], set()
        self.semantic = self.draw.random() < 0.6  # else parts are told by names alone, or not at all
        self.named = self.draw.random() < 0.85 or not self.semantic and self.draw.random() < 0.5

    def say(self, least: int, most: int) -> str:
        n = int(self.draw.integers(least, most + 1))
        words = " ".join(self.sentences[i] for i in self.draw.integers(0, len(self.sentences), max(1, n // 8))).split()[:n]
        while " ".join(words) in self.said:  # no text stands twice, so that labels are certain
            words.append(self.sentences[int(self.draw.integers(len(self.sentences)))].split()[0])
        self.said.add(" ".join(words))
        return " ".join(words).replace("&", "&amp;").replace("<", "&lt;")

    def pick(self, of: list[str]) -> str:
        return of[int(self.draw.integers(len(of)))]

    def mark(self, kind: str, inside: bool) -> tuple[str, str]:
        tags, names, roles = _FURNITURE[kind]
        tag = tags[0] if self.semantic else self.pick(tags[1:])
        named = self.named or tag not in LANDMARKS and (inside or self.draw.random() < 0.9)  # inside the main text nothing else would tell
        key = "class" if self.draw.random() < 0.7 else "id"
        more = f' {key}="{self.pick(names)}"' if named else ""
        more += f' role="{self.pick(roles)}"' if self.draw.random() < 0.15 else ""
        return f"<{tag}{more}>", f"</{tag}>"

    def block(self, tag: str, text: str, main: bool) -> str:
        if main:
            if " " in text and self.draw.random() < 0.15:
                text = text.replace(" ", f" {self.pick(sorted(FURNITURE))} ", 1)  # such words stand in main text as well
            self.main.append(" ".join(unescape(text).split()))
            words = text.split(" ")
            if len(words) > 6 and self.draw.random() < 0.25:
                k = int(self.draw.integers(1, len(words) - 3))
                words[k : k + 2] = [f'<a href="/x">{" ".join(words[k : k + 2])}</a>']
                text = " ".join(words)
        shape = self.draw.random()
        if shape < 0.1 and tag == "p":
            return f"<p><b>{text}<br>"
        return f"<{tag}>{text}" if shape < 0.2 and tag in ("p", "li") else f"<{tag}>{text}</{tag}>"

    def furniture(self, kind: str, inside: bool = False) -> str:
        before, after = self.mark(kind, inside)
        own = []
        if kind in ("menu", "side", "share") or kind == "footer" and self.draw.random() < 0.4:
            own = [f'<li><a href="/{k}">{self.say(1, 4)}</a></li>' for k in range(int(self.draw.integers(2, 8)))]
            own = own if before.startswith(("<ul", "<ol")) else ["<ul>", *own, "</ul>"]
        if kind in ("advert", "header", "comments", "side", "footer", "notice", "form") and self.draw.random() < 0.8:
            for _ in range(int(self.draw.integers(1, 4))):
                own.append(self.block(self.pick(["p", "div", "p"]), self.say(2, 60 if kind == "comments" else 25), False) if not before.startswith("<p") else self.say(2, 25))
        if kind in _SAYINGS and (self.draw.random() < 0.6 or not own):
            saying = self.pick(_SAYINGS[kind])
            own.insert(0, saying if before.startswith("<p") else f"<button>{saying}</button>" if kind == "form" else f"<p>{saying}</p>")
        return before + "".join(own or [self.say(2, 12)]) + after

    def page(self) -> tuple[str, str]:
        tag = self.pick(["article", "main", "article"]) if self.semantic else self.pick(["div", "div", "td", "section"])
        name = f' class="{self.pick(_MAIN)}"' if self.draw.random() < (0.4 if self.semantic else 0.6) else ""
        article = [f"<{tag}{name}>"]
        title = self.say(1, 14)
        article.append(self.block("h1", title, True) if self.draw.random() < 0.8 else f"<header>{self.block('h1', title, True)}</header>")
        inner = [k for k in ("advert", "form", "side", "share", "menu", "notice") if self.draw.random() < 0.12]
        for k in range(int(self.draw.integers(1, 12))):
            if inner and self.draw.random() < 0.3:
                article.append(self.furniture(inner.pop(), True))
            kind = self.draw.random()
            if kind < 0.08:
                article.append("<ul>" + "".join(self.block("li", self.say(2, 20), True) for _ in range(3)) + "</ul>")
            elif kind < 0.13:
                article.append("<blockquote>" + self.block("p", self.say(5, 40), True) + "</blockquote>")
            else:
                article.append(self.block("h2" if kind > 0.92 else "p", self.say(1, 10 if kind < 0.3 or kind > 0.92 else 150), True))
        if self.draw.random() < 0.25:
            article.append(self.furniture("comments", True))
        article.append(f"</{tag}>")
        outer = {k: self.furniture(k) for k in _FURNITURE if k == "comments" and self.draw.random() < 0.25 or k != "comments" and self.draw.random() < 0.45}
        after = [k for k in ("share", "comments", "side", "form", "footer") if k in outer]
        head = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>"
        return head + "".join(x for k, x in outer.items() if k not in after) + "".join(article) + "".join(outer[k] for k in after), "\n".join(self.main)


def labelled_pages(pages: DataFrame, n_pages: int = 400) -> DataFrame:
    """(html, main): at most `n_pages` labelled pages, whose layouts follow from a checksum and whose words are those of given pages.

    A given page (the first by checksum of their ids and html; null and wordless ones are left out) lends its sentences, furniture and all, to
    one labelled page. So the labels are known without anybody's reading pages, and no layout of the given pages is used.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in batch.column(0):
                text = html.as_py()
                sentences = [x for x in re.split(r"(?<=[.!?])\s", " ".join(b.text for b in leaf_blocks(text))) if x]
                if sentences:
                    rows.append(_Layout(zlib.crc32(text.encode("utf-8", "replace")), sentences).page())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["html", "main"])

    turn = F.crc32(F.concat_ws(" ", F.lit("labelled"), F.col("page_id").cast("string"), F.length("html").cast("string")).cast("binary"))
    turned = pages.where("html is not null").select("html", turn.alias("turn"))
    last = turned.select("turn").orderBy("turn").limit(n_pages).agg(F.max("turn")).first()[0]  # numbers meet first, and pages up to the last one then
    sample = turned.where(F.col("turn") <= F.lit(-1 if last is None else last)).orderBy("turn", F.length("html"), "html").limit(n_pages)
    return sample.select("html").mapInArrow(made, "html string, main string")
