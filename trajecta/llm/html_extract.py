"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of words and tags. Words score above zero, tags below, by weights learned from labelled pages; one linear
scan finds the contiguous region with the greatest total, and its blocks are the text. Elements that hold no article text by their
name (menus, footers, forms, scripts ...) or by their class, id or role (adverts, comments, notices ...) are passed over: their words
do not count, and the region may run across them at the price of one learned weight. A class, id or role counts if all words of one of
its space-separated names are in the list ("cookie-notice", but not "no-sidebar"); ids of headings do not, as they are made from the text.
No element but the invisible ones is passed over if article or main begin or end in it; nor is one marked by its class, id or role, or a
form, if it holds a heading and a paragraph after it, unless it stands outside the article or main of a page that has one.

Weights start as log odds of each token in labelled content against the rest and are then corrected by a structured perceptron
until it finds the labelled regions. `labelled_pages` makes labelled pages by a rule, for when there are none from people.

Defined results: null or empty html and pages without words give the empty string; a repeated page gives its text again; a tag that is never closed
ends where its page ends, and an element to be passed over that is never closed is an ordinary tag. Pages are read whole, at any length.
Other columns are kept by `annotate`, but for those with a new name, which it replaces.
"""

from __future__ import annotations

import bisect
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.tables import replaced

# HTML's block elements, elements without end tags, raw text elements, and elements and words that mark what is no article text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PASSED = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe label menu nav noscript object select svg template textarea title video".split())
UNSEEN = frozenset("audio button canvas datalist head iframe object select svg template textarea title video".split())
FORMS = frozenset("fieldset form".split())
MARKED = frozenset("ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond replies disqus cookie cookies consent gdpr notice banner popup modal overlay share sharing social related recommended newsletter subscribe signup login search pagination pager masthead toolbar contentinfo complementary".split())
INLINE = frozenset("abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

RAW = re.compile(r"<(script|style)\b", re.I)
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
# Between a tag's name and its end: spaces, attribute names, and values; a quote opens a value only after the equals sign. Nothing is ever given back.
INSIDE = re.compile(r"(?:[\s/]++|(?:=(?!\s*+[\"']))?+[^\s/>=]++(?:\s*+=\s*+(?![\"'])[^\s>]*+)?+|=++(?!\s*+[\"']))*+")
OPENED = re.compile(r"\s*+=\s*+([\"'])")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Za-z]+")


@dataclass(frozen=True)
class Token:
    """kind: word, link (words inside an anchor), pass (inner if in an article), inline, heading, or another tag's name; text of words; block: whether it ends a block."""

    kind: str
    count: int
    text: str = ""
    block: bool = False


@dataclass(frozen=True)
class Tag:
    """A tag from start to end; name is empty for comments, declarations and whole script and style elements."""

    start: int
    end: int
    close: bool = False
    name: str = ""
    attributes: str = ""


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at `at`, or -1. An unclosed quote ends the tag at the next sign for it."""
    while True:
        at = INSIDE.match(page, at).end()
        if page.startswith(">", at):
            return at + 1
        quote = OPENED.match(page, at)
        if quote is None:
            # An equals sign without a name, before a quote or at the end.
            if at >= len(page):
                return -1
            at += 1
            continue
        end = page.find(quote[1], quote.end())
        if end < 0:
            return page.find(">", quote.end()) + 1 or -1
        at = end + 1


def tags(page: str) -> list[Tag]:
    """All tags, in time linear in the page: what is looked at for a tag is part of it, and without a closing sign further on nothing is a tag."""
    out: list[Tag] = []
    at, last = page.find("<"), page.rfind(">")
    while at >= 0:
        end = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            out.append(Tag(at, end := len(page) if end < 0 else end + 3))
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            out.append(Tag(at, end := len(page) if end < 0 else end + 3))
        elif at < last:
            if page.startswith(("<!", "<?"), at):
                out.append(Tag(at, end := page.index(">", at) + 1))
            elif raw := RAW.match(page, at):
                close = RAW_END[raw[1].lower()].search(page, page.index(">", at) + 1)
                out.append(Tag(at, end := close.end() if close else len(page)))
            elif m := NAME.match(page, at):
                end = _tag_end(page, m.end())
                if end > 0:
                    out.append(Tag(at, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]))
                else:
                    last = at  # nothing after it is a whole tag
        at = page.find("<", end if end > 0 else at + 1)
    return out


def _marked(name: str, attributes: str) -> bool:
    kinds = ("class", "role") if name in HEADINGS else ("class", "id", "role")
    words = (PART.findall(x.lower()) for key, *value in ATTRIBUTE.findall(attributes) if key.lower() in kinds for x in "".join(value).split())
    return any(w and MARKED.issuperset(w) for w in words)


def _within(places: list[int], first: int, last: int) -> int | None:
    """The first of the ascending places between two others."""
    k = bisect.bisect_right(places, first)
    return places[k] if k < len(places) and places[k] < last else None


def tokens(page: str) -> list[Token]:
    """The page's tokens; what lies in a passed element is one token."""
    found = tags(page)
    names = [m.name for m in found]
    # The tag that closes each element, by a stack for each name.
    closes: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for i, (m, name) in enumerate(zip(found, names)):
        if name and name not in VOID:
            stack = stacks.setdefault(name, [])
            if not m.close:
                stack.append(i)
            elif stack:
                closes[stack.pop()] = i
    articles = [i for i, name in enumerate(names) if name in ("article", "main")]
    headings = [i for i, name in enumerate(names) if name in HEADINGS and not found[i].close]
    paragraphs = [i for i, name in enumerate(names) if name == "p" and not found[i].close]

    def passes(i: int, name: str, attributes: str) -> bool:
        if name in UNSEEN:
            return True
        listed = name in PASSED or name == "header" and inside <= 0
        if name in ("html", "body", "article", "main") or not listed and not _marked(name, attributes) or _within(articles, i, closes[i]) is not None:
            return False
        if listed and name not in FORMS or articles and inside <= 0:
            return True
        heading = _within(headings, i, closes[i])
        return heading is None or _within(paragraphs, heading, closes[i]) is None

    out: list[Token] = []
    at, i, links, inside = 0, 0, 0, 0
    while i < len(found):
        m, name = found[i], names[i]
        if text := page[at : m.start]:
            _words(out, text, links)
        at = m.end
        if name:
            if name in ("article", "main"):
                inside += -1 if m.close else 1
            if not m.close and i in closes and passes(i, name, m.attributes):
                out.append(Token("inner" if inside > 0 else "pass", 1, block=True))
                i = closes[i]
                at = found[i].end
            else:
                if name == "a":
                    links = 0 if m.close else 1
                kind = "inline" if name in INLINE else "heading" if name in HEADINGS else name
                out.append(Token(kind, 1, block=name in BLOCKS))
        i += 1
    if text := page[at:]:
        _words(out, text, links)
    return out


def _words(out: list[Token], text: str, links: int) -> None:
    text = html.unescape(text) if "&" in text else text
    out.append(Token("link" if links else "word", len(text.split()), text))


@dataclass(frozen=True)
class Model:
    """Weight of each kind of token; tags that were never seen have `other`."""

    weights: dict[str, float]
    other: float = -2.0

    def region(self, sequence: list[Token]) -> tuple[int, int]:
        """First and last + 1 token of the region with the greatest total, the first of equals; (0, 0) if none is above zero."""
        best, span, total, start = 0.0, (0, 0), 0.0, 0
        for i, t in enumerate(sequence):
            if total <= 0:
                total, start = 0.0, i
            total += self.weights.get(t.kind, self.other) * t.count
            if total > best:
                best, span = total, (start, i + 1)
        return span

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        sequence = tokens(page)
        first, last = self.region(sequence)
        blocks, open_block = [], []
        for t in sequence[first:last]:
            if t.block:
                blocks.append("".join(open_block))
                open_block = []
            elif t.text:
                open_block.append(t.text)
        blocks.append("".join(open_block))
        return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def fit(labelled: list[tuple[list[Token], tuple[int, int]]], rounds: int = 12, rate: float = 0.02) -> Model:
    """Weights from token sequences and their content regions."""
    content, rest = Counter(), Counter()
    for sequence, (first, last) in labelled:
        for i, t in enumerate(sequence):
            (content if first <= i < last else rest)[t.kind] += t.count
    kinds = sorted(content.keys() | rest.keys())
    inside, outside = sum(content.values()) + len(kinds), sum(rest.values()) + len(kinds)
    clip = lambda k, w: max(0.05, w) if k in ("word", "link") else min(-0.2, w)
    weights = {k: clip(k, math.log((content[k] + 1) / inside) - math.log((rest[k] + 1) / outside)) for k in kinds}
    total, n = Counter(), 0
    for _ in range(rounds):
        wrong = 0
        for sequence, (first, last) in labelled:
            a, b = Model(weights).region(sequence)
            if (a, b) != (first, last) and _filled(sequence, a, b) != _filled(sequence, first, last):
                wrong += 1
                step = Counter()
                for i in range(min(a, first), max(b, last)):
                    sign = (first <= i < last) - (a <= i < b)
                    if sign:
                        step[sequence[i].kind] += sign * min(sequence[i].count, 20)
                for k, v in step.items():
                    weights[k] = clip(k, weights[k] + rate * v)
            n += 1
            for k, w in weights.items():
                total[k] += w
        if not wrong:
            return Model(dict(weights))
    return Model({k: clip(k, total[k] / n) for k in kinds})


def _filled(sequence: list[Token], first: int, last: int) -> list[int]:
    """The tokens with words of a region."""
    return [i for i in range(first, last) if sequence[i].count and sequence[i].text.strip()]


def labelled_pages(n: int = 240, seed: int = 7) -> list[tuple[list[Token], tuple[int, int]]]:
    """Pages made by a rule, with their content region: articles of one to twelve blocks among menus, notices, adverts and footers,
    in elements that say what they are and in plain ones."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choices("abcdeiorstn", k=rng.randint(2, 8))) for _ in range(rng.randint(a, b)))
    out = []
    for _ in range(n):
        links = lambda k: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))
        name = rng.choice(["nav", "div", "div"])
        before = f"<html><head><title>{words(3, 9)}</title></head><body><{name}><ul>{links(rng.randint(3, 14))}</ul></{name}>"
        if rng.random() < 0.6:
            before += rng.choice(['<div class="ad">{}</div>', "<div>{}</div>", '<div id="cookie-notice"><p>{}</p></div>']).format(words(3, 10))
        blocks = []
        for _ in range(rng.randint(1, 12)):
            text = words(8, 90) if rng.random() < 0.75 else words(2, 8)
            if rng.random() < 0.2:
                tag = rng.choice(["em", "strong", "span", "code"])
                text += f" <{tag}>{words(1, 3)}</{tag}>{rng.choice(['', ' ' + words(1, 4)])}"
            if rng.random() < 0.3:
                text = f"<b>{text}<br>"
            if rng.random() < 0.25:
                text += f' <a href="/x">{words(1, 3)}</a> {words(2, 20)}'
            blocks.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<h2>{}</h2><p>" + words(15, 60) + "</p>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li><li>" + words(6, 20) + "</li></ul>"]).format(text))
            if rng.random() < 0.15:
                blocks.append(f'<div class="advert">{words(3, 8)}</div><p>{words(2, 30)}</p>')
            if rng.random() < 0.05:
                blocks.append(f"<form><label>{words(1, 3)}</label><input></form><p>{words(3, 30)}</p>")
        outer = rng.choice(["article", "article", "main", "div"])
        content = f"<h1>{words(3, 10)}</h1>" + "".join(blocks)
        after = rng.choice(["", f"<div><ul>{links(rng.randint(2, 8))}</ul></div>", f'<section id="comments"><p>{words(5, 30)}</p></section>'])
        after += rng.choice([f"<footer>&copy; {words(4, 16)}</footer>", f"<div><p>{words(3, 8)}</p></div>"]) + "</body></html>"
        head, middle = tokens(before + f"<{outer}>"), tokens(before + f"<{outer}>{content}")
        whole = tokens(before + f"<{outer}>{content}</{outer}>" + after)
        if whole[: len(middle)] == middle:
            out.append((whole, (len(head), len(middle))))
    return out


def default_model() -> Model:
    return fit(labelled_pages())


def annotate(pages: DataFrame, model: Model, *, column: str = "html", name: str = "text", size: str = "n_chars") -> DataFrame:
    """pages without the html column, with the text and its number of code points."""
    pages = pages if column in (name, size) else replaced(pages, [name, size], column)
    rest = [f for f in pages.schema.fields if f.name not in (column, name, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = batch.slice(start, 200)
                texts = [model.extract(x) for x in rows.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in rest), name, size])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return pages.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{column}`").alias("_html")).mapInArrow(run, f"{fields}`{name}` string, `{size}` long")
