"""Operator 2: main text of web pages by the maximum-scoring run of tokens.

A page is read once into tokens: words, opening and closing tags. A word's score is its log-odds of being
content, from the features of the elements that hold it (tags, words of class, id and role, links, cue phrases
of short blocks); a tag's score is never above 0. All weights are fitted to the labelled pages of ``layouts``:
logistic regression for words, log-odds for tags. An element that its own features make unlikely to be content
(menu, footer, advert, form, comments and the like) is one token with a bounded negative score, so content goes
on behind it. A linear scan finds the contiguous run with the largest sum; the text of that run, unlikely
elements left out, is the result. A name that marks such an element counts as another feature (also with its own
weight) where the element wraps the page's content: its first article or heading and a quarter of its words, or most of them.

One pass over the pages, no shuffle; no page depends on another.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.layouts import LAYOUTS
from kindred.llm.tables import table

_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_STOP = re.compile("[>\"']")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe svg object canvas title textarea select button audio video".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _tag_end(page: str, at: int) -> int:
    """Behind the ``>`` that ends a tag; quoted ones are passed over, and a quote that nothing closes is a character like others."""
    while m := _STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        closing = page.find(m[0], at)
        at = closing + 1 if closing >= 0 else at
    return len(page)


def _cut(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, kind, name, attributes)`` of all markup in page order, in one pass that never goes back.

    kind: "<" and ">" tags, "x" an element with all that it holds, "" comments and declarations.
    """
    at, n = 0, len(page)
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else n
            yield i, at, "", "", ""
        elif page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i + 2)
            at = end + 1 if end >= 0 else n
            yield i, at, "", "", ""
        elif not (m := _NAME.match(page, i)):
            at = i + 1
        else:
            at = _tag_end(page, m.end())
            name, attrs = m[2].lower(), page[m.end() : at].removesuffix(">")
            if name in RAW and not m[1]:
                if not attrs.endswith("/"):
                    end = _RAW_END[name].search(page, at)
                    at = end.end() if end else n
                yield i, at, "x", name, attrs
            else:
                yield i, at, ">" if m[1] else "<", name, attrs


#: One attribute after another: name, then value if it has one. What a value holds is never taken for a name.
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose text is a block of its own.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that need no end tag, and the starts that end them.
ENDED_BY = {"p": BLOCKS - {"td", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: By start: the elements that it ends.
_ENDS = {name: [old for old, by in ENDED_BY.items() if name in by] for name in BLOCKS}
_OPTIONAL = frozenset([*ENDED_BY, "html", "body", "head", "tbody", "thead", "tfoot"])
#: Words of class, id and role that a name must end in to mark something else than content, and words that may stand behind them.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead topbar "
    "comment comments respond replies disqus discussion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations pagination pager widget toolbar search contentinfo complementary copyright skip outbrain taboola".split()
)
HOLDERS = frozenset("area articles bar block body box button buttons col column container content form group holder icons inner item items left link links list news panel posts region right row section slot stories text thread title top unit wrap wrapper".split())
NOT = frozenset("with has have no not without hide".split())
CONTENT = frozenset("article content entry main post story text body".split())
#: Phrases of short blocks that are no part of an article.
CUE = re.compile(r"\b(?:sign up (?:for|to)|subscribe (?:to|now)|our newsletter|we use cookies|all rights reserved|follow us|share this|leave a (?:comment|reply)|privacy policy|terms of (?:use|service))\b|©|\(c\) \d{4}", re.I)
CUE_WORDS = 25
_PLAIN = frozenset("nav footer aside form dialog menu fieldset header a li td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dd dt label address small article main".split())
_MARKING = frozenset("nav footer aside form dialog menu fieldset header hint".split())


def _hint(value: str) -> bool:
    """Whether one of the names in a class, id or role marks something else than content."""
    for name in value.split():
        parts = [x.lower() for x in _PART.findall(name)]
        while len(parts) > 1 and parts[-1] in HOLDERS and parts[-1] not in HINTS:
            parts.pop()
        if parts and parts[-1] in HINTS and not NOT & set(parts[:-1]):
            return True
    return False


def own_features(name: str, attrs: str) -> set[str]:
    """Features of an element by itself. Nothing but class, id, role, hidden, aria-hidden and style is looked at."""
    out = {name} if name in _PLAIN else set()
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.add("hidden")
        if key in ("class", "id", "role"):
            if name not in ("html", "body") and _hint(value):
                out.add("hint")
            elif CONTENT & {x.lower() for x in _PART.findall(value)}:
                out.add("content")
    return out


class Page:
    """Elements (name, parent, features, words of their own text and below) and tokens (kind, text or name, element) in page order.

    kind: "t" text, "<" and ">" tags, "x" an element that never holds text (script and the like), "br" a line break.
    """

    def __init__(self, page: str):
        unclosed = self._parse(page, {})
        # one that was never closed ends where content starts: the page is read again with these ends
        content, stop = [0] * (len(self.name) + 1), 0
        for c in range(len(self.name) - 1, 0, -1):
            content[c + 1] = stop
            stop = c if self.name[c] in ("article", "main", "h1") and "hint" not in self.features[c] else stop
        ends: dict[int, list[int]] = {}
        for e in unclosed:
            if self.features[e] & _MARKING and e < content[e + 1] < self.upto[e]:
                ends.setdefault(content[e + 1], []).append(e)
        if ends:
            self._parse(page, ends)
        self._settle()

    def _parse(self, page: str, ends: dict[int, list[int]]) -> list[int]:
        """Elements and tokens of a page; those that nothing closed though they need it come back. ``ends``: elements that end where another one starts."""
        self.name, self.parent, self.features, self.words, self.upto = [""], [-1], [set()], [0], [0]
        self.tokens: list[tuple[str, str, int]] = []
        unclosed: list[int] = []
        #: open elements, the places of each name among them, and of those that need an end tag and hold blocks
        open_, place, walls = [0], {}, [0]

        def close(k: int, ended: bool) -> None:
            gone = open_[k:]
            del open_[k:]
            while len(walls) > 1 and walls[-1] >= k:
                walls.pop()
            for e in gone:
                self.upto[e] = len(self.name)
                place[self.name[e]].pop()
            unclosed.extend(e for e in gone[ended:] if self.name[e] not in _OPTIONAL)

        at = 0
        for start, end, kind, name, attrs in _cut(page):
            if start > at:
                self._text(page[at:start], open_[-1])
            at = end
            if kind == "x":
                self.tokens.append(("x", "", open_[-1]))
            elif kind == ">":
                if place.get(name):
                    close(place[name][-1], True)
                self.tokens.append((">", name, open_[-1]))
            elif kind and name in VOID:
                self.tokens.append(("br" if name == "br" else "<", name, open_[-1]))
            elif kind:
                e = len(self.name)
                # elements are numbered as they start, so open ones stand in order
                here = [k for old in ends.get(e, ()) if (k := bisect_left(open_, old)) < len(open_) and open_[k] == old]
                if here:
                    close(min(here), True)
                # an element of the kind that this start ends, not beyond an element that must be closed
                k = max((place[old][-1] for old in _ENDS.get(name, ()) if place.get(old)), default=0)
                if k > walls[-1]:
                    close(k, True)
                self.name.append(name)
                self.parent.append(open_[-1])
                self.features.append(own_features(name, attrs))
                self.words.append(0)
                self.upto.append(0)
                self.tokens.append(("<", name, e))
                if attrs.endswith("/"):
                    self.upto[e] = e + 1
                else:
                    place.setdefault(name, []).append(len(open_))
                    if name in BLOCKS and name not in ENDED_BY:
                        walls.append(len(open_))
                    open_.append(e)
        if at < len(page):
            self._text(page[at:], open_[-1])
        close(1, False)
        self.upto[0] = len(self.name)
        return unclosed

    def _text(self, text: str, e: int) -> None:
        self.tokens.append(("t", text, e))
        self.words[e] += len(text.split())

    def _settle(self) -> None:
        """Features as they stand in the page, words below each element, and for each element the features of all that hold it."""
        n = len(self.name)
        for e in range(n - 1, 0, -1):
            self.words[self.parent[e]] += self.words[e]
        marks = [e for e in range(1, n) if self.name[e] in ("main", "article") and "hint" not in self.features[e]]
        heads = [e for e in range(1, n) if self.name[e] == "h1"]
        inner = [False] * n
        self.held: list[frozenset] = [frozenset()] * n
        known: dict[frozenset, frozenset] = {}
        for e in range(1, n):
            p = self.parent[e]
            inner[e] = inner[p] or self.name[e] in ("main", "article")
            own = self.features[e]
            if "header" in own and inner[p]:
                own = (own - {"header"}) | {"inner header"}
            if own & _MARKING:
                mark = marks[:1] or ([] if own & _MARKING == {"header"} else heads[:1])
                around = e < mark[0] < self.upto[e] and self.words[e] * 4 > self.words[0] if mark else self.words[e] * 5 > self.words[0] * 3
                if around and self.name[e] not in ("main", "article"):
                    own = {f"{f} around" if f in _MARKING else f for f in own}
            self.features[e] = own
            both = self.held[p] | own
            self.held[e] = known.setdefault(both, both)

    def blocks(self) -> tuple[set[int], set[int]]:
        """Positions of the texts of short blocks that hold a cue phrase; and of links (tags and texts) in blocks of mostly other words."""
        cues: set[int] = set()
        prose: set[int] = set()
        texts: list[int] = []
        links: list[int] = []
        for i, (kind, what, e) in enumerate([*self.tokens, ("<", "p", 0)]):
            if kind == "t":
                (links if "a" in self.held[e] else texts).append(i)
            elif what == "a":
                links.append(i)
            elif kind == "br" or kind in "<>" and what in BLOCKS:
                if texts or links:
                    words = sum(len(self.tokens[j][1].split()) for j in texts)
                    linked = sum(len(self.tokens[j][1].split()) for j in links if self.tokens[j][0] == "t")
                    if linked < words:
                        prose.update(links)
                    if 0 < words + linked <= CUE_WORDS:
                        both = [j for j in sorted(texts + links) if self.tokens[j][0] == "t"]
                        if CUE.search(" ".join(self.tokens[j][1] for j in both)):
                            cues.update(both)
                texts, links = [], []
        return cues, prose


def features_at(held: frozenset, cue: bool, prose: bool) -> frozenset:
    """Features of a text: a link amid other words is no link, and inside what is marked as content a phrase is no cue."""
    held = held - {"a"} if prose else held
    return held | {"cue"} if cue and not held & {"article", "main", "content"} else held


class Weights:
    """``word``: features (and "" for any word) to log-odds; ``tag``: names to scores of at most 0; ``other``: of any other tag; ``skip``: of an unlikely element."""

    def __init__(self, word: dict[str, float], tag: dict[str, float]):
        self.word, self.tag = word, tag
        self.other = min(0.0, sum(tag.values()) / max(1, len(tag)))
        self.skip = 3 * self.other
        self.seen: dict[frozenset, float] = {}

    def of(self, features: frozenset) -> float:
        """Score of one word, between -1 and 1."""
        if features not in self.seen:
            z = self.word[""] + sum(self.word.get(f, 0.0) for f in features)
            self.seen[features] = max(-1.0, min(1.0, z / 2))
        return self.seen[features]

    def unlikely(self, own: set[str]) -> bool:
        """Whether an element's own features alone make its words something else than content."""
        return "hidden" in own or bool(own & _MARKING) and self.word[""] + sum(self.word.get(f, 0.0) for f in own if f in _MARKING) < 0


@lru_cache(maxsize=1)
def weights() -> Weights:
    """Fitted to the labelled layouts: the same numbers in every process."""
    rows: Counter = Counter()
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for layout in LAYOUTS:
        layout = layout.replace("{l}", "<a href='/'>w w</a>").replace("{s}", "w " * 9).replace("{p}", "w " * 45)
        spans, plain = [], ""
        for k, part in enumerate(re.split("[«»]", layout)):
            spans.append((len(plain), len(plain) + len(part), k % 2 == 1))
            plain += part
        page = Page(plain)
        (cues, prose), at = page.blocks(), 0
        for i, (kind, what, e) in enumerate(page.tokens):
            # tokens come in page order, so the place of each is found behind the one before
            mark = what if kind == "t" else {"<": "<", ">": "</"}.get(kind, "<") + what
            at = plain.index(mark, at)
            inside = any(a <= at < b and c for a, b, c in spans)
            at += len(mark)
            if kind == "t":
                rows[(features_at(page.held[e], i in cues, i in prose), inside)] += len(what.split())
            elif kind in "<>" and i not in prose:
                tags[inside][what] += 1
    names = ["", *sorted({f for (held, _), n in rows.items() if n for f in held})]
    x = np.array([[f == "" or f in held for f in names] for (held, _), n in rows.items() if n], dtype=float)
    y = np.array([inside for (_, inside), n in rows.items() if n], dtype=float)
    # a long paragraph and a short link are both evidence: the root of the words
    m = np.sqrt(np.array([n for n in rows.values() if n], dtype=float))
    w, ridge = np.zeros(len(names)), np.where(np.array(names) == "", 1e-3, 0.05)
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (m * (p - y)) + ridge * w
        w = w - np.linalg.solve(x.T @ (x * (m * p * (1 - p))[:, None]) + np.diag(ridge + 1e-6), g)
    total_in, total_out = sum(tags[True].values()), sum(tags[False].values())
    odds = {t: np.log((tags[True][t] + 0.5) / (total_in + 1) * (total_out + 1) / (tags[False][t] + 0.5)) for t in {*tags[True], *tags[False]}}
    return Weights(dict(zip(names, w.tolist(), strict=True)), {t: float(max(-1.0, min(0.0, v))) for t, v in odds.items()})


def main_text(page: str | None) -> str:
    """Blocks of the best run, joined by line breaks; "" if a page has no content."""
    if not page:
        return ""
    doc, w = Page(page), weights()
    cues, prose = doc.blocks()
    n = len(doc.name)
    out = [False] * n
    for e in range(1, n):
        out[e] = out[doc.parent[e]] or w.unlikely(doc.features[e])
    best, best_from, best_to, now, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, what, e) in enumerate(doc.tokens):
        if out[e]:
            if kind == "<" and not out[doc.parent[e]] and what == doc.name[e]:
                now += w.skip
        elif kind == "t":
            k = len(what.split())
            if k:
                now += k * w.of(features_at(doc.held[e], i in cues, i in prose))
        elif kind == "x":
            now += w.other
        elif i not in prose:
            now += w.tag.get(what, w.other)
        if now > best:
            best, best_from, best_to = now, start, i + 1
        if now < 0:
            now, start = 0.0, i + 1
    blocks: list[list[str]] = [[]]
    for kind, what, e in doc.tokens[best_from:best_to]:
        if kind == "t":
            if not out[e]:
                blocks[-1].append(what)
        elif kind == "br":
            blocks[-1].append(" ")
        elif what in BLOCKS:
            blocks.append([])
    lines = (" ".join(_html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in the column ``out`` (which it replaces, if there is one).

    A null or empty page gives "", and so does one without content. Long pages are read whole; repeated rows give
    the same text each; other columns, of any names, stay; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x if isinstance(x, str) else None) for x in s], dtype=object)

    return pages.withColumn(out, extract(F.col(html)))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
