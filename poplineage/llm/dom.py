"""HTML as a flat tree: elements and text runs with their parents, in page order, and features of each node."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import log1p

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_LETTERS = re.compile("[a-z]+")
_MARKS = re.compile("[.,;:!?]")

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "#text a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
UNSEEN = frozenset("head script style template noscript iframe object svg math canvas audio video select option datalist textarea title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
    "body": frozenset(["head"]),
}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "body": ("html",)}
#: Parameters: tags and attribute words that often mark what belongs to an article and what does not.
GOOD_TAGS = frozenset(["article", "main"])
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset button".split())
GOOD_WORDS = frozenset("article content post entry body text story main prose".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu header masthead banner footer sidebar aside widget ad ads advert advertisement sponsor sponsored promo"
    " promotion cookie cookies consent notice alert warning popup modal overlay comment comments reply replies respond form search"
    " newsletter subscribe signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar"
    " copyright legal disclaimer hidden".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
FEATURES = (
    "good_tag bad_tag heading paragraph item link box run good_words bad_words within_good within_bad_tag within_bad_words depth"
    " text links tags marks siblings place alike sibling_text parent_text parent_links before share"
).split()


class Page:
    """The nodes of one page. ``parts`` are the text runs (node numbers) with None where a block begins or ends."""

    def __init__(self, html: str):
        self.parent, self.tag, self.words, self.text = [-1], ["#page"], [()], [""]
        self.parts: list[int | None] = []
        self.open: Counter[str] = Counter()  # open elements by name, so that a tag that ends nothing is told at once
        stack, at, size = [0], 0, len(html)
        while at < size:
            found = _TAG.search(html, at)
            start = found.start() if found else size
            if start > at:
                self._run(stack[-1], html[at:start])
            if not found:
                break
            at = found.end()
            name = found["name"] or found["name2"]
            if not name:
                continue
            name = name.lower()
            if found["end"] or found["end2"]:
                self._close(stack, name)
                continue
            self._make_room(stack, name)
            if name not in INLINE:
                self.parts.append(None)
            node = self._add(stack[-1], name, self._words(found["attributes"] or found["attributes2"] or ""))
            if name in VOID or (found["attributes"] or "").endswith("/"):
                continue
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(html, at)
                at = end.start() if end else size
                if not end:
                    continue
            stack.append(node)
            self.open[name] += 1

    def _add(self, parent: int, tag: str, words: tuple[str, ...], text: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        return len(self.parent) - 1

    def _run(self, parent: int, raw: str) -> None:
        text = unescape(raw)
        if text.strip():
            self.parts.append(self._add(parent, "#text", (), text))
        else:
            self.parts.append(-1)  # white space between words

    @staticmethod
    def _words(attributes: str) -> tuple[str, ...]:
        if not attributes:
            return ()
        return tuple(w for value in _NAMED.findall(attributes) for w in _LETTERS.findall(value.lower()))

    def _pop_to(self, stack: list[int], depth: int) -> None:
        if any(self.tag[n] not in INLINE for n in stack[depth:]):
            self.parts.append(None)
        self.open.subtract(self.tag[n] for n in stack[depth:])
        del stack[depth:]

    def _close(self, stack: list[int], name: str) -> None:
        """Ends the nearest open element of the name; an inline one only up to the block around it."""
        if not self.open[name]:
            return None
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                return self._pop_to(stack, depth)
            if name in INLINE and tag not in INLINE:
                return None
        return None

    def _make_room(self, stack: list[int], name: str) -> None:
        """Ends what the new element ends without a tag: a paragraph before a block, an item before an item."""
        closes, holds = CLOSES.get(name), HOLDS.get(name, ())
        if closes is None:
            if name in INLINE or name in VOID:
                return
            closes, holds = frozenset(["p"]), ("td", "th", "li", "div", "article", "section", "body", "button")
        if not any(self.open[tag] for tag in closes):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in closes:
                return self._pop_to(stack, depth)
            if tag in holds:
                return

    def seen(self) -> list[bool]:
        """Whether a node is drawn at all."""
        out = [True]
        for node in range(1, len(self.parent)):
            out.append(out[self.parent[node]] and self.tag[node] not in UNSEEN)
        return out

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent, tags = self.parent, self.tag
        text, links, inner, marks, children = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
        place, depth, before, alike = [0] * n, [0] * n, [0] * n, [0] * n
        good, bad_tag, bad_words = [False] * n, [False] * n, [False] * n
        own_good, own_bad, kinds = [0] * n, [0] * n, {}
        total = 0
        seen = self.seen()
        for k in range(1, n):
            p, words = parent[k], self.words[k]
            depth[k], place[k], before[k] = depth[p] + 1, children[p], total
            children[p] += 1
            kinds[p, tags[k]] = kinds.get((p, tags[k]), 0) + 1
            if words:
                own_good[k], own_bad[k] = sum(w in GOOD_WORDS for w in words), sum(w in BAD_WORDS for w in words)
            good[k] = good[p] or tags[k] in GOOD_TAGS or own_good[k] > 0
            bad_tag[k] = bad_tag[p] or tags[k] in BAD_TAGS
            bad_words[k] = bad_words[p] or own_bad[k] > 0
            if self.text[k] and seen[k]:
                text[k] = len(self.text[k])
                marks[k] = len(_MARKS.findall(self.text[k]))
                total += text[k]
        for k in range(n - 1, 0, -1):
            p = parent[k]
            if tags[k] == "a":
                links[k] = text[k]
            text[p] += text[k]
            links[p] += links[k]
            inner[p] += inner[k]
            marks[p] += marks[k]
        rows = []
        for k in range(n):
            p, tag = max(0, parent[k]), tags[k]
            around = max(1, children[p] - 1)
            rows.append(
                (
                    tag in GOOD_TAGS, tag in BAD_TAGS, tag in HEADINGS, tag == "p", tag == "li", tag == "a", tag in ("div", "section"),
                    tag == "#text", own_good[k], own_bad[k], good[p], bad_tag[p], bad_words[p], min(depth[k], 50),
                    log1p(text[k]), links[k] / (1 + text[k]), 100 * inner[k] / (1 + text[k]), 100 * marks[k] / (1 + text[k]),
                    children[p], place[k] / max(1, children[p]), kinds.get((p, tag), 0) / max(1, children[p]),
                    log1p((text[p] - text[k]) / around), log1p(text[p]), links[p] / (1 + text[p]),
                    before[k] / (1 + total), text[k] / (1 + total),
                )
            )
        return np.array(rows, np.float32)

    def consistent(self, margin: np.ndarray) -> list[bool]:
        """The choice of nodes with the largest sum of margins in which no node is kept below a dropped one.

        All text that stands directly in a block, links and marked words included, is one choice by the mean margin
        of its characters.
        """
        n, seen = len(self.parent), self.seen()
        block, runs, chars = [0] * n, [0.0] * n, [0] * n
        for k in range(1, n):
            block[k] = block[self.parent[k]] if self.tag[k] in INLINE else k
            if self.text[k] and seen[k]:
                runs[block[k]] += float(margin[k]) * len(self.text[k])
                chars[block[k]] += len(self.text[k])
        best = [float("-inf")] * n
        for k in range(n):
            if block[k] == k and seen[k]:
                best[k] = float(margin[k]) + max(0.0, runs[k] / max(1, chars[k]))
        for k in range(n - 1, 0, -1):
            if best[k] > 0:
                best[block[self.parent[k]]] += best[k]
        keep = [True] * n
        for k in range(1, n):
            own = best[k] > 0 if block[k] == k else runs[block[k]] > 0 and seen[k]
            keep[k] = own and keep[block[self.parent[k]]]
        return keep

    def main_text(self, keep: list[bool]) -> str:
        held = [" " if k is None or k == -1 else self.text[k] if keep[k] else "" for k in self.parts]
        return " ".join("".join(held).split())
