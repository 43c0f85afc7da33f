"""Text and links of nested page elements.

Balanced nesting is beyond regular expressions, so one Arrow
batch of pages at a time goes to Python. Pages are scanned tag by tag with one regular
expression; attributes are read only where the name or value that some selector asks for
occurs, and text only inside elements that are wanted. A page that is not made of plain
tags goes through the HTML parser of the standard library instead, with the same result.
The helper only finds elements; priorities, labels and everything after are columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.text import BLANKS


@dataclass(frozen=True)
class Sel:
    """An element by tag, class, id, attribute, exact or partial attribute value, or place."""

    tag: str | None = None
    cls: tuple[str, ...] = ()
    id: str | None = None
    has: str | None = None
    attr: tuple[str, str] | None = None
    part: tuple[str, str] | None = None
    inside: Sel | None = None
    last_child_of: Sel | None = None

    @property
    def bare(self) -> bool:
        """Whether an element without attributes can match."""
        return not (self.cls or self.id or self.has or self.attr or self.part)

    @property
    def marks(self) -> set[str]:
        """What the attributes of a matching element, and of those it must lie in, hold as text."""
        own = {*self.cls, self.id, self.has, *(self.attr or ())[1:], *(self.part or ())[1:]}
        around = [s.marks for s in (self.inside, self.last_child_of) if s is not None]
        return {m for m in own.union(*around) if m}

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        return (
            (self.tag is None or self.tag == tag)
            and (self.id is None or attrs.get("id") == self.id)
            and (not self.cls or set(self.cls) <= set(attrs.get("class", "").split()))
            and (self.has is None or self.has in attrs)
            and (self.attr is None or attrs.get(self.attr[0]) == self.attr[1])
            and (self.part is None or self.part[1] in attrs.get(self.part[0], ""))
        )


@dataclass(frozen=True)
class Pick:
    """The first element, in document order, that any of the selectors matches.

    Its text is that of all nodes inside, or, if ``lines``, what is visible, a line per tag that is not inline.
    """

    any_of: tuple[Sel, ...]
    lines: bool = False


# Facts of HTML.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNSEEN = frozenset("script style noscript template head".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup time u var".split())
_BREAK = None
_SPACES = str.maketrans("\t\n\r\f", "    ")
# Plain markup: an end tag, a start tag and its attributes, a comment, a document type.
_TAG = re.compile(
    r"""<(?:(/)([a-z][a-z0-9:_-]*)\s*>|([a-z][a-z0-9:_-]*)((?:\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*)\s*(/?)>"""
    r"""|!--.*?--\s*>|!doctype\b[^<>\[]*>)""",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style")}
# Characters of a page read at once, between looks at whether all is found.
_STEP = 16_384


def _as_lines(parts: list[str | None]) -> str:
    """Join text and breaks; runs of blanks count as one, empty lines are dropped."""
    text = "".join("\n" if part is _BREAK else part.translate(_SPACES) for part in parts)
    found = [re.sub(" +", " ", line).strip(" ") for line in text.split("\n")]
    return "\n".join(line for line in found if line)


class _Capture:
    """Text being gathered for a slot; ``parent`` is set while it may still turn out not to be the last child."""

    def __init__(self, slot: int, parent: _Node | None = None):
        self.slot, self.parent, self.parts = slot, parent, []


class Plan:
    """What to look for on a page, and how to tell that an element is of no concern."""

    def __init__(self, picks: tuple[Pick, ...] = (), anchors: tuple[Sel, ...] = ()):
        self.picks, self.anchors = picks, anchors
        marks = sorted(set().union(*(s.marks for s in (*anchors, *(s for pick in picks for s in pick.any_of)))))
        # A reference may stand for a mark.
        self.marks = re.compile("|".join(["&", *map(re.escape, marks)]), re.IGNORECASE)
        self._bare: dict[str, list[int]] = {}

    def bare(self, tag: str) -> list[int]:
        """The slots that an element of this tag without attributes may fill."""
        if tag not in self._bare:
            fits = [any(s.bare and s.tag in (None, tag) for s in pick.any_of) for pick in self.picks]
            self._bare[tag] = [slot for slot, fit in enumerate(fits) if fit]
        return self._bare[tag]


class _Node:
    __slots__ = ("tag", "attrs", "captures")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.captures = tag, attrs, []


class _Finder(HTMLParser):
    def __init__(self, plan: Plan):
        super().__init__(convert_charrefs=True)
        self.plan, self.picks, self.anchors = plan, plan.picks, plan.anchors
        self.texts: list[str | None] = [None] * len(plan.picks)
        self.targets: list[str] = []
        self.open: list[_Node] = []
        self.running: list[_Capture] = []
        self.taken: set[int] = set()
        # Last children so far, by slot.
        self.last: dict[int, _Capture] = {}
        self.hidden = 0
        self.missing = len(plan.picks)

    def _matches(self, sel: Sel, tag: str, attrs: dict) -> bool:
        if not sel.fits(tag, attrs):
            return False
        return sel.inside is None or any(sel.inside.fits(n.tag, n.attrs) for n in self.open)

    def _add(self, part: str | None):
        for capture in self.running:
            if self.picks[capture.slot].lines:
                if not self.hidden:
                    capture.parts.append(part)
            elif part is not _BREAK:
                capture.parts.append(part)

    def _close(self):
        node = self.open.pop()
        for capture in [c for c in self.last.values() if c.parent is node] if self.last else ():
            del self.last[capture.slot]
            if capture.slot not in self.taken:
                self.taken.add(capture.slot)
                self._finish(capture)
        self.hidden -= node.tag in _UNSEEN
        for capture in node.captures:
            self.running = [c for c in self.running if c is not capture]
            if capture.parent is None:
                self._finish(capture)
        if node.tag not in _INLINE:
            self._add(_BREAK)

    def _finish(self, capture: _Capture):
        self.missing -= self.texts[capture.slot] is None
        text = _as_lines(capture.parts) if self.picks[capture.slot].lines else "".join(capture.parts)
        self.texts[capture.slot] = text.strip(BLANKS)

    def handle_starttag(self, tag, attrs):
        self._start(tag, {k: v or "" for k, v in reversed(attrs)})

    def _start(self, tag: str, attrs: dict[str, str]):
        node = _Node(tag, attrs)
        if tag == "a" and any(self._matches(s, tag, attrs) for s in self.anchors):
            self.targets.append(attrs.get("href", ""))
        parent = self.open[-1] if self.open else None
        if tag not in _INLINE:
            self._add(_BREAK)
        if self.last:
            self.last = {s: c for s, c in self.last.items() if c.parent is not parent}
        for slot in range(len(self.picks)) if attrs else self.plan.bare(tag):
            any_of = self.picks[slot].any_of
            if slot not in self.taken and any(self._matches(s, tag, attrs) for s in any_of):
                over = any_of[0].last_child_of
                if over is None:
                    self.taken.add(slot)
                    node.captures.append(_Capture(slot))
                elif parent is not None and over.fits(parent.tag, parent.attrs):
                    self.last[slot] = _Capture(slot, parent)
                    node.captures.append(self.last[slot])
        self.running += node.captures
        self.open.append(node)
        self.hidden += tag in _UNSEEN
        if tag in _VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open):
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.running:
            self._add(data)

    @property
    def done(self) -> bool:
        """Whether every text is found, so that the rest of the page adds nothing."""
        return not self.anchors and not self.missing

    def _attributes(self, tag: str, raw: str) -> dict[str, str]:
        """The attributes of a tag, or none where no selector can be concerned; of repeated ones the first counts."""
        if not raw or not (self.plan.marks.search(raw) or (tag == "a" and self.anchors)):
            return {}
        found = {}
        for name, value in _ATTRIBUTE.findall(raw):
            if value[:1] in ('"', "'"):
                value = value[1:-1]
            found.setdefault(name.lower(), unescape(value) if "&" in value else value)
        return found

    def _scan(self, html: str) -> bool:
        """Whether the page was read to where all is found; not if something other than plain markup stands before."""
        at = 0
        while True:
            start = html.find("<", at)
            if self.running and start != at:
                text = html[at:] if start < 0 else html[at:start]
                self._add(unescape(text) if "&" in text else text)
            if start < 0:
                return True
            found = _TAG.match(html, start)
            if found is None:
                return False
            end_tag, closed, opened, raw, empty = found.groups()
            at = found.end()
            if end_tag:
                self.handle_endtag(closed.lower())
            elif opened:
                tag = opened.lower()
                self._start(tag, self._attributes(tag, raw))
                if tag in _RAW_END:
                    end = _RAW_END[tag].search(html, at)
                    if empty or end is None:
                        return False
                    if self.running and end.start() > at:
                        self._add(html[at : end.start()])
                    self.handle_endtag(tag)
                    at = end.end()
            if self.done:
                return True

    def parse(self, html: str) -> _Finder:
        """Read a page with the parser of the standard library, whatever its markup."""
        for start in range(0, len(html), _STEP):
            self.feed(html[start : start + _STEP])
            if self.done:
                return self
        self.close()
        return self._ended()

    def _ended(self) -> _Finder:
        while self.open:
            self._close()
        return self

    def run(self, html: str) -> _Finder:
        return self._ended() if self._scan(html) else _Finder(self.plan).parse(html)


def element_texts(html: Column, platform: Column, picks: dict[str, tuple[Pick, ...]]) -> Column:
    """``texts``, one per pick of the page's platform, null where no element matches, and ``failed``.

    A page the parser gives up on has no texts and is marked as failed.
    """

    plans = {name: Plan(p) for name, p in picks.items()}

    @F.pandas_udf("texts array<string>, failed boolean")
    def texts(pages: pd.Series, platforms: pd.Series) -> pd.DataFrame:
        def one(page, name):
            if page is None or name not in plans:
                return None, False
            try:
                return _Finder(plans[name]).run(page).texts, False
            except Exception:
                return None, True

        return pd.DataFrame([one(*row) for row in zip(pages, platforms)], columns=["texts", "failed"], dtype=object)

    return texts(html, platform)


def anchor_targets(html: Column, anchors: tuple[Sel, ...]) -> Column:
    """``targets``, the ``href`` of the anchors any selector matches, in document order, and ``failed``."""

    plan = Plan(anchors=anchors)

    @F.pandas_udf("targets array<string>, failed boolean")
    def targets(pages: pd.Series) -> pd.DataFrame:
        def one(page):
            if page is None:
                return None, False
            try:
                return _Finder(plan).run(page).targets, False
            except Exception:
                return [], True

        return pd.DataFrame([one(page) for page in pages], columns=["targets", "failed"], dtype=object)

    return targets(html)
