"""Links in Markdown text: what is one, where it stands, and what may be written in its place.

Positions are code points. A byte per code point says whether it is taken; fences and code spans take first, then links
and images, addresses in angle brackets, tags, definitions, and what is left is searched for bare urls. Each step is
linear in the text, so a text of many brackets or quotes costs no more than its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from typing import NamedTuple

# What counts as a url, a fence, a definition's head, an address in angle brackets, a tag.
URL = re.compile(r"https?://[^\s<>\"\]]+", re.I)
FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
DEFINITION = re.compile(r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]*<?", re.M)
ANGLED = re.compile(r"<(https?://[^<>\s]+)>", re.I)
TAG = re.compile(r"</?[A-Za-z]")  # up to a `>` on the same line

_ENDING = re.compile(r"[ \t]*(?:\"[^\"]*\"|'[^']*')?[ \t]*\)")
_BRACKET = re.compile("[()]")


class Link(NamedTuple):
    kind: str  # bare, markdown (labelled with its own url), titled, image, autolink, reference
    url: str
    start: int  # of the url
    end: int
    span_start: int  # of the whole construct
    span_end: int
    label_start: int | None = None
    label_end: int | None = None

    @property
    def untitled(self) -> bool:
        """Whether a title may be put in its place."""
        return self.kind in ("bare", "markdown", "autolink")


class _Taken:
    def __init__(self, n: int):
        self.places = bytearray(n)

    def take(self, start: int, end: int) -> None:
        self.places[start:end] = b"\1" * (end - start)

    def free(self, start: int, end: int) -> bool:
        return self.places.find(1, start, end) < 0


def trimmed(url: str) -> str:
    """A bare url without the prose punctuation after it; closing brackets stay where they have an opening one."""
    url = url.rstrip(".,;:!?'")
    for left, right in ("()", "{}"):
        surplus = min(len(url) - len(url.rstrip(right)), url.count(right) - url.count(left))
        url = url[: len(url) - max(surplus, 0)]
    return url


def _code(text: str, taken: _Taken) -> None:
    at, fence, since = 0, None, 0
    for line in text.splitlines(keepends=True):
        if mark := FENCE.match(line):
            sign = mark[1]
            if fence is None:
                fence, since = sign, at
            elif sign.startswith(fence):  # the same sign, at least as often
                taken.take(since, at + len(line))
                fence = None
        at += len(line)
    if fence is not None:
        taken.take(since, len(text))
    at, missing = 0, set()
    while (at := text.find("`", at)) >= 0:
        if not taken.free(at, at + 1):
            at += 1
            continue
        run = len(text[at : at + 1]) and next((i for i in range(at, len(text)) if text[i] != "`"), len(text))
        ticks = text[at:run]
        end = -1 if ticks in missing else text.find(ticks, run)
        if end < 0:
            missing.add(ticks)  # nor will it be found further on
        elif taken.free(end, end + len(ticks)):
            taken.take(at, end + len(ticks))
            run = end + len(ticks)
        at = run


def _destination(text: str, at: int) -> tuple[int, int, int] | None:
    """Start and end of the url that a construct's destination is, and where the construct ends; null if it is none."""
    angled = text.startswith("<", at)
    m = URL.match(text, at + angled)
    if not m:
        return None
    end = m.end()
    if angled:
        after = end + 1
        if not text.startswith(">", end):
            return None
    else:
        depth = 0
        for turn in _BRACKET.finditer(text, m.start(), end):
            depth += 1 if turn[0] == "(" else -1
            if depth < 0:
                end = turn.start()
                break
        else:
            if end < len(text) and (depth or text[end] == "\n" or not text[end].isspace()):
                return None
        after = end
    ending = _ENDING.match(text, after)
    return (m.start(), end, ending.end()) if ending and URL.fullmatch(text, m.start(), end) else None


def _bracketed(text: str, taken: _Taken) -> Iterable[Link]:
    turns = [m.start() for m in re.finditer(r"\]\(", text)]
    breaks = [m.start() for m in re.finditer("\n", text)]
    known: dict[int, tuple[int, int, int] | None] = {}
    done = 0
    for opening in re.finditer(r"\[", text):
        at = opening.start()
        turn = bisect_left(turns, at + 1)
        if turn == len(turns):
            return
        line = bisect_left(breaks, at)
        if at < done or not taken.free(at, at + 1) or line < len(breaks) and breaks[line] < turns[turn]:
            continue
        if turn not in known:
            known[turn] = _destination(text, turns[turn] + 2)
        if found := known[turn]:
            start, end, done = found
            image = at > 0 and text[at - 1] == "!"
            url, label = text[start:end], text[at + 1 : turns[turn]]
            link = Link("image" if image else "markdown" if label == url else "titled", url, start, end, at - image, done, at + 1, turns[turn])
            taken.take(link.span_start, done)
            yield link


def _tags(text: str, taken: _Taken) -> None:
    done = close = line = 0
    for m in TAG.finditer(text):
        if m.start() < done:
            continue
        if 0 <= close < m.end():
            close = text.find(">", m.end())
        if 0 <= line < m.end():
            line = text.find("\n", m.end())
        if close < 0:
            return
        if not 0 <= line < close:
            done = close + 1
            if taken.free(m.start(), done):
                taken.take(m.start(), done)


def links(text: str) -> list[Link]:
    """All links of a text in source order; urls in code and in tags are none, definitions count wherever they stand."""
    taken = _Taken(len(text))
    _code(text, taken)
    found = list(_bracketed(text, taken))
    for m in ANGLED.finditer(text):
        if taken.free(*m.span()):
            taken.take(*m.span())
            found.append(Link("autolink", m[1], *m.span(1), *m.span()))
    _tags(text, taken)
    for kind in ("reference", "bare"):
        heads = ((m.end(), text.find("\n", m.end())) for m in DEFINITION.finditer(text)) if kind == "reference" else ()
        there = (URL.match(text, at, end if end >= 0 else len(text)) for at, end in heads) if kind == "reference" else URL.finditer(text)
        for m in there:
            if m and (kind == "reference" or taken.free(*m.span())) and (url := trimmed(m[0])):
                end = m.start() + len(url)
                if kind == "reference":
                    taken.take(m.start(), end)
                found.append(Link(kind, url, m.start(), end, m.start(), end))
    return sorted(found, key=lambda x: (x.span_start, x.start))


def spliced(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """The text with `new` in place of text[start:end] for each edit; the first of two for one place counts."""
    out, at = [], 0
    for (start, end), new in sorted({(a, b): new for a, b, new in reversed(list(edits))}.items()):
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join([*out, text[at:]])


def redirected(text: str, url: Callable[[str], str]) -> str:
    """The text with each link's url (and a label that repeats it) changed; everything around stays."""
    edits = []
    for x in links(text):
        new = url(x.url)
        edits.append((x.start, x.end, new))
        if x.kind == "markdown":
            edits.append((x.label_start, x.label_end, new))
    return spliced(text, edits)
