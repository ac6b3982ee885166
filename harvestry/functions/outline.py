"""Retrieval units of plan outlines and of Markdown notes, a line at a time."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

# An outline's task states, headings, priorities, tags, drawers, and a note's headings.
STATES = ("TODO", "NEXT", "MAYB", "WAIT", "DONE", "STARTED", "INPR", "HOLD", "CANCELLED")
HEADING = re.compile(r"^(\*+)\s+(.*)$")
PRIORITY = re.compile(r"^\[#[A-C]\]\s*")
TAGS = re.compile(r"\s+:[A-Za-z0-9_@#%:]+:\s*$")
DRAWER = re.compile(r"^\s*(SCHEDULED:|DEADLINE:|CLOSED:|:PROPERTIES:|:END:|:[A-Z_]+:)")
NOTE_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
WINDOW = 280  # words of a section that make one unit


class Unit(NamedTuple):
    kind: str  # org-charter, org-task, org-section, vault-section
    line: int  # where it begins, from 1
    path: str
    title: str
    keyword: str | None
    text: str


def _setting(lines: list[str], name: str, default: str) -> str:
    return next((x.split(":", 1)[1].strip() for x in lines if x.upper().startswith(f"#+{name}:")), default)


def _heading(rest: str) -> tuple[str, str | None]:
    """A heading's title and task state."""
    word = rest.split(None, 1)
    state = word[0] if word and word[0] in STATES else None
    if state:
        rest = word[1] if len(word) > 1 else ""
    return TAGS.sub("", PRIORITY.sub("", rest)).strip(), state


def outline_units(text: str, file: str) -> Iterator[Unit]:
    """The charter of a plan (what stands above its first heading) and a unit for each heading with its own lines.

    A unit's path names the headings above it: at each level the last one, of levels that are skipped none.
    """
    lines = text.splitlines()
    heads = [(i, m) for i, x in enumerate(lines) if (m := HEADING.match(x))]
    ends = [i for i, _ in heads[1:]] + [len(lines)]
    top = [x for x in lines[: heads[0][0] if heads else len(lines)] if x.strip()]
    title, subtitle = _setting(top, "TITLE", file), _setting(top, "SUBTITLE", "")
    prose = " ".join(x for x in top if not x.startswith("#+"))
    if prose or subtitle:
        yield Unit("org-charter", 1, file, title, None, f"{title}. " + f"{subtitle}. {prose}".strip())
    above: list[str] = []
    for (at, m), end in zip(heads, ends):
        name, state = _heading(m[2])
        above = above[: len(m[1]) - 1]
        path = " > ".join([file, *above])
        body = " ".join(x.strip() for x in lines[at + 1 : end] if not DRAWER.match(x)).strip()
        yield Unit("org-task" if state else "org-section", at + 1, path, name, state, f"{path} > {name}. {body}".strip())
        above = [*above, name]


def note_units(text: str, file: str, window: int = WINDOW) -> Iterator[Unit]:
    """The sections of a note, cut at headings of the first three levels, in windows that name the line they begin on."""
    folder, _, name = file.rpartition("/")
    note = re.sub(r"(?<=.)\.[^.]*$", "", name)
    lines = text.splitlines()
    marks = [(0, note)] + [(i, m[2].strip()) for i, x in enumerate(lines) if (m := NOTE_HEADING.match(x)) and len(m[1]) <= 3]
    for (start, heading), (end, _) in zip(marks, [*marks[1:], (len(lines), "")]):
        body = [(i + 1, x.split()) for i, x in enumerate(lines[start:end], start) if x.strip() and not NOTE_HEADING.match(x) and not x.startswith("---")]
        words = [w for _, ws in body for w in ws]
        before, seen = [], 0
        for _, ws in body:
            before.append(seen)
            seen += len(ws)
        path = f"{folder or '.'}/{note}" + (f" > {heading}" if heading != note else "")
        for first in range(0, len(words), window):
            line = body[bisect_right(before, first) - 1][0]
            yield Unit("vault-section", line, path, heading, None, f"{path}. " + " ".join(words[first : first + window]))
