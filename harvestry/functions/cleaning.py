"""Cleaning of whole texts. Compatibility normalisation, mixed scripts and urls inside prose have no built-in, so one Arrow function does a text."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import scanner
from .text import BULLETS, KEPT_SIGNS, LOOKALIKES, SYMBOLS
from .urls import UNWANTED

INVISIBLE = re.compile("[­​-‍⁠﻿]")
#: One pictograph as Unicode's emoji data has it: a flag, or an emoji with its variation and skin tone and what is joined to it.
PICTOGRAPH = regex.compile(r"\p{Regional_Indicator}{2}|(?![0-9#*])\p{Emoji}(?:\uFE0F|\p{Emoji_Modifier})?(?:\u200D(?![0-9#*])\p{Emoji}(?:\uFE0F|\p{Emoji_Modifier})?)*")
HASHTAGS = re.compile(r"(?:[*•\-\s]*)(?:(?:hashtag)?#[a-zA-Z]\w*\s*)+", re.A)
WORD = re.compile(r"\b[a-zA-Z0-9Ѐ-ӿ]+\b")


def latin(word: str) -> str:
    """A word of both scripts, Latin at least as much as Cyrillic, in Latin letters."""
    cyrillic = sum("Ѐ" <= x <= "ӿ" for x in word)
    other = sum(x.isascii() and x.isalpha() or x.isdigit() for x in word)
    return "".join(LOOKALIKES.get(x, x) for x in word) if 0 < cyrillic <= other else word


def untracked(url: str) -> str:
    parts = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in UNWANTED]
    return urlunsplit(parts._replace(query=urlencode(kept))) if parts.query else url


def prose(text: str) -> str:
    """A line's words: one script, plain signs, no pictographs, hashtags or trackers, single spaces."""
    text = re.sub("([0-9])️?⃣", r"\1", text.replace("\U0001f51f", "10"))
    text = WORD.sub(lambda m: latin(m[0]), unicodedata.normalize("NFKC", text))
    for sign, plain in SYMBOLS.items():
        text = text.replace(sign, plain)
    text = PICTOGRAPH.sub(lambda m: m[0] if m[0] in KEPT_SIGNS else "", text)
    text = re.sub(r"\bhashtag#([a-zA-Z]\w*)|(?<!\S)#([a-zA-Z]\w*)", lambda m: m[1] or m[2], text, flags=re.A)
    text = scanner.redirected(text, untracked)
    return re.sub(" +([.,!?;:])", r"\1", re.sub(r"(?<=\S) {2,}", " ", text)).strip()


def line(x: str) -> str:
    """One line; directives of an outline stay, separators become `---`, lines of hashtags vanish, items and headings keep their marks."""
    x = INVISIBLE.sub("", x)
    if x.startswith(("#+", "# ")):
        return x
    core = x.strip()
    if len(core) > 1 and not set(core) - set("—–-=_.") and set(core) & set("—–-="):
        return "---"
    if core and HASHTAGS.fullmatch(core):
        return ""
    if m := re.fullmatch(rf"(\s*)([-+*{BULLETS}])(\s+)(.*)", x, re.S):
        mark = m[2] if m[2] in "-+*" else "*" if m[1] else "-"
        return m[1] + mark + m[3] + prose(m[4])
    m = re.fullmatch(r"(\*+\s+)?(.*)", x, re.S)
    return (m[1] or "") + prose(m[2])


def whole(text: str) -> str:
    """All lines, of blank ones at most one in a row and none at the end."""
    out: list[str] = []
    for x in map(line, text.splitlines()):
        if x.strip() or not out or out[-1]:
            out.append(x if x.strip() else "")
    while out and not out[-1]:
        out.pop()
    ends = text.endswith(("\n", "\r")) or len(out) < len(text.splitlines())
    return "\n".join(out) + ("\n" if out and ends else "")


SLICE = 64  # texts that are Python strings at once


def cleaned(rows: DataFrame, text: str) -> DataFrame:
    """rows with their texts cleaned, a few at a time: a task holds one Arrow batch and a slice of results."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                done = pa.array([None if t is None else whole(t) for t in part.column(at).to_pylist()], part.column(at).type)
                yield part.set_column(at, text, done)

    return rows.mapInArrow(run, rows.schema)


@F.pandas_udf(StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    """Cleaned texts; null stays null, an empty text empty."""
    return texts.map(lambda t: None if t is None else whole(t))
