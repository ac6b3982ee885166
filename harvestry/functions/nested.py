"""Nested JSON of any depth: redaction, a page's JSON-LD title, guarded and wrapped values."""

from __future__ import annotations

import html as entities
import json
import re
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .media import GENERIC_TITLES

# Keys whose values give access, what takes their place, the types of pages that have a title.
SENSITIVE = ("authorization", "cookie", "cookies", "fragment_base_url", "http_headers", "manifest_url", "url")
REDACTED = "[redacted]"
PAGE_TYPES = ("article", "blogposting", "creativework", "newsarticle", "webpage")
NODES = 1000  # values of one script that are looked at
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.I | re.S)
_TYPE = re.compile(r"\btype\s*=\s*[\"']?application/ld\+json\b", re.I)


def without_access(value: Any) -> Any:
    """The value with everything under a sensitive key taken out, at any depth; a list of steps instead of recursion, so depth has no limit."""
    root = [value]
    todo: list[tuple[Any, Any]] = [(root, 0)]
    while todo:
        holder, at = todo.pop()
        x = holder[at]
        if isinstance(x, dict):
            holder[at] = x = {k: REDACTED if k.casefold() in SENSITIVE else v for k, v in x.items()}
            todo += [(x, k) for k, v in x.items() if isinstance(v, dict | list)]
        elif isinstance(x, list):
            holder[at] = x = list(x)
            todo += [(x, i) for i, v in enumerate(x) if isinstance(v, dict | list)]
    return root[0]


def usable_title(value: Any) -> str | None:
    """A title on one line; None for generic and overlong ones and those with control signs."""
    title = " ".join(entities.unescape(value).split()) if isinstance(value, str) else ""
    low = title.casefold()
    bad = not title or len(title) > 500 or low in GENERIC_TITLES or low.startswith("404 ") or any(unicodedata.category(x)[0] == "C" for x in title)
    return None if bad else title


def linked_data_title(page: str, nodes: int = NODES) -> str | None:
    """The headline, else the name, of the first page-like object in a page's JSON-LD; later members of a list or object come first."""
    for m in _SCRIPT.finditer(page):
        if not _TYPE.search(m[1]):
            continue
        try:
            todo = [json.loads(m[2])]
        except (ValueError, RecursionError):
            continue
        for _ in range(nodes):
            if not todo:
                break
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                kinds = x.get("@type")
                kinds = kinds if isinstance(kinds, list) else [kinds]
                if any(isinstance(k, str) and k.casefold() in PAGE_TYPES for k in kinds):
                    for k in ("headline", "name"):
                        if title := usable_title(x.get(k)):
                            return title
                todo += x.values()
    return None


def _read(x: str | None) -> Any:
    try:
        return json.loads(x) if x is not None else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def redacted(x: pd.Series) -> pd.Series:
    """JSON texts without the values of sensitive keys; null and broken ones are null."""
    return x.map(lambda t: None if (v := _read(t)) is None else json.dumps(without_access(v), ensure_ascii=False, separators=(",", ":")))


@F.pandas_udf(StringType())
def json_ld_title(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else linked_data_title(t))


def parsed(x: Column) -> Column:
    """A JSON object as a variant, without what stands before it to keep it from running as a script; null if it is broken or none."""
    return F.try_parse_json(F.regexp_replace(x, r"(?s)^[^{]*", ""))


def unwrapped(v: Column, name: str) -> Column:
    """A field's text, be it plain or wrapped as {value: ...}; lists of texts are joined by `, `."""
    wrapped, plain = (F.try_variant_get(v, f"$.{name}{x}", "variant") for x in (".value", ""))
    field = F.coalesce(wrapped, plain)
    listed = F.array_join(F.try_variant_get(field, "$", "array<string>"), ", ")
    return F.coalesce(F.when(F.schema_of_variant(field).startswith("ARRAY"), listed), F.when(~F.schema_of_variant(field).startswith("OBJECT"), F.try_variant_get(field, "$", "string")))
