"""Queries over the links of Markdown documents: one document for each page, with its url in every construct and its html below."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as ur
from ..operators import markdown as md
from ..registry import query
from .core import _CANON

c = F.col

#: The constructs around a url, in both dialects: what stands before and after it, kind, offsets of the span around it, the label's length.
_PARTS = [
    ("'Read ('", "').' || chr(10)", "bare", 0, 0, None),
    ("'[' || url || ']('", "') '", "markdown", None, 1, "length(url)"),
    ("'[Page ' || page_id || '](<'", "'> \"t\") '", "titled", None, 6, "(5 + length('' || page_id))"),
    ("'<'", "'>' || chr(10)", "autolink", -1, 1, None),
    ("'`'", "'`, ``' || url || ' ` `` '", None, 0, 0, None),
    ("'![image]('", "')' || chr(10)", "image", -9, 1, "5"),
    ("'  [ref]: '", "chr(10)", "reference", 0, 0, None),
    ("'<a href=\"'", "'\">raw</a>' || chr(10) || '~~~' || chr(10) || url || chr(10) || '~~~' || chr(10)", None, 0, 0, None),
]
_MARKDOWN = " || ".join(f"{before} || url || {after}" for before, after, *_ in _PARTS)


def _documents(t):
    return t("pages").select("page_id", "url", F.expr(f"{_MARKDOWN} || html").alias("text"))


def _planted() -> str:
    """SQL: the links that stand in the documents by construction."""
    at, rows, n = "0", [], 0
    for before, after, kind, left, right, label in _PARTS:
        start = f"{at} + length({before})"
        if kind:
            n += 1
            head = f"({start} - {label} - {3 if kind == 'titled' else 2})" if label else "null"
            span = f"{start} + {left}" if left is not None else f"{head} - 1"
            labels = f"{head}::int as label_start, {head}::int + {label} as label_end" if label else "null::int as label_start, null::int as label_end"
            rows.append(f"select page_id, {n} as n, '{kind}' as kind, url, {start} as url_start, {start} + length(url) as url_end, {span} as span_start, {start} + length(url) + {right} as span_end, {labels} from pages")
        at = f"{start} + length(url) + length({after})"
    return " union all ".join(rows)


@query("markdown_links", f"select page_id, n, kind, url, url_start::int as url_start, url_end::int as url_end, span_start::int as span_start, span_end::int as span_end, label_start, label_end::int as label_end from ({_planted()})")
def _(t):
    return md.occurrences(_documents(t), "page_id", "text").drop("label", "untitled")


def _resolutions(t):
    """url, destination, title: the canonical url and the page's title, none for every third page."""
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return t("pages").select("url", ur.canonical(c("url")).alias("destination"), F.when(c("page_id") % 3 > 0, title).alias("title"))


_TO = f"""(select url, min({{'d': canonical, 't': case when page_id % 3 > 0 then trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) end}}) as t from pages join ({_CANON}) using (page_id) group by 1)"""


@query("redirected_documents", "select page_id, sha256(" + " || ".join(f"{before.replace('url', 'to_url') if kind == 'markdown' else before} || {'to_url' if kind else 'url'} || {after}" for before, after, kind, *_ in _PARTS) + f" || html) as text_sha256 from (select page_id, pages.url, html, t['d'] as to_url from pages join {_TO} r on r.url = pages.url)")
def _(t):
    return md.redirect(_documents(t), "page_id", "text", _resolutions(t)).select("page_id", F.sha2("text", 256).alias("text_sha256"))


_TITLED = r"case when coalesce(t['t'], '') <> '' then '[' || regexp_replace(t['t'], '([\\\[\]*_`])', '\\\1', 'g') || '](' || regexp_replace(t['d'], '([\\()])', '\\\1', 'g') || ')' else t['d'] end"


def _titled_text() -> str:
    out = []
    for before, after, kind, *_ in _PARTS:
        if kind in ("markdown", "autolink"):
            out.append(f"whole || {after.replace(') ', ' ', 1) if kind == 'markdown' else after.replace('>', '', 1)}")
        else:
            out.append(f"{before} || {'whole' if kind == 'bare' else 'url'} || {after}")
    return " || ".join(out)


@query("titled_documents", f"select page_id, sha256({_titled_text()} || html) as text_sha256 from (select page_id, pages.url, html, {_TITLED} as whole from pages join {_TO} r on r.url = pages.url)")
def _(t):
    return md.entitle(_documents(t), "page_id", "text", _resolutions(t)).select("page_id", F.sha2("text", 256).alias("text_sha256"))
