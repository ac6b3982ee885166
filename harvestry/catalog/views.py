"""View queries: link, source and problem lists and whole indexes of items made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import render as rd
from ..registry import query

c = F.col

#: Links of items of nine pages each, in both dialects.
_LINKS = {
    "item": "page_id // 9", "n": "page_id % 9 + 1", "canonical": "url", "title": "case when page_id % 3 = 0 then 'T [' || page_id || ']  x' end", "label": "case when page_id % 4 = 0 then 'label_' || page_id end",
    "handler": "case when page_id % 5 = 0 then 'medium' else 'document' end", "status": "case page_id % 6 when 0 then 'duplicate' when 1 then 'excluded' when 2 then 'failed' else 'resolved' end",
    "reason": "case when page_id % 2 = 0 then 'http-error' end", "duplicate_of": "case when page_id % 12 = 0 then 1 end",
}
_SQL_LINKS = "(select " + ", ".join(f"{v} as {k}" for k, v in _LINKS.items()) + " from pages)"
_LINE = r"""n || '. [' || regexp_replace(trim(regexp_replace(coalesce(title, label, canonical), '\s+', ' ', 'g')), '([\\\[\]*_`])', '\\\1', 'g') || '](' || regexp_replace(canonical, '([\\()])', '\\\1', 'g') || ') — ' || handler || ' · ' || case when status = 'duplicate' and duplicate_of is not null then 'duplicate of ' || duplicate_of when reason is not null and status <> 'resolved' then status || ' (' || reason || ')' else status end"""
_SOURCES = "(select page_id // 9 as item, page_id % 9 + 1 as place, 'extractions/' || page_id || '/content.md' as path, case when page_id % 2 = 0 then 'P' || page_id else '' end as title, case when page_id % 4 = 0 then 'A, B, C' when page_id % 4 = 1 then 'A' end as who, case when page_id % 3 = 0 then '2024-01-01' end as published, case when page_id % 8 = 0 then 'partial' else 'complete' end as status, case when page_id % 8 = 0 then 'cut' end as reason, length(html) as words from pages where page_id % 4 < 2)"
_SOURCE_LINE = """place || '. [' || path || '](' || path || ')' || case when title <> '' or who is not null or published is not null then ' — ' || concat_ws(' · ', nullif(title, ''), who, published) else '' end || ' — ' || case when reason is not null and status <> 'complete' then status || ' (`' || reason || '`)' else status end || ' · ' || format('{:,}', words) || ' words'"""
_PROBLEMS = "(select page_id // 9 as item, page_id as place, 'url-resolution' as step, 'partial' as outcome, 'http-error' as reason, url as target, 'HTTP  404' as message from pages where page_id % 11 = 0)"


def _links(t):
    return t("pages").select(*(F.expr(v.replace("//", "div")).alias(k) for k, v in _LINKS.items()))


def _sources(t):
    p = c("page_id")
    authors = F.when(p % 4 == 0, F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D"))).when(p % 4 == 1, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    return t("pages").where("page_id % 4 < 2").select(
        F.expr("page_id div 9").alias("item"), (p % 9 + 1).alias("place"), F.concat(F.lit("extractions/"), p.cast("string"), F.lit("/content.md")).alias("path"), F.when(p % 2 == 0, F.concat(F.lit("P"), p.cast("string"))).otherwise("").alias("title"), authors.alias("authors"),
        F.when(p % 3 == 0, "2024-01-01").alias("published"), F.lit(None).cast("string").alias("venue"), F.when(p % 8 == 0, "partial").otherwise("complete").alias("status"), F.when(p % 8 == 0, "cut").alias("reason"), F.length("html").alias("words"), F.lit(None).cast("string").alias("via"),
    )


def _problems(t):
    return t("pages").where("page_id % 11 = 0").select(
        F.expr("page_id div 9").alias("item"), c("page_id").alias("place"), F.lit("url-resolution").alias("step"), F.lit("partial").alias("outcome"), F.lit("http-error").alias("reason"), c("url").alias("target"), F.lit("HTTP  404").alias("message")
    )


@query("link_lists", f"select item, string_agg({_LINE}, chr(10) order by n) as links, count(*)::bigint as links_count from {_SQL_LINKS} where status <> 'excluded' group by item")
def _(t):
    return rd.link_lines(_links(t), "item")


@query("source_lists", f"select item, string_agg({_SOURCE_LINE}, chr(10) order by place) as sources, count(*)::bigint as sources_count from {_SOURCES} group by item")
def _(t):
    return rd.source_lines(_sources(t), "item")


@query("stream_ranks", "select doc_id, case when h = 'caption' then 4 when h like 'transcript (%' then 3 when h = 'spoken audio' then 2 else 7 end as rank from (select doc_id, case doc_id % 4 when 0 then 'caption' when 1 then 'transcript (auto)' when 2 then 'spoken audio' else 'other' end as h from documents)")
def _(t):
    h = F.expr("case doc_id % 4 when 0 then ' Caption' when 1 then 'Transcript (auto)' when 2 then 'Spoken audio' else 'other' end")
    return t("documents").select("doc_id", rd.stream_rank(h).alias("rank"))


_ITEMS = "(select page_id // 9 as item, min(url) as canonical_url, count(*) as link_count, case when min(page_id) % 2 = 0 then 'see \"this\"' end as note, case when min(page_id) % 4 = 1 then 'T' || min(page_id) end as title from pages group by 1)"


@query("item_indexes", f"""with l as (select item, string_agg({_LINE}, chr(10) order by n) as links from {_SQL_LINKS} where status <> 'excluded' group by item), s as (select item, string_agg({_SOURCE_LINE}, chr(10) order by place) as sources, count(*) as ns from {_SOURCES} group by item),
 p as (select item, string_agg('- `' || step || '` ' || outcome || ' — `' || reason || '` — ' || target || ' — HTTP 404', chr(10) order by place) as problems, count(*) as np from {_PROBLEMS} group by item)
 select item, '---' || chr(10) || concat_ws(chr(10), 'id: ' || item, 'origin: web', case when note is null then 'intent: null' else 'intent: "see \\"this\\""' end, 'kind: linklist', case when title is not null then 'title: "' || title || '"' else 'headline: "H' || item || '"' end, 'canonical_url: ' || canonical_url, 'extraction: ok',
 'sources: ' || ns, 'lead: excerpt', case when link_count > 5 then 'link_count: ' || link_count end, 'problems: ' || np) || chr(10) || '---' || chr(10) || chr(10) || '## Captured' || chr(10) || chr(10) || case when note is null then '> {rd.NO_NOTE}' else '> ' || note end
 || case when sources is not null then chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || sources else '' end || chr(10) || chr(10) || '## Lead' || chr(10) || chr(10) || '> a' || chr(10) || '>' || chr(10) || '> b' || case when links is not null then chr(10) || chr(10) || '## Links' || chr(10) || chr(10) || links else '' end
 || case when problems is not null then chr(10) || chr(10) || '## Problems' || chr(10) || chr(10) || problems else '' end || chr(10) as index from {_ITEMS} left join l using (item) left join s using (item) left join p using (item)""")
def _(t):
    first = F.min("page_id")
    items = t("pages").groupBy(F.expr("page_id div 9").alias("item")).agg(
        F.min("url").alias("canonical_url"), F.count("*").alias("link_count"), F.when(first % 2 == 0, 'see "this"').alias("note"), F.when(first % 4 == 1, F.concat(F.lit("T"), first.cast("string"))).alias("title")
    )
    none = F.lit(None).cast("string")
    items = items.withColumns({
        "captured_at": none, "origin": F.lit("web"), "via": none, "intent": c("note"), "kind": F.lit("linklist"), "headline": F.concat(F.lit("H"), c("item").cast("string")), "extraction": F.lit("ok"), "reason": none, "lead": F.lit("a\n\nb"), "lead_kind": F.lit("excerpt"),
    })
    return rd.index(items, _links(t), _sources(t), _problems(t), "item")
