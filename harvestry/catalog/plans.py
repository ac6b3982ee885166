"""Units of plans and notes: an outline made of each document, a note made of each conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import corpus

c = F.col

_LINE = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_SPARK_LINE = r"trim(regexp_replace({x}, '\\s+', ' '))"
_OUTLINE = """'#+TITLE: Plan ' || doc_id || chr(10) || '#+SUBTITLE: In ' || coalesce(lang, '-') || chr(10) || chr(10) || 'Opening prose.' || chr(10) || '* TODO [#A] First ' || doc_id || '  :a:b:' || chr(10) || 'SCHEDULED: <2026-01-01>' || chr(10) || '  :ID: 1' || chr(10)
 || '- ' || {line} || chr(10) || '*** Deep :not tags' || chr(10) || chr(10) || '** Second' || chr(10) || 'x' || chr(10) || ' * no heading' || chr(10) || '* DONE'"""


@query("outline_units", f"""with d as (select 'd/' || doc_id || '.org' as file, doc_id, coalesce(lang, '-') as lang, {_LINE.format(x="coalesce(text, '')")} as line from documents),
 u as (select file, unnest([{{'kind': 'org-charter', 'line': 1, 'path': file, 'title': 'Plan ' || doc_id, 'keyword': null, 'text': 'Plan ' || doc_id || '. In ' || lang || '. Opening prose.'}},
  {{'kind': 'org-task', 'line': 5, 'path': file, 'title': 'First ' || doc_id, 'keyword': 'TODO', 'text': file || ' > First ' || doc_id || '. ' || trim('- ' || line)}},
  {{'kind': 'org-section', 'line': 9, 'path': file || ' > First ' || doc_id, 'title': 'Deep :not tags', 'keyword': null, 'text': file || ' > First ' || doc_id || ' > Deep :not tags.'}},
  {{'kind': 'org-section', 'line': 11, 'path': file || ' > First ' || doc_id, 'title': 'Second', 'keyword': null, 'text': file || ' > First ' || doc_id || ' > Second. x * no heading'}},
  {{'kind': 'org-task', 'line': 14, 'path': file, 'title': '', 'keyword': 'DONE', 'text': file || ' > .'}}]) as u from d)
 select file, u['kind'] as kind, u['line']::int as line, u['path'] as path, u['title'] as title, u['keyword'] as keyword, sha256(u['text']) as text_sha256 from u""")
def _(t):
    rows = t("documents").select(F.expr("'d/' || doc_id || '.org'").alias("file"), F.expr(_OUTLINE.format(line=_SPARK_LINE.format(x="coalesce(text, '')"))).alias("text"))
    return corpus.plan_units(rows).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query("note_units", f"""with t as (select conv_id, 'talks/c' || conv_id || '.md' as file, 'talks/c' || conv_id as head, row_number() over (partition by conv_id order by turn) as k, role || ' ' || turn as title, list_filter(string_split({_LINE.format(x='text')}, ' '), lambda w: w <> '') as ws from conversations where text is not null),
 w as (select *, unnest(range(0, len(ws), 40)) as first from t)
 select file, 'vault-section' as kind, (2 * k)::int as line, head || ' > ' || title as path, title, sha256(head || ' > ' || title || '. ' || array_to_string(ws[first + 1:first + 40], ' ')) as text_sha256 from w""")
def _(t):
    lines = F.expr(_SPARK_LINE.format(x="text"))
    rows = t("conversations").where("text is not null").select("conv_id", "turn", F.concat(F.lit("## "), c("role"), F.lit(" "), c("turn").cast("string"), F.lit("\n"), lines).alias("part"))
    notes = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("text"))
    named = notes.select(F.expr("'talks/c' || conv_id || '.md'").alias("file"), "text")
    return corpus.note_units(named, window=40).withColumn("text_sha256", F.sha2("text", 256)).drop("text", "keyword")
