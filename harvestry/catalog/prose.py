"""Text queries: line rules, cuts, headlines, headings, front matter, over lines made from the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import text as tx
from ..registry import query

c = F.col

#: Each document as one line, and with the marks that the rules look for, in both dialects.
_START = "replace(text, chr(10), ' ')"
_LINE = f"""case doc_id % 16 when 0 then '#AI #llm_2 ' when 1 then '- hashtag#GenAI is  here !' when 2 then '  🔹 ' || {_START} when 3 then '○ First  item ,' when 4 then '=====' when 5 then '— —' when 6 then '#+TITLE: a  b' when 7 then '* Head  line'
 when 8 then '1️⃣ and 🔟' when 9 then 'so → “this” – that’s ▪' when 10 then '[a](https://a.example/x) ' when 11 then '@user #tag www.a.example' when 12 then '— … !' when 13 then '-.-' when 14 then '' else {_START} end"""
_ROWS = f"(select doc_id, {_LINE} as line from documents)"
_BULLET = r"^(\s*)(?:[○🔹🔸•◾▪∘‣])(\s+.*)$"


def _lines(t):
    return t("documents").select("doc_id", F.expr(_LINE).alias("line"))


@query("line_kinds", rf"""select doc_id, trim(line) <> '' and not starts_with(line, '#+') and regexp_matches(trim(line), '^[\s*•-]*(?:(?:hashtag#|#)[a-zA-Z][a-zA-Z0-9_]*\s*)+$') as hashtags, starts_with(line, '#+') or starts_with(line, '# ') as directive,
 case when regexp_matches(trim(line), '^[—–\-=_.]{{2,}}$') and regexp_matches(trim(line), '[—–\-=]') then '---' else line end as separator,
 case when regexp_matches(line, '{_BULLET}') then regexp_extract(line, '{_BULLET}', 1) || case when regexp_extract(line, '{_BULLET}', 1) = '' then '-' else '*' end || regexp_extract(line, '{_BULLET}', 2) else line end as bullet,
 not regexp_matches(line, '[\pL\pN]') or regexp_matches(line, '^(?:\[(?:[^\]\\]|\\.)*\]\((?:[^()\\]|\\.)*\)\s*)+$') or len(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda w: w <> '' and not regexp_matches(w, '^(?:#|@|http://|https://|www\.)'))) = 0 as nameless from {_ROWS}""")
def _(t):
    x = c("line")
    return _lines(t).select("doc_id", tx.hashtag_line(x).alias("hashtags"), tx.directive_line(x).alias("directive"), tx.separator_line(x).alias("separator"), tx.bullet_line(x).alias("bullet"), tx.names_nothing(x).alias("nameless"))


_SYMBOLS = "line"
for _sign, _plain in tx.SYMBOLS.items():
    _SYMBOLS = f"replace({_SYMBOLS}, '{_sign}', '{_plain.replace(chr(39), chr(39) * 2)}')"


@query("plain_signs", rf"""select doc_id, {_SYMBOLS} as symbols, regexp_replace(replace(line, '🔟', '10'), '([0-9])️?⃣', '\1', 'g') as keycaps, regexp_replace(line || '​' || '﻿', '[­​-‍⁠﻿]', '', 'g') as visible from {_ROWS}""")
def _(t):
    x = c("line")
    return _lines(t).select("doc_id", tx.symbols(x).alias("symbols"), tx.keycaps(x).alias("keycaps"), tx.strip_invisible(F.concat(x, F.lit("​﻿"))).alias("visible"))


@query("cleaned_documents")
def _(t):
    marked = F.concat_ws("\n", c("line"), F.lit(""), F.lit(""), c("text"))
    rows = t("documents").select("doc_id", "text", F.expr(_LINE).alias("line"))
    return cleaning.cleaned(rows.select("doc_id", marked.alias("text")), "text").select("doc_id", F.sha2("text", 256).alias("cleaned_sha256"))


@query("cut_at_word", r"""select doc_id, case when length(x) <= 60 then x else rtrim(case when contains(substr(x, 1, 59), ' ') then regexp_replace(substr(x, 1, 59), ' [^ ]*$', '') else substr(x, 1, 59) end, ' ,;:—-') || '…' end as head from (select doc_id, """ + _START + """ as x from documents)""")
def _(t):
    return t("documents").select("doc_id", tx.cut_at_word(F.expr(_START), 60).alias("head"))


@query("alnum_word_count", r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '[\pL\pN]')))::int as n, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::int as all_words, format('{:,}', len(text)) as chars from documents")
def _(t):
    x = c("text")
    return t("documents").select("doc_id", tx.word_count(x).alias("n"), F.size(tx.words(x)).alias("all_words"), F.format_number(F.length(x), 0).alias("chars"))


_WORDS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


@query("truncate_words", rf"""with p as (select doc_id, text, len({_WORDS.format(x='text')}) as total, unnest(string_split(text, chr(10))) as para, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
 s as (select *, len({_WORDS.format(x='para')}) as n, sum(len({_WORDS.format(x='para')})) over (partition by doc_id order by k) as upto from p),
 b as (select doc_id, min(k) filter (k > 1 and upto > 50) as past, min(k) filter (upto >= 50) as enough from s group by 1),
 f as (select s.doc_id, string_agg(para, chr(10) || chr(10) order by k) as whole, sum(n) as used from s join b using (doc_id) where k <= least(coalesce(past - 1, 1000000), coalesce(enough, 1000000)) group by 1)
 select doc_id, case when total <= 50 then regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') when used <= 50 then regexp_replace(whole, '^\s+|\s+$', '', 'g') || case when used = total then '' else ' …' end else array_to_string({_WORDS.format(x='text')}[1:50], ' ') || ' …' end as lead
 from f join (select distinct doc_id, text, total from p) using (doc_id)""")
def _(t):
    return t("documents").select("doc_id", tx.truncate_words(F.replace("text", F.lit("\n"), F.lit("\n\n")), 50).alias("lead"))


@query("short_query", rf"""with p as (select doc_id, unnest(ss) as sentence, generate_subscripts(ss, 1) as k from (select doc_id, string_split(regexp_replace(text, '([.!?])\s', '\1' || chr(1), 'g'), chr(1)) as ss from documents)),
 s as (select *, sum(len({_WORDS.format(x='sentence')})) over (partition by doc_id order by k) - len({_WORDS.format(x='sentence')}) as before from p)
 select doc_id, string_agg(sentence, ' ' order by k) as short from s where before < 28 group by 1""")
def _(t):
    return t("documents").select("doc_id", tx.short_query(c("text")).alias("short"))


@query("yaml_scalars", r"""select doc_id, '"' || replace(replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '\', '\\'), '"', '\"') || '"' as scalar, '["' || replace(replace(coalesce(source, '-'), '\', '\\'), '"', '\"') || '", "' || coalesce(lang, '-') || '"]' as list from (select *, text || ' "q" \ ' as x from documents)""")
def _(t):
    both = F.array(F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    return t("documents").select("doc_id", tx.yaml_scalar(F.concat("text", F.lit(' "q" \\ '))).alias("scalar"), tx.yaml_list(both).alias("list"))


_HEADING = "case doc_id % 5 when 0 then '## ' when 1 then '##### ' when 2 then '# ' when 3 then '#' else '' end || 'T' || doc_id"


@query("demoted_headings", rf"""select doc_id, case when regexp_matches(h, '^#{{1,6}}\s') then repeat('#', least(length(regexp_extract(h, '^(#+)', 1)) + 2, 6)) || substr(h, length(regexp_extract(h, '^(#+)', 1)) + 1) else h end as heading,
 array_to_string(list_transform(string_split(text, chr(10)), lambda l: case when l = '' then '>' else '> ' || l end), chr(10)) as quote, regexp_replace(h || '[x]_`*\', '([\\\[\]*_`])', '\\\1', 'g') as label from (select *, {_HEADING} as h from documents)""")
def _(t):
    h = F.expr(_HEADING)
    quote = tx.blockquote(c("text"))
    return t("documents").select("doc_id", tx.demote_heading(h).alias("heading"), quote.alias("quote"), tx.escape_label(F.concat(h, F.lit("[x]_`*\\"))).alias("label"))


@query("section_numbers", "select doc_id, line_no, sum((line_no % 4 = 0)::int) over (partition by doc_id order by line_no)::bigint as section from (select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as line_no from documents)")
def _(t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return rows.select("doc_id", "line_no", F.sum((c("line_no") % 4 == 0).cast("long")).over(w).alias("section"))


#: Heading offsets against link offsets: the last heading at or before a link.
@query("asof_heading", """with h as (select doc_id, unnest(range(0, n_chars, 400)) as place from documents), l as (select doc_id, unnest(range(37, n_chars, 333)) as start from documents)
 select doc_id, start, max(place)::bigint as heading from l join h using (doc_id) where place <= start group by 1, 2""")
def _(t):
    d = t("documents")
    marks = lambda name, lo, step, kind: d.where(c("n_chars") > lo).select("doc_id", F.explode(F.sequence(F.lit(lo).cast("long"), c("n_chars") - 1, F.lit(step).cast("long"))).alias("at"), F.lit(kind).alias("kind"))
    both = marks("at", 0, 400, 0).unionByName(marks("start", 37, 333, 1))
    # one pass instead of a join: the last heading before each link in order
    w = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("heading", F.max(F.when(c("kind") == 0, c("at"))).over(w)).where("kind = 1").select("doc_id", c("at").alias("start"), "heading")


@query("front_matter_fields", r"""select page_id, map_from_entries(list_sort(list_transform(['kind: link', 'canonical_url: ' || url, 'title: "T' || page_id || '"'], lambda l: {'k': trim(split_part(l, ':', 1)), 'v': trim(trim(substr(l, position(':' in l) + 1)), '"')})))['canonical_url'] as canonical_url, 'T' || page_id as title from pages""")
def _(t):
    text = F.concat(F.lit("kind: link\ncanonical_url: "), c("url"), F.lit('\ntitle: "T'), c("page_id").cast("string"), F.lit('"'))
    pair = lambda l: F.struct(F.trim(F.split_part(l, F.lit(":"), F.lit(1))), F.trim(F.trim(F.regexp_replace(l, "^[^:]*:", "")), F.lit('"')))  # noqa: E731, E741
    fields = F.map_from_entries(F.transform(F.filter(F.split(text, "\n", -1), lambda l: F.contains(l, F.lit(":"))), pair))  # noqa: E741
    return t("pages").select("page_id", F.element_at(fields, "canonical_url").alias("canonical_url"), F.element_at(fields, "title").alias("title"))


_NAMELESS = r"(not regexp_matches(x, '[\pL\pN]') or regexp_matches(x, '^(?:\[(?:[^\]\\]|\\.)*\]\((?:[^()\\]|\\.)*\)\s*)+$') or len(list_filter(string_split(x, ' '), lambda w: not regexp_matches(w, '^(?:#|@|http://|https://|www\.)'))) = 0)"
_SENTENCES = rf"flatten(list_transform(list_filter(list_transform(string_split({{t}}, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda x: x <> '' and not {_NAMELESS}), lambda l: string_split(regexp_replace(l, '([.?!…]) ', '\1' || chr(10), 'g'), chr(10))))"
_OPENING = rf"""list_reduce({_SENTENCES}, lambda a, s: case when a['d'] then a else {{{{'j': ltrim(a['j'] || ' ' || s), 'd': (len(list_filter(string_split(ltrim(a['j'] || ' ' || s), ' '), lambda w: regexp_matches(w, '[\pL\pN]'))) >= 4 and not ends_with(ltrim(a['j'] || ' ' || s), ':')) or length(ltrim(a['j'] || ' ' || s)) > 100}}}} end, {{{{'j': '', 'd': false}}}})['j']"""
_CUT = r"""case when length(o) <= 100 then o else rtrim(case when contains(substr(o, 1, 99), ' ') then regexp_replace(substr(o, 1, 99), ' [^ ]*$', '') else substr(o, 1, 99) end, ' ,;:—-') || '…' end"""
#: Openings that name nothing, stop at a colon or are too short, before each document's text, in both dialects.
_LED = "case doc_id % 6 when 0 then '#tag @who' || chr(10) when 1 then 'In short:' || chr(10) when 2 then '… !' || chr(10) || 'Well. Yes. ' when 3 then '[a](https://a.example) ' || chr(10) when 4 then 'https://a.example/x' || chr(10) || chr(10) else '' end || coalesce(text, '')"


@query("first_sentences", f"select doc_id, {_CUT} as opening from (select doc_id, {_OPENING.format(t='t')} as o from (select doc_id, {_LED} as t from documents))")
def _(t):
    return t("documents").select("doc_id", tx.first_sentence(F.expr(_LED)).alias("opening"))


_PAGE_TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query("headlines", f"""with p as (select page_id, url, {_PAGE_TITLE} as title, case page_id % 4 when 0 then '[x](https://a.example)' || chr(10) || 'and why' when 1 then 'Only note' || page_id || '!' when 2 then {_PAGE_TITLE} else '' end as t from pages),
 c as (select page_id, url, case page_id % 4 when 0 then title || chr(10) || t when 2 then t when 1 then case when title <> '' then title else t end else '' end as t, title, page_id % 4 as k from p),
 o as (select page_id, url, title, k, {_OPENING.format(t='t')} as o from c), h as (select page_id, k, title, url, {_CUT} as h from o)
 select page_id, case when k < 3 and h <> '' then h else regexp_replace(rtrim(regexp_replace(url, '^.*?://', ''), '/'), '^www\\.', '') end as headline from h""")
def _(t):
    """Pages by a link with a remark, a note, a captured title, or their address alone."""
    k, none = c("page_id") % 4, F.lit(None).cast("string")
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.when(k == 0, F.lit("[x](https://a.example)\nand why")).when(k == 2, title).otherwise("")
    note = F.when(k == 1, F.concat(F.lit("Only note"), c("page_id").cast("string"), F.lit("!")))
    return t("pages").select("page_id", tx.headline([], none, none, F.when(k < 2, title), note, body, none, c("url")).alias("headline"))
