"""Smaller rules: tallies around cleaning, caption spans, script calibration, row clusters, destinations, blocks, authors, identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..registry import query

c = F.col


@query("cleaning_tallies", r"""select lang, sum(length(text))::bigint as chars, sum(length(trim(regexp_replace(regexp_replace(text, '(\S) {2,}', '\1 ', 'g'), ' +([.,!?;:])', '\1', 'g'), ' ')))::bigint as chars_after, sum(len(string_split(text, chr(10))))::bigint as lines, count(*) filter (contains(text, 'http'))::bigint as with_urls from documents group by 1""")
def _(t):
    return t("documents").groupBy("lang").agg(
        F.sum(F.length("text")).alias("chars"), F.sum(F.length(tx.tidy_spaces(c("text")))).alias("chars_after"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.count_if(F.contains("text", F.lit("http"))).alias("with_urls")
    )


@query("caption_span", "select user_id, round(least(1.0, (max(epoch(ts)) - min(epoch(ts))) / 2600000.0), 6) as span from events group by 1")
def _(t):
    s = F.unix_micros(c("ts").cast("timestamp")) / 1e6
    return t("events").groupBy("user_id").agg(F.round(F.least(F.lit(1.0), (F.max(s) - F.min(s)) / 2600000.0), 6).alias("span"))


@query("script_calibration", "with f as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events), s as (select user_id, event_type, round(avg(value), 6) as score from f where k <= 8 group by 1, 2) select user_id, arg_max(event_type, (score, event_type)) as script from s group by 1")
def _(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = t("events").withColumn("k", k).where("k <= 8").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("score"))
    return s.groupBy("user_id").agg(F.max_by("event_type", F.struct("score", "event_type")).alias("script"))


@query("row_clusters", "with r as (select user_id, event_id, value, lag(value) over (partition by user_id order by value desc, event_id) as before from events where value is not null) select user_id, event_id, sum((before is null or before - value > 3)::int) over (partition by user_id order by value desc, event_id)::bigint as row from r")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    gap = F.coalesce(F.lag("value").over(w) - c("value") > 3, F.lit(True)).cast("long")
    return t("events").where("value is not null").withColumn("g", gap).select("user_id", "event_id", F.sum("g").over(w).alias("row"))


@query("adjacent_equal_ratio", "with l as (select doc_id, unnest(string_split(x, '')) as ch, generate_subscripts(string_split(x, ''), 1) as k from (select doc_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) as x from documents) where length(x) >= 40), p as (select doc_id, ch = lag(ch) over (partition by doc_id order by k) as twin from l) select doc_id, count(*) filter (twin) >= 0.2 * count(*) as doubled from p group by 1")
def _(t):
    x = F.regexp_replace("text", "[^A-Za-z]", "")
    return t("documents").where(F.length(x) >= 40).select("doc_id", tx.duplicate_layer(x).alias("doubled"))


@query("plan_destination", "select l_orderkey as item, arg_max(l_suppkey, (l_extendedprice, l_linenumber)) filter (l_extendedprice >= 30000) as destination from lineitem group by 1")
def _(t):
    clear = F.when(c("l_extendedprice") >= 30000, F.struct("l_extendedprice", "l_linenumber"))
    return t("lineitem").groupBy(c("l_orderkey").alias("item")).agg(F.max_by("l_suppkey", clear).alias("destination"))


@query("best_title_block", "select l_orderkey as page, arg_max(l_partkey, (l_quantity, l_linenumber, l_partkey)) as block from lineitem group by 1")
def _(t):
    return t("lineitem").groupBy(c("l_orderkey").alias("page")).agg(F.max_by("l_partkey", F.struct("l_quantity", "l_linenumber", "l_partkey")).alias("block"))


@query("few_authors", "select l_orderkey as paper, case when count(*) <= 3 then string_agg('' || l_partkey, ',' order by l_linenumber, l_partkey) else '' end as wanted, array_to_string(list('' || l_partkey order by l_linenumber, l_partkey)[1:3], ', ') as shown from lineitem group by 1")
def _(t):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return t("lineitem").groupBy(c("l_orderkey").alias("paper")).agg(ids.alias("ids")).select("paper", F.when(F.size("ids") <= 3, F.array_join("ids", ",")).otherwise("").alias("wanted"), F.array_join(F.slice("ids", 1, 3), ", ").alias("shown"))


_BEGIN, _END = "<!-- neighbours:begin -->", "<!-- neighbours:end -->"  # fixed values


@query("annotated_blocks", f"""select page_id, case when contains(body, '## Problems') then replace(body, chr(10) || '## Problems', chr(10) || block || chr(10) || chr(10) || '## Problems') else body || chr(10) || chr(10) || block || chr(10) end as page from (select page_id, 'T' || page_id || case when page_id % 3 = 0 then chr(10) || '## Problems' || chr(10) else '' end as body, '{_BEGIN}' || chr(10) || 'new' || chr(10) || '{_END}' as block from pages)""")
def _(t):
    # pages that were annotated before: the old block goes with the blank lines around it
    old = F.concat(F.lit(f"\n\n{_BEGIN}\nold "), c("page_id").cast("string"), F.lit(f"\n{_END}\n"))
    body = F.concat(F.lit("T"), c("page_id").cast("string"), old, F.when(c("page_id") % 3 == 0, "\n## Problems\n").otherwise(""))
    bare = F.regexp_replace(body, rf"(?s)\n*{_BEGIN}.*?{_END}\n*", "\n")
    block = f"{_BEGIN}\nnew\n{_END}"
    return t("pages").select("page_id", tx.annotate(bare, block).alias("page"))


@query("author_comments", "select a.conv_id, b.turn from (select conv_id, role, turn % 2 as profile from conversations where turn = 0) a join (select conv_id, role, turn, case when turn % 3 = 0 then null else turn % 2 end as profile from conversations where turn > 0) b on a.conv_id = b.conv_id and (a.profile = b.profile or (b.profile is null and a.role = b.role))")
def _(t):
    x = t("conversations")
    author = x.where("turn = 0").select("conv_id", c("role").alias("name"), (c("turn") % 2).alias("profile"))
    comment = x.where("turn > 0").select("conv_id", c("role").alias("their_name"), "turn", F.when(c("turn") % 3 != 0, c("turn") % 2).alias("their_profile"))
    same = (c("profile") == c("their_profile")) | ((c("profile").isNull() | c("their_profile").isNull()) & (c("name") == c("their_name")))
    return author.join(comment, "conv_id").where(same).select("conv_id", "turn")


@query("neighbour_queries", r"""select page_id, concat_ws('. ', nullif(title, ''), note, array_to_string(list_filter(regexp_split_to_array(lead, '\s+'), lambda w: w <> '')[1:120], ' ')) as query from (select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, case when page_id % 2 = 0 then 'note ' || page_id end as note, regexp_replace(html, '<[^>]*>', ' ', 'g') as lead from pages)""")
def _(t):
    title = F.nullif(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    lead = F.array_join(F.slice(tx.words(F.regexp_replace("html", "<[^>]*>", " ")), 1, 120), " ")
    return t("pages").select("page_id", F.concat_ws(". ", title, F.when(c("page_id") % 2 == 0, F.concat(F.lit("note "), c("page_id").cast("string"))), lead).alias("query"))


@query("author_names", """select event_id, case event_id % 4 when 0 then ['A', 'B'] when 1 then ['C'] when 2 then ['D ' || event_id] else [] end as authors from events""")
def _(t):
    text = F.expr("""case event_id % 4 when 0 then '["A", {"name": " B "}]' when 1 then '"C"' when 2 then '{"name": "D ' || event_id || '"}' else 'null' end""")
    return t("events").select("event_id", tx.author_names(text).alias("authors"))
