"""Item queries: point lookups, upserts, reconciliation, grouping of messages, aggregates over runs, windows and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state
from ..operators import steps as st
from ..registry import query

c = F.col


# --- lookups and writes -----------------------------------------------------------------------------------------------
@query("item_by_key", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 17 and o_orderstatus in ('O', 'F', 'P')")
def _(t):
    return t("orders").where("o_orderkey = 17 and o_orderstatus in ('O', 'F', 'P')").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("item_by_local_id", """with l as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as local_id from orders) select o_orderkey, o_custkey from l where local_id = 3""")
def _(t):
    # an order is the third of its customer if exactly two come before it: ranks stop at three
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").withColumn("local_id", F.row_number().over(w)).where("local_id = 3").select("o_orderkey", "o_custkey")


@query("register_missing", "select event_type as name, false as new from (select distinct event_type from events) union all select n, true from (values ('view'), ('share'), ('mute')) v(n) where n not in (select event_type from events)")
def _(t):
    e = t("events")
    known = e.select(c("event_type").alias("name")).distinct()
    offered = e.sparkSession.createDataFrame([("view",), ("share",), ("mute",)], "name string")
    return state.insert_missing(known, offered, "name")


@query("status_exists", "select s as status, exists (select 1 from orders where o_orderstatus = s) as present from (values ('O'), ('X'), ('P')) v(s)")
def _(t):
    asked = t("orders").sparkSession.createDataFrame([("O",), ("X",), ("P",)], "status string")
    have = t("orders").select(c("o_orderstatus").alias("status"), F.lit(True).alias("present")).distinct()
    return asked.join(have, "status", "left").select("status", F.coalesce("present", F.lit(False)).alias("present"))


@query("item_upsert_revision", r"""select user_id, max(event_id) as revision, arg_max(value, event_id) as value, case when count(*) > 1 then null else arg_max(event_type, event_id) end as problems, substr(trim(regexp_replace(arg_max(props || '  x', event_id), '\s+', ' ', 'g')), 1, 160) as short_text from events group by 1""")
def _(t):
    return state.save_items(t("events").select("user_id", c("event_id").alias("revision"), "value", c("event_type").alias("problems"), F.concat("props", F.lit("  x")).alias("text")), "user_id")


@query("promote_if_current", """with s as (select user_id, max(event_id) as revision from events group by 1), r as (select event_id, user_id, event_id - (event_id % 3) * 1000000 as revision from events where event_type = 'view')
 select r.event_id, r.revision >= s.revision - 500 and r.revision <= s.revision as current, case when r.revision < s.revision - 500 then 'superseded' when event_id % 2 = 0 then 'ready' else 'failed' end as status from r join s using (user_id)""")
def _(t):
    now = t("events").groupBy("user_id").agg(F.max("event_id").alias("now"))
    done = t("events").where("event_type = 'view'").select("event_id", "user_id", (c("event_id") - (c("event_id") % 3) * 1000000).alias("revision"))
    met = done.join(now, "user_id")
    current = (c("revision") >= c("now") - 500) & (c("revision") <= c("now"))
    return met.select("event_id", current.alias("current"), F.when(c("revision") < c("now") - 500, "superseded").when(c("event_id") % 2 == 0, "ready").otherwise("failed").alias("status"))


@query("pending_in_order", "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::int as place from events where event_type = 'click'")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").where("event_type = 'click'").select("user_id", "event_id", F.row_number().over(w).alias("place"))


@query("crash_reconciliation", """select o_orderkey, case when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'promote-staging' when o_orderstatus = 'O' and o_orderkey % 3 = 0 then 'keep-inbox' when o_orderstatus = 'O' then 'mark-failed'
 when o_orderkey % 3 = 0 then 'keep-inbox' when o_orderkey % 5 = 0 then 'follow-move' when o_orderkey % 2 = 0 then 'restore-staging' else 'mark-missing' end as action from orders""")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    staged, inbox, moved = (o.where(c("o_orderkey") % k == 0).select("o_orderkey", F.lit(True).alias(name)) for k, name in ((2, "staged"), (3, "inbox"), (5, "moved")))
    met = o.join(staged, "o_orderkey", "left").join(inbox, "o_orderkey", "left").join(moved, "o_orderkey", "left").na.fill(False, ["staged", "inbox", "moved"])
    return met.select("o_orderkey", state.reconciled(c("o_orderstatus") == "O", c("staged"), c("inbox"), c("moved")).alias("action"))


@query("sync_three_way", """with r as (select o_custkey as k, count(*) as v from orders where o_orderstatus <> 'F' group by 1), d as (select o_custkey as k, count(*) as v from orders where o_orderstatus <> 'O' group by 1), l as (select distinct o_custkey as k from orders where o_orderkey % 3 = 0)
 select k, case when d.v is null or l.k is not null then null when r.v <= d.v then 'delete' else 'restore' end as decision from r left join d using (k) left join l using (k)""")
def _(t):
    side = lambda s: t("orders").where(f"o_orderstatus <> '{s}'").groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    return state.deletions(side("F"), side("O"), t("orders").where("o_orderkey % 3 = 0").select(c("o_custkey").alias("k")), "k", "v")


@query("stale_local_items", "select distinct o_custkey as k from orders where o_orderstatus = 'F' and o_custkey in (select o_custkey from orders where o_orderkey % 3 = 0) and o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def _(t):
    keys = lambda where: t("orders").where(where).select(c("o_custkey").alias("k")).distinct()
    return state.stale(keys("o_orderstatus = 'F'"), keys("o_orderstatus = 'P'"), keys("o_orderkey % 3 = 0"), "k")


# --- messages into items ----------------------------------------------------------------------------------------------
_MESSAGES = "(select event_id as message_id, user_id as chat_id, ts, case when event_id % 7 < 2 then user_id * 1000 + event_id // 40 end as album from events)"


@query("grouped_messages", f"""with u as (select chat_id, coalesce('a' || album, 'm' || message_id) as unit, min(ts) as start, max(ts) as stop, arg_min(message_id, (ts, message_id)) as first from {_MESSAGES} group by 1, 2),
 g as (select *, max(stop) over (partition by chat_id order by start, first rows between unbounded preceding and 1 preceding) as before from u),
 n as (select *, sum(case when before is null or start - before > interval 90 minute then 1 else 0 end) over (partition by chat_id order by start, first)::bigint as item from g)
 select message_id, item from {_MESSAGES} m join n on m.chat_id = n.chat_id and coalesce('a' || album, 'm' || message_id) = n.unit""")
def _(t):
    m = t("events").select(c("event_id").alias("message_id"), c("user_id").alias("chat_id"), "ts", F.when(c("event_id") % 7 < 2, c("user_id") * 1000 + F.expr("event_id div 40")).alias("album"))
    return state.grouped_messages(m, ["chat_id"], 5400.0).select("message_id", "item")


@query("batch_summary", f"""select chat_id, min(ts) as received_at, max(ts) filter (message_id % 3 = 0) as edited_at, case when count(distinct album) = 1 and count(album) = count(*) then max(album) end as media_group from {_MESSAGES} group by chat_id""")
def _(t):
    m = t("events").select(c("event_id").alias("message_id"), c("user_id").alias("chat_id"), "ts", F.when(c("event_id") % 7 < 2, c("user_id") * 1000 + F.expr("event_id div 40")).alias("album"))
    one = (F.min("album") == F.max("album")) & (F.count("album") == F.count("*"))
    return m.groupBy("chat_id").agg(F.min("ts").alias("received_at"), F.max(F.when(c("message_id") % 3 == 0, c("ts"))).alias("edited_at"), F.when(one, F.max("album")).alias("media_group"))


@query("requested_route", "select user_id, case when count(distinct event_type) filter (event_type in ('click', 'signup')) = 1 then max(event_type) filter (event_type in ('click', 'signup')) end as route from events where event_id % 5 = 0 group by 1")
def _(t):
    return state.only_value(t("events").where("event_id % 5 = 0"), "user_id", "event_type", ["click", "signup"], "route")


@query("payload_positions", """with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from events), s as (select user_id, row_number() over (partition by user_id order by event_id) as n from events where user_id % 2 = 0 or event_id % 2 = 0),
 b as (select user_id, max(r.n) as a from r group by 1), v as (select user_id, max(s.n) as a from s group by 1) select r.user_id, r.n::int as n, event_id from r join s using (user_id, n) join b using (user_id) join v using (user_id) where b.a = v.a""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    payloads = t("events").select("user_id", "event_id", F.row_number().over(w).alias("n"))
    segments = t("events").where("user_id % 2 = 0 or event_id % 2 = 0").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    return state.zipped(payloads, segments, "user_id", "n").select("user_id", "n", "event_id")


# --- runs and outcomes ------------------------------------------------------------------------------------------------
@query("report_summary", "select count(*)::bigint as total, count(*) filter (html like '%<title>%')::bigint as titled, count(*) filter (html not like '%<title>%')::bigint as untitled from pages")
def _(t):
    titled = F.contains(c("html"), F.lit("<title>"))
    return t("pages").agg(F.count("*").alias("total"), F.count_if(titled).alias("titled"), F.count_if(~titled).alias("untitled"))


@query("step_runner", """with s as (select l_orderkey as item, l_linenumber as step, l_partkey, l_suppkey, case when l_quantity < 5 then 'failed' when l_quantity < 12 then 'partial' else 'succeeded' end as outcome, l_partkey as value from lineitem),
 o as (select *, row_number() over (partition by item order by step, l_partkey, l_suppkey) as k from s)
 select item, arg_max(value, k) filter (outcome <> 'failed') as value, count(*) filter (outcome <> 'succeeded')::bigint as problems, coalesce(string_agg(outcome, ',' order by k) filter (outcome <> 'succeeded'), '') as outcomes from o group by item""")
def _(t):
    outcome = F.when(c("l_quantity") < 5, "failed").when(c("l_quantity") < 12, "partial").otherwise("succeeded")
    rows = t("lineitem").select(c("l_orderkey").alias("item"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("step"), outcome.alias("outcome"), c("l_partkey").alias("value"))
    return st.run(rows, "item")


@query("stream_comparison", """with w as (select conv_id, sum(len(string_split(text, ' '))) filter (role = 'user') as caption, sum(len(string_split(text, ' '))) filter (role = 'assistant') as recovered from conversations group by 1)
 select count(*)::bigint as posts, count(*) filter (recovered > caption)::bigint as exceeds, count(*) filter (recovered >= 3 * caption)::bigint as threefold, count(*) filter (caption < 25)::bigint as thin from w""")
def _(t):
    n = F.size(F.split("text", " ", -1))
    w = t("conversations").groupBy("conv_id").agg(F.sum(F.when(c("role") == "user", n)).alias("a"), F.sum(F.when(c("role") == "assistant", n)).alias("b"))
    return w.agg(F.count("*").alias("posts"), F.count_if(c("b") > c("a")).alias("exceeds"), F.count_if(c("b") >= 3 * c("a")).alias("threefold"), F.count_if(c("a") < 25).alias("thin"))


@query("hit_rates", """with r as (select l_suppkey as model, l_partkey % 45 + 1 as rank from lineitem) select model, count(*) filter (rank <= 1)::bigint as hit1, count(*) filter (rank <= 5)::bigint as hit5, count(*) filter (rank <= 40)::bigint as hit40, (list_sort(list(rank))[count(*) // 2 + 1])::bigint as median_rank from r group by 1""")
def _(t):
    r = t("lineitem").select(c("l_suppkey").alias("model"), (c("l_partkey") % 45 + 1).alias("rank"))
    # the upper median from counts of ranks, not from lists of them
    counts = r.groupBy("model", "rank").agg(F.count("*").alias("n"))
    w = Window.partitionBy("model")
    half = counts.withColumn("upto", F.sum("n").over(w.orderBy("rank"))).withColumn("all", F.sum("n").over(w))
    hits = lambda k: F.sum(F.when(c("rank") <= k, c("n")).otherwise(0)).alias(f"hit{k}")
    return half.groupBy("model").agg(hits(1), hits(5), hits(40), F.min(F.when(c("upto") > F.expr("all div 2"), c("rank"))).alias("median_rank"))


@query("sampling_recall", "select l_linenumber as rate, round(100.0 * sum(least(l_quantity, 20)) / sum(l_quantity), 4) as recall, round(sum(l_extendedprice) / 60 / sum(l_quantity), 4) as seconds_a_minute, greatest(512, ceil(max(l_quantity) * 25 * 1.5 / 256) * 256)::bigint as limit_mb from lineitem group by 1")
def _(t):
    return t("lineitem").groupBy(c("l_linenumber").alias("rate")).agg(
        F.round(100.0 * F.sum(F.least("l_quantity", F.lit(20.0))) / F.sum("l_quantity"), 4).alias("recall"), F.round(F.sum("l_extendedprice") / 60 / F.sum("l_quantity"), 4).alias("seconds_a_minute"),
        F.greatest(F.lit(512), F.ceil(F.max("l_quantity") * 25 * 1.5 / 256) * 256).cast("long").alias("limit_mb"),
    )


# --- windows and budgets ----------------------------------------------------------------------------------------------
@query("wall_clock_cutoff", """with r as (select l_orderkey as item, l_linenumber, l_partkey, l_suppkey, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as spent from lineitem),
 f as (select *, row_number() over (partition by item order by l_linenumber, l_partkey, l_suppkey) as k, count(*) filter (spent < 80) over (partition by item) as run from r) select item, l_linenumber, l_partkey, case when k <= run then 'run' else 'wall-clock-exceeded' end as state from f where k <= run + 1""")
def _(t):
    rows = t("lineitem").select(c("l_orderkey").alias("item"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return st.cutoff(rows, "item", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", 80).select("item", "l_linenumber", "l_partkey", "state")


@query("collapse_duplicates", """with i as (select page_id, page_id % 20 as url, page_id % 3 = 0 as sources from pages), f as (select url, min(page_id) as first from i group by 1)
 select i.page_id, first as duplicate_of, (select sources from i j where j.page_id = f.first) or not i.sources as collapse from i join f using (url) where i.page_id <> first""")
def _(t):
    i = t("pages").select("page_id", (c("page_id") % 20).alias("url"), (c("page_id") % 3 == 0).alias("sources"))
    first = i.groupBy("url").agg(F.min_by(F.struct(c("page_id").alias("first"), c("sources").alias("had")), "page_id").alias("r")).select("url", "r.*")
    return i.join(first, "url").where("page_id <> first").select("page_id", c("first").alias("duplicate_of"), (c("had") | ~c("sources")).alias("collapse"))


@query("shared_budget_passes", """with p as (select l_orderkey as item, case when l_linenumber <= 3 then 1 else 2 end as pass, l_linenumber, l_partkey, l_suppkey from lineitem), r as (select *, row_number() over (partition by item order by pass, l_linenumber, l_partkey, l_suppkey) as k from p) select item, pass, l_linenumber, l_partkey from r where k <= 4""")
def _(t):
    p = t("lineitem").select(c("l_orderkey").alias("item"), F.when(c("l_linenumber") <= 3, 1).otherwise(2).alias("pass"), "l_linenumber", "l_partkey", "l_suppkey")
    k = F.row_number().over(Window.partitionBy("item").orderBy("pass", "l_linenumber", "l_partkey", "l_suppkey"))
    return p.withColumn("k", k).where("k <= 4").select("item", "pass", "l_linenumber", "l_partkey")


@query("global_numbering", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey)::bigint as n, o_orderdate::date is distinct from lag(o_orderdate::date) over (order by o_orderdate, o_orderkey) as new_day from orders")
def _(t):
    return state.numbered(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "n", "new_day")


@query("comment_threads", """with r as (select *, row_number() over (partition by l_orderkey, l_suppkey % 3 order by l_linenumber, l_partkey) as k from lineitem where l_linenumber > 1), a as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from r where k <= 2),
 p as (select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderdate, o_orderkey) as rank from orders) select l_orderkey, l_linenumber, l_partkey from a join p on l_orderkey = o_orderkey where n <= 3 and rank <= 5""")
def _(t):
    r = t("lineitem").where("l_linenumber > 1").select("l_orderkey", "l_linenumber", "l_partkey", (c("l_suppkey") % 3).alias("thread"))
    k = F.row_number().over(Window.partitionBy("l_orderkey", "thread").orderBy("l_linenumber", "l_partkey"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    replies = r.withColumn("k", k).where("k <= 2").withColumn("n", n).where("n <= 3")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey"))
    parents = t("orders").withColumn("rank", rank).where("rank <= 5").select("o_orderkey")
    return replies.join(parents, c("l_orderkey") == c("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("common_destinations", "select l_suppkey, count(*)::bigint as n from lineitem group by 1 order by n desc, l_suppkey limit 6")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(6)


@query("cache_join", "select page_id, case when page_id % 3 = 0 then 'cached' else 'computed' end as source, case when page_id % 3 = 0 then page_id * 10 else length(url) end as value from pages")
def _(t):
    p = t("pages").select("page_id", "url")
    cached = p.where("page_id % 3 = 0").select("page_id", (c("page_id") * 10).alias("value"))
    return state.through_cache(p, cached, "page_id", F.length("url").cast("long"))


@query("ordered_union_distinct", "with u as (select lang as x, doc_id as o from documents union all select source, doc_id + 1000000 from documents) select x, min(o)::bigint as first from u where x is not null group by 1")
def _(t):
    d = t("documents")
    u = d.select(c("lang").alias("x"), c("doc_id").alias("o")).unionByName(d.select(c("source").alias("x"), (c("doc_id") + 1000000).alias("o")))
    return u.where("x is not null").groupBy("x").agg(F.min("o").alias("first"))


@query("term_set_algebra", r"""with s as (select conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')) filter (role = 'user'))) as a, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')) filter (role = 'assistant'))) as b from conversations group by 1)
 select conv_id, len(list_intersect(a, b))::int as both, (len(a) + len(b) - len(list_intersect(a, b)))::int as either, (len(a) - len(list_intersect(a, b)))::int as missing, (len(b) - len(list_intersect(a, b)))::int as extra, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double, 6) as jaccard from s where len(a) > 0 and len(b) > 0""")
def _(t):
    # distinct words before they are gathered: a side's words, not its texts, bound the arrays
    w = t("conversations").where("role in ('user', 'assistant')").select("conv_id", "role", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    per = w.groupBy("conv_id", "word").agg(F.bool_or(c("role") == "user").alias("a"), F.bool_or(c("role") == "assistant").alias("b"))
    n = lambda x: F.count_if(x).cast("int")
    out = per.groupBy("conv_id").agg(n(c("a") & c("b")).alias("both"), n(c("a") | c("b")).alias("either"), n(c("a") & ~c("b")).alias("missing"), n(c("b") & ~c("a")).alias("extra"))
    return out.where((c("both") + c("missing") > 0) & (c("both") + c("extra") > 0)).withColumn("jaccard", F.round(c("both") / c("either"), 6))


@query("valid_names", r"""select page_id, regexp_matches(n, '^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]+$') as item, regexp_matches(r, '^[a-z][a-z0-9_]{0,31}$') as route from (select page_id, case when page_id % 2 = 0 then '2026-01-0' || page_id % 10 || '_' || page_id else 'x' || page_id end as n, case when page_id % 3 = 0 then 'job_' || page_id else 'Job' end as r from pages)""")
def _(t):
    name = F.expr("case when page_id % 2 = 0 then '2026-01-0' || page_id % 10 || '_' || page_id else 'x' || page_id end")
    route = F.expr("case when page_id % 3 = 0 then 'job_' || page_id else 'Job' end")
    return t("pages").select("page_id", name.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]+$").alias("item"), route.rlike(r"^[a-z][a-z0-9_]{0,31}$").alias("route"))


@query("attachment_rules", """select event_id, case when value > 90 then 'too-large' when event_type = 'error' then 'ignored' else 'download' end as action, case when event_type = 'view' then 'voice' when event_type = 'click' then 'text' when value > 50 then 'caption' else 'message' end as kind from events""")
def _(t):
    kind = F.when(c("event_type") == "view", "voice").when(c("event_type") == "click", "text").when(c("value") > 50, "caption").otherwise("message")
    return t("events").select("event_id", F.when(c("value") > 90, "too-large").when(c("event_type") == "error", "ignored").otherwise("download").alias("action"), kind.alias("kind"))
