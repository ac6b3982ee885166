"""State, sessions, links, text, retrieval and media queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ur
from ..operators import search, state
from ..registry import query
from .links import _canonical

c = F.col


# --- state ------------------------------------------------------------------------------------------------------------
@query("status_counts_zero_filled", "select event_type, count(e.event_id)::bigint as n from (select unnest(['click','error','purchase','signup','view','failed']) as event_type) left join events e using (event_type) group by 1")
def _(t):
    domain = t("events").sparkSession.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "failed")], "event_type string")
    return state.zero_filled_counts(t("events"), "event_type", domain)


@query("processor_outcomes_pivot", "select user_id, count(*)::bigint as runs, count(*) filter (event_type = 'view')::bigint as view, count(*) filter (event_type = 'click')::bigint as click, count(*) filter (event_type = 'error')::bigint as error from events group by 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("runs"), *(F.count_if(c("event_type") == k).alias(k) for k in ("view", "click", "error")))


@query("reason_counts", "select user_id, event_type, json_extract_string(props, '$.k') as reason, count(*)::bigint as n from events group by 1, 2, 3")
def _(t):
    return t("events").groupBy("user_id", "event_type", F.get_json_object("props", "$.k").alias("reason")).agg(F.count("*").alias("n"))


@query("reasons_nested", "with r as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as reasons from r group by 1")
def _(t):
    r = t("events").groupBy("user_id", "event_type").count()
    return r.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", c("count").cast("string")))), ",").alias("reasons"))


@query("message_item_join", "select l_orderkey, l_linenumber, o_custkey, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'")
def _(t):
    o = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")
    return t("lineitem").select("l_orderkey", "l_linenumber").join(o, c("l_orderkey") == c("o_orderkey")).drop("o_orderkey")


@query("items_with_status", "select o_orderkey, o_orderdate from orders where o_orderstatus = 'O'")
def _(t):
    return t("orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate")).select("o_orderkey", "o_orderdate")


@query("pending_distinct_chats", "select distinct event_type, user_id from events")
def _(t):
    return t("events").select("event_type", "user_id").distinct()


@query("pending_clear_anti", "select event_id, user_id from events where event_id not in (select event_id from events where event_type = 'error' or event_id % 10 = 3)")
def _(t):
    e = t("events")
    return e.select("event_id", "user_id").join(e.where("event_type = 'error' or event_id % 10 = 3").select("event_id").distinct(), "event_id", "left_anti")


@query("queue_pop", "select o_orderkey, o_orderdate, o_custkey from orders where o_orderstatus = 'O' order by o_orderdate, o_custkey, o_orderkey limit 1")
def _(t):
    return t("orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_custkey", "o_orderkey").limit(1).select("o_orderkey", "o_orderdate", "o_custkey")


@query("latest_revision_upsert", "select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1")
def _(t):
    return state.latest(t("events").select("user_id", "event_id", "event_type", "value", c("event_id").alias("_o")), ["user_id"], "_o").drop("_o")


@query("sequence_allocate", "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id)::int as local_id from events")
def _(t):
    return t("events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("local_id"))


@query("item_bundle", "select conv_id, count(*)::bigint as n, string_agg(role, '>' order by turn, role) as roles from conversations group by 1")
def _(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"))


@query("sync_delta", "with r as (select o_custkey as k, count(*) as v from orders where o_orderstatus <> 'F' group by 1), d as (select o_custkey as k, count(*) as v from orders where o_orderstatus <> 'O' group by 1) select k, case when d.v is null then 'add' when r.v is null then 'delete' when r.v > d.v then 'update' else 'keep' end as action from r full join d using (k)")
def _(t):
    side = lambda s: t("orders").where(f"o_orderstatus <> '{s}'").groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    return state.delta(side("F"), side("O"), "k", "v")


@query("oldest_age", "select event_type, count(*)::bigint as n, greatest(date_diff('day', min(ts)::date, date '2026-01-01'), 0)::int as oldest_days from events group by 1")
def _(t):
    age = F.greatest(F.datediff(F.lit("2026-01-01").cast("date"), F.min("ts").cast("date")), F.lit(0))
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), age.alias("oldest_days"))


@query("status_lattice", "select conv_id, case when not bool_or(role = 'assistant') then 'failed' when bool_or(role = 'system') then 'partial' else 'ok' end as status, coalesce(arg_min(role, turn) filter (role <> 'assistant'), '') as reason from conversations group by 1")
def _(t):
    some = F.bool_or(c("role") == "assistant")
    status = F.when(~some, "failed").when(F.bool_or(c("role") == "system"), "partial").otherwise("ok")
    return t("conversations").groupBy("conv_id").agg(status.alias("status"), F.coalesce(F.min_by(F.when(c("role") != "assistant", c("role")), F.when(c("role") != "assistant", c("turn"))), F.lit("")).alias("reason"))


# --- sessions and windows ---------------------------------------------------------------------------------------------
_SESSION = "select event_id, user_id, sum(new) over (partition by user_id order by ts, event_id)::bigint as session from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 2 hour then 1 else 0 end as new from events)"


@query("session_gap_groups", _SESSION)
def _(t):
    return state.gap_sessions(t("events"), ["user_id"], "ts", "event_id", 7200).select("event_id", "user_id", "session")


@query("session_counts", f"select user_id, session, count(*)::bigint as n from ({_SESSION}) group by 1, 2")
def _(t):
    return state.gap_sessions(t("events"), ["user_id"], "ts", "event_id", 7200).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("session_window_counts", f"select user_id, count(distinct session)::bigint as sessions from ({_SESSION}) group by 1")
def _(t):
    w = t("events").groupBy("user_id", F.session_window(c("ts").cast("timestamp"), "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("adjacent_note_candidates", "select conv_id, turn from (select *, lag(role) over w as p, lead(role) over w as n from conversations window w as (partition by conv_id order by turn)) where role = 'user' and (p = 'system' or n = 'assistant')")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = t("conversations").withColumns({"p": F.lag("role").over(w), "n": F.lead("role").over(w)})
    return r.where("role = 'user' and (p = 'system' or n = 'assistant')").select("conv_id", "turn")


@query("exactly_one_note", "select conv_id, min(turn) as turn from conversations where role = 'user' group by 1 having count(*) = 1")
def _(t):
    return t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("fair_share_budget", "with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint as q, least(l_quantity::bigint, greatest(60 // count(*) over (partition by l_orderkey), 1)) as a from lineitem), p as (select *, 60 - sum(a) over (partition by l_orderkey) as spare, coalesce(sum(q - a) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as before from s) select l_orderkey, l_linenumber, l_partkey, (a + least(q - a, greatest(spare - before, 0)))::bigint as granted from p")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("long").alias("q"))
    return state.fair_share(rows, ["l_orderkey"], "q", ["l_linenumber", "l_partkey", "l_suppkey"], 60).drop("q", "l_suppkey")


@query("prefix_budget", "select l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) < 60 as taken from lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)) < 60).alias("taken"))


@query("digest_numbering", "select o_orderkey, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey)::int as n from orders")
def _(t):
    return t("orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")).alias("n"))


@query("popular_topk", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc nulls last, ts, event_id) as r from events) where r <= 3")
def _(t):
    w = Window.partitionBy("user_id").orderBy(c("value").desc_nulls_last(), "ts", "event_id")
    return t("events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id", "value")


@query("thread_replies_limits", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id, role order by turn) as r, row_number() over (partition by conv_id order by turn) as n from conversations) where r <= 2 and n <= 10")
def _(t):
    r = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").withColumns({"r": r, "n": n}).where("r <= 2 and n <= 10").select("conv_id", "turn", "role")


# --- links ------------------------------------------------------------------------------------------------------------
_CANON = f"select page_id, canonical from {_canonical('(select page_id, url from pages)')}"


@query("link_canonicalize", _CANON)
def _(t):
    return t("pages").select("page_id", ur.canonical(c("url")).alias("canonical"))


@query("link_dedupe_first", f"select page_id, case when page_id <> f then f end as duplicate_of from (select page_id, min(page_id) over (partition by canonical) as f from ({_CANON}))")
def _(t):
    keyed = t("pages").select("page_id", ur.canonical(c("url")).alias("k"))
    return state.first_wins(keyed, "k", "page_id").drop("k")


@query("host_buckets", "select regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') as host, count(*)::bigint as n from pages group by 1")
def _(t):
    return t("pages").groupBy(ur.bare_host(c("url")).alias("host")).agg(F.count("*").alias("n"))


@query("link_cache_key", f"select page_id, substr(sha256(canonical), 1, 16) as cache_key from ({_CANON})")
def _(t):
    return t("pages").select("page_id", ur.cache_key(ur.canonical(c("url"))).alias("cache_key"))


@query("budget_topk", "select host, page_id, rank from (select *, row_number() over (partition by host order by page_id)::int as rank, count(*) over (partition by host) as n from (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') as host from pages)) where rank <= case when n >= 8 then 2 else 5 end")
def _(t):
    return state.budgeted(t("pages").select("page_id", ur.bare_host(c("url")).alias("host")), ["host"], ["page_id"])


@query("sole_link_flag", "select page_id, count(*) over (partition by lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))) = 1 as sole from pages")
def _(t):
    # counts by partial aggregation: a host with many pages is not one task
    rows = t("pages").select("page_id", ur.host(c("url")).alias("host"))
    return rows.join(rows.groupBy("host").agg((F.count("*") == 1).alias("sole")), "host").select("page_id", "sole")


@query("html_title_h1", r"select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) as h1 from pages")
def _(t):
    tag = lambda n: F.trim(F.regexp_extract("html", rf"(?is)<{n}[^>]*>(.*?)</{n}>", 1))
    return t("pages").select("page_id", tag("title").alias("title"), tag("h1").alias("h1"))


@query("html_links", r"select page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*href'))::bigint as n_links from pages")
def _(t):
    return t("pages").select("page_id", F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href")).cast("long").alias("n_links"))


# --- text -------------------------------------------------------------------------------------------------------------
@query("clean_whitespace", r"select doc_id, trim(regexp_replace(regexp_replace(text, '(\S) {2,}', '\1 ', 'g'), ' +([.,!?;:])', '\1', 'g'), ' ') as clean from documents")
def _(t):
    return t("documents").select("doc_id", tx.tidy_spaces(c("text")).alias("clean"))


@query("hashtag_unwrap", r"select doc_id, regexp_replace(regexp_replace(text, '\bhashtag#([a-zA-Z][a-zA-Z0-9_]*)', '\1', 'g'), '(^|\s)#([a-zA-Z][a-zA-Z0-9_]*)', '\1\2', 'g') as clean from documents")
def _(t):
    return t("documents").select("doc_id", tx.unwrap_hashtags(c("text")).alias("clean"))


@query("word_counts", r"select doc_id, len(regexp_extract_all(text, '\S+'))::int as n_words from documents")
def _(t):
    return t("documents").select("doc_id", F.size(tx.words(c("text"))).alias("n_words"))


@query("line_dedupe_in_document", "select doc_id, array_to_string(list_transform(list_filter(list_zip(ls, range(1, len(ls) + 1)), lambda p: list_position(ls, p[1]) = p[2]), lambda p: p[1]), chr(10)) as text from (select doc_id, string_split(text, chr(10)) as ls from documents)")
def _(t):
    return t("documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n").alias("text"))


@query("line_numbers", "select doc_id, unnest(range(1, len(ls) + 1))::int as line_no, length(unnest(ls))::int as chars from (select doc_id, string_split(text, chr(10)) as ls from documents)")
def _(t):
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", (c("p") + 1).alias("line_no"), F.length("line").alias("chars"))


_STOPS = "('" + "','".join(x.replace("'", "''") for x in tx.STOP) + "')"
_TERMS = f"list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9][a-z0-9+.#_-]*'), lambda t: length(t) > 1 and t not in {_STOPS})"


@query("tokenize_terms", f"select doc_id, len({_TERMS.format(x='text')})::int as n_terms from documents")
def _(t):
    return t("documents").select("doc_id", F.size(tx.terms(c("text"))).alias("n_terms"))


@query("doc_freq_idf", f"with p as (select distinct doc_id, unnest({_TERMS.format(x='text')}) as term from documents) select term, count(*)::bigint as df, round(ln(1 + ((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from p group by 1")
def _(t):
    d = t("documents")
    terms = d.select(F.explode(F.array_distinct(tx.terms(c("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("term", "df", F.round(search.idf(c("n"), c("df")), 6).alias("idf"))


def _bm25(asked: str) -> str:
    """SQL: (item_id, doc_id, score) of documents for the queries of asked(item_id, text)."""
    return f"""(with d as (select doc_id, {_TERMS.format(x='text')} as ts from documents), p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from d) group by 1, 2),
 s as (select doc_id, len(ts) as l from d), w as (select count(*) as n, avg(l) as al from s), f as (select term, count(*) as df from p group by 1), q as (select distinct item_id, unnest({_TERMS.format(x='text')}) as term from {asked})
 select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.4 + 0.6 * l / al))), 6) as score from q join f using (term) join p using (term) join s using (doc_id), w group by 1, 2)"""


@query("bm25_top5_documents", f"select item_id, doc_id, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from {_bm25('benchmark')}) where rank <= 5")
def _(t):
    return search.bm25_best(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text", 5).select("item_id", "doc_id", "rank")


@query("bm25_pool_by_corpus", f"""select item_id, lang, doc_id, rank from (select *, row_number() over (partition by item_id, lang order by score desc, doc_id)::int as rank from (select r.*, lang from {_bm25('benchmark')} r join documents using (doc_id) where score > 0)) where rank <= 20""")
def _(t):
    found = search.bm25_best(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text", 20, "lang")
    return found.where("score > 0").select("item_id", "lang", "doc_id", "rank")


@query("neighbours_under_quotas", f"""with s as (select r.*, coalesce(lang, '') as bucket, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id % 50 as file from {_bm25('benchmark')} r join documents using (doc_id) where score >= 4),
 f as (select *, row_number() over (partition by item_id, bucket, file order by score desc, doc_id) as k from s)
 select item_id, bucket, file, doc_id, rank from (select *, row_number() over (partition by item_id, bucket order by score desc, doc_id)::int as rank from f where k = 1) where rank <= 2""")
def _(t):
    where = t("documents").where("doc_id is not null").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("bucket"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), (c("doc_id") % 50).cast("string")).alias("file"))
    scored = search.bm25_files(where, "doc_id", "text", t("benchmark"), "item_id", "text", 2, "bucket", "file", 4.0)
    return search.neighbours(scored, "item_id", "bucket", "file", "doc_id", 4.0).select("item_id", "bucket", "file", "doc_id", "rank")


_TITLES = f"""(select page_id as item_id, canonical as url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as text from (select canonical, min(page_id) as page_id from ({_CANON}) group by 1) join (select page_id, html from pages) using (page_id)
 where trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '')"""


@query("flagship_nearest_passages", f"""select page_id, url, title, doc_id, score, rank from (select item_id as page_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from {_bm25(_TITLES)}) join (select item_id as page_id, url, text as title from {_TITLES}) using (page_id) where rank <= 2""")
def _(t):
    pages = t("pages").select("page_id", ur.canonical(c("url")).alias("url"), F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
    kept = pages.groupBy("url").agg(F.min_by(F.struct("page_id", "title"), "page_id").alias("r")).select("r.page_id", "url", "r.title").where("title <> ''")
    best = search.bm25_best(t("documents"), "doc_id", "text", kept, "page_id", "title", 2)
    return kept.join(best, "page_id")


@query("jaccard_tokens", r"with s as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as ts from benchmark) select a.item_id as a, b.item_id as b, round(len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts)))::double, 6) as jaccard from s a join s b on b.item_id = a.item_id + 1")
def _(t):
    s = t("benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("ts"))
    o = s.select((c("item_id") - 1).alias("item_id"), c("item_id").alias("b"), c("ts").alias("tb"))
    n = F.size(F.array_intersect("ts", "tb"))
    return s.join(o, "item_id").select(c("item_id").alias("a"), "b", F.round(n / (F.size("ts") + F.size("tb") - n), 6).alias("jaccard"))


@query("exact_key_collapse", r"select min(doc_id) as doc_id, count(*)::bigint as n from documents group by lower(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g'))")
def _(t):
    return t("documents").groupBy(F.sha2(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", "")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@query("label_quality_rollup", "select source, count(*)::bigint as docs, count(l.doc_id)::bigint as labelled, coalesce(sum(quality), 0)::bigint as good, coalesce(sum(toxic), 0)::bigint as toxic from documents d left join labels l using (doc_id) group by 1")
def _(t):
    l = t("labels").withColumn("has", F.lit(1))  # noqa: E741
    return t("documents").select("doc_id", "source").join(l, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("docs"), F.count("has").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))


# --- media ------------------------------------------------------------------------------------------------------------
@query("band_self_join", "select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and a.event_id < b.event_id and b.ts <= a.ts + interval 30 minute and a.ts <= b.ts + interval 30 minute")
def _(t):
    e = t("events").select("event_id", "user_id", F.unix_micros(c("ts").cast("timestamp")).alias("u"))
    width = 1_800_000_000
    left = e.withColumn("cell", F.explode(F.expr(f"sequence(u div {width} - 1, u div {width} + 1)")))
    right = e.select(c("event_id").alias("b"), "user_id", c("u").alias("ub"), F.expr(f"u div {width}").alias("cell"))
    return left.join(right, ["user_id", "cell"]).where((c("event_id") < c("b")) & (F.abs(c("u") - c("ub")) <= width)).select(c("event_id").alias("a"), "b")


@query("stride_sampling", "select event_id from events where event_id % greatest(1, round(30 / 4.0)::int) = 0")
def _(t):
    stride = max(1, round(30 / 4.0))
    return t("events").where(F.pmod("event_id", F.lit(stride)) == 0).select("event_id")


@query("merge_tracks", "select user_id, event_type, max(value) as confidence, min(ts) as first_seen, max(ts) as last_seen, count(*)::bigint as observations, arg_max(event_id, (ts, event_id)) as last_event from events group by 1, 2")
def _(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max("value").alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("observations"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
