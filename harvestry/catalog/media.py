"""Media, date and page queries: recognised text, captions, moments, titles, over values made from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import alike
from ..functions import media as me
from ..functions import nested
from ..functions import urls as ur
from ..operators import frames as fr
from ..operators import fuzzy
from ..registry import query

c = F.col

#: Recognised lines: a box, a confidence and a number of observations for each event, in both dialects.
_BOX = {"x": "(event_id * 37 % 97) / 100.0", "y": "(event_id * 53 % 89) / 100.0", "w": "(event_id * 11 % 23 + 1) / 100.0", "h": "(event_id * 7 % 13 + 1) / 100.0"}
_SQL = ", ".join(f"({v})::double as {k}" for k, v in _BOX.items())
_TEXT = "case event_id % 5 when 0 then 'Ab' when 1 then '...' when 2 then 'A longer line of text' when 3 then 'H3' else 'Hello world' end"


def _boxes(t, *more):
    return t("events").select("event_id", "user_id", F.struct(*(F.expr(v).cast("double").alias(k) for k, v in _BOX.items())).alias("box"), *more)


@query("box_relations", f"""with b as (select event_id, user_id, {_SQL} from events), p as (select a.event_id as a, b.event_id as b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as i, a.w * a.h + b.w * b.h as u,
 abs(a.y + a.h / 2 - b.y - b.h / 2) <= greatest(a.h, b.h) * 1.15 as row, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= least(a.w, b.w) * 0.08 as wide from b a join b b on a.user_id = b.user_id and b.event_id > a.event_id and b.event_id <= a.event_id + 30)
 select a, b, round(i / (u - i), 6) as iou, i / (u - i) >= 0.06 or (row and wide) as related from p""")
def _(t):
    # a band of neighbouring ids per source: cells of the band's width, met with themselves and the next
    left = _boxes(t).withColumn("cell", F.explode(F.array(F.expr("event_id div 30"), F.expr("event_id div 30 + 1"))))
    right = _boxes(t).select(c("event_id").alias("b"), "user_id", c("box").alias("other"), F.expr("event_id div 30").alias("cell"))
    met = left.join(right, ["user_id", "cell"]).where((c("b") > c("event_id")) & (c("b") <= c("event_id") + 30))
    return met.select(c("event_id").alias("a"), "b", F.round(me.iou(c("box"), c("other")), 6).alias("iou"), me.spatially_related(c("box"), c("other")).alias("related"))


@query("polygon_boxes", f"select event_id, round(least(x, x + w), 6) as x, round(1 - (y + h), 6) as y, round(w, 6) as w, round(h, 6) as h from (select event_id, {_SQL} from events)")
def _(t):
    b = c("box")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    polygon = F.array(point(b["x"], b["y"]), point(b["x"] + b["w"], b["y"]), point(b["x"] + b["w"], b["y"] + b["h"]), point(b["x"], b["y"] + b["h"]))
    return _boxes(t).select("event_id", me.bounding_box(polygon).alias("r")).select("event_id", *(F.round(f"r.{k}", 6).alias(k) for k in "xywh"))


_N = r"length(regexp_replace(text, '[^\pL\pN]', '', 'g'))"
_NORMAL = "(case when fps <= 0 then 3 else greatest(2, ceil(fps * 0.10)) end)::int"
_SHORT = "(case when fps <= 0 then 3 else greatest(3, ceil(fps * 0.25)) end)::int"


@query("useful_segments", f"""select event_id, {_NORMAL} as normal, {_SHORT} as short, {_N} > 0 and confidence >= 0.45 and not ({_N} <= 3 and seen < {_SHORT}) and not (video and seen < {_NORMAL} and not ({_N} >= 12 and confidence >= 0.9)) as useful
 from (select event_id, {_TEXT} as text, (event_id % 20) / 20.0::double as confidence, event_id % 9 as seen, (event_id % 4) * 10.0::double as fps, event_id % 2 = 0 as video from events)""")
def _(t):
    rows = t("events").select("event_id", F.expr(_TEXT).alias("text"), (c("event_id") % 20 / 20.0).alias("confidence"), (c("event_id") % 9).alias("seen"), (c("event_id") % 4 * 10.0).alias("fps"), (c("event_id") % 2 == 0).alias("video"))
    return rows.select("event_id", me.least_observations(c("fps"))["normal"].alias("normal"), me.least_observations(c("fps"))["short"].alias("short"), me.useful(c("text"), c("confidence"), c("seen"), c("fps"), c("video")).alias("useful"))


@query("merged_segments", f"""select user_id, lower(regexp_replace({_TEXT}, '[^A-Za-z0-9_]+', '', 'g')) as key, count(*)::bigint as observations, max(value) as confidence, min(ts) as first_seen, max(ts) as last_seen, arg_max(event_id, (ts, event_id)) as box_of, arg_min(event_id, event_id) as first from events group by 1, 2""")
def _(t):
    rows = t("events").withColumn("key", alike.text_key(F.expr(_TEXT)))
    return rows.groupBy("user_id", "key").agg(F.count("*").alias("observations"), F.max("value").alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_id", F.struct("ts", "event_id")).alias("box_of"), F.min("event_id").alias("first"))


@query("consensus_variant", """with v as (select user_id, event_type as text, count(*) as n, avg(value) as conf from events group by 1, 2) select user_id, arg_max(text, (n, round(conf, 6), length(text), text)) as text from v group by 1""")
def _(t):
    v = t("events").groupBy("user_id", c("event_type").alias("text")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("conf"))
    return v.groupBy("user_id").agg(F.max_by("text", F.struct("n", "conf", F.length("text"), "text")).alias("text"))


@query("reading_order", f"select event_id, row_number() over (partition by user_id, event_id // 50 order by -(round(y + h, 6)), x, event_id)::int as place from (select event_id, user_id, {_SQL} from events)")
def _(t):
    b = c("box")
    w = Window.partitionBy("user_id", F.expr("event_id div 50")).orderBy(-F.round(b["y"] + b["h"], 6), b["x"], "event_id")
    return _boxes(t).select("event_id", F.row_number().over(w).alias("place"))


@query("subsumed_segments", """with s as (select distinct user_id, substr('abcdefghij', 1, 1 + (event_id % 7)::int) || case when event_id % 3 = 0 then 'x' else '' end as key from events) select user_id, key from s a where length(key) >= 2 and exists (select 1 from s b where b.user_id = a.user_id and length(b.key) > length(a.key) and contains(b.key, a.key))""")
def _(t):
    key = F.expr("substr('abcdefghij', 1, 1 + cast(event_id % 7 as int)) || case when event_id % 3 = 0 then 'x' else '' end")
    s = t("events").select("user_id", key.alias("key")).distinct()
    # every part of a key is looked up as a key: no pairs of keys
    n = F.length("key")
    parts = s.select("user_id", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: c("key").substr(i, k))))))
                     .alias("part"), "key").where((F.length("part") >= 2) & (F.length("part") < n)).select("user_id", c("part").alias("key")).distinct()
    return s.join(parts, ["user_id", "key"], "left_semi")


@query("durations_and_dates", """select event_id, case when s <= 0 then '' when s >= 3600 then (s // 3600) || ':' || lpad('' || (s % 3600 // 60), 2, '0') || ':' || lpad('' || (s % 60), 2, '0') else (s % 3600 // 60) || ':' || lpad('' || (s % 60), 2, '0') end as duration,
 coalesce(case when event_id % 3 = 0 then strftime(make_timestamp((1700000000 + event_id * 86400)::bigint * 1000000), '%Y-%m-%d') end, '2024-01-' || lpad('' || (event_id % 28 + 1), 2, '0')) as published, (date '2026-01-01' - ts::date)::int as age from (select *, event_id * 7 - 21 as s from events)""")
def _(t):
    seconds = 1700000000 + c("event_id") * 86400
    # seconds past from_epoch's limit would read as milliseconds, so such moments are given in milliseconds
    stamp = F.when(c("event_id") % 3 == 0, F.when((c("event_id") % 2 == 0) & (seconds <= 1e11), seconds).otherwise(seconds * 1000)).cast("double")
    text = F.concat(F.lit("2024/01/"), F.lpad((c("event_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00"))
    none = F.lit(None)
    return t("events").select("event_id", me.duration(c("event_id") * 7 - 21).alias("duration"), me.published([stamp, none.cast("double")], [none.cast("string"), text]).alias("published"), F.datediff(F.lit("2026-01-01").cast("date"), c("ts").cast("date")).alias("age"))


@query("utc_moments", """select event_id, case when event_id % 3 = 0 then null else strftime(ts - case when event_id % 3 = 1 then interval 2 hour else interval 0 hour end, '%Y-%m-%dT%H:%M:%SZ') end as moment from (select event_id, date_trunc('second', ts) as ts from events)""")
def _(t):
    text = F.concat(F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(c("event_id") % 3 == 0, "").when(c("event_id") % 3 == 1, "+02:00").otherwise("Z"))
    return t("events").select("event_id", me.utc_moment(text).alias("moment"))


@query("caption_tracks", """select event_id, case when event_id % 4 = 0 then 'en-GB' when event_id % 4 = 1 then 'fr' when event_id % 4 = 2 then 'de-orig' end as key, case when event_id % 4 < 2 then 'youtube_manual' when event_id % 4 = 2 then 'youtube_automatic' end as source from events""")
def _(t):
    k = c("event_id") % 4
    manual = F.when(k == 0, F.array(F.lit("live_chat"), F.lit("fr"), F.lit("en-GB"))).when(k == 1, F.array(F.lit("fr"))).otherwise(F.array(F.lit("live_chat"), F.lit("fr")))
    automatic = F.when(k == 2, F.array(F.lit("en"), F.lit("es-orig"), F.lit("de-orig"))).otherwise(F.array(F.lit("en"), F.lit("es-orig"), F.lit("it-orig")))
    language = F.when(k == 0, "EN").when(k == 2, "de").when(k == 3, "pt")
    return t("events").select("event_id", me.caption_track(manual, automatic, language).alias("r")).select("event_id", "r.key", "r.source")


@query("page_titles", r"""with h as (select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as host, case page_id % 4 when 0 then '<meta property="og:title" content="Shared ' || page_id || '">' when 1 then '<meta property="og:title" content="Not Found">' when 2 then '<script type="application/ld+json">{"@graph": [{"@type": ["WebPage", 1], "name": " Linked ' || page_id || '"}, {"@type": "Person", "name": "x"}]}</script>' else '' end || html as html from pages),
 x as (select page_id, regexp_replace(host, '^www\.', '') as host, regexp_extract(html, '(?is)<meta\s+property="og:title"\s+content="([^"]*)"', 1) as og, regexp_extract(html, '"name": " ([^"]*)"', 1) as ld, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g') as title, regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g') as h1 from h),
 n as (select page_id, host, list_transform([og, ld, title, h1], lambda v: trim(regexp_replace(replace(replace(replace(v, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) as all_ from x)
 select page_id, list_filter(all_, lambda v: v <> '' and length(v) <= 500 and lower(v) <> 'not found' and not starts_with(lower(v), '404 ') and rtrim(regexp_replace(lower(v), '^www\.', ''), './ ') <> host)[1] as title from n""")
def _(t):
    head = F.expr("""case page_id % 4 when 0 then '<meta property="og:title" content="Shared ' || page_id || '">' when 1 then '<meta property="og:title" content="Not Found">' when 2 then '<script type="application/ld+json">{"@graph": [{"@type": ["WebPage", 1], "name": " Linked ' || page_id || '"}, {"@type": "Person", "name": "x"}]}</script>' else '' end""")
    html = F.concat(head, c("html"))
    return t("pages").select("page_id", me.html_title(html, ur.bare_host(c("url")), nested.json_ld_title(html)).alias("title"))


@query("refresh_targets", """select page_id, case page_id % 3 when 0 then 'https://a.example/' || page_id when 1 then 'https://b.example/' || page_id end as target from pages""")
def _(t):
    html = F.expr("""case page_id % 3 when 0 then '<meta http-equiv="refresh" content="0; URL=https://a.example/' || page_id || '">' when 1 then '<script> window.location.href = "https://b.example/' || page_id || '"; </script>' else '<script>var a = 1; location = "x";</script>' end""")
    return t("pages").select("page_id", me.refresh_target(html).alias("target"))


@query("transcript_scores")
def _(t):
    """Precision, recall and F1 by common words of each answer against its question, and their mean by length class."""
    x = t("conversations")
    pair = x.where("role = 'user'").select("conv_id", "turn", F.lower("text").alias("a")).join(x.where("role = 'assistant'").select("conv_id", (c("turn") - 1).alias("turn"), F.lower("text").alias("b")), ["conv_id", "turn"])
    sized = pair.withColumns({"lcs": alike.common_words("a", "b"), "n": F.size(F.split("a", " ", -1)), "m": F.size(F.split("b", " ", -1))})
    scored = sized.withColumns({"precision": c("lcs") / c("m"), "recall": c("lcs") / c("n"), "f1": 2 * c("lcs") / (c("n") + c("m"))})
    return scored.groupBy(F.expr("n div 20").alias("class")).agg(F.count("*").alias("pairs"), *(F.round(F.avg(k), 6).alias(k) for k in ("precision", "recall", "f1")))


@query("evolving_texts")
def _(t):
    """Titles of pages that follow each other on a host: whether they are states of one text, and their similarity."""
    title = alike.text_key(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    before = F.lag("b").over(Window.partitionBy("host").orderBy("page_id"))
    p = t("pages").select("page_id", ur.bare_host(c("url")).alias("host"), title.alias("b")).select("page_id", before.alias("a"), "b").where("a is not null")
    return p.select("page_id", F.round(alike.similarity(c("a"), c("b")), 4).alias("ratio"), alike.evolving(c("a"), c("b")).alias("evolving"))


_HEAD = r"substr(regexp_replace(text, '[^A-Za-z]+', '', 'g'), 1, 40)"
_SHOWN = f"(select 'd' || doc_id as media, {_HEAD} as head, source from documents where length({_HEAD}) >= 20)"


@query("merged_frames", f"""select media, 1 as n, head as text, 0.9::double as confidence, 0.0::double as first, 20.0::double as last, 6 as seen from {_SHOWN}
 union all select media, 2, source, 0.8, 0.0, 0.4, 5 from {_SHOWN} where source is not null""")
def _(t):
    """Each document's head, revealed a fifth at a time, and after a cut once more; its source stands above."""
    head = F.substring(F.regexp_replace("text", "[^A-Za-z]+", ""), 1, 40)
    docs = t("documents").select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("media"), head.alias("head"), "source").where(F.length("head") >= 20)
    frames = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("frame"))
    time = F.when(c("frame") < 5, c("frame") / 10).otherwise(20.0)
    size = F.when(c("frame") < 4, F.floor(F.length("head") * (c("frame") + 1) / 5)).otherwise(F.length("head")).cast("int")
    box = lambda *x: F.array(*(F.lit(v) for v in x))
    lines = [
        F.struct(F.lit(0).alias("line"), c("head").substr(F.lit(1), size).alias("text"), F.lit(0.9).alias("confidence"), box(0.1, 0.2, 0.5, 0.1).alias("box")),
        F.when(c("frame") < 5, F.struct(F.lit(1).alias("line"), c("source").alias("text"), F.lit(0.8).alias("confidence"), box(0.1, 0.8, 0.3, 0.1).alias("box"))),
    ]
    rows = frames.select("media", "frame", time.alias("time"), F.explode(F.array_compact(F.array(*lines))).alias("l")).select("media", "frame", "time", "l.*")
    return fr.segments(rows).select("media", "n", "text", "confidence", "first", "last", "seen")


@query("alike_heads")
def _(t):
    """Documents' first 60 letters that are nearly alike, by language and source; tested against all pairs."""
    rows = t("documents").select("lang", "source", F.substring(F.regexp_replace("text", "[^A-Za-z]+", ""), 1, 60).alias("head")).where("lang is not null and source is not null")
    return fuzzy.alike_pairs(rows, ["lang", "source"], "head").withColumn("ratio", F.round("ratio", 6))


_WORDS = r"(select lang, list_distinct(regexp_extract_all(text, '\pL+')) as ws from documents where lang is not null)"


@query("words_to_read", f"""with s as (select distinct lang, replace(lower(w), 'ß', 'ss') as key from (select lang, unnest(ws) as w from {_WORDS})), k as (select * from s where length(key) <= 12)
 select lang, key from k a where not exists (select 1 from k b where a.lang = b.lang and length(b.key) > length(a.key) and contains(b.key, a.key))""")
def _(t):
    """Words of up to twelve letters that are part of no other one of their language."""
    words = t("documents").where("lang is not null").select(c("lang").alias("media"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\pL+"), F.lit(0)))).alias("text")).distinct()
    kept = fr.worth_reading(words.withColumn("n", F.xxhash64("text")), F.length(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))) <= 12)
    return kept.select(c("media").alias("lang"), alike.text_key(c("text")).alias("key"))


@query("redacted_records", """select event_id, '{"kind":"' || event_type || '","Cookies":"[redacted]","formats":[{"url":"[redacted]","props":' || replace(props, ' ', '') || '},[[{"http_headers":"[redacted]","n":' || event_id || '}]]]}' as record,
 case when event_id % 2 = 0 then event_type else event_type || ', x' end as kind from events where props is not null""")
def _(t):
    rows = t("events").where("props is not null").withColumn("raw", F.expr("""'])}while(1);</x>{"kind": "' || event_type || '", "Cookies": {"a": 1}, "formats": [{"url": "https://x", "props": ' || props || '}, [[{"http_headers": null, "n": ' || event_id || '}]]], "wrapped": {"value": ' || case when event_id % 2 = 0 then '"' || event_type || '"' else '["' || event_type || '", "x"]' end || '}}'"""))
    whole = F.regexp_replace("raw", r"^[^{]*", "")
    shown = F.regexp_replace(nested.redacted(whole), r',"wrapped":.*', "}")
    return rows.select("event_id", shown.alias("record"), nested.unwrapped(nested.parsed(c("raw")), "wrapped").alias("kind"))
