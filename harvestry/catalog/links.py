"""Link queries: canonical forms, redirectors, identities, exclusion, priorities and whole link tables, over urls made from the pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as ur
from ..operators import links as lk
from ..operators import redirects
from ..registry import query

c = F.col

#: A raw link for each page, in both dialects: every kind of address that the rules tell apart.
RAW = """case page_id % 30
 when 1 then 'HTTPS://WWW.Example.COM:443/a' || page_id || '?b=2&utm_source=x&igsh=1&SI=2&a=b%20c+e&d'
 when 2 then 'http://x.org:80/p.html?rcm=1&ref=' || page_id || '#frag'
 when 3 then 'https://t.me/chan' || page_id
 when 4 then 'https://t.me/s/chan/' || page_id
 when 5 then 'https://telegram.me/joinchat/abc'
 when 6 then 'reddit' || page_id || '.com'
 when 7 then 'https://github.com/owner/repo' || (page_id % 90)
 when 8 then 'https://www.instagram.com/reel/Ab_' || page_id || '/?igsh=MTk='
 when 9 then 'https://www.linkedin.com/posts/user_topic-activity-70' || page_id || '-abcd?rcm=x'
 when 10 then 'https://www.linkedin.com/feed/update/urn:li:ugcPost:90' || page_id || '/'
 when 11 then 'https://youtu.be/' || lpad('' || page_id, 11, 'a') || '?si=x'
 when 12 then 'https://www.youtube.com/watch?v=' || lpad('' || page_id, 11, 'Z') || case when page_id % 60 = 12 then '&list=PL1' else '&t=3' end
 when 13 then 'https://arxiv.org/abs/2401.' || lpad('' || page_id, 5, '0') || 'v2'
 when 14 then 'https://medium.com/@user/some-title-' || lpad('' || page_id, 12, 'a') || '?sk=1&source=rss'
 when 15 then 'https://www.google.com/url?q=https%3A%2F%2Fexample.org%2Fx%3Fa%3D1&sa=' || page_id
 when 16 then 'https://bit.ly/' || page_id
 when 17 then 'https://pbs.twimg.com/media/' || page_id || '.jpg'
 when 18 then 'https://x.com/user' || page_id
 when 19 then 'https://blog.example.net/tags/a' || page_id || '/b'
 when 20 then 'https://openreview.net/pdf?id=Q' || page_id
 when 21 then 'https://aclanthology.org/2023.acl-long.' || page_id || '.pdf'
 when 22 then 'https://href.li/?https://example.net/y' || page_id
 when 23 then 'http://user:pw@example.com/?utm_source=x'
 when 24 then 'mailto:a' || page_id || '@b.example'
 when 25 then 'https://www.youtube.com/shorts/' || lpad('' || page_id, 11, 'q')
 when 26 then 'https://proceedings.mlr.press/v97/p' || page_id || '/p' || page_id || '.pdf'
 when 27 then 'https://www.amazon.com/dp/' || page_id
 when 28 then 'https://nam01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fexample.org%2Fz%2F&data=' || page_id
 else url end"""


def _parts(of: str, url: str = "url") -> str:
    """SQL: the rows of `of` with the parts of a url."""
    return rf"""(select *, lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as s, regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as a,
 lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) as h, regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1) as port,
 regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as p, regexp_extract({url}, '^[^?#]*\?([^#]*)', 1) as q, regexp_extract({url}, '#(.*)$', 1) as f from {of})"""


_PAIRS = "list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(case when contains(x, '=') then substr(x, position('=' in x) + 1) else '' end, '+', ' '))})"
_FORM = "array_to_string(list_transform({x}, lambda y: replace(url_encode(y['k']), '%20', '+') || '=' || replace(url_encode(y['v']), '%20', '+')), '&')"
_BARE = r"regexp_replace(h, '^www\.', '')"
_SEGMENTS = "list_filter(string_split(p, '/'), lambda x: x <> '')"


def _canonical(of: str, url: str = "url") -> str:
    kept = f"list_filter({_PAIRS}, lambda z: not (lower(z['k']) in {ur.TRACKING} or starts_with(lower(z['k']), 'utm_') or starts_with(lower(z['k']), 'cp_landing')))"
    form = _FORM.format(x=kept)
    return f"""(select * exclude (s, a, h, port, p, q, f), case when s in ('http', 'https') and h <> '' and not contains(a, '@') then
 s || '://' || h || case when port <> '' and port::int <> case s when 'http' then 80 else 443 end then ':' || port::int else '' end || p || case when {form} <> '' then '?' || {form} else '' end
 || case when f <> '' then '#' || f else '' end else {url} end as canonical from {_parts(of, url)})"""


_RAW = f"(select page_id, {RAW} as raw from pages)"
_URL = f"(select *, case when regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') then raw else 'https://' || raw end as url from {_RAW})"
_DEST = f"""(select * exclude (s, a, h, port, p, q, f), case when h = 'href.li' then q when ends_with(h, '.safelinks.protection.outlook.com') then list_filter({_PAIRS}, lambda z: z['k'] = 'url')[1]['v']
 when h = 'www.google.com' and p = '/url' then list_filter({_PAIRS}, lambda z: z['k'] = 'q')[1]['v'] end as destination from {_parts(_URL)})"""
_TABLE = _canonical(f"(select * replace (coalesce(destination, url) as url) from {_DEST})")
_PARTED = _parts(_TABLE, "canonical")
_CHANNEL = f"""({_BARE} in {ur.CHAT_HOSTS} and (len({_SEGMENTS}) = 0 or starts_with({_SEGMENTS}[1], '+') or lower({_SEGMENTS}[1]) = 'joinchat' or case when lower({_SEGMENTS}[1]) = 's' then len({_SEGMENTS}) <= 2 else len({_SEGMENTS}) = 1 end))"""
_EXCLUDED = f"case when {_CHANNEL} then 'telegram-channel' when not regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') and trim(p, '/') = '' and q = '' then 'bare-hostname' end"
_INSTAGRAM = "case when h in ('instagram.com', 'www.instagram.com', 'm.instagram.com') then nullif(regexp_extract(p, '(?:^|/)(?:p|reel|reels|tv)/+([A-Za-z0-9_-]+)(?:/|$)', 1), '') end"
_POST = "case when h in ('linkedin.com', 'www.linkedin.com') then nullif(case when starts_with(p, '/posts/') then regexp_extract(p, '(?i)-(?:activity|share|ugcpost)-([0-9]+)(?:-|$)', 1) else regexp_extract(p, '(?i)^/feed/update/urn:li:(?:activity|share|ugcpost):([0-9]+)/?$', 1) end, '') end"
_VIDEO = f"""case when len(list_filter({_PAIRS}, lambda z: z['k'] = 'list')) = 0 then nullif(regexp_extract(case when h = 'youtu.be' then p when h in ('youtube.com', 'www.youtube.com', 'm.youtube.com') and p = '/watch' then '/' || list_filter({_PAIRS}, lambda z: z['k'] = 'v')[1]['v']
 when h in ('youtube.com', 'www.youtube.com', 'm.youtube.com') and starts_with(p, '/shorts/') then substr(p, 8) else '' end, '^/([A-Za-z0-9_-]{{11}})/?$', 1), '') end"""
_PAPER = f"""case when {_BARE} = 'arxiv.org' then 'arxiv:' || nullif(regexp_extract(p, '^/(?:abs|pdf|html)/([0-9]{{4}}\\.[0-9]{{4,5}}(?:v[0-9]+)?)(?:\\.pdf)?/?$', 1), '')
 when {_BARE} = 'aclanthology.org' then 'acl:' || nullif(regexp_extract(p, '^/([A-Za-z0-9.-]+?)(?:\\.pdf)?/?$', 1), '')
 when {_BARE} = 'openreview.net' and p in ('/forum', '/pdf', '/challenge') then 'openreview:' || list_filter({_PAIRS}, lambda z: z['k'] = 'id')[1]['v']
 when {_BARE} = 'proceedings.mlr.press' then 'pmlr:' || nullif(regexp_extract(p, '^/(v[0-9]+)/', 1), '') || '-' || regexp_extract(p, '^/v[0-9]+/([^/.]+)', 1) end"""
_STORY = f"case when s = 'https' and port = '' and not (h in ('medium.com', 'www.medium.com') and (len({_SEGMENTS}) < 2 or {_SEGMENTS}[1] = 'p')) then nullif(lower(regexp_extract(rtrim(p, '/'), '(?i)(?:^|-|/)([0-9a-f]{{12}})$', 1)), '') end"
_HANDLER = f"case when {_INSTAGRAM} is not null then 'instagram' when {_POST} is not null then 'linkedin' when {_VIDEO} is not null then 'youtube' when {_PAPER} is not null then 'research' when {_STORY} is not null then 'medium' else 'document' end"
_LOW = f"({_BARE} in {ur.IMAGE_HOSTS + ur.STORE_HOSTS} or regexp_matches(lower(p), '/hashtag/|/explore/tags/|/tags/') or ({_BARE} in {ur.SOCIAL_HOSTS} and len({_SEGMENTS}) <= 1))"
_REPO = f"({_BARE} in {ur.REPOSITORY_HOSTS} and len({_SEGMENTS}) >= 2)"


def _raw(t):
    return t("pages").select("page_id", F.expr(RAW).alias("raw"))


def _canonicals(t):
    url = ur.with_scheme(c("raw"))
    return _raw(t).withColumn("_url", ur.unwrapped(url)).withColumn("canonical", ur.canonical(c("_url")))


@query("link_canonical_forms", f"select page_id, canonical from {_TABLE}")
def _(t):
    return _canonicals(t).select("page_id", "canonical")


@query("link_embedded_destination", f"select page_id, destination, destination is not null or {_BARE} in {ur.SHORTENERS} as redirector from {_parts(_DEST)}")
def _(t):
    u = ur.with_scheme(c("raw"))
    return _raw(t).select("page_id", ur.embedded(u).alias("destination"), ur.shortened(u).alias("redirector"))


@query("link_clean_url", f"""select page_id, case when q = '' then url else s || '://' || a || p || case when {_FORM.format(x='w')} <> '' then '?' || {_FORM.format(x='w')} else '' end || case when f <> '' then '#' || f else '' end end as clean
 from (select *, list_filter({_PAIRS}, lambda z: not lower(z['k']) in {ur.UNWANTED}) as w from {_parts(_URL)})""")
def _(t):
    return _raw(t).select("page_id", ur.clean(ur.with_scheme(c("raw"))).alias("clean"))


_DOCUMENT = f"(select page_id, s || '://' || lower(a) || case when p = '' then '/' else p end || case when q <> '' then '?' || {_FORM.format(x='list_sort(' + _PAIRS + ')')} else '' end as d, h, p from {_parts(_URL)} where s in ('http', 'https'))"


@query("link_document_id", rf"""select page_id, d as document_url, substr(regexp_replace(regexp_replace(lower(h || '-' || case when regexp_extract(rtrim(p, '/'), '([^/]*)$', 1) = '' then 'index' else regexp_replace(regexp_extract(rtrim(p, '/'), '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1') end), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70) || '-' || substr(sha256(d), 1, 10) as document_id from {_DOCUMENT}""")
def _(t):
    u = ur.with_scheme(c("raw"))
    return _raw(t).where(ur.scheme(u).isin("http", "https")).select("page_id", ur.document_url(u).alias("document_url"), ur.document_id(u).alias("document_id"))


@query("link_handler_identity", f"""select page_id, {_HANDLER} as handler, coalesce({_INSTAGRAM}, {_POST}, {_VIDEO}, {_PAPER}, {_STORY}) as identity, h <> 'youtu.be' and starts_with(p, '/shorts/') and {_VIDEO} is not null as short,
 case when {_STORY} is not null then case when h in ('medium.com', 'www.medium.com') then 'https://medium.com/feed/' || {_SEGMENTS}[1] else 'https://' || h || '/feed' end end as feed from {_PARTED}""")
def _(t):
    u = c("canonical")
    named = F.coalesce(ur.shortcode(u), ur.post_urn(u)["post_id"], ur.video_id(u), ur.paper_id(u), ur.article_id(u))
    return _canonicals(t).select("page_id", ur.handler(u).alias("handler"), named.alias("identity"), ur.is_short_url(u).alias("short"), ur.feed_url(u).alias("feed"))


@query("link_exclusion", f"select page_id, {_EXCLUDED} as reason, {_CHANNEL} as channel, {_REPO} as repository, {_LOW} as deprioritized from {_PARTED}")
def _(t):
    u = c("canonical")
    return _canonicals(t).select("page_id", ur.exclusion(c("raw"), u).alias("reason"), ur.chat_channel(u).alias("channel"), ur.repository(u).alias("repository"), ur.deprioritized(u).alias("deprioritized"))


#: Items of eight links; every third link comes from an entity, those first, and every fourth has a label.
_ITEM = "page_id % 250 // 8"
_LINKS = f"""(select *, page_id % 250 // 8 as item, case when page_id % 3 = 0 then 0 else 1 end as stage, case when page_id % 4 = 1 then 'label ' || page_id end as label from {_PARTED} where s in ('http', 'https'))"""
_KEPT = f"""(select item, canonical, arg_min(page_id, (stage, page_id)) as page_id, min(stage) as stage, arg_min(label, (stage, page_id)) filter (label is not null) as label, arg_min({_EXCLUDED}, (stage, page_id)) filter ({_EXCLUDED} is not null) as _any,
 list(coalesce({_EXCLUDED}, '') order by stage, page_id)[1] as reason, first({_HANDLER}) as handler, first({_LOW}) as low, first({_REPO}) as repo from {_LINKS} group by item, canonical)"""


@query("link_table", f"""select item, n::int as n, canonical, label, status, reason, case when status = 'excluded' then 9 when handler = 'research' then 1 when low then 9 when kept = 1 then 2 when repo then 3 when handler in ('medium', 'document') then 4 else 5 end as priority
 from (select *, row_number() over (partition by item order by stage, page_id) as n, sum((status <> 'excluded')::int) over (partition by item) as kept from (select * exclude (reason), nullif(reason, '') as reason, case when reason <> '' then 'excluded' else 'discovered' end as status from {_KEPT}))""")
def _(t):
    found = _raw(t).select(
        F.expr("page_id % 250 div 8").alias("item"), F.when(c("page_id") % 3 == 0, 0).otherwise(1).alias("stage"), c("page_id").alias("position"), "raw",
        F.when(c("page_id") % 4 == 1, F.concat(F.lit("label "), c("page_id").cast("string"))).alias("label"),
    )
    return lk.link_table(found, "item").select("item", "n", "canonical", "label", "status", "reason", "priority")


#: Rows of finished link tables: status, origin and priority by number.
_STATUS = "case page_id % 7 when 0 then 'duplicate' when 1 then 'excluded' when 2 then 'failed' else 'resolved' end"
_ORIGIN = "case page_id % 5 when 0 then 'harvest' when 1 then 'body' else 'entity' end"
_RANK = "case page_id % 6 when 0 then 9 when 1 then 1 else 4 end"
_ROWS = f"(select page_id // 9 as item, page_id as n, {_STATUS} as status, {_ORIGIN} as origin, {_RANK} as priority from pages)"


def _rows(t):
    return t("pages").select(F.expr("page_id div 9").alias("item"), c("page_id").alias("n"), F.expr(_STATUS).alias("status"), F.expr(_ORIGIN).alias("origin"), F.expr(_RANK).alias("priority"))


@query("link_row_filters", f"select n, status not in ('duplicate', 'excluded') as listed, status not in ('duplicate', 'excluded') and origin <> 'harvest' as captured, status not in ('duplicate', 'excluded') and priority <> 9 as extractable from {_ROWS}")
def _(t):
    return _rows(t).select("n", lk.distinct().alias("listed"), lk.captured().alias("captured"), lk.extractable().alias("extractable"))


@query("link_primary", f"select item, arg_min(n, (priority, n)) as n from {_ROWS} where status not in ('duplicate', 'excluded') group by item")
def _(t):
    return lk.primary(_rows(t), "item").select("item", "n")


@query("link_candidates", f"""select item, n, rank::int as rank from (select *, row_number() over (partition by item order by priority, n) as rank, count(*) over (partition by item) as k from {_ROWS} where status not in ('duplicate', 'excluded') and priority <> 9) where rank <= case when k >= 4 then 2 else 3 end""")
def _(t):
    return lk.candidates(_rows(t), "item", threshold=4, many=2, few=3).select("item", "n", "rank")


@query("link_item_kind", f"""select item, case when n = 0 then 'note' when n >= 4 then 'linklist' else 'link' end as kind from (select item, count(*) filter (status not in ('duplicate', 'excluded') and origin <> 'harvest') as n from {_ROWS} group by item)""")
def _(t):
    n = F.count_if(lk.captured())
    return _rows(t).groupBy("item").agg(F.when(n == 0, "note").when(n >= 4, "linklist").otherwise("link").alias("kind"))


@query("extraction_rollup", f"""with e as (select * from {_ROWS} where n % 2 = 0), r as (select item, count(*) as k, bool_or(status = 'resolved') as got, arg_min(status, (priority, n)) as first, arg_min(status, (priority, n)) filter (status <> 'resolved') as bad from e group by item),
 l as (select item, arg_min(status, n) filter (status = 'failed') as unfinished from {_ROWS} group by item)
 select item, case when k is null then case when unfinished is not null then 'partial' else 'none' end when not got then 'failed' when bad is not null then 'partial' else 'ok' end as extraction,
 case when k is null then unfinished when not got then first when bad is not null then bad end as reason from l left join r using (item)""")
def _(t):
    rows = _rows(t)
    return lk.extraction_rollup(rows.where("n % 2 = 0").withColumns({"retrieved": c("status") == "resolved", "complete": c("status") == "resolved", "reason": c("status")}),
                                rows.withColumns({"unfinished": c("status") == "failed", "reason": c("status")}), "item")


@query("extraction_order", f"""select e.n, e.n // 9 as item, row_number() over (partition by e.n // 9 order by coalesce(l.priority, 99), e.n)::int as place from (select n from {_ROWS} where n % 2 = 0) e left join (select n, priority from {_ROWS} where n % 3 = 0) l using (n)""")
def _(t):
    rows = _rows(t)
    e = rows.where("n % 2 = 0").select("n").join(rows.where("n % 3 = 0").select("n", "priority"), "n", "left")
    item = F.expr("n div 9")
    return e.select("n", item.alias("item"), F.row_number().over(Window.partitionBy(item).orderBy(F.coalesce("priority", F.lit(99)), "n")).alias("place"))


_HARVEST = f"(select page_id // 9 as item, page_id as n, canonical from {_TABLE} where page_id % 2 = 0)"


@query("link_harvest", f"""with k as (select page_id // 9 as item, canonical from {_TABLE} where page_id % 2 = 1),
 f as (select page_id // 9 as item, page_id as position, canonical, raw, {_EXCLUDED} as ex, {_LOW} as low from {_PARTED} where page_id % 2 = 0 and s in ('http', 'https')),
 d as (select item, canonical, min(position) as position from f where ex is null and not low and (item, canonical) not in (select item, canonical from k) group by item, canonical)
 select item, canonical, position, rank::int as rank from (select *, row_number() over (partition by item order by position) as rank from d) where rank <= 3""")
def _(t):
    rows = _canonicals(t).withColumns({"item": F.expr("page_id div 9"), "position": c("page_id")})
    return lk.harvest(rows.where("page_id % 2 = 0"), rows.where("page_id % 2 = 1"), "item", 3).select("item", "canonical", "position", "rank")


_MESSAGE = """case page_id % 11 when 0 then 'redirect loop detected' when 1 then 'shortener chain did not expose a final destination' when 2 then 'exceeded 10 page-level redirects' when 3 then 'no trustworthy title found'
 when 4 then 'unsupported content type image/png' when 5 then 'response exceeded 2 MiB' when 6 then 'unsafe URL: x' when 7 then 'HTTP 404' when 8 then '' when 9 then 'could not parse PDF metadata: x' else 'timed out' end"""


@query("resolution_reasons", f"""select page_id, case when m = 'redirect loop detected' then 'redirect-loop' when m like 'shortener chain did not expose%' then 'destination-not-found' when m like 'exceeded %' then 'redirect-limit' when m = 'no trustworthy title found' then 'title-not-found'
 when m like 'unsupported content type%' or m like 'could not parse PDF metadata%' then 'unsupported-content' when m like 'response exceeded%' then 'response-too-large' when m like 'unsafe URL:%' then 'unsafe-url' when m like 'HTTP %' then 'http-error' when m <> '' then 'request-error' else 'unknown-resolution-error' end as reason from (select page_id, {_MESSAGE} as m from pages)""")
def _(t):
    return t("pages").select("page_id", ur.failure_reason(F.expr(_MESSAGE)).alias("reason"))


@query("outcomes_by_route", f"""select handler, status, count(*)::bigint as n, count(distinct canonical)::bigint as targets, round(100.0 * count(*) / sum(count(*)) over (partition by handler), 2) as share from (select {_HANDLER} as handler, {_STATUS} as status, canonical from {_PARTED}) group by 1, 2""")
def _(t):
    rows = _canonicals(t).select(ur.handler(c("canonical")).alias("handler"), F.expr(_STATUS).alias("status"), "canonical")
    n = rows.groupBy("handler", "status").agg(F.count("*").alias("n"), F.countDistinct("canonical").alias("targets"))
    return n.withColumn("share", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy("handler")), 2))


#: What each page answers: a hop to the next page of its host (the last leads to the first), a refresh, an error, no destination, or itself.
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
_ANSWERS = f"""select page_id, url, case page_id % 8 when 5 then 404 when 6 then case when page_id % 16 = 6 then 302 else 200 end when 0 then 200 when 7 then 200 when 3 then 200 else 301 end as status, case when page_id % 8 in (1, 2, 4) then next_url end as location,
 case when page_id % 8 = 3 then next_url end as target, case page_id % 8 when 7 then 'application/octet-stream' else 'text/html' end as content_type, case when page_id % 8 = 0 then 'Page ' || page_id end as title
 from (select page_id, url, coalesce(lead(url) over (partition by host order by page_id), first_value(url) over (partition by host order by page_id)) as next_url from (select page_id, url, {_HOST} as host from pages))"""


@query("redirect_chains", f"""with recursive a as (select url, min({{'status': status, 'location': location, 'target': target, 'content_type': content_type, 'title': title}}) as p from ({_ANSWERS}) group by 1),
 r(start, current, stops, reason, title) as (select distinct url, url, []::varchar[], null::varchar, null::varchar from a
  union all select start, case when reason is null then nxt else current end, stops, reason, title from (
   select start, current, list_append(r.stops, current) as stops, coalesce(p['location'], p['target'], current) as nxt,
    case when len(list_filter(r.stops, lambda s: s = current)) >= 2 then 'redirect-loop' when p['status'] in (301, 302) and p['location'] is null then 'destination-not-found' when p['status'] in (301, 302) then null
     when p['status'] >= 400 then 'http-error' when p['content_type'] = 'application/octet-stream' then 'unsupported-content' when p['target'] is not null and p['target'] <> current then null when p['title'] is not null then 'ok' else 'title-not-found' end as reason,
    p['title'] as title from r join a on a.url = current where r.reason is null and len(r.stops) < 10))
 select start as url, current as final_url, case when reason = 'ok' then title end as title, case when reason is null then 'redirect-limit' when reason <> 'ok' then reason end as reason, (len(stops) - 1)::int as hops
 from r where reason is not null or len(stops) = 10""")
def _(t):
    session = t("pages").sparkSession
    answers = session.sql(_ANSWERS.replace("from pages", "from {pages}"), pages=t("pages")).select("url", F.lit(None).cast("string").alias("final_url"), "status", "location", "target", "content_type", F.lit(None).cast("long").alias("bytes"), "title")
    return redirects.resolve(t("pages"), answers).drop("message")
