"""Messages with entities, made from the conversations: a sign of two units, a linked first word, entities that can't be used."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as ms
from ..operators import messages as mo
from ..registry import query

c = F.col

_FIRST = "split_part(replace(text, chr(10), ' '), ' ', 1)"
_WORDS = f"(select conv_id, turn, role, replace(text, chr(10), ' ') as text, {_FIRST} as first from conversations where text is not null and length({_FIRST}) > 0)"
_URL = "'https://example.com/' || conv_id || '/(' || turn || ')'"


def _messages(t):
    x = t("conversations").where("text is not null").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))).withColumn("first", F.split_part("text", F.lit(" "), F.lit(1))).where("first <> ''")
    url = F.format_string("https://example.com/%d/(%d)", "conv_id", "turn")
    link = lambda at, n, u, kind="text_link": F.struct(F.lit(kind).alias("type"), at.alias("offset"), n.alias("length"), u.alias("url"))
    n, lit = F.length("first"), F.lit
    entities = F.array(
        link(lit(3), n, url), link(lit(3), n + 1, url), link(lit(1), lit(2), url), link(lit(0), lit(2), lit("ftp://example.com")), link(lit(3), F.length("text") + 9, url), link(lit(0), lit(2), lit(None).cast("string"), "bold"), link(lit(-1), lit(3), url)
    )
    caption = c("turn") % 3 == 2
    payload = F.struct(
        (c("turn") + 10).alias("message_id"), (100 - c("turn")).alias("date"),
        F.when(~caption, F.concat(lit("🚀 "), "text")).alias("text"), F.when(caption, F.concat(lit("🚀 "), "text")).alias("caption"), F.when(~caption, entities).alias("entities"), F.when(caption, entities).alias("caption_entities"),
        F.when(c("role") == "system", lit("x")).alias("forward_sender_name"),
        F.when(c("turn") == 0, F.struct(lit(52.5).alias("latitude"), lit(13.25).alias("longitude"))).alias("location"),
    )
    return mo.read_payloads(x.select("conv_id", "turn", F.to_json(payload).alias("payload")))


_BODY = r"""'🚀 [' || regexp_replace(first, '([\\\[\]*_`])', '\\\1', 'g') || '](https://example.com/' || conv_id || '/\(' || turn || '\))' || substr(text, length(first) + 1)
 || case when turn = 0 then chr(10) || chr(10) || '### Location' || chr(10) || 'Coordinates: 52.5,13.25' || chr(10) || '[Open in maps](https://www.google.com/maps/search/?api=1&query=52.5,13.25)' else '' end"""


@query("message_contents", f"select conv_id, turn, {_BODY} as content from {_WORDS}")
def _(t):
    return _messages(t).select("conv_id", "turn", ms.content(c("message")).alias("content"))


_ASKED = f"""select conv_id, turn, unnest([{{'u': {_URL}, 'l': first}}, {{'u': {_URL}, 'l': case when length(text) > length(first) then first || ' ' end}}, {{'u': {_URL}, 'l': null}}, {{'u': 'ftp://example.com', 'l': '🚀'}}, {{'u': {_URL}, 'l': null}}, {{'u': {_URL}, 'l': null}}]) as x, unnest(range(1, 7)) as n from {_WORDS}"""


@query("entity_links", f"select conv_id, turn, n::int as n, x['u'] as url, x['l'] as label from ({_ASKED})")
def _(t):
    """Every entity that names a link, whether its label can be used or not."""
    return _messages(t).select("conv_id", "turn", F.posexplode(ms.entity_links(c("message"))).alias("n", "x")).select("conv_id", "turn", (c("n") + 1).alias("n"), c("x.url").alias("url"), c("x.label").alias("label"))


@query("rendered_items", f"""select conv_id, count(*)::bigint as segments, sha256(string_agg('## Segment ' || n || ' — ' || case when role = 'system' then 'forwarded ' else '' end || case when turn % 3 = 2 then 'caption' else 'text' end || chr(10) || chr(10) || content, chr(10) || chr(10) order by n)) as body_sha256
 from (select *, {_BODY} as content, row_number() over (partition by conv_id order by 100 - turn, turn) as n from {_WORDS}) group by 1""")
def _(t):
    return mo.rendered_items(_messages(t), "conv_id").select("conv_id", "segments", F.sha2("body", 256).alias("body_sha256"))
