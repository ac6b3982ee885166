"""Where links lead: chains of redirects over a table of fetched pages.

What is known of a url is worked out once, for all urls that a chain can reach; every round then is a narrow join with
that table. A url is resolved once, however many links have it. A chain is over after ten rounds at most, so the plan is of fixed size, and a url keeps the list of its
stops to see when it comes round a third time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as ur

ROUNDS = 10
STATUSES = (301, 302, 303, 307, 308)
# How much an outcome without a title is worth when a page is asked twice.
QUALITY = {"title-not-found": 4, "response-too-large": 3, "unsupported-content": 3, "destination-not-found": 2, "http-error": 1, "request-error": 1, "redirect-loop": 1, "redirect-limit": 1, "unsafe-url": 0}
#: What is known of a url: its own address after the request, status, the Location header, where the page itself sends its reader, its type, size and title.
PAGES = "url string, final_url string, status int, location string, target string, content_type string, bytes long, title string"

_OUTCOME = "struct<url:string,title:string,reason:string,message:string>"


def _outcome(url: Column, reason: str | None, message: Column | str | None = None, title: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) or message is None else message
    return F.struct(url.alias("url"), (F.lit(None) if title is None else title).alias("title"), F.lit(reason).alias("reason"), text.alias("message")).cast(_OUTCOME)


def _known(urls: DataFrame, pages: DataFrame, guard: bool, html_bytes: int, pdf_bytes: int) -> DataFrame:
    """(known, inside, hop, end) of urls(known): the destination a url carries, where its page leads, else how a chain ends there."""
    now = F.col("known")
    met = urls.join(pages, now == F.col("url"), "left")
    at = F.coalesce("final_url", now)
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    pdf = F.contains(kind, F.lit("application/pdf")) | F.lower(ur.path(at)).endswith(".pdf")
    html = F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml+xml")) | (kind == "")
    limit = F.when(pdf, pdf_bytes).otherwise(html_bytes)
    moved = F.col("status").isin(*STATUSES)
    met = met.withColumns({"at": at, "unsafe": F.coalesce(ur.unsafe(now), ur.unsafe(at)) if guard else F.lit(None).cast("string"), "to": ur.joined(at, F.when(moved, F.col("location")).otherwise(F.col("target")))})
    titled = F.when(F.coalesce("title", F.lit("")) == F.col("at"), None).otherwise(F.col("title"))
    at = F.col("at")
    end = (
        F.when(F.col("unsafe").isNotNull(), _outcome(now, "unsafe-url", F.concat(F.lit("unsafe URL: "), F.col("unsafe"))))
        .when(F.col("status").isNull(), _outcome(now, "request-error", "not fetched"))
        .when(moved & F.col("location").isNull(), _outcome(at, "destination-not-found", "redirect response did not provide a destination"))
        .when(moved, F.lit(None).cast(_OUTCOME))
        .when(F.col("status") >= 400, _outcome(at, "http-error", F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
        .when(F.col("bytes") > limit, _outcome(at, "response-too-large", F.concat(F.lit("response exceeded "), limit.cast("string"), F.lit(" bytes"))))
        .when(~pdf & ~html, _outcome(at, "unsupported-content", F.concat(F.lit("unsupported content type: "), kind)))
        .when(~pdf & (F.col("to") != now), F.lit(None).cast(_OUTCOME))
        .when(~pdf & ur.shortened(now), _outcome(at, "destination-not-found", "shortener chain did not expose a final destination (the last link may be expired)"))
        .when(titled.isNotNull(), _outcome(at, None, None, titled))
        .otherwise(_outcome(at, "title-not-found", "no trustworthy title found"))
    )
    return met.select("known", ur.embedded(now).alias("inside"), "to", end.alias("end")).select("known", "inside", F.when(F.col("end").isNull(), F.col("to")).alias("hop"), "end")


def _carried(url: str, rounds: int) -> Column:
    """A url and the destinations that it and these carry inside them."""
    once = lambda a, _: F.when(F.element_at(a, -1).isNotNull(), F.array_append(a, ur.embedded(F.element_at(a, -1)))).otherwise(a)
    return F.array_compact(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(F.col(url)), once))


def _step(state: DataFrame, known: DataFrame) -> DataFrame:
    """One round of state(start, current, stops, done); done says how a chain ended, and those that have pass through."""
    now, still = F.col("current"), F.col("done").isNull()
    # a chain that is over asks for a page that cannot be, each for another one, so that they spread
    asked = F.when(still, now).otherwise(F.concat(F.lit("\0"), F.col("start")))
    met = state.join(known, asked == F.col("known"), "left")
    before = F.size(F.filter("stops", lambda s: s == now))
    fresh = F.col("inside").isNotNull() & (F.col("inside") != now) & ~F.array_contains("stops", F.col("inside"))
    done = F.when(~still, F.col("done")).when(before >= 2, _outcome(now, "redirect-loop", "redirect loop detected")).when(~fresh | F.col("inside").isNull(), F.col("end"))
    to = F.when(fresh, F.col("inside")).otherwise(F.col("hop"))
    rows = met.select("start", now.alias("before"), to.alias("to"), F.when(still, F.array_append("stops", now)).otherwise(F.col("stops")).alias("stops"), done.alias("done"))
    return rows.select("start", F.when(F.col("done").isNull(), F.col("to")).otherwise(F.col("before")).alias("current"), "stops", "done")


def resolve(links: DataFrame, pages: DataFrame, url: str = "url", rounds: int = ROUNDS, guard: bool = True, html_bytes: int = 2 << 20, pdf_bytes: int = 20 << 20) -> DataFrame:
    """(url, final_url, title, reason, message, hops) of the distinct urls of links over pages (see PAGES).

    A chain follows a destination inside the url, a Location header, then the page's own target; it ends at a page with
    a title or with a reason. A url that pages doesn't have is a request-error, one that comes round a third time a
    redirect-loop, one that is still on its way after the last round is at its redirect-limit. Of several rows of a url
    the smallest counts, a null being larger than any value; null urls take no part.
    """
    rest = [c for c in pages.columns if c != "url"]
    order = F.struct(*(x for c in rest for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))
    once = pages.groupBy("url").agg(F.min(order).alias("p")).select("url", *(F.col(f"p.{c}").alias(c) for c in rest))
    starts = links.where(F.col(url).isNotNull()).select(F.col(url).alias("start")).distinct().withColumn("current", F.regexp_replace("start", "&amp;", "&"))
    at = F.coalesce("final_url", "url")
    stops = once.select(F.explode(F.array("url", ur.joined(at, F.col("location")), ur.joined(at, F.col("target")))).alias("u")).unionByName(starts.select(F.col("current").alias("u"))).where("u is not null").distinct()
    known = _known(stops.select(F.explode(_carried("u", rounds)).alias("known")).distinct(), once, guard, html_bytes, pdf_bytes)
    state = starts.select("start", "current", F.array().cast("array<string>").alias("stops"), F.lit(None).cast(_OUTCOME).alias("done"))
    for _ in range(rounds):
        state = _step(state, known)
    state = state.withColumn("done", F.coalesce("done", _outcome(F.col("current"), "redirect-limit", f"exceeded {rounds} page-level redirects")))
    return state.select(F.col("start").alias("url"), F.col("done.url").alias("final_url"), "done.title", "done.reason", "done.message", (F.size("stops") - 1).alias("hops"))


def better(first: DataFrame, second: DataFrame) -> DataFrame:
    """The better of two resolutions of each url of first: one with a title, else the one whose reason is worth more.

    A second attempt that got further, off a redirector, wins too; unsafe and unsupported links are not asked twice.
    """
    worth = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv))[F.col(c)], F.lit(0))
    columns = [c for c in first.columns if c != "url"]
    pair = first.join(second.select("url", *(F.col(c).alias(f"second_{c}") for c in columns)), "url", "left")
    settled = F.col("title").isNotNull() | F.coalesce(F.col("reason").isin("unsafe-url", "unsupported-content"), F.lit(False)) | F.col("second_final_url").isNull()
    further = (F.col("final_url") == F.col("url")) & (F.col("second_final_url") != F.col("url")) & ~ur.shortened(F.col("second_final_url"))
    take = ~settled & (F.col("second_title").isNotNull() | (worth("second_reason") > worth("reason")) | further)
    return pair.select("url", *(F.when(take, F.col(f"second_{c}")).otherwise(F.col(c)).alias(c) for c in columns))
