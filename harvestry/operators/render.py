"""An item's index as text: its fields in a fixed order, what was captured, sources, lead, links and problems. Each list is gathered per item, whose rows are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

c = F.col
#: Streams of a short item in the order in which a lead quotes them. Fixed values.
STREAMS = ("forwarded", "on-screen text", "spoken audio", "transcript", "caption", "description", "accessibility description")
NO_NOTE = "[forwarded — no note of your own]"  # fixed value


def stream_rank(heading: Column, order: tuple[str, ...] = STREAMS) -> Column:
    """A stream's place; a source may follow its name in brackets."""
    name = F.lower(F.trim(heading))
    out = F.lit(len(order))
    for i in reversed(range(len(order))):
        out = F.when((name == order[i]) | name.startswith(f"{order[i]} ("), i).otherwise(out)
    return out


def link_status(status: Column, reason: Column, duplicate_of: Column) -> Column:
    return F.when((status == "duplicate") & duplicate_of.isNotNull(), F.concat(F.lit("duplicate of "), duplicate_of.cast("string"))).when(
        (F.coalesce(reason, F.lit("")) != "") & (status != "resolved"), F.concat(status, F.lit(" ("), reason, F.lit(")"))
    ).otherwise(status)


def escape_destination(url: Column) -> Column:
    return F.regexp_replace(url, r"([\\()])", r"\\$1")


def markdown_link(label: Column, url: Column) -> Column:
    flat = F.trim(F.regexp_replace(label, r"\s+", " "))
    return F.concat(F.lit("["), tx.escape_label(flat), F.lit("]("), escape_destination(url), F.lit(")"))


def listed(rows: DataFrame, item: str, order: str, line: Column, out: str) -> DataFrame:
    """(item, out, out_count): the lines of each item's rows in order."""
    ordered = F.array_sort(F.collect_list(F.struct(c(order).alias("o"), line.alias("l"))))
    return rows.groupBy(item).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias(out), F.count("*").alias(f"{out}_count"))


def link_lines(links: DataFrame, item: str) -> DataFrame:
    """One line for each link that isn't excluded: links(item, n, canonical, title, label, handler, status, reason, duplicate_of)."""
    line = F.concat(c("n").cast("string"), F.lit(". "), markdown_link(F.coalesce("title", "label", "canonical"), c("canonical")), F.lit(" — "), c("handler"), F.lit(" · "), link_status(c("status"), c("reason"), c("duplicate_of")))
    return listed(links.where("status <> 'excluded'"), item, "n", line, "links")


def source_lines(sources: DataFrame, item: str) -> DataFrame:
    """One line for each source: sources(item, place, path, title, authors, published, venue, status, reason, words, via); at most three authors."""
    who = F.nullif(F.array_join(F.slice("authors", 1, 3), ", "), F.lit(""))
    what = F.concat_ws(" · ", F.nullif(c("title"), F.lit("")), who, F.nullif(c("published"), F.lit("")), F.nullif(c("venue"), F.lit("")))
    state = F.when(c("reason").isNotNull() & (c("status") != "complete"), F.concat(c("status"), F.lit(" (`"), c("reason"), F.lit("`)"))).otherwise(c("status"))
    via = F.when(c("via").isNotNull(), F.concat(F.lit(" · via "), c("via"))).otherwise("")
    line = F.concat(c("place").cast("string"), F.lit(". "), markdown_link(c("path"), c("path")), F.when(what != "", F.concat(F.lit(" — "), what)).otherwise(""), F.lit(" — "), state, F.lit(" · "), F.format_number("words", 0), F.lit(" words"), via)
    return listed(sources, item, "place", line, "sources")


def problem_lines(problems: DataFrame, item: str) -> DataFrame:
    """One line for each problem(item, place, step, outcome, reason, target, message)."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    more = lambda x: F.when(F.coalesce(flat(x), F.lit("")) != "", F.concat(F.lit(" — "), flat(x))).otherwise("")
    line = F.concat(F.lit("- `"), c("step"), F.lit("` "), c("outcome"), F.lit(" — `"), c("reason"), F.lit("`"), more(c("target")), more(c("message")))
    return listed(problems, item, "place", line, "problems")


def index(items: DataFrame, links: DataFrame, sources: DataFrame, problems: DataFrame, item: str) -> DataFrame:
    """(item, index) of items(item, captured_at, origin, via, intent, kind, title, headline, canonical_url, extraction, reason, link_count, note, lead, lead_kind)."""
    rows = items.join(link_lines(links, item), item, "left").join(source_lines(sources, item), item, "left").join(problem_lines(problems, item), item, "left")
    field = lambda name, x, show=None: F.when(x.isNotNull() if show is None else show, F.concat(F.lit(f"{name}: "), x.cast("string")))
    fields = F.concat_ws(
        "\n", field("id", c(item)), field("captured_at", c("captured_at")), field("origin", c("origin")), field("via", tx.yaml_scalar(c("via"))), F.concat(F.lit("intent: "), F.coalesce(tx.yaml_scalar(c("intent")), F.lit("null"))),
        field("kind", c("kind")), F.coalesce(field("title", tx.yaml_scalar(c("title"))), field("headline", tx.yaml_scalar(c("headline")))), field("canonical_url", c("canonical_url")), field("extraction", c("extraction")), field("reason", c("reason")),
        field("sources", c("sources_count")), field("lead", c("lead_kind")), field("link_count", c("link_count"), c("link_count") > 5), field("problems", c("problems_count")),
    )
    section = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"\n## {head}\n\n"), x))
    captured = F.when(F.coalesce(c("note"), F.lit("")) == "", f"> {NO_NOTE}").otherwise(tx.blockquote(c("note")))
    whole = F.concat_ws("\n", F.lit("---"), fields, F.lit("---"), section("Captured", captured), section("Sources", c("sources")), section("Lead", F.when(c("lead") != "", tx.blockquote(c("lead")))), section("Links", c("links")), section("Problems", c("problems")))
    return rows.select(item, F.concat(whole, F.lit("\n")).alias("index"))
