"""How far each source's vocabulary diverges from other sources and from its whole language, in exact integers.

A kept term of a language has probability p = 1 + floor(10^9 (n + 1) / (N + V)) in a group (lang, source) and adds
floor((p - q)^2 / q). Most terms occur in few groups, so a sum over all V terms is put together by inclusion-exclusion
over the two supports: a histogram of each group's counts prices the terms of one group as if the other had none of
them, a join of postings replaces those prices for the terms that both have, and one constant covers all terms that
neither has. No table of groups times terms is made.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialise

MIN_DOCUMENTS = 3
TOP_TERMS = 200
HELD = 1 << 19  # (group, term) entries that a task counts before it hands them on
SOURCES = 1024  # sources of a term that one task joins with all others

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` after A-Z are lower-cased: those letters fold, separators become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with the term '' for every group that occurs."""

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows():
            for (lang, source), (n, d) in held.items():
                terms = [*n, b""]
                same = lambda x: pa.DictionaryArray.from_arrays(pa.array([0] * len(terms), pa.int32()), [x]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(terms, pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(d.__getitem__, n), 0], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms = (text.as_py() or "").encode().translate(FOLD).split()
                size -= len(n)
                n.update(terms)
                d.update(set(terms))
                size += len(n)
                if size > HELD:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    found = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: str, total: str, terms: str = "v"):
    """A term's probability, in parts of 10^9; decimals, as the product may pass 64 bits.

    A language without kept terms has no such price, but Spark may compute it before a join or filter drops the row: 1 there.
    """
    return F.expr(f"1 + (cast(1000000000 as decimal(38, 0)) * ({n} + 1)) div greatest({total} + {terms}, 1)")


def _f(p: str, q: str):
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _sum(what: str, name: str):
    return F.sum(F.expr(f"cast({what} as decimal(38, 0))")).alias(name)


def _overlaps(kept: DataFrame, salts: int) -> DataFrame:
    """(lang, source, item, n, m, terms): for both orders of two groups, terms that both have, by their counts there."""
    x = kept.select("lang", "term", "source", "n", F.pmod(F.xxhash64("source"), F.lit(salts)).alias("salt"))
    y = kept.select("lang", "term", F.col("source").alias("item"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    met = x.join(y, ["lang", "term", "salt"]).where("source < item").groupBy("lang", "source", "item", "n", "m").agg(F.count("*").alias("terms"))
    both = F.array(F.struct("source", "item", "n", "m"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("m").alias("n"), F.col("n").alias("m")))
    return met.select("lang", "terms", F.explode(both).alias("p")).select("lang", "terms", "p.*")


def _pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"), F.col("support").alias("item_support"))
    pairs = groups.join(other, "lang").where("source <> item")
    pairs = pairs.select("lang", "source", "item", "v", "total", "support", "item_total", "item_support", _p("0", "total").alias("p0"), _p("0", "item_total").alias("q0"))
    keys = ["lang", "source", "item"]
    mine = pairs.join(histogram, ["lang", "source"]).select(*keys, "terms", _p("n", "total").alias("p"), "q0").groupBy(keys).agg(_sum(f"terms * ({_f('p', 'q0')})", "part"))
    theirs = pairs.join(histogram.select("lang", F.col("source").alias("item"), "n", "terms"), ["lang", "item"]).select(*keys, "terms", "p0", _p("n", "item_total").alias("q")).groupBy(keys).agg(_sum(f"terms * ({_f('p0', 'q')})", "part"))
    met = _overlaps(kept, -(-most // SOURCES)).join(pairs, keys).select(*keys, "terms", "p0", "q0", _p("n", "total").alias("p"), _p("m", "item_total").alias("q"))
    both = met.groupBy(keys).agg(_sum(f"terms * ({_f('p', 'q')} - {_f('p', 'q0')} - {_f('p0', 'q')} + {_f('p0', 'q0')})", "part"))
    none = pairs.where("v > 0").select(*keys, F.expr(f"cast(v - support - item_support as decimal(38, 0)) * ({_f('p0', 'q0')})").cast("decimal(38,0)").alias("part"))
    nothing = pairs.where("v = 0").select(*keys, F.lit(0).cast("decimal(38,0)").alias("part"))
    parts = mine
    for x in (theirs, both, none, nothing):
        parts = parts.unionByName(x.withColumn("part", F.col("part").cast("decimal(38,0)")))
    return parts.groupBy(keys).agg(F.sum("part").cast("long").alias("value"))


def audit(docs: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    """Per group (lang, source) of docs(text, lang, source): (lang, source, part, item, value, rank).

    Part `pair` ranks the other sources of the language, part `term` the group's over-represented terms, at most
    top_terms of them. Nulls are read as ''. Every row is a document, repeated ones too; ties go to the smaller item in
    UTF-8 order. A language without kept terms has pairs of value 0 and no terms; an empty table gives no rows. Other
    columns are ignored.
    """
    counted = materialise(_counted(docs), "counted")
    terms = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCUMENTS)
    kept = materialise(counted.where("term <> ''").join(terms.select("lang", "term", "all"), ["lang", "term"]).select("lang", "source", "term", "n", "all"), "kept")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    # a language's number of terms: each has one posting in its smallest source
    langs = kept.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("whole"))
    groups = counted.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.fillna(0, ["total", "support", "v", "whole"]), "groups")
    group = ["lang", "source"]
    pairs = _pairs(groups, kept).select(*group, F.lit("pair").alias("part"), "item", "value")
    priced = kept.join(groups.select(*group, "total", "whole", "v"), group).select(*group, F.col("term").alias("item"), _p("n", "total").alias("p"), _p("all", "whole").alias("q"))
    over = priced.where("p > q").select(*group, F.lit("term").alias("part"), "item", F.expr(_f("p", "q")).alias("value"))
    order = Window.partitionBy(*group, "part").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)]
    out = materialise(ranked[0].unionByName(ranked[1]).withColumn("rank", F.col("rank").cast("int")), "divergence")
    for table in (counted, kept, groups):
        drop_table(table)
    return out


ORACLE = r"""
    with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
    k as (select lang, term from (select lang, unnest(list_distinct(ws)) as term from d) group by all having count(*) >= 3),
    c as (select lang, source, term, count(*) as n from (select lang, source, unnest(ws) as term from d) group by all),
    g as (select distinct lang, source from d),
    v as (select lang, count(*) as v from k group by 1),
    full_counts as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, v.v from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    p as (select *, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + v) as p from full_counts),
    l as (select lang, term, any_value(v) as v, sum(n) as n from full_counts group by all),
    q as (select lang, term, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang) + v) as q from l),
    pair as (select x.lang, x.source, 'pair' as part, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
             union all select x.lang, x.source, 'pair', y.source, 0 from g x join g y on x.lang = y.lang and x.source <> y.source where x.lang not in (select lang from v)),
    term as (select p.lang, p.source, 'term' as part, p.term as item, (p - q) * (p - q) // q as value from p join q using (lang, term) where n > 0 and p > q),
    r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (from pair union all from term))
    select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 200"""
