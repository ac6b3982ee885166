"""The queries opN_<name> of this subpackage, with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, divergence, langid, line_dedup, ngram_join, packing, pii, simhash, substring_dedup, token_rollup, url_filter, voronoi
from .common import materialise, shared_dir

#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.nearest(_table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined); all lines with words take part."""
    return line_dedup.removals(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingests all documents, deletes the toxic ones, revises those of low quality to count repeated lines once; each batch is sent twice."""
    counted = materialise(token_rollup.count_documents(_table(spark, sf_dir, "documents")), "counts")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = counted.join(labels, "doc_id")
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        rollup.commit("1-ingest", token_rollup.inserts(counted))
        rollup.commit("2-curate", token_rollup.deletes(marked.where("toxic = 1")), token_rollup.revisions(marked.where("quality = 0 and toxic = 0")))
    return rollup.totals()


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.identify(docs, trees).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_pii, op3_url_filter, op4_simhash, op5_voronoi_knn, op6_line_dedup, op7_decontaminate, op8_packing, op9_token_rollup, op10_language_id, op11_divergence, op12_collocations, op13_ngram_join)}


_RE = {k: v.replace("'", "''") for k, v in token_rollup.TOKENIZERS.items()}
_COUNT = "len(regexp_extract_all({x}, '{re}'))"

ORACLE = {
    "op11_divergence": divergence.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op1_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        win as (select doc_id, unnest(range(1, len(ws) - 18)) as s, ws from w where len(ws) >= 20),
        key as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') as k from win),
        late as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as r from key) where r > 1),
        gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from late),
        word as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from w),
        kept as (select word.doc_id, string_agg(word, ' ' order by word.p) as t, count(*) as n from word anti join gone on word.doc_id = gone.doc_id and word.p = gone.p group by 1)
        select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from w left join kept using (doc_id)""",
    "op3_url_filter": r"""
        with u as (select page_id, coalesce(case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end, '') as rest from pages),
        h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
        r(rh, rp, v) as (values """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in URL_RULES) + r"""),
        m as (select page_id, arg_max(struct_pack(rule := rh || rp, v := v), length(rh || rp)) as best from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1)
        select h.page_id, host, path, best.rule as rule, coalesce(best.v, 'allow') as verdict from h left join m using (page_id)""",
    "op5_voronoi_knn": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
              from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
        select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op9_token_rollup": f"""
        with c as (select doc_id, source, lang, unnest([
            {", ".join("{'tokenizer': '" + t + "', 'tokens': " + _COUNT.format(x="coalesce(text, '')", re=re) + ", 'revised': list_sum(list_transform(list_distinct(string_split(coalesce(text, ''), chr(10))), lambda x: " + _COUNT.format(x="x", re=re) + "))}" for t, re in _RE.items())}
            ], recursive := true) from documents),
        l as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by 1)
        select source, lang, tokenizer,
            sum(case when toxic = 1 then 0 else 1 end)::bigint as n_docs,
            sum(case when toxic = 1 then 0 when quality = 0 and toxic = 0 then revised else tokens end)::bigint as n_tokens
        from c left join l using (doc_id) group by 1, 2, 3""",
}
