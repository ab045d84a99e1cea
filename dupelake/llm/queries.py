"""The named queries of the operators, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_dedup, conversations, decontaminate, divergence, hilbert, html_text, language, lines, ngram_join, packing, quality, token_store, toxicity
from .common import crc_fold, own_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_pack_documents(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query()
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.admitted_rows)
    return toxicity.score(docs, model).select(
        "doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


#: Links are counted on pairs of different sets; each set is one node, and labels pass along the links until nothing new is reached.
OP3_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
 d AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
  ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END)) AS g FROM w),
 c AS (SELECT g, min(doc_id) AS node, len(g) AS n FROM d WHERE len(g) > 0 GROUP BY g),
 s AS (SELECT node, n, unnest(g) AS x FROM c),
 l AS (SELECT a.node AS a, b.node AS b FROM s a JOIN s b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT node, node AS near FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.near = e.a),
 k AS (SELECT node, min(near) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(len(d.g) AS BIGINT) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id FROM d LEFT JOIN c ON d.g = c.g LEFT JOIN k ON k.node = c.node"""


@query(OP3_SQL)
def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join_components(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query(lines.ORACLE_SQL)
def op7_line_dedup(spark, sf_dir):
    return lines.dedup_report(table(spark, sf_dir, "documents"))


@query(decontaminate.oracle_sql())
def op8_benchmark_decontamination(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_bwt_dedup(spark, sf_dir):
    return byte_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op4_html_extraction(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query()
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.admitted_rows)
    return quality.score(docs, model).select(
        "doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query()
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, language.admitted_rows))
    return found.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op6_hilbert_neighbours(spark, sf_dir):
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query(divergence.ORACLE_SQL)
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query()
def op12_token_store(spark, sf_dir):
    return token_store.read_digests(spark, token_store.write_tokens(table(spark, sf_dir, "documents"), own_folder(spark, "tokens")))


@query(conversations.ORACLE_SQL)
def op11_conversation_repair(spark, sf_dir):
    return conversations.plan_repairs(conversations.damage(table(spark, sf_dir, "conversations")))
