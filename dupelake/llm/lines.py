"""Line deduplication with overlapping three-line windows, in DataFrame functions only.

A document is cut at line feeds. Every run of ``window`` consecutive lines is a window, keyed by two 64-bit hashes. Of all
occurrences of a window the first, by (doc_id, text hash, position), stays; the lines of every later occurrence are covered,
and a document keeps its lines that no later occurrence covers, in their order, joined by line feeds.

Defined cases: documents with fewer lines than a window, null or empty texts, and rows with a null doc_id stay as they are and
remove nothing; repeated rows (same doc_id and text) are one document and get the same result; documents of which no line is left
are dropped by ``dedup_lines`` unless ``keep_empty``; a column ``n_chars`` is set to the new length; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WINDOW = 3


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64(F.lit(1), "text").alias("row_key"), F.split("text", "\n").alias("ls"))


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row_key, pos (of the first line, from 0), h1, h2."""
    n = F.size("ls") - window + 1
    zipped = _keyed(docs).where(n > 0).select(
        "doc_id", "row_key", F.arrays_zip(*[F.slice("ls", F.lit(j + 1), n).alias(f"l{j}") for j in range(window)]).alias("win"))
    rows = zipped.select("doc_id", "row_key", F.posexplode("win").alias("pos", "w"))
    cols = [F.col("w")[f"l{j}"] for j in range(window)]
    return rows.select("doc_id", "row_key", "pos", F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(2), *cols).alias("h2"))


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row_key, covered (sorted positions of the lines to remove), only for documents that lose lines."""
    occ = windows(docs, window)
    me = F.struct("doc_id", "row_key", "pos")
    firsts = (occ.groupBy("h1", "h2").agg(F.min(me).alias("first"), F.max(me).alias("last"))
              .where(F.col("first") != F.col("last")).select("h1", "h2", "first"))
    later = occ.join(firsts, ["h1", "h2"]).where(me != F.col("first"))
    lines = later.select("doc_id", "row_key", F.explode(F.sequence(F.col("pos"), F.col("pos") + window - 1)).alias("line"))
    return lines.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("line")).alias("covered"))


def _with_cover(docs: DataFrame, window: int) -> DataFrame:
    cover = covered_lines(docs, window).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("covered").alias("__covered"))
    return docs.join(cover, (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.lit(1), "text") == F.col("__key")), "left")


def _lines_left():
    ls = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__covered"))
    return F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n")


def dedup_lines(docs: DataFrame, window: int = WINDOW, keep_empty: bool = False) -> DataFrame:
    """``docs`` with the repeated windows taken out of ``text``."""
    joined = _with_cover(docs, window)
    hit = F.col("__covered").isNotNull()
    if not keep_empty:
        joined = joined.where(~hit | (F.size("__covered") < F.size(F.split("text", "\n"))))
    out = joined.withColumn("text", F.when(hit, _lines_left()).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def dedup_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (0 for a null text), n_removed, kept_text (null for a null text)."""
    hit = F.col("__covered").isNotNull()
    return _with_cover(docs.select("doc_id", "text"), window).select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(hit, F.size("__covered")).otherwise(0).cast("long").alias("n_removed"),
        F.when(hit, _lines_left()).otherwise(F.col("text")).alias("kept_text"))


ORACLE_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, text, p, ls[p + 1:p + {WINDOW}] AS k FROM (SELECT *, unnest(range(0, len(ls) - {WINDOW - 1})) AS p FROM d WHERE len(ls) >= {WINDOW})),
r AS (SELECT doc_id, text, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, text, p) AS rn FROM w),
c AS (SELECT doc_id, text, list(DISTINCT p + j) AS cov FROM (SELECT *, unnest(range(0, {WINDOW})) AS j FROM r WHERE rn > 1) GROUP BY ALL)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(cov), 0) AS BIGINT) AS n_removed,
 CASE WHEN cov IS NULL THEN text ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(cov, i - 1)], chr(10)) END AS kept_text
FROM d LEFT JOIN c USING (doc_id, text)
"""
