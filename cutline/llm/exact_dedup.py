"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import broadcast_if_small, broadcast_within, saved, table
from cutline.plans.pooled import lookup

SPACE = "[\\x20\\x09-\\x0D]+"


def _normalised(text: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after white space is deleted; NULL counts as empty. Of equal texts the one with the
    most code points stays, then the smallest id. Rows are grouped by the MD5 of the normalised text; only rows of
    groups of two or more then meet the row that stays, and their bytes are compared. Should two texts share a hash,
    the odd ones are grouped by their bytes instead.

    The hot group: sizes and the row that stays are combined before the shuffle; the byte comparison joins on the id
    of the row that stays, straight from a shuffle on both sides, so that adaptive execution can split it.

    Rows with the same id and equal text are one document and give one row. A NULL id is an id that comes last: it
    stays only if no equal text has an id. Columns other than the two named ones are ignored. No rows give no rows.
    """
    base = saved(
        docs.select(
            F.col(id).cast("long").alias("doc_id"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
            _normalised(text).alias("_n"),
        ).select("doc_id", "points", F.md5("_n").alias("digest"), F.sha2("_n", 256).alias("text_sha256")),
        "exact",
    )
    rows = base.groupBy("doc_id", "digest").agg(F.max("points").alias("points"), F.first("text_sha256").alias("text_sha256"))
    groups = (
        rows.groupBy("digest", "points")
        .agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(
            F.expr("max_by(low, CASE WHEN low IS NOT NULL THEN points END)").alias("keep_id"),
            F.sum("n").alias("group_size"),
        )
    )
    marked = saved(
        lookup(rows, groups, ["digest"]).select(
            "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", "digest"
        ),
        "exact",
    )
    # only texts that share their hash with another take part in the comparison
    several = marked.where("group_size > 1 AND doc_id IS NOT NULL").select("doc_id", "digest", "keep_id")
    texts = (
        docs.select(F.col(id).cast("long").alias("doc_id"), _normalised(text).alias("_n"))
        .withColumn("digest", F.md5("_n"))
        .join(broadcast_if_small(several), ["doc_id", "digest"])
    )
    stays = texts.where("doc_id = keep_id").select("keep_id", "digest", F.col("_n").alias("_k"))
    odd = saved(
        texts.where("doc_id <> keep_id").join(stays, ["keep_id", "digest"]).where("_n <> _k")
        .select("doc_id", "digest", "_n").distinct(),
        "exact",
    )
    result = marked.drop("digest")
    if odd.isEmpty():
        return result
    return _split_collisions(marked, odd, docs, id, text)


def _split_collisions(marked: DataFrame, odd: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame:
    """Regroup texts whose hash equals another text's: those that differ from the row that stays, by their bytes."""
    points = docs.select(
        F.col(id).cast("long").alias("doc_id"), _normalised(text).alias("_n"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
    )
    rows = odd.join(points.groupBy("doc_id", "_n").agg(F.max("points").alias("points")), ["doc_id", "_n"])
    groups = rows.groupBy("_n").agg(
        F.expr("max_by(doc_id, struct(points, -doc_id))").alias("_keep"), F.count(F.lit(1)).alias("_size")
    )
    moved = lookup(rows, groups, ["_n"]).select("doc_id", "digest", "_keep", "_size", F.sha2("_n", 256).alias("_sha"))
    lost = moved.groupBy("digest").agg(F.count(F.lit(1)).alias("_lost"))
    return (
        lookup(marked, lost, ["digest"])
        .join(moved, ["doc_id", "digest"], "left")
        .select(
            "doc_id",
            F.coalesce("_keep", "keep_id").alias("keep_id"),
            F.expr("coalesce(_size, group_size - coalesce(_lost, 0))").alias("group_size"),
            F.expr("doc_id <=> coalesce(_keep, keep_id)").alias("kept"),
            F.coalesce("_sha", "text_sha256").alias("text_sha256"),
        )
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that stay, with the columns of ``docs``. Repeated rows of one id and text become one row.

    Rows that share an id but differ in text are judged one by one; rows without an id stay, once each text, if no
    equal text has an id.
    """
    dropped = exact_dedup(docs).where("NOT kept").selectExpr("doc_id AS _dropped_id_", "text_sha256 AS _dropped_sha_").distinct()
    known = docs.withColumn("_sha_", F.sha2(_normalised("text"), 256))
    same = F.expr("CAST(doc_id AS BIGINT) <=> _dropped_id_ AND _sha_ = _dropped_sha_")
    rest = known.join(broadcast_within(saved(dropped, "dropped")), same, "left_anti")
    repeated = rest.groupBy("doc_id", "_sha_").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    many = saved(repeated.selectExpr("CAST(doc_id AS BIGINT) AS _dropped_id_", "_sha_ AS _dropped_sha_"), "repeated")
    if many.isEmpty():
        return rest.select(*docs.columns)
    many = broadcast_within(many)
    twice = rest.join(many, same, "left_semi").dropDuplicates(["doc_id", "_sha_"])
    return rest.join(many, same, "left_anti").select(*docs.columns).union(twice.select(*docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


# Spark's char_length counts code points, as DuckDB's length does
SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
