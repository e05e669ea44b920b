"""Exact dedup: heavy-hitter split over content digests (native).

A Misra-Gries summary (``approx_top_k_accumulate``'s frequent-items sketch,
bounded by ``tracked`` counters) names digests that may be frequent; an exact
recount verifies them; the at most ``max_heavy`` winners are broadcast, and
their rows are resolved map-side. All other digests take an ordinary shuffle
with map-side pre-aggregation.

Null text counts as empty, so null and empty texts are copies of each other.
Rows that repeat a doc_id are separate rows: exactly one row of each group of
equal texts is kept, the one of the largest doc_id (any one of equal rows;
null ids come last). Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.llm.base import columns_of, row_of, staged, text_or_empty


def heavy_digests(digests: DataFrame, tracked: int, max_heavy: int) -> DataFrame:
    """Digests held by at least 1 / (2 * max_heavy) of the rows, with exact counts: (sha, n, best).

    With ``tracked`` >= 8 * max_heavy counters the summary can't miss one.
    """
    spark = digests.sparkSession
    summary = digests.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(sha, {max_heavy}, {tracked})").alias("top")
    ).first()
    named = [x["item"] for x in summary["top"] or [] if x["item"] is not None]  # max_heavy at most
    least = max(2, -(-summary["n"] // (2 * max_heavy)))
    maybe = spark.createDataFrame([(x,) for x in named], "sha string")
    return (
        digests.join(F.broadcast(maybe), "sha")
        .groupBy("sha")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("best"))
        .filter(F.col("n") >= least)
    )


def exact_dedup(docs: DataFrame, tracked: int = 4096, max_heavy: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = staged(
        docs.select(
            F.col("doc_id"), F.sha2(text_or_empty().cast("binary"), 256).alias("sha"), F.monotonically_increasing_id().alias("rid")
        )
    )
    winners = staged(heavy_digests(digests, tracked, max_heavy))  # max_heavy rows at most
    hot = digests.join(F.broadcast(winners), "sha")
    rest = digests.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    groups = rest.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("best"))
    return hot.unionByName(rest.join(groups, "sha")).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, one per distinct text (null counts as empty)."""
    kept = exact_dedup(docs, **options).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    marked = docs.select(docs["doc_id"].alias("id"), sha.alias("sha"), row_of(docs).alias("row"))
    out = marked.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return out.dropDuplicates(["id", "sha"]).select(*columns_of(docs))
