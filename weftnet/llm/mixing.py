"""Mixing sources to target weights by systematic sampling.

Source k of the sources in code-point order (null last) has weight
``weights[k % len(weights)]`` and a share of the total size in proportion to it.
A target stops at ``max_copies`` times its source's size; the excess is reshared
by weight until no target is above. That fixed point is found in one pass: with
sources ordered by the level at which they fill up, the level of those that
don't is (total - what the full ones hold) / (their weights).

Within a source a document's expected copies are target / source size. Their
prefix sum over the source's documents, largest first, plus one random offset
(a hash of the seed and the source) crosses an integer once for each copy taken.
Largest first makes the taken words differ from the target by about one large
document; that rest is then cut from, or added to, the first documents that
have room between nothing and ``max_copies`` times their size. So a source's
taken words equal its target, rounded down.

Null text counts as empty; a document without words takes nothing. Ties in size
are ordered by doc_id (null first), then by a hash of the text; equal rows are
separate documents of equal rank, whose order changes no total. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftnet.llm.base import columns_of, prefix_sums, row_of, staged, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, weights: Sequence[float], max_copies: float) -> DataFrame:
    """(source, source_size) with weight and target. One row per source, ordered in one task."""
    everything = Window.partitionBy(F.lit(0))
    position = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    chosen = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("weight", F.get(chosen, position % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size") * float(max_copies)).withColumn("fills", F.col("cap") / F.col("weight"))
    so_far = everything.orderBy("fills", "source").rowsBetween(Window.unboundedPreceding, -1)
    onward = everything.orderBy("fills", "source").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0))) / F.sum("weight").over(onward)
    # the first source that doesn't fill up before the level of those from it on
    rows = rows.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "source", "level"))).over(everything)
    rows = rows.withColumn("level", F.coalesce(found["level"], F.lit(float("inf"))))
    return rows.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def offset(seed: int) -> Column:
    """A number in [0, 1) for each source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: int = 3, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, source, size, source_size, target, copies, taken."""
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.xxhash64(text_or_empty()).alias("_th"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        )
    )
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    goals = staged(goals.withColumn("offset", offset(seed)))
    order = [F.desc("size"), F.col("doc_id").asc_nulls_first(), F.col("_th").asc()]
    each = prefix_sums(rows, ["source"], order, {"rank": F.lit(1)})
    each = each.join(goals.withColumnRenamed("source", "_source"), each["source"].eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = each.withColumn("_e", expected)
    copies = F.floor((F.col("rank") + 1) * F.col("_e") + F.col("offset")) - F.floor(F.col("rank") * F.col("_e") + F.col("offset"))
    each = each.withColumn("copies", F.when(F.col("size") > 0, F.least(copies, F.lit(max_copies))).otherwise(0).cast("long"))
    each = staged(each.withColumn("_got", F.col("copies") * F.col("size")).drop("_e", "offset"))

    lacking = each.groupBy("source", "target").agg(F.sum("_got").alias("_sum"))
    lacking = staged(lacking.select(F.col("source").alias("_source"), (F.floor("target") - F.col("_sum")).alias("_lack")))
    each = each.join(lacking, each["source"].eqNullSafe(lacking["_source"])).drop("_source")
    room = F.when(F.col("_lack") < 0, F.col("_got")).otherwise(F.col("size") * max_copies - F.col("_got"))
    each = prefix_sums(each, ["source"], order, {"_before": room})
    change = F.greatest(F.lit(0), F.least(room, F.abs("_lack") - F.col("_before")))
    taken = F.col("_got") + F.when(F.col("_lack") < 0, -change).otherwise(change)
    return each.select("doc_id", "_th", "source", "size", "source_size", "target", "copies", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` repeated as the mix takes them; a copy taken in part has its first words, joined by spaces.

    Equal rows are told apart by number, so that none is taken more often than its rank says.
    Further columns are kept, whatever their names.
    """
    number = F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy("taken"))
    plan = mix(docs, **options).withColumn("_no", number).filter("taken > 0").select(F.struct(F.col("doc_id").alias("id"), F.col("_th").alias("th"), F.col("_no").alias("no"), "size", "taken").alias("plan"))
    keyed = docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("th"), row_of(docs).alias("row"))
    keyed = keyed.withColumn("no", F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(0))))
    same = F.col("id").eqNullSafe(F.col("plan.id")) & (F.col("th") == F.col("plan.th")) & (F.col("no") == F.col("plan.no"))
    out = keyed.join(plan, same)
    size, taken = F.col("plan.size"), F.col("plan.taken")
    left = F.transform(F.sequence(F.lit(0), F.expr("(plan.taken - 1) div plan.size")), lambda k: F.least(size, taken - k * size))
    out = out.withColumn("take", F.explode(left))
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, F.lit(1), F.col("take").cast("int")), " ")
    text = F.when(F.col("take") < size, part).otherwise(F.col("row.text"))
    return out.select(*columns_of(docs, text=text))
