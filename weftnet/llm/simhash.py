"""Document fingerprints: SimHash (native).

A text's terms are its pairs of neighbouring words (lower case, split at spaces,
tabs and line breaks); a text of one word has that word as its term. Each
occurrence of a term votes on every bit of the fingerprint, for it where the
term's hash has a one and against it where it has a zero, so a term weighs as
often as it occurs. A bit is set when the votes for it are in the majority; a
text without words has all bits zero. Equal texts have equal fingerprints.

The votes for bits k and k + 32 of a 64-bit hash travel in one long, 32 bits
each, so a term costs 64 additions in generated code for all 128 bits.

Likeness is 1 - Hamming distance / 128. ``hamming_matches`` finds every pair
within a radius r by block tables: with at most r differing bits one of
r div (e + 1) + 1 blocks differs in at most e, so a query looks up each of its
blocks and all that differ from it in up to e bits; e is r div 8.

Dense groups. Counting each query's matches pair by pair makes rows with the square
of a group of near copies. So ``near_counts`` finds centres of dense groups first
(majorities of the bits of fingerprints that share a 32-bit word) and gives each
fingerprint within REACH of a centre to the nearest one. A query that lies b from a
centre has all members at a distance of at most r - b from it counted at once, none
nearer to it than b - r; those between are compared in a fold over the arrays of
PART members that a group is held in, where no pair becomes a row. Fingerprints near no
centre go through the block tables. Which centres are taken decides speed alone.

RADIUS is from sf0.1's documents, those divisible by 20 against all: of 74 pairs
of different texts with a Jaccard likeness of their five-word shingles of 0.75 or
more, none is within 3 bits, 0.919 are within 16, 0.973 within 20.

Null text counts as empty. Equal rows are one document (see base.py).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftnet.llm.base import NULL_ID, partitions, staged, text_or_empty, with_row_key

BITS = 128
LANES = 0x0000000100000001
RADIUS = 20
DENSE, CENTRES, REACH, PART = 32, 64, 32, 4096
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _terms(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(n < 2, hashes).otherwise(pairs)


def fingerprints(df: DataFrame, keys: list[str], text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, f0, f1, carry): the 128 bits of each key's text, with long columns of the same value in all its rows.

    No shuffle if ``df`` is dealt by some of ``keys``. Repeated rows change nothing.
    """
    each = df.select(*keys, *carry, _terms(F.col(text)).alias("h")).select(*keys, *carry, F.explode_outer(_pairs(F.col("h"))).alias("t"))
    each = each.withColumns({"h0": F.xxhash64("t", F.lit(0)), "h1": F.xxhash64("t", F.lit(1))})
    # a text without terms has one null term, without votes
    lanes = [
        F.sum(F.when(F.col("t").isNotNull(), F.shiftrightunsigned(f"h{j}", k).bitwiseAND(F.lit(LANES)))).alias(f"v{j}_{k}")
        for j in (0, 1)
        for k in range(32)
    ]
    votes = each.groupBy(*keys).agg(F.count("t").alias("n"), *[F.max(c).alias(c) for c in carry], *lanes)

    def word(j: int) -> Column:
        def bit(k: int) -> Column:
            lane = F.coalesce(F.col(f"v{j}_{k % 32}"), F.lit(0).cast("long"))
            count = lane.bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(lane, 32)
            return F.shiftleft((count * 2 > F.col("n")).cast("long"), k)

        return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(64)])

    return votes.select(*keys, word(0).alias("f0"), word(1).alias("f1"), *carry)


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(*words: Column) -> Column:
    return F.lit(1.0) - distance(*words) / F.lit(float(BITS))


def hex_string(f0: Column, f1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def hamming_matches(queries: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """Pairs (q0, q1, f0, f1, distance) of a fingerprint of each side within ``radius`` (at most 31).

    Both sides hold distinct fingerprints as f0, f1; copies are counted outside.
    A pair is made by the first block table in which it agrees.
    """
    if not 0 <= radius <= 31:
        raise ValueError("radius must be 0 to 31")
    flips = radius // 8
    blocks = radius // (flips + 1) + 1  # 8 at most: not all can differ in more than ``flips`` bits
    cuts = [BITS * k // blocks for k in range(blocks + 1)]

    def block(f0: str, f1: str, k: int) -> Column:
        if blocks == 1:
            return F.xxhash64(f0, f1)
        (w, at), width = divmod(cuts[k], 64), cuts[k + 1] - cuts[k]
        bits = F.shiftrightunsigned(F.col((f0, f1)[w]), at)
        if at + width > 64:
            bits = bits.bitwiseOR(F.shiftleft(F.col(f1), 64 - at))
        return bits.bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    def around(width: int) -> Column:
        """All masks of up to ``flips`` of ``width`` bits, an array that is folded to a constant."""
        masks = [sum(1 << x for x in ones) for n in range(flips + 1) for ones in combinations(range(width), n)]
        return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")

    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        rows = df.select(F.col("f0").alias(a), F.col("f1").alias(b))
        return rows.select(a, b, F.posexplode(F.array(*[block(a, b, k) for k in range(blocks)])).alias("table", "block"))

    def probes(df: DataFrame) -> DataFrame:
        rows = tables(df, "q0", "q1")
        if not flips:
            return rows
        masks = reduce(lambda out, k: F.when(F.col("table") == k, around(cuts[k + 1] - cuts[k])).otherwise(out), range(1, blocks), around(cuts[1]))
        return rows.select("q0", "q1", "table", "block", F.explode(masks).alias("mask")).select(
            "q0", "q1", "table", F.col("block").bitwiseXOR(F.col("mask")).alias("block")
        )

    gap = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    first = reduce(
        lambda out, k: F.when(F.bit_count(block("q0", "q1", k).bitwiseXOR(block("f0", "f1", k))) <= flips, F.lit(k)).otherwise(out),
        reversed(range(blocks)),
        F.lit(-1),
    )
    q, x = probes(queries), tables(index, "f0", "f1").withColumnsRenamed({"table": "t2", "block": "b2"})
    on = (F.col("table") == F.col("t2")) & (F.col("block") == F.col("b2")) & (gap <= radius) & (first == F.col("table"))
    # the planner does not see that probes are many rows a query, and would broadcast them
    return q.hint("merge").join(x, on).select("q0", "q1", "f0", "f1", gap.alias("distance"))


def _centres(index: DataFrame) -> list[tuple[int, int]]:
    """Up to CENTRES centres of dense groups of the distinct fingerprints (f0, f1)."""
    word = F.posexplode(F.array(*[F.shiftrightunsigned(f, k).bitwiseAND(F.lit(0xFFFFFFFF)) for f in ("f0", "f1") for k in (0, 32)]))
    words = index.select("f0", "f1", word.alias("at", "word"))
    dense = words.groupBy("at", "word").agg(F.count("*").alias("k")).filter(F.col("k") >= DENSE).orderBy(F.desc("k"), "at", "word").limit(CENTRES)
    ones = [F.sum(F.shiftrightunsigned(f, k).bitwiseAND(F.lit(1))).alias(f"{f}_{k}") for f in ("f0", "f1") for k in range(64)]
    votes = words.join(F.broadcast(dense.select("at", "word")), ["at", "word"]).groupBy("at", "word").agg(F.count("*").alias("k"), *ones)
    whole = lambda r, f: sum(1 << k for k in range(64) if 2 * r[f"{f}_{k}"] > r["k"])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted({(signed(whole(r, "f0")), signed(whole(r, "f1"))) for r in votes.collect()})


def near_counts(queries: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """(f0, f1, copies, least) for each query fingerprint: sum and least over those of the index within ``radius``.

    Both hold distinct fingerprints f0, f1; the index (staged) has ``copies`` and ``least`` (null if none).
    """
    spark = index.sparkSession
    found = _centres(index.select("f0", "f1"))
    parts = []
    if found:
        centres = F.broadcast(spark.createDataFrame([(k, *c) for k, c in enumerate(found)], "centre int, c0 long, c1 long"))
        off = distance(F.col("c0"), F.col("c1"), F.col("f0"), F.col("f1"))
        owned = index.join(centres, off <= REACH).groupBy("f0", "f1").agg(F.min(F.struct(off.alias("off"), "centre")).alias("at"), F.first("copies").alias("copies"), F.first("least").alias("least"))
        owned = staged(owned.select("f0", "f1", "copies", "least", "at.centre", "at.off"))
        tally = owned.groupBy("centre", "off").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("least").alias("least"))
        groups = tally.groupBy("centre").agg(  # a row a centre
            F.ceil(F.sum("n") / PART).cast("int").alias("parts"), F.max("off").alias("rim"), F.collect_list(F.struct("off", "copies", "least")).alias("tally")
        )
        groups = F.broadcast(staged(groups))
        member = F.struct("off", "f0", "f1", "copies", "least")
        members = owned.join(groups.select("centre", "parts"), "centre").withColumn("part", F.pmod(F.xxhash64("f0", "f1"), F.col("parts")).cast("int"))
        members = members.groupBy("centre", "part").agg(F.collect_list(member).alias("members"))
        asked = queries.join(centres, off <= REACH + radius).withColumn("b", off).join(groups, "centre").filter(F.col("b") <= F.col("rim") + radius)
        asked = staged(asked.select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), "centre", "b", "parts", "rim", "tally"))
        sure = F.col("b") + F.col("x.off") <= radius
        parts.append(asked.select("q0", "q1", "b", F.explode("tally").alias("x")).filter(sure).select("q0", "q1", "x.copies", "x.least"))
        some = asked.filter(F.col("b") + F.col("rim") > radius).select("q0", "q1", "centre", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def fold(so_far: Column, x: Column) -> Column:
            between = (x["off"] + F.col("b") > radius) & (F.abs(x["off"] - F.col("b")) <= radius)
            hit = between & (distance(F.col("q0"), F.col("q1"), x["f0"], x["f1"]) <= radius)
            both = F.struct((so_far["copies"] + x["copies"]).alias("copies"), F.least(so_far["least"], x["least"]).alias("least"))
            return F.when(hit, both).otherwise(so_far)

        none = F.struct(F.lit(0).cast("long").alias("copies"), F.lit(None).cast("long").alias("least"))
        counted = some.join(members, ["centre", "part"]).select("q0", "q1", F.aggregate("members", none, fold).alias("x"))
        parts.append(counted.select("q0", "q1", "x.copies", "x.least").filter("copies > 0"))
        index = index.join(owned.select("f0", "f1"), ["f0", "f1"], "left_anti")
    parts.append(hamming_matches(queries, index.select("f0", "f1"), radius).join(index, ["f0", "f1"]).select("q0", "q1", "copies", "least"))
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("copies").alias("copies"), F.min("least").alias("least"))


def following(thin: DataFrame) -> DataFrame:
    """Rows (_did, _th, _n) with the key of the next row: (n0, n1); the first follows the last.

    The rows are dealt by range and staged; only the first row of each partition
    (as many rows as partitions) crosses to the one before.
    """
    order = [F.col("_did"), F.col("_th")]
    ranged = staged(thin.repartitionByRange(partitions(thin.sparkSession), *order).withColumn("_pid", F.spark_partition_id()))
    key = F.struct("_did", "_th")
    firsts = ranged.groupBy("_pid").agg(F.min(key).alias("head"))
    wrap = F.first("head").over(Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("_pid", F.coalesce(F.lead("head").over(Window.partitionBy(F.lit(0)).orderBy("_pid")), wrap).alias("head"))
    nxt = F.lead(key).over(Window.partitionBy("_pid").orderBy(*order))
    out = ranged.withColumn("nxt", nxt).join(firsts, "_pid")
    out = out.withColumn("nxt", F.coalesce("nxt", "head"))
    return out.select("_did", "_th", "_n", F.col("nxt._did").alias("n0"), F.col("nxt._th").alias("n1"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, query_step: int = 20) -> DataFrame:
    """Fingerprints of each text and of its edited text; see the contract of op4.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document by doc_id; the first follows the
    last. near_count: for documents whose id is divisible by ``query_step``,
    how many other documents have a fingerprint within ``radius``; near_id: the
    smallest doc_id of these and itself, which stands for them; else null.
    """
    keyed = with_row_key(docs)
    thin = keyed.select("_did", "_th", F.char_length("_text").cast("long").alias("_n")).dropDuplicates(["_did", "_th"])
    order = staged(following(thin))
    texts = keyed.select("_did", "_th", "_text").repartition(F.col("_did"), F.col("_th"))
    wanted = order.select(F.col("n0").alias("_did"), F.col("n1").alias("_th"), F.col("_did").alias("p0"), F.col("_th").alias("p1"), F.col("_n").alias("pn"))
    heads = (
        texts.join(wanted, ["_did", "_th"])
        .select(F.col("p0").alias("_did"), F.col("p1").alias("_th"), F.expr("substring(_text, 1, cast(pn div 2 as int))").alias("_head"))
        .groupBy("_did", "_th")
        .agg(F.first("_head").alias("_head"))
    )
    edited = F.concat(F.expr("substring(_text, 1, cast(char_length(_text) - char_length(_text) div 2 as int))"), F.col("_head"))
    both = texts.join(heads, ["_did", "_th"]).withColumn("_edited", edited).withColumn("_sha", F.sha2(F.col("_edited").cast("binary"), 256))
    sha = {f"_s{k}": F.conv(F.substring("_sha", 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)}
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t"))))
    rows = both.withColumns(sha).select("_did", "_th", *sha, kinds.alias("x")).select("_did", "_th", *sha, F.col("x.k").alias("kind"), F.col("x.t").alias("_t"))
    votes = fingerprints(rows, ["_did", "_th", "kind"], "_t", tuple(sha))
    pick = {n: F.max(F.when(F.col("kind") == k, F.col(f))) for n, k, f in (("f0", 0, "f0"), ("f1", 0, "f1"), ("e0", 1, "f0"), ("e1", 1, "f1"))}
    prints = staged(votes.groupBy("_did", "_th").agg(*[c.alias(n) for n, c in pick.items()], *[F.max(c).alias(c) for c in sha]))

    distinct = staged(prints.groupBy("f0", "f1").agg(F.count("*").alias("copies"), F.min(F.when(F.col("_did") != NULL_ID, F.col("_did"))).alias("least")))
    asked = prints.filter(F.col("_did") % query_step == 0).select("f0", "f1").distinct()
    near = near_counts(asked, distinct, radius).select("f0", "f1", (F.col("copies") - 1).alias("near_count"), F.col("least").alias("near_id"))
    nxt = prints.select(F.col("_did").alias("n0"), F.col("_th").alias("n1"), F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    asked_id = (F.col("_did") % query_step == 0) & (F.col("_did") != NULL_ID)
    out = order.join(prints, ["_did", "_th"]).join(nxt, ["n0", "n1"]).join(near, ["f0", "f1"], "left")
    out = out.select(
        "_did",
        "_th",
        F.col("_n").alias("n_chars"),
        F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in sha])).alias("edited_sha256"),
        hex_string(F.col("f0"), F.col("f1")).alias("fingerprint"),
        hex_string(F.col("e0"), F.col("e1")).alias("edited_fingerprint"),
        likeness(*map(F.col, ("f0", "f1", "e0", "e1"))).alias("near_edited"),
        likeness(*map(F.col, ("f0", "f1", "g0", "g1"))).alias("near_next"),
        F.when(asked_id, F.col("near_count")).alias("near_count"),
        F.when(asked_id, F.col("near_id")).alias("near_id"),
    )
    return keyed.select("_did", "_th", "doc_id").join(out, ["_did", "_th"]).drop("_did", "_th")
