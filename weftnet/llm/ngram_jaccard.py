"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct shingles of ``width`` words
(A-Z lower-cased); fewer words make one shingle of all; no words, no shingles.
Two documents link when ``den * |both| >= num * |either|``. Hashes have 64 bits,
so texts are told apart up to collisions of probability 2**-64 a pair.

Sketch. The set is dealt by hash into the P blocks of its size band, and a
block's parity word is the XOR of its shingle hashes. Two sets that differ in d
shingles differ in d blocks at most: the count of differing blocks bounds the
symmetric difference from below. Linked sets of sizes m and n differ in at most
D = (den - num) * (m + n) / (den + num) shingles, so of the occupied blocks all
but D agree. By the pigeonhole principle, when each document orders its blocks
by one common rule, its first D + 1 hold one that the other has among its own
first D + 1. Those are its join keys. The rule puts blocks with shingles that
are frequent in a bounded sample last; it decides speed alone. Sets up to 64
shingles take a block for each shingle. A document also joins in the next size
band if a partner may be there, so each pair meets in its larger one's band.

Equal sets are one node, named by a hash of their digest, so a text and its copies
are joined and verified once, and rows that share a doc_id with different texts are
nodes of their own.

Join. Keys are dealt to buckets, which tasks take one after the other. A key's sets
are grouped by tiers of sizes, each with the tier below, as sets of other sizes
can't link. In a group of at most ``small`` sets all pairs are candidates; in a
larger one each set is a candidate with that of the smallest doc_id, and the
members are noted.
With each key comes the next smaller key of its set: where two sets agree on that,
too, they meet there as well, so in small groups a pair is made only where a run of
shared keys begins. Of a candidate pair first the bit sketches are compared: the parity of
the hashes that fall on each of 2n to 4n bits. Where their Hamming distance is
above D the pair can't link; the others are verified on their whole sets. Where a
noted group has members in several components after that, they are compared by
sketch in blocks, all pairs across components, and what passes is verified, so no
link between components is lost. Where groups are very large, ``pivot_rounds`` first
tries members of three components against the others.

Results: one row per row of the input with doc_id, n_shingles, component_id, the
smallest doc_id that can be reached by links of any row's text. Null text: no
shingles. A null doc_id takes no part: its component is null. Rows that repeat a
doc_id are reached together; each keeps its own n_shingles. Other columns of the
input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.llm import textkernel as tk
from weftnet.llm.base import partitions, staged, text_or_empty, tidy
from weftnet.llm.components import components

BAND = 16  # sizes of a band grow by this factor
FIRST = 64  # largest set of the first band
HOT_BITS = 26
BATCH_BYTES = 1 << 20
PART, PART_BYTES = 4096, 8 << 20  # members of a group that are compared with as many others at once, and bytes of their sketches


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for begin, end in tk.slices(texts, BATCH_BYTES):
        w = tk.words(texts.slice(begin, end - begin), lower=True)
        all_grams = tk.grams(w.hashes, width)
        for a, b in zip(w.of_doc[:-1], w.of_doc[1:]):
            if b - a >= width:
                yield np.unique(all_grams[a : b - width + 1])
            elif b > a:
                yield tk.grams(w.hashes[a:b], int(b - a))
            else:
                yield w.hashes[:0]


def digest(sets: np.ndarray) -> tuple[int, int, int]:
    """Size, sum and XOR: equal for equal sets, and else different but for collisions."""
    return len(sets), int(sets.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(tk.mix(sets), initial=np.uint64(0)).view(np.int64))


def most_apart(n: int, num: int, den: int) -> int:
    """Largest symmetric difference of a set of n shingles and any set that links with it."""
    return (den - num) * (n + n * den // num) // (den + num)


def band_of(n: int) -> int:
    band, top = 0, FIRST
    while n > top:
        band, top = band + 1, top * BAND
    return band


def bit_sketch(sets: np.ndarray) -> bytes:
    """Parities of a set on a power of two of bits, 2n at least."""
    bits = 1 << max(8, (2 * len(sets) - 1).bit_length())
    parity = np.bincount((sets >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(bool), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Differing bits, the longer sketch being folded to the length of the other."""
    x, y = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def size_tier(n: int, num: int, den: int) -> int:
    """Sets that link lie in the same tier of sizes or in neighbouring ones."""
    return int(math.log(n) / math.log(den / num) + 1e-9) if num < den else min(n, 255)


def part_of(tier: int, num: int, den: int) -> int:
    """Members a part of a group whose largest set has this tier: bounded in number and in bytes of sketches."""
    if num == den:  # the tier doesn't bound the size
        return PART // 4
    largest = (den / num) ** (tier + 1)  # sketches have 4 bits a shingle at most
    return max(16, int(min(PART, PART_BYTES / max(32, largest / 2))))


def tiered(keys: np.ndarray, ids: np.ndarray, tiers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of a key and a tier: its own documents, and those of the tier below."""
    named = lambda t: tk.mix(keys ^ tk.mix((t.astype(np.uint64) + np.uint64(1)) * np.uint64(tk.GOLDEN)))
    own, above = named(tiers.astype(np.int64)), named(tiers.astype(np.int64) + 1)
    there = np.unique(own)
    at = np.minimum(np.searchsorted(there, above), len(there) - 1)
    visits = there[at] == above
    return np.concatenate([own, above[visits]]), np.concatenate([ids, ids[visits]])


def join_keys(sets: np.ndarray, band: int, apart: int, hot: np.ndarray) -> np.ndarray:
    """The first ``apart`` + 1 parity words of a set in a band."""
    slot = (sets >> np.uint64(64 - HOT_BITS)).astype(np.int64)
    warm = (hot[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
    if band == 0:
        words = sets
    else:
        blocks = sets % np.uint64(FIRST * BAND**band)
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order], prepend=np.uint64(2**64 - 1)))
        words = np.bitwise_xor.reduceat(sets[order], cuts)
        warm = np.logical_or.reduceat(warm[order], cuts)
    if len(words) <= apart:
        raise RuntimeError(f"{len(sets)} shingles fill {len(words)} blocks only")
    keys = tk.mix(words ^ np.uint64((band + 1) * tk.GOLDEN % 2**64))
    if len(keys) == apart + 1:
        return keys
    first = keys >> np.uint64(1) | warm.astype(np.uint64) << np.uint64(63)
    return keys[np.argpartition(first, apart)[: apart + 1]]


def _hot_table(docs: DataFrame, width: int, sample: int) -> np.ndarray:
    """Bitmap (8 MB, whatever the corpus) of hash prefixes that 4 or more of about ``sample`` documents have."""
    step = max(1, docs.count() // sample)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")

    def prefixes(batches):
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                yield pa.record_batch([pa.array((s >> np.uint64(64 - HOT_BITS)).astype(np.int32))], ["p"])

    often = some.mapInArrow(tidy(prefixes), "p int").groupBy("p").count().filter("count >= 4").select("p")
    hot = np.zeros(1 << HOT_BITS, bool)
    hot[often.toPandas()["p"].to_numpy()] = True  # a fourth of the sample's shingles at most
    return np.packbits(hot)


ROWS = "bucket int, keys binary, before binary, ids binary, docs binary, tiers binary, doc_id long, th long, id long, n_shingles long, sketch binary"
DOC = ("doc_id", "th", "id", "n_shingles", "sketch")
KEY = {"keys": np.uint64, "before": np.uint64, "ids": np.int64, "docs": np.int64, "tiers": np.uint8}
FLUSH = 1_000_000  # keys
MADE = 1_000_000  # pairs held to drop repeats


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _rows(schema: pa.Schema, n: int, given: dict) -> pa.RecordBatch:
    """``n`` rows with the given columns; the others are null."""
    return pa.record_batch([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema)


def node_of(sets: np.ndarray) -> int:
    """A name for all equal sets."""
    n, d0, d1 = digest(sets)
    parts = np.array([n, d0 & 2**64 - 1, d1 & 2**64 - 1], np.uint64)
    return int(tk.mix(np.array([(parts * np.array([tk.odd(k) for k in range(3)])).sum(dtype=np.uint64)]))[0].view(np.int64))


def _emit(docs: DataFrame, width: int, num: int, den: int, hot: np.ndarray, buckets: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        table, schema = shared.value, _schema(ROWS)
        keys, names, held, seen = [], [], 0, set()

        def flush():
            if not keys:
                return
            many = np.array([len(k) for k in keys])
            k = np.concatenate(keys)
            before = np.concatenate([[0], k[:-1]]).astype(np.uint64)
            before[np.cumsum(many) - many] = 0  # a set's smallest key has none before it
            ids, of = (np.repeat(np.array([x[j] for x in names], np.int64), many) for j in (0, 1))
            tiers = np.repeat(np.array([x[2] for x in names], np.uint8), many)
            parts = list(tk.packed((k % np.uint64(buckets)).astype(np.int64), [k, before, ids, of, tiers], buckets))
            yield _rows(schema, len(parts), {"bucket": [g for g, _ in parts]} | {c: [x[j] for _, x in parts] for j, c in enumerate(KEY)})
            keys.clear(), names.clear(), seen.clear()

        for batch in batches:
            rows = []
            for doc, th, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), width)):
                n, name = len(s), node_of(s)
                rows.append((doc, th, name, n, bit_sketch(s)))
                if doc is None or not n or name in seen:
                    continue
                seen.add(name)
                apart, band = most_apart(n, num, den), band_of(n)
                for b in range(band, band_of(n * den // num) + 1):
                    k = np.sort(join_keys(s, b, apart, table))
                    keys.append(k), names.append((name, doc, size_tier(n, num, den)))
                    held += len(k)
                if held >= FLUSH:
                    yield from flush()
                    held = 0
            for c in range(0, len(rows), 2000):
                part = rows[c : c + 2000]
                yield _rows(schema, len(part), {"bucket": [(r[0] or 0) % buckets for r in part]} | {name: [r[j] for r in part] for j, name in enumerate(DOC)})
        yield from flush()

    return docs.select("doc_id", "th", "text").mapInArrow(tidy(run), ROWS)


MET = "kind int, a long, b long, doc_id long, th long, id long, n_shingles long, sketch binary, members binary"


def _groups(keys: np.ndarray, before: np.ndarray, ids: np.ndarray, docs: np.ndarray, tiers: np.ndarray, small: int):
    """Candidate pairs (a < b) of a bucket, and (members, largest tier) of its larger groups."""
    keys, rows = tiered(keys, np.arange(len(ids)), tiers)
    ids, before, docs, tiers = ids[rows], before[rows], docs[rows], tiers[rows]
    order = np.lexsort((docs, ids, keys))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    # by doc_id: copies mostly come after what they were made from, which is the nearest to all of them
    order = order[np.lexsort((ids[order], docs[order], keys[order]))]
    keys, ids, before, tiers = keys[order], ids[order], before[order], tiers[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    sizes = np.diff(starts, append=len(keys))
    # places of the two of each pair
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in range(2, small + 1):
        at = starts[sizes == size]
        for x, y in combinations(range(size), 2):
            low.append(at + x), high.append(at + y)
    low, high = np.concatenate(low), np.concatenate(high)
    new = (before[low] != before[high]) | (before[low] == 0)
    low, high = [low[new]], [high[new]]
    large = np.flatnonzero(sizes > small)
    for at, size in zip(starts[large].tolist(), sizes[large].tolist()):
        low.append(np.full(size - 1, at)), high.append(np.arange(at + 1, at + size))
    pairs = np.stack([ids[np.concatenate(low)], ids[np.concatenate(high)]], 1)
    return _distinct(np.sort(pairs, axis=1)), [(np.sort(ids[at : at + size]), int(tiers[at : at + size].max())) for at, size in zip(starts[large], sizes[large])]


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    keep = np.ones(len(pairs), bool)
    keep[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs[keep]


def _meet(entries: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """kind 0: candidate pair a < b; 1: members of a large group, in chunks (a: the group, b: its size); 2: a document.

    Tasks get their buckets in order and hold one at a time.
    """

    def run(batches):
        schema = _schema(MET)
        noted, held, now, met = set(), {c: [] for c in KEY}, None, []

        def made():
            pairs = _distinct(np.concatenate(met)) if met else np.zeros((0, 2), np.int64)
            met.clear()
            for c in range(0, len(pairs), 50_000):
                part = pairs[c : c + 50_000]
                yield _rows(schema, len(part), {"kind": np.zeros(len(part), np.int32), "a": part[:, 0], "b": part[:, 1]})

        def settled():
            if not held["keys"]:
                return
            pairs, groups = _groups(*[np.concatenate(held[c]) for c in KEY], small)
            for c in KEY:
                held[c].clear()
            met.append(pairs)
            if sum(map(len, met)) > MADE:
                yield from made()
            for members, tier in groups:
                name = (len(members), int(tk.mix(members.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)))
                if name in noted:
                    continue
                if len(noted) < 1_000_000:  # else it may be noted again, which is undone later
                    noted.add(name)
                part = part_of(tier, num, den)
                chunks = [members[c : c + part].tobytes() for c in range(0, len(members), part)]
                n = len(chunks)
                yield _rows(schema, n, {"kind": [1] * n, "a": [name[1]] * n, "b": [name[0]] * n, "members": chunks})

        for batch in batches:
            docs = pa.Table.from_batches([batch])
            docs = docs.filter(pc.is_valid(docs["n_shingles"])).combine_chunks()
            if docs.num_rows:
                yield _rows(schema, docs.num_rows, {"kind": np.full(docs.num_rows, 2, np.int32)} | {c: docs[c].combine_chunks() for c in DOC})
            buckets, blobs = batch.column("bucket").to_pylist(), [batch.column(c) for c in KEY]
            for k, bucket in enumerate(buckets):
                if bucket != now:
                    yield from settled()
                    now = bucket
                if blobs[0][k].is_valid:
                    for (c, kind), blob in zip(KEY.items(), blobs):
                        held[c].append(np.frombuffer(blob[k].as_py(), kind))
        yield from settled()
        yield from made()

    n = partitions(entries.sparkSession)
    return entries.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), MET)


def _staged_in(df: DataFrame, rows: int) -> DataFrame:
    """``df`` staged with Arrow batches of so many rows, as its rows may be large."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(name)
    conf.set(name, str(rows))
    try:
        return staged(df)
    finally:
        conf.set(name, was)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int, most_ids: int) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes that link; ``nodes`` has id, doc_id (of one of its rows), n_shingles, sketch."""
    for x in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")), x)
    pairs = pairs.filter((F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num))

    def near(batches):
        for batch in batches:
            most = (den - num) * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) // (den + num)
            apart = [sketch_distance(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            keep = pa.array(np.flatnonzero(np.array(apart, np.int64) <= most))
            yield pa.record_batch([batch.column(k).take(keep) for k in (0, 1)], ["a", "b"])

    pairs = _staged_in(pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(tidy(near), "a long, b long"), 2000)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = staged(wanted.join(nodes.select("id", "doc_id"), "id"))
    large = wanted.count() > most_ids
    some, names = wanted.select("doc_id").distinct(), wanted.select("id")
    texts = docs.join(some if large else F.broadcast(some), "doc_id", "left_semi").select("doc_id", "text")

    def sets(batches):
        for batch in batches:
            for begin, end in tk.slices(batch.column(1), BATCH_BYTES):
                found = list(shingle_sets(batch.column(1).slice(begin, end - begin), width))
                yield pa.record_batch([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "grams"])

    def compare(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(np.flatnonzero(good))
            yield pa.record_batch([batch.column(k).take(keep) for k in (0, 1)], ["a", "b"])

    # of rows that share a doc_id, those that are wanted
    held = texts.mapInArrow(tidy(sets), "id long, grams binary").join(names if large else F.broadcast(names), "id", "left_semi")
    out = pairs.join(held.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    out = out.join(held.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")
    return staged(_staged_in(out.mapInArrow(tidy(compare), "a long, b long"), 500).distinct())


def _unsettled(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, size, part, id, root): members of the noted groups that lie in several components."""

    def members(batches):
        for batch in batches:
            for g, size, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = np.frombuffer(m, np.int64)
                # parts of a group are cut at the same places wherever it was noted
                part = np.full(len(ids), int(tk.mix(ids[:1].view(np.uint64))[0] >> np.uint64(1)))
                yield pa.record_batch([pa.array(np.full(len(ids), g)), pa.array(np.full(len(ids), size)), pa.array(part), pa.array(ids)], ["g", "size", "part", "id"])

    each = groups.select("a", "b", "members").distinct().mapInArrow(tidy(members), "g long, size long, part long, id long")
    return _still(each, roots)


def _still(each: DataFrame, roots: DataFrame) -> DataFrame:
    each = each.join(roots, "id", "left").select("g", "size", "part", "id", F.coalesce("component", "id").alias("root"))
    mixed = each.groupBy("g", "size").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("g", "size")
    return staged(each.join(mixed, ["g", "size"], "left_semi"))


def _pivots(each: DataFrame) -> DataFrame:
    """Pairs (a, b) of a member of each group's largest, of its smallest and of one other component with the members of others."""
    comps = each.groupBy("g", "size", "root").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    ends = comps.groupBy("g", "size").agg(
        F.min(F.struct(-F.col("k"), "root", "id")).alias("x"), F.max(F.struct(-F.col("k"), "root", "id")).alias("y"),
        F.min(F.struct(F.xxhash64("root"), "root", "id")).alias("z"),
    )
    chosen = ends.select("g", "size", F.explode(F.array(*[F.struct(F.col(f"{c}.root").alias("r"), F.col(f"{c}.id").alias("a")) for c in "xyz"])).alias("p"))
    pairs = each.join(chosen.select("g", "size", "p.r", "p.a").distinct(), ["g", "size"]).filter("root != r")
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def _across(each: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of a group in different components whose sketches allow a link.

    A group is compared part by part (``part_of`` says how many members a part
    has), so no task holds more than two parts, and only pairs that pass are made.
    Each member is sent once for each part of its group.
    """
    parts = each.select("g", "size", "part").distinct()
    other = parts.select("g", "size", F.col("part").alias("with"))
    blocks = parts.join(other, ["g", "size"]).select("g", "size", "part", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"))
    rows = each.join(nodes.select("id", F.col("n_shingles").alias("n"), "sketch"), "id")
    rows = rows.join(blocks, ["g", "size", "part"]).select("g", "size", "lo", "hi", "part", "id", "root", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        lo, hi, part, ids, root, n = (table[c].to_numpy() for c in ("lo", "hi", "part", "id", "root", "n"))
        sketches = table["sketch"].to_pylist()
        length = np.array([len(x) for x in sketches])
        found = [np.zeros((0, 2), np.int64)]
        for size in np.unique(length):  # with sketches of the same length, or longer ones folded to it
            small = np.flatnonzero(length == size)
            large = np.flatnonzero((length == size) | (length == 2 * size))
            bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[k], np.uint64).reshape(-1, size // 8), axis=0) for k in large])
            at, step = np.searchsorted(large, small), max(1, (1 << 18) // bits.size)
            for c in range(0, len(small), step):
                k, x = small[c : c + step, None], bits[at[c : c + step]]
                apart = np.bitwise_count(x[:, None, :] ^ bits).sum(2)
                fits = (apart <= (den - num) * (n[large] + n[k]) // (den + num)) & (root[large] != root[k])
                fits &= (n[large] * den >= n[k] * num) & (n[k] * den >= n[large] * num)
                if lo[0] != hi[0]:  # pairs within a part have a block of their own
                    fits &= part[large] != part[k]
                a, b = np.nonzero(fits)
                a, b = ids[small[c + a]], ids[large[b]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("g", "size", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


class Linked(NamedTuple):
    """rows: doc_id, th, id, n_shingles of every row; nodes: one row an id; links: (a, b) of nodes."""

    rows: DataFrame
    nodes: DataFrame
    links: DataFrame


def linked_sets(
    docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, small: int = 4, sample: int = 12_000, most_ids: int = 1_000_000, pivot_rounds: int = 0
) -> Linked:
    """Links that hold together whatever is linked: between any two linked texts there is a path.

    Ids of candidates are broadcast if they are ``most_ids`` at most, else joined by a shuffle.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), "text")
    hot = _hot_table(docs, width, sample)
    met = staged(_meet(_emit(docs, width, num, den, hot, 4 * partitions(spark)), small, num, den))
    rows = met.filter("kind = 2").select("doc_id", "th", "id", "n_shingles")
    solid = met.filter("kind = 2 and doc_id is not null and n_shingles > 0")
    nodes = staged(solid.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")))

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, docs, nodes, width, num, den, most_ids)

    links = verified(met.filter("kind = 0").select("a", "b").distinct())
    groups = met.filter("kind = 1")
    if groups.isEmpty():
        return Linked(rows, nodes, links)
    each = _unsettled(groups, components(links))
    for _ in range(pivot_rounds):
        if each.isEmpty():
            break
        more = verified(_pivots(each))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        each = _still(each.drop("root"), components(links))
    if not each.isEmpty():
        links = links.unionByName(verified(_across(each, nodes, num, den)))
    return Linked(rows, nodes, links)


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id. Options: those of ``linked_sets``."""
    rows, nodes, links = linked_sets(docs, **options)
    first = nodes.select("id", F.col("doc_id").alias("rep"))
    for x in ("a", "b"):
        links = links.join(first.withColumnRenamed("id", x), x).drop(x).withColumnRenamed("rep", x)
    copies = rows.filter("doc_id is not null and n_shingles > 0").join(first, "id").filter("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(links.unionByName(copies))
    out = rows.select("doc_id", "n_shingles").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that of the smallest doc_id (then of the smallest xxhash64 of its text).

    A text is judged by itself: rows that share a doc_id with different texts go or
    stay each for its own links. Of rows that are equal in doc_id and text one stays.
    Rows of null doc_id, and texts without a word, are linked with nothing and stay.
    """
    rows, _, links = linked_sets(docs, **options)
    solid = rows.filter("doc_id is not null and n_shingles > 0")
    rooted = solid.join(components(links), "id", "left").select("doc_id", "th", F.coalesce("component", "id").alias("root"))
    groups = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("n"))
    gone = rooted.join(groups.filter("n > 1"), "root").filter("struct(doc_id, th) != first")
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    twice = solid.groupBy("doc_id", "th").count().filter("count > 1").select(F.col("doc_id").alias("_twice_id"), F.col("th").alias("_twice_th"))
    gone, twice = staged(gone), staged(twice)
    same = lambda x: (docs["doc_id"].cast("long") == x[x.columns[0]]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == x[x.columns[1]])
    out = docs.join(gone, same(gone), "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
    if twice.isEmpty():
        return out
    key = F.struct(out["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"))
    marked = out.select(key.alias("key"), F.struct(*[out[f"`{c}`"] for c in out.columns]).alias("row"))
    on = (F.col("key.doc_id") == twice["_twice_id"]) & (F.col("key.th") == twice["_twice_th"])
    once = marked.join(twice, on, "left_anti").select("row")
    one = marked.join(twice, on, "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.unionByName(one).select("row.*")
