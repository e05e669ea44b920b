"""Substring dedup: suffix automata of reference shards over words.

A window is ``length`` consecutive words of one document. Each word covered by a
window whose word sequence also starts earlier goes: at a smaller doc_id, or
earlier in the same document. Windows are judged on the input.

An automaton of the whole corpus can't be broadcast, and streaming every
document through every shard's automaton is quadratic, so shards are cut by
content. Every window picks the smallest hash of its ``ANCHOR``-word runs;
equal windows pick the same, so a shard holds the passages (runs of windows
that picked one place) of one hash, and documents stream through the shards of their own
passages alone:

1. hashes picked twice or more are marked in a bitmap of at most ``most_bits``
   bits (its size is bounded, so it may be broadcast; a full bitmap costs
   shuffle and loses nothing),
2. marked passages go to their shard, equal passages pre-aggregated on the map
   side; of equal passages all but the earliest go whole,
3. the different passages of a shard are read in order: matching statistics
   over the automaton of the earlier ones give, at each word, the longest match
   that ends there; where it reaches ``length`` the window goes. Then the
   passage is added to the automaton.

Words are compared by 64-bit hashes. Null text has no words. Null doc_ids come
first. Rows that share a doc_id are ordered by a hash of their text; fully equal
rows are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.llm import textkernel as tk
from weftnet.llm.base import NULL_ID, partitions, text_or_empty

ANCHOR = 5
BATCH_BYTES = 1 << 20


class SuffixAutomaton:
    """Online suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, sequence) -> None:
        nxt, link, length, last = self.next, self.link, self.len, 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:  # the run is there already
                last = q if length[last] + 1 == length[q] else self._split(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def matches(self, sequence) -> list[int]:
        """For each position, the length of the longest run ending there that occurs in what was added."""
        nxt, link, length, state, run, out = self.next, self.link, self.len, 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            q = nxt[state].get(c)
            if q is None:
                run = 0
            else:
                state, run = q, run + 1
            out.append(run)
        return out


def passages(texts: pa.Array, length: int):
    """(words, picked hash, document, first word, windows) of the passages of some texts; arrays but the first."""
    w = tk.words(texts)
    g = tk.grams(w.hashes, ANCHOR)
    n_windows = np.maximum(np.diff(w.of_doc) - length + 1, 0)
    if not n_windows.sum():
        none = np.zeros(0, np.int64)
        return w, none.astype(np.uint64), none, none, none
    span, least, where = length - ANCHOR + 1, g, np.arange(len(g))
    have = 1
    while have < span:  # leftmost minima over 1, 2, 4 ... runs
        step = min(have, span - have)
        right = least[step:] < least[:-step]
        least, where = (np.where(right, x[step:], x[:-step]) for x in (least, where))
        have += step
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    # a passage: the windows that picked the same place, at most ``span`` of them
    begin = np.flatnonzero(np.diff(where[w.of_doc[doc] + at], prepend=-1))
    # least hashes crowd near zero: mixed again, they spread over buckets and bits
    return w, tk.mix(least[w.of_doc[doc] + at][begin]), doc[begin], at[begin], np.diff(begin, append=len(doc))


def _repeated(docs: DataFrame, length: int, bits: int) -> np.ndarray:
    """Bitmap over the leading bits of picked hashes that occur twice or more."""
    spark = docs.sparkSession
    buckets = 1 << max(3, (4 * partitions(spark) - 1).bit_length())
    shift, per = 64 - bits.bit_length() + 1, bits // buckets

    def emit(batches):
        for batch in batches:
            for begin, end in tk.slices(batch.column(0), 32 * BATCH_BYTES):
                held = []
                for a, b in tk.slices(batch.column(0).slice(begin, end - begin), BATCH_BYTES):
                    held.append(passages(batch.column(0).slice(begin + a, b - a), length)[1])
                keys = np.concatenate(held)
                parts = list(tk.packed((keys >> np.uint64(shift)).astype(np.int64) // per, [keys], buckets))
                yield pa.record_batch([pa.array([g for g, _ in parts], pa.int32()), pa.array([c[0] for _, c in parts], pa.binary())], ["bucket", "keys"])

    def count(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for g, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.setdefault(g, []).append(np.frombuffer(k, np.uint64))
        for g, keys in rows.items():
            keys = np.sort(np.concatenate(keys))
            twice = keys[1:][keys[1:] == keys[:-1]]
            flags = np.zeros(per, bool)
            flags[(twice >> np.uint64(shift)).astype(np.int64) - g * per] = True
            yield pa.record_batch([pa.array([g], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["bucket", "flags"])

    keys = docs.select("text").mapInArrow(emit, "bucket int, keys binary")
    found = keys.repartition(partitions(spark), "bucket").mapInArrow(count, "bucket int, flags binary")
    out = np.zeros(bits // 8, np.uint8)
    for g, flags in ((r["bucket"], r["flags"]) for r in found.toLocalIterator()):  # bits / 8 bytes in all
        out[g * per // 8 : (g + 1) * per // 8] = np.frombuffer(flags, np.uint8)
    return out


ENTRY = [("key", np.uint64), ("same", np.uint64), ("did", np.int64), ("th", np.int64), ("start", np.int64), ("n", np.int64)]


def _later(rows: np.ndarray) -> np.ndarray:
    """Flags of rows, ordered by (key, same, position), that come after the first of their (key, same)."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["same"][1:] != rows["same"][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    moved = np.zeros(len(rows), bool)
    for c in ("did", "th", "start"):
        moved |= rows[c] != rows[c][first]
    return moved, new


def _ordered(rows: np.ndarray) -> np.ndarray:
    return np.lexsort((rows["start"], rows["th"], rows["did"], rows["same"], rows["key"]))


def repeats(docs: DataFrame, length: int = 20, most_bits: int = 1 << 28) -> DataFrame:
    """(_did, _th, start, n): n windows from word ``start`` on that repeat an earlier one."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = 1 << max(16, min(most_bits, size // 3).bit_length())  # some 16 for each passage
    bits = min(bits, most_bits)
    shared = spark.sparkContext.broadcast(_repeated(docs, length, bits))
    shift, buckets = 64 - bits.bit_length() + 1, 4 * partitions(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("_did"), F.xxhash64(text_or_empty()).alias("_th"), F.col("text"))

    def gone(rows):
        return pa.record_batch(
            [pa.nulls(len(rows), pa.int32()), *[pa.nulls(len(rows), pa.binary())] * 2, *[pa.array(rows[c]) for c in ("did", "th", "start", "n")]],
            ["bucket", "rows", "words", "_did", "_th", "start", "n"],
        )

    def emit(batches):
        marked = shared.value
        for batch in batches:
            did, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for begin, end in tk.slices(batch.column(2), BATCH_BYTES):
                w, key, doc, at, n = passages(batch.column(2).slice(begin, end - begin), length)
                slot = (key >> np.uint64(shift)).astype(np.int64)
                keep = (marked[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
                key, doc, at, n = key[keep], doc[keep], at[keep], n[keep]
                if not len(key):
                    continue
                rows = np.zeros(len(key), ENTRY)
                first = w.of_doc[doc] + at
                many = n + length - 1
                # a passage's content: its words, weighed by place, and their number
                ends = np.cumsum(many)
                place = np.arange(ends[-1]) - np.repeat(ends - many, many)
                content = w.hashes[np.repeat(first, many) + place]
                weight = tk.mix((np.arange(2 * length, dtype=np.uint64) + np.uint64(1)) * np.uint64(tk.GOLDEN)) | np.uint64(1)
                rows["key"], rows["did"], rows["th"], rows["start"], rows["n"] = key, did[begin + doc], th[begin + doc], at, n
                rows["same"] = tk.mix(np.add.reduceat(content * weight[place], ends - many) + n.astype(np.uint64))
                order = _ordered(rows)
                later, new = _later(rows[order])
                if later.any():
                    yield gone(rows[order][later])
                send = order[new]
                parts = np.argsort((key[send] % np.uint64(buckets)).astype(np.int64), kind="stable")
                send = send[parts]
                group = (key[send] % np.uint64(buckets)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(group, prepend=-1))
                out = []
                for a, b in zip(cuts, np.append(cuts[1:], len(group))):
                    own = send[a:b]
                    held = np.concatenate([content[ends[i] - many[i] : ends[i]] for i in own])
                    out.append((int(group[a]), rows[own].tobytes(), held.tobytes()))
                none = pa.nulls(len(out), pa.int64())
                yield pa.record_batch(
                    [pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[j] for x in out], pa.binary()) for j in (1, 2)], none, none, none, none],
                    ["bucket", "rows", "words", "_did", "_th", "start", "n"],
                )

    def match(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for g, r, c in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                if g is None:
                    continue
                held.setdefault(g, []).append((np.frombuffer(r, ENTRY), np.frombuffer(c, np.uint64)))
            plain = pa.Table.from_batches([batch]).filter(pc.is_null(batch.column(0)))
            yield from plain.select(["_did", "_th", "start", "n"]).to_batches()
        while held:
            _, parts = held.popitem()
            rows, content = np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])
            parts = None
            ends = np.cumsum(rows["n"] + length - 1)
            order = _ordered(rows)
            later, new = _later(rows[order])
            found = [rows[order][later][["did", "th", "start", "n"]]]
            lead = order[new]
            lead = lead[np.lexsort((rows["start"][lead], rows["th"][lead], rows["did"][lead], rows["key"][lead]))]
            keys = rows["key"][lead]
            cuts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(lead))):
                if b - a < 2:
                    continue
                shard = SuffixAutomaton()
                for i in lead[a:b]:
                    run = content[ends[i] - rows["n"][i] - length + 1 : ends[i]].tolist()
                    if i != lead[a]:
                        hits = np.flatnonzero(np.array(shard.matches(run)[length - 1 :]) >= length)
                        if len(hits):
                            part = np.zeros(len(hits), found[0].dtype)
                            part["did"], part["th"], part["start"], part["n"] = rows["did"][i], rows["th"][i], rows["start"][i] + hits, 1
                            found.append(part)
                    if i != lead[b - 1]:
                        shard.add(run)
            got = np.concatenate(found)
            yield pa.record_batch([pa.array(np.ascontiguousarray(got[c])) for c in ("did", "th", "start", "n")], ["_did", "_th", "start", "n"])

    sent = keyed.mapInArrow(emit, "bucket int, rows binary, words binary, _did long, _th long, start long, n long")
    # removals found on the map side have no bucket; they are spread, not sent to one task
    where = F.coalesce(F.col("bucket").cast("long"), F.xxhash64("_did", "start"))
    return sent.repartition(partitions(spark), where).mapInArrow(match, "_did long, _th long, start long, n long")


def substring_dedup(docs: DataFrame, length: int = 20, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text (the kept words, joined by one space)."""
    gone = repeats(docs, length, **options).groupBy("_did", "_th").agg(F.collect_list("start").alias("_starts"), F.collect_list("n").alias("_ns"))
    keyed = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("_did"), F.xxhash64(text_or_empty()).alias("_th"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    rows = keyed.join(gone, ["_did", "_th"], "left").select("doc_id", "text", "_starts", "_ns")

    def cut(batches):
        for batch in batches:
            for begin, end in tk.slices(batch.column(1), BATCH_BYTES):
                w = tk.words(batch.column(1).slice(begin, end - begin))
                raw, starts, ends = w.data.tobytes(), w.starts.tolist(), w.ends.tolist()
                kept, n_words, n_removed = [], np.diff(w.of_doc), []
                for k, (a, b) in enumerate(zip(w.of_doc[:-1].tolist(), w.of_doc[1:].tolist())):
                    s, n = batch.column(2)[begin + k], batch.column(3)[begin + k]
                    if not s.is_valid:
                        kept.append(b" ".join([raw[x:y] for x, y in zip(starts[a:b], ends[a:b])]))
                        n_removed.append(0)
                        continue
                    s, n = (v.values.to_numpy(zero_copy_only=False) for v in (s, n))
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + length - 1, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    n_removed.append(b - a - len(stay))
                    kept.append(b" ".join([raw[starts[a + x] : ends[a + x]] for x in stay.tolist()]))
                yield pa.record_batch(
                    [batch.column(0).slice(begin, end - begin), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "text"],
                )

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")
