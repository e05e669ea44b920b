"""SentencePiece encoding and decoding over a lattice.

A text is read as SentencePiece reads it under an identity normaliser: a space
is put before it (not before an empty one) and spaces become U+2581. It falls
into chunks: a run of U+2581 and the run of other characters after it, cut before
and after line feeds. No piece has U+2581 after another character, or a line feed,
so no piece reaches over a chunk's end, and equal chunks have equal pieces.

Lattice. Of the distinct chunks of some documents the substrings of at most the
longest piece's length are exploded and equi-joined to the piece table, and the
edges found are grouped by chunk. This is done on Arrow batches: as rows of their
own, the substrings of a tenth of all chunks would outweigh the texts in shuffles.
A character that is in no piece is as many places of the lattice as its UTF-8 has
bytes, each with the edge of its byte's piece.

Fold. Spark's higher-order ``aggregate`` folds each chunk's lattice to its pieces.
``unigram`` tables are folded by Viterbi over the places: best score, ties to the
longer last piece. ``bpe`` models, such as the public one, are not Viterbi encoders:
the best path by score is not what SentencePiece returns. Their fold goes over the
edges from best to worst (ties: leftmost); its state is a mask of piece ends, and an
edge that joins exactly two neighbouring pieces merges them. An edge can come within
reach after its turn only if it holds one whose turn is later, so such a one names
these edges, and they are tried when it has been made. Chunks of any length go this
way: the mask is one long up to 60 places and an array of longs beyond.

Known chunks. The chunks that occur twice in some batch are counted, and up to
``frequent`` of the most frequent are encoded first, by the same lattice and fold,
and broadcast. That bound decides speed alone: other chunks are encoded with the
documents that hold them. Texts and ids aren't shuffled.

Chunks are told apart by hashes of 64 bits. Null counts as empty: no pieces. Every
row of the input has one row; repeated rows are encoded each. A column of the input
that has the name of an output column is replaced by it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm import textkernel as tk
from weftnet.llm.base import driver_gives_back, partitions, staged, text_or_empty, tidy

MARK = "▁"
MASK = 60  # places in a long
FAR = 1e9  # cost of a byte's piece in a path
FREQUENT = 400_000
BATCH_BYTES = 1 << 18
BATCH_IDS = 1 << 18
BYTES = 0x110000  # places that stand for bytes follow the code points


class Pieces(NamedTuple):
    """table: (piece, id, score) of ordinary pieces; byte0: id of the piece of byte 0; longest: characters of the longest."""

    table: DataFrame
    byte0: int
    longest: int
    path: str | None
    kind: str


def load_pieces(spark: SparkSession, path: str, kind: str = "bpe") -> Pieces:
    """Piece table of a SentencePiece model file, which is on every machine."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ordinary, byte0 = [], None
    for k in range(sp.vocab_size()):
        if sp.is_byte(k):
            byte0 = k if sp.id_to_piece(k) == "<0x00>" else byte0
        elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
            ordinary.append((sp.id_to_piece(k), k, float(sp.get_score(k))))
    if byte0 is None:
        raise ValueError("the model has no byte pieces")
    if any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in ordinary):
        raise ValueError("a piece reaches over a chunk's end")
    table = spark.createDataFrame(ordinary, "piece string, id int, score double")
    return Pieces(table, byte0, max(len(p) for p, _, _ in ordinary), path, kind)


class Lattices:
    """A piece table as arrays, sorted by hash within each length."""

    def __init__(self, rows: list[tuple[str, int, float]], byte0: int, kind: str):
        rows = sorted(rows, key=lambda r: (len(r[0]), r[0]))
        self.kind, self.byte0 = kind, byte0
        self.ids = np.array([r[1] for r in rows], np.int32)
        self.cost = np.array([-r[2] for r in rows], np.float64)
        self.chars = _code_points("".join(r[0] for r in rows))
        length = np.array([len(r[0]) for r in rows], np.int64)
        self.at = np.cumsum(length) - length
        sums = tk.running(self.chars)
        self.by_length = {}
        for k in np.unique(length).tolist():
            these = np.flatnonzero(length == k)
            hashes = tk.run_hashes(sums, self.at[these], k)
            order = np.argsort(hashes)
            self.by_length[k] = hashes[order], these[order]
        self.longest = int(length.max(initial=0))
        if self.longest > MASK:
            raise ValueError(f"pieces of more than {MASK} characters")
        self.known = np.unique(self.chars)
        if set(self.known.tolist()) != set(self.chars[self.at[length == 1]].tolist()):
            raise ValueError("a character of a piece is no piece itself")
        # the longest piece that begins with two characters, by their hash
        self.reach = np.zeros(1 << 16, np.uint8)
        two = np.flatnonzero(length > 1)
        np.maximum.at(self.reach, self._first_two(self.chars, self.at[two]), length[two].astype(np.uint8))
        # pieces that lie in a piece of no worse score
        costs = {r[0]: -r[2] for r in rows}
        late = {
            p[i:j] for p, _, score in rows for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and costs.get(p[i:j], -np.inf) >= -score
        }
        self.late = np.array([r[0] in late for r in rows], bool)

    @staticmethod
    def _first_two(chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (chars[at].astype(np.int64) * 40503 + chars[at + 1].astype(np.int64) * 2654435761 >> 5) & 0xFFFF

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' characters, those in no piece as bytes, and where each word begins (and the end)."""
        chars = _code_points("".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        spot = np.searchsorted(self.known, chars)
        strange = self.known[np.minimum(spot, len(self.known) - 1)] != chars if len(self.known) else np.ones(len(chars), bool)
        many = np.ones(len(chars), np.int64)
        at = np.flatnonzero(strange)
        raw = [chr(x).encode() for x in chars[at].tolist()]
        many[at] = [len(x) for x in raw]
        out = np.repeat(chars, many)
        upto = np.concatenate([[0], np.cumsum(many)])
        if len(at):
            to = np.concatenate([np.arange(a, b) for a, b in zip(upto[at], upto[at + 1])])
            out[to] = BYTES + np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        return out, np.concatenate([[0], upto[ends]])

    def edges(self, chars: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece found in the words: first place, length, number of the piece."""
        sums, n = tk.running(chars), len(chars)
        room = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(n)
        some = np.flatnonzero(room > 1)
        room[some] = np.minimum(room[some], np.maximum(1, self.reach[self._first_two(chars, some)]))
        found = []
        for length, (hashes, pieces) in self.by_length.items():
            at = np.flatnonzero(room >= length)
            seek = tk.run_hashes(sums, at, length)
            spot = np.minimum(np.searchsorted(hashes, seek), len(hashes) - 1)
            hit = hashes[spot] == seek
            at, piece = at[hit], pieces[spot[hit]]
            span = np.arange(length)
            same = (chars[at[:, None] + span] == self.chars[self.at[piece][:, None] + span]).all(1)
            found.append((at[same], np.full(int(same.sum()), length), piece[same]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def rows(self, words: list[str]) -> tuple[list[pa.Array], np.ndarray]:
        """The words' lattices as list columns (see ``SCHEMAS``), and for each word its place in them, one list after the other."""
        chars, cuts = self.places(words)
        at, length, piece = self.edges(chars, cuts)
        one = length == 1
        ones = np.where(chars >= BYTES, chars.astype(np.int64) - BYTES + self.byte0, 0).astype(np.int32)
        ones[at[one]] = self.ids[piece[one]]
        if self.kind == "unigram":
            paths = _paths(cuts, at, length, self.ids[piece], self.cost[piece], np.flatnonzero(chars >= BYTES), ones)
            return [paths], np.arange(len(words))
        at, length, piece = at[~one], length[~one], piece[~one]
        word = np.searchsorted(cuts, at, "right") - 1
        order = np.lexsort((length, at, self.cost[piece], word))
        at, length, piece, word = at[order], length[order], piece[order], word[order]
        first = np.searchsorted(word, np.arange(len(words) + 1))
        late, after = self._holders(at, length, piece, word, first)
        wide = np.diff(cuts) > MASK
        place = np.empty(len(words), np.int64)
        place[~wide], place[wide] = np.arange((~wide).sum()), (~wide).sum() + np.arange(wide.sum())
        out = []
        for these in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            pick, offsets = _gathered(first, these)
            begin = at[pick] - cuts[word[pick]]
            fields = {"key": pa.array(_keys(begin, self.ids[piece[pick]]))} | _bits(begin, length[pick], len(out) == 1)
            some, cut = _gathered(late, pick)
            fields["after"] = _lists(cut, pa.array(after[some], pa.int32()))
            edges = _lists(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            held, offsets = _gathered(cuts, these)
            keys = _keys(held - np.repeat(cuts[these], np.diff(offsets)), ones[held])
            out.append(_one_list(pa.StructArray.from_arrays([_lists(offsets, pa.array(keys)), edges], ["ones", "edges"])))
        return out, place

    def _holders(self, at, length, piece, word, first) -> tuple[np.ndarray, np.ndarray]:
        """For each edge those before it that hold it, by their place among the word's edges: where they begin, and all of them."""
        late = np.flatnonzero(self.late[piece])
        rank = late - first[word[late]]
        low = np.repeat(late, rank)
        high = np.arange(rank.sum()) - np.repeat(np.cumsum(rank) - rank, rank) + np.repeat(first[word[late]], rank)
        holds = (at[high] <= at[low]) & (at[high] + length[high] >= at[low] + length[low])
        low, high = low[holds], high[holds]
        return np.searchsorted(low, np.arange(len(at) + 1)), high - first[word[high]]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _gathered(cuts: np.ndarray, these: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of some groups, one after the other, and where each group's begin (and the end)."""
    many = cuts[these + 1] - cuts[these]
    offsets = np.concatenate([[0], np.cumsum(many)])
    return np.arange(offsets[-1]) + np.repeat(cuts[these] - offsets[:-1], many), offsets


def _keys(place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A place and a piece in one long, which sorts by place."""
    return place.astype(np.int64) << 32 | ids


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _one_list(values: pa.Array) -> pa.Array:
    return _lists(np.array([0, len(values)]), values)


def _bits(begin: np.ndarray, length: np.ndarray, wide: bool) -> dict[str, pa.Array]:
    """``ends``: the bits of an edge's two ends, ``span``: with those between; in a wide mask they begin in long ``w`` and end in the next."""
    low = begin % MASK if wide else begin
    top = low + length
    bit = lambda k: np.int64(1) << k
    if not wide:
        return {"span": pa.array(bit(top + 1) - bit(low)), "ends": pa.array(bit(top) | bit(low))}
    over = top >= MASK
    past = np.where(over, top - MASK, 0)
    return {
        "w": pa.array(begin // MASK, pa.int32()),
        "span": pa.array(np.where(over, bit(np.int64(MASK)), bit(np.minimum(top, MASK - 1) + 1)) - bit(low)),
        "ends": pa.array(bit(low) | np.where(over, 0, bit(np.minimum(top, MASK - 1)))),
        "span2": pa.array(np.where(over, bit(past + 1) - 1, 0)),
        "ends2": pa.array(np.where(over, bit(past), 0)),
    }


def _paths(cuts, at, length, ids, cost, byte_at, ones) -> pa.Array:
    """For each word and place the edges that end there."""
    begin = np.concatenate([at, byte_at])
    end = begin + np.concatenate([length, np.ones(len(byte_at), np.int64)])
    ids, cost = np.concatenate([ids, ones[byte_at]]).astype(np.int32), np.concatenate([cost, np.full(len(byte_at), FAR)])
    order = np.lexsort((begin, end))
    word = np.searchsorted(cuts, begin[order], "right") - 1
    edges = pa.StructArray.from_arrays([pa.array(begin[order] - cuts[word], pa.int32()), pa.array(ids[order]), pa.array(cost[order])], ["i", "id", "cost"])
    into = _lists(np.searchsorted(end[order], np.arange(1, cuts[-1] + 2)), edges)
    return _one_list(pa.StructArray.from_arrays([_lists(cuts, into)], ["into"]))


_EDGE = "key: bigint, span: bigint, ends: bigint, after: array<int>"
#: Columns of lattices: one list of words for unigram tables, one of words of up to 60 places and one of longer ones for bpe.
SCHEMAS = {
    "unigram": {"words": "array<struct<into: array<array<struct<i: int, id: int, cost: double>>>>>"},
    "bpe": {
        "words": f"array<struct<ones: array<bigint>, edges: array<struct<{_EDGE}>>>>",
        "wide": "array<struct<ones: array<bigint>, edges: array<struct<key: bigint, w: int, span: bigint, ends: bigint, span2: bigint, ends2: bigint, after: array<int>>>>>",
    },
}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


class _Long:
    """Masks of up to 60 places: a bit for each piece end."""

    def all(self, n: Column) -> Column:
        return _bit(n + 1) - 1

    def ends_within(self, mask: Column, e: Column) -> Column:
        return F.bit_count(mask.bitwiseAND(e["span"]))

    def has_ends(self, mask: Column, e: Column) -> Column:
        return mask.bitwiseAND(e["ends"]) == e["ends"]

    def merged(self, mask: Column, e: Column) -> Column:
        return mask.bitwiseAND(e["ends"].bitwiseOR(F.bitwise_not(e["span"])))

    def single(self, mask: Column, k: Column) -> Column:
        """A piece of one place begins at k."""
        return F.call_function("shiftright", mask, k).bitwiseAND(F.lit(3)) == 3


class _Longs(_Long):
    """The same for any number of places: 60 to a long."""

    def all(self, n: Column) -> Column:
        left = lambda k: F.least(F.lit(MASK), n + 1 - k * MASK)
        return F.transform(F.sequence(F.lit(0), F.floor(n / MASK).cast("int")), lambda k: _bit(left(k)) - 1)

    def _next(self, mask: Column, e: Column) -> Column:
        return F.coalesce(F.get(mask, e["w"] + 1), F.lit(0).cast("long"))

    def ends_within(self, mask: Column, e: Column) -> Column:
        return F.bit_count(F.get(mask, e["w"]).bitwiseAND(e["span"])) + F.bit_count(self._next(mask, e).bitwiseAND(e["span2"]))

    def has_ends(self, mask: Column, e: Column) -> Column:
        here = F.get(mask, e["w"]).bitwiseAND(e["ends"]) == e["ends"]
        return here & (self._next(mask, e).bitwiseAND(e["ends2"]) == e["ends2"])

    def merged(self, mask: Column, e: Column) -> Column:
        less = lambda m, k: (
            F.when(k == e["w"], m.bitwiseAND(e["ends"].bitwiseOR(F.bitwise_not(e["span"]))))
            .when(k == e["w"] + 1, m.bitwiseAND(e["ends2"].bitwiseOR(F.bitwise_not(e["span2"]))))
            .otherwise(m)
        )
        return F.transform(mask, less)

    def single(self, mask: Column, k: Column) -> Column:
        is_end = lambda p: F.call_function("shiftright", F.get(mask, F.floor(p / MASK).cast("int")), p % MASK).bitwiseAND(F.lit(1)) == 1
        return is_end(k) & is_end(k + 1)


def _merges(word: Column, masks: _Long) -> Column:
    """Ids of a word: a fold over its edges from best to worst."""
    edges, ones = word["edges"], word["ones"]
    joins_two = lambda m, e: masks.has_ends(m, e) & (masks.ends_within(m, e) == 3)

    def caught_up(mask: Column, e: Column) -> Column:
        """After a merge, the better edges that it brought within reach, best first; each merge takes one of them away."""

        def again(m: Column, _: Column) -> Column:
            ready = F.filter(F.transform(e["after"], lambda k: F.get(edges, k)), lambda x: joins_two(m, x))
            return _let(F.get(ready, F.lit(0)), lambda x: F.when(x.isNull(), m).otherwise(masks.merged(m, x)))

        return F.aggregate(e["after"], masks.merged(mask, e), again)

    def step(mask: Column, e: Column) -> Column:
        made = F.when(F.size(e["after"]) > 0, caught_up(mask, e)).otherwise(masks.merged(mask, e))
        return F.when(joins_two(mask, e), made).otherwise(mask)

    def ids(mask: Column) -> Column:
        left = F.transform(F.filter(edges, lambda e: masks.has_ends(mask, e) & (masks.ends_within(mask, e) == 2)), lambda e: e["key"])
        single = F.filter(ones, lambda k: masks.single(mask, F.call_function("shiftright", k, F.lit(32)).cast("int")))
        return F.transform(F.sort_array(F.concat(left, single)), lambda k: k.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))

    return _let(F.aggregate(edges, masks.all(F.size(ones)), step), ids)


def _best_path(word: Column) -> Column:
    """Ids of a word: Viterbi over its places, then back from the last."""
    node = lambda s, i, k: F.struct(s.alias("s"), i.alias("i"), k.alias("id"))
    none = F.lit(-1)

    def step(best: Column, edges: Column) -> Column:
        ways = F.transform(edges, lambda e: node(F.get(best, e["i"])["s"] + e["cost"], e["i"], e["id"]))
        return F.concat(best, F.array(F.array_min(ways)))

    def back(best: Column) -> Column:
        def one(state: Column, _: Column) -> Column:
            before = lambda x: F.struct(x["i"].alias("at"), F.concat(F.array(x["id"]), state["ids"]).alias("ids"))
            return F.when(state["at"] > 0, _let(F.get(best, state["at"]), before)).otherwise(state)

        start = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<int>").alias("ids"))
        return F.aggregate(word["into"], start, one)["ids"]

    return _let(F.aggregate(word["into"], F.array(node(F.lit(0.0), none, none)), step), back)


def _folded(kind: str) -> Column:
    """Ids of all words of a row's lattices: array<array<int>>."""
    if kind == "unigram":
        return F.transform("words", _best_path)
    return F.concat(F.transform("words", lambda w: _merges(w, _Long())), F.transform("wide", lambda w: _merges(w, _Longs())))


class Chunks(NamedTuple):
    """Chunks of some texts: hashes, byte ranges in ``data`` (spaces not yet marked), first chunk of each text (and the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of_doc: np.ndarray
    data: np.ndarray

    def texts(self, at: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode().replace(" ", MARK) for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


_VALUES = tk.mix(np.arange(257, 513, dtype=np.uint64) * np.uint64(tk.GOLDEN)) | np.uint64(1)


def chunks(texts: pa.Array) -> Chunks:
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
    data, at = tk.bytes_of(texts)
    space, feed = data == 0x20, data == 0x0A
    first = space | feed
    first[1:] &= ~(space[1:] & space[:-1])
    first[1:] |= feed[:-1]
    first[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return Chunks(tk.span_hashes(data, starts, _VALUES), starts, ends, np.searchsorted(starts, at), data)


def _batches(batches, column: str):
    """Slices of at most BATCH_BYTES of text, or of one row."""
    for batch in batches:
        for begin, end in tk.slices(batch.column(column), BATCH_BYTES):
            yield batch.slice(begin, end - begin)


def _lattices(pieces: Pieces) -> Lattices:
    rows = pieces.table.select("piece", "id", "score").collect()  # the model's size
    return Lattices([tuple(r) for r in rows], pieces.byte0, pieces.kind)


def repeated(docs: DataFrame) -> DataFrame:
    """(chunk, n): the chunks that occur more than once in some batch of texts, and how often in such batches."""

    def run(batches):
        for batch in _batches(batches, "text"):
            c = chunks(batch.column("text"))
            _, at, n = np.unique(c.hashes, return_index=True, return_counts=True)
            often = n > 1
            yield pa.record_batch([pa.array(c.texts(at[often]), pa.string()), pa.array(n[often], pa.int64())], ["chunk", "n"])

    each = docs.select(text_or_empty().alias("text")).mapInArrow(tidy(run), "chunk string, n long")
    return each.groupBy("chunk").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Those of ``counts`` (chunk, n) with the greatest n, ``most`` at most; chunks of n of the same sixteenth of a power of two go together."""
    counts = counts.withColumn("step", F.floor(F.log2("n") * 16))
    steps = {r["step"]: r["k"] for r in counts.groupBy("step").agg(F.count("*").alias("k")).collect()}  # 16 for each power of two
    total, least = 0, None
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > most:
            break
        least = step
    return counts.filter(F.col("step") >= least).select("chunk") if least is not None else counts.filter("false").select("chunk")


class Known(NamedTuple):
    """Ids of known chunks, in the order of their hashes."""

    hashes: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    flat: np.ndarray


def known_chunks(chosen: DataFrame, lattices, kind: str) -> Known:
    """Pieces of the chunks in ``chosen`` (chunk), which must be few enough for a broadcast."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at in range(0, len(words), 4000):
                some = words[at : at + 4000]
                columns, place = lattices.value.rows(some)
                order = np.argsort(place)
                yield pa.record_batch([_one_list(pa.array([some[k] for k in order], pa.string())), *columns], ["chunk", *SCHEMAS[kind]])

    rows = chosen.repartition(partitions(chosen.sparkSession)).mapInArrow(tidy(run), ", ".join(["chunk array<string>", *[f"{k} {v}" for k, v in SCHEMAS[kind].items()]]))
    rows = rows.select(F.explode(F.arrays_zip("chunk", _folded(kind).alias("ids"))).alias("x")).select("x.*").toArrow()
    # as in a text: marks are spaces there
    words = pc.replace_substring(rows.column("chunk").combine_chunks(), MARK, " ") if rows.num_rows else pa.array([], pa.string())
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    data, at = tk.bytes_of(words)
    hashes = tk.span_hashes(data, at[:-1], _VALUES)
    ids = rows.column("ids").combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.list_(pa.int32()))
    order = np.argsort(hashes)
    first = ids.offsets.to_numpy().astype(np.int64)
    length = np.diff(first)[order]
    begin = np.cumsum(length) - length
    # as arrays: as Python's integers, the ids of 400,000 chunks would fill the driver
    flat = ids.values.to_numpy()[np.arange(int(length.sum())) + np.repeat(first[:-1][order] - begin, length)].astype(np.int32)
    return Known(hashes[order], begin, length, flat)


def encode(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with piece_ids (array<int>) after its columns."""
    docs = docs.drop("piece_ids")
    return _encoded(docs, docs.columns, pieces, frequent)


def _encoded(docs: DataFrame, columns: list[str], pieces: Pieces, frequent: int) -> DataFrame:
    """Some columns of ``docs``, with piece_ids."""
    kind = pieces.kind
    context = docs.sparkSession.sparkContext
    lattices = context.broadcast(_lattices(pieces))
    known = context.broadcast(known_chunks(most_frequent(staged(repeated(docs)), frequent), lattices, kind))
    driver_gives_back(docs.sparkSession)

    def run(batches):
        table = known.value
        for batch in _batches(batches, "_text"):
            c = chunks(batch.column("_text"))
            distinct, at, back = np.unique(c.hashes, return_index=True, return_inverse=True)
            place = np.searchsorted(table.hashes, distinct)
            old = place < len(table.hashes)
            old[old] = table.hashes[place[old]] == distinct[old]
            lists, spot = lattices.value.rows(c.texts(at[~old]))
            hole = np.full(len(distinct), -1, np.int64)
            hole[~old] = spot
            begin, length = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            begin[old], length[old] = table.begin[place[old]], table.length[place[old]]
            runs, ids = _runs(c.of_doc, hole[back], begin[back], length[back], table.flat)
            n = batch.num_rows
            rows = pa.StructArray.from_arrays([batch.column("_row"), _lists(runs[0], pa.StructArray.from_arrays([_lists(runs[1], ids), runs[2]], ["ids", "hole"]))], ["row", "runs"])
            yield pa.record_batch([_lists(np.array([0, n]), rows), *lists], ["docs", *SCHEMAS[kind]])

    row = F.struct(*[docs[f"`{c}`"] for c in columns])
    kept = docs.select(row.alias("_row"), text_or_empty().alias("_text"))
    shape = kept.schema["_row"].dataType.simpleString()
    fields = [f"docs array<struct<row: {shape}, runs: array<struct<ids: array<int>, hole: int>>>>", *[f"{k} {v}" for k, v in SCHEMAS[kind].items()]]
    coded = kept.mapInArrow(tidy(run), ", ".join(fields))

    def filled(found: Column) -> Column:
        part = lambda r: F.when(r["hole"] < 0, r["ids"]).otherwise(F.concat(r["ids"], F.get(found, r["hole"])))
        return F.transform("docs", lambda d: F.struct(d["row"].alias("row"), F.flatten(F.transform(d["runs"], part)).alias("piece_ids")))

    out = coded.select(F.explode(_let(_folded(kind), filled)).alias("x"))
    return out.select(*[F.col(f"x.row.`{c}`").alias(c) for c in columns], "x.piece_ids")


def _runs(of_doc: np.ndarray, hole: np.ndarray, begin: np.ndarray, length: np.ndarray, flat: np.ndarray):
    """Known ids of texts in runs, each up to a chunk that isn't known (its place in ``hole``) or to a text's end (-1).

    Returns (first run of each text, first id of each run, holes), ids.
    """
    upto = np.concatenate([[0], np.cumsum(length)])
    ids = flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], length)]
    at = np.flatnonzero(hole >= 0)
    # in order of place; a text ends before the next one's first chunk
    order = np.argsort(np.concatenate([2 * at + 1, 2 * of_doc[1:]]), kind="stable")
    ends = np.concatenate([upto[at], upto[of_doc[1:]]])[order]
    holes = np.concatenate([hole[at], np.full(len(of_doc) - 1, -1)])[order]
    first = np.concatenate([[0], np.flatnonzero(order >= len(at)) + 1])
    return (first, np.concatenate([[0], ends]), pa.array(holes, pa.int32())), pa.array(ids, pa.int32())


def decode(rows: DataFrame, key: str, pieces: Pieces) -> DataFrame:
    """(key, raw binary): the UTF-8 of the piece ids in column ``ids``, U+2581 not yet turned to spaces.

    ``key`` must be distinct; rows dealt by it are not shuffled again.
    """
    each = rows.select(key, F.posexplode("ids").alias("p", "id"))
    each = each.join(F.broadcast(pieces.table.select("id", "piece")), "id", "left")
    part = F.when(F.col("piece").isNotNull(), F.hex(F.encode("piece", "UTF-8"))).otherwise(F.lpad(F.hex(F.col("id") - pieces.byte0), 2, "0"))
    text = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", part.alias("x")))).alias("parts"))
    return text.select(key, F.unhex(F.array_join(F.transform("parts", lambda s: s["x"]), "")).alias("raw"))


def decoded_text(raw: Column) -> Column:
    """Text of decoded UTF-8: marks to spaces, without the one put first."""
    text = F.translate(F.decode(raw, "UTF-8"), MARK, " ")
    return F.when(text.startswith(" "), F.substring(text, F.lit(2), F.char_length(text))).otherwise(text)


class Decoder:
    """Texts of piece ids."""

    def __init__(self, rows: list[tuple[str, int, float]], byte0: int):
        raw = {r[1]: r[0].replace(MARK, " ").encode() for r in rows} | {byte0 + b: bytes([b]) for b in range(256)}
        each = [raw.get(k, b"") for k in range(max(raw) + 1)]
        self.length = np.array([len(x) for x in each], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def texts(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of rows of ids, and where each row's begins (and the end), without the space put first."""
        length = self.length[ids]
        upto = np.concatenate([[0], np.cumsum(length)])
        out = self.flat[np.arange(upto[-1]) + np.repeat(self.at[ids] - upto[:-1], length)]
        at = upto[cuts]
        first = at[:-1][at[:-1] < at[1:]]
        keep = np.ones(len(out), bool)
        keep[first[out[first] == 0x20]] = False
        return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def with_round_trip(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, piece_ids, round_trip: whether the ids decode to the row's own text (by xxhash64)."""
    rows = [tuple(r) for r in pieces.table.select("piece", "id", "score").collect()]
    decoder = docs.sparkSession.sparkContext.broadcast(Decoder(rows, pieces.byte0))

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            lists = batch.column("piece_ids")
            cuts, begin = lists.offsets.to_numpy().astype(np.int64), 0
            while begin < len(lists):
                end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + BATCH_IDS, "right")) - 1)
                part = batch.slice(begin, end - begin)
                raw, at = decoder.value.texts(lists.values.to_numpy()[cuts[begin] : cuts[end]], cuts[begin : end + 1] - cuts[begin])
                raw = memoryview(raw)
                digests = [xxh64_intdigest(raw[a:b], 42) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                good = pa.array(np.array(digests, np.uint64).view(np.int64) == part.column("_th").to_numpy())
                yield pa.record_batch([part.column("doc_id"), part.column("piece_ids"), good], ["doc_id", "piece_ids", "round_trip"])
                begin = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("_th"))
    return _encoded(keyed, ["doc_id", "_th"], pieces, frequent).mapInArrow(tidy(run), f"doc_id {kind}, piece_ids array<int>, round_trip boolean")


def encoded_documents(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, piece_ids, round_trip: whether the ids decode to the row's own text."""
    rows = with_round_trip(docs, pieces)
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")


def document_pieces(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, pieces_hash (xxhash64 of the ids in their order), round_trip, as above."""
    rows = with_round_trip(docs, pieces, frequent)
    digest = F.xxhash64("piece_ids").cast("string")
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), digest.alias("pieces_hash"), "round_trip")
