"""Token-ID output: documents as coded id files, and back.

``encode_documents`` writes a Parquet table of chunks in ascending doc_id order
(``shard`` by range, ``chunk`` within it). A chunk holds whole documents: their
ids and counts, and the token ids coded by ``range_coder`` in independent,
checksummed blocks. Spark's writer commits the files, so a lost executor leaves
no half-written shard, and any store that Spark can write to will do.
``decode_documents`` reads such a table.

Texts are encoded by the tokenizers library, which gets each distinct
blank-separated word that a worker does not remember once: the tokenizer drops
white space and never joins across it. What a worker remembers is bounded and
decides speed alone. Each text ends with ``end_id``; null counts as empty. Ids
must be below 2**16.

Null doc_ids come first. Rows that share a doc_id follow each other in the order
of a hash of their text.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.llm import range_coder
from weftnet.llm import textkernel as tk
from weftnet.llm.base import NULL_ID, partitions, shared_dir, text_or_empty

BATCH_BYTES = 2 << 20
CHUNK_IDS = 8 << 20
MOST_WORDS = 1_500_000  # kept encoded in a worker
PER_CALL = 1000  # words


class WordEncoder:
    """Token ids of texts; remembers a bounded number of words.

    New words are encoded many a call. Words of letters, and words of letters and
    then a mark or more, are one and two runs for the tokenizer; where its tokens
    tell the ends of runs, such words need only blanks between them. Between others
    stands ``BETWEEN``, where that is a word of one id and no part of another word.
    """

    BETWEEN = "|"
    MARKS = ",.;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        between = self._ids([self.BETWEEN])[0]
        self.cut = between[0] if len(between) == 1 else None
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        ends = [k for x, k in self.tokenizer.get_vocab().items() if suffix and x.endswith(suffix)]
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[k for k in ends if k < 1 << 16]] = True
        # in the order of their hashes: hash, first id's place and number of ids in ``flat``, batches that had the word
        self.hash, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.uses = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.flat = np.zeros(0, np.uint16)

    def _ids(self, words: list[str]) -> list[list[int]]:
        # offsets aren't needed, and cost more than the ids
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(words, add_special_tokens=False)]

    def _runs(self, word: str) -> int:
        """1 or 2 if the word is surely so many runs; 0: not known."""
        if word.isalpha():
            return 1
        return 2 if word.rstrip(self.MARKS).isalpha() else 0

    def encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        out: list = [None] * len(words)
        kinds: list[list[int]] = [[], [], []]
        for k, x in enumerate(words):
            kinds[self._runs(x)].append(k)
        if not self.ends.any():
            kinds = [[k for kind in kinds for k in kind], [], []]
        for runs in (1, 2):
            for at in range(0, len(kinds[runs]), PER_CALL):
                some = kinds[runs][at : at + PER_CALL]
                ids = np.array(self._ids([" ".join([words[k] for k in some])])[0], np.int64)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                # each word has as many runs at least, so by their sum it has just as many
                if len(cuts) == runs * len(some):
                    cuts, ids = [0, *cuts[runs - 1 :: runs].tolist()], ids.tolist()
                    for k, x, y in zip(some, cuts, cuts[1:]):
                        out[k] = ids[x:y]
                else:
                    kinds[0] += some
        # "|" would be taken for a cut; special tokens are found inside of words and have "|", too
        many = [k for k in kinds[0] if self.BETWEEN not in words[k]] if self.cut is not None else []
        for at in range(0, len(many), PER_CALL):
            some = many[at : at + PER_CALL]
            ids = np.array(self._ids([f" {self.BETWEEN} ".join([words[k] for k in some])])[0], np.int64)
            cuts = np.flatnonzero(ids == self.cut).tolist()
            if len(cuts) == len(some) - 1:
                ids = ids.tolist()
                for k, x, y in zip(some, [-1, *cuts], [*cuts, len(ids)]):
                    out[k] = ids[x + 1 : y]
        alone = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(alone, self._ids([words[k] for k in alone])):
            out[k] = x
        return out

    def _forget(self) -> None:
        """Keep the words that the most batches had, at most half the limit."""
        half = MOST_WORDS // 2
        least = 2
        while (self.uses >= least).sum() > half:
            least += 1
        keep = np.flatnonzero(self.uses >= least)
        length = self.length[keep]
        self.flat = self.flat[_ranges(self.begin[keep], length)]
        self.hash, self.length, self.uses = self.hash[keep], length, self.uses[keep] // 2
        self.begin = np.cumsum(length, dtype=np.int64) - length

    def _learn(self, w: tk.Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of distinct words, in the order of their hashes, given by hash and one place each."""
        if len(self.hash) > MOST_WORDS:
            self._forget()
        place = np.searchsorted(self.hash, hashes)
        old = place < len(self.hash)
        old[old] = self.hash[place[old]] == hashes[old]
        self.uses[place[old]] += self.uses[place[old]] < 255
        new = np.flatnonzero(~old)
        if len(new):
            raw = w.data.tobytes()
            coded = self.encoded([raw[a:b].decode() for a, b in zip(w.starts[at[new]].tolist(), w.ends[at[new]].tolist())])
            length = np.fromiter(map(len, coded), np.int32, len(coded))
            ids = np.fromiter(chain.from_iterable(coded), np.int64, int(length.sum()))
            if ids.max(initial=0) >= 1 << 16:
                raise ValueError("ids of 2**16 and more")
            to = place[new]
            self.hash = np.insert(self.hash, to, hashes[new])
            self.begin = np.insert(self.begin, to, len(self.flat) + np.cumsum(length, dtype=np.int64) - length)
            self.length, self.uses = np.insert(self.length, to, length), np.insert(self.uses, to, np.uint8(1))
            self.flat = np.concatenate([self.flat, ids.astype(np.uint16)])
            place += np.cumsum(~old) - ~old
        return place

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each, and how many each has."""
        w = tk.words(texts)
        distinct, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        number = self._learn(w, distinct, at)[back] if len(distinct) else np.zeros(0, np.int64)
        length = self.length[number]
        counts = np.diff(np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[w.of_doc]) + 1
        out = np.full(counts.sum(), end_id, np.uint16)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        out[inner] = self.flat[_ranges(self.begin[number], length)]
        return out, counts


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of ranges, one after the other."""
    upto = np.cumsum(length, dtype=np.int64)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - length), length)


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file; a worker that lives on keeps its words from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


CHUNKS = "shard int, chunk int, n_docs long, n_ids long, doc_ids binary, counts binary, coded binary"


def encode_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block: int = range_coder.BLOCK) -> None:
    """Write the id files of ``docs`` to ``path``; ``tokenizer`` is a tokenizers JSON file on every machine."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("_did"), F.xxhash64(text_or_empty()).alias("_th"), F.col("text"))
    rows = rows.repartitionByRange(partitions(spark), "_did", "_th").sortWithinPartitions("_did", "_th").select("_did", "text")

    def run(batches):
        shard, coder, part = TaskContext.get().partitionId(), word_encoder(tokenizer), 0
        docs_, counts_, ids_, held = [], [], [], 0

        def flush():
            ids, counts, docs = np.concatenate(ids_), np.concatenate(counts_), np.concatenate(docs_)
            row = [shard, part, len(docs), len(ids), zlib.compress(np.diff(docs, prepend=0).tobytes()), zlib.compress(counts.astype("<u4").tobytes()), range_coder.encode(ids, block)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = ["shard", "chunk", "n_docs", "n_ids", "doc_ids", "counts", "coded"]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for begin, end in tk.slices(batch.column(1), BATCH_BYTES):
                ids, counts = coder.encode(batch.column(1).slice(begin, end - begin), end_id)
                docs_.append(numbers[begin:end]), counts_.append(counts), ids_.append(ids)
                held += len(ids)
                if held >= CHUNK_IDS:
                    yield flush()
                    docs_, counts_, ids_, held, part = [], [], [], 0, part + 1
        if docs_:
            yield flush()

    rows.mapInArrow(run, CHUNKS).write.parquet(path)


def _chunks(batches) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n_docs"]
            docs = np.cumsum(np.frombuffer(zlib.decompress(row["doc_ids"]), np.int64, n))
            counts = np.frombuffer(zlib.decompress(row["counts"]), "<u4", n).astype(np.int64)
            yield row["shard"], row["chunk"], docs, counts, range_coder.decode(row["coded"])


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks, and the number of ids before each: (shard, chunk, before). One row a chunk is ordered in one task."""
    table = spark.read.parquet(path)
    earlier = Window.partitionBy(F.lit(0)).orderBy("shard", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    return table, table.select("shard", "chunk", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))


def decode_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of the id files."""

    def run(batches):
        for shard, chunk, docs, counts, ids in _chunks(batches):
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            n = len(docs)
            yield pa.record_batch([pa.array([shard] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array(docs), pa.array(ends - counts), lists], ["shard", "chunk", "doc_id", "at", "ids"])

    table, before = _read(spark, path)
    rows = table.mapInArrow(run, "shard int, chunk int, doc_id long, at long, ids array<int>").join(before, ["shard", "chunk"])
    return rows.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), (F.col("at") + F.col("before")).alias("start"), "ids")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the id files, without sending the ids anywhere."""

    def run(batches):
        for shard, chunk, docs, counts, ids in _chunks(batches):
            raw, ends, n = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts), len(docs)
            crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
            columns = [pa.array([shard] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array(docs), pa.array(ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
            yield pa.record_batch(columns, ["shard", "chunk", "doc_id", "at", "n_tokens", "ids_crc32"])

    table, before = _read(spark, path)
    rows = table.mapInArrow(run, "shard int, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long").join(before, ["shard", "chunk"])
    return rows.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def temporary_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
