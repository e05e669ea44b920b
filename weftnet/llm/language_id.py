"""Language ID by language-bitmask n-gram filters.

A text's n-grams are the runs of ``N`` bytes of its UTF-8 in lower case, where
each run of bytes that are no ASCII letter nor part of a longer code point is
one space, with a space before and after each text. A language's n-grams are
those that make up at least ``share`` of the n-grams of its training texts and
at least ``contrast`` of what they make up in any other language.

The filter of all languages is one table of ``slots`` words, in which bit l of
a word belongs to language l: bit-sliced Bloom filters with two hashes. The AND
of an n-gram's two words is the mask of all languages that (may) contain it.
A language's count is the popcount of its bit over the text's n-grams; a filter
filled to a fraction f answers yes by mistake with probability p = f * f, so the
count is corrected to (count - n * p) / (1 - p). The largest corrected count
decides (ties: the first language by code point); score is that count over n.

Learning takes labelled rows only, at most about ``sample`` of them (rows whose
hash of doc_id is a multiple of rows // sample), whole texts, and at most
``most`` n-grams a language, the most frequent. The table is as large for any
corpus.

A text that is null or has no letter is ``und`` with score 0. One with letters
whose corrected counts are all 0 or less gets the language with the most n-grams
in training, with score 0. Equal texts get equal results. Without labelled rows
every text is ``und``. Any number of languages will do: each 64 have a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftnet.llm import textkernel as tk
from weftnet.llm.base import driver_gives_back, tidy

N = 5
BATCH_BYTES = 1 << 20
LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts as integers, and where each text's begin (and the end)."""
    data, at = tk.bytes_of(pc.utf8_lower(texts))
    # a space on either side of each text
    shift = np.arange(len(at)) * 2
    out = np.full(len(data) + 2 * (len(at) - 1), 0x20, np.uint8)
    place = np.ones(len(out), bool)
    place[at[:-1] + shift[:-1]] = False
    place[at[1:] + shift[1:] - 1] = False
    out[place] = np.where(LETTERS[data], data, np.uint8(0x20))
    blank = out == 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    begins = at + shift
    keep[begins[:-1]] = True  # also after the space that ends the text before
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    out, begins = out[keep].astype(np.uint64), kept_before[begins]
    total = max(0, len(out) - N + 1)
    grams = np.zeros(total, np.uint64)
    for k in range(N):
        grams |= out[k : k + total] << np.uint64(8 * k)
    # those that reach over a text's end go
    of = np.repeat(begins[1:], np.diff(begins))[:total]
    inside = np.arange(total) + N <= of
    counts = np.concatenate([[0], np.cumsum(inside)])
    return grams[inside], counts[np.minimum(begins, total)]


def _slots(grams: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    h = tk.mix(grams * np.uint64(tk.GOLDEN))
    mask = np.uint64(slots - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Filters:
    """The languages' bit-sliced filters, a table for each 64; ``usual``: the language where none is found."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], slots: int, usual: int = 0):
        self.langs, self.slots, self.usual = langs, slots, usual
        self.tables, mistaken = [], []
        for first in range(0, len(langs), 64):
            some = grams[first : first + 64]
            kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(some) <= n)
            table = np.zeros(slots, kind)
            for l, g in enumerate(some):
                for at in _slots(g, slots):
                    table[at] |= kind(1 << l)
            mistaken += [(table >> kind(l) & kind(1)).mean() ** 2 for l in range(len(some))]
            self.tables.append(table)
        self.mistaken = np.array(mistaken)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, numbers of n-grams."""
        grams, begins = ngrams(texts)
        n = np.diff(begins)
        if not len(self.langs):
            return ["und"] * len(n), np.zeros(len(n)), n
        a, b = _slots(grams, self.slots)
        counts = np.zeros((len(self.langs), len(n)))
        for l in range(len(self.langs)):
            table = self.tables[l // 64]
            if l % 64 == 0:
                masks = table[a] & table[b]
            hits = np.concatenate([[0], np.cumsum(masks >> table.dtype.type(l % 64) & table.dtype.type(1), dtype=np.int64)])
            counts[l] = hits[begins[1:]] - hits[begins[:-1]]
            counts[l] = (counts[l] - n * self.mistaken[l]) / max(1 - self.mistaken[l], 1e-9)
        best = counts.argmax(0)
        top = counts[best, np.arange(len(n))]
        best[top <= 0] = self.usual
        score = np.clip(top / np.maximum(n, 1), 0, 1)
        named = [self.langs[k] if t is not None and has_letter(t) else "und" for k, t in zip(best, texts.to_pylist())]
        return named, np.where([x == "und" for x in named], 0.0, score), n


def learn(rows: DataFrame, sample: int = 20_000, most: int = 100_000, share: float = 3e-6, contrast: float = 0.2, slots: int = 1 << 22) -> Filters:
    """Filters of the languages of ``rows`` (doc_id, text, lang); rows without text or lang are left out."""
    rows = rows.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    step = max(1, rows.count() // sample)
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.column(1).filter(pc.equal(batch.column(0), lang))
                for begin, end in tk.slices(own, BATCH_BYTES):
                    grams, n = np.unique(ngrams(own.slice(begin, end - begin))[0], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    each = rows.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = each.groupBy("lang").agg(F.sum("n").alias("total"))
    each = each.join(F.broadcast(total), "lang").withColumn("part", F.col("n") / F.col("total"))  # a row a language
    top = each.groupBy("gram").agg(F.max("part").alias("top"))
    own = each.filter(f"n >= 3 and part >= {share}").join(top, "gram").filter(f"part >= {contrast} * top")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    own = own.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("lang", "gram").toPandas()
    langs = sorted(own["lang"].unique())
    many = {r["lang"]: r["total"] for r in total.collect()}  # a row a language
    usual = max(range(len(langs)), key=lambda k: (many[langs[k]], -k), default=0)
    return Filters(langs, [own["gram"][own["lang"] == x].to_numpy().astype(np.uint64) for x in langs], slots, usual)


def _judged(docs: DataFrame, filters: Filters) -> DataFrame:
    """row (struct of the columns of ``docs``), lang_pred, score, n_grams."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    driver_gives_back(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("text").alias("t"))

    def run(batches):
        for batch in batches:
            for begin, end in tk.slices(batch.column(1), BATCH_BYTES):
                langs, score, n = shared.value.predict(batch.column(1).slice(begin, end - begin))
                columns = [batch.column(0).slice(begin, end - begin), pa.array(langs, pa.string()), pa.array(score), pa.array(n, pa.int64())]
                yield pa.record_batch(columns, ["row", "lang_pred", "score", "n_grams"])

    return rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, n_grams long")


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with lang_pred and score after its columns; columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return _judged(docs, filters).select(*[F.col("row").getField(c).alias(c) for c in own], "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score; learns from rows not held out."""
    filters = learn(docs.filter(~held_out()), **options)
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted_documents(docs: DataFrame, least: float = 0.2, **options) -> DataFrame:
    """``docs`` without those that are ``und`` or of whose n-grams less than ``least`` belong to the language found.

    A text with letters that is too short for an n-gram stays.
    """
    filters = learn(docs.filter(~held_out()), **options)
    fits = (F.col("lang_pred") != "und") & ((F.col("score") >= least) | (F.col("n_grams") == 0))
    return _judged(docs, filters).filter(fits).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
