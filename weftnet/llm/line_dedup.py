"""Line dedup: winnowing over line hashes (native).

A document's lines are its text split at line feeds; a line's key is the line
without spaces, tabs and returns at its ends; lines with an empty key are kept
and not counted. A window is ``min_run`` consecutive counted lines of one
document. A line goes if a window that covers it repeats a window (the same
keys in the same order) that starts earlier: at a smaller doc_id, or earlier in
the same document. What remains keeps its order, joined by line feeds. With ``long_words``, a single
line of at least as many words that repeats an earlier line goes as well; the
first occurrence of a line always stays.

Winnowing picks in every window the rightmost line of smallest hash, so equal
windows pick the same line, and each repeated run of ``min_run`` lines shares a
fingerprint. Fingerprints that occur once leave at the first, pre-aggregated
shuffle. For the rest each position is extended both ways over the lines around
it: every window through the position that picked it is compared with its first
occurrence, never with all others, and the matched windows are merged to runs.

Null text: no lines, stays null. Empty tables give empty results. Equal rows
are one document (see base.py); of rows that share a doc_id with different
texts, a window counts as earlier by its position alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftnet.llm.base import NULL_ID, columns_of, row_of, with_row_key

BLANKS = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _picked(hashes: Column, start: Column, width: int) -> Column:
    """Position of the rightmost smallest of hashes[start .. start + width)."""
    pick, least = start, F.get(hashes, start)
    for k in range(1, width):
        h = F.get(hashes, start + F.lit(k))
        pick, least = F.when(h <= least, start + F.lit(k)).otherwise(pick), F.least(h, least)
    return pick


def fingerprints(docs: DataFrame, min_run: int) -> DataFrame:
    """Winnowed positions: (_did, _th, pos, fp, off, around).

    around: hashes of the lines within min_run - 1 of pos, pos being at ``off``.
    """
    w = min_run
    lines = F.filter(F.split("_text", "\n"), lambda x: _key(x) != "")
    rows = with_row_key(docs).select("_did", "_th", F.transform(lines, lambda x: F.xxhash64(_key(x))).alias("h"))
    starts = F.sequence(F.lit(0), F.size("h") - w)
    picks = F.array_distinct(F.transform(starts, lambda s: _picked(F.col("h"), s, w)))
    each = rows.filter(F.size("h") >= w).select("_did", "_th", "h", F.explode(picks).alias("pos"))
    off = F.least(F.col("pos"), F.lit(w - 1))
    return each.select(
        "_did", "_th", "pos", F.get("h", F.col("pos")).alias("fp"), off.alias("off"),
        F.slice("h", F.col("pos") - off + 1, off + w).alias("around"),
    )


def repeated_windows(docs: DataFrame, min_run: int) -> DataFrame:
    """(_did, _th, start): windows that repeat an earlier one."""
    w = min_run
    fps = fingerprints(docs, w)
    where = F.struct("_did", "pos")
    often = fps.groupBy("fp").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).filter("lo != hi")
    near = fps.join(often.select("fp"), "fp", "left_semi")
    through = F.filter(F.sequence(F.lit(0), F.size("around") - w), lambda s: _picked(F.col("around"), s, w) == F.col("off"))
    windows = near.select("_did", "_th", "pos", "off", "around", F.explode(through).alias("s")).select(
        "_did",
        "_th",
        (F.col("pos") - F.col("off") + F.col("s")).alias("start"),
        F.xxhash64(F.slice("around", F.col("s") + 1, w)).alias("k1"),
        F.xxhash64(F.reverse(F.slice("around", F.col("s") + 1, w))).alias("k2"),
    )
    first = windows.groupBy("k1", "k2").agg(F.min(F.struct("_did", "start")).alias("first"))
    return windows.join(first, ["k1", "k2"]).filter(F.struct("_did", "start") > F.col("first")).select("_did", "_th", "start")


def repeated_lines(docs: DataFrame, long_words: int) -> DataFrame:
    """(_did, _th, start): counted lines of ``long_words`` words or more that repeat an earlier one."""
    keys = F.transform(F.filter(F.split("_text", "\n"), lambda x: _key(x) != ""), _key)
    words = lambda k: F.size(F.filter(F.split(k, f"[ {BLANKS}]+"), lambda w: w != ""))
    each = with_row_key(docs).select("_did", "_th", F.posexplode(F.transform(keys, lambda k: F.struct(words(k).alias("n"), F.xxhash64(k).alias("k1"), F.xxhash64(F.reverse(k)).alias("k2")))))
    each = each.filter(F.col("col.n") >= long_words).select("_did", "_th", F.col("pos").alias("start"), "col.k1", "col.k2")
    where = F.struct("_did", "start")
    often = each.groupBy("k1", "k2").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first != last")
    return each.join(often, ["k1", "k2"]).filter(where > F.col("first")).select("_did", "_th", "start")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(text: Column, starts: Column, min_run: int) -> Column:
    """struct(text, n_lines, n_removed) without the runs that begin at ``starts`` of the counted lines."""
    runs = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.lit(min_run - 1)))))

    def of(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        counted = F.filter(numbers, lambda i: _key(F.get(lines, i)) != "")
        gone = _let(counted, lambda at: F.transform(runs, lambda p: F.get(at, p)))
        kept = F.array_join(F.transform(F.array_except(numbers, gone), lambda i: F.get(lines, i)), "\n")
        return F.struct(
            F.when(starts.isNull(), text).otherwise(kept).alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size(runs), F.lit(0)).cast("long").alias("n_removed"),
        )

    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return F.when(text.isNull(), none).otherwise(_let(F.split(text, "\n"), of))


def _lines_cut(docs: DataFrame, min_run: int, long_words: int | None) -> DataFrame:
    """(row, cut): each row of ``docs``, and struct(text, n_lines, n_removed)."""
    if min_run < 2:
        raise ValueError("min_run must be 2 at least")
    gone = repeated_windows(docs, min_run)
    if long_words is not None:
        runs = gone.select("_did", "_th", F.explode(F.sequence("start", F.col("start") + min_run - 1)).alias("start"))
        gone, min_run = runs.unionByName(repeated_lines(docs, long_words)), 1
    gone = gone.groupBy("_did", "_th").agg(F.collect_set("start").alias("starts"))
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(F.coalesce(docs["doc_id"], F.lit(NULL_ID)).cast("long").alias("_did"), F.xxhash64(text).alias("_th"), row_of(docs).alias("row"))
    return keyed.join(gone, ["_did", "_th"], "left").select("row", _cut(F.col("row.text"), F.col("starts"), min_run).alias("cut"))


def line_dedup(docs: DataFrame, min_run: int = 3, long_words: int | None = None) -> DataFrame:
    """``docs`` with their text cut, and n_lines, n_removed (long) after its columns, in place of its own of these names."""
    out = _lines_cut(docs, min_run, long_words)
    kept = [x for c, x in zip(docs.columns, columns_of(docs, text=F.col("cut.text"))) if c not in ("n_lines", "n_removed")]
    return out.select(*kept, "cut.n_lines", "cut.n_removed")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with their text cut, less the documents that lose all their lines; all columns keep their names and places."""
    out = _lines_cut(docs, options.get("min_run", 3), options.get("long_words"))
    emptied = (F.col("cut.n_removed") > 0) & (F.btrim("cut.text", F.lit(" \t\r\n")) == "")
    return out.filter(~emptied).select(*columns_of(docs, text=F.col("cut.text")))
