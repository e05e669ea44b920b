"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. Each token covers a span of its UTF-8;
the spans follow each other without gaps. Sections (or fields) are spans, too,
and tokens are joined to them by interval: both lists are ordered, so the join is
a binary search of section ends among token starts. Offsets are code points.

A token that crosses a boundary is allocated by ``rule``:

* ``first``: to the section of its first byte,
* ``most``: to the section with most of its bytes (ties: the earlier one),
* ``split``: to each section in proportion to its bytes.

Sections of a document are its lines, each with the line feed that ends it; a
line of more than ``most_points`` code points is cut after every so many.
``field_tokens`` joins columns by ``between`` into one text and counts per
column; the text between belongs to the field before. A null or empty text has
one section without tokens; a null field counts as empty. Equal rows are
separate documents. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.llm import textkernel as tk

RULES = ("first", "most", "split")
BATCH_BYTES = 2 << 20


class SpanEncoder:
    """Token counts of spans of texts, by a tiktoken ranks file and a split pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.length[k] = len(token)

    def token_ends(self, text: str) -> np.ndarray:
        return np.cumsum(self.length[self.encoding.encode_ordinary(text)])


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (float for ``split``), and tokens of each that reach over its end."""
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    # sections are half-open: a start at a section's end belongs to a later one
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    crossing = np.bincount(first[last > first], minlength=n)[:n]
    if rule == "first":
        return np.bincount(first, minlength=n)[:n], crossing
    out = np.bincount(first[last == first], minlength=n)[:n].astype(float)
    begins = np.concatenate([[0], section_ends[:-1]])
    for a, b, x, y in zip(starts[last > first], token_ends[last > first], first[last > first], last[last > first]):
        parts = np.minimum(section_ends[x : y + 1], b) - np.maximum(begins[x : y + 1], a)
        if rule == "most":
            out[x + int(parts.argmax())] += 1
        else:
            out[x : y + 1] += parts / (b - a)
    return out, crossing


def section_ends(raw: np.ndarray, most_points: int) -> np.ndarray:
    """Byte offsets at which the sections of a text end."""
    begins = np.flatnonzero((raw & 0xC0) != 0x80)  # of code points
    lines = np.flatnonzero(raw[begins] == 0x0A) + 1
    if not len(lines) or lines[-1] != len(begins):
        lines = np.append(lines, len(begins))
    starts = np.concatenate([[0], lines[:-1]])
    cuts = [np.arange(a + most_points, b, most_points) for a, b in zip(starts, lines) if b - a > most_points]
    return np.append(begins, len(raw))[np.sort(np.concatenate([lines, *cuts]))]


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "most", most_points: int = 512) -> DataFrame:
    """One row per section of each document: doc_id, section, begin, end, n_tokens (double), n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        encoder = SpanEncoder(path, pattern)
        for batch in batches:
            for a, b in tk.slices(batch.column(1), BATCH_BYTES):
                part = batch.slice(a, b - a)
                raw, at = tk.bytes_of(part.column(1))
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                held: list[list] = [[] for _ in range(5)]
                for k, text in enumerate(part.column(1).to_pylist()):
                    own = raw[at[k] : at[k + 1]]
                    ends = section_ends(own, most_points)
                    n, crossing = attribute(encoder.token_ends(text or ""), ends, rule)
                    to = points[at[k] + ends] - points[at[k]]
                    for x, v in zip(held, (np.arange(len(ends)), np.concatenate([[0], to[:-1]]), to, n.astype(float), crossing)):
                        x.append(v)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), [len(x) for x in held[0]])))
                columns = [pa.array(np.concatenate(x)) for x in held]
                yield pa.record_batch([ids, *columns], ["doc_id", "section", "begin", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, section long, begin long, end long, n_tokens double, n_crossing long")


def field_tokens(rows: DataFrame, key: str, fields: Sequence[str], path: str, pattern: str, rule: str = "most", between: str = "\n") -> DataFrame:
    """One row per row and field: key, field, n_tokens (double)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not fields:
        raise ValueError("no fields")

    def run(batches):
        encoder = SpanEncoder(path, pattern)
        for batch in batches:
            counts = []
            for values in zip(*(batch.column(k + 1).to_pylist() for k in range(len(fields)))):
                parts = [(v or "") + (between if k + 1 < len(fields) else "") for k, v in enumerate(values)]
                ends = np.cumsum([len(p.encode()) for p in parts])
                counts.append(attribute(encoder.token_ends("".join(parts)), ends, rule)[0].astype(float))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), len(fields))))
            flat = np.concatenate(counts) if counts else np.zeros(0)
            yield pa.record_batch([keys, pa.array(list(fields) * len(batch), pa.string()), pa.array(flat)], ["key", "field", "n_tokens"])

    some = rows.select(F.col(key).alias("key"), *[F.col(f).cast("string").alias(f"_f{k}") for k, f in enumerate(fields)])
    kind = dict(some.dtypes)["key"]
    return some.mapInArrow(run, f"key {kind}, field string, n_tokens double").withColumnRenamed("key", key)
