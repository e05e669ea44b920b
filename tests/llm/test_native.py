"""Exact dedup, line dedup, SimHash and mixing against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftnet.llm import exact_dedup, line_dedup, mixing, simhash


def low(i):
    return -(2**63) if i is None else i


def test_exact_dedup(docs, rows):
    got = exact_dedup.exact_dedup(docs, tracked=64, max_heavy=8).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    for r in got:
        own = groups[r.text_sha256]
        assert r.group_size == len(own) and low(r.keep_id) == max(map(low, own))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.kept_documents(docs).count() == len(groups)


def test_exact_dedup_resolves_a_hot_group_on_the_map_side(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    digests = many.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("doc_id").alias("rid"))
    assert [r.n for r in exact_dedup.heavy_digests(digests, 64, 8).collect()] == [1000]
    got = exact_dedup.exact_dedup(many, 64, 8)
    assert got.filter("kept").count() == 2001 and got.filter("group_size = 1000 and keep_id = 2997").count() == 1000


def line_brute(rows, w):
    seen, out = set(), {}
    for i, t in sorted({(low(i), t) for i, t, *_ in rows if t is not None}):
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(line_dedup.BLANKS)]
        keys, gone = [lines[k].strip(line_dedup.BLANKS) for k in at], set()
        for s in range(len(keys) - w + 1):
            run = tuple(keys[s : s + w])
            gone.update(at[s : s + w]) if run in seen else seen.add(run)
        out[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("w", [2, 3])
def test_line_dedup(docs, rows, w):
    want = line_brute(rows, w)
    back = docs.withColumn("was", F.col("text"))
    for r in line_dedup.line_dedup(back, w).collect():
        if r.was is None:
            assert r.text is None and r.n_lines == 0
        else:
            assert (r.text, r.n_removed) == want[low(r.doc_id), r.was]


def test_line_dedup_inside_one_document(spark):
    one = spark.createDataFrame([(1, "a\nb\nc\n\nx\na\nb\nc\ny")], "doc_id long, text string")
    assert line_dedup.line_dedup(one).first().text == "a\nb\nc\n\nx\ny"
    with pytest.raises(ValueError):
        line_dedup.line_dedup(one, 1)


def test_long_single_lines(spark):
    import corpus_pipeline

    note = "all rights reserved by the owner of this text"
    rows = [(1, f"a\n{note}\nb"), (2, f"c\n {note}\t\nshort line\nd"), (3, f"short line\n{note}\ne\n{note}\nf"), (4, f"p\nq\nr\n{note}"), (5, "p\nq\nr\ns")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(frame, long_words=8).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("c\nshort line\nd", 1), 3: ("short line\ne\nf", 2), 4: ("p\nq\nr", 1), 5: ("s", 3)}
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, "").collect()}
    assert kept == {i: t for i, (t, _) in got.items()}


def test_simhash_contract(docs, rows):
    got = {}
    for r in simhash.document_fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = sorted({(low(i), t or "") for i, t, *_ in rows})
    assert sum(map(len, got.values())) == len(rows)
    prints = {}
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        for r in got[None if i == low(None) else i]:
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert prints[""] == prints[" \n\t "] == "0" * 32


def test_hamming_matches_find_all(spark):
    import random

    rng = random.Random(1)
    base = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(30)]
    more = [(a ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)), b ^ (1 << rng.randrange(63))) for a, b in base]
    frame = spark.createDataFrame(sorted(set(base + more)), "f0 long, f1 long")
    got = {((r.q0, r.q1), (r.f0, r.f1)) for r in simhash.hamming_matches(frame, frame, 3).collect()}
    points = sorted(set(base + more))
    gap = lambda x, y: (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()
    assert got == {(x, y) for x in points for y in points if gap(x, y) <= 3}


@pytest.mark.parametrize("radius", [12, 20, 23])
def test_hamming_matches_find_all_in_wide_radii(spark, radius):
    import random

    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(12)]
    points = set(base)
    for x in base:
        for n in (1, radius - 1, radius, radius + 1):
            # spread over all blocks, and in a run
            points.add(x ^ sum(1 << k for k in rng.sample(range(128), n)))
            points.add(x ^ (((1 << n) - 1) << rng.randrange(128 - n)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    words = {x: (signed(x >> 64), signed(x & (1 << 64) - 1)) for x in points}
    frame = spark.createDataFrame(list(words.values()), "f0 long, f1 long")
    got = [((r.q0, r.q1), (r.f0, r.f1)) for r in simhash.hamming_matches(frame, frame, radius).collect()]
    want = {(words[x], words[y]) for x in points for y in points if (x ^ y).bit_count() <= radius}
    assert len(got) == len(want) and set(got) == want


def test_near_counts_of_dense_groups(spark, monkeypatch):
    """All counts and least ids are those of brute force, but a query makes a row for each part of a group, not for each match."""
    import random

    rng = random.Random(8)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(128), n))
    centre = rng.getrandbits(128)
    dense = {centre, *[flip(centre, min(40, int(rng.expovariate(0.09)))) for _ in range(600)]}
    points = sorted(dense | {rng.getrandbits(128) for _ in range(200)} | {flip(centre, k) for k in range(41, 60)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = {x: (signed(x & (1 << 64) - 1), signed(x >> 64)) for x in points}
    rows = [(*words[x], k % 3 + 1, None if k % 7 == 0 else k) for k, x in enumerate(points)]
    index = spark.createDataFrame(rows, "f0 long, f1 long, copies long, least long")
    asked = index.filter("copies = 2").select("f0", "f1")
    monkeypatch.setattr(simhash, "PART", 150)
    matches, pairs = simhash.hamming_matches, []
    monkeypatch.setattr(simhash, "hamming_matches", lambda *a: pairs.append(matches(*a)) or pairs[-1])
    for reach in (8, 32):
        monkeypatch.setattr(simhash, "REACH", reach)
        got = {(r.f0, r.f1): (r.copies, r.least) for r in simhash.near_counts(asked, index, 20).collect()}
        want = {}
        for k, x in enumerate(points):
            if k % 3 == 1:
                near = [j for j, y in enumerate(points) if (x ^ y).bit_count() <= 20]
                want[words[x]] = sum(j % 3 + 1 for j in near), min((j for j in near if j % 7), default=None)
        assert got == want
    assert pairs[-1].count() < 300 < sum(1 for k, x in enumerate(points) if k % 3 == 1 for y in points if (x ^ y).bit_count() <= 20)


def test_edited_copies_are_near(spark):
    import random

    rng = random.Random(4)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(6)]
    rows = [(20 * k + 20, " ".join(t)) for k, t in enumerate(texts)]
    for k, t in enumerate(texts):
        edited = list(t)
        edited[50] = "other"
        rows.append((k + 1, " ".join(edited)))
    got = {r.doc_id: r for r in simhash.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gap = lambda a, b: (int(got[a].fingerprint, 16) ^ int(got[b].fingerprint, 16)).bit_count()
    for i, r in got.items():
        near = [j for j in got if gap(i, j) <= simhash.RADIUS]
        assert (r.near_count, r.near_id) == ((len(near) - 1, min(near)) if i % 20 == 0 else (None, None))
    assert all(got[20 * k + 20].near_id == k + 1 for k in range(6))


def test_mixing(docs, rows):
    got = mixing.mix(docs)
    again = sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert sorted(map(str, got.collect())) == again
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:  # reshare by weight until none is above three times its size
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3 * sizes[s] for s in capped}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    taken = Counter()
    for r in got.collect():
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    out = mixing.mixed_documents(docs)
    words = Counter()
    for r in out.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == taken and out.columns == docs.columns


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert simhash.document_fingerprints(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_columns_of_clashing_names(docs, rows):
    """Columns named like the operators' own change nothing and keep their values."""
    import corpus_pipeline

    extra = ["size", "taken", "n_lines", "n_removed", "_s", "_th", "_did", "id", "row", "a.b"]
    many = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in extra])
    own = lambda r: all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for c in extra)
    plain = lambda frame: Counter((r.doc_id, r.text, r.source) for r in frame.collect())
    stages = [corpus_pipeline.lines, corpus_pipeline.mix, lambda _, d, __: exact_dedup.kept_documents(d)]
    for stage in stages:
        got = stage(None, many, "")
        assert got.columns == many.columns and all(map(own, got.collect()))
    for stage in stages[:2]:
        assert plain(stage(None, many, "")) == plain(stage(None, docs, ""))
    got = line_dedup.line_dedup(many)
    assert got.columns == [c for c in many.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert {(low(r.doc_id), r.text, r.n_removed) for r in got.collect()} == {(low(r.doc_id), r.text, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}


def test_null_and_empty_texts_are_copies(spark):
    frame = spark.createDataFrame([(1, None), (1, ""), (2, "x"), (2, "x"), (3, "x")], "doc_id long, text string")
    got = exact_dedup.kept_documents(frame).collect()
    assert len(got) == 2 and sorted((r.doc_id, r.text or "") for r in got) == [(1, ""), (3, "x")]
