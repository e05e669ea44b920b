"""Language ID, Jaccard join, pieces, token files and counts, substring dedup against brute force."""

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftnet.llm import language_id, ngram_jaccard, range_coder, sentence_pieces, substring_dedup, textkernel, token_counts, token_files
from weftnet.llm.base import NULL_ID

public = pytest.importorskip("public_tokenizers")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def low(i):
    return NULL_ID if i is None else i


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_word_kernel(rows):
    texts = pa.array([t for _, t, *_ in rows])
    w = textkernel.words(texts)
    raw, k, known = w.data.tobytes(), 0, {}
    for (a, b), (_, t, *_) in zip(zip(w.of_doc[:-1], w.of_doc[1:]), rows):
        assert [raw[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b])] == words(t)
        for x in words(t):
            assert known.setdefault(x, w.hashes[k]) == w.hashes[k]
            k += 1
    assert len(set(known.values())) == len(known)


def shingles(t):
    w = [x.translate(LOWER) for x in words(t)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("small", [2, 8])
def test_jaccard_components(spark, small):
    import random

    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(n)] for n in (30, 90, 200, 700, 12)]
    texts = []
    for b in base:
        for k in range(12):
            t = list(b)
            for _ in range(rng.randrange(1 + len(t) // 60 + k // 4)):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(t[k % 3 :]))
    texts += [texts[0], texts[0].upper(), "", None, "one two", "one two", "a b c d e", "tail " + texts[1]]
    rows = list(enumerate(texts)) + [(None, texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_jaccard.jaccard_components(frame, small=small).collect()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.component_id, r.n_shingles) == (find(r.doc_id), len(sets[r.doc_id]))


def test_sketch_distance_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 80, 900):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 3 + 1).astype(np.uint64)]))
        gap = len(np.setxor1d(a, b))
        assert ngram_jaccard.sketch_distance(ngram_jaccard.bit_sketch(a), ngram_jaccard.bit_sketch(b)) <= gap


def removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted({(low(i), t or "") for i, t, *_ in rows}, key=lambda x: x[0]):
        w = [x.decode() for x in words(t)]
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            run = tuple(w[s : s + length])
            if run in seen:
                gone[s : s + length] = [True] * length
            seen.add(run)
        out[i, t] = (" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    return out


@pytest.mark.parametrize("length", [6, 20])
def test_substring_dedup(docs, rows, length):
    want = sorted((i, *v) for (i, t), v in removed(rows, length).items())
    got = sorted({(low(r.doc_id), r.text, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs, length, most_bits=1 << 16).collect()})
    assert got == want


def test_suffix_automaton():
    a = substring_dedup.SuffixAutomaton()
    a.add([1, 2, 3, 4])
    a.add([3, 4, 5, 1, 2])
    assert a.matches([2, 3, 4, 5, 1, 2, 9, 3]) == [1, 2, 3, 3, 4, 5, 0, 1]


def test_language_id(spark):
    import random

    rng = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "fr": ["eau", "ment", "que", "oi", "les"], "es": ["ción", "os", "que", "llo", "an"]}
    make = lambda lang: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(40))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["en", "fr", "es"] * 60)] + [(900, None, None), (901, "123 !?", "en"), (902, "", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(frame).collect()}
    truth = {i: lang for i, _, lang in rows}
    tested = [i for i in got if i < 900 and got[i].held_out]
    assert len(tested) > 30 and sum(got[i].lang_pred == truth[i] for i in tested) >= 0.98 * len(tested)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i in got)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    same = language_id.identify(frame.withColumn("lang", F.when(F.col("doc_id") % 50 != 1, F.col("lang"))))
    assert same.count() == len(rows)
    kept = language_id.accepted_documents(frame)
    assert kept.count() == 180 and kept.columns == frame.columns


def test_filters_correct_for_mistakes():
    grams = [np.arange(0, 3000, dtype=np.uint64), np.arange(10_000, 10_003, dtype=np.uint64)]
    f = language_id.Filters(["a", "b"], grams, 1 << 13)
    assert f.mistaken[0] > 0.05 > f.mistaken[1]


@pytest.fixture(scope="module")
def pieces(spark):
    return sentence_pieces.load_pieces(spark, public.path("piece_bpe_32k.model"))


def test_sentence_pieces(docs, rows, pieces):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.path)
    got = sentence_pieces.encode(docs, pieces)
    assert sorted((low(r.doc_id), list(r.piece_ids)) for r in got.collect()) == sorted((low(i), sp.encode(t or "")) for i, t, *_ in rows)
    thin = sentence_pieces.document_pieces(docs, pieces, frequent=50).collect()
    assert sorted((low(r.doc_id), r.n_pieces) for r in thin) == sorted((low(i), len(sp.encode(t or ""))) for i, t, *_ in rows)
    assert all(r.round_trip for r in thin)
    keyed = got.withColumn("key", F.monotonically_increasing_id()).withColumnRenamed("piece_ids", "ids").persist()
    back = sentence_pieces.decode(keyed, "key", pieces).select("key", sentence_pieces.decoded_text(F.col("raw")).alias("back"))
    assert keyed.join(back, "key").filter("text <> back").count() == 0
    keyed.unpersist()


def test_pieces_query_returns_ids_and_decodes_documents(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    from weftnet.llm import queries

    sp = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    texts = ["a b", "a▁b", " two  spaces ", "é́ 日本語 😀\r\nx", "", None, "x" * 90 + " y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op8_sentence_pieces(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert (list(got[i].piece_ids), got[i].n_pieces) == (sp.encode(t or ""), len(sp.encode(t or "")))
        assert got[i].round_trip == (i != 1)
    thin = sentence_pieces.document_pieces(frame, sentence_pieces.load_pieces(spark, public.path("piece_bpe_32k.model")))
    assert {r.doc_id for r in thin.collect() if not r.round_trip} == {1}


def test_viterbi_over_a_unigram_table(spark):
    table = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -4.0, "ba": -4.6, "▁ab": -5.5, "abb": -9.0}
    frame = spark.createDataFrame([(p, 300 + k, s) for k, (p, s) in enumerate(table.items())], "piece string, id int, score double")
    p = sentence_pieces.Pieces(frame, 3, 3, None, "unigram")
    texts = ["abba", "ab ab", "b", "aabbab", "zab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {piece: 300 + k for k, piece in enumerate(table)}

    def best(chunk):
        paths = [(0.0, [])] + [None] * len(chunk)
        for j in range(1, len(chunk) + 1):
            ways = [(paths[i][0] + table[chunk[i:j]], paths[i][1] + [ids[chunk[i:j]]]) for i in range(max(0, j - 3), j) if chunk[i:j] in table]
            if chunk[j - 1] not in table:
                ways.append((paths[j - 1][0] - 1e9, paths[j - 1][1] + [3 + b for b in chunk[j - 1].encode()]))
            paths[j] = max(ways, key=lambda x: x[0])
        return paths[-1]

    for r in sentence_pieces.encode(docs, p).collect():
        want = [x for c in re.findall("▁+[^▁]*", "▁" + r.text.replace(" ", "▁")) for x in best(c)[1]]
        assert list(r.piece_ids) == want


def test_range_coder_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 2047, 2049, 9000):
        for ids in (rng.integers(0, 65536, n), np.full(n, 7), rng.zipf(1.4, n) % 49408, np.tile(rng.integers(0, 500, 50), n // 50 + 1)[:n]):
            assert (range_coder.decode(range_coder.encode(ids.astype(np.uint16), 512)) == ids).all()


def test_range_coder_learns_and_checks():
    ids = np.tile(np.random.default_rng(1).integers(0, 40_000, 100), 200).astype(np.uint16)
    coded = range_coder.encode(ids)
    assert len(coded) < len(ids) * 0.4
    hurt = bytearray(coded)
    hurt[-100] ^= 1
    with pytest.raises(range_coder.BadBlock):
        range_coder.decode(bytes(hurt))


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    token_files.encode_documents(docs, str(tmp_path / "ids"), path, block=256)
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    order = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()
    for r in sorted(order, key=lambda r: (low(r.doc_id), r.th)):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((low(r.doc_id), start, ids))
        start += len(ids)
    got = sorted((low(r.doc_id), r.start, list(r.ids)) for r in token_files.decode_documents(spark, str(tmp_path / "ids")).collect())
    assert got == sorted(want)
    thin = sorted((low(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_files.document_digests(spark, str(tmp_path / "ids")).collect())
    assert thin == sorted((i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want)


def test_token_counts(docs, rows):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for rule in token_counts.RULES:
        got, want = {}, {}
        for r in token_counts.section_tokens(docs, path, public.PATTERN, rule, 20).collect():
            got.setdefault(low(r.doc_id), []).append(r)
        for i, t, *_ in rows:
            want[low(i)] = want.get(low(i), 0) + len(enc.encode_ordinary(t or ""))
        assert {i: round(sum(r.n_tokens for r in v), 6) for i, v in got.items()} == want
    spans = sorted((r.begin, r.end) for r in got[54])
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(next(t for i, t, *_ in rows if i == 54))


def test_allocation_rules():
    ends, sections = np.array([3, 8, 10]), np.array([4, 10])
    assert [token_counts.attribute(ends, sections, r)[0].tolist() for r in token_counts.RULES] == [[2, 1], [1, 2], [1.2, 1.8]]
    assert token_counts.attribute(ends, sections, "first")[1].tolist() == [1, 0]
    assert token_counts.attribute(np.zeros(0, np.int64), np.array([0]), "most")[0].tolist() == [0]


def test_field_tokens(spark):
    frame = spark.createDataFrame([(1, "a title", None), (2, "", "some body text")], "k long, title string, body string")
    got = {(r.k, r.field): r.n_tokens for r in token_counts.field_tokens(frame, "k", ["title", "body"], public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()}
    assert got[1, "body"] == 0 and got[2, "body"] == 3 and got[1, "title"] >= 2


def test_empty_tables(spark, empty, pieces, tmp_path):
    assert ngram_jaccard.jaccard_components(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert language_id.identify(empty).count() == 0
    assert sentence_pieces.encode(empty, pieces).count() == 0 and sentence_pieces.document_pieces(empty, pieces).count() == 0
    token_files.encode_documents(empty, str(tmp_path / "none"), public.path("word_bpe_49k.json"))
    assert token_files.document_digests(spark, str(tmp_path / "none")).count() == 0
    assert token_counts.section_tokens(empty, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0


def test_a_block_is_read_alone():
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.3, 3000) % 49408).astype(np.uint16)
    coded = range_coder.encode(ids, 512)
    _, _, ends, _, code = range_coder._head(coded)
    head = len(coded) - 2 * len(code)
    for k in range(6):
        hurt = bytearray(coded)
        # all other blocks' code is overwritten
        for j in range(6):
            if j != k:
                hurt[head + 2 * ends[j] : head + 2 * ends[j + 1]] = b"\xff" * int(2 * (ends[j + 1] - ends[j]))
        assert (range_coder.decode_block(bytes(hurt), k) == ids[512 * k : 512 * (k + 1)]).all()
        with pytest.raises(range_coder.BadBlock):
            range_coder.decode_block(bytes(hurt), (k + 1) % 6)
    hurt = bytearray(coded)
    hurt[20] ^= 1
    with pytest.raises(range_coder.BadBlock):
        range_coder.decode(bytes(hurt))
    with pytest.raises(range_coder.BadBlock):
        range_coder.decode_block(coded[:30], 0)
    with pytest.raises(IndexError):
        range_coder.decode_block(coded, 6)


def test_prior_covers_all_ids():
    shares = np.diff(range_coder.PRIOR.astype(np.int64))
    assert len(shares) == 1 << 16 and shares.min() >= 1 and shares.sum() == 1 << range_coder.PRIOR_BITS


def test_word_encoder_forgets_and_stays_right(monkeypatch):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    monkeypatch.setattr(token_files, "MOST_WORDS", 40)
    monkeypatch.setattr(token_files, "PER_CALL", 7)
    coder, tokenizer, rng = token_files.WordEncoder(path), Tokenizer.from_file(path), np.random.default_rng(3)
    odd = ["a|b", "|", "<|endoftext|>", "x y", " ", "it's", "İstanbul", "ΣΑΣ", "́a", "日本語", "3.14", "--|--", "ﬁ", "q̸", "end.", "Fin!?", "ß,", "ǅ.", "가", "ᄀᄀᆞᆫ", "aͅ"]
    for _ in range(12):
        texts = [" ".join([odd[rng.integers(len(odd))], *(f"w{rng.integers(60)}" for _ in range(9))]) for _ in range(4)]
        ids, counts = coder.encode(pa.array(texts), 1)
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_texts_that_share_an_id_have_links_of_their_own(spark):
    import random

    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    rows = [(7, "one short text of its own with some words", 1), (7, long, 2), (9, long + " tail", 3), (9, long + " tail", 4), (None, long, 5), (5, "", 6), (4, None, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long").repartition(3)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_jaccard.jaccard_components(frame).collect()}
    assert got == {(7, 5): 7, (7, 196): 7, (9, 197): 7, (None, 196): None, (5, 0): 5, (4, 0): 4}
    kept = ngram_jaccard.kept_documents(frame)
    assert kept.columns == frame.columns
    # the row of 7 that is like 9's stays for both, the other row of 7 for itself
    assert sorted(r.n_shingles for r in kept.collect()) == [1, 2, 5, 6, 7]
    twice = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "q", "z")], "doc_id long, text string, _twice_id string")
    assert sorted((r.doc_id, r.text) for r in ngram_jaccard.kept_documents(twice).collect()) == [(1, "a b c d e f"), (2, "q")]


def test_many_languages_short_texts_and_clashing_names(spark):
    langs = [f"l{k:03}" for k in range(130)]
    grams = [language_id.ngrams(pa.array([f"speak{k:03}word tongue{'abcdefghij'[k % 10] * 6}{chr(97 + k // 10) * 6}"]))[0] for k in range(130)]
    f = language_id.Filters(langs, [np.unique(g) for g in grams], 1 << 14, usual=5)
    found = f.predict(pa.array([f"tongue{'abcdefghij'[k % 10] * 6}{chr(97 + k // 10) * 6}" for k in range(130)]))[0]
    assert sum(a == b for a, b in zip(found, langs)) >= 120 and found[129] == langs[129]
    assert f.predict(pa.array(["A", "qqqq wwww vvvv", None, "12"]))[0] == ["l005", "l005", "und", "und"]
    rows = [(i, "the song of the old men and the sea " * 3, "en", i) for i in range(30)] + [(31, "De.", None, 31), (32, None, "en", 32), (33, "", None, 33)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    kept = language_id.accepted_documents(frame)
    assert kept.columns == frame.columns and sorted(r.score for r in kept.collect()) == [*range(30), 31]


def test_groups_are_compared_across_parts(spark):
    """Every pair of members in different components that sketches and sizes allow, whatever parts they are in, once."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(150) < p], rng.integers(0, 2**63, 10, dtype=np.uint64)])) for p in rng.choice([0.6, 0.85, 0.95], 40)]
    sketches, apart = [ngram_jaccard.bit_sketch(s) for s in sets], lambda m, n: 25 * (m + n) // 175
    roots = [k % 7 for k in range(len(sets))]
    nodes = spark.createDataFrame([(k, len(s), bytearray(x)) for k, (s, x) in enumerate(zip(sets, sketches))], "id long, n_shingles long, sketch binary")
    each = spark.createDataFrame([(1, 40, k // 9, k, roots[k]) for k in range(len(sets))], "g long, size long, part long, id long, root long")
    got = sorted((r.a, r.b) for r in ngram_jaccard._across(each, nodes, 75, 100).collect())
    want = [
        (a, b) for a in range(40) for b in range(a + 1, 40)
        if roots[a] != roots[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b]))
        and ngram_jaccard.sketch_distance(sketches[a], sketches[b]) <= apart(len(sets[a]), len(sets[b]))
    ]
    assert got == want and 0 < len(want) < 780


def test_parts_are_bounded_in_bytes():
    for n in (1, 64, 300, 5000, 20_000, 10**6):
        part = ngram_jaccard.part_of(ngram_jaccard.size_tier(n, 75, 100), 75, 100)
        assert 16 <= part <= ngram_jaccard.PART
        assert part == 16 or part * len(ngram_jaccard.bit_sketch(np.arange(n, dtype=np.uint64))) <= ngram_jaccard.PART_BYTES
