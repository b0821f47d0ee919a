"""The operators against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tallyforge.llm import bpe, catalog, language, lines, packing, simhash, substrings, topk, toxicity, vectors, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, part int, dedup_id bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in rows], DOCS)


def sample_texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "élan", "x", "<|endoftext|>", "3.14", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 5, 30, 200]))) for _ in range(60)]
    rows = list(enumerate(texts + texts[:20] + [None, "", "   ", "\n\n", "A line of its own\nanother\nA line of its own ", "ab" * 4000]))
    return [*rows, rows[3], (5, "other text of the same id"), (None, texts[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, sample_texts()).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def test_bpe_is_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.WORD_VOCABULARY)
    expected = []
    for i, t in sample_texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    got = [tuple(r) for r in bpe.encoded(docs, catalog.WORD_VOCABULARY).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_merges_take_the_leftmost_lowest_rank():
    vocab = {c: i for i, c in enumerate("abc")} | {"ab": 3, "bc": 4, "abc": 5, "aa": 6}
    table = bpe.Merges(vocab, [("b", "c"), ("a", "b"), ("a", "a"), ("a", "bc")])
    for n in range(1, 40):
        rng = random.Random(n)
        ids = np.array([rng.randrange(3) for _ in range(n)])
        own = ids.tolist()
        rules = {(1, 2): (0, 4), (0, 1): (1, 3), (0, 0): (2, 6), (0, 4): (3, 5)}
        while pairs := [(rules[p][0], k) for k, p in enumerate(zip(own, own[1:])) if p in rules]:
            _, k = min(pairs)
            own[k : k + 2] = [rules[tuple(own[k : k + 2])][1]]
        merged, length = bpe.merge_words(ids, np.array([n]), table)
        assert merged.tolist() == own and length.tolist() == [len(own)]


def brute_substrings(rows, size):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, 1 << 63), (1 << 63) - 1 if d is None else d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < ((1 << 63) - 1 if d is None else d):
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [4, 10, 50])
def test_substrings(docs, size):
    got = [tuple(r) for r in substrings.digests(docs, size).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_substrings(sample_texts(), size)))


def test_substrings_tells_words_apart_that_differ_in_few_bytes(spark):
    """Words of 1,024 bytes made of two letters by the parity of their place, and with all letters swapped."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"{same} {one} {same}"), (2, f"{same} {other} {same}"), (3, f"{same} {other} {same}")]
    got = {r.doc_id: r.n_removed for r in substrings.digests(documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 61}


@pytest.mark.parametrize("limits", [(1 << 10, 1 << 12), (1 << 8, 1 << 9)])
def test_substrings_in_many_small_classes(docs, monkeypatch, limits):
    monkeypatch.setattr(substrings, "CLASS_BYTES", limits[0])
    monkeypatch.setattr(substrings, "PART_BYTES", limits[1])
    got = [tuple(r) for r in substrings.digests(docs, 10).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_substrings(sample_texts(), 10)))


def test_callers_columns_keep_their_values(spark):
    text = " ".join(f"word{k}" for k in range(60))
    names = ["dedup_id", "dedup_keys", "sub_key", "sub_id", "sub_starts", "_gone", "row_key"]
    rows = [(d, t, *(f"{n}{d}" for n in names)) for d, t in ((1, text), (2, text), (3, "other " * 20))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    for run in (lines.deduplicated, substrings.deduplicated, simhash.deduplicated):
        out = run(docs)
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_lines(docs):
    rows = sample_texts()
    key = lambda x: x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    last = (1 << 63) - 1
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(last if d is None else d)
    expected = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or min(holders[key(x)]) == (last if d is None else d)]
        expected.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in lines.digests(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert lines.deduplicated(docs).columns == docs.columns


@pytest.mark.parametrize("per_class", [1 << 20, 16])
def test_simhash(docs, monkeypatch, per_class):
    monkeypatch.setattr(simhash, "PER_CLASS", per_class)
    rows = [tuple(r) for r in simhash.linked(docs).collect()]
    texts = sample_texts()
    prints = [simhash.fingerprint(t) for _, t in texts]
    ids = [(1 << 63) if d is None else d for d, _ in texts]
    low = ids
    for _ in texts:
        low = [min(low[j] for j in range(len(texts)) if bin(prints[i] ^ prints[j]).count("1") <= 3) for i in range(len(texts))]
    expected = [(d, f"{f:016x}", c) for (d, _), f, c in zip(texts, prints, low)]
    assert sorted(map(str, rows)) == sorted(map(str, expected))


def test_fingerprint_follows_its_definition():
    import xxhash

    for text in ("", "One", "one TWO", "the quick brown fox jumps over the lazy dog the quick brown fox"):
        words = text.lower().split()
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        assert simhash.fingerprint(text) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_ball_hashing_links_all_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [int(b) for b in base] + [0]
    for b in base:
        for n in (1, 2, 3, 4):
            prints.append(int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    prints = np.unique(np.array(prints, np.uint64))
    for classes in (1, 8, 64):
        ball = simhash.Ball(classes)
        parent = {int(p): int(p) for p in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for own in range(classes):
            where, odd = ball.hash(prints), (np.bitwise_count(prints) & 1).astype(int)
            mine = np.array([p for p, w, o in zip(prints, where, odd) if own ^ w in ball.reach[o]], np.uint64)
            for a, b in zip(*simhash.class_links(mine, own, ball)) if len(mine) else ():
                assert bin(int(a) ^ int(b)).count("1") <= 3
                parent[root(int(a))] = root(int(b))
        for a in prints:
            for b in prints[np.bitwise_count(prints ^ a) <= 3]:
                assert root(int(a)) == root(int(b))


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.BYTE_VOCABULARY)
    rows = packing.packed_documents(docs, catalog.BYTE_VOCABULARY).collect()
    expected = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in sample_texts())
    assert sum(r.length for r in rows) == sum(expected)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= 1024 and len(own) <= packing.SEGMENTS


def test_pieces_carry_their_ids_crc(docs):
    import zlib
    from collections import Counter

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.BYTE_VOCABULARY)
    ids = {(d, n): i for d, t in sample_texts() for i in [[*library.encode(t or "", add_special_tokens=False).ids, 0]] for n in [len(i)]}
    copies = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in sample_texts())
    rows = packing.packed_documents(docs, catalog.BYTE_VOCABULARY).collect()
    covered = Counter()
    for r in rows:
        own = ids[r.doc_id, r.doc_tokens][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == r.length
        covered.update({(r.doc_id, r.doc_tokens, k): 1 for k in range(r.start, r.start + r.length)})
    assert covered == Counter({(*key, k): n for key, n in copies.items() for k in range(key[1])})


def test_instructions_keep_all_three_limits(spark):
    rng = random.Random(12)
    limits = (300, 4, 120)
    rows = [(c, t, ("user", "assistant", "system")[t % 3], "word " * rng.randrange(0, 60)) for c in range(300) for t in range(rng.randrange(1, 5))] + [(1000, 0, "assistant", "long " * 20_000), (None, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    sizes = {r.example_id: (r.n_tokens, r.n_loss) for r in packing.instruction_sizes(turns, catalog.BYTE_VOCABULARY).collect()}
    assert sizes[None] == (1, 0) and sizes[1000][1] == sizes[1000][0] > 20_000
    got = packing.packed_examples(packing.instruction_sizes(turns, catalog.BYTE_VOCABULARY), limits).collect()
    assert sorted((str(r.example_id), r.n_tokens, r.n_loss) for r in got) == sorted((str(k), *v) for k, v in sizes.items())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    full = [0, 0, 0]
    for own in by.values():
        own.sort(key=lambda r: (r.offset, r.n_tokens))
        assert [r.offset for r in own] == np.cumsum([0, *(r.n_tokens for r in own)])[:-1].tolist()
        used = (sum(r.n_tokens for r in own), len(own), sum(r.n_loss for r in own))
        assert len(own) == 1 or all(u <= m for u, m in zip(used, limits))
        full = [f + (u > 0.9 * m) for f, u, m in zip(full, used, limits)]
    assert min(full) > 0  # each limit binds somewhere


def test_fill_keeps_all_limits():
    rng = np.random.default_rng(1)
    need = np.column_stack([n := rng.integers(1, 900, 300), rng.integers(0, n + 1)])
    groups = packing.fill(need, np.array([1024, 5, 600]), cut=False) if (need[:, 1] <= 600).all() else packing.fill(np.minimum(need, [900, 600]), np.array([1024, 5, 600]), cut=False)
    assert sorted(i for g in groups for i, _, _ in g) == list(range(300))
    need = np.minimum(need, [900, 600])
    for g in groups:
        at = [i for i, _, _ in g]
        assert need[at, 0].sum() <= 1024 and need[at, 1].sum() <= 600 and len(g) <= 5


VECTORS = "vec_id bigint, embedding array<float>, label int, filter int"


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [(i, base[i % 60] + (0.25 * rng.standard_normal(16) if i >= 60 else 0), i % 3) for i in range(240)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [], 1), (505, [None] * 16, 1), (506, [1.0, 2.0], 1)]
    rows += [(300 + k, rows[0][1], 0) for k in range(5)]
    got = {r.vec_id: r for r in vectors.linked(spark.createDataFrame([(*r, 1) for r in rows + odd], VECTORS)).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (y[:, None] == y)
    np.fill_diagonal(near, False)
    found = np.array([got[r[0]].n_links for r in rows])
    assert found.sum() >= 0.98 * near.sum() and (found <= near.sum(1)).all()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _, _ in odd)


@pytest.mark.parametrize("size", [4, 8, 16, 32, 64, 768])
@pytest.mark.parametrize("number", [100, 5000, 1_000_000])
def test_filters_meet_at_every_size(size, number):
    rng = np.random.default_rng(6)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 400, size)))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    filters = vectors.Filters(size, *vectors.design(size, number, 0.93))
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(filters.passed(x), filters.passed(y))]
    assert np.mean(met) >= 0.97


def test_vectors_components_threshold_and_crowded_filters(spark, monkeypatch):
    """Chains, a pair exactly at the threshold and one below, repeated ids, and groups split in blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, [3.0, 4.0, 0.0, 0.0] if i == 0 else [1.0, 0.0, 0.0, 0.0], 7) for i in range(2)]
    chain = [[float(np.cos(0.3 * k)), float(np.sin(0.3 * k)), 0.0, 0.0] for k in range(8)]
    rows += [(10 + k, v, 8) for k, v in enumerate(chain)]
    crowd = rng.standard_normal(4) + 0.05 * rng.standard_normal((120, 4))
    rows += [(100 + k, [float(np.float32(x)) for x in v], 9) for k, v in enumerate(crowd)]
    rows += [(10, chain[0], 8), (100, rows[10][1], 9)]
    got = vectors.linked(spark.createDataFrame([(*r, 1) for r in rows], VECTORS)).collect()
    x = np.array([np.array(r[1], np.float32).astype(float) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (y[:, None] == y)
    np.fill_diagonal(near, False)
    root = np.array([r[0] for r in rows])
    for _ in rows:
        root = np.minimum(root, [root[n].min(initial=1 << 30) for n in near])
    expected = sorted((r[0], int(near[i].sum()), int(root[i]), bool(r[0] == root[i])) for i, r in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == expected
    at = [([1.0, 0.0], [0.93, float(np.sqrt(1 - 0.93**2))]), ([1.0, 0.0], [0.92, 0.4])]
    for a, b in at:
        cosine = np.dot(np.float64(np.float32(a)), np.float64(np.float32(b))) / np.linalg.norm(np.float64(np.float32(a))) / np.linalg.norm(np.float64(np.float32(b)))
        pair = vectors.linked(spark.createDataFrame([(1, a, 1, 1), (2, b, 1, 1)], VECTORS)).collect()
        assert {r.n_links for r in pair} == {int(cosine >= 0.93)}


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], 0, 1) for i in range(350)] + [(700, None, 1, 1), (800, [float("inf")], 1, 1), (900, [1.0, None], 1, 1)]
    from pyspark.sql import functions as F

    got = [tuple(r) for r in topk.searched(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).collect()]
    expected = []
    for q, v, *_ in rows[:350:100]:
        scores = sorted(((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w)), i) for i, w, *_ in rows[:350] if i != q))
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    assert sorted(got) == sorted(expected)


def test_topk_asks_rows_that_share_an_id(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    plain = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)], 0, 1) for i in rng.integers(0, 6, 70) * 50]
    rows = [*plain, *plain[:9], *plain[:9], (100, [0.0] * 4, 0, 1), (100, [0.0] * 4, 0, 1), (100, [9.0] * 4, 0, 1), (None, [1.0] * 4, 0, 1)]
    got = [tuple(r) for r in topk.searched(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 100 == 0, k=12).collect()]
    expected = []
    for n, (q, v, *_) in enumerate(rows[:-1]):
        if q % 100 == 0:
            scores = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w)), i) for m, (i, w, *_) in enumerate(rows[:-1]) if m != n)
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:12])]
    assert sorted(got) == sorted(expected)
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", [r[:2] for r in rows])
    assert sorted(con.execute(topk.sql(k=12)).fetchall()) == sorted(expected)
    two = spark.createDataFrame([(100, [1.0], 0, 1), (100, [2.0], 0, 1)], VECTORS)
    assert sorted(tuple(r) for r in topk.searched(two, F.col("vec_id") % 100 == 0).collect()) == [(100, 1, 100, 2 << 20), (100, 1, 100, 2 << 20)]


def test_language_learns(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(80)]
    rows += [(900, None, "en"), (901, "123 456", "de"), (902, "", None), (903, "ẍ" * 50_000, "en")]
    got = language.identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    for r in got:
        assert 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (900, 901, 902) else r.lang_pred if r.doc_id == 903 else "en" if r.doc_id % 2 else "de")


def test_language_follows_the_shortest_code(spark):
    """The query against code lengths added up byte by byte with the same model."""
    rng = random.Random(11)
    speak = {"a": ["ba", "na", "ra"], "b": ["bi", "ni", "ri", "ba"], "c": ["öl", "ül", "na"]}
    rows = [(i, " ".join("".join(rng.choices(speak[g], k=2)) for _ in range(rng.choice([1, 4, 30]))), g) for i, g in ((i, "abc"[i % 3]) for i in range(150))]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, lang string, score double")
    model = language.fitted(docs)
    for r in language.identified(docs).collect():
        data = b"\0" * model.order + rows[r.doc_id][1].encode()
        bits = np.zeros(3)
        for k in range(model.order, len(data)):
            context = 0
            for j in range(model.order, 0, -1):
                context = context * model.size + model.symbol[data[k - j]]
            bits += model.bits[model.contexts[-1][context], model.symbol[data[k]]]
        assert abs(bits[model.langs.index(r.lang_pred)] - bits.min()) < 1e-3


def test_code_lengths_are_a_distribution():
    grams, n = np.unique(np.array([b[0] << 16 | b[1] << 8 | b[2] for b in zip(b"abracadabra", b"bracadabra!", b"racadabra!?")]), return_counts=True)
    model = language.Model({"x": (grams, n.astype(float))}, 2)
    p = np.exp2(-model.bits[:, :, 0].astype(float))
    assert np.allclose(p[:, :-1].sum(1) + model.unmet * p[:, -1], 1, atol=1e-4)


def test_toxicity_learns(spark):
    rows = [(i, ("nice calm words here " * 3) + ("vile scum " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "vile")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(7, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert all(got[i].predicted == y for i, _, y in rows) and 0 <= got[900].score < 0.3
    none = toxicity.scored(docs, labels.filter("doc_id < 0")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)


def brute_toxicity(docs, labels):
    """Scores by plain sums over all examples."""
    import math
    import zlib

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    tally = [toxicity.terms_of(t) for _, t in docs]
    examples = [(d, y, c) for (d, _), c in zip(docs, tally) for k, y in labels if k == d and not held(d)]
    n = [sum(y == k for _, y, _ in examples) for k in (0, 1)]
    weight = {}
    for t in {t for _, _, c in examples for t in c}:
        a, b = (sum(t in c for _, y, c in examples if y == k) for k in (1, 0))
        idf = math.log((1 + len(docs)) / (1 + sum(t in c for c in tally))) + 1
        ratio = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        weight[t] = idf * (toxicity.FLOOR + max(0, ratio - toxicity.Z * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))))

    def vector(c):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    known = [(d, y, vector(c)) for d, y, c in examples]

    def vote(c, but=None):
        q = vector(c)
        near = sorted((-sum(x * v.get(t, 0) for t, x in q.items()), d, y) for d, y, v in known if d != but)[: toxicity.NEIGHBOURS]
        near = [(-s, d, y) for s, d, y in near if s < 0]
        return (sum(s * y for s, _, y in near) / sum(s for s, _, _ in near), near[0][1]) if near else (None, None)

    learned = sorted((vote(c, d)[0], y) for d, y, c in examples)
    votes, shares = toxicity.isotonic(np.array([v for v, _ in learned]), np.array([y for _, y in learned], float), np.ones(len(learned)))
    out = {}
    for (d, _), c in zip(docs, tally):
        v, near = vote(c)
        out[d] = (sum(y for _, y, _ in examples) / len(examples) if v is None else float(np.interp(v, votes, shares)), near, held(d))
    return out


def test_toxicity_is_the_sum_over_all_examples(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("mor", "la", "tri", "ben", "goludi") for b in ("na", "ti", "sovar", "kel")]
    rows = []
    for i in range(160):
        y = int(rng.random() < 0.3)
        own = [rng.choice(words) for _ in range(rng.choice([3, 10, 40]))] + (["rotten", f"vilest{rng.choice('abc')}"] if y and rng.random() < 0.8 else [])
        rows.append((i, " ".join(rng.sample(own, len(own))), y))
    docs = [(i, t) for i, t, _ in rows] + [(900, None), (901, "?"), (902, "unseen wordings"), (903, "rotten " * 20_000), (None, "vilesta")]
    labels = [(i, y) for i, _, y in rows if i % 5]
    expected = brute_toxicity(docs, labels)
    source = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, score string")
    got = toxicity.scored(source, spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    for r in got:
        score, near, held = expected[r.doc_id]
        assert abs(r.score - score) < 1e-6 and r.held_out == held and r.predicted == int(r.score >= 0.3)
        assert (r.nearest_example is None) == (near is None) and (near is None or r.evidence)


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(0, 20, 300) / 20)
    y, w = (rng.random(300) < x).astype(float), rng.random(300) + 0.1
    at, share = toxicity.isotonic(x, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all()
    assert share.min() >= 0 and share.max() <= 1


PAGES = "page_id bigint, url string, html string, payload string, date int"


def test_warc(spark):
    html = """<html><head><title>T &amp; U</title></head><body><p title="a > b">One</p><!-- x --><script a='>'>no</script><p>Two&#8212;&#x27;&eacute;&nosuch;&#0; &amp;lt;&#38;gt;</body>"""
    rows = [(1, "http://a/", html, "p", 1), (1, "http://a/", html, "p", 1), (2, None, None, None, None), (None, "u", "", "", 3)]
    got = warc.derivatives(warc.responses(spark.createDataFrame(rows, PAGES))).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 6
    one = next(r for r in got if r.page_id == 1 and r.record_type == "conversion")
    assert one.block == "T & U\nOne\nTwo—'é&nosuch;&#0; &lt;&gt;" and one.block_digest == "sha256:" + hashlib.sha256(one.block.encode()).hexdigest()
    assert {r.block for r in got if r.page_id == 2 and r.record_type == "conversion"} == {""}
    assert warc.derivatives(warc.responses(spark.createDataFrame([], PAGES))).count() == 0


def test_warc_sql_agrees_on_odd_pages(spark):
    import duckdb
    import pandas as pd

    odd = ["", None, "<p", "<!--", "a<!-- b", "<script>x", "<a href='>'>t</a>", '<a b="c', "&", "&&amp;", "&#x1F600;&#55296;&#1114112;", "<style>.</style >z", "x < y > z", "<p>1<br/>2<pre> 3\n 4</pre>", "&nbsp;a&NBSP;", "<a " + " ".join(f'x{k}="p>q"' for k in range(60)) + ">t</a>", "<p " + "'>'" * 500 + ">v"]
    pages = pd.DataFrame({"page_id": range(len(odd)), "url": "u", "html": odd})
    spark_rows = warc.derivatives(warc.responses(spark.createDataFrame([(i, "u", h, "", 1) for i, h in enumerate(odd)], PAGES))).collect()
    con = duckdb.connect()
    con.register("pages", pages)
    found = con.execute(warc.sql())
    names = [c[0] for c in found.description]
    assert sorted(str(sorted(r.asDict().items())) for r in spark_rows) == sorted(str(sorted(zip(names, r))) for r in found.fetchall())


def test_warc_time_grows_with_length_alone(spark):
    import time

    long = ["<script>" * 400_000, "<script" * 400_000, '<a b="' * 400_001, "<!--" * 700_000, "<" * 3_000_000, "&#" * 1_000_000, "</script " * 300_000, "word <b>and</b> " * 200_000, "<a " + 'x=">" ' * 400_000 + ">t"]
    start = time.time()
    rows = warc.derivatives(warc.responses(spark.createDataFrame([(i, "u", h, "", 1) for i, h in enumerate(long)], PAGES))).collect()
    assert len(rows) == 2 * len(long) and time.time() - start < 60


def test_warc_files_round_trip(spark, tmp_path):
    """Response records are read from plain and gzip files; what is written parses back, hostile URIs and dates as well."""
    import gzip

    html = "<p>Grüße &amp; more</p>"
    http = f"HTTP/1.1 200 OK\r\nServer: x\r\nContent-Length: {len(html.encode())}".encode()

    def record(kind, name, uri, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-02-02T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [record("warcinfo", "<urn:i>", "", b"x: y\r\n"), record("response", "<urn:1>", "http://a/", http + b"\r\n\r\n" + html.encode()), record("response", "<urn:2>", "http://b/", b"HTTP/1.1 204 No Content")]
    (tmp_path / "a.warc").write_bytes(b"".join(records) + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    read = warc.read_responses(spark, str(tmp_path))
    assert sorted(r.record_id for r in read.collect()) == ["<urn:1>", "<urn:1>", "<urn:2>", "<urn:2>"]
    hostile = spark.createDataFrame([(None, "<urn:9>", "http://c/\r\nWARC-Type: response\r\n\r\nx y", "1\r\n2", "H: 1\r\n", "t")], read.schema)
    made = warc.derivatives(read.dropDuplicates(["record_id"]).union(hostile))
    expected = {r.record_id: r for r in made.collect()}
    content = "".join(r.value for r in warc.as_warc(made, "2024-01-01T00:00:00Z").collect()).encode()
    parsed = list(warc.records_of(content))
    assert len(parsed) == 6
    for headers, block in parsed:
        r = expected[headers["warc-record-id"]]
        assert (headers["warc-type"], headers["warc-refers-to"], block.decode()) == (r.record_type, r.refers_to, r.block)
        assert headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert headers["warc-date"] == ("2020-02-02T00:00:00Z" if r.refers_to != "<urn:9>" else "1%0D%0A2")
    facts = next(b for h, b in parsed if h["warc-refers-to"] == "<urn:1>" and h["warc-type"] == "metadata").decode()
    assert f"source-headers: HTTP/1.1 200 OK; Server: x; Content-Length: {len(html.encode())}\r\n" in facts


def test_empty_tables(spark, empty):
    vec = spark.createDataFrame([], VECTORS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    from pyspark.sql import functions as F

    for df in (substrings.digests(empty), substrings.deduplicated(empty), lines.digests(empty), lines.deduplicated(empty), simhash.linked(empty), bpe.encoded(empty, catalog.WORD_VOCABULARY), packing.packed_documents(empty, catalog.BYTE_VOCABULARY), language.identified(empty), toxicity.scored(empty, labels), vectors.linked(vec), topk.searched(vec, F.lit(True))):
        assert df.count() == 0
