"""Near copies by the similarity of their shingle sets."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tallyforge.llm import simhash_sets as s


def jaccard(a, b):
    x, y = (set(s.shingle_set(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_limits_surround_the_expected_distance():
    sure, most = s.limits(0.8)
    assert sure < s.BITS * 0.1515 < most and s.limits(0.9)[1] < most


def test_stars_pass_over_strangers():
    value, node = np.array([7, 7, 7, 9], np.uint32), np.array([1, 2, 3, 4])
    screen = np.array([(1 << 64) - 1, 0, 1, 0], np.uint64)
    a, b, heads = s.stars(value, node, screen)
    assert list(zip(a, b)) == [(2, 3)] and sorted(node[heads]) == [1, 2, 4]


def test_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, gone = [], set()
    for d in range(0, 600, 3):
        text = [rng.choice(words) for _ in range(rng.choice([60, 200, 500]))]
        near, far = list(text), list(text)
        near[len(text) // 2] = "Other"
        for k in range(0, len(text), 6):
            far[k] = rng.choice(words)
        rows += [(d, " ".join(text), 1), (d + 1, "  ".join(near).replace("w1", "W1"), 1), (d + 2, " ".join(far), 1)]
        gone.add(d + 1)
        assert jaccard(rows[-3][1], rows[-2][1]) >= 0.8 > 0.6 > jaccard(rows[-3][1], rows[-1][1])
    rows += [(None, rows[0][1], 1), (9000, None, 2), (9001, "", 2), (9002, " \n", 2), (9003, "x" * 100_000, 2), (9004, "few words", 2), (9005, "few words", 2), (0, rows[0][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node int").repartition(6)
    kept = s.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    expected = [r[0] for r in rows if r[0] is not None and r[0] not in gone | {9001, 9002, 9005}]
    assert sorted(ids) == sorted(expected)


def test_large_group_of_near_copies_keeps_one(spark):
    base = [f"v{k}" for k in range(300)]
    rows = [(d, " ".join(base[:k] + [f"x{d}"] + base[k + 1 :])) for d in range(700) for k in [d % 300]]
    kept = s.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9))
    assert [r.doc_id for r in kept.collect()] == [0]


def family(rng, members, twins, size=900):
    """Texts of a template, alike at 0.74 to 0.8, and for the first of them copies alike at 0.85."""
    places, chosen, texts = range(10, size - 10, 10), [], []
    while len(chosen) < members:
        edits = set(rng.sample(places, 13))
        if all(len(edits & e) < 6 for e in chosen):
            chosen.append(edits)
            texts.append([f"{len(texts)}e{k}" if k in edits else f"w{k}" for k in range(size)])
    copies = [list(t) for t in texts[:twins]]
    for d, c in enumerate(copies):
        for k in rng.sample(places, 14):
            c[k + 5] = f"{d}c{k}"
    return [" ".join(t) for t in texts + copies]


def test_apart_gives_every_pair_of_different_roots():
    rng = np.random.default_rng(4)
    value, node, root = rng.integers(0, 9, 200).astype(np.uint32), np.arange(200), rng.integers(0, 5, 200)
    screen = np.where(rng.random(200) < 0.5, np.uint64(0), ~np.uint64(0)).astype(np.uint64)
    wanted = {(i, j) for i in range(200) for j in range(i + 1, 200) if value[i] == value[j] and root[i] != root[j] and screen[i] == screen[j]}
    assert {tuple(p) for p in s.apart(value, node, root, screen).tolist()} == wanted
    assert len(s.apart(*(x[:0] for x in (value, node, root, screen)))) == 0


def test_pairs_under_a_third_text_are_compared(spark, monkeypatch):
    """The stars pair 1 and 2 with 0 alone, which is like neither."""
    words = np.zeros((3, len(s.WORDS)), np.int64)
    words[1, -1], words[2, -1] = (1 << 20) - 1, (1 << 21) - 1
    rows = [(i, i, *map(int, w)) for i, w in enumerate(words)]
    nodes = spark.createDataFrame(rows, "node bigint, root bigint, " + ", ".join(f"{w} bigint" for w in s.WORDS)).coalesce(1)
    assert {tuple(r) for r in s.colliding(nodes).collect()} == {(0, 1), (0, 2)}
    for most in (s.CLASS_ROWS, 1):
        monkeypatch.setattr(s, "CLASS_ROWS", most)
        assert {tuple(r) for r in s.unlinked(nodes).collect()} == {(0, 1), (0, 2), (1, 2)}
        assert s.unlinked(nodes.withColumn("root", nodes.root * 0)).isEmpty()


def test_copies_in_a_family_of_a_template(spark):
    rows = list(enumerate(family(random.Random(3), 300, 60)))
    assert jaccard(rows[0][1], rows[300][1]) > 0.84 and jaccard(rows[0][1], rows[1][1]) < 0.8
    kept = {r.doc_id for r in s.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()}
    assert kept >= set(range(300)) and len(kept) <= 301


def test_short_texts_lose_no_copy(spark):
    """Pairs at 0.8 or just above, by number of words: words are added at the end until the next would be too many."""
    rows, gone = [], Counter()
    for n in (8, 9, 10, 12, 14, 19, 24, 34, 44, 68):
        for k in range(40):
            text = [f"t{n}x{k}w{i}" for i in range(n)]
            more = text + [f"t{n}x{k}m{i}" for i in range((n - 4) // 4)]
            pair = [" ".join(text), " ".join(more)]
            assert 0.8 <= jaccard(*pair) <= 0.86
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
            gone[n] += 1
    rows += [(10_000 + k, f"some words in common and then {k} else") for k in range(50)]
    size = {d: len(t.split()) for d, t in rows}
    kept = [r.doc_id for r in s.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()]
    assert {n for d, n in size.items() if d % 2 and d < 10_000 and d in kept} == set() and len(kept) == len(rows) - sum(gone.values())


def test_empty_table(spark):
    assert s.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
