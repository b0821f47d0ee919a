"""The stages of the pipeline, each on what the one before kept, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyforge.llm import catalog
from tallyforge.llm.common import written

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, extra int"
WORD = re.compile("[^\x20\x09-\x0d]+")
SPACE = " \t\n\v\f\r"
LAST = 1 << 63


def sample():
    rng = random.Random(11)
    en = "the cat dog house with river and tree sun over moon light walks slowly home again never".split()
    de = "der hund katze haus mit fluss und baum sonne über mond licht geht langsam heim wieder nie".split()
    make = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    rows = [(i, make(en if i % 2 else de, rng.choice([3, 40, 120])), "en" if i % 2 else "de") for i in range(80)]
    passage, line = make(en, 70), "A License Line of its own"
    rows += [(100 + i, f"{make(en, 60)} {passage} {make(en, 50)}", "en") for i in range(6)]
    rows += [(120 + i, f"{make(de, 50)}\n{line}{' ' * i}\n{make(de, 40)}", "de") for i in range(5)]
    whole = make(en, 900)
    rows += [(140 + i, whole.replace(" cat ", f" cat{i} ", 1) if i else whole, "en") for i in range(4)]
    other = make(de, 300)
    rows += [(150 + i, other.replace(" ", " " * (i + 1), 1), "de") for i in range(3)]
    rows += [(160, None, "en"), (161, "", "en"), (162, "12 34 --", "de"), (163, line, None), (164, "A license line of its own", None)]
    rows += [rows[3], rows[3], (None, rows[5][1], None), (None, make(en, 30), "en"), (5, make(de, 60), "de"), (170, "x" * 30_000, "en")]
    return [(i, t, lang, "s", len(t or ""), "k", 1) for i, t, lang in rows]


def order(d):
    return LAST if d is None else d


def lines_kept(rows):
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for d, t in rows:
        for x in t.split("\n"):
            first[key(x)] = min(first.get(key(x), LAST), order(d))
    return [(d, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == order(d))) for d, t in rows]


def shingles_of(text, shingle=5):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def one_of_each(rows):
    sets = [shingles_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(order(rows[i][0]) for i in range(len(rows)) if group[i] == g) for g in set(group)}
    return [r for r, g in zip(rows, group) if order(r[0]) == least[g]]


def passages_kept(rows, size=50):
    first = {}
    words = [WORD.findall(t) for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, LAST), order(d))
    out = []
    for (d, t), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < order(d):
                gone |= set(range(i, i + size))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    return out


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage gives, as written."""
    docs = spark.createDataFrame(sample(), SHAPE).repartition(5)
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, "unused"))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns_of_documents(kept):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].columns == corpus_pipeline.COLUMNS
        assert all(r.n_chars == len(r.text) for r in kept[name].collect())


def test_language_rejects_only_texts_without_letters(kept):
    expected = [r[:2] for r in sample() if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter(texts(kept["language"])) == Counter(expected)


def test_language_keeps_texts_where_none_is_told(spark):
    rows = [(i, t, None, "s", len(t or ""), "k", 1) for i, t, *_ in sample()]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SHAPE), "unused")
    assert got.columns == corpus_pipeline.COLUMNS
    assert Counter(texts(got)) == Counter((i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t))


def test_lines(kept):
    got = texts(kept["lines"])
    assert Counter(got) == Counter(lines_kept(texts(kept["language"])))
    assert sum("icense" in t for _, t in got) == 1


def test_near_copies(kept):
    got = texts(kept["near copies"])
    assert Counter(got) == Counter(one_of_each(texts(kept["lines"])))
    ids = [d for d, _ in got]
    assert [d for d in ids if 150 <= (d or 0) < 153] == [150] and ids.count(5) == 2


def test_passages(kept):
    before = texts(kept["near copies"])
    got = texts(kept["passages"])
    assert Counter(got) == Counter(passages_kept(before)) and Counter(got) != Counter(before)


def test_packing_holds_each_id_once(kept):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.BYTE_VOCABULARY)
    wanted = Counter()
    for d, t in texts(kept["passages"]):
        wanted[d] += len(library.encode(t, add_special_tokens=False).ids) + 1
    rows = kept["packing"].collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == wanted
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts(kept["passages"])}
    several = {d for d, n in Counter(d for d, _ in texts(kept["passages"])).items() if n > 1}
    for r in rows:
        if r.doc_id not in several:
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def test_run_is_the_chain(spark, kept, tmp_path):
    kept["documents"].write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = lambda rows: Counter({d: sum(r.length for r in rows if r.doc_id == d) for d in {r.doc_id for r in rows}})
    assert total(rows) == total(kept["packing"].collect())


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SHAPE)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "unused"))
    assert docs.count() == 0
