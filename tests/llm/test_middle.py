"""Fill-in-the-middle against a plain cut of each text, and on texts that are null, marked, long or not UTF-8."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tallyforge.llm import middle

SCHEMA = "doc_id bigint, text string, n string, form string, h1 int, id string, output string"
UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plainly(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(pre), len(mid), out


def texts():
    rng = random.Random(5)
    some = ["".join(rng.choice(["a", "é", "字", "𝄞", "\n", "\n", "<", "S>", " ", "\r", "\x0b", " "]) for _ in range(rng.choice([1, 5, 40, 700]))) for _ in range(150)]
    long = ["line é\n" * 30_000, "x" * 300_000, "\n" * 70_000, "字" * 100_000 + "\n" + "y"]
    odd = [None, "", "\n", "\n\n", "a", "a\n", "has <P> in it\nb\n", "<M>", "ends with <", "S>starts\n", "<P\n>"]
    return [(i, t) for i, t in enumerate([t for t in some if not re.search("<[PSM]>", t)] + long + odd)] + [(3, "repeated id\nb"), (3, "repeated id\nb"), (None, "no id\n\nat all"), (None, None), (-5, "x\ny\nz")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", "f", 1, "i", "o") for i, t in texts()], SCHEMA).repartition(4)


@pytest.mark.parametrize("every", [1, 3, 64])
def test_outputs_are_the_plain_cuts(docs, every, monkeypatch):
    out = middle.transformed(docs, every=every)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((i, *plainly(i, t))) for i, t in texts())


def test_texts_come_back(docs):
    out = middle.transformed(docs)
    back = [r[0] for r in out.select(middle.restored(out["output"], out["form"])).collect()]
    assert sorted(back) == sorted(t or "" for _, t in texts())


def test_rates(docs):
    got = sorted(map(repr, map(tuple, middle.transformed(docs, rate=30, spm_rate=10).collect())))
    assert got == sorted(repr((i, *plainly(i, t, 30, 10))) for i, t in texts())


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 16])
@pytest.mark.parametrize("every", [1, 2, 5, 64])
def test_checkpoints_find_every_unit(piece, every, monkeypatch):
    monkeypatch.setattr(middle, "PIECE", piece)
    for text in ("", "a", "\n", "é\n字\n\n𝄞", "a\nb\nc\n" * 9, "no end of line 字"):
        index = middle.Checkpoints(text.encode(), every=every)
        units = UNIT.findall(text)
        assert index.count == len(units)
        assert index.units == list(range(0, text.count("\n") + 1, every))
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert index.start(u) == (len(before.encode()), len(before))


def test_other_units_and_columns(spark):
    df = spark.createDataFrame([("k1", "a b  c"), (None, None)], "key string, body string")
    out = {r["key"]: r for r in middle.transformed(df, "key", "body", end=" ", every=2).collect()}
    assert out["k1"]["n"] == 4 and out[None]["n"] == 0


def test_bytes_that_are_no_text_stay(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'610AFF0A62' AS STRING) AS text")
    out = middle.transformed(df).select(middle.restored(middle.F.col("output"), middle.F.col("form")).cast("binary").alias("b")).first()
    assert bytes(out["b"]) == b"a\n\xff\nb"


def test_digests_and_empty_tables(docs):
    got = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in middle.digests(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(i, sha(plainly(i, t)[4]), sha(t or "")) for i, t in texts()}
    assert middle.digests(docs.limit(0)).collect() == []


def test_sql_agrees(docs):
    import duckdb

    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(None if i != i else int(i), t) for i, t in zip(frame["doc_id"], frame["text"])])
    assert sorted(map(repr, con.execute(middle.sql()).fetchall())) == sorted(repr(tuple(r)) for r in middle.digests(docs).collect())
