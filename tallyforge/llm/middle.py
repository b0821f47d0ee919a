"""Fill-in-the-middle: a text is cut at two units, and its parts are put in another order behind marks.

A unit is a run of bytes up to and with an end byte; with the default, a line. While the units of a text are counted,
a sparse index keeps where every 64th unit starts, in bytes and in code points. A cut is found from it: the last
checkpoint before the cut by binary search, then the few units from there.

Null and empty texts are plain, with no units. The text stays as it is, also where it isn't valid UTF-8. A null id
draws like an empty one; repeated rows draw alike and each is kept. Other columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyforge.llm.common import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: Units from one checkpoint to the next.
EVERY = 64
#: Bytes that are counted at a time.
PIECE = 1 << 16


class Checkpoints:
    """Where every so many units of a text start: unit, byte and code point, each counted from 0."""

    def __init__(self, raw: bytes, end: int = 10, every: int = EVERY):
        self.raw, self.end = raw, bytes([end])
        self.buffer = np.frombuffer(raw, np.uint8)
        self.units, self.bytes, self.points = [0], [0], [0]
        seen = points = 0
        for at in range(0, len(raw), PIECE):
            piece = self.buffer[at : at + PIECE]
            ends = np.flatnonzero(piece == end)
            first = (piece & 0xC0) != 0x80
            due = np.arange(-(seen + 1) % every, len(ends), every)
            if len(due):
                upto = np.cumsum(first)
                self.units += (seen + due + 1).tolist()
                self.bytes += (at + ends[due] + 1).tolist()
                self.points += (points + upto[ends[due]]).tolist()
            seen += len(ends)
            points += int(np.count_nonzero(first))
        self.count = seen + (len(raw) > 0 and not raw.endswith(self.end))

    def start(self, unit: int) -> tuple[int, int]:
        """The byte and the code point where a unit starts; for the number of units, where the text ends."""
        k = bisect_right(self.units, unit) - 1
        at = self.bytes[k]
        for _ in range(unit - self.units[k]):
            at = self.raw.find(self.end, at) + 1 or len(self.raw)
        return at, self.points[k] + int(np.count_nonzero((self.buffer[self.bytes[k] : at] & 0xC0) != 0x80))


def _draws(text_id, seed: int):
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(text_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def transformed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, end: str = "\n", every: int = EVERY) -> DataFrame:
    """The id, n units, the form (plain, psm, spm), prefix_chars, middle_chars and the output text of each row.

    ``rate`` of a hundred texts are cut, ``spm_rate`` of a hundred of these have the suffix first.
    """
    text = F.col("text")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), *_draws(F.col(id_column), seed))
    rows = rows.select("id", "text", "h1", "h2", form.alias("form"))
    schema = StructType([docs.schema[id_column], StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])
    return rows.mapInArrow(_cut(ord(end), every, id_column), schema)


def _cut(end: int, every: int, id_column: str):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                rows = []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for raw, h1, h2, form in zip(texts, *(part.column(c).to_pylist() for c in ("h1", "h2", "form"))):
                    index = Checkpoints(raw, end, every)
                    if form == "plain":
                        rows.append((index.count, None, None, raw))
                        continue
                    cuts = h1 % (index.count + 1), h2 % (index.count + 1)
                    (a, first), (b, second) = index.start(min(cuts)), index.start(max(cuts))
                    output = (p, raw[:a], s, raw[b:], m, raw[a:b]) if form == "psm" else (s, raw[b:], p, raw[:a], m, raw[a:b])
                    rows.append((index.count, first, second - first, b"".join(output)))
                n, before, middle, output = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), part.column("form"), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                    [id_column, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def restored(output, form):
    """The text again, from an output and its form; a cut text holds no marks, so they part it."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = transformed(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def sql() -> str:
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    join = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i < len(s) THEN s[i] || chr(10) ELSE s[i] END)[1:len(s) - (s[len(s)] = '')::INT] AS u FROM (SELECT *, string_split(text, chr(10)) AS s FROM t)),
c AS (SELECT *, len(u) AS n, {draw(0)} % (len(u) + 1) AS x, {draw(1)} % (len(u) + 1) AS y,
 CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {draw(2)} % 100 >= {RATE} THEN 'plain' WHEN {draw(3)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, {join(1, 'least(x, y)')} AS prefix, {join('least(x, y) + 1', 'greatest(x, y)')} AS middle, {join('greatest(x, y) + 1', 'n')} AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p"""
