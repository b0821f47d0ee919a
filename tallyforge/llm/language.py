"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``max_order`` bytes, with escape probabilities by method C
and exclusion of what longer contexts have seen. The statistics are frozen after training, so that a byte's
code length depends on the bytes before it alone: all of them are worked out once, as a row of code lengths
for each context that was met in training. A text's score for a language is its exact code length in bits.

Training: at most ``per_language`` whole documents of each language, those of the smallest hash of doc_id;
that bound is the classifier's documented sample. Every text is scored whole.

Null texts and texts without a letter are ``und`` with score 0. Equal code lengths go to the first language
in alphabetical order. Without any training row every text is ``und``. Repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import pieces

#: Documents of each language to learn from.
PER_LANGUAGE = 300
#: Bytes of context.
MAX_ORDER = 3
UNDETERMINED = "und"


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept out of learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(docs: DataFrame, per_language: int, order: int) -> DataFrame:
    """(lang, gram, n): how often each run of order + 1 bytes, or shorter run at a text's start, ends at some byte."""
    from pyspark.sql import Window

    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("doc_id", "lang").withColumn("place", first).filter(F.col("place") <= per_language).select("doc_id", "lang").distinct()
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = np.frombuffer(b"\0" * order + text.encode(), np.uint8).astype(np.int64)
                    if len(data) > order:
                        code = np.zeros(len(data) - order, np.int64)
                        for k in range(order + 1):
                            code = code << 8 | data[k : len(data) - order + k]
                        grams, n = np.unique(code, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    return sample.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths of all languages, by context and byte."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        self.order, self.langs = order, sorted(counts)
        if not self.langs:
            return
        every = np.unique(np.concatenate([g for g, _ in counts.values()]))
        used = np.unique(np.concatenate([every >> 8 * k & 255 for k in range(order + 1)]))
        self.size = len(used) + 1  # the last symbol stands for each byte that training never met: all are alike
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        self.unmet = max(1, 256 - len(used))
        #: Rows of code lengths; contexts[k] gives the row of a context of k symbols, or that of its longest met ending.
        self.contexts = [np.zeros(1, np.int32)]
        met = self._met(every, order)
        rows = 1
        for k in range(1, order + 1):
            longer = np.tile(self.contexts[-1], self.size)  # by the symbols after the first
            longer[met[k]] = rows + np.arange(len(met[k]))
            self.contexts.append(longer.astype(np.int32))
            rows += len(met[k])
        self.bits = np.empty((rows, self.size, len(self.langs)), np.float32)
        for i, lang in enumerate(self.langs):
            self.bits[:, :, i] = self._lengths(*counts[lang], met, rows)

    def _split(self, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The context of k symbols before the last byte of each gram, and that byte's symbol."""
        context = np.zeros(len(grams), np.int64)
        for j in range(k, 0, -1):
            context = context * self.size + self.symbol[grams >> 8 * j & 255]
        return context, self.symbol[grams & 255]

    def _met(self, grams: np.ndarray, order: int) -> list[np.ndarray]:
        return [np.unique(self._split(grams, k)[0]) for k in range(order + 1)]

    def _lengths(self, grams: np.ndarray, n: np.ndarray, met: list[np.ndarray], rows: int) -> np.ndarray:
        p = np.empty((rows, self.size))
        below = np.full((1, self.size), 1 / 256)  # order -1: all bytes alike
        each = np.ones(self.size)
        each[-1] = self.unmet  # bytes that the last symbol stands for
        first = 0
        for k, contexts in enumerate(met):
            context, symbol = self._split(grams, k)
            seen = np.zeros((len(contexts), self.size))
            np.add.at(seen, (np.searchsorted(contexts, context), symbol), n)
            lower = below if k == 0 else p[self.contexts[k - 1][contexts % self.size ** (k - 1)]]
            total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            rest = ((seen == 0) * lower * each).sum(1, keepdims=True)  # what exclusion leaves to shorter contexts
            escaped = np.where(kinds > 0, kinds / np.maximum(total + kinds, 1), 1) / np.maximum(rest, 1e-300)
            whole = np.where(rest > 1e-12, total + kinds, np.maximum(total, 1))  # nothing is left to escape to
            p[first : first + len(contexts)] = np.where(seen > 0, seen / np.maximum(whole, 1), lower * escaped)
            p[first : first + len(contexts)][(kinds == 0)[:, 0]] = lower[(kinds == 0)[:, 0]] if len(lower) > 1 else lower
            first += len(contexts)
        return -np.log2(np.maximum(p, 1e-12))

    def score(self, text: str) -> np.ndarray:
        """The code length of a text in each language, in bits."""
        total = np.zeros(len(self.langs))
        data = self.symbol[np.frombuffer(b"\0" * self.order + text.encode(), np.uint8)]
        for first in range(self.order, len(data), 1 << 16):
            last = min(first + (1 << 16), len(data))
            context = np.zeros(last - first, np.int64)
            for j in range(self.order, 0, -1):
                context = context * self.size + data[first - j : last - j]
            total += self.bits[self.contexts[-1][context], data[first:last]].sum(0, dtype=np.float64)
        return total


def fitted(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = MAX_ORDER) -> Model:
    found = gram_counts(docs, per_language, order).toPandas()
    return Model({lang: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for lang, g in found.groupby("lang")}, order)


def predicted(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id alone by default), held_out, lang_pred and score of each document.

    score: the share of the predicted language when languages weigh 2^-bits, with the advantage over the
    next language spread over the text's length, so that it doesn't end at 1 for every longer text.
    """
    keep = keep or ["doc_id"]
    source = docs.select(*keep, *({"text"} - set(keep)), held_out().alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            for part in pieces(batch):
                lang, score = [], []
                for text in part.column("text").to_pylist():
                    if not own.langs or not text or not any(map(str.isalpha, text)):
                        lang.append(UNDETERMINED)
                        score.append(0.0)
                        continue
                    bits = own.score(text)
                    best = int(np.argmin(bits))
                    lang.append(own.langs[best])
                    score.append(float(1 / np.exp2((bits[best] - bits) / np.sqrt(len(text) + 1)).sum()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "held_out", "lang_pred", "score"])

    kinds = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", held_out boolean, lang_pred string, score double"
    return source.mapInArrow(run, schema)


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = MAX_ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, by a model of the rows that aren't held out."""
    return predicted(docs, fitted(docs, per_language, order))
