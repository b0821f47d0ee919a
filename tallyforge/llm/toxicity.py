"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded, documented sample of labelled documents (PER_CLASS of each label, those of the smallest hash of
doc_id) makes the examples. All their words are terms. Document frequencies for IDF are counted over all
documents. A term's weight is its IDF times FLOOR plus what it tells about toxicity: the lower bound, at
Z standard errors, of the logarithm of how much more often toxic examples have it. Words outside the sample
have no weight.

The examples lie in an inverted index: postings by term, in blocks of examples, and the largest weight of each
term in each block. Blocks are scored exactly, through their postings, in the order of their bounds until none
can reach the k-th neighbour. The neighbours vote, weighted by cosine and by how many documents of the
learning rows an example stands for. What a vote is worth is learned from the examples, each voted on by the
others: an isotonic regression, weighted as above, turns votes into shares of toxic documents. Evidence: the
best neighbour and the heaviest terms shared with it.

Null and empty texts, and texts without a term of the index, are told from each other by nothing: their score
is the share of toxic documents among examples of that kind, or else among all. Labels other than 0 and 1, and
documents labelled both ways, teach nothing. Without labels every score is 0. Repeated rows give repeated rows;
other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import pieces, written
from tallyforge.llm.language import held_out

#: Examples of each label, neighbours, examples of a block.
PER_CLASS, NEIGHBOURS, BLOCK = {1: 1000, 0: 3000}, 25, 256
#: What a term weighs that tells nothing, and the standard errors of the lower bound of what it tells.
FLOOR, Z = 0.05, 2.0
#: Share of the examples from which a term's postings are kept whole.
OFTEN = 1 / 16
THRESHOLD = 0.3
WORDS = regex.compile(r"\p{L}+")


def terms_of(text: str | None) -> dict[str, int]:
    """How often each word is in a text."""
    return Counter(WORDS.findall(text.lower()) if text else ())


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The examples (doc_id, text, toxic), written, and the number of learning rows of each label."""
    told = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    ids = written(told.select("doc_id", "toxic").join(docs.select("doc_id").distinct(), "doc_id"))
    number = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    first = [ids.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in PER_CLASS.items()]
    return written(docs.select("doc_id", "text").join(F.broadcast(first[0].union(first[1])), "doc_id").dropDuplicates(["doc_id"])), number


def tallied(examples: DataFrame) -> list[tuple[int, int, dict[str, int]]]:
    """(doc_id, toxic, words and counts) of each example, by doc_id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                counts = [terms_of(t) for t in part.column("text").to_pylist()]
                lists = [pa.array([list(side(c)) for c in counts], kind) for side, kind in ((dict.keys, pa.list_(pa.string())), (dict.values, pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "words", "counts"])

    found = examples.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id bigint, toxic int, words array<string>, counts array<int>").toArrow().sort_by("doc_id")
    return [(i, y, dict(zip(w, c, strict=True))) for i, y, w, c in zip(*(found.column(n).to_pylist() for n in ("doc_id", "toxic", "words", "counts")), strict=True)]


def document_frequencies(docs: DataFrame, places: dict[str, int]) -> tuple[int, np.ndarray]:
    """The number of documents and, for each term, of those that have it."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        import pyarrow as pa

        own = shared.value
        df, rows = np.zeros(len(own) + 1, np.int64), 0
        for batch in batches:
            for part in pieces(batch):
                rows += part.num_rows
                for text in part.column("text").to_pylist():
                    at = [own[w] for w in terms_of(text) if w in own]
                    df[at] += 1
        df[-1] = rows
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(places) + 1, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def term_weights(n_docs: int, df: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n: dict[int, int]) -> np.ndarray:
    """The weight of each term, from documents that have it: all, toxic and other examples; n examples of each label."""
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    ratio = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
    return idf * (FLOOR + np.maximum(0, ratio - Z * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))))


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start, start + 1, … of each range, one range after the other."""
    return np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)


def _best(ids: np.ndarray, cosines: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest cosines, largest first, of equal ones the smallest ids.

    Cosines are compared to six digits, so that equal examples aren't told apart by the order of additions.
    """
    at = np.arange(len(cosines))
    if len(cosines) > k:
        at = np.flatnonzero(cosines >= np.partition(cosines, -k)[-k] - 1e-6)
    return at[np.lexsort((ids[at], -np.round(cosines[at], 6)))[:k]]


class Index:
    """Examples by term, in blocks with the largest weight of each term."""

    def __init__(self, places: dict[str, int], weight: np.ndarray, examples: list[tuple[int, int, dict[str, int]]], number: dict[int, int]):
        self.places, self.weight, self.size = places, weight, BLOCK
        vectors = [self.vector(c) for _, _, c in examples]
        # Examples that are alike stand together: by label, most frequent word and heaviest term.
        frequent = [max(c, key=lambda w, c=c: (c[w], w)) if c else "" for _, _, c in examples]
        heaviest = [t[np.argmax(w)] if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(examples)), key=lambda i: (examples[i][1], frequent[i], heaviest[i], examples[i][0]))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.toxic = np.array([examples[i][1] for i in order], np.float64)
        n = [max(1, int((self.toxic == y).sum())) for y in (0, 1)]
        learned = max(1, sum(number.values()))
        self.stands_for = np.where(self.toxic == 1, number.get(1, 0) / n[1], number.get(0, 0) / n[0]) / learned
        self.prior = number.get(1, 0) / learned
        self.blocks = max(1, -(-len(order) // BLOCK))
        sizes = [len(vectors[i][0]) for i in order]
        row = np.repeat(np.arange(len(order)), sizes)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        value = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        by_term = np.lexsort((row, term))
        term, self.row, self.value = term[by_term], row[by_term].astype(np.int32), value[by_term].astype(np.float32)
        key = term * self.blocks + self.row // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.first = np.append(first, len(key)).astype(np.int32)
        self.block_of = (key[first] % self.blocks).astype(np.int16)
        self.most = np.maximum.reduceat(self.value, first) if len(first) else self.value
        self.of_term = np.searchsorted(key[first] // self.blocks, np.arange(len(weight) + 1)).astype(np.int32)
        # Postings of terms that many examples have are kept whole, with zeros where an example lacks the term.
        often = np.flatnonzero(np.bincount(term, minlength=len(weight)) >= max(2, len(order) * OFTEN))
        self.whole = np.full(len(weight), -1, np.int32)
        self.whole[often] = np.arange(len(often))
        self.postings = np.zeros((len(often), len(order)), np.float32)
        held = self.whole[term] >= 0
        self.postings[self.whole[term[held]], self.row[held]] = self.value[held]

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, ascending, and their weights, of length 1."""
        places = self.places
        terms = np.fromiter(map(places.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        order = np.argsort(terms)[np.count_nonzero(terms < 0) :]
        terms = terms[order]
        w = (1 + np.log(n[order])) * self.weight[terms]
        return terms, w / np.linalg.norm(w) if len(w) else w

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k nearest examples (but one of the id ``but``) and their cosines, exactly; of equal ones the smallest ids."""
        start, length = self.of_term[terms], self.of_term[terms + 1] - self.of_term[terms]
        at, weight = _ragged(start, length), np.repeat(q, length)
        block = self.block_of[at]
        own = self.whole[terms]
        frequent = own >= 0
        sums = (q[frequent].astype(np.float32) @ self.postings[own[frequent]]).astype(np.float64)
        rare = np.repeat(~frequent, length)
        bounds = np.bincount(block, weight * self.most[at], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        found, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        done, step = 0, 4
        while done < len(order):
            chosen = order[done : done + step]
            chosen = chosen[(bounds[chosen] > 0) & (bounds[chosen] >= least - 1e-6)]
            if not len(chosen):
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[chosen] = True
            here = rare & wanted[block]
            posting, n = self.first[at[here]], self.first[at[here] + 1] - self.first[at[here]]
            entry = _ragged(posting, n)
            scores = np.bincount(self.row[entry], np.repeat(weight[here], n) * self.value[entry], len(self.ids))
            scores = scores + np.where(np.repeat(wanted, self.size)[: len(scores)], sums, 0)
            if but is not None:
                scores[self.ids == but] = 0
            new = np.flatnonzero(scores)
            found, cosines = np.concatenate([found, new]), np.concatenate([cosines, scores[new]])
            if len(found) > k:
                best = _best(self.ids[found], cosines, k)
                found, cosines = found[best], cosines[best]
                least = cosines[-1]
            done, step = done + step, 2 * step
        best = _best(self.ids[found], cosines, k)
        return found[best], cosines[best]

    def vote(self, counts: dict[str, int], but: int | None = None) -> tuple[float | None, int | None, np.ndarray]:
        """(vote, place of the nearest example, terms shared with it by weight); nothing for texts without a term."""
        terms, q = self.vector(counts)
        at, cosines = self.nearest(terms, q, but=but)
        if not len(at):
            return None, None, terms
        weight = cosines * self.stands_for[at]
        return float((weight * self.toxic[at]).sum() / weight.sum()), int(at[0]), terms[np.argsort(-q, kind="stable")]

    def in_common(self, at: int, terms: np.ndarray, most: int = 3) -> list[int]:
        """The first of the terms that an example has too."""
        out = []
        for t in terms.tolist():
            own = self.row[self.first[self.of_term[t]] : self.first[self.of_term[t + 1]]]
            k = int(np.searchsorted(own, at))
            if k < len(own) and own[k] == at:
                out.append(t)
                if len(out) == most:
                    break
        return out


class Calibration:
    """What votes are worth, learned from (doc_id, toxic, vote) of the examples, and the score of texts without a vote."""

    def __init__(self, index: Index, told: list[tuple[int, int, float | None]]):
        stands_for = dict(zip(index.ids.tolist(), index.stands_for.tolist(), strict=True))
        bare = [(stands_for[i], y) for i, y, v in told if v is None]
        self.bare = sum(w * y for w, y in bare) / sum(w for w, _ in bare) if bare else index.prior
        rest = sorted((v, y, stands_for[i]) for i, y, v in told if v is not None) or [(0.0, index.prior, 1.0)]
        self.votes, self.shares = isotonic(*(np.array(c, np.float64) for c in zip(*rest, strict=True)))

    def score(self, vote: float | None) -> float:
        return float(self.bare if vote is None else np.interp(vote, self.votes, self.shares))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of x and y in the groups of the rising step function that is nearest to y; x must be sorted."""
    groups: list[list[float]] = []
    for a in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1):
        groups.append([w[a].sum(), (w[a] * x[a]).sum(), (w[a] * y[a]).sum()])
        while len(groups) > 1 and groups[-2][2] * groups[-1][0] >= groups[-1][2] * groups[-2][0]:
            last = groups.pop()
            groups[-1] = [p + q for p, q in zip(groups[-1], last, strict=True)]
    total, sx, sy = np.array(groups).T
    return sx / total, sy / total


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, Calibration] | None:
    """The index, sent to the executors, and its calibration; nothing where no documents of both labels are known."""
    sample, number = sampled(docs, labels)
    examples = tallied(sample)
    n = Counter(y for _, y, _ in examples)
    if not n[0] or not n[1]:
        return None
    places = {w: i for i, w in enumerate(sorted({w for _, _, c in examples for w in c}))}
    have = np.zeros((2, len(places)), np.int64)
    for _, y, counts in examples:
        have[y, [places[w] for w in counts]] += 1
    n_docs, df = document_frequencies(docs, places)
    index = Index(places, term_weights(n_docs, df, have[1], have[0], n), examples, number)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            votes = [own.vote(terms_of(t), i)[0] for i, t in zip(ids.to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, batch.column("toxic"), pa.array(votes, pa.float64())], ["doc_id", "toxic", "vote"])

    spread = sample.select("doc_id", "toxic", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    told = [tuple(r) for r in spread.mapInArrow(run, "doc_id bigint, toxic int, vote double").collect()]
    return shared, Calibration(index, told)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, nearest_example, evidence of each document."""
    shared, calibration = fitted(docs, labels) or (None, None)
    names = ["doc_id", "held_out", "score", "predicted", "nearest_example", "evidence"]

    def run(batches):
        import pyarrow as pa

        own = shared.value if shared else None
        words = sorted(own.places) if own else []
        for batch in batches:
            for part in pieces(batch):
                out = []
                for text in part.column("text").to_pylist():
                    vote, at, terms = own.vote(terms_of(text)) if own else (None, None, [])
                    evidence = None if at is None else " ".join(words[t] for t in own.in_common(at, terms))
                    out.append((calibration.score(vote) if own else 0.0, None if at is None else int(own.ids[at]), evidence))
                score = np.array([o[0] for o in out], np.float64)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, nearest_example bigint, evidence string")
