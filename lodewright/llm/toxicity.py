"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import set_aside
from ._memory import give_back, tidy

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
FIRST_BLOCKS = 4
FREQUENT = 16
NEIGHBOURS = 25
REJECT = 0.7
FOLDS = 4
MOST_EXAMPLES = 2048


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_words(text: str | None) -> Counter:
    """The terms of a whole text, its words in lower case, and how often it has each."""
    return Counter(WORD.findall((text or "").lower()))


def known_counts(text: str | None, known: dict[str, int]) -> dict[int, int]:
    """How often a whole text has each term that is known, by the term's number."""
    found = text_words(text)
    return {known[w]: found[w] for w in found.keys() & known.keys()}


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers low[0] to high[0], low[1] to high[1] and so on, one after the other."""
    size = high - low
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


def label_weights(vectors: list[dict[int, int]], labels: np.ndarray, terms: int) -> np.ndarray:
    """1 + by how many standard deviations more examples of label 1 have a term than a share without regard to it gives."""
    toxic, every = np.zeros(terms), np.zeros(terms)
    for v, y in zip(vectors, labels, strict=True):
        at = np.fromiter(v, np.int64, len(v))
        every[at] += 1
        if y:
            toxic[at] += 1
    share = float(labels.mean()) if len(labels) else 0.0
    spread = np.sqrt(np.maximum(every, 1) * max(share * (1 - share), 1e-9))
    return 1.0 + np.maximum(0.0, (toxic - every * share) / spread)


class Index:
    """Labelled examples as unit vectors, in blocks of rows, and an inverted list for each term.

    A vector's components are (1 + log count) * idf * label weight, over every word that an example has. Lists of
    terms that are in a FREQUENT-th of the examples or more are kept by block, with their greatest weight in each.
    """

    def __init__(self, vectors: list[dict[int, int]], labels: np.ndarray, ids: np.ndarray, class_weights: tuple[float, float], idf: np.ndarray, k: int = NEIGHBOURS):
        self.k, self.class_weights = k, class_weights
        self.weights = idf * label_weights(vectors, labels, len(idf))
        units = [self.unit(v) for v in vectors]
        heaviest = np.array([at[np.argmax(w)] if len(at) else -1 for at, w in units], np.int64)
        order = np.lexsort((ids, labels, heaviest))  # like examples share blocks
        self.labels, self.ids = labels[order].astype(float), ids[order]
        self.blocks = max(1, -(-len(order) // BLOCK))
        row = np.repeat(np.arange(len(order)), [len(units[i][0]) for i in order])
        term = np.concatenate([np.zeros(0, np.int64), *(units[i][0] for i in order)])
        value = np.concatenate([np.zeros(0), *(units[i][1] for i in order)])
        length = np.bincount(term, minlength=len(idf))
        self.frequent = np.full(len(idf), -1, np.int32)
        often = np.flatnonzero(length >= max(2, len(order) // FREQUENT))
        self.frequent[often] = np.arange(len(often))
        part = self.frequent[term]
        self.lists = np.zeros((self.blocks, len(often), BLOCK))
        own = part >= 0
        self.lists[row[own] // BLOCK, part[own], row[own] % BLOCK] = value[own]
        self.most = self.lists.max(axis=2)
        row, term, value = row[~own], term[~own], value[~own]
        by = np.lexsort((row, term))
        self.rows, self.values = row[by].astype(np.int32), value[by]
        self.cuts = np.searchsorted(term[by], np.arange(len(idf) + 1))
        self.steps: tuple[np.ndarray, np.ndarray] = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.bare = 0.0

    def unit(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        order = np.argsort(at)
        at, n = at[order], np.fromiter(counts.values(), float, len(counts))[order]
        w = (1 + np.log(n)) * self.weights[at]
        return at, w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples and all that tie with the k-th; a cosine of 0 is not near.

        The short lists are read first. A block's bound is its greatest sum so far and, for the frequent terms, the
        query's weight times the block's greatest. Blocks are read by falling bound; once k cosines exceed a block's
        bound, that block can't hold a nearer one.
        """
        low, high = self.cuts[at], self.cuts[at + 1]
        read = _ranges(low, high)
        score = np.zeros((self.blocks, BLOCK))
        score.ravel()[:] = np.bincount(self.rows[read], np.repeat(w, high - low) * self.values[read], score.size)
        part = self.frequent[at]
        at, w = part[part >= 0], w[part >= 0]
        bound = score.max(axis=1) + self.most[:, at] @ w
        order, kth = np.argsort(-bound, kind="stable"), 0.0
        left, exact = order[bound[order] > 0], []
        for size in (FIRST_BLOCKS, self.blocks):
            now, left = left[:size], left[size:]
            if not len(now):
                break
            score[now] += w @ self.lists[now[:, None], at[None, :]]
            exact.append(now)
            every = score[np.concatenate(exact)].ravel()
            if len(every) > self.k:
                kth = float(np.partition(every, len(every) - self.k)[-self.k])
                left = left[bound[left] >= kth - 1e-9]
        if not exact:
            return np.zeros(0, np.int64), np.zeros(0)
        block, place = np.nonzero((score[done := np.sort(np.concatenate(exact))] > 0) & (score[done] >= kth - 1e-9))
        return done[block] * BLOCK + place, score[done[block], place]

    def vote(self, counts: dict[int, int]) -> tuple[float, list[int], list[int]]:
        """The share of label 1 among the neighbours, by cosine and by how much of its class an example stands for; -1
        without any. With the ids of the three nearest and the query's five heaviest terms."""
        at, w = self.unit(counts)
        row, cosine = self.nearest(at, w)
        if not len(row):
            return -1.0, [], []
        y = self.labels[row]
        weight = np.where(y == 1, *self.class_weights) * cosine
        near = row[np.lexsort((self.ids[row], -cosine.round(12)))[:3]]
        return float((weight * y).sum() / weight.sum()), self.ids[near].tolist(), at[np.argsort(-w, kind="stable")[:5]].tolist()

    def calibrate(self, votes: list[float], labels: np.ndarray) -> None:
        """The isotonic rates of label 1 that belong to votes; those of -1 give the rate of examples without neighbours."""
        weights = np.where(labels == 1, *self.class_weights)
        alone = np.array(votes) < 0
        self.bare = float((1.0 + weights[alone & (labels == 1)].sum()) / (20.0 + weights[alone].sum()))
        merged: list[list[float]] = []  # sums of votes, of labels and of weights
        for got, label, weight in sorted((v, int(y), w) for v, y, w in zip(votes, labels, weights, strict=True) if v >= 0):
            merged.append([got * weight, label * weight, weight])
            while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
                last = merged.pop()
                merged[-1] = [a + b for a, b in zip(merged[-1], last, strict=True)]
        if merged:
            self.steps = np.array([m[0] / m[2] for m in merged]), np.array([(m[1] + 0.5) / (m[2] + 1.0) for m in merged])

    def score(self, counts: dict[int, int]) -> tuple[float, list[int], list[int]]:
        """The calibrated score, ids of the nearest examples and heaviest terms."""
        got, ids, terms = self.vote(counts) if counts else (-1.0, [], [])
        return (self.bare if got < 0 else float(np.clip(np.interp(got, *self.steps), 0, 1))), ids, terms


def fit_index(vectors: list[dict[int, int]], labels: np.ndarray, ids: np.ndarray, class_weights: tuple[float, float], idf: np.ndarray) -> Index:
    """The index of all examples, calibrated by the votes that each fold of them gets from the others."""
    fold = np.arange(len(ids)) % FOLDS
    votes = [-1.0] * len(ids)
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        part = Index([vectors[i] for i in rest], labels[rest], ids[rest], class_weights, idf)
        for i in np.flatnonzero(fold == f).tolist():
            votes[i] = part.vote(vectors[i])[0]
    index = Index(vectors, labels, ids, class_weights, idf)
    index.calibrate(votes, labels)
    return index


def _examples(docs: DataFrame, labels: DataFrame, most: int) -> tuple[pa.Table, tuple[float, float]]:
    """doc_id, toxic, words and counts of at most ``most`` labelled rows of the learning part, by hash of their id.

    A third of them have label 1 if there are so many. A doc_id counts once, with its least text.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = usable.join(docs.select("doc_id"), "doc_id", "left_semi")
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = {1: most // 3, 0: most - most // 3}
    picked = [r for y in (1, 0) for r in usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share[y]).collect()]
    weights = tuple(totals.get(y, 0) / max(1, min(share[y], totals.get(y, 0))) for y in (1, 0))
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "doc_id long, toxic int")
    own = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # most rows at most

    @tidy
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_words(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "counts"])

    return own.mapInArrow(words, "doc_id long, toxic int, words array<string>, counts array<long>").toArrow().combine_chunks().sort_by("doc_id"), weights


def train(docs: DataFrame, labels: DataFrame, most_examples: int = MOST_EXAMPLES) -> tuple[dict[str, int], Index]:
    """The vocabulary, every word of the examples, and the index of all examples.

    Learns from labelled rows that aren't held out, a sample of at most ``most_examples``. Document frequencies are
    counted over all ``docs``. What reaches the driver is the examples' words and a count for each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, class_weights = _examples(texts, labels.select("doc_id", "toxic"), most_examples)
    words, counts = (pa.concat_arrays(rows[c].chunks) if rows.num_rows else pa.array([], rows[c].type) for c in ("words", "counts"))
    names = pc.unique(words.flatten()).sort()
    vocabulary = {word: i for i, word in enumerate(names.to_pylist())}
    sent = spark.sparkContext.broadcast(vocabulary)

    @tidy
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a term and task; the term -1 counts texts."""
        known, seen, n = sent.value, np.zeros(len(sent.value), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    seen[[known[w] for w in known.keys() & set(WORD.findall(text.lower()))]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, seen[at]])], ["term", "n"])

    counted = texts.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    term, n = counted["term"].to_numpy(), counted["n"].to_numpy().astype(float)
    df, total = np.zeros(len(vocabulary)), float(n[term == -1].sum())
    df[term[term >= 0]] = n[term >= 0]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1e-3  # a word of every text says nearly nothing
    sent.destroy()
    terms, times, cuts = pc.index_in(words.flatten(), names).to_numpy(zero_copy_only=False), counts.flatten().to_numpy(), words.offsets.to_numpy()
    vectors = [dict(zip(terms[a:b].tolist(), times[a:b].tolist(), strict=True)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    y, ids = rows["toxic"].to_numpy().astype(np.int64), rows["doc_id"].to_numpy()
    index = fit_index(vectors, y, ids, class_weights, idf)
    del vectors, terms, times, words, counts, rows
    give_back()
    return vocabulary, index


_ANSWERS = "toxicity double, evidence_ids array<long>, evidence_terms array<string>"


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with toxicity (0 to 1), evidence_ids (the nearest labelled examples) and evidence_terms (the text's
    heaviest words that examples have, at most five); columns of those names are replaced.

    Only the text decides, all of it. Null and empty texts, and texts without any word of an example, get the rate of
    label 1 among such examples; without usable labels that is near 0. Ids are whole numbers or null; repeated rows have
    a row each; other columns are left as they are; an empty table gives an empty table. Rows are scored where they lie,
    so that no text is shuffled.
    """
    vocabulary, index = train(docs, labels, **options)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, index))
    base = docs.drop("toxicity", "evidence_ids", "evidence_terms")
    at = base.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = sent.value
        names, last = list(known), {}
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                answers = []
                for text in batch.column(at).to_pylist():
                    if text not in last:
                        score, ids, terms = index.score(known_counts(text, known))
                        last[text] = score, ids, [names[t] for t in terms]
                    answers.append(last[text])
                last = {}  # equal texts of a batch are scored once
                columns = [pa.array(c, t) for c, t in zip(zip(*answers, strict=True), [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string())], strict=True)]
                if answers:
                    yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "toxicity", "evidence_ids", "evidence_terms"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), _ANSWERS])
    return base.mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, toxicity, evidence_ids, evidence_terms, as in ``scored``; extra columns aren't read."""
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, **options).drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below ``reject``, with their columns."""
    plain, back = set_aside(docs, "doc_id", "text")
    return back(scored(plain, labels, **options).where(F.col("toxicity") < reject))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scores(docs, labels).select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= REJECT, 1).otherwise(0).alias("predicted"), "evidence_ids", "evidence_terms")
