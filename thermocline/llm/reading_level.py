"""Reading level of each document by a Rasch model of word occurrences.

Every occurrence of a word in a document is a response: does the document reach grade k?  The
model of each step k is P = sigmoid(level of the document - difficulty of the word), the
dichotomous Rasch model; the three steps together are its partial-credit form.  Documents and
words are estimated in turn by Newton steps of the penalised joint likelihood until it stands
still: a pass over the documents brings each level to its optimum and sums gradients and
curvatures by word, and the words then move.  The steps are anchored by the graded sample.

Documents are split in two halves by a hash of their id.  Each half estimates words for the
other, so neither a document's grades nor what is believed about it enter its own level, and
graded and ungraded documents are measured on one scale.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.text import fold, own_prose
from thermocline.operators.support import small_side, spread, written

STEPS = (2, 3, 4)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,]")


def occurrences(text: str | None) -> list[int]:
    """Distinct word occurrences of a text's own prose as 64-bit hashes: words and pairs of neighbours, with the marks between them."""
    tokens = _TOKEN.findall(fold(own_prose(text)))
    found = {t for t in tokens if t not in ",.;:!?"}
    if not found:
        return []
    found.update(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))
    return sorted(xxhash.xxh64_intdigest(x) - (1 << 63) for x in found)


@dataclass
class Words:
    """Word difficulties: ``b[half, step, bucket]``, the difficulty ``start[step]`` of a word never seen, and per step (cut, slope) of the level scale."""

    b: np.ndarray
    start: np.ndarray
    cuts: list[tuple[float, float]] = field(default_factory=list)


@dataclass
class ReadingLevel:
    """Estimates a level from 1 to 4 for each document with prose of its own.

    ``turns``: in the first turn graded documents respond, in later ones ungraded documents too,
    by what is believed about them, with at most ``ungraded_weight`` of a graded one and less the
    fewer words they have.  A turn ends when the likelihood changes by less than ``tolerance`` of
    itself, after ``most_steps`` alternations at the latest.  ``prior``: responses that a word's
    difficulty is drawn to the overall mean by; ``level_prior``: precision of the zero that a
    document's departure from its words is drawn to.  ``middle_words``: a document's level is the
    mean of its words with so many neutral words added, so that posts of few words stay in the
    middle.  ``buckets``: words are hashed to so many parameters, which bounds the model whatever
    the vocabulary; rare words that share one share a difficulty.  ``calibration_rows``: at most
    so many graded documents, by hash order, calibrate the cut between neighbouring grades; all
    of them, and all documents, estimate the words.

    Several grades of a document are averaged per step; null grades and grades of unknown
    documents are ignored.  Quoted text, signatures, pasted machine text and markup don't count;
    documents without own prose get no row.  Repeated document rows give one row, of differing
    texts under one id the one whose words sort first.  Without any grades there is no scale,
    and the result is empty.  ``likelihoods`` holds those of the last fit, turn by turn.
    """

    turns: int = 2
    most_steps: int = 8
    tolerance: float = 0.001
    prior: float = 2.0
    level_prior: float = 100.0
    middle_words: float = 10.0
    ungraded_weight: float = 0.2
    buckets: int = 1 << 18
    calibration_rows: int = 20_000
    likelihoods: list[list[float]] = field(default_factory=list)

    def levels(self, documents: DataFrame, grades: DataFrame) -> DataFrame:
        """``documents``: doc_id, text.  ``grades``: doc_id, grade.  Result: ``doc_id, level, difficulty``."""
        spark = documents.sparkSession
        docs = self._responses(documents, grades)
        graded = docs.where(F.col("graded"))
        sums = graded.agg(F.count(F.lit(1)), *[F.avg(f"y{k}") for k in STEPS]).first()
        if not sums[0]:
            return spark.createDataFrame([], "doc_id long, level int, difficulty double")
        base = np.array([min(max(float(x), 0.01), 0.99) for x in sums[1:]])
        self.likelihoods, words = [], None
        for turn in range(self.turns):
            words = self._fit(graded if turn == 0 else docs, base, words)
            words.cuts = self._cuts(graded, words)
        placed = self._placed(docs, words)
        reached = [F.col(f"t{k}") > F.lit(c) for k, (c, _) in zip(STEPS, words.cuts)]
        # a level counts as reached when it or a higher one is
        level = F.when(reached[2], 4).when(reached[1], 3).when(reached[0], 2).otherwise(1)
        return placed.select("doc_id", level.cast("int").alias("level"), sum((F.col(f"t{k}") for k in STEPS[1:]), F.col(f"t{STEPS[0]}")).alias("difficulty"))

    def _responses(self, documents: DataFrame, grades: DataFrame) -> DataFrame:
        """``doc_id, half, words, y2, y3, y4, graded``: buckets of the word occurrences and, where graded, the share of graders who see each grade reached.

        The files of graded documents lie apart, so the first turn reads nothing else.
        """
        buckets = self.buckets

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted({x % buckets for x in occurrences(t)}) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "words"])

        kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        found = spread(kept).mapInArrow(read, "doc_id long, words array<int>").where(F.size("words") > 0)
        once = found.groupBy("doc_id").agg(F.min("words").alias("words"))
        per = grades.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.avg((F.col("grade") >= k).cast("double")).alias(f"y{k}") for k in STEPS])
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
        joined = once.join(small_side(per), "doc_id", "left").select("doc_id", half, "words", *[f"y{k}" for k in STEPS], F.col(f"y{STEPS[0]}").isNotNull().alias("graded"))
        return written(joined, "word-occurrences", "graded")

    def _fit(self, docs: DataFrame, base: np.ndarray, before: Words | None) -> Words:
        """Words of one turn: a start from the log-odds of the responses, then alternating Newton steps.

        The model lives in arrays of fixed size; each task sums its documents into such arrays and
        sends what isn't zero, so a pass shuffles no occurrence.
        """
        start = np.log((1 - base) / base)
        words = Words(np.broadcast_to(start[None, :, None], (2, len(STEPS), self.buckets)).astype(np.float32), start)
        n, s, _ = self._sums(docs, words, base, before, begin=True)
        seen = n[:, :1] > 0
        share = (s + self.prior * base[None, :, None]) / (n + self.prior)
        words.b = np.where(seen, np.log((1 - share) / share), start[None, :, None]).astype(np.float32)
        found: list[float] = []
        for _ in range(self.most_steps):
            h, g, likelihood = self._sums(docs, words, base, before, begin=False)
            p = 1 / (1 + np.exp(words.b.astype(float)))
            b = base[None, :, None]
            found.append(likelihood + float((seen * self.prior * (b * np.log(p) + (1 - b) * np.log(1 - p))).sum()))
            if len(found) > 1 and abs(found[-1] - found[-2]) <= self.tolerance * abs(found[-2]):
                break
            step = (g + self.prior * (b - p)) / (h + self.prior * p * (1 - p))
            words.b = np.where(seen, words.b - np.clip(step, -1, 1), words.b).astype(np.float32)
        self.likelihoods.append(found)
        return words

    def _sums(self, docs: DataFrame, words: Words, base: np.ndarray, before: Words | None, *, begin: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """Per half, step and bucket the curvature and gradient of the likelihood with every document at its best level, and the likelihood.

        ``begin``: weights and weighted responses instead.  A document adds to the words of its own half.
        """
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((words, before))
        one = self

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, old = shared.value
            curve, slope = np.zeros(now.b.shape), np.zeros(now.b.shape)
            total = 0.0
            for batch in batches:
                half, at, sizes, owner = _flat(batch)
                y = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(STEPS))])
                free = np.isnan(y[0])
                if free.any():
                    y = np.where(free, one._beliefs(_place(old, half, at, sizes, owner, one.middle_words), old), y)
                w = np.where(free, one.ungraded_weight * sizes / (sizes + one.middle_words), 1.0)
                wr, side = w[owner], half[owner].astype(np.int64)
                cell = side * one.buckets + at
                # flat positions of the difficulties of step 0; those of the next step lie one table further
                place, flat = side * (len(STEPS) * one.buckets) + at, now.b.reshape(-1)
                for i in range(len(STEPS)):
                    yr = y[i][owner]
                    if begin:
                        up, down = wr, wr * yr
                    else:
                        theta, p = _best_levels(flat.take(place + i * one.buckets), yr, owner, len(sizes), one.level_prior)
                        up, down = wr * p * (1 - p), wr * (yr - p)
                        p = np.clip(p, 1e-12, 1 - 1e-12)
                        total += float((wr * (yr * np.log(p) + (1 - yr) * np.log(1 - p))).sum() - one.level_prior / 2 * (w * theta**2).sum())
                    curve[:, i] += np.bincount(cell, up, 2 * one.buckets).reshape(2, -1)
                    slope[:, i] += np.bincount(cell, down, 2 * one.buckets).reshape(2, -1)
            used = np.flatnonzero(curve[:, 0].reshape(-1))
            ids = np.append(used, -1)
            columns = [np.append(a[:, i].reshape(-1)[used], total if i == 0 and a is curve else 0.0) for a in (curve, slope) for i in range(len(STEPS))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns)], ["id", "c2", "c3", "c4", "g2", "g3", "g4"])

        parts = docs.select("half", "words", *[f"y{k}" for k in STEPS]).mapInArrow(add, "id long, c2 double, c3 double, c4 double, g2 double, g3 double, g4 double")
        sums = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]]).toArrow()
        shared.destroy()
        ids = sums.column("id").to_numpy()
        real = ids >= 0
        out = []
        for kind in "cg":
            a = np.zeros((2 * self.buckets, len(STEPS)))
            a[ids[real]] = np.stack([sums.column(f"{kind}{k}").to_numpy()[real] for k in STEPS], axis=1)
            out.append(a.T.reshape(len(STEPS), 2, -1).swapaxes(0, 1))
        return out[0], out[1], float(sums.column("c2").to_numpy()[~real].sum())

    @staticmethod
    def _beliefs(t: np.ndarray, words: Words) -> np.ndarray:
        return np.stack([1 / (1 + np.exp(-np.clip((t[i] - c) * s, -30, 30))) if np.isfinite(c) else np.full(t.shape[1], float(c < 0)) for i, (c, s) in enumerate(words.cuts)])

    def _placed(self, docs: DataFrame, words: Words) -> DataFrame:
        """``doc_id, y2, y3, y4, t2, t3, t4``: levels from the words of the other half."""
        shared = docs.sparkSession.sparkContext.broadcast(words)
        middle = self.middle_words

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = _place(shared.value, *_flat(batch), middle)
                yield pa.RecordBatch.from_arrays([batch.column(5), *[batch.column(2 + i) for i in range(len(STEPS))], *[pa.array(x) for x in t]], ["doc_id", "y2", "y3", "y4", "t2", "t3", "t4"])

        return docs.select("half", "words", *[f"y{k}" for k in STEPS], "doc_id").mapInArrow(place, "doc_id long, y2 double, y3 double, y4 double, t2 double, t3 double, t4 double")

    def _cuts(self, graded: DataFrame, words: Words) -> list[tuple[float, float]]:
        """Per step the cut on the level scale and the steepness, by a ridge logistic fit on graded documents."""
        bounded = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.calibration_rows)
        rows = self._placed(bounded, words).drop("doc_id").toPandas().to_numpy(dtype=float)
        return [_logistic(rows[:, len(STEPS) + i], rows[:, i]) for i in range(len(STEPS))]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Half of each document, buckets of all occurrences one after the other, occurrences per document, document of each occurrence."""
    lists = batch.column(1)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False), sizes, np.repeat(np.arange(len(sizes)), sizes)


def _place(words: Words, half: np.ndarray, at: np.ndarray, sizes: np.ndarray, owner: np.ndarray, middle: float) -> np.ndarray:
    """Level of each document at each step: how much easier its words are than the mean, with ``middle`` neutral words added."""
    steps, buckets = words.b.shape[1:]
    place, flat = (1 - half[owner].astype(np.int64)) * (steps * buckets) + at, words.b.reshape(-1)
    return np.stack([np.bincount(owner, words.start[i] - flat.take(place + i * buckets), len(sizes)) / (sizes + middle) for i in range(len(STEPS))])


def _best_levels(b: np.ndarray, y: np.ndarray, owner: np.ndarray, documents: int, precision: float) -> tuple[np.ndarray, np.ndarray]:
    """Level of each document that is likeliest given its words' difficulties, and the probability of each response."""
    theta, b = np.zeros(documents), b.astype(np.float32)
    # where a step is this small, the next one is the square of it
    small = 1e-3
    with np.errstate(over="ignore"):
        for _ in range(6):
            p = 1 / (1 + np.exp(b - theta.astype(np.float32)[owner]))
            g = np.bincount(owner, y - p, documents) - precision * theta
            h = np.bincount(owner, p * (1 - p), documents) + precision
            step = np.clip(g / h, -1, 1)
            theta = theta + step
            if not len(step) or np.abs(step).max() < small:
                break
        return theta, (1 / (1 + np.exp(b - theta.astype(np.float32)[owner]))).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Cut and slope of the logistic curve that best gives ``y`` (0 to 1) from ``x``."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([np.ones_like(x), (x - mean) / scale], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - ridge * np.array([0.0, beta[1]])
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    if beta[1] <= 1e-9:
        return (float("inf") if y.mean() < 0.5 else float("-inf")), 1.0
    return mean - scale * float(beta[0] / beta[1]), float(beta[1]) / scale
