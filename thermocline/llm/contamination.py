"""Evaluation texts that leaked into training text.

Rare n-gram seeds of the test items find candidate passages in the corpus, an exact bound on
shared words and pairs of words finds candidates for edited copies, and a Smith-Waterman
alignment scores each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.text import words
from thermocline.operators.support import spread, written

#: Test items are matched in blocks of at most so many bytes of text; a block is broadcast to the tasks.
BLOCK_BYTES = 32 << 20

RESULT = "doc_id long, item_id string, longest_run int, score double, matched_words int, first_word int, last_word int"
MATCH, MISMATCH, GAP = 2, -1, -1


def gram_hashes(tokens: list[str], n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    out = np.zeros(len(tokens) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + each[k : len(tokens) - n + 1 + k]
            out ^= out >> np.uint64(29)
    return out


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int, int]:
    """Smith-Waterman with linear gaps: best score, matched words on its path (lower bound from the score), first and last word in ``doc``, longest equal run.

    One vector step per item word.  A cell holds its score in the upper half of a long and the place
    where its alignment begins in the lower, so one maximum settles both; gaps along the document
    are settled by a running maximum.
    """
    n, unit = len(doc), 1 << 32
    fresh = np.arange(1, n + 1)
    gaps = GAP * unit * fresh
    cells, run = np.arange(n + 1), np.zeros(n + 1, np.int64)
    best, last, longest = 0, 0, 0
    for w in item:
        equal = doc == w
        new = cells[:-1] + np.where(equal, MATCH * unit, MISMATCH * unit)
        np.maximum(new, cells[1:] + GAP * unit, out=new)
        np.maximum(new, fresh, out=new)
        new -= gaps
        np.maximum.accumulate(new, out=new)
        new += gaps
        cells[1:] = new
        run[1:] = (run[:-1] + 1) * equal
        longest = max(longest, int(run.max()))
        top = int(new.max())
        if top >> 32 > best >> 32:
            best, last = top, int(new.argmax())
    score = best >> 32
    return score, (score + MATCH - 1) // MATCH, best % unit, last, longest


@dataclass
class LeakFinder:
    """Finds corpus documents that contain passages of test items.

    ``min_run``: consecutive equal words that make a passage.  ``seed_words``: length of the
    seeds; in every window of ``min_run - seed_words + 1`` successive n-grams of an item the one
    found in the fewest documents, but in some, is a seed, so each passage of ``min_run`` words
    holds one whatever the rarities.  ``min_score``: pairs whose alignment reaches that share of the best
    possible score of the item are reported even without such a run, as edited copies.  They need no
    seed: a pair is aligned unless the words and pairs of successive words that it shares rule out that
    score (:class:`Overlap`).  :meth:`passages` leaves edited copies out.

    Result: one row per document and item with the longest equal run in words, the share of the
    best score, the matched words and the place in the document in words.  Documents without
    text or words and items with fewer than ``seed_words`` words match nothing.  Repeated
    documents or items give one row; rows with a null id are left out.  Whole texts are read.
    Items are matched in blocks of bounded size, documents stream past them: nothing but the
    found pairs is shuffled.
    """

    min_run: int = 13
    seed_words: int = 6
    min_score: float = 0.5
    block_bytes: int = BLOCK_BYTES

    def find(self, documents: DataFrame, items: DataFrame) -> DataFrame:
        """``documents``: doc_id, text.  ``items``: item_id, prompt."""
        return self._find(documents, items, True)

    def passages(self, documents: DataFrame, items: DataFrame) -> DataFrame:
        """The pairs of :meth:`find` with a run of ``min_run`` words; place and score are those around its seeds."""
        return self._find(documents, items, False)

    def _find(self, documents: DataFrame, items: DataFrame, edited: bool) -> DataFrame:
        corpus = self._words(documents)
        items = items.select("item_id", "prompt").where(F.col("item_id").isNotNull() & F.col("prompt").isNotNull())
        total = items.agg(F.sum(F.octet_length(F.col("prompt").cast("binary")))).first()[0] or 0
        blocks = max(1, -(-int(total) // self.block_bytes))
        found = None
        for b in range(blocks):
            block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
            pairs = self._match(corpus, {r["item_id"]: words(r["prompt"]) for r in block.collect()}, edited)
            found = pairs if found is None else found.unionByName(pairs)
        best = F.struct("longest_run", "score", "matched_words", "first_word", "last_word")
        return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select("doc_id", "item_id", "b.*")

    def _words(self, documents: DataFrame) -> DataFrame:
        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [" ".join(words(t)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "words"])

        kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        return written(spread(kept).mapInArrow(plain, "doc_id long, words string"), "plain-words")

    def _match(self, corpus: DataFrame, items: dict[str, list[str]], edited: bool) -> DataFrame:
        spark, n = corpus.sparkSession, self.seed_words
        items = {k: w for k, w in items.items() if len(w) >= n}
        if not items:
            return spark.createDataFrame([], RESULT)
        names = sorted(items)
        grams = {k: gram_hashes(items[k], n) for k in names}
        seeds = self._seeds(names, grams, self._document_counts(corpus, np.unique(np.concatenate(list(grams.values())))))
        vocabulary: dict[str, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in items[k]], np.int64) for k in names]
        shared = spark.sparkContext.broadcast((names, coded, vocabulary, seeds, Overlap(coded, len(vocabulary), self.min_score) if edited else None))
        min_run, min_score = self.min_run, self.min_score

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, coded, vocabulary, (hashes, item_of, place_of), overlap = shared.value
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tokens = text.split()
                    own = gram_hashes(tokens, n)
                    low = np.searchsorted(hashes, own, "left")
                    high = np.searchsorted(hashes, own, "right")
                    hit = np.flatnonzero(high > low)
                    if not len(hit) and overlap is None:
                        continue
                    doc = np.fromiter((vocabulary.get(t, -1) for t in tokens), np.int64, len(tokens))
                    starts: dict[int, list[int]] = {}
                    for d in hit:
                        for s in range(low[d], high[d]):
                            starts.setdefault(int(item_of[s]), []).append(int(d) - int(place_of[s]))
                    parts = overlap.parts(doc) if overlap is not None else {}
                    for i in starts.keys() | parts.keys():
                        offsets = starts.get(i, [])
                        if i not in parts and not _holds_run(doc, coded[i], offsets, min_run):
                            continue
                        made = _best(doc, coded[i], _merged(_spans(doc, coded[i], offsets) + parts.get(i, [])))
                        share = made[0] / (MATCH * len(coded[i]))
                        if made[4] >= min_run or edited and share >= min_score:
                            rows.append((doc_id, names[i], made[4], share, made[1], made[2], made[3]))
                columns = list(zip(*rows)) if rows else [()] * 7
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "longest_run", "score", "matched_words", "first_word", "last_word"])

        return corpus.mapInArrow(scan, RESULT)

    def _document_counts(self, corpus: DataFrame, wanted: np.ndarray) -> dict[int, int]:
        """Number of documents that hold each n-gram of the items; counts of item n-grams only, so as bounded as the block."""
        shared, n = corpus.sparkSession.sparkContext.broadcast(wanted), self.seed_words

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            total = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    own = np.unique(gram_hashes(text.split(), n))
                    at = np.searchsorted(wanted, own)
                    at[at == len(wanted)] = 0
                    total[at[wanted[at] == own]] += 1
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["i", "c"])

        rows = corpus.select("words").mapInArrow(count, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()
        return {int(wanted[r["i"]]): r["c"] for r in rows}

    def _seeds(self, names: list[str], grams: dict[str, np.ndarray], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted seed hashes with their item and place."""
        window = max(1, self.min_run - self.seed_words + 1)
        hashes, item_of, place_of = [], [], []
        for i, name in enumerate(names):
            h = grams[name]
            # an n-gram in no document finds nothing: the rarest of those that occur is the seed
            rarity = [(counts.get(int(x), 0), int(x)) for x in h]
            windows = [[k for k in range(a, min(a + window, len(h))) if rarity[k][0]] for a in range(max(1, len(h) - window + 1))]
            chosen = {min(w, key=lambda k: rarity[k]) for w in windows if w}
            for k in sorted(chosen):
                hashes.append(h[k])
                item_of.append(i)
                place_of.append(k)
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        return np.array(hashes, np.uint64)[order], np.array(item_of)[order], np.array(place_of)[order]


class Overlap:
    """Which items a document can hold with a share ``min_score`` of their best score, and where: an exact bound, never a guess.

    An alignment of M matched words in r runs has at least r - 1 edits between the runs, and M - r
    pairs of successive words that both sides share.  Its score is at most 2 M - (r - 1), so at most
    the shared words plus the shared pairs plus one, each counted as often as it occurs on both
    sides.  A score of S has at most 2 M - S edits, so it lies within 3 L - S words of the document.
    """

    def __init__(self, items: list[np.ndarray], words: int, min_score: float):
        self.words = words
        self.pairs = np.unique(np.concatenate([w[:-1] * words + w[1:] for w in items]))
        self.kinds = [np.unique(np.concatenate([w, words + np.searchsorted(self.pairs, w[:-1] * words + w[1:])]), return_counts=True) for w in items]
        self.lengths = np.array([len(w) for w in items])
        self.least = np.maximum(1, np.ceil(MATCH * min_score * self.lengths - 1e-6)).astype(np.int64)
        features = np.concatenate([k for k, _ in self.kinds])
        order = np.argsort(features, kind="stable")
        self.item_of = np.repeat(np.arange(len(items)), [len(k) for k, _ in self.kinds])[order]
        self.count_of = np.concatenate([c for _, c in self.kinds])[order]
        self.first = np.searchsorted(features[order], np.arange(words + len(self.pairs) + 1))

    def parts(self, doc: np.ndarray) -> dict[int, list[list[int]]]:
        """Item to the parts of the document that can hold it."""
        if not len(doc):
            return {}
        pair = np.full(len(doc), -1)
        at = np.flatnonzero((doc[:-1] >= 0) & (doc[1:] >= 0))
        key = doc[at] * self.words + doc[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        same = self.pairs[place] == key
        pair[at[same]] = self.words + place[same]
        kinds, counts = np.unique(np.concatenate([doc[doc >= 0], pair[pair >= 0]]), return_counts=True)
        sizes = self.first[kinds + 1] - self.first[kinds]
        rows = np.repeat(self.first[kinds] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        total = np.bincount(self.item_of[rows], np.minimum(self.count_of[rows], np.repeat(counts, sizes)), len(self.lengths))
        found = {}
        for i in np.flatnonzero((total > 0) & (total + 1 >= self.least)):
            width = int(3 * self.lengths[i] - self.least[i])
            if len(doc) <= width:
                found[int(i)] = [[0, len(doc)]]
                continue
            kinds, counts = self.kinds[i]
            sums = np.concatenate(([0], np.cumsum(np.isin(doc, kinds).astype(np.int64) + np.isin(pair, kinds))))
            windows = np.flatnonzero(sums[width:] - sums[:-width] + 1 >= self.least[i])
            kept = [s for s in _merged([[int(a), int(a) + width] for a in windows]) if self._shared(np.concatenate([doc[s[0] : s[1]], pair[s[0] : s[1]]]), kinds, counts) + 1 >= self.least[i]]
            if kept:
                found[int(i)] = kept
        return found

    @staticmethod
    def _shared(features: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> int:
        own = features[np.isin(features, kinds)]
        return int(np.minimum(np.bincount(np.searchsorted(kinds, own), minlength=len(kinds)), counts).sum())


def _spans(doc: np.ndarray, item: np.ndarray, offsets: list[int]) -> list[list[int]]:
    """Parts of the document around the seeds, wide enough for insertions of half the item's length on either side."""
    reach = len(item) + len(item) // 2 + 8
    return [[max(0, o - len(item) // 2 - 8), min(len(doc), o + reach)] for o in set(offsets)]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, overlapping ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _holds_run(doc: np.ndarray, item: np.ndarray, offsets: list[int], min_run: int) -> bool:
    """Whether the pair has a run of ``min_run`` words: it lies on the diagonal of a seed, so this spares the alignment, never a guess."""
    for o in set(offsets):
        a, b = max(0, o), min(len(doc), o + len(item))
        equal = doc[a:b] == item[a - o : b - o]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
        if len(edges) and int((edges[1::2] - edges[::2]).max()) >= min_run:
            return True
    return False


def _best(doc: np.ndarray, item: np.ndarray, spans: list[list[int]]) -> tuple[int, int, int, int, int]:
    """Best alignment over the given parts of the document, and the longest run of any."""
    best, longest = None, 0
    for a, b in spans:
        score, matched, first, last, run = align(doc[a:b], item)
        longest = max(longest, run)
        if best is None or score > best[0]:
            best = (score, matched, a + first, a + last)
    return (*best, longest)


__all__ = ["LeakFinder", "Overlap", "align", "gram_hashes"]
