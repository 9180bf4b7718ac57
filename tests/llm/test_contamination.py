import random

import numpy as np
import pytest

from thermocline.llm import contamination
from thermocline.llm.contamination import GAP, MATCH, MISMATCH, LeakFinder, Overlap, align
from thermocline.llm.text import words

DOCS, ITEMS = "doc_id long, text string, item_id string, words string", "item_id string, prompt string, text string"


def classic(doc, item):
    h = np.zeros((len(item) + 1, len(doc) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if item[i - 1] == doc[j - 1] else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return int(h.max())


def longest(doc, item):
    best = 0
    for i in range(len(item)):
        for j in range(len(doc)):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_alignment_against_the_textbook():
    rnd = np.random.RandomState(0)
    for _ in range(60):
        doc, item = rnd.randint(0, 4, rnd.randint(1, 25)), rnd.randint(0, 4, rnd.randint(1, 15))
        score, _, first, last, run = align(doc, item)
        assert score == classic(doc, item) and run == longest(doc, item)
        assert 0 <= first <= last < len(doc)


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of"] * 30
    items = [(f"i{k}", " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 13, 30, 50])))) for k in range(12)]
    items[3] = ("i3", items[2][1] + " more words of its own")  # shares a passage
    docs = []
    for d in range(150):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 5, 80]))]
        if d % 3 == 0:
            w = items[rnd.randrange(12)][1].split()
            n = rnd.choice([11, 12, 13, 14, 40])
            a = rnd.randrange(max(1, len(w) - n + 1))
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w[a : a + n]
        docs.append((d, "\n> ".join([" ".join(text[:20]), " ".join(text[20:])]).upper()))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 25, 400])
def test_every_passage_is_found(spark, block_bytes):
    docs, items = corpus()
    truth = {(d, i) for d, t in docs for i, p in items if longest(words(t), words(p)) >= 13}
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs] + [(0, docs[0][1], "x", "y"), (None, docs[0][1], "", ""), (999, None, "", ""), (998, "", "", "")], DOCS)
    it = spark.createDataFrame([(*x, "t") for x in items] + [(*items[0], "t"), (None, items[0][1], ""), ("nul", None, ""), ("empty", "", "")], ITEMS)
    found = LeakFinder(block_bytes=block_bytes).find(df, it).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["longest_run"] >= 13} == truth
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})
    exact = {(d, i): longest(words(t), words(p)) for d, t in docs for i, p in items}
    assert all(r["longest_run"] == exact[r["doc_id"], r["item_id"]] for r in found if r["longest_run"] >= 13)


def test_edited_copies_are_scored(spark):
    item = " ".join(f"a{i}" for i in range(40)).split()
    edited = [w if i % 9 else "changed" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "x " * 50 + " ".join(edited) + " y" * 50), (2, "x " * 100)], "doc_id long, text string")
    got = LeakFinder().find(docs, spark.createDataFrame([("i", " ".join(item))], "item_id string, prompt string")).collect()
    assert [(r["doc_id"], r["longest_run"]) for r in got] == [(1, 8)]
    assert got[0]["score"] > 0.6 and got[0]["first_word"] >= 49 and got[0]["last_word"] <= 91


def test_edited_copies_beside_an_exact_one(spark):
    item = " ".join(f"a{i}" for i in range(40)).split()
    ninth, fifth = ([w if i % n else "changed" for i, w in enumerate(item)] for n in (9, 5))
    spaced = [x for w in item for x in ([w, "um"] if int(w[1:]) % 2 else [w])]
    texts = [(1, ninth), (2, item), (3, fifth), (4, spaced), (5, item[::-1]), (6, item[:12])]
    docs = spark.createDataFrame([(d, "x " * 300 + " ".join(w) + " y" * 300) for d, w in texts], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join(item))], "item_id string, prompt string")
    got = {r["doc_id"]: r for r in LeakFinder().find(docs, items).collect()}
    assert {d: (r["longest_run"], round(r["score"] * 80)) for d, r in got.items()} == {1: (8, 2 * 35 - 4), 2: (40, 80), 3: (4, 2 * 32 - 7), 4: (2, 2 * 40 - 19)}
    assert all(r["first_word"] >= 300 and r["last_word"] < 300 + len(dict(texts)[d]) for d, r in got.items())
    assert [r["doc_id"] for r in LeakFinder().passages(docs, items).collect()] == [2]


@pytest.mark.parametrize("min_score", [0.3, 0.5, 0.8])
def test_no_pair_above_the_score_is_passed_over(min_score):
    rnd = np.random.RandomState(3)
    reached = 0
    for k in range(250):
        items = [rnd.randint(0, 8, rnd.randint(6, 16)) for _ in range(3)]
        doc = rnd.randint(-1, 8, rnd.randint(1, 60))
        if k % 2:
            copy = np.array([x if rnd.rand() > k % 4 * 0.08 else -1 for x in items[0] for _ in range(rnd.choice([0, 2] + [1] * (4 if k % 4 > 1 else 30)))], int)
            at = rnd.randint(0, len(doc) + 1)
            doc = np.concatenate([doc[:at], copy, doc[at:]])
        parts = Overlap(items, 8, min_score).parts(doc)
        for i, item in enumerate(items):
            best = classic(doc, item)
            if best >= min_score * MATCH * len(item):
                reached += 1
                assert max(align(doc[a:b], item)[0] for a, b in parts[i]) == best
    assert reached > 30


def test_empty_tables_and_very_long_texts(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("i", "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id string, prompt string")
    assert LeakFinder().find(docs, items).count() == 0
    long_text = "filler " * 300_000 + "One, two three four five six seven eight nine ten eleven twelve thirteen! " + "filler " * 10
    docs = spark.createDataFrame([(1, long_text)], "doc_id long, text string")
    assert [(r["doc_id"], r["longest_run"]) for r in LeakFinder().find(docs, items).collect()] == [(1, 13)]
    assert LeakFinder().find(docs, items.limit(0)).count() == 0


def test_seeds_cover_every_window():
    grams = {"i": np.arange(30, dtype=np.uint64)}
    finder = LeakFinder(min_run=13, seed_words=6)
    hashes, _, places = finder._seeds(["i"], grams, {k: 1 + k % 5 for k in range(30)})
    chosen = set(places.tolist())
    assert all(chosen & set(range(a, a + 8)) for a in range(30 - 8 + 1)) and len(chosen) < 30
    # n-grams that no document has are no seeds
    assert finder._seeds(["i"], grams, {4: 9})[2].tolist() == [4]
    assert contamination.gram_hashes(["a"] * 3, 6).size == 0 and len(hashes) == len(places)
