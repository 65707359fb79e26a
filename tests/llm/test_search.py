import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, k):
    """(place of the item, rank, id, score), each document against each item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for j, (_, text) in enumerate(items):
        own = []
        for i, c in counts:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total))) for t in terms(text) if c[t])
            own += [(-score, (i is not None, i), i)] if score > 0 else []
        out += [(j, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(own, key=lambda x: x[:2])[:k])]
    return out


@pytest.mark.parametrize("k", [1, 20])
def test_equals_brute_force(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)] + ["É", "ß7", "THE", "of"] * 20
    pick = lambda n: " ".join(rng.choice(words[: rng.randint(5, len(words))]) for _ in range(n))
    docs = [(i, pick(rng.randint(0, 60))) for i in range(400)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(200)] + [(7, docs[3][1]), (None, docs[3][1]), (5000, None), (5001, ""), (5002, "the of " * 40000 + "w299")]
    items = [(i, pick(rng.randint(1, 25))) for i in range(30)] + [(3, docs[3][1]), (40, ""), (41, None), (42, "nothing known"), (43, "w299 w299 w299 the")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns({"score": F.lit("x"), "item": F.lit(1)})
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.item_id, r["rank"], r.doc_id if r.doc_id is not None else -1, r.score) for r in lexical.ranked_search(df, it, k).collect())
    want = sorted((items[j][0], r, i if i is not None else -1, s) for j, r, i, s in plain(docs, items, k))
    assert got == want


def test_blocks_and_names(spark, monkeypatch):
    docs = [(f"d{i}", f"alpha w{i % 5} beta{i % 3}") for i in range(60)]
    items = [(f"q{i}", f"w{i % 5} beta{i % 3} alpha") for i in range(12)]
    args = spark.createDataFrame(docs, "id string, body string"), spark.createDataFrame(items, "q string, body string")
    run = lambda: sorted(tuple(r) for r in lexical.ranked_search(*args, 4, "id", "body", "q", "body").collect())
    whole = run()
    assert whole == sorted((items[j][0], r, i, s) for j, r, i, s in plain(docs, items, 4))
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 60)
    assert run() == whole


def test_terms_are_pruned_but_nothing_is_lost():
    """Seeds from kth impacts leave out frequent terms, and the best documents stay the same."""
    item, term, times = np.zeros(3, np.int64), np.arange(3), np.ones(3, np.int64)
    s = lexical.search_of(item, term, times, 1, 3, np.array([9000, 50, 10]), np.array([800, 800, 800]), np.array([700, 1, 1]))
    assert s.seed.tolist() == [6_300_000]
    best = lexical.Ranking(s, 2)
    assert best.by_term[0].tolist() == [0] and best.others.tolist() == [60 * 800]


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items), (docs, items.withColumn("text", F.lit("zz")))):
        out = lexical.ranked_search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
