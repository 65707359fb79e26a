import random
import re

import numpy as np
import pytest

from strandlake.llm import minhash
from strandlake.llm.minhash import near_duplicates


def brute(rows, k=4, percent=80):
    sets = []
    for _, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", folded)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if key is not None else None
        out.append((key, len(sets[i]), c, key is None or key == c))
    return sorted(out, key=repr)


def case():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Éa", "ßx", "A", "B"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "a b c d"), (7, "a b c d e f g h i j"), (7, "other text with the same id here"), (None, "a b c d"), (8, "x " * 5000)]
    for g in range(30):
        base = [r.choice(vocab) for _ in range(r.choice([5, 12, 60, 300]))]
        for _ in range(r.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((len(rows) + 10, r.choice([" ", "\n", "  "]).join(copy)))
    return rows + rows[-3:]


#: Sizes of the program as it is, and so small that nodes branch, stop and are cut into tiles on a few rows.
@pytest.mark.parametrize("sizes", [{}, {"SMALL": 2, "TILE": 4, "PIVOTS": 1, "STARS": 2}, {"SMALL": 1, "TILE": 1 << 20, "TILE_SHINGLES": 300, "LEVELS": 2}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(minhash, name, value)
    rows = case()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as sig", "2 as component_id")
    got = sorted((tuple(x) for x in near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs at a similarity of 0.80 to 0.82, all sets sharing a passage so that nodes are large and branch."""
    rows, n = [], 1500
    for i in range(n):
        m = 24 + i % 3
        both = [f"p{j}" for j in range(12)] + [f"b{i}x{j}" for j in range(m)]
        for side in "uv":  # 36 to 38 words in both, 4 of its own: 36/44 = 0.818, and with 4.5 on average 0.80
            rows.append((len(rows), " ".join(both + [f"{side}{i}x{j}" for j in range(4 + (side == "u" and m == 24))])))
    monkeypatch.setattr(minhash, "SMALL", 16)
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    near = [i for i in range(n) if 0.8 <= (36 + i % 3) / (44 + i % 3 + (i % 3 == 0)) <= 0.83]
    assert len(near) == n and sum(got[2 * i + 1] == 2 * i for i in near) >= 0.999 * n
    assert all(got[2 * i] == 2 * i for i in range(n))


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 64)
    r, base = random.Random(11), [f"w{j}" for j in range(200)]
    rows = []
    for i in range(1200):  # each a text of its own, near the first; a chain leads from them to some that are not
        words = list(base)
        for j in r.sample(range(200), 2):
            words[j] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + s, " ".join([f"z{j}" for j in range(6 * s)] + base[6 * s :])) for s in range(12)] + [(3000, "quite another text than all of these")]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    assert {c for i, c in got.items() if i != 3000} == {0} and got[3000] == 3000


def test_very_long_texts(spark):
    r = random.Random(12)
    words = [f"w{r.randrange(50000)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:199_000], "end"])), (3, " ".join(words[:100_000])), (4, "x" * 1_000_000), (5, "x" * 1_000_000)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)})
    assert [got[i][1] for i in range(1, 6)] == [1, 1, 3, 4, 4]


def test_pivots_equal_all_pairs():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)] + [np.unique(np.append(np.arange(100, 130), r.integers(130, 134, 3)).astype(np.uint64)) for _ in range(60)]
    n = np.array([len(x) for x in sets])
    a, b = np.triu_indices(len(sets), 1)
    forests = []
    for pivots in (0, 1, 8, 1000):
        forest = minhash._Forest()
        minhash.PIVOTS, kept = pivots, minhash.PIVOTS
        edges = list(minhash.verified(sets, n, a, b, 50, forest))
        minhash.PIVOTS = kept
        assert all(2 * len(np.intersect1d(sets[x], sets[y])) >= len(np.union1d(sets[x], sets[y])) for x, y in edges)
        forests.append([forest.top(i) for i in range(len(sets))])
    assert forests[0] == forests[1] == forests[2] == forests[3]
