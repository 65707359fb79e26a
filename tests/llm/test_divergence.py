import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for lang, source, text in rows]
    df = Counter((lang, t) for lang, _, w in docs for t in set(w))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    counts = defaultdict(Counter)
    for lang, source, w in docs:
        for t in w:
            if df[lang, t] >= least:
                counts[lang, source][t] += 1
                counts[lang][t] += 1
    share = lambda c, v: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(v)) for t in v}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    groups, out = sorted({(lang, source) for lang, source, _ in docs}), []
    p = {g: share(counts[g], kept[g[0]]) for g in groups}
    for lang, source in groups:
        own, q = p[lang, source], share(counts[lang], kept[lang])
        pairs = [(sum(f(own[t], p[lang, s][t]) for t in kept[lang]), s) for g, s in groups if g == lang and s != source]
        terms = [(f(own[t], q[t]), t) for t in kept[lang] if counts[lang, source][t] and own[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, r + 1) for r, (v, item) in enumerate(found) if part == "pair" or r < top]
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(90)] + ["É", "ß", "日本", "a", "The"] * 3
    pick = lambda n, lo: " 7,".join(rng.choice(words[lo : lo + 60]) for _ in range(n))
    out = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "ü", None]), pick(rng.randint(0, 40), rng.randint(0, 40))) for _ in range(300)]
    return out + [("xx", "one", "lonely"), ("yy", "a", None), ("yy", "b", ""), ("en", "silent", "123"), ("en", "long", "a " * 60000 + "The")] + out[:20]


def test_equals_plain_sums(spark):
    for least, top in ((10, 10), (3, 2)):
        made = rows(least)
        df = spark.createDataFrame(made, "lang string, source string, text string").repartition(5).withColumns({"term": F.lit(1), "count": F.lit("x"), "n": F.lit(0)})
        got = sorted(tuple(r) for r in divergence.divergence(df, least_docs=least, top_terms=top).collect())
        assert got == plain(made, least, top)


def test_small_parts_and_large_numbers(spark, monkeypatch):
    """Tallies in small parts give the same, and so do keys that don't fit into one number."""
    rng = np.random.default_rng(2)
    lists = [[{"source": s, "count": int(rng.integers(1, 3)) * (10**12 if rng.random() < 0.1 else 1)} for s in "abcde" if rng.random() < 0.7] for _ in range(200)]
    batch = pa.RecordBatch.from_pylist([{"lang": "xy"[i % 2], "by_source": x} for i, x in enumerate(lists)])
    want = Counter()
    for i, x in enumerate(lists):
        want.update(("xy"[i % 2], a["source"], b["source"], a["count"], b["count"]) for k, a in enumerate(x) for b in x[k + 1 :])

    def tally():
        got = Counter()
        for b in divergence._tally(iter([batch])):
            for r in b.to_pylist():
                got[tuple(r.values())[:5]] += r["n"]
        return got

    assert tally() == want
    for name in ("PAIRS", "ROWS"):
        monkeypatch.setattr(divergence, name, 7)
        assert tally() == want


def test_exact_shares_of_large_counts(spark):
    n = 9_000_000_007
    df = spark.createDataFrame([(n * 1000, n * 5000, 3), (5, 10**13, 10**6), (0, 0, 0)], "c long, n long, v long")
    got = [r[0] for r in df.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n * 1000 + 2) // (n * 5000 + 6), 1 + 10**9 * 7 // (10**13 + 2 * 10**6), None]


def test_no_rows(spark):
    df = spark.createDataFrame([("en", "a", "x")], "lang string, source string, text string")
    assert divergence.divergence(df.limit(0)).collect() == []
    assert divergence.divergence(df).collect() == []
