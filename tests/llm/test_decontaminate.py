import random
import re

from strandlake.llm import decontaminate
from strandlake.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for v, own in windows.items():
            for i in range(len(w) - len(v) + 1):
                if tuple(w[i : i + len(v)]) == v:
                    hit |= set(range(i, i + len(v)))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def case():
    r = random.Random(2)
    vocab = ["the", "of", "a", "ÉT", "übér", "X1"] + [f"w{i}" for i in range(60)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([3, 10, 11, 25])))) for i in range(30)] + [(30, "solo"), (31, ""), (32, None), (None, "no id here"), (3, "again the same id"), (33, "the the the the the the the the the the the the")]
    docs = [(0, None), (1, ""), (2, "...!!"), (3, "Solo"), (None, "it is SOLO, no"), (4, "the " * 40), (5, "No  id-HERE")]
    for i in range(120):
        w = say(r.choice([0, 5, 50, 300]))
        for _ in range(r.choice([0, 1, 3])):
            source = words(r.choice(items)[1])
            lo = r.randrange(len(source) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = source[lo : lo + r.choice([9, 10, 30])]
        docs.append((10 + i, r.choice([" ", ", ", "\n"]).join(w)))
    return docs + docs[-4:], items


def check(spark):
    docs, items = case()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as spans").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = [(x.doc_id, x.n_words, x.n_hit, x.n_items, ",".join(x.item_ids), x.contaminated) for x in contamination(df, it).collect()]
    assert sorted(got, key=repr) == brute(docs, items)
    clean = contamination(df, it.limit(0)).collect()
    assert len(clean) == len(docs) and not any(x.contaminated for x in clean)
    assert contamination(df.limit(0), it).collect() == []


def test_equals_brute_force(spark):
    check(spark)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    check(spark)


def test_long_texts_and_rows_that_stay(spark):
    item = [f"q{i}" for i in range(400)]
    filler = " ".join(f"w{i % 977}" for i in range(300_000))
    docs = [(1, f"{filler} {' '.join(item[50:70])} {filler}"), (2, f"{filler} {' '.join(item[50:59])} {filler}"), (3, None), (3, ""), (None, "..."), (4, "x" * 500_000), (4, "x" * 500_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'a' as spans", "2 as n_words", "3 as item_ids")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "x" * 500_000)], "item_id long, text string")
    got = {(x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids)) for x in contamination(df, items).collect()}
    assert got == {(1, 600_020, 20, ("1",)), (2, 600_009, 0, ()), (3, 0, 0, ()), (None, 0, 0, ()), (4, 1, 1, ("2",))}
    kept = decontaminate.uncontaminated(df, items)
    assert kept.schema == df.schema and sorted((x.doc_id or 0, len(x.text or "")) for x in kept.collect()) == [(0, 3), (2, len(docs[1][1])), (3, 0), (3, 0)]
    assert decontaminate.uncontaminated(df, items.limit(0)).count() == len(docs)
    assert decontaminate.uncontaminated(df.limit(0), items).collect() == []


def test_a_full_block_of_items_fits_on_the_driver():
    """The index of BLOCK_BYTES of items, but for its counts, while it is made; numpy's memory is traced."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50_000)]
    texts, size = [], 0
    while size < decontaminate.BLOCK_BYTES:
        texts.append(" ".join(words[i] for i in rng.integers(0, 50_000, 60)))
        size += len(texts[-1])
    tracemalloc.start()
    index, hashes = decontaminate.windows_of([str(i) for i in range(len(texts))], texts, 10, 3)
    known = np.unique(np.concatenate([np.unique(m) for _, _, m in decontaminate._shingles(index, hashes)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(known) > 500_000 and peak < 400 << 20, peak >> 20
