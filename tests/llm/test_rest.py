import math
import random

import numpy as np

from strandlake.llm import chat, importance, vectors


def brute_vectors(rows, cosine=0.95):
    ok = []
    for i, v in rows:
        good = i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        ok.append(np.array(v) / np.linalg.norm(v) if good else None)
    n, links, top = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(n):
        for b in range(n):
            if a != b and ok[a] is not None and ok[b] is not None and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                links[a] += 1
                top[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        c = None if i is None else min(rows[b][0] for b in range(n) if find(b) == find(a) and rows[b][0] is not None)
        out.append((i, links[a], c, i is None or i == c))
    return sorted(out, key=repr)


def vector_case():
    r = np.random.default_rng(4)
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [float("nan")] + [1.0] * 63), (5, [None] + [1.0] * 63), (6, [float("inf")] * 64), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, [1.0, 2.0])]
    for _ in range(40):
        base = r.standard_normal(64)
        for _ in range(r.integers(1, 9)):
            rows.append((len(rows) + 10, (base + r.choice([0, 0.1, 0.2, 0.28]) * r.standard_normal(64)).tolist()))
    return rows + rows[-3:] + [(9, rows[-1][1]), (9, (np.array(rows[-1][1]) * 3).tolist())]


def test_vectors_equal_brute_force(spark, monkeypatch):
    rows = vector_case()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as sig", "2 as n")
    got = sorted((tuple(x) for x in vectors.near_vectors(df).collect()), key=repr)
    assert got == brute_vectors(rows)
    monkeypatch.setattr(vectors, "TILE", 20)
    monkeypatch.setattr(vectors, "PART", 2)
    got = sorted((tuple(x) for x in vectors.near_vectors(df).collect()), key=repr)
    assert got == brute_vectors(rows)
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_ties_at_the_threshold_and_huge_values(spark):
    a = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, a), (2, [0.6, 0.8, 0.0, 0.0]), (3, [6e200, 8e200, 0.0, 0.0]), (4, [6e-200, 8e-200, 0.0, 0.0]), (5, [0.59, 0.807, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectors.near_vectors(df, cosine=0.6).collect()}
    assert got == {1: (3, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (3, 1)}
    assert vectors.near_vectors(df, cosine=0.6).where("vec_id = 1 and n_links = 3").count() == 1


def test_parts_lose_no_near_pair(monkeypatch):
    monkeypatch.setattr(vectors, "PART", 8)
    r = np.random.default_rng(1)
    z = np.concatenate([r.normal(0, 0.1, (700, 8)), np.repeat(r.normal(0, 0.1, (3, 8)), 90, axis=0)]).astype(np.float32)
    own, other = np.arange(0, len(z), 2), np.arange(len(z))
    got = {(int(h), int(a)) for o, t in vectors._parts(z, own, other, 0.02) for h in o for a in t}
    near = ((z[own][:, None] - z[other]) ** 2).sum(axis=2) <= 0.02
    assert {(int(own[i]), int(other[j])) for i, j in zip(*np.nonzero(near))} <= got and len(got) < 0.8 * len(own) * len(other)


def test_vectors_are_shuffled_and_written_once_however_many_tiles(spark, monkeypatch):
    """Copies of a vector used to grow with the number of tiles; now only pairs of tiles do."""
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((300, 16)))]
    rows += [(300 + i, (np.array(v) + 0.01 * r.standard_normal(16)).tolist()) for i, v in rows[:60]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sizes, written = {}, vectors.written
    monkeypatch.setattr(vectors, "written", lambda t, name: sizes.update({name: t.count()}) or written(t, name))
    monkeypatch.setattr(vectors, "TILE", 16)
    got = sorted((tuple(x) for x in vectors.near_vectors(df).collect()), key=repr)
    assert got == brute_vectors(rows)
    assert 10 < sizes["vector-tiles"] <= vectors.tiles(len(rows))


def test_chat_round_trip(spark):
    r = random.Random(1)
    odd = ["", None, "\\### Assistant: </turn> ok", "<turn:user>\nx</turn>\n", "\\l\\b\\g<>\\", "é漢\n\n", "a" * 50000]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a>\nb<"]), r.choice(odd)) for c in [1, 2, 3, None] for t in range(6)]
    rows += [(9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (9, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as piece", "2 as at", "3 as conv")
    out = chat.format_chat(df)
    got = {x.conv_id: x for x in out.select("conv_id", "n_turns", "formatted", chat.read_chat(out.formatted).alias("turns"), chat.masked_text(out.formatted, out.loss_mask).alias("loss")).collect()}
    for c in {x[0] for x in rows}:
        own = sorted(((t if t is not None else -1, role or "", text or "") for conv, t, role, text in rows if conv == c), key=lambda x: x[0])
        assert got[c].n_turns == len(own)
        assert sorted((a.role, a.text) for a in got[c].turns) == sorted(x[1:] for x in own)
        if c != 9:
            assert [(a.role, a.text) for a in got[c].turns] == [x[1:] for x in own]
            assert got[c].loss == "".join(text for _, role, text in own if role == "assistant")
    assert [(a.role, a.text) for a in got[9].turns] == [("user", "first"), ("assistant", "same"), ("assistant", "same")]
    assert chat.format_chat(df.limit(0)).collect() == []


def test_chat_parts(spark):
    parts = [("text", "see <b>", None, None), ("image", None, "i.png", 4), ("text", " and ", None, None), ("audio", None, "a.wav", 10), ("document", None, "d.pdf", None), ("text", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    r = chat.format_chat(df, parts_col="parts").first()
    assert r.formatted == "<turn:user>\nsee \\lb\\g<image/> and <audio/><document/></turn>\n<turn:assistant>\nok</turn>\n<turn:user>\n</turn>\n"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "i.png", 1024), (0, "audio", "a.wav", 250), (0, "document", "d.pdf", 800)]
    assert [r.formatted[m.start : m.start + m.length] for m in r.loss_mask] == ["ok"]


def test_resampling(spark, monkeypatch):
    r = random.Random(7)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(r.choices(good if i % 2 else bad, k=20))) for i in range(400)] + [(500, None), (501, "..."), (None, "g1 g2"), (7, "g1 g2 g3 g4"), (502, "g1 " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as log_weight").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(importance, "FEW", 5)
    out = importance.resample(df, labels, share=0.25).collect()
    assert len(out) == len(rows)
    words = lambda t: [w for w in (t or "").replace(".", " ").split()]
    with_words = [x for x in out if x.log_weight is not None]
    assert len(with_words) == sum(bool(words(t)) for _, t in rows)
    keys = sorted((x.gumbel_key for x in with_words), reverse=True)
    cut = keys[math.ceil(0.25 * len(keys)) - 1]
    assert all(x.selected == (x.gumbel_key is not None and x.gumbel_key >= cut) for x in out)
    assert np.mean([x.doc_id % 2 for x in out if x.selected and x.doc_id is not None and x.doc_id < 400]) > 0.9
    again = {(x.doc_id, x.gumbel_key) for x in importance.resample(df.repartition(5), labels, share=0.25).collect()}
    assert again == {(x.doc_id, x.gumbel_key) for x in out}
    assert importance.resample(df.limit(0), labels).collect() == []


def test_weights_equal_plain_counts(spark):
    rows = [(1, "a b a"), (2, "b c"), (3, "C c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.log_weight for x in importance.resample(df, labels).collect()}
    grams = {i: (w := t.lower().split()) + [tuple(p) for p in zip(w, w[1:])] for i, t in rows}
    raw, own, b = [g for v in grams.values() for g in v], grams[1], importance.BUCKETS
    for i, g in grams.items():
        want = sum(math.log((own.count(x) + 1) / (len(own) + b)) - math.log((raw.count(x) + 1) / (len(raw) + b)) for x in g)
        assert abs(got[i] - want) < 1e-9
