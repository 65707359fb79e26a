import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strandlake.llm import langid, pii, queries, store, tokens


def sets(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    """Distinct rows (id, text) that are first of their group, by id and with those without one last."""
    rows = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))
    own, top = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= 80 * len(own[i] | own[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {rows[i] for i in range(len(rows)) if find(i) == i}


def test_near_duplicates_by_row(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(90)) for _ in range(40))
    one, two, three, four = text(), text(), text(), text()
    near = one.rsplit(" ", 1)[0] + " end"
    rows = [(11, five := text()), (11, five + " more"), (12, text()), (12, text()), (1, one), (7, near), (7, two), (7, two), (2, text()), (None, three), (None, three.upper()), (None, two + " more"), (9, four), (None, four), (3, ""), (4, None), (5, ""), (None, None), (6, "One"), (8, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as row", "2 as copy", "doc_id as id", "3 as doc")
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = [(x.doc_id, x.text) for x in out.collect()]
    ties = {(None, three), (None, three.upper()), (11, five), (11, five + " more")}  # one id, one group: either may stand for both
    want = brute(rows)
    assert len(got) == len(want) and len(ties & set(got)) == len(ties & want) == 2
    assert set(got) - ties == want - ties
    assert sum(k == 11 for k, _ in got) == 1 and sum(k == 12 for k, _ in got) == 2
    assert (7, two) in got and (7, near) not in got and (None, four) not in got
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").collect() == []


SF = "/root/testdata/sf0.001"
EXTRA = ["1 as n", "'x' as row", "2 as copy", "3 as kept_id", "4 as id", "5 as doc", "'s' as spans", "'i' as item_ids", "'l' as lang_pred", "6 as score", "7 as text_", "8 as text_hash", "9 as n_words"]
DE = "der hund und die katze gehen am abend in das haus und schlafen dort bis der morgen kommt "
EN = "the dog and the cat walk to the house in the evening and sleep there until the morning comes "


def odd_rows():
    r = random.Random(9)
    words = (DE + EN).split()
    say = lambda n: " ".join(r.choice(words) + r.choice("abcdefgh") * r.randrange(2) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "  "), (4, "12 34"), (None, say(60)), (None, None), (5, long := say(30_000)), (5, long), (6, long + " end"), (7, say(50)), (7, say(50)), (8, f"mail a.b@c.org or 1.2.3.4 {say(30)}"), (9, "é" * 20)]
    item = "one two three four five six seven eight nine ten eleven"
    return rows + [(10, f"{say(30)} {item} {say(20)}"), (11, say(40)), (11, say(40))], [(1, item), (None, None), (2, "")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows, items = odd_rows()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, ["de", "en"][k % 2]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string").selectExpr("*", "cast(length(text) as int) as n_chars", *EXTRA)
    return docs, folder


def rows_of(df):
    return Counter((x.doc_id, x.text) for x in df.collect())


def test_stages_keep_columns_and_take_odd_rows(spark, odd):
    docs, folder = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert corpus_pipeline.packed(spark, docs.limit(0), folder).collect() == []
    have = rows_of(docs)
    letters = Counter({k: n for k, n in have.items() if k[1] and any(c.isalpha() for c in k[1])})
    kept = rows_of(corpus_pipeline.language(spark, docs, folder))
    assert kept <= letters and all(k in kept for k in letters if len(k[1].split()) > 25)
    assert rows_of(corpus_pipeline.benchmark_free(spark, docs, folder)) == Counter({k: n for k, n in have.items() if k[0] != 10})
    finder = pii.Finder(*pii.train())
    clean = lambda t: t and pii.redacted(t, finder.find(t)[1])
    out = corpus_pipeline.private(spark, docs, folder)
    assert rows_of(out) == Counter({(i, t): sum(n for (k, u), n in have.items() if k == i and clean(u) == t) for i, t in {(i, clean(t)) for i, t in have}})
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in out.collect())
    assert any(t and "[EMAIL]" in t and "[IP]" in t for _, t in rows_of(out))


def test_run_equals_its_parts(spark, odd):
    """The whole pipeline against plain versions of its stages, on a folder of its own."""
    docs, folder = odd
    docs.write.parquet(f"{folder}/documents.parquet")
    model = langid.fit(docs)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    import pyarrow as pa

    lang, score = langid.predict_rows(model, *langid.features(pa.array([t for _, t in rows], pa.string())))
    rows = [x for x, p, s in zip(rows, lang, score, strict=True) if p != "und" and s >= corpus_pipeline.LEAST_SCORE]
    rows = [x for x in brute(rows) if "one two three four five six seven eight nine ten" not in x[1]]
    finder, encode = pii.Finder(*pii.train()), Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json")).encode
    want = Counter()
    for i, t in rows:
        want[i, tuple(encode(pii.redacted(t, finder.find(t)[1]), add_special_tokens=False).ids + [1])] += 1
    pieces = {}
    got = Counter()
    for p in corpus_pipeline.run(spark, folder).orderBy("doc_id", "doc_tokens", "start").collect():
        held = pieces.setdefault((p.doc_id, p.doc_tokens), [])
        held += np.frombuffer(p.ids, dtype="<u4").tolist()
        if len(held) == p.doc_tokens:
            got[p.doc_id, tuple(pieces.pop((p.doc_id, p.doc_tokens)))] += 1
    assert got == want and not pieces


def test_scratch_goes(spark, tmp_path):
    df = spark.range(10)
    with store.scratch(spark):
        inside = store.written(df, "inside")
        outside = store.written(inside, "outside", str(tmp_path / "kept"))
        place = inside.inputFiles()[0].removeprefix("file:").removeprefix("//")
    import os

    assert not os.path.exists(place) and outside.count() == 10
    store.delete(outside, outside, df)
    assert not os.path.exists(tmp_path / "kept")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_digest_columns_of_queries(spark):
    """What the queries without SQL make of their operators' outputs."""
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encode = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json")).encode
    ids = {i: encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    for p in queries.op2(spark, SF).collect():
        own = ids[p.doc_id] + [1]
        assert p.doc_tokens == len(own) and p.ids_crc32 == crc(own[p.start : p.start + p.length])
    at = 0
    for p in queries.op6(spark, SF).orderBy("doc_id").collect():
        assert (p.start, p.n_tokens, p.ids_crc32) == (at, len(ids[p.doc_id]) + 1, crc(ids[p.doc_id] + [2]))
        at += p.n_tokens
    finder = pii.Finder(*pii.train())
    import hashlib

    for p in queries.op5(spark, SF).collect():
        base, every = finder.find(docs[p.doc_id])
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert p.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest() and p.spans == text(every)
        assert [p[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    lengths = {p.doc_id: p.n_bytes for p in queries.op7(spark, SF).collect()}
    assert lengths == {i: len(t.encode()) for i, t in docs.items()}
    rows = queries.op9(spark, SF).collect()
    assert {p.doc_id for p in rows} == set(docs) and all(p.held_out == (zlib.crc32(str(p.doc_id).encode()) % 4 == 2) for p in rows)
    rows = queries.op1(spark, SF).collect()
    assert len(rows) == len(docs) and 0 < sum(p.selected for p in rows) < len(docs)
