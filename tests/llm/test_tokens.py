import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm import idfile, packing, tokencount
from strandlake.llm import tokens
from strandlake.llm.tokens import WordEncoder, encoder, tokenizer_path

WORDS, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["", "   ", "a\x0bb\x0cc", "É  x y", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "<|ENDOFTEXT|>", "éx", "ΑΣ Σ", "\x1cq\x1d", "it's we're 123 ½ ²", "漢字 テ", "a\x85b", "İstanbul ﬁ ŉ", "Ünï.,ço!!dé 'S ''s", "a" * 3000]


def rows():
    r = random.Random(5)
    vocab = ["the", "of", "Thnter", "ÉTION", "über", "x1y2", "a.b,", "(q)", "—"] + ["".join(r.choices("abcdefgh", k=7)) for _ in range(300)]
    texts = [*ODD, None] + [" ".join(r.choices(vocab, k=r.choice([1, 30, 700, 3000]))) for _ in range(60)]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, "repeated id"), (5, "repeated id"), (6000, "x y " * 40000)]


def ids_of(text, end):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_library():
    texts = [t for _, t in rows()]
    e = WordEncoder(WORDS)
    assert e.by_word
    ids, at = e.encode(pa.array(texts), 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(t, 1), repr(t)[:80]


def test_encoder_of_another_kind():
    path = tokenizer_path("byte_bpe_50k.json")
    e, texts = WordEncoder(path), ["a b", None, "x  y\n z"]
    assert not e.by_word
    ids, at = e.encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(3)] == [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]


def test_memory_of_words_starts_anew(monkeypatch):
    texts = [t for _, t in rows()]
    want = WordEncoder(WORDS).encode(pa.array(texts))[0].tolist()
    monkeypatch.setattr(tokens, "WORDS_KEPT", 40)
    e = WordEncoder(WORDS)
    for lo in range(0, len(texts), 7):
        e.encode(pa.array(texts[lo : lo + 7]))
    assert e.encode(pa.array(texts))[0].tolist() == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abzABZ019 .,'-\n\t<|>éÉßøæœ½²İŉΣσ漢テ\u0301\x1c\x85\xa0\xad", max_size=30) | st.text(max_size=20), max_size=6))
def test_encoder_equals_library_on_odd_texts(texts):
    e = encoder(WORDS)
    ids, at = e.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_covers_every_id(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as start").repartition(3)
    got = packing.pack(df, WORDS).collect()
    want = sorted(tuple(ids_of(t, 1)) for _, t in rows())
    total = sum(map(len, want))
    sequences, docs = {}, {}
    for p in got:
        assert p.length == len(p.ids) // 4 > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.ids))
    assert sum(p.length for p in got) == total
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    single = {i: t for i, t in rows() if i not in (None, 5)}
    for (doc, n), pieces in docs.items():
        if doc in single:
            ids = np.frombuffer(b"".join(x for _, x in sorted(pieces)), dtype="<u4").tolist()
            assert ids == ids_of(single[doc], 1) and len(ids) == n
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


def test_packer_bounds_its_memory(monkeypatch):
    monkeypatch.setattr(packing, "RUN_IDS", 33 * 500)
    out = []
    p = packing.SquaresPacker(64, out.append)
    for i in range(20000):
        p.add(i, np.zeros(33, dtype=np.uint32))
        assert p.counts.sum() <= 501
    p.close()
    assert sum(len(x[2]) for w in out for x in w) == 33 * 20000
    fills = [sum(len(x[2]) for x in w) for w in out]
    assert all(f == 64 or f & (f - 1) == 0 for f in fills) and sum(f != 64 for f in fills) <= 6


@pytest.mark.parametrize("sizes", [[5, 7, 11, 33], [33], [1, 31, 32, 63], [20, 21, 22, 23]])
def test_placement_equals_brute_force(sizes):
    """The least sum of squares over all levels that the piece fits on, a lower level before a higher one."""
    r, out, levels = random.Random(len(sizes)), [], {}
    p = packing.SquaresPacker(64, out.append)
    for i in range(600):
        size, best = r.choice(sizes), None
        for level in [0, *sorted(levels)]:
            if level + size <= 64:
                after = dict(levels)
                if level:
                    after[level] -= 1
                if level + size < 64:
                    after[level + size] = after.get(level + size, 0) + 1
                total = sum(n * n for n in after.values())
                if best is None or total < best[0]:
                    best = total, {k: n for k, n in after.items() if n}
        levels = best[1]
        p.add(i, np.zeros(size, dtype=np.uint32))
        assert {k: int(n) for k, n in enumerate(p.counts) if n} == levels
    assert all(sum(len(x[2]) for x in w) == 64 for w in out)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_segment_round_trip(planes):
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 1000, 70_001):
        ids = r.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (idfile.decode_segment(*idfile.encode_segment(ids, planes, 4096), n, planes, 4096) == ids).all()


def test_id_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "SEGMENT_IDS", 5000)
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "'x' as shard").repartition(3)
    idfile.write_ids(df, str(tmp_path / "ids"), WORDS)
    got = idfile.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    ids = [x.doc_id for x in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == len(rows())
    at = 0
    for x in got:
        assert x.start == at and x.n_tokens == len(x.ids) // 4
        at += x.n_tokens
    assert sorted(zlib.crc32(x.ids) for x in got) == sorted(crc(ids_of(t, 2)) for _, t in rows())
    idfile.write_ids(df.limit(0), str(tmp_path / "none"), WORDS)
    assert idfile.read_ids(spark, str(tmp_path / "none")).collect() == []


def test_token_counts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    long = " ".join(t for _, t in rows() if t)
    data = [*rows(), (999, long), (998, "no boundary" + "é-" * 90000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted(map(tuple, tokencount.token_counts(df, PIECES).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in data]
    assert got == sorted(want, key=repr)
    got = sorted(map(tuple, tokencount.token_counts(df, WORDS).collect()), key=repr)
    assert got == sorted([(i, len((t or "").encode()), n := len(ids_of(t, 0)) - 1, n > 4096) for i, t in data], key=repr)
    assert tokencount.token_counts(df.limit(0), PIECES).collect() == []
