"""FASTQ in ranges, and file order as a key."""

import gzip
import io
import random

import numpy as np
import pytest

from strandlake.operators import sources_lr
from strandlake.sources import fastq, text_formats


def fastq_text(rng, n):
    out, good = [], []
    for i in range(n):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 7, 200])))
        qual = "".join(rng.choice("@+!I~") for _ in seq)
        qual = "@" + qual[1:] if i % 3 == 0 and qual else qual
        if i % 17 == 5:
            out += [f"@bad{i}", "ACGT", "no plus", "IIII"]
        elif i % 17 == 6:
            out += [f"@short{i}", "ACGT", "+", "@@"]
        elif i % 17 == 7:
            out += ["", "junk"]
        out += [f"@r{i} a comment" if i % 2 else f"@r{i}", seq, "+" + ("again" if i % 5 == 0 else ""), qual]
        good.append((f"r{i}", "a comment" if i % 2 else "", seq, qual))
    return out, good


def test_fastq_ranges(spark, tmp_path):
    lines, good = fastq_text(random.Random(5), 300)
    data = "\n".join(lines) + "\n"
    (tmp_path / "a.fastq").write_text(data)
    (tmp_path / "b.fq").write_text("\r\n".join(lines))
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(data.encode()))
    read = lambda at, n: sorted(map(tuple, text_formats.fastq(spark, str(tmp_path / at), n).collect()))
    for n in (len(data), len(data) // 7, 1000):
        assert read("a.fastq", n) == sorted(good)
    assert read("b.fq", 3000) == read("c.fq.gz", 3000) == sorted(good)
    assert read("", 5000) == sorted(good * 3)


@pytest.mark.parametrize("seed", range(4))
def test_any_two_ranges_share_no_record_and_lose_none(seed, monkeypatch):
    monkeypatch.setattr(fastq, "CHUNK_BYTES", 61)
    data = "\n".join(fastq_text(random.Random(seed), 40)[0]).encode()
    whole = list(fastq.records(io.BytesIO(data), 0, None))
    rng = np.random.default_rng(seed)
    for _ in range(30):
        cuts = [0, *sorted(set(rng.integers(1, len(data), 4).tolist()))]
        got = []
        for lo, end in zip(cuts, [*cuts[1:], None], strict=True):
            f = io.BytesIO(data)
            f.seek(max(0, lo - 1))
            got += fastq.records(f, lo, end)
        assert got == whole


def test_first_and_last_per_key_over_files_and_splits(spark, tmp_path):
    rng = random.Random(9)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    paf, status = {}, {}
    first, last = {}, {}
    for name in ("a", "b", "c"):
        paf[name], status[name] = [], []
        for i in range(400):
            q, start = f"q{rng.randrange(90)}", rng.randrange(1000)
            paf[name].append(f"{q} 1000 {start} 9999 + t 500 1 91 80 90 60 dv:f:0.01 {'x' * rng.randrange(60)}")
            first.setdefault(q, start)
            key, value = f"k{rng.randrange(70)}", f"{name}{i}"
            status[name].append(f"{key}\t{value}")
            last[key] = value
        (tmp_path / f"{name}.paf").write_text("\n".join(paf[name]))
        (tmp_path / f"{name}.status").write_text("\n".join(status[name]))
    try:
        for size in ("128m", "3k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0b")
            got = sources_lr.first_per_key(text_formats.paf(spark, str(tmp_path / "*.paf")), "qname", "line").collect()
            assert {r.qname: r.qstart for r in got} == first
            assert {r.read_id: r.status for r in text_formats.status_table(spark, str(tmp_path / "*.status")).collect()} == last
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
