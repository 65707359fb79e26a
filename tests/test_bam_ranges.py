"""BAM files read in ranges of bytes, and long cigars."""

import io
import random

import numpy as np
import pytest

from strandlake.sources import bam, bam_decode


def made_rows(rng, n, long=0):
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 5, 300, 4000]) if i != long else 400_000
        seq = "".join(rng.choices("ACGTN", k=k))
        row = {"qname": f"r/{i}/ccs", "flag": rng.choice([0, 16]), "rname": rng.choice(["c1", "c2"]), "pos": rng.randint(0, 1 << 20), "mapq": rng.randint(0, 60), "cigar": f"{k}M" if k else "*", "seq": seq, "qual": [rng.randrange(94) for _ in seq] if i % 3 else None}
        if i % 4:
            row |= {t: [rng.randrange(256) for _ in seq] for t in bam_decode.SIGNALS if rng.random() < 0.8}
            row |= {"fn": rng.randint(0, 30), "ec": float(rng.randint(0, 20)), "mm": "A+m,0;", "ml": [7], "zp": [0.5]}
        out.append(row)
    return out


def written(rows, cut=65280):
    out = io.BytesIO()
    bam.write_file(iter(rows), out, [("c1", 1 << 21), ("c2", 1 << 21)])
    if cut != 65280:  # blocks of other sizes, some of them empty
        plain = b"".join(d for _, d in bam._blocks_from(io.BytesIO(out.getvalue()), 0))
        parts = [plain[i : i + cut] for i in range(0, len(plain), cut)]
        return b"".join(b"".join(bam._blocks(p)) + (bam.END if i % 5 == 2 else b"") for i, p in enumerate(parts)) + bam.END
    return out.getvalue()


def test_ranges_give_the_same_reads_and_numbers(spark, tmp_path):
    rows = made_rows(random.Random(1), 400, long=90)
    data = written(rows)
    (tmp_path / "a.bam").write_bytes(data)
    (tmp_path / "b.bam").write_bytes(written(rows[:20], 700))
    (tmp_path / "c.bam").write_bytes(written([]))
    spark.dataSource.register(bam.BamSource)
    key = lambda df: sorted((r.read_id, r.qname, r.cigar, r.seq, tuple(r.qual or ()), r.fi, r.ri, r.fn, r.ec, r.mm) for r in df.collect())
    whole = key(spark.read.format("bam").load(str(tmp_path)))
    assert [w[0] for w in whole] == [*range(400), *((1 << 40) + i for i in range(20))]
    assert [w[1:4] for w in whole[:400]] == [(r["qname"], r["cigar"], r["seq"]) for r in rows]
    for parts in (1, 3, 50):
        assert key(bam.reads(spark, str(tmp_path), -(-len(data) // parts))) == whole


@pytest.mark.parametrize("cut", [97, 1000, 65280])
def test_any_range_begins_at_a_record(cut):
    """Each two neighbouring ranges share no record and lose none, wherever they meet; one may lie within a record or the header."""
    rows = made_rows(random.Random(cut), 60, long=20 if cut > 97 else -1)
    data = written(rows, cut)
    rng, n = np.random.default_rng(cut), len(data)
    f = io.BytesIO(data)
    for _ in range(6):
        cuts = sorted({0, *rng.integers(0, n, 9).tolist()})
        ends = [*cuts[1:], bam.FILE_END]
        got = [b.column("qname").to_pylist() for lo, hi in zip(cuts, ends, strict=True) for b in bam.read_file(f, 0, lo, hi, n)]
        assert [q for g in got for q in g] == [r["qname"] for r in rows]
        counts = [c for lo, hi in zip(cuts, ends, strict=True) if (c := bam.count_range(f, lo, hi, n))[0]]
        assert sum(c[0] for c in counts) == len(rows) and all(a[2] == b[1] for a, b in zip(counts, counts[1:], strict=False))


def test_cut_off_files_are_errors_in_ranges(spark, tmp_path):
    data = written(made_rows(random.Random(3), 200))
    for k, bad in enumerate([data[: -len(bam.END)], data[: len(data) // 2], data[: len(data) // 2] + bytes(200) + data[len(data) // 2 + 200 :]]):
        (tmp_path / f"{k}.bam").write_bytes(bad)
        with pytest.raises(Exception, match="cut off|checksum|no BGZF|decompress|join"):
            bam.reads(spark, str(tmp_path / f"{k}.bam"), len(data) // 7).collect()


def test_long_cigars_go_through_a_tag():
    ops = 70_001
    cigar = "".join(f"{1 + i % 3}{'MID'[i % 3] if i % 2 else '='}" for i in range(ops))
    n = sum(1 + i % 3 for i in range(ops) if i % 2 == 0 or i % 3 < 2)
    row = {"qname": "q", "flag": 0, "rname": "c1", "pos": 3, "mapq": 9, "cigar": cigar, "seq": "ACGT" * (n // 4) + "A" * (n % 4), "qual": None, "fi": [1]}
    out = io.BytesIO()
    bam.write_file(iter([row, row | {"cigar": f"{n}S5N"}, row | {"cigar": f"{n}M"}]), out, [("c1", 1 << 21)])
    out.seek(0)
    got = [r for b in bam.read_file(out) for r in b.to_pylist()]
    assert [r["cigar"] for r in got] == [cigar, f"{n}S5N", f"{n}M"] and got[0]["fi"] == [1] and got[0]["seq"] == row["seq"]


def test_batches_are_bounded_by_bytes():
    out = io.BytesIO()
    seq = "ACGT" * 250_000
    bam.write_file(({"qname": f"q{i}", "flag": 4, "rname": "*", "pos": -1, "mapq": 0, "cigar": "*", "seq": seq, "qual": [9] * len(seq)} for i in range(8)), out, [])
    out.seek(0)
    sizes = [b.num_rows for b in bam.read_file(out)]
    assert sum(sizes) == 8 and max(sizes) <= 1 + bam.BATCH_BYTES // 1_500_000
