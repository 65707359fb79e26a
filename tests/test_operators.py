import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import kinetics, sequence, text
from strandlake.operators import alignment, calls, ml, reads, sites, sources_lr, stats
from strandlake.plans import workflows
from strandlake.sources import bam, bam_decode, text_formats
from strandlake.streaming import sites as stream


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_reverse_complement(spark):
    assert one(spark, "ACGTNX", "string", sequence.reverse_complement) == "ANACGT"
    assert one(spark, "ACGTN", "string", sequence.strict_reverse_complement) is None
    assert one(spark, "GATTACA", "string", lambda c: sequence.reverse_complement(sequence.reverse_complement(c))) == "GATTACA"
    assert one(spark, bytes([0x12, 0x48, 0xF0]), "binary", lambda c: sequence.nibbles(c, F.lit(5))) == "ACGTN"
    assert one(spark, bytes([0x13]), "binary", lambda c: sequence.nibbles(c, F.lit(2))) is None
    assert one(spark, "ACN", "string", sequence.one_hot_sequence) == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert one(spark, "ACGTN", "string", sequence.ordinals) == [1, 2, 3, 4, 0]
    assert one(spark, [1, 2, 3], "array<int>", lambda c: sequence.window(c, F.lit(0), 2)) == [1, 1, 1, 2, 3]


def test_motif_and_substitution(spark):
    df = spark.createDataFrame([("CCGATCC",), ("CAGATCC",), ("CCGGTCC",)], "k string")
    assert [r[0] for r in df.select(sequence.motif_in_centre(F.col("k"), "GAT")).collect()] == [True, False, False]
    rows = [("A", "G"), ("C", "T"), ("A", "AT"), ("AT", "A"), ("N", "A"), ("A", "<*>")]
    df = spark.createDataFrame(rows, "r string, a string")
    assert [x[0] for x in df.select(sequence.substitution(F.col("r"), F.col("a"))).collect()] == ["T->C", "C->T", "INS", "DEL", None, None]


def test_frames(spark):
    got = {v: (c, d) for v, c, d in spark.createDataFrame([(v,) for v in (0, 63, 64, 65, 191, 192, 447, 448, 951, 952, 5000)], "v int").select("v", kinetics.encode_frames(F.col("v")).alias("c"), kinetics.decode_frames(kinetics.encode_frames(F.col("v")))).collect()}
    assert got == {0: (0, 0), 63: (63, 63), 64: (64, 64), 65: (64, 64), 191: (127, 190), 192: (128, 192), 447: (191, 444), 448: (192, 448), 951: (254, 944), 952: (255, 952), 5000: (255, 952)}
    assert one(spark, [3, 1, 2, 10], "array<int>", kinetics.median) == 2.5 and one(spark, [], "array<int>", kinetics.median) is None
    assert one(spark, "[1, 2,3]", "string", kinetics.parse_list) == [1, 2, 3] and one(spark, None, "string", lambda c: kinetics.centre(kinetics.parse_list(c), 3)) == [0, 0, 0]


def read_rows(spark):
    base = {"seq": "ACGT", "flag": 0}
    full = {t: [1, 2, 3, 4] for t in reads.TAGS}
    rows = [dict(base, read_id=1, fn=3, rn=3, **full), dict(base, read_id=2, fn=2, rn=3, **full), dict(base, read_id=3, fn=3, rn=3, **full | {"fi": []}), dict(base, read_id=4, fn=3, rn=3, **full | {"rp": None}), dict(base, read_id=5, fn=3, rn=3, **full | {"fi": [0], "ri": [0]}), dict(base, read_id=6, fn=9, rn=9, **full | {"fp": [1, 1]})]
    return spark.createDataFrame([{k: r.get(k) for k in ("read_id", "seq", "flag", "fn", "rn", *reads.TAGS)} for r in rows], "read_id long, seq string, flag int, fn int, rn int, fi array<int>, ri array<int>, fp array<int>, rp array<int>")


def test_filters(spark):
    df = read_rows(spark)
    assert sorted(r.read_id for r in reads.eligible(df).collect()) == [1, 6]
    assert [r.read_id for r in reads.quality_filter(df).collect()] == [6]  # the largest ratio is at the percentile
    assert sorted(r.read_id for r in reads.consistent(df, 4).collect()) == [1, 2]
    assert reads.has_signals(df) and not reads.has_signals(df.where("read_id = 0"))


def test_context_rows(spark):
    r = random.Random(7)
    seqs = ["".join(r.choices("ACGTN", k=n)) for n in (0, 1, 5, 6, 7, 30, 41)]
    rows = [(i, s, *([[r.randrange(256) for _ in s] for _ in range(4)])) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "read_id long, seq string, fi array<int>, ri array<int>, fp array<int>, rp array<int>")
    for half, margin in ((2, 3), (3, 0)):
        want = set()
        for i, s, fi, ri, fp, rp in rows:
            for p, b in enumerate(s):
                if b in "AT" and max(half, margin) <= p <= len(s) - max(margin, half + 1):
                    cut = lambda a, c: tuple(a[c - half : c + half + 1])
                    kmer, c = s[p - half : p + half + 1], len(s) - 1 - p
                    if b == "T":
                        kmer = None if "N" in kmer else kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))
                    want.add((i, p, b, kmer, cut(ri, c) if b == "A" else cut(fi, p), cut(rp, c) if b == "A" else cut(fp, p)))
        got = {(x.read_id, x.pos, x.base, x.kmer, tuple(x.ipd), tuple(x.pw)) for x in reads.context_rows(df, half, margin).collect()}
        assert got == want and got


def aligned(spark, cigar, seq, pos=0, flag=0):
    return spark.createDataFrame([(1, seq, flag, cigar, "c", pos, 30, 9.0)], "read_id long, seq string, flag int, cigar string, rname string, pos int, mapq int, ec double")


@pytest.mark.parametrize("gap,length", [(19, 39), (20, 20), (21, 20)])
@pytest.mark.parametrize("op", ["D", "I"])
def test_identity_of_gaps(spark, gap, length, op):
    ref = "A" * 100
    seq = "A" * (20 + gap * (op == "I"))
    got = alignment.identity(aligned(spark, f"10M{gap}{op}10M", seq), spark.createDataFrame([("c", ref)], "contig string, seq string")).first().identity
    assert abs(got - 100 * 20 / length) < 1e-9


def test_neighbouring_gaps(spark):
    contigs = spark.createDataFrame([("c", "A" * 100)], "contig string, seq string")
    run = lambda c, n: alignment.identity(aligned(spark, c, "A" * n), contigs).first().identity
    assert run("10M15D6N10M", 20) == 100.0  # one run of 21 on the same side
    assert abs(run("10M15D6I10M", 26) - 100 * 20 / 41) < 1e-9
    assert run("5S", 5) == 0.0


READ = "read_id long, seq string, flag int, cigar string, rname string, pos int, mapq int, ec double"


@pytest.mark.parametrize("small", [True, False])
def test_unmapped_reads_keep_their_bases(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(alignment, "BROADCAST_BASES", 0)
        monkeypatch.setattr(alignment, "TILE_BASES", 4)
    contigs = spark.createDataFrame([("c", "GGACGTAACC"), ("e", None)], "contig string, seq string")
    s = "ACGTAA"
    rows = [
        (1, s, 0, "6M", "c", 2, 60, 9.0), (2, s, 4, "*", "*", -1, 0, 9.0), (3, s, 20, None, None, None, None, 9.0), (4, s, None, "6M", "c", 2, 60, 9.0), (5, s, 0, "6M", "c", 2, None, 9.0), (6, None, 0, "6M", "c", 2, 60, 9.0),
        (7, s, 4, "6M", "nowhere", 2, 60, 9.0), (8, s, 0, "6M", "c", 2, 60, None), (9, s, 0, "6M", "c", 8, 60, 9.0), (10, s, 0, "6M", "e", 0, 60, 9.0),
    ]
    calls_of = spark.createDataFrame([(r[0], p, 0.5) for r in rows for p in range(6)], "read_id long, pos int, prob double")
    got = {}
    for r in alignment.base_table(spark.createDataFrame(rows, READ), contigs, calls_of).collect():
        got.setdefault(r.read_id, []).append((r.strand, r.qpos, r.base, r.rname, r.rpos))
    mapped = [("+", 0, "A", "c", 2), ("+", 3, "T", "c", 5), ("+", 4, "A", "c", 6), ("+", 5, "A", "c", 7)]
    plain = [(*x[:3], None, None) for x in mapped]
    assert {k: sorted(v) for k, v in got.items()} == {1: mapped, 2: plain, 3: [("-", *x[1:]) for x in plain], 4: mapped, 5: plain, 7: plain, 9: plain, 10: plain}
    assert {r.read_id for r in alignment.base_table(spark.createDataFrame(rows, READ), contigs, calls_of, mapped_only=True).collect()} == {1, 4}
    assert {r.read_id for r in alignment.identity(spark.createDataFrame(rows, READ), contigs).collect()} == {1, 4, 5, 8, 9, 10}
    unknown = spark.createDataFrame([(1, s, 0, "6M", "x", 2, 60, 9.0)], READ)
    for f in (lambda: alignment.base_table(unknown, contigs, calls_of), lambda: alignment.identity(unknown, contigs), lambda: alignment.aligned_pairs(unknown, contigs)):
        with pytest.raises(Exception, match="no such contig"):
            f().collect()


def test_clips_and_reference_n(spark):
    contigs = spark.createDataFrame([("c", "NACGT")], "contig string, seq string")
    df = aligned(spark, "2H2S5M1H", "GGAACGT")
    assert [(r.op, r.q_start, r.r_offset) for r in alignment.walk(df).orderBy("k").collect()] == [("H", 0, 0), ("S", 0, 0), ("M", 2, 0), ("H", 7, 5)]
    assert [(r.q, r.r, r.query, r.reference) for r in alignment.aligned_pairs(df, contigs).orderBy("q").collect()] == [(2, 0, "A", "A"), (3, 1, "A", "A"), (4, 2, "C", "C"), (5, 3, "G", "G"), (6, 4, "T", "T")]
    assert alignment.unknown_contigs(df, contigs.where("contig = 'x'")).count() == 1


def test_reference_in_tiles(spark, monkeypatch):
    r = random.Random(6)
    contigs = spark.createDataFrame([(c, "".join(r.choices("ACGTN", k=n))) for c, n in (("c", 95), ("d", 16))], "contig string, seq string")
    rows = [(i, "".join(r.choices("ACGT", k=30)), 0, "10M2I3D8M1D10M", r.choice("cd"), r.randrange(60), 30, 9.0) for i in range(40)]
    df = spark.createDataFrame(rows, "read_id long, seq string, flag int, cigar string, rname string, pos int, mapq int, ec double")
    whole = sorted(map(tuple, alignment.aligned_pairs(df, contigs).collect()))
    monkeypatch.setattr(alignment, "BROADCAST_BASES", 0)
    monkeypatch.setattr(alignment, "TILE_BASES", 16)
    assert sorted(map(tuple, alignment.aligned_pairs(df, contigs).collect())) == whole


def test_checked_alignment(spark):
    good, bad = aligned(spark, "2H2S5M1H", "GGAACGT"), [aligned(spark, "5M", "AACG"), aligned(spark, "4M2Q", "AACG"), aligned(spark, "4M", "AACG", pos=-1)]
    assert alignment.with_checked_alignment(good).collect() == good.collect()
    for df in bad:
        with pytest.raises(Exception, match="not an alignment"):
            alignment.with_checked_alignment(df).collect()


def test_base_table_of_a_reverse_read(spark):
    contigs = spark.createDataFrame([("c", "AACGT")], "contig string, seq string")
    found = spark.createDataFrame([(1, 0, "A", 0.9), (1, 4, "T", 0.2)], "read_id long, pos int, base string, prob double")
    df = aligned(spark, "5M", "AACGT", flag=16)  # sequenced as ACGTT
    got = sorted(tuple(r) for r in alignment.base_table(df, contigs, found).collect())
    assert got == [(1, "-", 0, "A", "c", 0, 0.2), (1, "-", 4, "T", "c", 4, 0.9)]
    low = alignment.base_table(df.withColumn("mapq", F.lit(5)), contigs, found)
    assert [r.rpos for r in low.collect()] == [None, None] and alignment.base_table(df.withColumn("mapq", F.lit(5)), contigs, found, mapped_only=True).count() == 0
    assert alignment.base_table(df.withColumn("ec", F.lit(None).cast("double")), contigs, found).count() == 0


def test_tags(spark):
    seqs = spark.createDataFrame([(1, "AATTACGNA"), (2, "CCCC"), (3, "TTT")], "read_id long, seq string")
    found = spark.createDataFrame([(1, 1, "A", 0.5), (1, 8, "A", 1.0), (1, 3, "T", 0.29), (3, 2, "T", 0.0)], "read_id long, pos int, base string, prob double")
    tags = calls.encode_tags(seqs, found)
    got = {r.read_id: (r.mm, r.ml) for r in tags.collect()}
    assert got == {1: ("A+m,1,1;T-m,1;", [128, 255, 74]), 3: ("A+m;T-m,2;", [0])}
    back = sorted((r.read_id, r.pos, r.base, round(r.prob, 3)) for r in calls.resolve_tags(seqs, tags).collect())
    assert back == [(1, 1, "A", 0.5), (1, 3, "T", 0.29), (1, 8, "A", 1.0), (3, 2, "T", 0.0)]
    tagged = lambda mm, zp: calls.resolve_tags(seqs, spark.createDataFrame([(1, mm, None, zp)], "read_id long, mm string, ml array<short>, zp array<float>"))
    assert [(r.pos, r.base, round(r.prob, 2)) for r in tagged("A+m?,1;T-m.,0;", [0.9, 0.1]).collect()] == [(1, "A", 0.9), (2, "T", 0.1)]
    for mm, zp in (("C+m,0;A+m,0;T-m;", [0.9, 0.1]), ("A+m,0;T-m,0;", [0.5]), ("A+m,0,0;T-m;", [0.5]), ("A+m,x;", [0.5])):
        with pytest.raises(Exception, match="A.m|gaps and"):
            tagged(mm, zp).collect()
    assert tagged("A+m,90;T-m;", [0.9]).collect() == [] and tagged(None, None).collect() == []
    ml_only = sorted((r.pos, round(r.prob * 255)) for r in calls.resolve_tags(seqs, tags.withColumn("zp", F.lit(None).cast("array<float>"))).collect() if r.read_id == 1)
    assert ml_only == [(1, 128), (3, 74), (8, 255)]
    assert {r.read_id: r.seq for r in calls.relabelled(seqs, found).collect()} == {1: "AZTTACGNZ", 2: "CCCC", 3: "TTT"}
    hist = {(r.read_id, r.bucket): r.share for r in calls.histogram(found).collect()}
    assert hist[1, 28] == hist[1, 50] == hist[1, 99] and hist[3, 0] == 1.0
    assert calls.histogram(found, least=2).select("read_id").distinct().count() == 1


def test_relabelled_in_order(spark):
    seqs = spark.createDataFrame([(1, "ATNTA"), (2, "AT"), (3, "AAT"), (4, "CG")], "read_id long, seq string")
    tags = spark.createDataFrame([(1, [0.9, 0.1, 0.5, 0.4]), (2, None), (3, [0.2, 0.7]), (4, [])], "read_id long, zp array<float>")
    # One value too few leaves the last base as it is; a read without values gives no row.
    assert {r.read_id: r.seq for r in calls.relabelled_in_order(seqs, tags).collect()} == {1: "ZTNOA", 3: "AZT"}


def test_random_round_trip(spark):
    r = random.Random(1)
    seqs = [(i, "".join(r.choices("ACGTN", k=80))) for i in range(40)]
    rows = [(i, p, b, r.random()) for i, s in seqs for p, b in enumerate(s) if b in "AT" and r.random() < 0.3]
    s = spark.createDataFrame(seqs, "read_id long, seq string")
    found = spark.createDataFrame(rows, "read_id long, pos int, base string, prob double")
    got = {(x.read_id, x.pos, x.base): x.prob for x in calls.resolve_tags(s, calls.encode_tags(s, found)).collect()}
    assert got.keys() == {x[:3] for x in rows} and all(abs(got[x[:3]] - x[3]) < 1e-6 for x in rows)


def test_sites(spark):
    df = spark.createDataFrame([("a_1", 5, 0.5), ("a_1", 5, 0.49), ("b", 1, None), (None, 1, 0.9)], "chr string, coor int, prob double")
    assert [tuple(r) for r in sites.site_frequency(df).collect()] == [("a_1", 5, 1, 1, 0.5)]


def test_sources(spark):
    classes = spark.createDataFrame([("r1", "+"), ("r2", "-"), ("r3", "*"), ("r4", "-")], "read string, tag string")
    contig = spark.createDataFrame([("r1", "c1"), ("r2", "c1"), ("r3", "c1"), ("r4", "c2")], "read string, contig string")
    got = {r.source: (r.reads, r.z_reads, r.lr) for r in sources_lr.likelihood_ratio(classes, contig).collect()}
    assert got == {"c1": (2, 1, 250.0), "c2": (1, 0, 0.0)}
    paf = spark.createDataFrame([("q", 1, 100, 90, 100, "dv:f:0.01"), ("q", 2, 100, 0, 100, "dv:f:0.01"), ("s", 3, 100, 0, 1, "dv:f:0.01"), ("t", 4, 100, 0, 90, "dv:f:0.2")], "qname string, line long, qlen long, qstart long, qend long, tags string")
    assert sorted(r.line for r in sources_lr.mapping_filter(paf).collect()) == [1, 3]
    assert sorted(r.line for r in sources_lr.mapping_filter(paf, coverage_mode="fraction").collect()) == []
    split = sources_lr.stratified_split(spark.range(100).withColumn("y", F.col("id") % 2), "y", "id").groupBy("y").agg(F.count_if("train").alias("n")).collect()
    assert all(34 <= r.n <= 36 for r in split)


def test_p_values(spark):
    for t, df, p in [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (12.706, 1, 0.05), (1.96, 1e6, 0.0499963), (5.0, 30, 2.3315e-05)]:
        assert abs(stats.t_tail(t, df) - p) < 2e-5 * max(p, 0.05)
    assert stats.t_tail(None, 3) is None and stats.t_tail(1.0, 0) is None
    assert abs(one(spark, 1.959964, "double", stats.normal_p_value) - 0.05) < 1e-6


def test_benjamini_hochberg(spark):
    r = random.Random(2)
    ps = [r.choice([0.01, 0.02, 0.5, r.random()]) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(ps)), "id long, p double").repartition(4)
    order = sorted(range(len(ps)), key=lambda i: (1.0 if ps[i] is None else ps[i], i))
    want, low = {}, 1.0
    for k in range(len(order), 0, -1):
        i = order[k - 1]
        low = min(low, (1.0 if ps[i] is None else ps[i]) * len(ps) / k)
        want[i] = low
    for got in (stats.benjamini_hochberg(df, "p", "id"), stats.benjamini_hochberg(df.withColumn("g", F.lit(1)), "p", "id", ["g"])):
        assert all(abs(x.adjusted - want[x.id]) < 1e-12 for x in got.collect())


def test_support_vector_machine(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.5, (40, 3)), rng.normal(1.5, 0.5, (40, 3))])
    y = np.array([-1.0] * 40 + [1.0] * 40)
    m = ml.train_svm(x, y)
    assert (np.sign(m.decide(x)) == y).mean() > 0.95 and abs(m.coefficients.sum()) < 1e-9 and np.abs(m.coefficients).max() <= 1 + 1e-9
    again = ml.Svm.from_text(m.to_text(), 3)
    assert np.allclose(again.decide(x), m.decide(x))
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x[:5])], "id long, features array<double>, n_calls int")
    got = [r.tag for r in ml.predict_reads(df, m, least_calls=2).orderBy("id").collect()]
    assert got[:2] == ["*", "*"] and set(got[2:]) == {"-"}


def test_signal_tests(spark):
    r = random.Random(5)
    value = {(k, p, z): [r.randrange(1, 60) + 7.0 * (z and k == 1 and p == 2) for _ in range(r.randrange(2, 9))] for k in range(3) for p in range(4) for z in (True, False)}
    del value[2, 3, True]
    sides = [spark.createDataFrame([(k, p, v) for (k, p, s), vs in value.items() if s == z for v in vs], "kmer int, place int, value double") for z in (True, False)]
    got = {(x.kmer, x.place): x for x in stats.signal_tests(*sides).collect()}
    want = {}
    for k in range(3):
        places = [p for p in range(4) if (k, p, True) in value]
        factor = np.median([np.median(value[k, p, True]) / np.median(value[k, p, False]) for p in places])
        for p in places:
            a, b = np.array(value[k, p, False]), np.array(value[k, p, True]) / factor
            df = len(a) + len(b) - 2
            t = (a.mean() - b.mean()) / math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / df * (1 / len(a) + 1 / len(b)))
            want[k, p] = (np.median(b) / np.median(a), t, df, stats.t_tail(t, df))
    assert got.keys() == want.keys()
    assert all(np.allclose([got[x].ratio, got[x].t, got[x].df, got[x].p], want[x]) for x in want)
    low = 1.0
    for i, x in enumerate(sorted(want, key=lambda x: -want[x][3])):
        low = min(low, want[x][3] * len(want) / (len(want) - i))
        assert abs(got[x].adjusted - low) < 1e-9


def test_cross_validation(spark):
    rng = np.random.default_rng(8)
    y = [1 if i % 3 else -1 for i in range(90)]
    df = spark.createDataFrame([(i, (rng.normal(0.9 * v, 1.0, 2)).tolist(), v) for i, v in enumerate(y)], "vec_id long, features array<double>, label int")
    decided = ml.out_of_fold(df, [(1.0, 0.5), (0.5, 2.0)], folds=3).toPandas()
    assert len(decided) == 180 and (decided.groupby(["cost", "gamma", "fold"]).label.apply(lambda v: (v > 0).sum()) == 20).all()
    rows = {r.vec_id: r for r in df.collect()}
    own = decided[(decided.cost == 1.0) & (decided.fold == 1)]
    rest = sorted(set(rows) - set(own.id))
    model = ml.train_svm(np.array([rows[i].features for i in rest]), np.array([float(rows[i].label) for i in rest]))
    assert np.allclose(model.decide(np.array([rows[i].features for i in own.id])), own.decision)
    best = ml.grid_search(df, [1.0, 0.5], [0.5], folds=3).collect()
    assert len(best) == 2 and best[0].n == 90 and best[0].accuracy >= best[1].accuracy > 0.7
    one_class = ml.out_of_fold(df.where("label = 1"), [(1.0, 0.5)]).toPandas()
    assert len(one_class) == 60 and (one_class.decision == 1).all()
    assert ml.out_of_fold(df.where("vec_id < 0"), [(1.0, 0.5)]).count() == 0
    assert ml.bounded_sample(df, "label", "vec_id").count() == 90 and 20 < ml.bounded_sample(df, "label", "vec_id", 45).count() < 70


def test_probabilities(spark):
    rng = np.random.default_rng(9)
    d = rng.normal(0, 2, 400)
    y = np.where(rng.random(400) < 1 / (1 + np.exp(-1.5 * d + 0.5)), 1, -1)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(d, y, strict=True)], "decision double, label int")
    a, b = ml.fit_sigmoid(df)
    p = 1 / (1 + np.exp(a * d + b))
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    assert abs((t - p).sum()) < 1e-3 and abs(((t - p) * d).sum()) < 1e-3  # the likelihood's slopes are nought
    got = [r.prob for r in ml.with_probability(df, a, b).collect()]
    assert np.allclose(got, p) and ml.fit_sigmoid(df.where("label = 0")) == (0.0, 0.0)


def test_text(spark):
    sizes = {0: "0", 999: "999", 1000: "1.00K", 1234567: "1.23M", 999499: "999K", 999500: "1.00M", 12345: "12.3K", 10**18: "1.00E"}
    got = dict(spark.createDataFrame([(k,) for k in sizes], "n long").select("n", text.number_to_size(F.col("n"))).collect())
    assert got == sizes
    binary = {0: "0", 1023: "1023", 1024: "1.00Ki", 1536: "1.50Ki", 10 * 1024: "10.0Ki", 10239: "10.0Ki", 1000 * 1024 - 1: "0.98Mi", 999 * 1024: "999Ki", 999 * 1024 + 512: "0.98Mi", 1024**2: "1.00Mi", 2**63 - 1: "8.00Ei", 5 * 1024**4 + 1024**4 // 8: "5.13Ti"}
    assert dict(spark.createDataFrame([(k,) for k in binary], "n long").select("n", text.number_to_binary_size(F.col("n"))).collect()) == binary
    four = {1023 * 1024 + 1000: "1.000Mi", 1010 * 1024: "1010Ki", 12345: "12.06Ki"}
    assert dict(spark.createDataFrame([(k,) for k in four], "n long").select("n", text.number_to_binary_size(F.col("n"), 4)).collect()) == four
    back = {"1.5K": 1500, "2MiB": 2097152, "7": 7, "x": None, "3 GB": 3 * 10**9}
    assert dict(spark.createDataFrame([(k,) for k in back], "s string").select("s", text.size_to_number(F.col("s"))).collect()) == back
    ok = {"1": True, "-1.5e3": True, ".5": True, "5.": False, "": False, "1e": False, "+": False, "1E3": False}
    assert dict(spark.createDataFrame([(k,) for k in ok], "s string").select("s", text.is_number(F.col("s"))).collect()) == ok
    assert one(spark, "a\tb\"\\\x01é", "string", text.printable) == 'a\\tb\\"\\\\\\001é'
    assert one(spark, "aa bb cc", "string", lambda c: text.wrapped(c, 5)) == ["aa bb", "cc"]
    row = spark.createDataFrame([("abcabc", " x ")], "s string, t string").select(text.find(F.col("s"), "c"), text.rfind(F.col("s"), "bc"), text.find_first_of(F.col("s"), "cb"), text.find_last_of(F.col("s"), "ab"), text.find(F.col("s"), "z"), text.truncate_spaces(F.col("t")), text.is_blank(F.col("t")), text.compare(F.col("s"), F.lit("ABCABC"), case=False), text.to_bool(F.lit("Yes")), text.fixed_width(F.lit(42), 5)).first()
    assert tuple(row) == (2, 4, 1, 4, -1, "x", False, 0, True, "00042")


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first one\nACGT\nac gt;note\n!skip\n>c2\r\nNNNN\r\n>bad\n1?!?!?!?\n>\nACGT\n")
    assert sorted(tuple(r) for r in text_formats.fasta(spark, str(tmp_path / "a.fa")).collect()) == [("c1", "first one", "ACGTACGT"), ("c2", "", "NNNN")]
    with pytest.raises(Exception, match="bad record"):
        text_formats.fasta(spark, str(tmp_path / "a.fa"), "FAILFAST").collect()
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nAC\n+\nI\n@r3\nA\n+r3\nI\n")
    assert sorted(tuple(r) for r in text_formats.fastq(spark, str(tmp_path / "a.fq")).collect()) == [("r1", "x", "ACGT", "@III"), ("r3", "", "A", "I")]
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nq\t16\tc1\t11\t60\t4M\t*\t0\t0\tACGT\tIIII\tfi:B:C,1,2,3,4\tfn:i:5\tec:f:7.5\tMM:Z:A+m,0;T-m;\tML:B:C,200\nr\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    q, r = text_formats.sam(spark, str(tmp_path / "a.sam")).orderBy("qname").collect()
    assert (q.pos, q.fi, q.fn, q.rn, q.ec, q.mm, q.ml, q.qual) == (10, [1, 2, 3, 4], 5, 0, 7.5, "A+m,0;T-m;", [200], [40] * 4)
    assert r.qual is None and r.fi is None and r.ec == 0
    (tmp_path / "b.tsv").write_text("q\t1\t+\t3\tA\tc\t9\t0.5\nq\t1\t+\t4\tT\t0.7\nshort\n")
    assert [tuple(x) for x in text_formats.base_table(spark, str(tmp_path / "b.tsv")).collect()] == [("q", 1, "+", 3, "A", "c", 9, 0.5), ("q", 1, "+", 4, "T", None, None, 0.7)]
    (tmp_path / "s.tsv").write_text("a\tx\nb\ty\nbad\na\tz\n")
    assert {tuple(x) for x in text_formats.status_table(spark, str(tmp_path / "s.tsv")).collect()} == {("a", "z"), ("b", "y")}
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nc\t7\t.\tA\tG,T\tq\n")
    assert {tuple(x) for x in stats.substitution_counts(text_formats.vcf(spark, str(tmp_path / "v.vcf"))).collect()} == {("T->C", 1), ("T->A", 1)}
    (tmp_path / "p.paf").write_text("q 100 0 90 + t 500 1 91 80 90 60 tp:A:P dv:f:0.01\n")
    assert sources_lr.mapping_filter(text_formats.paf(spark, str(tmp_path / "p.paf"))).count() == 1
    df = spark.createDataFrame([("b", 2, 1, 2, 1 / 3), ("a", 10, 0, 1, 0.0), ("a", 9, 1, 0, 1.0)], "chr string, coor int, above long, below long, ratio double")
    text_formats.write_frequencies(df, str(tmp_path / "f"))
    back = text_formats.tsv(spark, str(tmp_path / "f"), text_formats.FREQUENCIES, header=True).collect()
    assert sorted((x.chr, x.coor, x.ratio_above_threshold) for x in back) == [("a", 9, 1.0), ("a", 10, 0.0), ("b", 2, 0.33)]
    text_formats.write_fasta(spark.createDataFrame([(1, "ACZT")], "read_id long, seq string"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 2


def test_bam(spark, tmp_path):
    row = {"qname": "q1", "flag": 16, "rname": "c2", "pos": 7, "mapq": 60, "cigar": "2S3M1D", "seq": "ACGTN", "qual": [1, 2, 3, 4, 5], "fi": [0, 255, 3, 4, 5], "ri": [952, 1, 2, 3, 4], "fp": None, "rp": None, "fn": 4, "rn": 5, "ec": 7.5, "mm": "A+m,0;T-m;", "ml": [200], "zp": [0.5]}
    bare = {"qname": "q2", "flag": 4, "rname": "*", "pos": -1, "mapq": 0, "cigar": "*", "seq": "AC", "qual": None}
    out = io.BytesIO()
    bam.write_file(iter([row, bare] + [dict(row, qname=f"n{i}", seq="ACGT" * 500, qual=[30] * 2000) for i in range(800)]), out, [("c1", 100), ("c2", 200)])
    (tmp_path / "a.bam").write_bytes(out.getvalue())
    (tmp_path / "b.bam").write_bytes(out.getvalue())
    spark.dataSource.register(bam.BamSource)
    got = spark.read.format("bam").load(str(tmp_path / "*.bam"))
    assert got.count() == 1604 and got.select("read_id").distinct().count() == 1604
    first = got.where("qname = 'q1'").orderBy("read_id").first().asDict()
    squeezed = row | {"ri": [255, 1, 2, 3, 4]}  # frames are stored as such and read as codes
    assert {k: v for k, v in first.items() if k != "read_id"} == squeezed and first["read_id"] == 0
    second = got.where("qname = 'q2'").first()
    assert second.rname == "*" and second.qual is None and second.fi is None and second.ec == 0


def test_bam_sink(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    rows = [(f"q{i}", 0, "c2", i, "3M", "ACG", [7, 8, 9], [1, 2, 255]) for i in range(50)]
    reads = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, cigar string, seq string, qual array<int>, fi array<int>").repartition(3)
    save = lambda df, mode: df.write.format("bam").option("contigs", "c1:100,c2:200").mode(mode).save(str(tmp_path / "out"))
    back = lambda at="out": spark.read.format("bam").load(str(tmp_path / at)).select("qname", "flag", "rname", "pos", "cigar", "seq", "qual", "fi")
    save(reads, "append")
    assert sorted(map(tuple, back().collect())) == sorted(rows) and len(bam.files(str(tmp_path / "out"))) == 3
    save(reads.where("pos < 10"), "append")
    assert back().count() == 60 and back("out/*.bam").count() == 60
    assert spark.read.format("bam").load(f"file://{tmp_path}/o*t/part-*.bam").count() == 60
    save(reads.where("pos < 5").coalesce(1).drop("fi", "cigar"), "overwrite")
    got = back().collect()
    assert len(got) == 5 and {(r.cigar, r.fi) for r in got} == {("*", None)} and not list((tmp_path / "out").glob("_temporary*"))
    with pytest.raises(Exception, match="unknown contig"):
        save(reads.withColumn("rname", F.lit("c9")), "append")
    assert back().count() == 5 and not list((tmp_path / "out").glob("_temporary*"))
    with pytest.raises(Exception, match="no BAM file"):
        spark.read.format("bam").load(str(tmp_path / "none*.bam")).count()


def test_bam_sink_in_order(spark, tmp_path):
    rows = [(i, f"q{i:04d}", "ACGT") for i in range(500)]
    df = spark.createDataFrame(rows, "read_id long, qname string, seq string").orderBy(F.xxhash64("qname")).repartition(5)
    bam.write(df, str(tmp_path / "out"), "", parts=4)
    assert len(bam.files(str(tmp_path / "out"))) == 4
    back = spark.read.format("bam").load(str(tmp_path / "out")).orderBy("read_id").collect()
    assert [r.qname for r in back] == [q for _, q, _ in rows]


def test_tsv_sink(spark, tmp_path):
    rows = [(1, 'a "quoted" \\ text', None, 0.5), (2, "", "x,y", -1e300)]
    text_formats.write_tsv(spark.createDataFrame(rows, "n int, a string, b string, v double").coalesce(1), str(tmp_path / "t"), header=True)
    lines = next((tmp_path / "t").glob("part-*")).read_text().split("\n")
    assert lines[:2] == ["n\ta\tb\tv", '1\ta "quoted" \\ text\t\t0.5'] and lines[2].split("\t")[0] == "2" and lines[2].endswith("x,y\t-1.0E300")
    again = text_formats.tsv(spark, str(tmp_path / "t"), "n int, a string, b string, v double", header=True).orderBy("n").collect()
    assert (again[0].a, again[0].b, again[1].b, again[1].v) == (rows[0][1], None, "x,y", -1e300)


def test_flipped_places(spark):
    df = spark.createDataFrame([(0, 10), (9, 10), (4, 10)], "pos int, n int")
    assert [tuple(r) for r in df.select(sequence.flip(F.col("pos"), F.col("n")), sequence.flip(F.col("pos"), F.col("n"), 2)).collect()] == [(9, 8), (0, -1), (5, 4)]


def test_reads_whose_quality_is_of_another_length_are_inconsistent(spark):
    full = {t: [1, 2, 3, 4] for t in reads.TAGS}
    rows = [dict(read_id=i, seq="ACGT", qual=q, **full) for i, q in ((1, [1, 2, 3, 4]), (2, [1]), (3, None))]
    df = spark.createDataFrame([{k: r[k] for k in ("read_id", "seq", "qual", *reads.TAGS)} for r in rows], "read_id long, seq string, qual array<int>, fi array<int>, ri array<int>, fp array<int>, rp array<int>")
    assert sorted(r.read_id for r in reads.consistent(df, 4).collect()) == [1, 3]


def test_windowed_frequency(spark, tmp_path):
    """Windows come out once the watermark has passed them; a late call doesn't count."""
    calls_at = "chr string, coor int, prob double, at timestamp"
    batches = [
        [("c", 1, 0.9, "2024-01-01 00:01:00"), ("c", 1, 0.1, "2024-01-01 00:09:00"), ("c", 2, 0.7, "2024-01-01 00:11:00")],
        [("c", 1, 0.8, "2024-01-01 00:05:00"), ("c", 9, 0.8, "2024-01-01 01:30:00")],
        [("c", 1, 0.8, "2024-01-01 00:02:00"), ("c", 9, 0.8, "2024-01-01 03:00:00")],
    ]
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "chr string, coor int, prob double, at string").withColumn("at", F.to_timestamp("at"))
        part.coalesce(1).write.parquet(str(source / f"b={k}"))
        found = stream.windowed_frequency(spark.readStream.schema(calls_at).option("recursiveFileLookup", "true").parquet(str(source)), "at")
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(str(r.window.start)[11:16], r.chr, r.coor): (r.above, r.below) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("00:00", "c", 1): (2, 1), ("00:10", "c", 2): (1, 0), ("01:30", "c", 9): (1, 0)}


def test_models_of_the_queries_have_the_right_values(spark):
    """Components up to their sign, network scores, and shares of importance, against numpy."""
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(e["embedding"].to_numpy()).astype(np.float64)
    got = np.array([r.components for r in ml.pca(spark, sf).orderBy("vec_id").collect()])
    way = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    want = (x - x.mean(0)) @ way.T
    assert all(min(np.abs(got[:, j] - s * want[:, j]).max() for s in (1, -1)) < 1e-6 for j in range(2))
    rng = np.random.Generator(np.random.PCG64(1))
    layers = [(rng.standard_normal((64, 16)) / 8, rng.standard_normal(16)), (rng.standard_normal((16, 2)) / 4, rng.standard_normal(2))]
    out = np.maximum(0, x @ layers[0][0] + layers[0][1]) @ layers[1][0] + layers[1][1]
    scored = ml.score_network(spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "features"), layers).orderBy("vec_id").collect()
    assert np.abs(np.array([r.prob for r in scored]) - np.exp(out[:, 1]) / np.exp(out).sum(1)).max() < 2e-5
    strong = spark.createDataFrame([(float(i % 7 > 3), i % 7 + 0.1 * (i % 3), float(i * 37 % 11)) for i in range(400)], "label double, a double, b double").select("label", ml.array_to_vector(F.array("a", "b")).alias("features"))
    found = {r.feature: r.importance for r in ml.forest_importance(strong, trees=20).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9 and found[0] > 0.7
    mixed = strong.withColumn("vec_id", F.monotonically_increasing_id())
    model = ml.RandomForestClassifier(numTrees=10, seed=1).fit(strong)
    loss = {r.feature: r.loss for r in ml.permutation_importance(mixed, model, [0, 1]).collect()}
    assert loss[0] > 0.2 > abs(loss[1])


def test_bam_files_that_are_cut_off_or_damaged_are_errors():
    out = io.BytesIO()
    row = {"qname": "q", "flag": 4, "rname": "*", "pos": -1, "mapq": 0, "cigar": "*", "seq": "ACGT", "qual": None}
    bam.write_file(iter([row] * 3), out, [])
    whole = out.getvalue()
    reads = lambda data: sum(b.num_rows for b in bam.read_file(io.BytesIO(data)))
    assert reads(whole) == 3
    plain = b"".join(data for _, data in bam._blocks_from(io.BytesIO(whole), 0))
    # Other extra fields before the block's size are legal.
    size = len(whole) - len(bam.END) + 6
    moved = whole[:10] + struct.pack("<H", 12) + b"XY\x02\0zz" + b"BC\x02\0" + struct.pack("<H", size - 1) + whole[18:]
    assert reads(moved) == 3
    record = len(bam.encode_record(row, -1))
    for bad, why in [(whole[: -len(bam.END)], "no end block"), (whole[:-5], "cut off"), (whole[:40], "cut off"), (whole[:30] + bytes([whole[30] ^ 1]) + whole[31:], ".")]:
        with pytest.raises((ValueError, zlib.error), match=why):
            reads(bad)
    for n in (2, 4, record - 1):  # within a record's size, after it, within its body
        with pytest.raises(ValueError, match="within a record"):
            reads(b"".join(bam._blocks(plain[: len(plain) - record + n])) + bam.END)


def test_damaged_alignment_lines(spark, tmp_path):
    good = "q\t0\tc\t5\t60\t3M\t*\t0\t0\tACG\t*"
    for k, line in enumerate(["q\t0\tc\t5", good.replace("\t5\t", "\tx\t"), good.replace("q\t0", "q\tzero")]):
        (tmp_path / f"{k}.sam").write_text(f"@HD\tVN:1.6\n{good}\n\n{line}\n")
        with pytest.raises(Exception, match="not an alignment line|is no number"):
            text_formats.sam(spark, str(tmp_path / f"{k}.sam")).collect()
        rows = text_formats.sam(spark, str(tmp_path / f"{k}.sam"), "PERMISSIVE").collect()
        assert len(rows) == (1 if k == 0 else 2) and rows[0].pos == 4 and (k == 0 or None in (rows[1].pos, rows[1].flag))


def test_raw_signals_are_read_as_codes(spark, tmp_path):
    line = "q\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*\t"
    (tmp_path / "a.sam").write_text(line + "fi:B:S,63,64,65535\trp:B:S,191,192,448\tri:B:C,0,64,255\n")
    got = text_formats.sam(spark, str(tmp_path / "a.sam")).first()
    assert (got.fi, got.rp, got.ri, got.fp) == ([63, 64, 255], [127, 128, 192], [0, 64, 255], None)
    assert bam_decode.codes("fi", "S", np.arange(1200)).tolist() == [r.c for r in spark.range(1200).select(kinetics.encode_frames(F.col("id")).alias("c")).collect()]
    for bad in ("fi:B:C,256", "fi:B:S,-1", "fi:B:i,1", "fi:B:C,x"):
        (tmp_path / "b.sam").write_text(line + bad + "\n")
        with pytest.raises(Exception):  # noqa: B017
            text_formats.sam(spark, str(tmp_path / "b.sam")).collect()


def test_fasta_records_begin_at_lines(spark, tmp_path):
    read = lambda text: [(tmp_path / "x.fa").write_bytes(text.encode()), sorted(tuple(r) for r in text_formats.fasta(spark, str(tmp_path / "x.fa")).collect())][1]
    assert read(">c1 a>b\nAC\n>c2\nGT\n") == [("c1", "a>b", "AC"), ("c2", "", "GT")]
    assert read("; note\n\n# other\n>c1\nAC\n") == [("c1", "", "AC")]
    assert read("\n>c1\r\nAC\r\nGT\r\n>c2 x\r\nA\r\n") == [("c1", "", "ACGT"), ("c2", "x", "A")]
    assert read(">c1\rAC\r>c2\rGT") == [("c1", "", "AC"), ("c2", "", "GT")]
    assert read("") == [] and read("\n") == []
    many = [(f"c{i}", "", "ACGT" * 50) for i in range(2000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # splits fall anywhere, between the two characters too
    try:
        assert read("".join(f">{n}\n{s}\n" for n, _, s in many)) == sorted(many)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_streaming(spark, tmp_path):
    rows = [("c", i % 5, (i % 10) / 10) for i in range(100)]
    df = spark.createDataFrame(rows, "chr string, coor int, prob double")
    df.where("prob < 0.5").write.parquet(str(tmp_path / "in" / "a"))
    df.where("prob >= 0.5").write.parquet(str(tmp_path / "in" / "b"))
    calls_in = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    stream.keep_updated(calls_in, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = stream.totals(spark.read.parquet(str(tmp_path / "out"))).select("chr", "coor", "above", "below", "ratio")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sites.site_frequency(df).collect()))
    q = stream.running_frequency(calls_in).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("running").agg(F.sum("above")).first()[0] == 50


def test_workflows(spark):
    r = random.Random(4)
    seqs = [(i, "".join(r.choices("ACGT", k=60))) for i in range(6)]
    rows = [(i, s, *([[r.randrange(256) for _ in s] for _ in range(4)])) for i, s in seqs]
    raw = spark.createDataFrame(rows, "read_id long, seq string, fi array<int>, ri array<int>, fp array<int>, rp array<int>")
    rng = np.random.default_rng(1)
    layers = [(rng.standard_normal((66, 8)).astype(np.float32), np.zeros(8, np.float32)), (rng.standard_normal((8, 2)).astype(np.float32), np.zeros(2, np.float32))]
    found = workflows.base_calls(raw, layers, least_length=10)
    got = found.collect()
    assert {(x.read_id, x.pos, x.base) for x in got} == {(i, p, b) for i, s in seqs for p, b in enumerate(s) if b in "AT"}
    i, s, fi, ri, fp, rp = rows[0]
    p = s.index("A")
    back = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    c, v = len(s) - 1 - p, []
    for d in range(-5, 6):
        k = min(max(c + d, 0), len(s) - 1)
        v += [float(back[k] == b) for b in "ACGT"] + [ri[k] / 255, rp[k] / 255]
    h = np.maximum(np.array(v, dtype=np.float32) @ layers[0][0], 0) @ layers[1][0]
    want = 1 / (1 + math.exp(float(h[0] - h[1])))
    assert abs(next(x.prob for x in got if (x.read_id, x.pos) == (i, p)) - want) < 1e-4
    tagged = workflows.tagged_reads(raw, found).collect()
    assert all(t.mm.startswith("A+m,0") for t in tagged)
    model = ml.Svm(np.zeros((1, 100)), np.array([1.0]), 0.5, gamma=0.0)
    assert {t.tag for t in workflows.read_classes(found, model).collect()} == {"+"}


def test_long_records_are_read_whole(spark, tmp_path):
    n = 1_000_001
    fields = ["q", "0", "c1", "11", "60", f"{n}M", "*", "0", "0", "A" * n, "*", *["xx:i:1"] * 10_000, "ec:f:7.5"]
    tags = [f"{t}:B:C" + ",7" * n for t in ("fi", "ML")] + ["ZP:B:f" + ",0.5" * n]
    (tmp_path / "a.sam").write_text("\t".join([*fields, *tags]) + "\n")
    got = text_formats.sam(spark, str(tmp_path / "a.sam")).selectExpr("ec", "size(fi) as fi", "size(ml) as ml", "size(zp) as zp", "fi[1000000] as last", "rp").first()
    assert (got.ec, got.fi, got.ml, got.zp, got.last, got.rp) == (7.5, n, n, n, 7, None)
    (tmp_path / "p.paf").write_text("q 100 0 90 + t 500 1 91 80 90 60 " + "xx:i:1 " * 1000 + "dv:f:0.01\n")
    assert text_formats.paf(spark, str(tmp_path / "p.paf")).first().tags.endswith("dv:f:0.01")
