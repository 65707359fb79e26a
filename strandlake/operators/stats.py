"""Statistics over groups of measurements, each in aggregates and windows; p-values by Arrow functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import substitution
from strandlake.operators.rows import numbered, ranged, totals
from strandlake.registry import query, table


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_tail(t: float | None, df: float | None) -> float | None:
    """Two-sided p of Student's t."""
    if t is None or df is None or math.isnan(t) or not df > 0:
        return None
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if x > 0 else 0.0
    return min(1.0, front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b)


def _t_tails(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(*x) for x in zip(t, df, strict=True)], dtype="float64")


def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2))).astype("float64")


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, in Arrow batches."""
    return F.pandas_udf(_t_tails, "double")(t, df)


def normal_p_value(z: Column) -> Column:
    """Two-sided p of a standard normal, in Arrow batches."""
    return F.pandas_udf(_normal_tails, "double")(z)


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sample standard deviation."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def mann_whitney(rows: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """U of the rows where ``side`` is true, and z of the normal form with tie and continuity corrections, by group.

    Ranks come from counts by distinct value, so a window sees distinct values only, whatever the number of rows. Without ``keys`` all rows
    are one group, whose values are put in order by ranges.
    """
    by_value = rows.where(F.col(value).isNotNull() & F.col(side).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("t"), F.count_if(F.col(side)).alias("t1"))
    if keys:
        before = F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = by_value.withColumn("rank", before + (F.col("t") + 1) / 2)
    else:
        ranked = numbered(by_value, value, name="before", weight="t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    out = ranked.groupBy(*keys).agg(F.sum("t1").alias("n1"), (F.sum("t") - F.sum("t1")).alias("n2"), F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2) - 0.5), spread)
    return out.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"))


def pooled_t(rows: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Student's t with pooled variance of the rows where ``side`` is true against the others, and its degrees of freedom, by group."""
    of = lambda f, own: f(F.when(F.col(side) if own else ~F.col(side), F.col(value)))
    g = rows.groupBy(*keys).agg(*[of(f, own).alias(f"{n}{2 - own}") for own in (True, False) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    df = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), df)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2"))))
    return g.where("n1 > 0 and n2 > 0").select(*keys, t.alias("t"), df.alias("df"))


def benjamini_hochberg(rows: DataFrame, p: str, id_col: str, group: list[str] | None = None) -> DataFrame:
    """Column ``adjusted``: p times m over its rank, never more than a later one's, at most 1. A missing p counts as 1.

    Without ``group`` all rows are one family, put in order by ranges that are written once: only each range's row count and least value are
    put in order by themselves. Ids order rows of equal p and change nothing else; they may repeat.
    """
    rows = rows.withColumn(p, F.coalesce(F.col(p), F.lit(1.0)))
    if group:
        own = Window.partitionBy(*group)
        ranked = rows.withColumns({"_m": F.count("*").over(own), "_r": F.row_number().over(own.orderBy(p, id_col))})
        least = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(own.orderBy(F.col("_r").desc()))
        return ranked.withColumn("adjusted", F.least(F.lit(1.0), least)).drop("_m", "_r")
    parts = ranged(rows, p, id_col)
    raw = parts.join(F.broadcast(totals(parts)), "_part").withColumn("_raw", F.col(p) * F.col("_all") / (F.col("_earlier") + F.col("_place") + 1))
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # one row a part
    later = raw.groupBy("_part").agg(F.min("_raw").alias("_least")).select("_part", F.min("_least").over(after).alias("_later"))
    within = F.min("_raw").over(Window.partitionBy("_part").orderBy(F.desc("_place")))
    out = raw.withColumn("_within", within).join(F.broadcast(later), "_part")
    return out.select(*rows.columns, F.least(F.lit(1.0), "_within", F.coalesce("_later", F.lit(1.0))).alias("adjusted"))


def proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-proportion z."""
    pool = (k1 + k2) / (n1 + n2)
    return F.try_divide(k1 / n1 - k2 / n2, F.sqrt(pool * (1 - pool) * (F.lit(1.0) / n1 + F.lit(1.0) / n2)))


def cohen_h(p1: Column, p2: Column) -> Column:
    return 2 * (F.asin(F.sqrt(p1)) - F.asin(F.sqrt(p2)))


def substitution_counts(vcf: DataFrame) -> DataFrame:
    """Rows by kind of change, one for each alternative allele."""
    each = vcf.select("ref", F.explode(F.split("alt", ",")).alias("alt")).select(substitution(F.col("ref"), F.col("alt")).alias("change"))
    return each.where("change is not null").groupBy("change").agg(F.count("*").alias("n"))


def binary_scores(rows: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: n, true and false positives and negatives, accuracy, sensitivity, specificity and AUC (by ranks, ties at half)."""
    yes, on = F.col(label) == 1, F.col(score) >= threshold
    counts = rows.agg(F.count("*").alias("n"), F.count_if(yes & on).alias("tp"), F.count_if(~yes & on).alias("fp"), F.count_if(~yes & ~on).alias("tn"), F.count_if(yes & ~on).alias("fn"))
    u = mann_whitney(rows.select(yes.alias("yes"), F.col(score).alias("s")), [], "yes", "s")
    auc = u.select(F.try_divide(F.col("u"), F.col("n1") * F.col("n2")).alias("auc"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return counts.crossJoin(auc).select("n", "tp", "fp", "tn", "fn", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), ratio("tp", "fn").alias("sensitivity"), ratio("tn", "fp").alias("specificity"), "auc")  # one row each


def common_keys(a: DataFrame, b: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Keys with ``least`` rows or more in both tables."""
    often = lambda df: df.groupBy(key).count().where(F.col("count") >= least).select(key)
    return often(a).intersect(often(b))


def median_ratio_normalised(z: DataFrame, n: DataFrame, key: str = "kmer", place: str = "place", value: str = "value") -> DataFrame:
    """Values of ``z`` divided by their key's factor, the median over its places of the ratio of medians to those of ``n``."""
    m = lambda df, name: df.groupBy(key, place).agg(F.median(value).alias(name))
    ratios = m(z, "mz").join(m(n, "mn"), [key, place]).withColumn("ratio", F.try_divide("mz", "mn"))
    factor = ratios.groupBy(key).agg(F.median("ratio").alias("factor"))
    return z.join(factor, key).withColumn(value, F.try_divide(F.col(value), F.col("factor")))


def signal_tests(z: DataFrame, n: DataFrame, key: str = "kmer", place: str = "place", value: str = "value") -> DataFrame:
    """(key, place, ratio, t, df, p, adjusted): ``n`` against ``z`` at each place, once the values of ``z`` are divided by their key's factor.

    ``ratio`` is that of the medians, z over n. All places of all keys are one family for the adjustment; a missing p counts as 1.
    Places that lack one of the sides give no row.
    """
    side = lambda df, plain: df.select(key, place, value, F.lit(plain).alias("plain"))
    both = side(median_ratio_normalised(z, n, key, place, value), False).unionByName(side(n, True))
    median = lambda cond: F.median(F.when(cond, F.col(value)))
    ratios = both.groupBy(key, place).agg(F.try_divide(median(~F.col("plain")), median(F.col("plain"))).alias("ratio"))
    tests = pooled_t(both, [key, place], "plain", value).join(ratios, [key, place])
    tests = tests.withColumns({"p": t_p_value(F.col("t"), F.col("df").cast("double")), "_id": F.struct(key, place)})
    return benjamini_hochberg(tests, "p", "_id").select(key, place, "ratio", "t", "df", "p", "adjusted")


_QV = "SELECT l_linenumber AS np, l_quantity AS qv, l_returnflag AS platform, l_linestatus = 'O' AS z FROM lineitem WHERE l_quantity < 100"


def _qv(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").where("l_quantity < 100")
    return i.select(F.col("l_linenumber").alias("np"), F.col("l_quantity").alias("qv"), F.col("l_returnflag").alias("platform"), (F.col("l_linestatus") == "O").alias("z"))


@query("a11_f17_summary", f"SELECT np, platform, count(*) AS n, round(avg(qv), 6) AS mean, round(stddev_samp(qv), 6) AS std FROM ({_QV}) GROUP BY 1, 2")
def qv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_qv(spark, sf_dir), ["np", "platform"], "qv").select("np", "platform", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "a12_mannwhitney_u",
    f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY np ORDER BY qv) + (count(*) OVER (PARTITION BY np, qv) - 1) / 2.0 AS rk FROM ({_QV})),
        t AS (SELECT np, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT np, count(*)::DOUBLE AS c FROM r GROUP BY np, qv) GROUP BY np),
        g AS (SELECT np, count(*) FILTER (WHERE z) AS n1, count(*) FILTER (WHERE NOT z) AS n2, sum(rk) FILTER (WHERE z)::DOUBLE AS r1 FROM r GROUP BY np)
        SELECT np, n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 3)::DOUBLE AS u,
               round(greatest(0, abs(r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) - 0.5) / sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))), 6) AS zscore FROM g JOIN t USING (np)""",
)
def u_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mann_whitney(_qv(spark, sf_dir), ["np"], "z", "qv").select("np", "n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("zscore"))


@query(
    "a13_ttest_stat",
    f"""SELECT np, platform, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t, n1 + n2 - 2 AS df
        FROM (SELECT np, platform, count(*) FILTER (WHERE z) AS n1, count(*) FILTER (WHERE NOT z) AS n2, avg(qv) FILTER (WHERE z) AS m1, avg(qv) FILTER (WHERE NOT z) AS m2,
              var_samp(qv) FILTER (WHERE z) AS v1, var_samp(qv) FILTER (WHERE NOT z) AS v2 FROM ({_QV}) GROUP BY 1, 2) WHERE n1 > 0 AND n2 > 0""",
)
def t_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled_t(_qv(spark, sf_dir), ["np", "platform"], "z", "qv").withColumn("t", F.round("t", 6))


def _tail_sql(rows: str, keys: str) -> str:
    """(keys, p): two-sided p of Student's t, by Simpson's rule over the density in the angle whose tangent is t over the root of df."""
    return f"""SELECT {keys}, 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * top / 6000 * sum(CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * pow(cos(top * j / 2000), df - 1)) AS p
        FROM (SELECT *, atan(abs(t) / sqrt(df)) AS top FROM {rows} WHERE t IS NOT NULL), range(2001) AS r(j) GROUP BY {keys}, df, top"""


_T_SQL = """CASE WHEN n1 + n2 > 2 THEN (m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 0) END"""


def _sides_sql(rows: str, keys: str, side: str, value: str) -> str:
    of = lambda f, own: f"{f}({value}) FILTER (WHERE {'' if own else 'NOT '}{side})"
    parts = ", ".join(f"{of(f, own)} AS {n}{2 - own}" for own in (True, False) for n, f in (("n", "count"), ("m", "avg"), ("v", "var_samp")))
    return f"SELECT {keys}, n1 + n2 - 2 AS df, {_T_SQL} AS t FROM (SELECT {keys}, {parts} FROM {rows} GROUP BY {keys}) WHERE n1 > 0 AND n2 > 0"


@query("a13_p_values", f"""WITH t AS ({_sides_sql(f"({_QV})", "np, platform", "z", "qv")}), p AS ({_tail_sql("t", "np, platform")})
    SELECT np, platform, round(t, 6) AS t, df, round(p, 6) AS p FROM t LEFT JOIN p USING (np, platform)""")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pooled_t(_qv(spark, sf_dir), ["np", "platform"], "z", "qv").withColumn("p", t_p_value(F.col("t"), F.col("df").cast("double")))
    return out.select("np", "platform", F.round("t", 6).alias("t"), "df", F.round("p", 6).alias("p"))


_P = "SELECT l_orderkey * 8 + l_linenumber AS id, ((l_orderkey * 7919 + l_linenumber * 389) % 1000 + 1) / 1001.0::DOUBLE AS p, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2"


def _ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 389) % 1000 + 1) / F.lit(1001.0)
    keys = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), p.alias("p")
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min("l_partkey").alias("part"))


def _bh_sql(group: str) -> str:
    return f"""WITH x AS ({_P}), r AS (SELECT *, row_number() OVER ({group} ORDER BY p, id) AS r, count(*) OVER ({group}) AS m FROM x)
        SELECT id, part, round(least(1.0, min(p * m / r) OVER ({group} ORDER BY r DESC)), 9) AS adjusted FROM r"""


@query("a15_bh_adjust", _bh_sql(""))
def bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benjamini_hochberg(_ps(spark, sf_dir), "p", "id").select("id", "part", F.round("adjusted", 9).alias("adjusted"))


@query("a16_a17_proportions", """WITH c AS (SELECT l_linenumber AS cat, count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS k1, count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE AS k2 FROM lineitem GROUP BY 1),
    s AS (SELECT *, sum(k1) OVER () AS n1, sum(k2) OVER () AS n2 FROM c)
    SELECT cat, round((k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z, round(2 * (asin(sqrt(k1 / (n1 / 1.695))) - asin(sqrt(k2 / n2))), 6) AS h FROM s""")
def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    c = i.groupBy(F.col("l_linenumber").alias("cat")).agg(F.count_if(F.col("l_linestatus") == "O").cast("double").alias("k1"), F.count_if(F.col("l_linestatus") == "F").cast("double").alias("k2"))
    total = c.agg(F.sum("k1").alias("n1"), F.sum("k2").alias("n2"))
    s = c.crossJoin(F.broadcast(total))  # one row
    z = proportion_z(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    h = cohen_h(F.col("k1") / (F.col("n1") / 1.695), F.col("k2") / F.col("n2"))
    return s.select("cat", F.round(z, 6).alias("z"), F.round(h, 6).alias("h"))


@query("a9_p38_substitutions", """WITH v AS (SELECT ['A', 'C', 'G', 'T', 'N', 'AT'][event_id % 6 + 1] AS ref, unnest(string_split(['C,T', 'G', 'A', '<*>', 'CC', 'T,G'][event_id % 7 % 6 + 1], ',')) AS alt FROM events),
    k AS (SELECT CASE WHEN ref = 'N' OR alt = '<*>' THEN NULL WHEN len(ref) < len(alt) THEN 'INS' WHEN len(ref) > len(alt) THEN 'DEL' WHEN ref IN ('A', 'G') THEN translate(ref || '->' || alt, 'ACGT', 'TGCA') ELSE ref || '->' || alt END AS change FROM v)
    SELECT change, count(*) AS n FROM k WHERE change IS NOT NULL GROUP BY 1""")
def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    return substitution_counts(e.select(pick(["A", "C", "G", "T", "N", "AT"], F.col("event_id") % 6).alias("ref"), pick(["C,T", "G", "A", "<*>", "CC", "T,G"], F.col("event_id") % 7 % 6).alias("alt")))


_SCORES = "SELECT doc_id, quality AS y, (doc_id * 7919 % 100003) / 100000.0::DOUBLE * 0.5 + quality * 0.3 AS s FROM labels"


@query("a18_a19_binary_scores", f"""WITH r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM ({_SCORES})),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE y <> 1 AND s >= 0.5) AS fp, count(*) FILTER (WHERE y <> 1 AND s < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND s < 0.5) AS fn,
          sum(rk) FILTER (WHERE y = 1)::DOUBLE AS r1 FROM r)
    SELECT n, tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round((r1 - (tp + fn) * (tp + fn + 1) / 2.0) / ((tp + fn) * (tn + fp)), 6)::DOUBLE AS auc FROM c""")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") * 7919 % 100003) / 100000.0 * 0.5 + F.col("quality") * 0.3).alias("s"))
    out = binary_scores(rows, "y", "s")
    return out.select("n", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "sensitivity", "specificity", "auc")])


@query("u2_f20_kmer_intersect", """SELECT l_partkey AS kmer FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 HAVING count(*) >= 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING count(*) >= 10""")
def kmer_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("kmer"), "l_linestatus")
    return common_keys(i.where("l_linestatus = 'O'"), i.where("l_linestatus = 'F'"), "kmer")


@query("a14_p39_normalised", """WITH v AS (SELECT l_suppkey AS kmer, l_linenumber AS place, l_quantity + 0.5 AS value, l_linestatus = 'O' AS z FROM lineitem),
    m AS (SELECT kmer, place, median(value) FILTER (WHERE z) AS mz, median(value) FILTER (WHERE NOT z) AS mn FROM v GROUP BY 1, 2), f AS (SELECT kmer, median(mz / mn) AS factor FROM m WHERE mz IS NOT NULL AND mn IS NOT NULL GROUP BY 1)
    SELECT kmer, place, count(*) AS n, round(sum(value / factor), 4) AS total FROM v JOIN f USING (kmer) WHERE z GROUP BY 1, 2""")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("kmer"), F.col("l_linenumber").alias("place"), (F.col("l_quantity") + 0.5).alias("value"), "l_linestatus")
    out = median_ratio_normalised(v.where("l_linestatus = 'O'"), v.where("l_linestatus = 'F'"))
    return out.groupBy("kmer", "place").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("u3_unpivot", "SELECT platform, measure, round(value, 6) AS value FROM (UNPIVOT (SELECT l_returnflag AS platform, avg(l_quantity) AS mean_qv, stddev_samp(l_quantity) AS std_qv FROM lineitem GROUP BY 1) ON mean_qv, std_qv INTO NAME measure VALUE value)")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("platform")).agg(F.avg("l_quantity").alias("mean_qv"), F.stddev_samp("l_quantity").alias("std_qv"))
    return wide.unpivot("platform", ["mean_qv", "std_qv"], "measure", "value").withColumn("value", F.round("value", 6))


@query("j10_platform_join", "WITH a AS (SELECT l_linenumber AS np, avg(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber < 6 GROUP BY 1), b AS (SELECT l_linenumber AS np, avg(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 2 GROUP BY 1) SELECT np, coalesce(round(a.m, 6), -1) AS a, coalesce(round(b.m, 6), -1) AS b FROM a FULL JOIN b USING (np)")
def platform_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "np")
    mean = lambda cond, name: i.where(cond).groupBy("np").agg(F.round(F.avg("l_quantity"), 6).alias(name))
    return mean("l_returnflag = 'A' and np < 6", "a").join(mean("l_returnflag = 'R' and np > 2", "b"), "np", "full").fillna(-1.0)


_SIGNALS = "SELECT l_suppkey AS kmer, l_linenumber AS place, l_quantity + 0.5 AS value, l_linestatus = 'O' AS z FROM lineitem"


@query("a13_a15_signal_tests", f"""WITH v AS ({_SIGNALS}),
    m AS (SELECT kmer, place, median(value) FILTER (WHERE z) AS mz, median(value) FILTER (WHERE NOT z) AS mn FROM v GROUP BY 1, 2),
    f AS (SELECT kmer, median(mz / mn) AS factor FROM m WHERE mz IS NOT NULL AND mn IS NOT NULL GROUP BY 1),
    b AS (SELECT kmer, place, NOT z AS plain, CASE WHEN z THEN value / factor ELSE value END AS value FROM v LEFT JOIN f USING (kmer) WHERE factor IS NOT NULL OR NOT z),
    t AS ({_sides_sql("b", "kmer, place", "plain", "value")}), p AS ({_tail_sql("t", "kmer, place")}),
    q AS (SELECT kmer, place, median(value) FILTER (WHERE NOT plain) / median(value) FILTER (WHERE plain) AS ratio FROM b GROUP BY 1, 2),
    x AS (SELECT kmer, place, ratio, t, df, coalesce(p, 1) AS p FROM t LEFT JOIN p USING (kmer, place) JOIN q USING (kmer, place)),
    r AS (SELECT *, row_number() OVER (ORDER BY p, kmer, place) AS r, count(*) OVER () AS m FROM x)
    SELECT kmer, place, round(ratio, 6) AS ratio, round(t, 6) AS t, df, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC)), 6) AS adjusted FROM r""")
def tested_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order quantities by supplier and line stand for signals by k-mer and place."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("kmer"), F.col("l_linenumber").alias("place"), (F.col("l_quantity") + 0.5).alias("value"), "l_linestatus")
    out = signal_tests(v.where("l_linestatus = 'O'"), v.where("l_linestatus = 'F'"))
    return out.select("kmer", "place", "df", *[F.round(c, 6).alias(c) for c in ("ratio", "t", "p", "adjusted")])
