"""Models: scoring with given weights, support vector machines in the usual text format, and Spark ML trainers."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators import machines, svm
from strandlake.operators.rows import dropped, held, small_batches
from strandlake.operators.svm import Svm
from strandlake.registry import query, table

# --- support vector machines -------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def kernel(name: str, a: Column, b: Column, gamma: float = 0.5, coef0: float = 0.0, degree: int = 3) -> Column:
    """linear, polynomial, rbf or sigmoid."""
    if name == "linear":
        return dot(a, b)
    if name == "polynomial":
        return F.pow(gamma * dot(a, b) + coef0, F.lit(float(degree)))
    if name == "rbf":
        return F.exp(-gamma * squared_distance(a, b))
    if name == "sigmoid":
        return F.tanh(gamma * dot(a, b) + coef0)
    raise ValueError(f"no kernel {name}")


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, gamma: float = 0.5, name: str = "rbf", eps: float = 1e-3, most: int | None = None) -> Svm:
    """A C-SVC; see ``svm.train`` for the other forms."""
    return svm.train(x, y, "c_svc", cost=cost, gamma=gamma, name=name, eps=eps, most=most)


def predict_reads(shares: DataFrame, model: Svm, vector: str = "features", n_calls: str = "n_calls", least_calls: int = 1) -> DataFrame:
    """Column ``tag``: * for too few calls, - for label -1, + otherwise. The machine goes along as a broadcast variable."""
    small_batches(shares.sparkSession)
    shared = shares.sparkSession.sparkContext.broadcast(model)

    def score(s: pd.Series) -> pd.Series:
        x = np.array([np.asarray(v, dtype=np.float64) for v in s]).reshape(len(s), -1)
        return pd.Series(shared.value.decide(x) if len(s) else [], dtype="float64")

    score.__annotations__ = {"s": pd.Series, "return": pd.Series}
    decided = F.pandas_udf(score, "double")
    label = F.when(F.col("decision") > 0, model.labels[0]).otherwise(model.labels[1])
    return shares.withColumn("decision", decided(vector)).withColumn("tag", F.when(F.col(n_calls) < least_calls, "*").when(label == -1, "-").otherwise("+"))


#: Rows that a machine is fitted on.
MOST_TRAINING_ROWS = 2000


def bounded_sample(rows: DataFrame, label: str, id_col: str, most: int = MOST_TRAINING_ROWS, seed: int = 42) -> DataFrame:
    """Some ``most`` rows or fewer in the classes' own proportions, picked by a hash of the id; all rows if there are no more."""
    total = rows.count()
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return rows.where(place < most / total) if total > most else rows


def out_of_fold(rows: DataFrame, grid: list[tuple[float, float]], folds: int = 5, vector: str = "features", label: str = "label", id_col: str = "vec_id", seed: int = 42) -> DataFrame:
    """(cost, gamma, fold, id, label, decision): for each pair of ``grid``, each row's decision by the machine trained on the other folds.

    Labels are above 0 for the first class. Classes are dealt evenly over the folds. Each pair and fold is a group of its own that takes all of
    ``rows``, so pass a ``bounded_sample``. A fold whose training rows are all of one class decides for that class.
    """
    own = Window.partitionBy(label).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)
    dealt = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("label"), ((F.row_number().over(own) - 1) % folds).alias("own_fold"))
    runs = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cost"), F.lit(float(g)).alias("gamma"), F.lit(i).alias("fold")) for c, g in grid for i in range(folds)]))
    each = dealt.withColumn("run", runs).select("run.*", "id", "x", "label", "own_fold")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        held = group["own_fold"] == group["fold"]
        y = np.where(group["label"] > 0, 1.0, -1.0)
        x = np.stack(group["x"].to_numpy())
        seen, out = y[~held], group.loc[held, ["cost", "gamma", "fold", "id", "label"]]
        if len(set(seen)) < 2:
            return out.assign(decision=float(seen[0]) if len(seen) else 0.0)
        return out.assign(decision=train_svm(x[~held], seen, group["cost"].iloc[0], group["gamma"].iloc[0]).decide(x[held]))

    kind = rows.schema[id_col].dataType.simpleString()
    return each.groupBy("cost", "gamma", "fold").applyInPandas(fit, f"cost double, gamma double, fold int, id {kind}, label double, decision double")


def grid_search(rows: DataFrame, costs: list[float] | None = None, gammas: list[float] | None = None, **options) -> DataFrame:  # noqa: ANN003
    """(cost, gamma, n, accuracy) by cross validation, best first. By default powers of two: costs from -5 to 15, widths from 3 down to -15, in steps of 2."""
    costs, gammas = costs or [2.0**i for i in range(-5, 16, 2)], gammas or [2.0**i for i in range(3, -16, -2)]
    decided = out_of_fold(rows, [(c, g) for c in costs for g in gammas], **options)
    right = (F.col("decision") > 0) == (F.col("label") > 0)
    return decided.groupBy("cost", "gamma").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy")).orderBy(F.desc("accuracy"), "cost", "gamma")


def fit_sigmoid(rows: DataFrame, decision: str = "decision", label: str = "label") -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(a * decision + b)), by likelihood under targets drawn in from 0 and 1 by the class counts.

    A row with target t goes in as a positive of weight t and a negative of weight 1 - t. Without rows both are 0.
    """
    yes, n = rows.agg(F.count_if(F.col(label) > 0), F.count("*")).first()
    if not n:
        return 0.0, 0.0
    target = F.when(F.col(label) > 0, F.lit((yes + 1) / (yes + 2))).otherwise(F.lit(1 / (n - yes + 2)))
    halves = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w"))))
    weighted = rows.select(array_to_vector(F.array(F.col(decision).cast("double"))).alias("x"), halves.alias("h")).select("x", "h.y", "h.w")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", tol=1e-9).fit(weighted)
    return -float(model.coefficients[0]), -float(model.intercept)


def with_probability(rows: DataFrame, a: float, b: float, decision: str = "decision") -> DataFrame:
    """Column ``prob`` of the first class."""
    return rows.withColumn("prob", 1 / (1 + F.exp(a * F.col(decision) + b)))


class Classes(NamedTuple):
    """One machine for each pair of classes, and the two numbers of its sigmoid."""

    labels: list
    machines: list[tuple[int, int, Svm, float, float]]


def fit_classes(rows: DataFrame, cost: float = 1.0, gamma: float = 0.5, folds: int = 5, vector: str = "features", label: str = "label", id_col: str = "vec_id", most: int = MOST_TRAINING_ROWS, seed: int = 42) -> Classes:
    """A one-versus-one machine for each pair of classes, with a sigmoid fitted on decisions out of folds.

    Fitted on some ``most`` rows or fewer. Each pair is a group of its own, so the pairs are fitted side by side. Rows of a null label are left out.
    """
    seen = bounded_sample(rows.where(F.col(label).isNotNull()), label, id_col, most, seed).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).alias("label"))
    labels = sorted(r[0] for r in seen.select("label").distinct().collect())  # no more than rows of the sample
    if len(labels) < 2:
        return Classes(labels, [])
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda j: F.struct(F.least(j, "own").alias("a"), F.greatest(j, "own").alias("b"))))
    each = seen.withColumn("own", place).withColumn("p", pairs).where("p.a < p.b").select("id", "x", "own", "p.a", "p.b")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x, y = np.stack(group["x"].to_numpy()), np.where(group["own"] == group["a"], 1.0, -1.0)
        fold, decision = np.zeros(len(y), dtype=np.int64), np.zeros(len(y))
        for k in (1, -1):
            fold[y == k] = np.arange((y == k).sum()) % folds
        for f in range(folds):
            held, rest = fold == f, fold != f
            if held.any():
                decision[held] = svm.train(x[rest], y[rest], cost=cost, gamma=gamma).decide(x[held]) if len(set(y[rest])) > 1 else (y[rest][:1] if rest.any() else 0.0)
        a, b = svm.sigmoid_of(decision, y > 0)
        return pd.DataFrame([(int(group["a"].iloc[0]), int(group["b"].iloc[0]), svm.train(x, y, cost=cost, gamma=gamma).to_text(), a, b)], columns=["a", "b", "machine", "slope", "offset"])

    found = each.groupBy("a", "b").applyInPandas(fit, "a int, b int, machine string, slope double, offset double").collect()  # vectors of the sample, once a pair
    dims = len(seen.first().x)
    return Classes(labels, sorted((r.a, r.b, Svm.from_text(r.machine, dims), r.slope, r.offset) for r in found))


def class_probabilities(rows: DataFrame, model: Classes, vector: str = "features") -> DataFrame:
    """Columns ``probs``, in the order of the model's labels, and ``predicted``, the likeliest label (the first of equal ones). A null vector has null in both."""
    small_batches(rows.sparkSession)
    shared, k = rows.sparkSession.sparkContext.broadcast(model), len(model.labels)

    def score(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        x = np.array([np.asarray(v, dtype=np.float64) for v in s[known]]).reshape(int(known.sum()), -1)
        out = np.full(len(s), None, dtype=object)
        if len(x):
            r = np.zeros((len(x), k, k))
            for a, b, m, slope, offset in shared.value.machines:
                r[:, a, b] = 1 / (1 + np.exp(np.clip(slope * m.decide(x) + offset, -500, 500)))
                r[:, b, a] = 1 - r[:, a, b]
            p = svm.coupled(r) if k > 1 else np.ones((len(x), 1))
            for i, v in zip(np.flatnonzero(known), p.tolist(), strict=True):
                out[i] = v
        return pd.Series(out)

    score.__annotations__ = {"s": pd.Series, "return": pd.Series}
    out = rows.withColumn("probs", F.pandas_udf(score, "array<double>")(vector))
    return out.withColumn("predicted", F.get(F.array(*map(F.lit, model.labels)), F.array_position("probs", F.array_max("probs")).cast("int") - 1))


# --- networks and trainers ---------------------------------------------------------------------------------------


def score_network(rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], vector: str = "features", precision: type = np.float32) -> DataFrame:
    """Column ``prob``: softmax of the second output of a fully connected network with rectified hidden layers, in the arithmetic of ``precision``."""
    shared = rows.sparkSession.sparkContext.broadcast(layers)

    def forward(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype="float64")
        x = np.stack([np.asarray(v, dtype=precision) for v in s])
        for i, (w, b) in enumerate(shared.value):
            x = x @ w + b
            if i + 1 < len(shared.value):
                x = np.maximum(x, 0)
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return pd.Series((e[:, 1] / e.sum(axis=1)).astype("float64"))

    forward.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return rows.withColumn("prob", F.pandas_udf(forward, "double")(vector))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") >= 5).cast("double").alias("label"))


def forest_importance(rows: DataFrame, trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance), largest first."""
    model = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=5).fit(rows)
    pairs = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    return rows.sparkSession.createDataFrame(pairs, "feature int, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(rows: DataFrame, model, features: list[int], seed: int = 7) -> DataFrame:  # noqa: ANN001
    """(feature, loss): fall of AUC when one feature's values are shuffled over the rows, for any model; ``nets`` has gradient explanations."""
    rate = BinaryClassificationEvaluator()
    whole, out = rate.evaluate(model.transform(rows)), []
    arrays = rows.withColumn("a", vector_to_array("features"))
    for f in features:
        # Each row takes the value of the row that follows it in an order by hashes, within one of many groups.
        group, order = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(64)), F.xxhash64("vec_id", F.lit(seed + f))
        own = Window.partitionBy(group).orderBy(order)
        drawn = arrays.withColumn("_v", F.coalesce(F.lead(F.get("a", f)).over(own), F.get("a", f)))
        mixed = drawn.withColumn("features", array_to_vector(F.concat(F.slice("a", 1, f), F.array("_v"), F.slice("a", f + 2, F.size("a")))))
        out.append((f, float(whole - rate.evaluate(model.transform(mixed)))))
    return rows.sparkSession.createDataFrame(out, "feature int, loss double")


def standardised(rows: DataFrame) -> DataFrame:
    """Zero mean and unit (population) standard deviation, column ``scaled``."""
    n = rows.count()
    model = StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True).fit(rows)
    return model.transform(rows).withColumn("scaled", F.transform(vector_to_array("_s"), lambda x: x * float(np.sqrt(n / max(1, n - 1))))).drop("_s")


def principal_components(rows: DataFrame, k: int = 2) -> DataFrame:
    centred = StandardScaler(inputCol="features", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    return PCA(k=k, inputCol="_c", outputCol="components").fit(centred).transform(centred).drop("_c")


def _machine(spark: SparkSession, sf_dir: str) -> Svm:
    """Five fixed vectors with alternating coefficients."""
    v = table(spark, sf_dir, "embeddings").where("vec_id < 5").orderBy("vec_id").collect()
    return Svm(np.array([r.embedding for r in v]), np.array([(-1.0) ** i * (i + 1) / 4 for i in range(len(v))]), 0.1)


@query("m4_svm_predict", """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, (CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE -1.0 END * (vec_id + 1) / 4)::DOUBLE AS c FROM embeddings WHERE vec_id < 5),
    d AS (SELECT v.vec_id, sum(s.c * exp(-0.5 * pow(list_distance(v.embedding::DOUBLE[], s.e), 2))) - 0.1 AS d FROM embeddings v, s GROUP BY 1)
    SELECT vec_id, round(d, 6) AS decision, CASE WHEN vec_id % 11 < 3 THEN '*' WHEN d > 0 THEN '+' ELSE '-' END AS tag FROM d""")
def svm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("vec_id") % 11).alias("n_calls"))
    out = predict_reads(rows, Svm.from_text(_machine(spark, sf_dir).to_text(), 64), least_calls=3)
    return out.select("vec_id", F.round("decision", 6).alias("decision"), "tag")


@query("m6_kernels", """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS linear, round(pow(0.5 * list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1, 3), 6) AS polynomial,
    round(exp(-0.5 * pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)), 6) AS rbf, round(tanh(0.5 * list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1), 6) AS sigmoid
    FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 0) b""")
def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    one = e.where("vec_id = 0").select(F.col("a").alias("b")).limit(1)
    both = e.crossJoin(F.broadcast(one))  # one row
    return both.select("vec_id", *[F.round(kernel(k, F.col("a"), F.col("b"), coef0=1.0), 6).alias(k) for k in ("linear", "polynomial", "rbf", "sigmoid")])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("label") >= 5, 1).otherwise(-1).alias("label"))
    return bounded_sample(rows, "label", "vec_id")


@query("m10_m13_grid_search")
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_search(_samples(spark, sf_dir), [0.5, 2.0], [0.25, 0.5], vector="embedding")


@query("m9_probabilities")
def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all rows: the machine is fitted on a bounded sample, the sigmoid on that sample's out-of-fold decisions."""
    seen = _samples(spark, sf_dir)
    a, b = fit_sigmoid(held(out_of_fold(seen, [(1.0, 0.5)], vector="embedding"), "decisions"))
    local = seen.orderBy("vec_id").toPandas()
    model = train_svm(np.stack(local["embedding"].to_numpy()).astype(np.float64), local["label"].to_numpy(dtype=np.float64))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.lit(1).alias("n_calls"))
    return with_probability(predict_reads(rows, model), a, b).select("vec_id", "decision", "prob")


@query("m9_class_probabilities")
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all ten classes for all rows; the machines are fitted on a bounded sample."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), "label")
    return class_probabilities(rows, fit_classes(rows)).select("vec_id", "label", "predicted", F.transform("probs", lambda p: F.round(p, 6)).alias("probs"))


@query("m2_m3_train_validate")
def train_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine fitted on 70 % of each class, all of those rows, and its counts on all other rows."""
    from strandlake.operators.sources_lr import stratified_split
    from strandlake.operators.stats import binary_scores

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.when(F.col("label") >= 5, 1).otherwise(-1).alias("label"))
    split = stratified_split(rows, "label", "vec_id")
    machine = machines.fit(split.where("train"))
    decided = machines.decided(split.where("not train"), machine, "label")
    dropped(machine.support)
    return binary_scores(decided, "label", "decision", 0.0)


@query("m12_minmax", "WITH m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_discount) AS dlo, max(l_discount) AS dhi FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 6) AS q, round((l_discount - dlo) / (dhi - dlo), 6) AS d FROM lineitem, m")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("features", array_to_vector(F.array("l_quantity", "l_discount")))
    out = MinMaxScaler(inputCol="features", outputCol="s").fit(rows).transform(rows).withColumn("s", vector_to_array("s"))
    return out.select("l_orderkey", "l_linenumber", F.round(F.get("s", 0), 6).alias("q"), F.round(F.get("s", 1), 6).alias("d"))


@query("m19_standardise", "SELECT vec_id, round((embedding[1] - (SELECT avg(embedding[1]::DOUBLE) FROM embeddings)) / (SELECT stddev_pop(embedding[1]::DOUBLE) FROM embeddings), 6) AS x FROM embeddings")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardised(labelled_vectors(spark, sf_dir)).select("vec_id", F.round(F.get("scaled", 0), 6).alias("x"))


@query("m14_forest_importance")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_importance(labelled_vectors(spark, sf_dir))


@query("m20_pca")
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return principal_components(labelled_vectors(spark, sf_dir)).select("vec_id", vector_to_array("components").alias("components"))


@query("m1_network_scores", """WITH h AS (SELECT vec_id, j, greatest(0, sum(embedding[i + 1]::DOUBLE * sin(16 * i + j + 1) / 4)) AS h FROM embeddings, range(64) AS a(i), range(16) AS b(j) GROUP BY vec_id, j),
    o AS (SELECT vec_id, sum(h * cos(2 * j + 1) / 2) AS a, sum(h * cos(2 * j + 2) / 2) AS b FROM h GROUP BY vec_id)
    SELECT vec_id, round(1 / (1 + exp(a - b)), 6) AS prob FROM o""")
def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With weights of a fixed rule, as published ones don't come with the data; in doubles, so that SQL can tell."""
    i, j, k = np.arange(64)[:, None], np.arange(16), np.arange(2)
    layers = [(np.sin(16 * i + j + 1) / 4, np.zeros(16)), (np.cos(2 * j[:, None] + k + 1) / 2, np.zeros(2))]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    return score_network(rows, layers, precision=np.float64).select("vec_id", F.round("prob", 6).alias("prob"))
