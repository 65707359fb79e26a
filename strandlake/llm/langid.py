"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

A text is described by hashed counts of its byte pairs and triples (A-Z lower-cased, every run of ASCII other than
letters as one space), each taken to the square root and scaled to length one, so that a text's length and repeats matter little.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import kernel
from strandlake.llm.store import let_go, small_batches

FEATURES = 2048
#: Labelled rows to fit on: some SAMPLE_ROWS in all and PER_LANGUAGE of a language, picked by a hash of their ids.
SAMPLE_ROWS, PER_LANGUAGE = 4000, 800
#: Languages that are learnt, those with most rows (equal ones by name). There is a machine for each pair of families, so with many their number is what counts.
MOST_LANGUAGES = 100
UNKNOWN = "und"
#: Families of closely related languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}

#: A-Z lower-cased, letters and bytes beyond ASCII as they are, the rest a space.
_CLEAN = np.full(256, 32, dtype=np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text, and whether it has a letter."""
    buf, at = kernel.text_bytes(col)
    clean = _CLEAN[buf]
    out = np.zeros((len(at) - 1, FEATURES), dtype=np.float32)
    lettered = np.zeros(len(at) - 1, dtype=bool)
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        t = clean[lo:hi]
        if len(t):
            t = t[(t != 32) | np.append(True, t[:-1] != 32)]
        plain = t < 128
        lettered[i] = bool((plain & (t != 32)).any()) or (not plain.all() and any(c.isalpha() for c in buf[lo:hi].tobytes().decode("utf-8", "replace")))
        if lettered[i]:
            t = np.concatenate([[32], t, [32]]).astype(np.uint32)
            pairs = t[:-1] * np.uint32(0x9E3779B1) + t[1:] * np.uint32(0x85EBCA77)
            triples = pairs[:-1] + t[2:] * np.uint32(0xC2B2AE3D)
            hashed = np.concatenate([pairs, triples + np.uint32(0x27D4EB2F)])
            hashed = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(21)
            count = np.sqrt(np.bincount(hashed, minlength=FEATURES))
            out[i] = count / np.linalg.norm(count)
    return out, lettered


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss; y is -1 or 1. Newton steps by conjugate gradients."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    weight = cost * len(y) / (2 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum()))) * 100 / len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        gradient = w - 2 * x[on].T @ (weight[on] * slack[on] * y[on])
        if np.linalg.norm(gradient) < 1e-6:
            break
        xs, ws = x[on], weight[on]
        step, rest = np.zeros_like(w), -gradient
        way, size = rest.copy(), rest @ rest
        for _ in range(50):
            image = way + 2 * xs.T @ (ws * (xs @ way))
            far = size / (way @ image)
            step += far * way
            rest -= far * image
            if (now := rest @ rest) < 1e-12:
                break
            way, size = rest + now / size * way, now
        w += step
    return w


class Machines(NamedTuple):
    """One-versus-one machines of some names: of each, the places of its two names, and its weights (the bias last)."""

    names: list[str]
    first: np.ndarray
    second: np.ndarray
    weights: np.ndarray


class Model(NamedTuple):
    between: Machines  # families
    within: dict[str, Machines]  # languages of each family

    @property
    def languages(self) -> list[str]:
        return sorted(n for m in self.within.values() for n in m.names)


NOTHING = Model(Machines([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FEATURES + 1))), {})


def _vote(x: np.ndarray, m: Machines) -> tuple[np.ndarray, np.ndarray]:
    """Winner of all one-versus-one decisions, and its mean squashed margin. Equal wins go to the larger sum of squashed margins, then to the first name."""
    p = 1 / (1 + np.exp(-2 * np.clip(x @ m.weights[:, :-1].T + m.weights[:, -1], -30, 30)))
    wins, total = np.zeros((len(x), len(m.names))), np.zeros((len(x), len(m.names)))
    for i in range(len(m.names)):
        a, b = m.first == i, m.second == i
        wins[:, i] = (p[:, a] >= 0.5).sum(axis=1) + (p[:, b] <= 0.5).sum(axis=1)
        total[:, i] = p[:, a].sum(axis=1) + (1 - p[:, b]).sum(axis=1)
    best = (wins + total / (len(m.names) + 1)).argmax(axis=1)
    return best, total[np.arange(len(x)), best] / max(1, len(m.names) - 1) if len(m.names) > 1 else np.ones(len(x))


def pairs_of(langs: np.ndarray) -> tuple[list[str], dict[str, list[str]], list[tuple[str | None, str, str]]]:
    """Families, the languages of each, and all machines to fit: (None, family, family) or (family, language, language)."""
    names = sorted(set(langs.tolist()))
    families = sorted({_FAMILY.get(n, n) for n in names})
    languages = {f: [n for n in names if _FAMILY.get(n, n) == f] for f in families}
    return families, languages, [(None, a, b) for a, b in combinations(families, 2)] + [(f, a, b) for f in families for a, b in combinations(languages[f], 2)]


def machine(x: np.ndarray, langs: np.ndarray, family: str | None, a: str, b: str) -> np.ndarray:
    """Weights of the machine that tells two families, or two languages of a family, apart."""
    own = langs if family is not None else np.array([_FAMILY.get(n, n) for n in langs], dtype=object)
    rows = (own == a) | (own == b)
    return support_vector_machine(x[rows], np.where(own[rows] == a, 1.0, -1.0))


def _fit_pairs(shared, pairs):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, langs = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([machine(x, langs, *pairs[i]).tobytes()], pa.binary())], ["id", "w"])

    return run


def train(spark: SparkSession, x: np.ndarray, langs: np.ndarray) -> Model:
    """All machines, each fitted in a task on the sample, which goes along: some SAMPLE_ROWS rows of FEATURES numbers."""
    families, languages, pairs = pairs_of(langs)
    weights = np.zeros((len(pairs), FEATURES + 1))
    if pairs:
        shared = spark.sparkContext.broadcast((x, langs))
        tasks = spark.range(0, len(pairs), 1, min(len(pairs), spark.sparkContext.defaultParallelism)).mapInArrow(_fit_pairs(shared, pairs), "id long, w binary")
        for r in tasks.collect():  # a vector a pair
            weights[r.id] = np.frombuffer(r.w)

    def of(names: list[str], family: str | None) -> Machines:
        own = [i for i, p in enumerate(pairs) if p[0] == family]
        place = {n: i for i, n in enumerate(names)}
        side = lambda k: np.array([place[pairs[i][k]] for i in own], dtype=np.int64)
        return Machines(names, side(1), side(2), weights[own])

    return Model(of(families, None), {f: of(languages[f], f) for f in families})


def predict_rows(model: Model, x: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
    lang, score = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
    if model.between.names and len(x):
        family, sure = _vote(x, model.between)
        for i, f in enumerate(model.between.names):
            rows = np.flatnonzero(lettered & (family == i))
            if len(rows):
                best, own = _vote(x[rows], model.within[f])
                lang[rows] = np.array(model.within[f].names, dtype=object)[best]
                score[rows] = sure[rows] * own
    return lang.tolist(), np.clip(score, 0.0, 1.0)


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for b in batches:
        x, lettered = features(b.column(0))
        keep = np.flatnonzero(lettered)
        yield pa.RecordBatch.from_arrays([pa.array([x[i].tobytes() for i in keep], pa.binary()), b.column(1).take(pa.array(keep))], ["x", "lang"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a sample of the rows that have text, language and id and aren't held out. ``lang_col`` is read here only.

    The MOST_LANGUAGES languages with most rows are learnt, each from some rows of its own, whatever their number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("id").isNotNull() & ~held_out("id"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return NOTHING
    most = min(PER_LANGUAGE, SAMPLE_ROWS // len(counts))
    # 31 bits of a hash of the id, as a number below 1: some ``most`` rows of each language whatever the table's size.
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, most / r.n))])
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    picked = rows.where(place < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    sample = picked.select("text", "lang").mapInArrow(_features, "x binary, lang string").toPandas()
    if not len(sample):
        return NOTHING
    sample = sample.sort_values(["lang", "x"])  # the same machines whatever order the rows came in
    return train(spark, np.frombuffer(b"".join(sample["x"]), dtype=np.float32).reshape(-1, FEATURES), sample["lang"].to_numpy(dtype=object))


def _predict(model):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            langs, scores = [], [np.zeros(0)]
            for i in range(0, b.num_rows, 512):
                found, score = predict_rows(model.value, *features(b.column("text").slice(i, 512)))
                langs += found
                scores.append(score)
            cols = [*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, lang_pred (``und`` if the text is null or has no letter, or nothing was learnt) and score (0 to 1, 0 for ``und``).

    Only the text decides. Ids may be null or repeat; an empty table gives no rows; other columns play no part.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors of FEATURES numbers
    out = texts.mapInArrow(_predict(shared), f"id {texts.schema['id'].dataType.simpleString()}, text string, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score")


def known_languages(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose language is known with a score of ``least`` or more, all columns as they are, whatever their names.

    A null text, one without a letter, and any text where nothing was learnt go; ids may be null or repeat, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    out = named.mapInArrow(_predict(shared), T.StructType([*named.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
