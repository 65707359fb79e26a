"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import chat, decontaminate, divergence, idfile, importance, langid, lexical, minhash, packing, pii, secrets, tokencount, vectors
from strandlake.llm.store import table_path
from strandlake.llm.tokens import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(_table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "ids")
    idfile.write_ids(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return idfile.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    trap = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(TRAP).alias("text"))
    out = chat.format_chat(rows.unionByName(trap.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])))
    out = out.select("conv_id", "formatted", chat.read_chat(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secrets(_table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


TRAP = "\\### Assistant: </turn> ok"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1,
    "op2_sum_of_squares_packing": op2,
    "op3_benchmark_decontamination": op3,
    "op4_embedding_near_dedup": op4,
    "op5_personal_data": op5,
    "op6_bit_plane_id_files": op6,
    "op7_token_counts": op7,
    "op8_minhash_near_dedup": op8,
    "op9_language_id": op9,
    "op10_chat_formatting": op10,
    "op11_ranked_search": op11,
    "op12_source_divergence": op12,
    "op13_secret_scans": op13,
}

_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": rf"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(regexp_replace({_FOLDED.format('text')}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents WHERE text IS NOT NULL
        ), q AS (
            SELECT item_id, unnest(regexp_extract_all(regexp_replace({_FOLDED.format('text')}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')) AS term FROM benchmark WHERE text IS NOT NULL
        ), total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM t WHERE len(w) > 0),
        tf AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) GROUP BY doc_id, len(w), term),
        weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * n_docs) // n_terms)))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id
        )
        SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
    """,
    "op12_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(regexp_replace({_FOLDED.format("coalesce(text, '')")}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents
        ), t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        own AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
        n AS (SELECT lang, source, sum(c)::BIGINT AS n FROM own GROUP BY lang, source),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + (1000000000 * (coalesce(o.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p
            FROM groups g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang
            LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
        ), whole AS (
            SELECT lang, term, 1 + (1000000000 * (c + 2)) // ((sum(c) OVER (PARTITION BY lang))::BIGINT + 2 * v) AS q
            FROM (SELECT lang, term, sum(c)::BIGINT AS c FROM own GROUP BY lang, term) JOIN v USING (lang)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN whole USING (lang, term) WHERE c > 0 AND p > q
        )
        SELECT lang, source, part, item, value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10
    """,
    "op10_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
            SELECT *, length(regexp_replace(role, '[\\<>]', '__', 'g')) + length(regexp_replace(text, '[\\<>]', '__', 'g')) + 16 AS n FROM rows
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: (x IS NOT NULL AND isfinite(x))::INT), 'min') = 1
              AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.c, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(low.c, vec_id)) AS kept
        FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN low ON e.vec_id = low.a
    """,
    "op3_benchmark_decontamination": r"""
        WITH item_words AS (
            SELECT item_id::VARCHAR AS item, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark
        ), windows AS (
            SELECT item, w[i:i + least(10, len(w)) - 1] AS g FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item_words WHERE len(w) > 0)
        ), doc_words AS (
            SELECT doc_id, coalesce(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+'), []) AS w FROM documents
        ), sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
        places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n),
        found AS (SELECT p.doc_id, p.i, p.n, g.item FROM places p JOIN windows g ON p.w[p.i:p.i + p.n - 1] = g.g),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items,
               sha256(coalesce(own.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN own ON d.doc_id = own.doc_id
    """,
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, w[i:i + least(4, len(w)) - 1] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT c.a, c.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) c
            JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * c.c >= 80 * (na.n + nb.n - c.c)
        ), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low.c, w.doc_id)) AS component_id,
               w.doc_id = least(w.doc_id, coalesce(low.c, w.doc_id)) AS kept
        FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN low ON w.doc_id = low.a
    """,
}
