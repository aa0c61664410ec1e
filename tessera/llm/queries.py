"""The registered queries of the training-data operators, one for each, over whole tables; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_automaton import encode_decode
from .embedding_join import near_vectors
from .html_extract import extract_main_text
from .id_files import round_trip
from .importance import importance_sample
from .kneser_ney import sequence_filter
from .language_id import fit, identify
from .minhash import near_duplicates
from .mixing import mix
from .quality_rules import quality_rules
from .token_counts import token_counts
from .toxicity import toxicity
from .vector_codes import code_vectors
from .workspace import held_out, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that a label calls good."""
    return labels.where("quality = 1").select("doc_id")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def vectors_linked_at_035(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op1 at a cosine that vectors of the tables do reach."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.35)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = toxicity(table(spark, sf_dir, "documents"), labels, cut=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), temperature=0.5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_filter(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2).drop("label")


def op12_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_embedding_near_dedup, op2_quality_rules, op3_toxicity, op4_html_extraction, op5_token_counts, op6_mixing, op7_language_id, op8_minhash_near_dedup, op9_quality_classifier, op10_bpe, op11_vector_codes, op12_token_id_files, op13_importance_resampling, pipeline, vectors_linked_at_035]
    return {f.__name__: f for f in made}


#: The smallest id reachable over the links (a, b), for the ids of `nodes`.
REACH = """
reach(id, top) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT l.b, r.top FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.id AND r.top < l.b
)
"""

OP1_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
),
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
{REACH}
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.top AS component_id, r.top = e.vec_id AS kept
FROM embeddings e JOIN (SELECT id, min(top) AS top FROM reach GROUP BY id) r ON r.id = e.vec_id LEFT JOIN counts c ON c.id = e.vec_id
"""

OP8_SQL = f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
{REACH}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.top AS component_id, r.top = s.doc_id AS kept
FROM sets s JOIN (SELECT id, min(top) AS top FROM reach GROUP BY id) r ON r.id = s.doc_id
"""


#: Assignments of all parts against a codebook `{books}` (p, e, c: components): nearest entry, ties to the lower one.
NEAREST = """(
  SELECT id, p, min(struct_pack(d := d, e := e)) AS best, any_value(c) AS c FROM (
    SELECT x.id, x.p, b.e, x.c, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts x JOIN {books} b ON b.p = x.p) GROUP BY id, p
)"""

#: A codebook after a round: floored means by component, entries without parts as they were.
RENEWED = """(
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM (
      SELECT p, e, k, sum(v)::BIGINT AS s, count(*) AS n FROM (
        SELECT p, best.e AS e, unnest(range(1, len(c) + 1)) AS k, unnest(c) AS v FROM {assigned}) GROUP BY p, e, k) GROUP BY p, e) m
  ON m.p = b.p AND m.e = b.e
)"""

OP11_SQL = f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT id, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS c FROM whole, range(16) t(p)),
books0 AS MATERIALIZED (SELECT p, e, c FROM parts JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM whole QUALIFY e < 64) USING (id)),
near0 AS MATERIALIZED {NEAREST.format(books="books0")},
books1 AS MATERIALIZED {RENEWED.format(books="books0", assigned="near0")},
near1 AS MATERIALIZED {NEAREST.format(books="books1")},
books2 AS MATERIALIZED {RENEWED.format(books="books1", assigned="near1")},
near2 AS MATERIALIZED {NEAREST.format(books="books2")},
coded AS (
  SELECT w.id, w.label, string_agg(printf('%02x', n.best.e::INTEGER), '' ORDER BY n.p) AS code, sum(n.best.d)::BIGINT AS error
  FROM whole w JOIN near2 n ON n.id = w.id GROUP BY w.id, w.label
)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM books2) AS codebooks_sha256
FROM coded
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "vectors_linked_at_035": OP1_SQL.replace(">= 0.98", ">= 0.35"), "op8_minhash_near_dedup": OP8_SQL, "op11_vector_codes": OP11_SQL}
