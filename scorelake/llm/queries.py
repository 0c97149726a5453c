"""The registered queries of this subpackage, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelake.llm import divergence, exact_dedup, fingerprint, language_id, language_model, mixing, near_dup, neighbours, packing, pii, quality, toxicity, vector_codes
from scorelake.llm.common import documents, fold
from scorelake.llm.vectors import embeddings

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


OP1 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir).select("doc_id", "text"), fold("doc_id", 7) == 2
    found = language_model.scored(docs, language_model.trained(docs.where(~held))).drop("text")
    return found.withColumn("held_out", held)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    base, spans = pii.spans_text(F.col("base")), pii.spans_text(F.col("spans"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), "n_found")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fitted(docs.where(fold("doc_id", 3) != 1))
    found = language_id.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality.scored(docs, quality.fitted(docs, labels(spark, sf_dir))).drop("text")
    return found.withColumn("held_out", fold("doc_id", 5) == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.fitted(docs, labels(spark, sf_dir))).drop("text")
    return found.withColumn("held_out", fold("doc_id", 5) == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path())


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


OP11 = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS m FROM w GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(x.total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) x USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(m) AS total FROM k GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.m,
    1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * l.v)::HUGEINT AS p, 1 + (1000000000 * (k.m + 2)::HUGEINT) // (l.total + 2 * l.v)::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)), 0)::BIGINT AS value
  FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
  LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source LEFT JOIN p b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term GROUP BY ALL),
t AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM t)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM a
UNION ALL SELECT lang, source, 'term', item, value, rank::INTEGER FROM r WHERE rank <= 10
"""


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(embeddings(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.vector_codes(embeddings(spark, sf_dir))
    return codes.drop("label").withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """All rows against all entries: the nearest by squared distance, then by index."""
    steps = [f"""x AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  s AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM x, range({parts}) r(part)),
  b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM s
    QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"""]
    near = "SELECT s.vec_id, any_value(s.label) AS label, s.part, any_value(s.v) AS v, min({d: list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e: b.e}) AS m FROM s JOIN b%d b USING (part) GROUP BY s.vec_id, s.part"
    near = near.replace("{d:", "{'d':").replace(", e: b.e", ", 'e': b.e")
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near % k})")
        steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, e, list(m ORDER BY i) AS v FROM
    (SELECT part, e, i, floor(sum(c) / count(*))::BIGINT AS m FROM (SELECT part, m.e AS e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL) n USING (part, e))""")
    steps.append(f"z AS ({near % rounds})")
    return f"""WITH {", ".join(steps)},
  o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM z GROUP BY vec_id),
  h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM o, h"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_fingerprint": op7_fingerprint,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {"op1_exact_dedup": OP1, "op6_ngram_jaccard": OP6, "op11_divergence_audit": OP11, "op13_vector_codes": op13_sql()}
