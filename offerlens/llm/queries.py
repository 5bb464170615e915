"""The ``opN_*`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import feistel, hash_search, language_ppm, minhash_trees, packing, pieces, quality_mil, secret_forest, toxicity_ordinal, vector_dedup
from .sampling import fold

#: Probability of any severity from which a text counts as toxic: texts without evidence stay under 0.05.
TOXIC_AT = 0.25

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_mil.Mil:
    return quality_mil.fit(docs, labels.where(fold("doc_id", 5) != 0))


def language_model(docs: DataFrame) -> language_ppm.Ppm:
    return language_ppm.fit(docs.where(fold("doc_id", 4) != 2))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_mil.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_ppm.identify(docs, language_model(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per find; the key is a stand-in for one that whoever runs this keeps."""
    done = feistel.pseudonymise(table(spark, sf_dir, "documents"), b"a key for the example tables")
    return done.select("doc_id", F.explode("finds").alias("f")).select("doc_id", "f.kind", "f.start", "f.end", "f.pseudonym")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_trees.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per confirmed secret; the value itself appears only as a digest."""
    docs = table(spark, sf_dir, "documents")
    found = secret_forest.scan(docs, secret_forest.learned(docs))
    rows = found.select("doc_id", F.explode("findings").alias("f")).where("f.secret")
    return rows.select("doc_id", "f.start", "f.end", "f.score", F.sha2("f.value", 256).alias("value_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_ordinal.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    found = toxicity_ordinal.severity(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "expected_severity", "grade", "p_toxic", (F.col("p_toxic") >= TOXIC_AT).alias("toxic"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_search.search(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pii": op6_pii,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_nearest": op10_nearest,
}

#: What the queries without models or tokenizers compute, said directly: all pairs that share a shingle, all pairs of vectors.
#: ``op10`` has none: its score is not rounded, and engines differ in the last digit of a cosine.
ORACLE_SQL: dict[str, str] = {
    "op7_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY md5s) AS class FROM (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS md5s FROM s GROUP BY 1)),
c AS (SELECT s.doc_id, s.s FROM s JOIN class ON class.doc_id = s.doc_id AND class.class = s.doc_id),
edges AS (SELECT a.doc_id AS u, b.doc_id AS v FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(id, least) AS (SELECT DISTINCT class, class FROM class UNION SELECT e.v, r.least FROM reach r JOIN edges e ON e.u = r.id WHERE r.least < e.v),
found AS (SELECT id, min(least) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(class.n, 0) AS n_shingles, coalesce(found.component_id, d.doc_id) AS component_id, coalesce(found.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN class ON class.doc_id = d.doc_id LEFT JOIN found ON found.id = class.class""",
    "op4_vector_dedup": """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), ok AS (SELECT vec_id, x FROM e WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(id, least) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.v, r.least FROM reach r JOIN links l ON l.u = r.id WHERE r.least < l.v),
found AS (SELECT id, min(least) AS component_id FROM reach GROUP BY 1), n AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, found.component_id, found.component_id = e.vec_id AS kept FROM e JOIN found ON found.id = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
}
