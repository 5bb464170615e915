"""From raw documents to packed sequences: quality, language, near duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given;
all but the last return the columns of documents. Texts stay in place: stages
that drop or rewrite rows do so in a scan. Duplicates are removed by a join with the
ids to remove, broadcast while they are few; beyond that a Bloom filter keeps the
texts that none of them can be out of the shuffle, as long as a filter of bounded
size can, and then the join shuffles.

Defined results: null texts are letterless and go with the language stage, as do
empty ones; rows without an id are never duplicates and stay; rows that repeat an id
with an unlike text stay both; equal rows leave one; further columns pass through; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from offerlens.llm import batches, bloom, minhash_trees, packing, queries, secret_forest
from offerlens.llm.scratch import Scratch

KEEP_QUALITY, KEEP_LANGUAGE = 0.3, 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least ``KEEP_QUALITY``."""
    model = spark.sparkContext.broadcast(queries.quality_model(docs, queries.table(spark, sf_dir, "labels")))
    return batches.rewrite_rows(docs, lambda texts: ((model.value.score(texts) >= KEEP_QUALITY).tolist(), None), rows=250)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language."""
    model = spark.sparkContext.broadcast(queries.language_model(docs))

    def known(texts: list) -> tuple[list[bool], None]:
        names, score = model.value.classify(texts)
        return [n != "und" and s >= KEEP_LANGUAGE for n, s in zip(names, score, strict=True)], None

    return batches.rewrite_rows(docs, known)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, and of equal rows one."""
    scratch = Scratch(spark, "pipeline")
    found = scratch.save(minhash_trees.near_duplicates(docs).select("doc_id", "text_hash", "first"))
    doc_id, text_hash, n = (next(c for k in range(len(docs.columns) + 1) if (c := f"_{name}{k}") not in docs.columns) for name in ("id", "hash", "n"))
    keys = [F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash)]
    gone = scratch.save(found.where("not first").select(*keys).distinct())
    again = scratch.save(found.where("first and doc_id is not null").groupBy(*keys).count().where("count > 1").select(doc_id, text_hash))
    marked = docs.withColumns({doc_id: F.col("doc_id").cast("long"), text_hash: F.xxhash64("text")})
    left = bloom.anti_join(marked, gone, [doc_id, text_hash], gone.count(), minhash_trees.BROADCAST_IDS)
    size = again.count()
    if not size:
        return left.select(*docs.columns)
    # rows that repeat: of each such row one stays, by its other columns' order
    order = [F.col(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    few = bloom.fetch(left, again, [doc_id, text_hash], size, minhash_trees.BROADCAST_IDS)
    one = few.withColumn(n, F.row_number().over(Window.partitionBy(doc_id, text_hash).orderBy(*order))).where(F.col(n) == 1)
    rest = bloom.anti_join(left, again, [doc_id, text_hash], size, minhash_trees.BROADCAST_IDS)
    return rest.select(*docs.columns).unionByName(one.select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    forest = spark.sparkContext.broadcast(secret_forest.learned(docs))

    def clean(texts: list) -> tuple[list[bool], list]:
        out = []
        for t, found in zip(texts, secret_forest.scan_texts(texts, forest.value), strict=True):
            for a, b, s in reversed(found):
                if s >= secret_forest.THRESHOLD:
                    t = t[:a] + secret_forest.MARK + t[b:]
            out.append(t)
        return [True] * len(out), out

    return batches.rewrite_rows(docs, clean)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", pack),
]

#: No stage but the last few joins can be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents``; every stage is written before the next one reads it."""
    scratch = Scratch(spark, "corpus")
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
            scratch.drop(before)
    return docs
