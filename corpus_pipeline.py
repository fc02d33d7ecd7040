"""A corpus pipeline of five stages over the table documents, each on one operator of wakelag.llm.

Language identification, near-duplicate removal, secret redaction, mixing to target weights, encoding.
A stage is written as Parquet to the shared folder and read again as the next one's input; its own input goes
as soon as it is written, the last one's when the program ends.

Every stage takes rows with nulls in any column, empty and very long texts, ids that are null or repeat, rows
that repeat, tables without rows, and columns besides those of documents, whatever they are called; what
becomes of each is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakelag.llm import bpe, jaccard, langid, mixing, secrets
from wakelag.llm.common import drop, free, orderable, quoted, row_digest, scratch, table

#: Posterior probability that a document's language needs.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, one for one; those without a letter (null and empty texts too) or
    below LEAST_SCORE go. A null lang becomes the language found. Where no row has a lang nothing can be learned, and no
    document stays. Rows that repeat get the same answer; other columns are carried along as they are."""
    label, score = free("lang_found", docs.columns), free("score_found", docs.columns)
    model = langid.fit(docs, langid.default_pieces())
    found = langid.identify(docs, model, label=label, score=score)
    kept = found.where((F.col(label) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", label)).select(*quoted(docs.columns))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies (five words, 0.8). Documents
    without words or without an id all stay; of rows that repeat an id and its text one stays, the first by its other
    columns, and by a digest of all where these are alike or have no order. Other texts under one id are judged apart: id and text together are a document, named by a
    64-bit hash."""
    name = free("key", docs.columns)
    named = docs.where("doc_id IS NOT NULL").withColumn(name, F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()))
    groups = jaccard.join(named, key=name).select(name, "component_id").distinct()
    found = named.select(name, "doc_id").distinct().join(groups, name)
    found = found.groupBy("component_id").agg(F.min(F.struct("doc_id", name)).alias("least")).select(f"least.{name}")
    mark = free("mark", named.columns)
    rows = named.withColumn(mark, row_digest(docs)).join(found, name, "left_semi")
    others = quoted([f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and orderable(f.dataType)])
    kept = rows.groupBy(name).agg(F.min_by(F.struct(*quoted(docs.columns)), F.struct(*others, mark)).alias("first"))
    return kept.select(*[F.col("first").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, one for one, every secret found replaced by a mark, n_chars as the new text has it. Null
    and empty texts, and texts without secrets, stay as they are; so do other columns, one named spans too."""
    spans = free("spans", docs.columns)
    clean = secrets.redact(secrets.scan(docs, spans=spans), spans=spans)
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*quoted(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words, to the nearest whole number of times (0 to 3). Documents
    without words take no part and go. A null source is a source of its own. Counts go by a digest of the
    whole row; rows alike in every column share the sum of theirs, so reruns agree."""
    row, times, copy = (free(x, docs.columns) for x in ("row", "times", "copy"))
    rows = docs.withColumn(row, row_digest(docs))
    shares = mixing.mix(rows.select("doc_id", "source", "text", F.col(row).alias("row_digest")), more=("row_digest",)).where("taken > 0")
    counts = shares.withColumn("n", F.expr("(2 * taken + size) DIV (2 * size)")).groupBy(F.col("row_digest").alias(row)).agg(F.sum("n").alias(times)).where(f"{times} > 0")
    copies = rows.join(counts, row).dropDuplicates([row])
    return copies.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*quoted(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, one row for one, with the digests of ids and of the bytes they decode
    to. A null text counts as empty: no ids. Columns other than id and text are not read."""
    made = bpe.encode_decode(docs, bpe.default_codec())
    return bpe.digests(made)


#: (name, function of (spark, docs, sf_dir)); each works on all that the one before kept.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("mixing", mix),
    ("bpe", encode),
]

#: A fitted language model is beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table documents, each written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    last = None
    for n, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return made
        path = f"{folder}/{n}-{name}"
        made.write.parquet(path)
        if last:
            drop(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
