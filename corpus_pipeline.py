"""A training corpus from the table `documents`, in five stages that each apply an operator of gridweave.llm.

Every stage takes (spark, docs, sf_dir) and returns all that it keeps, with the columns of documents; the last returns the
encoded corpus. A stage's result is written as Parquet and read again as the next one's docs. Defined results: an empty
table passes every stage as an empty one; documents with null or empty text are scored, deduplicated and mixed as empty
texts; rows that repeat an id are decided alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, linededup, minhash, mixing, quality
from gridweave.llm.common import fresh_dir, settle

#: A document goes if its score is lower, as the classifier's own decision has it.
REJECT = 0.7
#: Similarity from which documents are near-duplicates, in per cent, and how often the mixture may repeat a source.
SIMILAR, REPEAT = 80, 2.0


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels of documents that aren't held out."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.labelled())
    name = "_quality"
    while name in docs.columns:
        name = f"_{name}"
    scored = quality.score(docs, model, name=name)
    return scored.where(scored[name] >= REJECT).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over sites (but where a document has no others); n_chars follows the text."""
    cleaned = linededup.remove_spread_lines(docs, add=False)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    found = minhash.near_duplicates(docs, SIMILAR).select(F.col("doc_id").alias("_id"), "kept")
    ids = settle(found.groupBy("_id").agg(F.count_if("kept").alias("n")), "kept")
    # The ids that go are far fewer than those that stay: texts are shuffled only where they are too many to be broadcast.
    gone = minhash.side(ids.where("n = 0").select("_id"))
    one = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
    # Only where rows repeat an id do texts have to be compared again.
    return one if ids.where("n > 1").isEmpty() else one.dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: the source that is drawn least passes once, so every document stays; scarcer sources repeat."""
    return mixing.mix(docs, budget=None, repeat=REPEAT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the token ids of the whole text, their number, and whether they decode to the text."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source", "text"))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can express neither the trained classifier nor the search for the mixture's exponent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            at = fresh_dir(spark, f"stage{i}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
