"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gridweave.llm import ann, bpe, langid, linededup, lm, media, minhash, mixing, quality, warc
from gridweave.llm.common import crc_mod, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return records.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), per_cent=85)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.labelled())
    scored = quality.score(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    drawn = mixing.copies(docs, mixing.decisions(docs))
    return drawn.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n_words"), F.round("weight", 9).alias("weight"), "copies", "block_place", "doc_place")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = langid.learn(docs, crc_mod("doc_id", 4) != 2)
    return langid.predict(docs, profiles).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove_spread_lines(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "is_copy", F.md5("text").alias("clean_md5"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.text_media(documents(spark, sf_dir)))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(documents(spark, sf_dir), crc_mod("doc_id", 7) != 2, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_minhash, op3_bpe, op4_quality, op5_mixing, op6_langid, op7_linededup, op8_ann, op9_media, op10_lm)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as first_id from p where strlen(h) >= 1000 group by d having count(*) > 1),
j as (select p.*, g.first_id, (g.first_id is not null and strlen(h) >= 1000 and (p.page_id is null or p.page_id < g.first_id)) as rv from p left join g on p.d = g.d)
select page_id, strlen(h)::bigint as payload_bytes, d as payload_digest, case when rv then 'revisit' else 'response' end as record_type,
case when rv then first_id end as refers_to from j
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_minhash": minhash.SQL, "op7_linededup": linededup.SQL}
