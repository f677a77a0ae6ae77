"""The stages on small tables: columns, decisions, empty tables."""

import base64
import sys
from pathlib import Path

import corpus_pipeline as pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_minhash import brute  # noqa: E402

SF = "/root/testdata/sf0.01"


def plain_line_dedup(rows):
    sites = {}
    for _, text, site in rows:
        for line in text.split("\n"):
            sites.setdefault(line.strip(" \t\r"), set()).add(site)
    spread = {k for k, s in sites.items() if k and len(s) >= 10}
    for d, text, _ in rows:
        lines = text.split("\n")
        own = [x for x in lines if x.strip(" \t\r") not in spread]
        yield d, "\n".join(own) if any(x.strip(" \t\r") for x in own) else text


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == columns, name
        seen[name] = (docs, out)
        docs = out
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = seen["quality classifier"]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(d not in kept for d, q in quality.items() if q == 1) <= 3 and sum(d in kept for d, q in quality.items() if q == 0) <= 3
    before, after = seen["line dedup"]
    assert sorted((r.doc_id, r.text) for r in after.collect()) == sorted(plain_line_dedup([(r.doc_id, r.text, r.source) for r in before.collect()]))
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["MinHash near-dedup"]
    want = [d for d, _, _, kept in brute([(r.doc_id, r.text) for r in before.collect()], pipeline.SIMILAR) if kept]
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == want
    before, after = seen["mixing sources"]
    assert {r.doc_id for r in before.select("doc_id").collect()} == {r.doc_id for r in after.select("doc_id").collect()}
    before, after = seen["byte-level BPE"]
    assert before.count() == after.count() and after.where("not round_trip").count() == 0
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in after.where("doc_id % 5 = 0").collect())


def test_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "same words in this text here", "en", "a", 1), (2, "same words in this text here", "en", "a", 1), (3, "same words in this text here", None, "b", 1)]
    odd = spark.createDataFrame(rows, docs.schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        kept = sorted(str(r.doc_id) for r in stage(spark, odd, SF).collect())
        if name in ("line dedup", "byte-level BPE"):
            assert kept == ["1", "2", "2", "3", "None"], name
        if name == "mixing sources":
            assert set(kept) == {"1", "2", "3", "None"}, name
        clash = odd.withColumn("_quality", F.lit(1)).withColumn("weight", F.lit(2)).withColumn("ids", F.lit("x"))
        out = stage(spark, clash, SF)
        assert sorted(str(r.doc_id) for r in out.collect()) == kept and (name == "byte-level BPE" or out.columns == clash.columns), name
    assert sorted(str(r.doc_id) for r in pipeline.near_dedup(spark, odd, SF).collect()) == ["1", "2", "None"]


def test_line_dedup_leaves_no_spread_line_beside_own_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shared = "this line is on every site and longer than what the sites say themselves"
    rows = [(i, f"{shared}\nown words of {i}", "en", f"s{i}", 0) for i in range(12)] + [(20 + i, shared, "en", f"s{i}", 0) for i in range(12)]
    out = {r.doc_id: r.text for r in pipeline.line_dedup(spark, spark.createDataFrame(rows, docs.schema), SF).collect()}
    assert out == {i: f"own words of {i}" for i in range(12)} | {20 + i: shared for i in range(12)}


def test_near_dedup_leaves_texts_where_they_are(spark):
    """Texts meet the ids that go by a broadcast; rows that share an id stay if one of them does."""
    rows = [(i, f"word{i} " * 5 + f"other{i} tail{i}") for i in range(40)] + [(100 + i, f"word{i} " * 5 + f"other{i} tail{i}") for i in range(4)]
    rows += [(None, "null id one two three four five"), (200, "a b c d e f g"), (200, "word1 word1 word1 word1 word1 other1 tail1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.near_dedup(spark, docs.where("doc_id < 200"), SF)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == list(range(40))
        got = sorted((str(r.doc_id), r.text) for r in pipeline.near_dedup(spark, docs, SF).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == sorted((str(i), t) for i, t in rows if i is None or i < 100 or i == 200)
