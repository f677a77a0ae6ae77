"""Removal of lines that spread over many sites, with DataFrame functions alone.

A line (cut at line feeds, trimmed of blanks, tabs and carriage returns) is told apart by two 64-bit hashes. One
aggregation merges a HyperLogLog sketch of the sites for each line; a line whose estimate is clear of the threshold is
decided by it, the lines near it get an exact distinct count. Lines that occur on at least `min_sites` sites are removed
from every document that has a line of its own; documents that consist of such lines alone are copies of each other as a
whole, which is a matter for near-duplicate removal, and stay as they are.

Sketches and counts are merged on the map side, so a line that is on a third of all pages costs a row a task. Defined
results: null text stays null, blank lines are never removed, a null site counts as no site, lines of rows that share an
id (null too) are decided alike, repeated rows count once a site, and an empty table gives an empty one. Other columns, whatever their names,
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import settle

#: log2 of the sketches' registers; they are exact to some 2 % (and far better for few sites).
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(_key(line)).alias("a"), F.xxhash64(F.lit(7), _key(line)).alias("b"))


def spread_lines(docs: DataFrame, min_sites: int, text: str = "text", site: str = "source") -> DataFrame:
    """h, the hash of every line that occurs on at least min_sites sites."""
    line = docs.select(docs[site].alias("site"), F.explode(_lines(docs[text])).alias("line")).where(_key(F.col("line")) != "")
    line = line.select("site", _hash(F.col("line")).alias("h"))
    sketched = line.groupBy("h.a", "h.b").agg(F.count("site").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"))
    # A line on min_sites sites occurs as often, so most lines go before their sketch is read.
    guess = sketched.where(F.col("n") >= min_sites).select("a", "b", F.hll_sketch_estimate("sites").alias("guess"))
    slack = max(1, round(0.1 * min_sites))
    guess = settle(guess.where(F.col("guess") >= min_sites - slack), "spread")
    near = guess.where(F.col("guess") <= min_sites + slack).select("a", "b")
    exact = line.select("h.a", "h.b", "site").join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("exact"))
    sure = guess.where(F.col("guess") > min_sites + slack).select("a", "b")
    return sure.unionByName(exact.where(F.col("exact") >= min_sites).select("a", "b")).select(F.struct("a", "b").alias("h"))


def remove_spread_lines(docs: DataFrame, min_sites: int = 10, key: str = "doc_id", text: str = "text", site: str = "source", add: bool = True) -> DataFrame:
    """docs with the column `text` cleaned and, if `add`, the new columns n_lines, n_removed and is_copy (a document without a line of its own)."""
    spread = settle(spread_lines(docs, min_sites, text, site), "lines")
    own = docs.select(docs[key].alias("_key"), F.explode(_lines(docs[text])).alias("line")).where(_key(F.col("line")) != "").select("_key", _hash(F.col("line")).alias("h"))
    marks = own.join(spread, "h", "left_semi").groupBy("_key").agg(F.collect_set("h").alias("_gone"))
    joined = docs.join(marks, docs[key].eqNullSafe(marks["_key"]), "left")
    lines, gone = _lines(docs[text]), marks["_gone"]
    hit = lambda x: (_key(x) != "") & F.array_contains(gone, _hash(x))
    taken = F.filter(lines, hit)
    copy = F.coalesce(F.size(taken) == F.size(F.filter(lines, lambda x: _key(x) != "")), F.lit(False)) & gone.isNotNull()
    clean = F.when(gone.isNull() | copy, docs[text]).otherwise(F.array_join(F.filter(lines, lambda x: ~hit(x)), "\n"))
    removed = F.when(gone.isNull() | copy, 0).otherwise(F.size(taken))
    columns = [clean.alias(c) if c == text else docs[c] for c in docs.columns]
    if not add:
        return joined.select(*columns)
    n_lines = F.when(docs[text].isNull(), 0).otherwise(F.size(lines))
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), copy.alias("is_copy"))


SQL = """
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
k as (select *, trim(line, ' ' || chr(9) || chr(13)) as key from l),
spread as (select key from k where key <> '' group by key having count(distinct source) >= 10),
m as (select k.*, spread.key is not null as hit from k left join spread on k.key = spread.key),
d as (select doc_id, count(*) as n_lines, count(*) filter (key <> '') as own, count(*) filter (hit) as hits,
  coalesce(string_agg(line, chr(10) order by pos) filter (not hit), '') as clean from m group by doc_id)
select documents.doc_id, coalesce(d.n_lines, 0)::bigint as n_lines, case when hits = own then 0 else coalesce(hits, 0) end::bigint as n_removed,
  coalesce(hits = own and hits > 0, false) as is_copy, md5(case when hits = own then documents.text else d.clean end) as clean_md5
from documents left join d on documents.doc_id = d.doc_id
"""
