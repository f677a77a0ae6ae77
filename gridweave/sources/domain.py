"""Domain tables made from the benchmark tables, with the same tables as SQL for the oracle.

cells: one for every `per` users (every user one of its own, or blocks of BLOCK users where whole days are needed), on a grid of
GRID columns, so cells grow with users and customers and polygons with suppliers; masked: values of at most 3 are null;
demographics: the event's own band holds its count; dwell codes and states follow the event type
(of every sixth user, clicks and purchases are at home).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.functions import columns as X

GRID, BLOCK = 10, 30
#: Event types in order: dwell code, and state by the parity of the event's id.
DWELL_OF = {"click": "000", "error": "030", "purchase": "060", "signup": "120", "view": "240"}
STATE_OF = {"click": (1, 1), "error": (6, 6), "purchase": (3, 3), "signup": (2, 0), "view": (4, 5)}
STATES = [*C.REGIMES, C.STRUCTURAL]
DEMO = [f"{s}_{b}" for s in C.SEXES for b in C.LIVING_BANDS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, per: int) -> DataFrame:
    e, cell = table(spark, sf_dir, "events"), F.floor(F.col("user_id") / per)
    return e.select(
        "event_id",
        "event_type",
        "user_id",
        F.concat(F.lit("c"), F.lpad(cell.cast("string"), 9, "0")).alias("cell_id"),
        (cell % GRID).cast("int").alias("grid_ix"),
        F.floor(cell / GRID).cast("int").alias("grid_iy"),
        F.to_date("ts").alias("date"),
        F.hour("ts").cast("tinyint").alias("hour"),
        F.when(F.col("value") > 3, F.col("value")).alias("total"),
    )


def living(spark: SparkSession, sf_dir: str, per: int = 1) -> DataFrame:
    """Presence counts: grid_id, date, hour, total_pop and 28 demographic counts; masked counts are null."""
    e = _events(spark, sf_dir, per)
    demo = [F.when(F.col("total").isNotNull(), F.when(F.col("event_id") % len(DEMO) == i, F.col("total")).otherwise(0.0)).alias(d) for i, d in enumerate(DEMO)]
    return e.select(F.col("cell_id").alias("grid_id"), "grid_ix", "grid_iy", "date", "hour", F.col("total").alias("total_pop"), *demo)


def stay(spark: SparkSession, sf_dir: str, per: int = 1) -> DataFrame:
    """Dwell counts: cell_id, date, start_tz, stay_dur, total."""
    e = _events(spark, sf_dir, per)
    code = F.create_map(*(F.lit(x) for kv in DWELL_OF.items() for x in kv))
    return e.select("cell_id", "date", X.time_bin(F.col("hour")).alias("start_tz"), code[F.col("event_type")].alias("stay_dur"), "total")


def labels(spark: SparkSession, sf_dir: str, per: int = 1) -> DataFrame:
    """Decoded states: cell_id, grid_ix, grid_iy, date, time_bin, split and state."""
    e = _events(spark, sf_dir, per)
    state = F.create_map(*(F.lit(x) for k, (a, b) in STATE_OF.items() for x in (f"{k}0", a, f"{k}1", b)))
    home = (F.col("user_id") % 6 == 0) & F.col("event_type").isin("click", "purchase")
    odd = F.concat("event_type", (F.col("event_id") % 2).cast("string"))
    split = F.when(F.col("date") <= F.lit("2024-01-25").cast("date"), "train").otherwise("holdout")
    return e.select("event_id", "cell_id", "grid_ix", "grid_iy", "date", X.time_bin(F.col("hour")).alias("time_bin"), split.alias("split"), F.when(home, 4).otherwise(state[odd]).alias("state"))


def cell_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, grid indices and coordinates, with an area code and its district; a cell for each customer, areas from nations."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    i = F.col("c_custkey")
    base = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.concat(F.lpad((F.col("n_regionkey") + 11).cast("string"), 5, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    ix, iy = (i % GRID).cast("int"), F.floor(i / GRID).cast("int")
    return base.select(
        F.concat(F.lit("c"), F.lpad(i.cast("string"), 9, "0")).alias("cell_id"),
        ix.alias("grid_ix"),
        iy.alias("grid_iy"),
        (C.GRID_X0 + C.GRID_STEP * ix).alias("utm_x"),
        (C.GRID_Y0 + C.GRID_STEP * iy).alias("utm_y"),
        code.alias("admin_dong"),
        F.col("c_acctbal").alias("density"),
    )


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon layer: code, label, tier, ord and rings; a rectangle on the grid for each supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x0, y0 = C.GRID_X0 + C.GRID_STEP * (k * 3 % 9) - 125.0, C.GRID_Y0 + C.GRID_STEP * (k + k * 7 % 9) - 125.0
    x1, y1 = x0 + C.GRID_STEP * (1 + k % 3), y0 + C.GRID_STEP * (1 + k % 2)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))
    tiers = F.array(*(F.lit(t) for t in C.TIERS))
    return s.select(F.col("s_name").alias("code"), F.col("s_name").alias("label"), F.element_at(tiers, (k % 4).cast("int") + 1).alias("tier"), k.alias("ord"), F.array(ring).alias("rings"))


def ridership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stop_id, stop_name, use_ym, hour, board and alight from line items; hours 7 to 9 and 18 to 21."""
    l = table(spark, sf_dir, "lineitem")
    hours = F.array(*(F.lit(h) for h in (7, 8, 9, 12, 18, 19, 20)))
    return l.select(
        F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("stop_id"),
        F.col("l_suppkey").alias("place"),
        F.date_format("l_shipdate", "yyyyMM").alias("use_ym"),
        F.element_at(hours, F.col("l_linenumber")).alias("hour"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0).alias("board"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0).alias("alight"),
    )


# The same tables in the oracle's SQL.
_BIN = "case when hour(ts) <= 5 then '00' else lpad(cast(hour(ts) as varchar), 2, '0') end"


def _cell(per: int) -> str:
    return f"'c' || lpad(cast(user_id // {per} as varchar), 9, '0') as cell_id, cast(user_id // {per} % {GRID} as int) as grid_ix, cast(user_id // {per} // {GRID} as int) as grid_iy"


def in_blocks(sql: str) -> str:
    """The same SQL over cells of BLOCK users."""
    return sql.replace(_cell(1), _cell(BLOCK))


def living_sql(per: int = 1) -> str:
    demo = ", ".join(f"case when value > 3 then case when event_id % {len(DEMO)} = {i} then value else 0.0 end end as \"{d}\"" for i, d in enumerate(DEMO))
    return f"living as (select {_cell(per)}, cast(ts as date) as date, hour(ts) as hour, {_BIN} as time_bin, case when value > 3 then value end as total_pop, {demo} from events)"


def stay_sql(per: int = 1) -> str:
    code = " ".join(f"when '{k}' then '{v}'" for k, v in DWELL_OF.items())
    return f"stay as (select {_cell(per)}, cast(ts as date) as date, {_BIN} as start_tz, case event_type {code} end as stay_dur, case when value > 3 then value end as total from events)"


def labels_sql(per: int = 1) -> str:
    state = " ".join(f"when '{k}{p}' then {v[p]}" for k, v in STATE_OF.items() for p in (0, 1))
    return f"labels_t as (select event_id, {_cell(per)}, cast(ts as date) as date, {_BIN} as time_bin, case when cast(ts as date) <= date '2024-01-25' then 'train' else 'holdout' end as split, case when user_id % 6 = 0 and event_type in ('click', 'purchase') then 4 else case event_type || cast(event_id % 2 as varchar) {state} end end as state from events)"


def units_sql() -> str:
    return (
        f"units as (select 'c' || lpad(cast(c_custkey as varchar), 9, '0') as cell_id, cast(c_custkey % {GRID} as int) as grid_ix, cast(floor(c_custkey / {GRID}) as int) as grid_iy, "
        f"{C.GRID_X0} + {C.GRID_STEP} * (c_custkey % {GRID}) as utm_x, {C.GRID_Y0} + {C.GRID_STEP} * floor(c_custkey / {GRID}) as utm_y, "
        f"lpad(cast(n_regionkey + 11 as varchar), 5, '0') || lpad(cast(n_nationkey as varchar), 3, '0') as admin_dong, c_acctbal as density "
        f"from customer join nation on c_nationkey = n_nationkey)"
    )


def centres_sql() -> str:
    tier = " ".join(f"when {i} then '{t}'" for i, t in enumerate(C.TIERS))
    return (
        f"centres as (select s_name as label, case s_suppkey % 4 {tier} end as tier, s_suppkey as ord, "
        f"{C.GRID_X0} + {C.GRID_STEP} * (s_suppkey * 3 % 9) - 125.0 as x0, {C.GRID_Y0} + {C.GRID_STEP} * (s_suppkey + s_suppkey * 7 % 9) - 125.0 as y0, "
        f"{C.GRID_X0} + {C.GRID_STEP} * (s_suppkey * 3 % 9) - 125.0 + {C.GRID_STEP} * (1 + s_suppkey % 3) as x1, "
        f"{C.GRID_Y0} + {C.GRID_STEP} * (s_suppkey + s_suppkey * 7 % 9) - 125.0 + {C.GRID_STEP} * (1 + s_suppkey % 2) as y1 from supplier)"
    )


def ridership_sql() -> str:
    return (
        "rides as (select 's' || lpad(cast(l_suppkey as varchar), 9, '0') as stop_id, l_suppkey as place, strftime(l_shipdate, '%Y%m') as use_ym, "
        "[7, 8, 9, 12, 18, 19, 20][l_linenumber] as hour, case when l_linestatus = 'O' then l_quantity else 0.0 end as board, "
        "case when l_linestatus = 'F' then l_quantity else 0.0 end as alight from lineitem)"
    )
