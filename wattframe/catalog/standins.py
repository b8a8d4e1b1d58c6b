"""The driver's tables seen as telemetry, in Spark and in SQL.

``readings``     events: user = meter, value = kW (null on ``error`` rows)
``daily``        orders: priority = meter, order date = day, price = kWh, gap-free
``houses``       ``daily`` with order status = sub-meter, and a temperature by month
``power``        ``readings`` of five meters: user modulo five
``metered``      lineitem: line status = meter, return flag = sub-meter
``weather``      events per user and day, with a temperature and a condition
``homes``        lineitem per supplier and day, with a number of people
``regional``     orders through customer, nation and region: region = meter
``utterances``   conversations, each behind one of the known questions
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.rollup import day_spine
from .base import table

#: One question for each intent, and one for none.
QUESTIONS = [
    "Hi there, nice to meet you",
    "Give me a forecast for the coming month",
    "On which day do we reach the peak",
    "Is a weekend dearer than a working day",
    "Tell me about the historical usage of this house",
    "Which model was used and what about its accuracy",
    "Show the feature importance table",
    "Please schedule the dishwasher for me",
    "What would a cut by a tenth bring in savings",
    "Does the temperature outside matter",
    "Split the kitchen from the laundry by submeter",
    "Sing me a song",
]
METERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

READING_COLUMNS = [
    "active_power_kw", "reactive_power_kw", "voltage", "intensity", "sub1_wh", "sub2_wh", "sub3_wh",
]


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, kind = F.col("event_type") != "error", F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("meter_id"),
        F.date_trunc("second", "ts").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(ok, F.col("value")).alias("active_power_kw"),
        F.when(ok, F.col("value") / 10.0).alias("reactive_power_kw"),
        F.when(kind != "signup", _k() + 200.0).alias("voltage"),
        F.when(ok, F.col("value") * 4.0).alias("intensity"),
        F.when(kind == "click", _k()).otherwise(0.0).alias("sub1_wh"),
        F.when(kind == "view", _k()).otherwise(0.0).alias("sub2_wh"),
        F.when(kind == "purchase", _k()).otherwise(0.0).alias("sub3_wh"),
    )


_SQL_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"

SQL_READINGS = f"""readings AS (
  SELECT CAST(user_id AS VARCHAR) AS meter_id, date_trunc('second', ts) AS ts, event_id AS seq,
         CASE WHEN event_type <> 'error' THEN value END AS active_power_kw,
         CASE WHEN event_type <> 'error' THEN value / 10.0 END AS reactive_power_kw,
         CASE WHEN event_type <> 'signup' THEN {_SQL_K} + 200.0 END AS voltage,
         CASE WHEN event_type <> 'error' THEN value * 4.0 END AS intensity,
         CASE WHEN event_type = 'click' THEN {_SQL_K} ELSE 0.0 END AS sub1_wh,
         CASE WHEN event_type = 'view' THEN {_SQL_K} ELSE 0.0 END AS sub2_wh,
         CASE WHEN event_type = 'purchase' THEN {_SQL_K} ELSE 0.0 END AS sub3_wh
  FROM events)"""

SQL_ONCE = f"""{SQL_READINGS},
once AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY meter_id, ts ORDER BY seq) = 1)"""


def sql_interpolated(cols: list[str]) -> str:
    """CTE ``clean``: each column on the line between its known neighbours."""
    sides = ",\n         ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER up AS {c}_pi, "
        f"last_value({c} IGNORE NULLS) OVER up AS {c}_pv, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER down AS {c}_ni, "
        f"first_value({c} IGNORE NULLS) OVER down AS {c}_nv"
        for c in cols
    )
    filled = ",\n         ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pv IS NOT NULL AND {c}_nv IS NOT NULL "
        f"THEN {c}_pv + ({c}_nv - {c}_pv) * (i - {c}_pi) / ({c}_ni - {c}_pi) "
        f"ELSE coalesce({c}_pv, {c}_nv) END AS {c}"
        for c in cols
    )
    return f"""{SQL_ONCE},
numbered AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts) AS i FROM once),
sides AS (
  SELECT *, {sides}
  FROM numbered
  WINDOW up AS (PARTITION BY meter_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY meter_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
clean AS (
  SELECT meter_id, ts, seq, CAST(ts AS DATE) AS day,
         {filled}
  FROM sides)"""


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("meter_id"), F.to_date("o_orderdate").alias("day"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("kwh"))
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_spine(order_days(spark, sf_dir), ["kwh"])


SQL_ORDER_DAYS = """days AS (
  SELECT o_orderpriority AS meter_id, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS kwh
  FROM orders GROUP BY 1, 2)"""


def sql_spine(days: str = "days", out: str = "daily", sums=("kwh",), others=()) -> str:
    values = ", ".join([f"coalesce(d.{c}, 0.0) AS {c}" for c in sums] + [f"d.{c}" for c in others])
    return f"""calendar_{out} AS (
  SELECT meter_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM {days} GROUP BY meter_id),
{out} AS (SELECT c.meter_id, c.day, {values} FROM calendar_{out} c LEFT JOIN {days} d ON d.meter_id = c.meter_id AND d.day = c.day)"""


SQL_DAILY = f"{SQL_ORDER_DAYS},\n{sql_spine()}"


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    subs = {f"sub{i}_wh": F.sum(F.when(status == c, price * 500.0).otherwise(0.0)) for i, c in enumerate("FOP", 1)}
    days = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("meter_id"), F.to_date("o_orderdate").alias("day"))
        .agg(F.round(F.sum(price), 2).alias("kwh"), *[c.alias(n) for n, c in subs.items()])
    )
    return day_spine(days, ["kwh", *subs]).withColumn("temperature", 12 + 4.0 * (6 - F.abs(F.month("day") - 7)))


SQL_HOUSES = f"""house_days AS (
  SELECT o_orderpriority AS meter_id, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS kwh,
         {", ".join(f"sum(CASE WHEN o_orderstatus = '{c}' THEN o_totalprice * 500.0 ELSE 0.0 END) AS sub{i}_wh" for i, c in enumerate("FOP", 1))}
  FROM orders GROUP BY 1, 2),
{sql_spine("house_days", "house_spine", ("kwh", "sub1_wh", "sub2_wh", "sub3_wh"))},
houses AS (SELECT *, 12 + 4.0 * (6 - abs(month(day) - 7)) AS temperature FROM house_spine)"""


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).withColumn("meter_id", _pick(METERS, F.pmod(F.col("meter_id").cast("bigint"), F.lit(len(METERS)))))


def metered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linestatus").alias("meter_id"), F.to_date("l_shipdate").alias("day"))
        .agg(
            (F.round(F.sum(q * (1 + F.col("l_tax"))), 2) / 1000.0).alias("kwh"),
            F.sum(F.when(flag == "A", q).otherwise(0.0)).alias("sub1_wh"),
            F.sum(F.when(flag == "N", q).otherwise(0.0)).alias("sub2_wh"),
            F.sum(F.when(flag == "R", q).otherwise(0.0)).alias("sub3_wh"),
        )
        .withColumn(
            "remainder_wh",
            F.greatest(F.lit(0.0), F.col("kwh") * 1000.0 - (F.col("sub1_wh") + F.col("sub2_wh") + F.col("sub3_wh"))),
        )
    )


SQL_METERED = """metered_days AS (
  SELECT l_linestatus AS meter_id, CAST(l_shipdate AS DATE) AS day,
         round(sum(l_quantity * (1 + l_tax)), 2) / 1000.0 AS kwh,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END) AS sub1_wh,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END) AS sub2_wh,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS sub3_wh
  FROM lineitem GROUP BY 1, 2),
metered AS (SELECT *, greatest(0.0, kwh * 1000.0 - (sub1_wh + sub2_wh + sub3_wh)) AS remainder_wh FROM metered_days)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed per event type first: that step hashes, and only its few rows meet
    the minimum over text, which sorts."""
    per_type = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("string").alias("meter_id"), F.to_date("ts").alias("day"), "event_type")
        .agg(F.sum("value").alias("v"), F.min(_k()).alias("temperature"))
    )
    return per_type.groupBy("meter_id", "day").agg(
        F.round(F.sum("v"), 2).alias("kwh"),
        F.min("temperature").alias("temperature"),
        F.min("event_type").alias("condition"),
    )


SQL_WEATHER = f"""weather AS (
  SELECT CAST(user_id AS VARCHAR) AS meter_id, CAST(ts AS DATE) AS day, round(sum(value), 2) AS kwh,
         min({_SQL_K}) AS temperature, min(event_type) AS condition
  FROM events GROUP BY 1, 2)"""


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("meter_id"), F.to_date("l_shipdate").alias("day"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("kwh"), F.max("l_linenumber").alias("people"))
    )


SQL_HOMES = """homes AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS meter_id, CAST(l_shipdate AS DATE) AS day,
         round(sum(l_extendedprice), 2) AS kwh, max(l_linenumber) AS people
  FROM lineitem GROUP BY 1, 2)"""


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region and day. Orders are summed per customer and day before
    the join, so a customer with a third of all orders brings one row per day."""
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.to_date("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("v"))
    )
    who = (
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("meter_id"))
    )
    return (
        per_customer.join(who, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("meter_id", "day")
        .agg(F.round(F.sum("v"), 2).alias("kwh"))
    )


SQL_REGIONAL = """regional AS (
  SELECT r_name AS meter_id, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS kwh
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2)"""


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        _pick(METERS, F.pmod(conv, F.lit(len(METERS)))).alias("meter_id"),
        F.concat_ws(" ", _pick(QUESTIONS, F.pmod(conv, F.lit(len(QUESTIONS)))), F.col("text")).alias("text"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_POWER = f"""power AS (
  SELECT {_sql_list(METERS)}[user_id % {len(METERS)} + 1] AS meter_id, hour(ts) AS hour, CASE WHEN event_type <> 'error' THEN value END AS active_power_kw
  FROM events)"""

SQL_UTTERANCES = f"""utterances AS (
  SELECT conv_id, turn, {_sql_list(METERS)}[conv_id % {len(METERS)} + 1] AS meter_id,
         {_sql_list(QUESTIONS)}[conv_id % {len(QUESTIONS)} + 1] || ' ' || text AS text
  FROM conversations)"""
