"""Traces, answers, rollouts and ranges derived from the test tables.

No traces or trajectories ship with the test data; these views stand in for them
and grow with the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dealt import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(c: str) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, seq, ts, file, line, func, event, x: line number mod 4 names the function."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return dealt(table(spark, sf_dir, "events"), "user_id").select(
        F.col("user_id").alias("trace_id"), F.row_number().over(order).alias("seq"), "ts",
        F.concat(F.lit("pkg/mod_"), (F.col("user_id") % 5).cast("string"), F.lit(".py")).alias("file"),
        (_digits("props") % 20 + 10).alias("line"),
        F.concat(F.lit("f"), (_digits("props") % 4).cast("string")).alias("func"),
        F.when(kind == "signup", "call").when(kind == "purchase", "return").when(kind == "error", "exception").otherwise("line").alias("event"),
        F.when(kind.isin("view", "signup"), F.floor("value").cast("int") % 16).alias("x"))


def base_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return dealt(items, "l_orderkey").select(
        F.col("l_orderkey").alias("answer_id"), F.row_number().over(order).alias("pos"), "l_partkey", "l_suppkey", "l_quantity")


def expected_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_items(spark, sf_dir).select(
        "answer_id", "pos", (F.col("l_partkey") % 10).cast("string").alias("token"), F.col("l_quantity").alias("measure"))


def predicted_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some elements dropped, some replaced, some orders reversed, some measures off by one."""
    order = Window.partitionBy("answer_id").orderBy(F.when(F.col("answer_id") % 5 == 0, -F.col("pos")).otherwise(F.col("pos")))
    return base_items(spark, sf_dir).where(F.col("l_suppkey") % 9 != 0).select(
        "answer_id", F.row_number().over(order).alias("pos"),
        (F.when(F.col("l_partkey") % 8 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")) % 10).cast("string").alias("token"),
        F.when(F.col("l_suppkey") % 4 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("measure"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("instance_id"), F.col("n_name").alias("repo"), F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("archetype"), F.col("o_orderstatus").alias("exercise_mode"),
        F.col("o_totalprice").alias("score"), F.col("c_acctbal").alias("score2"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("l_partkey") % 5 < 3
    return base_items(spark, sf_dir).select(
        F.col("answer_id").alias("instance_id"), F.col("pos").alias("rollout"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"), good.alias("passed"),
        F.when(F.col("l_partkey") % 37 == 0, "session limit reached").when(good, "matched").otherwise("answer mismatch").alias("reason"),
        F.col("l_quantity").alias("duration"), F.col("l_partkey").alias("tokens"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(
        "instance_id", F.concat(F.lit("s"), (F.col("rollout") % 2).cast("string")).alias("scope"), F.col("rollout").alias("run_pos"), "passed")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("g"), (F.col(c) % 60).cast("string"))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 7).alias("module"), name("o_custkey").alias("caller"), name("o_orderkey").alias("callee")).distinct()


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("range_id"), (F.col("p_partkey") % 50).alias("instance_id"),
        F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/m.py")).alias("file"), F.col("p_size").alias("start_line"),
        (F.col("p_size") + F.col("p_partkey") % 12).alias("end_line"),
        F.when(F.col("p_partkey") % 3 == 0, "supporting").otherwise("essential").alias("necessity"))


def seen_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        (F.col("l_orderkey") % 50).alias("instance_id"), F.concat(F.col("p_brand"), F.lit("/m.py")).alias("file"),
        (F.col("l_linenumber") * 6).alias("start_line"), (F.col("l_linenumber") * 6 + F.col("l_quantity").cast("int") % 9).alias("end_line"))


#: The same views for the oracle.
VIEWS_SQL = {
    "trace_events": """SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
  concat('pkg/mod_', CAST(user_id % 5 AS VARCHAR), '.py') AS file,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 + 10 AS line,
  concat('f', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 AS VARCHAR)) AS func,
  CASE event_type WHEN 'signup' THEN 'call' WHEN 'purchase' THEN 'return' WHEN 'error' THEN 'exception' ELSE 'line' END AS event,
  CASE WHEN event_type IN ('view','signup') THEN CAST(floor(value) AS INT) % 16 END AS x FROM events""",
    "base_items": """SELECT l_orderkey AS answer_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  l_partkey, l_suppkey, l_quantity FROM lineitem""",
    "expected_elements": "SELECT answer_id, pos, CAST(l_partkey % 10 AS VARCHAR) AS token, l_quantity AS measure FROM base_items",
    "predicted_elements": """SELECT answer_id,
  row_number() OVER (PARTITION BY answer_id ORDER BY CASE WHEN answer_id % 5 = 0 THEN -pos ELSE pos END) AS pos,
  CAST((CASE WHEN l_partkey % 8 = 0 THEN l_partkey + 1 ELSE l_partkey END) % 10 AS VARCHAR) AS token,
  CASE WHEN l_suppkey % 4 = 0 THEN l_quantity + 1 ELSE l_quantity END AS measure FROM base_items WHERE l_suppkey % 9 <> 0""",
    "instances": """SELECT o_orderkey AS instance_id, n_name AS repo, c_mktsegment AS category, o_orderpriority AS archetype,
  o_orderstatus AS exercise_mode, o_totalprice AS score, c_acctbal AS score2
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "rollouts": """SELECT answer_id AS instance_id, pos AS rollout, concat('m', CAST(l_suppkey % 3 AS VARCHAR)) AS model,
  (l_partkey % 5 < 3) AS passed, CASE WHEN l_partkey % 37 = 0 THEN 'session limit reached'
  WHEN l_partkey % 5 < 3 THEN 'matched' ELSE 'answer mismatch' END AS reason, l_quantity AS duration, l_partkey AS tokens FROM base_items""",
    "verdicts": "SELECT instance_id, concat('s', CAST(rollout % 2 AS VARCHAR)) AS scope, rollout AS run_pos, passed FROM rollouts",
    "call_edges": """SELECT DISTINCT o_custkey % 7 AS module, concat('g', CAST(o_custkey % 60 AS VARCHAR)) AS caller,
  concat('g', CAST(o_orderkey % 60 AS VARCHAR)) AS callee FROM orders""",
    "line_ranges": """SELECT p_partkey AS range_id, p_partkey % 50 AS instance_id, concat('src/', p_brand, '/m.py') AS file,
  p_size AS start_line, p_size + p_partkey % 12 AS end_line,
  CASE WHEN p_partkey % 3 = 0 THEN 'supporting' ELSE 'essential' END AS necessity FROM part""",
    "seen_ranges": """SELECT l_orderkey % 50 AS instance_id, concat(p_brand, '/m.py') AS file, l_linenumber * 6 AS start_line,
  l_linenumber * 6 + CAST(floor(l_quantity) AS INT) % 9 AS end_line FROM lineitem JOIN part ON l_partkey = p_partkey""",
}
_NEEDS = {"expected_elements": ["base_items"], "predicted_elements": ["base_items"], "rollouts": ["base_items"], "verdicts": ["base_items", "rollouts"]}


def with_views(names: str, sql: str) -> str:
    """``sql`` behind the views it names; ``sql`` may go on with further common tables."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [v for v in (*_NEEDS.get(n, []), n) if v not in wanted]
    head = "WITH " + ", ".join(f"{n} AS ({VIEWS_SQL[n]})" for n in wanted)
    return f"{head}, {sql[5:]}" if sql.startswith("WITH ") else f"{head} {sql}"
