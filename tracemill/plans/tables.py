"""Trace tables from the star-schema tables, as DataFrames and as the same SQL for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.to_utc_timestamp(F.col(column).cast("timestamp_ntz").cast("timestamp"), F.current_timezone()))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as value changes of 16-bit signals, one per user."""
    e = table(spark, sf_dir, "events")
    value = F.lpad(F.bin(F.round(F.col("value") * 100).cast("long")), 16, "0")
    return e.select(micros("ts").alias("time"), (F.col("user_id") + 1).cast("int").alias("handle"), F.col("event_id").alias("seq"), value.alias("value"), (F.col("event_type") == "error").alias("var_len"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as changes of one signal per supplier, with several at one time."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(micros("l_shipdate").alias("time"), (F.col("l_suppkey") + 1).cast("int").alias("handle"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), F.lpad(F.bin(F.col("l_quantity").cast("long")), 8, "0").alias("value"))


def vars_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as variables and suppliers as aliases, in the scopes of their regions and nations."""
    places = F.broadcast(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("place")))  # tens of rows

    def one(name: str, p: str, alias: bool) -> DataFrame:
        key = F.col(f"{p}_{'supp' if alias else 'cust'}key")
        return table(spark, sf_dir, name).join(places, F.expr(f"{p}_nationkey = n_nationkey")).select(
            (key + (1_000_000_000 if alias else 0)).alias("ord"), (key % 30).cast("int").alias("type_code"), (key % 6).cast("int").alias("direction_code"), F.col(f"{p}_name").alias("name"),
            F.concat_ws(".", "place", f"{p}_name").alias("path"), F.lit(16).alias("length"), (key + 1).cast("int").alias("handle"), F.lit(alias).alias("is_alias"),
        )

    return one("customer", "c", False).unionByName(one("supplier", "s", True))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = region.select(F.lit(0).alias("type_code"), F.col("r_name").alias("name"), F.lit("").alias("component"), F.col("r_name").alias("path"), F.lit(1).alias("depth"))
    low = nation.join(F.broadcast(region), F.expr("n_regionkey = r_regionkey")).select((F.col("n_nationkey") % 22).cast("int").alias("type_code"), F.col("n_name").alias("name"), F.lit("").alias("component"), F.concat_ws(".", "r_name", "n_name").alias("path"), F.lit(2).alias("depth"))
    return top.unionByName(low)


def attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ord"), (F.col("p_size") % 4).alias("type_code"), (F.col("p_partkey") % 4).cast("int").alias("subtype_code"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("arg"), F.col("p_partkey").alias("arg_from_name"))


def blackouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error event toggles recording, off first."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(micros("ts").alias("time"), "event_id")
    idx = F.row_number().over(Window.orderBy("time", "event_id")) - 1
    return e.withColumn("idx", idx.cast("int")).select("idx", "time", (F.col("idx") % 2 == 1).alias("active"))


#: The same tables in SQL.
SQL = {
    "changes": "changes AS (SELECT epoch_us(ts) AS time, (user_id + 1)::INT AS handle, event_id AS seq, lpad(bin(round(value * 100)::BIGINT), 16, '0') AS value, event_type = 'error' AS var_len FROM events)",
    "shipments": "shipments AS (SELECT epoch_us(l_shipdate) AS time, (l_suppkey + 1)::INT AS handle, l_orderkey * 16 + l_linenumber AS seq, lpad(bin(l_quantity::BIGINT), 8, '0') AS value FROM lineitem)",
    "vars": "vars AS (SELECT c_custkey AS ord, (c_custkey % 30)::INT AS type_code, (c_custkey % 6)::INT AS direction_code, c_name AS name, r_name || '.' || n_name || '.' || c_name AS path, 16 AS length, (c_custkey + 1)::INT AS handle, false AS is_alias FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    " UNION ALL SELECT s_suppkey + 1000000000, (s_suppkey % 30)::INT, (s_suppkey % 6)::INT, s_name, r_name || '.' || n_name || '.' || s_name, 16, (s_suppkey + 1)::INT, true FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "scopes": "scopes AS (SELECT 0 AS type_code, r_name AS name, '' AS component, r_name AS path, 1 AS depth FROM region UNION ALL SELECT (n_nationkey % 22)::INT, n_name, '', r_name || '.' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "attrs": "attrs AS (SELECT p_partkey AS ord, p_size % 4 AS type_code, (p_partkey % 4)::INT AS subtype_code, p_name AS name, p_size::BIGINT AS arg, p_partkey AS arg_from_name FROM part)",
    "blackouts": "blackouts AS (SELECT idx::INT AS idx, time, idx % 2 = 1 AS active FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) AS time FROM events WHERE event_type = 'error'))",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
