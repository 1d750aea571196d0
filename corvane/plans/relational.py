"""Relational queries: sources and sinks, projections, filters, joins, aggregates, sorts, set operations, functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import jaccard_distance, shingles
from corvane.functions.vectors import l2_norm
from corvane.plans import inputs as I
from corvane.sources import files
from corvane.sources.files import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shared_path(spark, name: str) -> str:
    """A new path in the cluster's shared folder, or one of this machine where none is named and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# sources and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_scan(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "json")
    files.write_json(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path, "gzip")
    return files.read_json(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def json_reread(spark, sf_dir) -> DataFrame:
    """Writes a result, overwrites it once, and reads the folder again with an inferred schema."""
    path = shared_path(spark, "result")
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    for _ in range(2):
        files.write_json(counts, path)
    return files.read_json(spark, path)


@query("SELECT range AS index, range * range AS square FROM range(10000)")
def range_source(spark, sf_dir) -> DataFrame:
    return files.number_range(spark, 10_000).withColumn("square", F.col("index") * F.col("index"))


@query("SELECT * FROM (VALUES ('Berlin', 3), ('Oslo', 5)) AS t(place, n)")
def local_rows(spark, sf_dir) -> DataFrame:
    return files.local_rows(spark, [("Berlin", 3), ("Oslo", 5)], "place string, n int")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def temp_view_sql(spark, sf_dir) -> DataFrame:
    files.as_view(table(spark, sf_dir, "orders"), "corvane_orders")
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM corvane_orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority")


@query("SELECT array_to_string(list_sort(list(n_name)), '|') AS names, n_regionkey FROM nation GROUP BY n_regionkey")
def flat_array(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return files.flat_array(rows, "names")


# projections and filters


@query("SELECT c_custkey AS customer, c_mktsegment AS segment FROM customer")
def select_alias(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(o_totalprice * 2, 4) AS doubled FROM orders")
def select_expr(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(to_date(o_orderdate) AS string) AS day", "round(o_totalprice * 2, 4) AS doubled")


@query("SELECT c_custkey, CAST(substring(c_name, 10) AS INT) AS number, CAST(c_nationkey AS DOUBLE) AS nation FROM customer")
def add_and_cast(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.withColumns({"number": F.expr("try_cast(substring(c_name, 10) AS int)"), "nation": F.col("c_nationkey").cast("double")}).select("c_custkey", "number", "nation")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def filter_eq(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_quantity")


_SPENT = "SELECT c_custkey, sum(o_totalprice) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def _spent(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left")


@query(f"SELECT c_custkey, round(spent, 2) AS spent FROM ({_SPENT}) WHERE spent IS NOT NULL")
def drop_nulls(spark, sf_dir) -> DataFrame:
    return _spent(spark, sf_dir).dropna().select("c_custkey", F.round("spent", 2).alias("spent"))


@query(f"SELECT c_custkey, round(coalesce(spent, 0.0), 2) AS spent FROM ({_SPENT})")
def fill_nulls(spark, sf_dir) -> DataFrame:
    return _spent(spark, sf_dir).fillna(0.0).select("c_custkey", F.round("spent", 2).alias("spent"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, sf_dir) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_semi")


# joins


@query("SELECT p_brand, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def inner_join_count(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(part, "l_partkey", "inner").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def inner_join_sql(spark, sf_dir) -> DataFrame:
    files.as_view(table(spark, sf_dir, "customer"), "corvane_customer")
    files.as_view(table(spark, sf_dir, "nation"), "corvane_nation")
    return spark.sql("SELECT n.n_name, count(*) AS n FROM corvane_customer c JOIN corvane_nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY n DESC, n.n_name")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, sf_dir) -> DataFrame:
    """Key to attribute; the planner broadcasts the lookup side where its statistics allow."""
    side = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(side, "o_custkey").select("o_orderkey", "c_mktsegment")


# aggregates


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def group_count(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def group_count_two_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day"), "o_orderstatus").agg(F.count("*").alias("n")).orderBy("day")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def reduce_by_key(spark, sf_dir) -> DataFrame:
    """Sum of ones by key, as an aggregate that combines before it shuffles."""
    return table(spark, sf_dir, "events").select("event_type", F.lit(1).alias("one")).groupBy("event_type").agg(F.sum("one").alias("n")).orderBy(F.desc("n"))


@query("SELECT min(length(text)) AS shortest, max(length(text)) AS longest FROM documents")
def min_max_length(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))


@query("SELECT count(*) AS n FROM lineitem")
def global_count(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT r_name, list_sort(list(n_name)) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_collect(spark, sf_dir) -> DataFrame:
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf_dir, "nation").join(region, "n_regionkey").groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("members"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_set(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query(
    "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q25, "
    "round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS high FROM events"
)
def describe_values(spark, sf_dir) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return table(spark, sf_dir, "events").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("low"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("value").alias("high"),
    )


@query(
    "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1"
)
def pivot_counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT c_nationkey, max_by(c_custkey, (c_acctbal, c_custkey)) AS richest, min_by(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY 1")
def extreme_rows(spark, sf_dir) -> DataFrame:
    order = F.struct("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", order).alias("richest"), F.min_by("c_custkey", order).alias("poorest"))


# sorts and windows


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def sort_limit(spark, sf_dir) -> DataFrame:
    """A top-k report; the limit is the feature, and each task keeps its own top 10 first."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3")
def top_per_group(spark, sf_dir) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rank.alias("rk")).where("rk <= 3")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings ORDER BY sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) DESC, vec_id DESC LIMIT 15")
def largest_norms(spark, sf_dir) -> DataFrame:
    norm = l2_norm(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", norm.alias("x")).orderBy(F.desc("x"), F.desc("vec_id")).limit(15).select("vec_id", F.round("x", 6).alias("norm"))


# set operations and functions on arrays

_BENCH = "b AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), p AS (SELECT a.item_id AS l, b.item_id AS r, list_distinct(a.w) AS x, list_distinct(b.w) AS y FROM b a JOIN b ON b.item_id = a.item_id + 1)"


def _neighbours(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    return b.select(F.col("item_id").alias("l"), F.col("w").alias("x")).join(b.select((F.col("item_id") - 1).alias("l"), F.col("item_id").alias("r"), F.col("w").alias("y")), "l")


@query(f"WITH {_BENCH} SELECT l, r, len(list_intersect(x, y))::INT AS both, len(list_distinct(list_concat(x, y)))::INT AS either_, len(x) + len(y) AS joined FROM p")
def array_sets(spark, sf_dir) -> DataFrame:
    return _neighbours(spark, sf_dir).select("l", "r", F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_union("x", "y")).alias("either_"), F.size(F.concat("x", "y")).cast("bigint").alias("joined"))


@query(f"WITH {_BENCH} SELECT l, r, round(1 - len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS dist FROM p")
def jaccard_neighbours(spark, sf_dir) -> DataFrame:
    return _neighbours(spark, sf_dir).select("l", "r", F.round(jaccard_distance(F.col("x"), F.col("y")), 6).alias("dist"))


@query(f"WITH {I.SETS} SELECT id, len(shingles)::INT AS n, array_to_string(shingles, '|') AS shingles FROM sets")
def text_shingles(spark, sf_dir) -> DataFrame:
    return I.strings(spark, sf_dir).select("id", shingles(F.col("string")).alias("s")).select("id", F.size("s").alias("n"), F.array_join("s", "|").alias("shingles"))


@query("SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS top, round(abs(list_min(embedding)::DOUBLE), 6) AS low, round(least(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 6) AS a, round(greatest(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 6) AS b FROM embeddings")
def scalar_functions(spark, sf_dir) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.array_max("embedding").cast("double"), 6).alias("top"), F.round(F.abs(F.array_min("embedding").cast("double")), 6).alias("low"),
        F.round(F.least(e(0), e(1)), 6).alias("a"), F.round(F.greatest(e(0), e(1)), 6).alias("b"),
    )


@query("SELECT n_regionkey, to_json(list_sort(list(n_nationkey)))::VARCHAR AS keys FROM nation GROUP BY 1")
def json_arrays(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_nationkey"))).alias("keys"))
