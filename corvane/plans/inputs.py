"""How the operators' inputs come from the star-schema tables, for Spark and for DuckDB. All are whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.files import table


def strings(spark, sf_dir: str) -> DataFrame:
    """(id, string): every turn of conversations that has a text, whole texts."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("string"))


STRINGS = "strings AS (SELECT conv_id * 1000 + turn AS id, text AS string FROM conversations WHERE text IS NOT NULL)"
SETS = STRINGS + """,
low AS (SELECT id, lower(string) AS s FROM strings),
sets AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(length(s) - 2, 1)), lambda i: substring(s, i, 4)))) AS shingles FROM low)"""
PAIRS = SETS + """,
post AS (SELECT id, len(shingles) AS n, unnest(shingles) AS g FROM sets),
pairs AS (SELECT a.id AS l, b.id AS r, count(*) AS shared, 1 - count(*)::DOUBLE / (a.n + b.n - count(*)) AS dist
    FROM post a JOIN post b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 3),
ways AS (SELECT l, r, dist FROM pairs UNION ALL SELECT r, l, dist FROM pairs),
nn AS (SELECT * FROM (SELECT l, r, dist, row_number() OVER (PARTITION BY l ORDER BY dist, r) AS rk FROM ways) WHERE rk <= 30),
lim AS (SELECT quantile_cont(dist, 0.9) AS q, least(0.85, quantile_cont(dist, 0.9) + 0.05) AS t FROM nn WHERE rk = 1)"""
COMPONENTS = PAIRS + """,
edges AS (SELECT l, r FROM pairs, lim WHERE dist <= t UNION SELECT r, l FROM pairs, lim WHERE dist <= t),
reach AS (SELECT id, id AS other FROM strings UNION SELECT reach.id, edges.r FROM reach JOIN edges ON reach.other = edges.l),
comp AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id)"""


def ratings(spark, sf_dir: str) -> DataFrame:
    """(user, item, rating): mean value of a user's events with a key."""
    item = F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("item")  # else the filter parses it once more
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), item, "value")
    return rows.dropna().groupBy("user", "item").agg(F.avg("value").alias("rating"))


def rating_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    part = F.pmod(F.col("user") * 31 + F.col("item"), F.lit(5))
    return rows.where(part > 0), rows.where(part == 0)


RATINGS = """rated AS (SELECT user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS item, avg(value) AS rating FROM events
    WHERE user_id IS NOT NULL AND value IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL),
train AS (SELECT * FROM rated WHERE (u * 31 + item) % 5 > 0),
test AS (SELECT * FROM rated WHERE (u * 31 + item) % 5 = 0)"""
OVERLAP = RATINGS + """,
half AS (SELECT a.u AS u, b.u AS v, count(*) AS overlap FROM train a JOIN train b ON a.item = b.item AND a.u < b.u GROUP BY ALL),
counts AS (SELECT u, v, overlap FROM half UNION ALL SELECT v, u, overlap FROM half),
ranked AS (SELECT u, v, overlap, row_number() OVER (PARTITION BY u ORDER BY overlap DESC, v) AS rk FROM counts)"""
SIMS = OVERLAP + """,
pool AS (SELECT u, v FROM ranked WHERE {pool}),
common AS (SELECT p.u, p.v, a.rating AS ru, b.rating AS rv FROM pool p JOIN train a ON a.u = p.u JOIN train b ON b.u = p.v AND b.item = a.item),
centred AS (SELECT u, v, ru, rv, ru - avg(ru) OVER (PARTITION BY u, v) AS x, rv - avg(rv) OVER (PARTITION BY u, v) AS y FROM common),
sims AS (SELECT u, v, count(*) AS common, CASE WHEN count(*) >= 2 AND max(ru) > min(ru) AND max(rv) > min(rv)
    THEN round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 9) ELSE 0.0 END AS sim FROM centred GROUP BY u, v)"""
PREDICT = SIMS + """,
means AS (SELECT u, avg(rating) AS mean FROM train GROUP BY u),
near AS (SELECT t.u, t.item, s.v, s.sim, r.rating - m.mean AS dev, row_number() OVER (PARTITION BY t.u, t.item ORDER BY s.sim DESC, s.v DESC) AS rk
    FROM test t JOIN sims s ON s.u = t.u AND s.sim > 0 JOIN train r ON r.u = s.v AND r.item = t.item JOIN means m ON m.u = s.v),
sizes AS (SELECT unnest([5, 10, 15, 20, 25]) AS n),
moved AS (SELECT n, u, item, sum(sim * dev) / sum(abs(sim)) AS shift FROM near, sizes WHERE rk <= n GROUP BY ALL),
pred AS (SELECT n, t.u, t.item, t.rating, mean + coalesce(shift, 0) AS prediction FROM test t CROSS JOIN sizes LEFT JOIN means USING (u) LEFT JOIN moved USING (n, u, item))"""


def prices(spark, sf_dir: str) -> DataFrame:
    """(day, price): mean order price of each day."""
    day = F.col("o_orderdate").cast("date").alias("day")
    return table(spark, sf_dir, "orders").groupBy(day).agg(F.avg("o_totalprice").alias("price"))


PRICES = "prices AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1)"
LAGS = PRICES + ",\nlags AS (SELECT day, " + ", ".join(f"lag(price, {i}) OVER (ORDER BY day) AS lag_{i}" for i in range(1, 16)) + ", price AS label FROM prices),\nsamples AS (SELECT * FROM lags WHERE lag_15 IS NOT NULL)"
