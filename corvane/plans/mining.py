"""Mining queries: string clusters, lag regression with CUR columns, collaborative filtering."""

from __future__ import annotations

import time

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.config import RatingConfig, SeriesConfig
from corvane.functions.vectors import as_vector
from corvane.operators import cluster, linalg, recsys, regress, similarity, timeseries
from corvane.operators import strings as corpus
from corvane.operators.checkpoints import cut
from corvane.plans import inputs as I
from corvane.plans.relational import query
from corvane.sources.files import table

# string clusters


def _sets(spark, sf_dir) -> DataFrame:
    return similarity.with_shingles(I.strings(spark, sf_dir))


def _neighbours(spark, sf_dir) -> DataFrame:
    return similarity.nearest(_sets(spark, sf_dir))


@query(f"WITH {I.PAIRS} SELECT l, r, shared, round(dist, 9) AS dist FROM pairs WHERE dist <= 0.85e0")
def jaccard_pairs(spark, sf_dir) -> DataFrame:
    """Pairs up to the largest distance that can merge."""
    return similarity.similar_pairs(_sets(spark, sf_dir)).withColumn("dist", F.round("dist", 9))


@query(f"WITH {I.PAIRS} SELECT l, r, round(dist, 9) AS dist, rk::INT AS rk FROM nn")
def topk_neighbours(spark, sf_dir) -> DataFrame:
    return _neighbours(spark, sf_dir).withColumn("dist", F.round("dist", 9))


@query(f"WITH {I.PAIRS} SELECT round(q, 9) AS quantile, round(t, 9) AS threshold FROM lim")
def merge_threshold(spark, sf_dir) -> DataFrame:
    t = similarity.merge_threshold(_neighbours(spark, sf_dir))
    return t.select(F.round("quantile", 9).alias("quantile"), F.round("threshold", 9).alias("threshold"))


def _listed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(strings, neighbour lists, components at the merge threshold)."""
    sets = I.strings(spark, sf_dir)
    lists = cut(similarity.neighbour_lists(sets))
    limit = similarity.merge_threshold(similarity.listed(lists)).first()["threshold"]
    return sets, lists, cut(cluster.components_within(sets, lists, -1.0 if limit is None else limit))


def _assigned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(strings, components at the merge threshold)."""
    sets, _, placed = _listed(spark, sf_dir)
    return sets, placed


@query(f"WITH RECURSIVE {I.COMPONENTS} SELECT id, cluster_id FROM comp")
def components(spark, sf_dir) -> DataFrame:
    return _assigned(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {I.COMPONENTS} SELECT cluster_id, count(*) AS size FROM comp GROUP BY 1 ORDER BY size DESC, cluster_id")
def cluster_sizes(spark, sf_dir) -> DataFrame:
    return cluster.cluster_sizes(_assigned(spark, sf_dir)[1]).orderBy(F.desc("size"), "cluster_id")


@query(f"WITH RECURSIVE {I.COMPONENTS} SELECT cluster_id, list_sort(list(id)) AS members FROM comp GROUP BY 1")
def cluster_members(spark, sf_dir) -> DataFrame:
    return cluster.cluster_members(_assigned(spark, sf_dir)[1])


@query(
    f"""WITH RECURSIVE {I.COMPONENTS},
few AS (SELECT * FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(id::VARCHAR), id) AS k FROM comp) WHERE k <= 20),
mem AS (SELECT cluster_id, id, shingles FROM few JOIN sets USING (id)),
d AS (SELECT a.cluster_id, CASE WHEN len(a.shingles) + len(b.shingles) = 0 THEN 1.0 ELSE 1 - len(list_intersect(a.shingles, b.shingles))::DOUBLE / len(list_distinct(list_concat(a.shingles, b.shingles))) END AS dist
    FROM mem a JOIN mem b ON a.cluster_id = b.cluster_id AND a.id < b.id),
s AS (SELECT cluster_id, avg(dist) AS avg_dist, max(dist) AS diameter FROM d GROUP BY 1)
SELECT cluster_id, size, round(coalesce(avg_dist, 0), 9) AS avg_dist, round(coalesce(diameter, 0), 9) AS diameter
FROM (SELECT cluster_id, count(*) AS size FROM comp GROUP BY 1) LEFT JOIN s USING (cluster_id)"""
)
def cluster_stats(spark, sf_dir) -> DataFrame:
    stats = cluster.cluster_stats(_assigned(spark, sf_dir)[1], I.strings(spark, sf_dir))
    return stats.withColumns({"avg_dist": F.round("avg_dist", 9), "diameter": F.round("diameter", 9)})


_ANCHORS = "anchors AS (SELECT cluster_id, size, row_number() OVER (ORDER BY size DESC, cluster_id) AS rank FROM (SELECT cluster_id, count(*) AS size FROM comp GROUP BY 1) ORDER BY rank LIMIT 25)"
_LINK = _ANCHORS + """,
link AS (SELECT a.cluster_id, b.cluster_id AS anchor_id, min(dist) AS dist FROM ways JOIN comp a ON a.id = l JOIN comp b ON b.id = r
    WHERE a.cluster_id <> b.cluster_id AND b.cluster_id IN (SELECT cluster_id FROM anchors) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {I.COMPONENTS}, {_LINK} SELECT cluster_id, anchor_id, round(dist, 9) AS dist FROM link")
def min_link(spark, sf_dir) -> DataFrame:
    return cluster.min_link(*_assigned(spark, sf_dir)).withColumn("dist", F.round("dist", 9))


@query(f"WITH RECURSIVE {I.COMPONENTS} SELECT DISTINCT a.cluster_id, b.cluster_id AS other FROM nn JOIN comp a ON a.id = l JOIN comp b ON b.id = r WHERE a.cluster_id <> b.cluster_id")
def neighbour_clusters(spark, sf_dir) -> DataFrame:
    _, lists, placed = _listed(spark, sf_dir)
    return cluster.neighbour_clusters(similarity.listed(lists), placed)


@query(f"WITH RECURSIVE {I.COMPONENTS}, {_ANCHORS} SELECT cluster_id, size, rank::INT AS rank FROM anchors")
def anchors(spark, sf_dir) -> DataFrame:
    return cluster.anchors(_assigned(spark, sf_dir)[1])


@query(
    f"""WITH RECURSIVE {I.COMPONENTS}, {_LINK},
near AS (SELECT link.cluster_id AS c, min_by(anchor_id, (dist, rank)) AS o FROM link JOIN anchors ON anchors.cluster_id = anchor_id WHERE dist < 1 GROUP BY 1)
SELECT DISTINCT x.cluster_id, CASE WHEN a.cluster_id IS NOT NULL THEN x.cluster_id ELSE coalesce(near.o, (SELECT cluster_id FROM anchors WHERE rank = 1)) END AS anchor_id
FROM comp x LEFT JOIN anchors a USING (cluster_id) LEFT JOIN near ON near.c = x.cluster_id"""
)
def consolidated(spark, sf_dir) -> DataFrame:
    return cluster.consolidate(*_assigned(spark, sf_dir))


def _history(spark, sf_dir) -> tuple[DataFrame, DataFrame, float]:
    sets = _sets(spark, sf_dir)
    near = cut(similarity.nearest(sets))
    limit = similarity.merge_threshold(near).first()["threshold"] or 0.0
    return *cluster.merge_history(sets, near, limit), limit


@query()
def merge_history(spark, sf_dir) -> DataFrame:
    return _history(spark, sf_dir)[0]


@query()
def run_summary(spark, sf_dir) -> DataFrame:
    began = time.perf_counter()
    history, placed, limit = _history(spark, sf_dir)
    return cluster.run_summary(history, placed, limit, time.perf_counter() - began)


_JUMP = f"""{I.PRICES}, s AS (SELECT day, price AS x FROM prices),
w AS (SELECT day, x, row_number() OVER (ORDER BY day) AS k, lag(x) OVER (ORDER BY day) AS last, quantile_cont(x, 0.5) OVER (ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM s)"""


@query(f"WITH {_JUMP} SELECT day::VARCHAR AS day, round(x, 6) AS x, round(m, 6) AS trailing_median, coalesce(k > 30 AND x > m * 1.75e0 AND x - last > 0.1e0, false) AS jump FROM w")
def jump_flags(spark, sf_dir) -> DataFrame:
    series = I.prices(spark, sf_dir).select("day", F.col("price").alias("x"))
    flags = cluster.jump_flags(series, "x", "day")
    return flags.withColumns({"day": F.col("day").cast("string"), "x": F.round("x", 6), "trailing_median": F.round("trailing_median", 6)})


@query(f"WITH {I.PRICES}, w AS (SELECT day, row_number() OVER (ORDER BY day) AS step, price FROM prices) SELECT step, (5000 - step)::BIGINT AS active_clusters, round(sum(price) OVER (ORDER BY step) / (5000 - step), 6) AS global_avg_dist FROM w")
def running_average(spark, sf_dir) -> DataFrame:
    step = F.row_number().over(W.orderBy("day")).cast("bigint").alias("step")
    out = cluster.running_average(I.prices(spark, sf_dir).select(step, F.col("price").alias("change")), 5000)
    return out.select("step", F.col("active_clusters").cast("bigint").alias("active_clusters"), F.round("global_avg_dist", 6).alias("global_avg_dist"))


@query()
def string_corpus(spark, sf_dir) -> DataFrame:
    return corpus.string_corpus(spark)


@query(
    """WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), t AS (SELECT sum(size) AS total FROM s),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS k FROM customer)
SELECT c_custkey, r.c_mktsegment FROM r JOIN s USING (c_mktsegment), t WHERE k <= greatest(1, round_even(200 * size::DOUBLE / total::DOUBLE, 0))
ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 200"""
)
def stratified_sample(spark, sf_dir) -> DataFrame:
    return corpus.stratified_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 200)


@query()
def gram_projection(spark, sf_dir) -> DataFrame:
    """Truncated uncentred SVD of binary 4-gram vectors, 25 dimensions."""
    return linalg.sparse_svd_projection(corpus.gram_vectors(I.strings(spark, sf_dir)), "id", 25)


@query(
    f"""WITH {I.SETS}, g AS (SELECT unnest(shingles) AS gram FROM sets) SELECT gram, count(*) AS strings FROM g GROUP BY 1"""
)
def gram_frequencies(spark, sf_dir) -> DataFrame:
    """The vocabulary of the gram vectors: in how many strings each 4-gram is."""
    return _sets(spark, sf_dir).select(F.explode("shingles").alias("gram")).groupBy("gram").agg(F.count("*").alias("strings"))


@query()
def plot_projection(spark, sf_dir) -> DataFrame:
    """Plot coordinates of a sample of the strings, stratified by consolidated cluster: gram vectors, 25 singular
    directions, three principal components of these."""
    sets, placed = _assigned(spark, sf_dir)
    group = placed.join(cluster.consolidate(sets, placed), "cluster_id").select("id", "anchor_id")
    sample = cut(corpus.stratified_sample(I.strings(spark, sf_dir).join(group, "id"), "anchor_id", "id"))
    flat = linalg.sparse_svd_projection(corpus.gram_vectors(sample), "id", 25)
    plane = corpus.plane(flat.select("id", as_vector(F.col("coords")).alias("features")))
    return plane.join(sample, "id").select("id", "anchor_id", vector_to_array("coords").alias("coords"))


# lag regression


def _samples(spark, sf_dir) -> DataFrame:
    return timeseries.lag_samples(I.prices(spark, sf_dir))


_LAG_COLS = ", ".join(f"round(lag_{i}, 6) AS lag_{i}" for i in range(1, 16))


@query(f"WITH {I.LAGS} SELECT day::VARCHAR AS day, {_LAG_COLS}, round(label, 6) AS label FROM samples")
def lag15(spark, sf_dir) -> DataFrame:
    return _samples(spark, sf_dir).select(F.col("day").cast("string").alias("day"), *[F.round(f"lag_{i}", 6).alias(f"lag_{i}") for i in range(1, 16)], F.round("label", 6).alias("label"))


def _day_key():
    return F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))


@query(f"WITH {I.LAGS} SELECT CASE WHEN (day - DATE '1970-01-01') % 10 < 7 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM samples GROUP BY 1")
def split_counts(spark, sf_dir) -> DataFrame:
    part = F.when(F.pmod(_day_key(), F.lit(10)) < 7, "train").otherwise("test")
    return _samples(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query(f"WITH {I.LAGS} SELECT count(*) AS n, 0::BIGINT AS twice FROM samples")
def random_split(spark, sf_dir) -> DataFrame:
    """Spark's random split: its parts hold every sample once."""
    train, test = timeseries.random_split(_samples(spark, sf_dir), 0.7)
    both = train.select("day").unionAll(test.select("day"))
    return both.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("day")).alias("twice"))


@query(f"WITH {I.LAGS} SELECT round(sqrt(avg((lag_1 - label) * (lag_1 - label))), 4) AS rmse, count(*) AS n FROM samples WHERE (day - DATE '1970-01-01') % 10 >= 7")
def naive_rmse(spark, sf_dir) -> DataFrame:
    test = timeseries.key_split(_samples(spark, sf_dir), _day_key())[1]
    return test.agg(F.round(timeseries.rmse(F.col("lag_1"), F.col("label")), 4).alias("rmse"), F.count("*").alias("n"))


def _matrix(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Train and test samples with features as an array; prices in thousands."""
    rows = _samples(spark, sf_dir).select("day", F.array(*[F.col(f"lag_{i}") / 1000 for i in range(1, 16)]).alias("features"), (F.col("label") / 1000).alias("label"))
    return timeseries.key_split(rows, _day_key())


@query()
def leverage(spark, sf_dir) -> DataFrame:
    basis = linalg.svd_basis(_matrix(spark, sf_dir)[0])
    rows = [(k, j, round(float(x), 9)) for k in range(15, 4, -1) for j, x in enumerate(basis.leverage(k))]
    return spark.createDataFrame(rows, "dimension int, column int, score double")


@query()
def cur_embedding(spark, sf_dir) -> DataFrame:
    train, _ = _matrix(spark, sf_dir)
    return linalg.cur_embedding(train, linalg.svd_basis(train), SeriesConfig.min_dimension).select("day", "features", "label")


@query()
def cur_factors(spark, sf_dir) -> DataFrame:
    """U and R of the CUR decomposition at the smallest dimension."""
    train, _ = _matrix(spark, sf_dir)
    return linalg.cur_factors(train, linalg.svd_basis(train), "day", SeriesConfig.min_dimension)


_GRAM = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(a{i} * a{j}) AS g FROM m" for i in range(15) for j in range(i, 15))


@query(f"WITH {I.LAGS}, m AS (SELECT " + ", ".join(f"lag_{i} / 1000 AS a{i - 1}" for i in range(1, 16)) + f" FROM samples WHERE (day - DATE '1970-01-01') % 10 < 7) SELECT i::INT AS i, j::INT AS j, round(g, 3) AS g FROM ({_GRAM})")
def gram_matrix(spark, sf_dir) -> DataFrame:
    """The sums of products of columns of which the singular vectors and leverage scores are made."""
    basis = linalg.svd_basis(_matrix(spark, sf_dir)[0])
    gram = (basis.v * basis.singular**2) @ basis.v.T
    return spark.createDataFrame([(i, j, round(float(gram[i, j]), 3)) for i in range(15) for j in range(i, 15)], "i int, j int, g double")


@query()
def embedding_preview(spark, sf_dir) -> DataFrame:
    return linalg.embedding_preview(cur_embedding(spark, sf_dir), "day", SeriesConfig.min_dimension)


@query()
def cur_rmse_sweep(spark, sf_dir) -> DataFrame:
    return regress.dimension_sweep(*_matrix(spark, sf_dir), "day", SeriesConfig())


@query()
def best_dimension(spark, sf_dir) -> DataFrame:
    return regress.best_row(cur_rmse_sweep(spark, sf_dir), "test_rmse", "dimension")


# collaborative filtering


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return I.rating_split(cut(I.ratings(spark, sf_dir)))


@query(f"WITH {I.OVERLAP} SELECT u, v, overlap FROM counts")
def overlap_counts(spark, sf_dir) -> DataFrame:
    return recsys.overlap_counts(_split(spark, sf_dir)[0])


@query(f"WITH {I.OVERLAP} SELECT u, v, overlap, rk::INT AS rk FROM ranked WHERE rk <= 25")
def overlap_pool(spark, sf_dir) -> DataFrame:
    return recsys.overlap_pool(_split(spark, sf_dir)[0])


@query(f"WITH {I.RATINGS}, us AS (SELECT DISTINCT u FROM train) SELECT u, (SELECT count(*) FROM us) - 1 AS others FROM us")
def other_users(spark, sf_dir) -> DataFrame:
    return recsys.other_users(_split(spark, sf_dir)[0])


@query(f"WITH {I.SIMS.format(pool='rk <= 25')} SELECT u, v, common, round(sim, 6) AS sim FROM sims")
def centred_cosine(spark, sf_dir) -> DataFrame:
    train, _ = _split(spark, sf_dir)
    return recsys.pool_cosine(train, recsys.overlap_pool(train)).withColumn("sim", F.round("sim", 6))


def _predictions(spark, sf_dir, pool: int | None, sizes: tuple[int, ...]) -> DataFrame:
    train, test = _split(spark, sf_dir)
    if pool is None:
        return recsys.predict(train, test, None, sizes)
    return recsys.predict_by_pool(train, test, recsys.overlap_pool(train, pool), sizes)


@query(f"WITH {I.PREDICT.format(pool='rk <= 25')} SELECT u AS user, item, round(rating, 6) AS rating, round(prediction, 6) AS prediction FROM pred WHERE n = 10")
def cf_predict(spark, sf_dir) -> DataFrame:
    rows = _predictions(spark, sf_dir, 25, (10,))
    return rows.select("user", "item", F.round("rating", 6).alias("rating"), F.round("prediction", 6).alias("prediction"))


@query(f"WITH {I.PREDICT.format(pool='true')} SELECT u AS user, item, round(prediction, 6) AS prediction FROM pred WHERE n = 10")
def cf_predict_full_scan(spark, sf_dir) -> DataFrame:
    """Neighbours from all users; users without a common item have similarity 0 and cannot be neighbours."""
    return _predictions(spark, sf_dir, None, (10,)).select("user", "item", F.round("prediction", 6).alias("prediction"))


@query(f"WITH {I.PREDICT.format(pool='rk <= 25')} SELECT n, round(sqrt(avg((prediction - rating) * (prediction - rating))), 6) AS rmse, count(*) AS rows FROM pred WHERE prediction IS NOT NULL GROUP BY n")
def cf_rmse_by_n(spark, sf_dir) -> DataFrame:
    return recsys.error_by_size(_predictions(spark, sf_dir, 25, RatingConfig().neighbours)).withColumn("rmse", F.round("rmse", 6))


@query(f"WITH {I.PREDICT.format(pool='rk <= 25')}, e AS (SELECT n, round(sqrt(avg((prediction - rating) * (prediction - rating))), 6) AS rmse FROM pred WHERE prediction IS NOT NULL GROUP BY n) SELECT n, rmse FROM e ORDER BY rmse, n LIMIT 1")
def best_neighbourhood(spark, sf_dir) -> DataFrame:
    return regress.best_row(cf_rmse_by_n(spark, sf_dir), "rmse", "n").select("n", "rmse")


@query(f"WITH {I.RATINGS} SELECT u AS user, round(avg(rating), 6) AS mean FROM train GROUP BY 1")
def user_means(spark, sf_dir) -> DataFrame:
    return recsys.user_means(_split(spark, sf_dir)[0]).withColumn("mean", F.round("mean", 6))


@query(f"WITH {I.RATINGS} SELECT u AS user, item, round(rating, 6) AS rating FROM test WHERE u IN (SELECT u FROM train)")
def known_users(spark, sf_dir) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return recsys.known_users(test, train).withColumn("rating", F.round("rating", 6))


@query(f"WITH {I.RATINGS} SELECT item, array_to_string(list_sort(list(u)), ',') AS users FROM train GROUP BY 1")
def item_postings(spark, sf_dir) -> DataFrame:
    return recsys.postings(_split(spark, sf_dir)[0]).withColumn("users", F.array_join("users", ","))


_ITEMS = ", ".join(f"round(coalesce(max(rating) FILTER (item = {i}), 0), 6) AS i{i}" for i in range(100))


@query(f"WITH {I.RATINGS} SELECT u AS user, {_ITEMS} FROM rated GROUP BY 1")
def dense_profiles(spark, sf_dir) -> DataFrame:
    rows = recsys.dense_profiles(cut(I.ratings(spark, sf_dir)))
    return rows.select("user", *[F.round(c, 6).alias(c) for c in rows.columns if c != "user"])


_RUN = "(WITH {cte} SELECT u, item, rating, prediction FROM pred WHERE n = 10)"


@query(
    f"""SELECT count(*) AS rows, sum((round(a.prediction, 9) IS NOT DISTINCT FROM round(b.prediction, 9))::BIGINT)::BIGINT AS equal,
round(sqrt(avg((a.prediction - a.rating) ** 2)), 6) AS rmse_one, round(sqrt(avg((b.prediction - a.rating) ** 2)), 6) AS rmse_other
FROM {_RUN.format(cte=I.PREDICT.format(pool="rk <= 25"))} a JOIN {_RUN.format(cte=I.PREDICT.format(pool="true"))} b USING (u, item)"""
)
def cf_comparison(spark, sf_dir) -> DataFrame:
    """Predictions from the index against those from all users; bench.py times the two."""
    out = recsys.compare_runs(*(_predictions(spark, sf_dir, pool, (10,)).drop("n") for pool in (RatingConfig.pool, None)))
    return out.withColumns({c: F.round(c, 6) for c in ("rmse_one", "rmse_other")})


@query(f"WITH {I.SIMS.format(pool='rk <= 25')} SELECT u, v, round(avg(ru), 10) AS mean_u FROM common GROUP BY 1, 2")
def overlap_mean(spark, sf_dir) -> DataFrame:
    train, _ = _split(spark, sf_dir)
    return recsys.overlap_mean(train, recsys.overlap_pool(train)).withColumn("mean_u", F.round("mean_u", 10))


@query(f"WITH {I.OVERLAP}, p AS (SELECT u, count(*) AS n FROM ranked WHERE rk <= 25 GROUP BY 1) SELECT count(n) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS low, round(quantile_cont(n, 0.5), 6) AS q50, max(n) AS high FROM p")
def pool_sizes(spark, sf_dir) -> DataFrame:
    sizes = recsys.overlap_pool(_split(spark, sf_dir)[0]).groupBy("u").agg(F.count("*").alias("k"))
    return sizes.agg(F.count("k").alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.round(F.stddev_samp("k"), 6).alias("std"), F.min("k").alias("low"), F.round(F.percentile("k", F.lit(0.5)), 6).alias("q50"), F.max("k").alias("high"))
