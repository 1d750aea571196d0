"""Hand-sized cases for the edge rules of the library's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.config import ClusterConfig
from corvane.functions.text import jaccard_distance, shingles
from corvane.operators import cluster, linalg, recsys, similarity, strings, timeseries
from corvane.sources import files


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(("text", "want"), [("ABCDE", ["abcd", "bcde"]), ("aaaaaa", ["aaaa"]), ("abc", []), ("", [])])
def test_shingles(spark, text, want):
    assert rows(spark, [(text,)], "s string").select(shingles(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(("a", "b", "want"), [(["a", "b", "c"], ["b", "c", "d"], 0.5), ([], [], 1.0), (["a"], ["a"], 0.0), (["a"], [], 1.0)])
def test_jaccard(spark, a, b, want):
    assert rows(spark, [(a, b)], "a array<string>, b array<string>").select(jaccard_distance(F.col("a"), F.col("b"))).first()[0] == want


def noisy_texts(n=120):
    rng = np.random.default_rng(7)
    base = ["".join(rng.choice(list("abcdefg"), 40)) for _ in range(8)]
    texts = ["the quick brown fox", "the quick brown dog", "a quick brown fox", "zzz", "", "The Quick Brown Fox", "zzz"]
    for k in range(n):
        t = list(base[k % 8])
        for _ in range(rng.integers(0, 9)):
            t[rng.integers(len(t))] = "xyz"[rng.integers(3)]
        texts.append("".join(t))
    return texts


def distances(texts, least=3):
    cut = [{t.lower()[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    return {(i, j): 1 - len(a & b) / len(a | b) for i, a in enumerate(cut) for j, b in enumerate(cut) if i != j and len(a & b) >= least}


@pytest.mark.parametrize("cells", [10**9, 400])
def test_similarity_matches_brute_force(spark, monkeypatch, cells):
    from corvane.operators import blocks

    monkeypatch.setattr(blocks.over_blocks, "__defaults__", (None, cells))
    texts = noisy_texts()
    sets = similarity.with_shingles(rows(spark, list(enumerate(texts)), "id bigint, string string"))
    want = distances(texts)
    got = {(r["l"], r["r"]): r["dist"] for r in similarity.similar_pairs(sets, 0.6).collect()}
    assert got == {k: d for k, d in want.items() if k[0] < k[1] and d <= 0.6}
    near = [(r["l"], r["r"], r["rk"]) for r in similarity.nearest(sets, 5).collect()]
    best = {i: sorted((d, b) for (a, b), d in want.items() if a == i)[:5] for i in range(len(texts))}
    assert sorted(near) == sorted((i, b, k + 1) for i, x in best.items() for k, (_, b) in enumerate(x))
    all_edges = rows(spark, [k for k, d in want.items() if d <= 0.4], "l bigint, r bigint")
    ids = spark.range(len(texts))
    part = {tuple(r) for r in cluster.components(ids, similarity.spanning_edges(sets, 0.4)).collect()}
    assert part == {tuple(r) for r in cluster.components(ids, all_edges).collect()}
    home = dict(part)
    top = {r["cluster_id"] for r in cluster.anchors(rows(spark, list(part), "id bigint, cluster_id bigint"), 4).collect()}
    links = {}
    for (a, b), d in want.items():
        if home[a] != home[b] and home[b] in top:
            links[home[a], home[b]] = min(d, links.get((home[a], home[b]), 9))
    got = cluster.min_link(sets, rows(spark, list(part), "id bigint, cluster_id bigint"), 4).collect()
    assert {(r["cluster_id"], r["anchor_id"]): r["dist"] for r in got} == links


def test_similarity_of_nothing(spark):
    none = rows(spark, [], "id bigint, shingles array<string>")
    assert similarity.nearest(none).count() == similarity.similar_pairs(none).count() == 0
    short = rows(spark, [(1, []), (2, []), (3, None)], "id bigint, shingles array<string>")
    assert similarity.nearest(short).count() == similarity.spanning_edges(short, 1.0).count() == 0


def test_components_are_a_partition(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    parent = list(range(60))
    for _ in range(60):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["id"]: r["cluster_id"] for r in cluster.components(spark.range(60), rows(spark, edges, "l bigint, r bigint")).collect()}
    assert got == dict(enumerate(parent))


def test_components_without_edges(spark):
    none = rows(spark, [], "l bigint, r bigint")
    assert {tuple(r) for r in cluster.components(spark.range(3), none).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_single_member_has_no_spread(spark):
    sets = rows(spark, [(1, ["a"]), (2, ["a", "b"]), (3, ["b"])], "id bigint, shingles array<string>")
    got = {r["cluster_id"]: (r["size"], r["avg_dist"], r["diameter"]) for r in cluster.cluster_stats(rows(spark, [(1, 1), (2, 2), (3, 2)], "id bigint, cluster_id bigint"), sets).collect()}
    assert got == {1: (1, 0.0, 0.0), 2: (2, 0.5, 0.5)}


def test_unlinked_clusters_join_the_largest_anchor(spark):
    placed = rows(spark, [(1, 1), (2, 1), (3, 3), (4, 4)], "id bigint, cluster_id bigint")
    sets = rows(spark, [(1, ["a"]), (2, ["a"]), (3, list("pqrst")), (4, list("pqrsu"))], "id bigint, shingles array<string>")
    assert {tuple(r) for r in cluster.consolidate(sets, placed, 1).collect()} == {(1, 1), (3, 1), (4, 1)}
    assert {tuple(r) for r in cluster.consolidate(sets, placed, 2).collect()} == {(1, 1), (3, 3), (4, 3)}


@pytest.mark.parametrize(("before", "value", "stop"), [(29, 9.0, False), (30, 0.55, True), (30, 0.50, False), (30, 0.39, False)])
def test_jump_rule(spark, before, value, stop):
    series = rows(spark, [(i, 0.30) for i in range(before)] + [(before, value)], "step int, d double")
    assert cluster.jump_flags(series, "d", "step").orderBy(F.desc("step")).first()["jump"] is stop


def test_merge_history_is_ordered(spark):
    base = "abcdefghijklmnopqrstuvwxyz"
    texts = [base, base + "x", base[1:], "0123456789" * 3, "0123456789" * 3 + "q", "lonely text here"]
    sets = similarity.with_shingles(rows(spark, list(enumerate(texts)), "id bigint, string string"))
    near = similarity.nearest(sets)
    history, placed = cluster.merge_history(sets, near, 0.5)
    got = history.orderBy("step").collect()
    assert [r["active_clusters"] for r in got] == [5, 4, 3]
    assert [r["merge_distance"] for r in got] == sorted(r["merge_distance"] for r in got)
    assert {tuple(r) for r in placed.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)}
    assert got[0]["global_avg_dist"] == got[0]["merge_distance"] / 5
    with pytest.raises(ValueError, match="edges"):
        cluster.merge_history(sets, near, 0.9, most_rows=1)


def test_merge_history_stops_before_a_jump(spark):
    pairs = [(2 * k, 2 * k + 1, 0.1 + k / 1000) for k in range(35)] + [(0, 80, 0.5), (90, 91, 0.6)]
    sets = [(i, [f"g{i // 2}_{j}" for j in range(10)] + [f"own{i}"]) for i in range(70)] + [(80, ["far"]), (90, ["x"]), (91, ["x"])]
    near = rows(spark, [(a, b, d, 1) for a, b, d in pairs], "l bigint, r bigint, dist double, rk int")
    history, placed = cluster.merge_history(rows(spark, sets, "id bigint, shingles array<string>"), near, 0.9)
    assert history.count() == 35
    home = {r["id"]: r["cluster_id"] for r in placed.collect()}
    assert home[80] == 80 and home[91] == 91 and home[1] == 0 and home[69] == 68


def test_cur_factors_match_numpy(spark):
    data = np.random.default_rng(5).standard_normal((30, 6)) * np.arange(1, 7)
    df = rows(spark, [(i, r.tolist()) for i, r in enumerate(data)], "k int, features array<double>")
    basis = linalg.svd_basis(df)
    got = linalg.cur_factors(df, basis, "k", 3).orderBy("factor", "position").collect()
    top = np.argsort(-np.linalg.norm(data, axis=1))[:3]
    assert [r["key"] for r in got[:3]] == [str(i) for i in top]
    assert np.allclose([r["values"] for r in got[:3]], data[top])
    assert np.allclose([r["values"] for r in got[3:]], np.linalg.pinv(data[top][:, basis.columns(3)]))


def test_lags_drop_rows_after_a_null(spark):
    series = rows(spark, [(i, None if i == 3 else float(i)) for i in range(1, 21)], "day int, price double")
    assert [r["day"] for r in timeseries.lag_samples(series).orderBy("day").collect()] == [19, 20]


def test_dirty_prices_become_null(spark):
    raw = rows(spark, [("2020-01-02", "1.5"), ("x", "y")], "Date string, p string")
    assert [tuple(map(str, r)) for r in timeseries.clean_prices(raw, "p").collect()] == [("2020-01-02", "1.5"), ("None", "None")]


def test_leverage_sums_to_one(spark):
    data = np.random.default_rng(2).standard_normal((40, 6))
    basis = linalg.svd_basis(rows(spark, [(i, r.tolist()) for i, r in enumerate(data)], "k int, features array<double>"))
    assert np.allclose(basis.singular, np.linalg.svd(data)[1])
    for k in range(1, 7):
        assert abs(basis.leverage(k).sum() - 1) < 1e-9
    assert basis.columns(6) == [5, 4, 3, 2, 1, 0]  # all equal at full rank


def test_sparse_projection_matches_numpy(spark):
    from pyspark.ml.functions import array_to_vector

    data = np.random.default_rng(3).standard_normal((60, 12)) * np.arange(1, 13) ** 2
    df = rows(spark, [(i, r.tolist()) for i, r in enumerate(data)], "id bigint, x array<double>").select("id", array_to_vector("x").alias("features"))
    got = np.array([r["coords"] for r in linalg.sparse_svd_projection(df, "id", 3, rounds=12).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(got, axis=0), np.linalg.svd(data)[1][:3], rtol=1e-6)


RATED = "user bigint, item int, rating double"


def sims(spark, data):
    pairs = rows(spark, [(1, 2)], "u bigint, v bigint")
    return recsys.centred_cosine(rows(spark, data, RATED), pairs).first()["sim"]


def test_similarity_edges(spark):
    assert sims(spark, [(1, 1, 1.0), (2, 1, 5.0)]) == 0.0
    assert sims(spark, [(1, 1, 3.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 2.0)]) == 0.0
    assert sims(spark, [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 3.0), (2, 2, 2.0), (2, 3, 1.0)]) == -1.0


def test_prediction_fallbacks_and_ties(spark):
    train = rows(spark, [(1, 1, 2.0), (1, 2, 4.0), (3, 9, 5.0), (7, 9, 1.0), (3, 8, 1.0), (7, 8, 3.0)], RATED)
    test = rows(spark, [(1, 9, 3.0), (99, 9, 3.0), (1, 55, 3.0)], RATED)
    near = rows(spark, [(1, 3, 1.0), (1, 7, 1.0)], "u bigint, v bigint, sim double")
    got = {(r["user"], r["item"]): r["prediction"] for r in recsys.predict(train, test, near, (1,)).collect()}
    assert got[1, 9] == 3.0 + (1.0 - 2.0)  # the larger user id wins the tie
    assert got[99, 9] is None and got[1, 55] == 3.0


def test_full_pool_equals_index(spark):
    rng = np.random.default_rng(4)
    data = [(int(u), int(i), float(rng.integers(1, 6))) for u in range(12) for i in rng.choice(15, 8, replace=False)]
    train = rows(spark, data, RATED)
    all_ = recsys.centred_cosine(train, recsys.overlap_pool(train, None))
    some = recsys.centred_cosine(train, recsys.overlap_pool(train, 11))
    assert {tuple(r) for r in all_.collect()} == {tuple(r) for r in some.collect()}


def test_string_corpus(spark):
    c = ClusterConfig(total_strings=500)
    got = strings.string_corpus(spark, c).collect()
    assert len(got) == 500 and {r["prototype_id"] for r in got} == set(range(25))
    assert all(32 <= len(r["string"]) <= 64 for r in got)
    assert 150 < sum(r["string"] != r["string"].lower() for r in got) < 350
    assert got == strings.string_corpus(spark, c).collect()


def test_quota_rounds_half_to_even(spark):
    data = rows(spark, [(i, "a" if i < 25 else "b") for i in range(100)], "k int, s string")
    got = strings.stratified_sample(data, "s", "k", 10).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"a": 2, "b": 8}


def test_files_round_trip(spark, tmp_path):
    df = rows(spark, [(1, "a,b"), (2, None)], "n int, s string")
    files.write_csv(df, f"{tmp_path}/c")
    files.write_json(df, f"{tmp_path}/j", "gzip")
    for back in (files.read_csv(spark, f"{tmp_path}/c", "n int, s string"), files.read_json(spark, f"{tmp_path}/j", "n int, s string"), files.read_json(spark, f"{tmp_path}/j").select("n", "s")):
        assert sorted((r["n"], r["s"]) for r in back.collect()) == [(1, "a,b"), (2, None)]
    assert [tuple(r) for r in files.schema_rows(df).collect()] == [(0, "n", "int", True), (1, "s", "string", True)]


def test_gram_vectors_keep_every_gram(spark):
    text = "".join(chr(0x4E00 + k % 20_000) + chr(0x4E00 + k // 20_000) for k in range(70_000))
    parts = rows(spark, [(k, text[k * 200 : k * 200 + 203]) for k in range(700)], "id bigint, string string")
    distinct = len({text[k : k + 4] for k in range(len(text) - 3)})
    assert distinct > 1 << 16
    assert strings.gram_vectors(parts).first()["features"].size == distinct
    with pytest.raises(ValueError, match="4-grams"):
        strings.gram_vectors(parts, most=1000)


def test_pairs_of_a_block_with_itself_come_once(spark):
    """More rows in one block than are counted at once."""
    n = 2500
    sets = rows(spark, [(i, [f"a{i // 2}", f"b{i // 2}", f"c{i // 2}", f"d{i}"]) for i in range(n)], "id bigint, shingles array<string>")
    got = sorted((r["l"], r["r"], r["shared"]) for r in similarity.similar_pairs(sets, 0.5).collect())
    assert got == [(i, i + 1, 3) for i in range(0, n, 2)]
    near = similarity.nearest(sets, 2).collect()
    assert sorted((r["l"], r["r"], r["rk"]) for r in near) == [(i, i ^ 1, 1) for i in range(n)]
    edges = similarity.spanning_edges(sets, 0.5).collect()
    assert {(min(e), max(e)) for e in edges} == {(i, i + 1) for i in range(0, n, 2)}
    train = rows(spark, [(i, i // 2, 1.0) for i in range(n)], "user int, item int, rating double")
    assert sorted(map(tuple, recsys.overlap_counts(train).collect())) == [(i, i ^ 1, 1) for i in range(n)]


def test_blocks_are_shuffled_once(spark):
    """The bytes that a blocked product shuffles do not follow the number of blocks."""
    from corvane.operators.blocks import over_blocks

    rng = np.random.default_rng(3)
    sets = rows(spark, [(i, [int(x) for x in rng.choice(5000, 60, replace=False)]) for i in range(400)], "id bigint, cells array<bigint>")
    status = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: status.executorList(False).head().totalShuffleWrite()
    sizes = []
    for cells in (10**9, 600):
        before = written()
        assert over_blocks(sets, lambda p: __import__("pyarrow").table({"n": [len(p.l) * len(p.r)]}), "n bigint", None, cells).agg(F.sum("n")).first()[0] == 400**2
        sizes.append(written() - before)
    assert sizes[1] < 3 * sizes[0]


def test_merge_history_carries_its_samples(spark):
    """Against all members of every cluster, sorted anew for each merge."""
    import hashlib

    texts = noisy_texts(90)
    sets = similarity.with_shingles(rows(spark, list(enumerate(texts)), "id bigint, string string"))
    near = similarity.nearest(sets)
    history, _ = cluster.merge_history(sets, near, 0.85, ClusterConfig(max_sample=5, jump_factor=1e9))
    cut = [{t.lower()[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    home, want = {i: [i] for i in range(len(texts))}, []
    for d, a, b in sorted({(r["dist"], min(r["l"], r["r"]), max(r["l"], r["r"])) for r in near.collect() if r["dist"] <= 0.85}):
        if home[a] is home[b]:
            continue
        both = home[a] + home[b]
        home.update(dict.fromkeys(both, both))
        some = [cut[i] for i in sorted(both, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:5]]
        want.append((d, len(both), max(1 - len(x & y) / len(x | y) for k, x in enumerate(some) for y in some[k + 1 :])))
    got = [(r["merge_distance"], r["merged_cluster_size"], r["merged_cluster_diameter"]) for r in history.orderBy("step").collect()]
    assert got == want and len(got) > 60


@pytest.mark.parametrize("values", [(1.0, 2.0, 3.0), (50.01, 50.02, 480.3, 7.7, 0.0)])
def test_neighbours_from_all_users_match_joins(spark, values):
    rng = np.random.default_rng(8)
    data = [(int(u), int(i), float(rng.choice(values))) for u in range(60) for i in rng.choice(14, rng.integers(1, 11), replace=False)]
    data += [(99, 0, 2.0), (99, 1, 2.0)]
    part = [(u, i, r) for u, i, r in data if (u * 31 + i) % 5 == 0] + [(500, 1, 1.0), (3, 77, 1.0)]
    train, test = rows(spark, [x for x in data if x not in part], RATED), rows(spark, part, RATED)
    want = recsys.ranked_neighbours(train, test, recsys.centred_cosine(train, recsys.overlap_pool(train, None))).where("rk <= 4")
    exact = lambda x: sorted((r["user"], r["item"], r["rk"], r["v"], round(r["sim"], 8), round(r["dev"], 9)) for r in x.collect())
    got = recsys.all_neighbours(train, test, 4)
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "Window" not in got._jdf.queryExecution().toString()
    assert exact(got) == exact(want) and len(exact(want)) > 50


def test_sums_hold_one_column_at_a_time():
    import tracemalloc

    n, width = 200_000, 33
    at, value, q = np.arange(n) % 500, np.ones(n), np.ones((1000, width))
    tracemalloc.start()
    got = linalg._sums(at, (value * x[np.arange(n) % 1000] for x in q.T), 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == n / 500).all() and peak < n * width * 8 / 4


def test_components_within_find_links_beyond_the_lists(spark, monkeypatch):
    """Lists full of copies hide the links between their groups; the groups are joined all the same, as are all pairs."""
    from corvane.operators import blocks

    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    texts = [base] * 8 + [base + " so it went"] * 8 + ["something else altogether is said in this one"] * 3 + ["x", None] + noisy_texts()
    sets = similarity.with_shingles(rows(spark, list(enumerate(texts)), "id bigint, string string"))
    want = distances([t or "" for t in texts])
    for cells in (10**9, 400):
        monkeypatch.setattr(blocks.over_blocks, "__defaults__", (None, cells))
        for k in (3, 30):
            lists = similarity.neighbour_lists(sets, k)
            got = {tuple(r) for r in cluster.components_within(sets, lists, 0.4, k).collect()}
            all_edges = rows(spark, [p for p, d in want.items() if d <= 0.4], "l bigint, r bigint")
            assert got == {tuple(r) for r in cluster.components(spark.range(len(texts)), all_edges).collect()}
        near = similarity.listed(lists).collect()
        best = {i: sorted((d, b) for (a, b), d in want.items() if a == i)[:30] for i in range(len(texts))}
        assert sorted((r["l"], r["r"], r["dist"], r["rk"]) for r in near) == sorted((i, b, d, n + 1) for i, x in best.items() for n, (d, b) in enumerate(x))


def test_blocks_are_not_shuffled_as_sets(spark):
    """What neighbours of strings take on disk follows their text: less than the eight bytes of each shingle's hash."""
    texts = [(i, " ".join(f"{w}{(i * 7 + n * n) % 97}" for n, w in enumerate("all of these words are in every one of the many texts".split() * 6))) for i in range(600)]
    sets = similarity.with_shingles(rows(spark, texts, "id bigint, string string"))
    cells = sets.selectExpr("sum(size(shingles))").first()[0]
    status = spark.sparkContext._jsc.sc().statusStore()
    before = status.executorList(False).head().totalShuffleWrite()
    assert similarity.nearest(sets, 3).count() == 1800
    assert status.executorList(False).head().totalShuffleWrite() - before < 4 * cells


def test_cluster_stats_shuffle_texts_not_shingles(spark):
    """Over all pairs of each cluster; what is shuffled follows the texts of clusters of two and more."""
    texts = noisy_texts(113)
    strings = rows(spark, [(i, t * 20) for i, t in enumerate(texts)] + [(200, ""), (201, "x"), (202, None)], "id bigint, string string")
    placed = rows(spark, [(i, i % 7) for i in range(120)] + [(200, 200), (201, 200), (202, 202)], "id bigint, cluster_id bigint")
    cut = {i: {(t * 20).lower()[k : k + 4] for k in range(len(t) * 20 - 3)} for i, t in enumerate(texts)} | {200: set(), 201: set(), 202: set()}
    want = {}
    for c in (*range(7), 200, 202):
        ids = [i for i in cut if (i % 7 if i < 120 else 200 + 2 * (i == 202)) == c]
        d = [1 - len(cut[i] & cut[j]) / (len(cut[i] | cut[j]) or 1) for i in ids for j in ids if i < j]
        want[c] = (len(ids), round(sum(d) / max(len(d), 1), 12), round(max(d, default=0.0), 12))
    status = spark.sparkContext._jsc.sc().statusStore()
    before = status.executorList(False).head().totalShuffleWrite()
    got = cluster.cluster_stats(placed, strings).collect()
    assert {r["cluster_id"]: (r["size"], round(r["avg_dist"], 12), round(r["diameter"], 12)) for r in got} == want
    assert status.executorList(False).head().totalShuffleWrite() - before < 2 * sum(len(t) * 20 for t in texts)
    same = cluster.cluster_stats(placed, similarity.with_shingles(strings)).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, got))


@pytest.mark.parametrize("copies", [1, 3, 40])
def test_pool_of_copied_users_matches_all_counts(spark, copies):
    """Users of the same items, more of them than the pool takes; every user of a set that others have is counted once."""
    rng = np.random.default_rng(12)
    data = [(int(u) + 100 * k, int(i), float(rng.integers(1, 6))) for u in range(30) for i in rng.choice(12, rng.integers(1, 9), replace=False) for k in range(copies)]
    data += [(9000, 900, 1.0), (9001, 901, 2.0), (9002, 901, 2.0)]
    train = rows(spark, data, RATED)
    for pool in (1, 4):
        want = recsys.overlap_pool(train, None).where(F.col("rk") <= pool).select("u", "v", "overlap", "rk")
        assert sorted(map(tuple, recsys.overlap_pool(train, pool).collect())) == sorted(map(tuple, want.collect()))


def test_copied_users_add_no_counts(spark, monkeypatch):
    """The product has a row for each different set of items, not for each user."""
    from corvane.operators import blocks

    met = []
    whole = blocks.over_blocks
    monkeypatch.setattr(recsys, "over_blocks", lambda sets, *a, **b: met.append(sets.count()) or whole(sets, *a, **b))
    train = rows(spark, [(u, (u % 5) * 3 + i, 1.0) for u in range(200) for i in range(4)], RATED)
    assert recsys.overlap_pool(train, 25).count() == 200 * 25
    assert met == [5]


def test_pool_cosine_shuffles_no_rating_for_a_pair(spark):
    """As by joins, in blocks; what is shuffled does not follow pairs times common items."""
    rng = np.random.default_rng(13)
    values = (50.01, 50.02, 480.3, 7.7, 0.0)
    data = [(int(u), int(i), float(rng.choice(values))) for u in range(200) for i in rng.choice(60, rng.integers(1, 50), replace=False)]
    train = rows(spark, data, RATED)
    pairs = rows(spark, sorted({(int(u), int(v)) for u, v in rng.integers(0, 202, (6000, 2)) if u != v}), "u bigint, v bigint")
    exact = lambda x: sorted((r["u"], r["v"], r["common"], round(r["sim"], 8)) for r in x.collect())
    status = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: status.executorList(False).head().totalShuffleWrite()
    sizes, got = [written()], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        for f in (recsys.centred_cosine, recsys.pool_cosine):
            got.append(exact(f(train, pairs)))
            sizes.append(written())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and len(got[0]) > 4000
    assert 2 * (sizes[2] - sizes[1]) < sizes[1] - sizes[0]
    mean = {}
    for u, i, r in data:
        mean.setdefault(u, {})[i] = r
    for r in recsys.overlap_mean(train, pairs).limit(200).collect():
        common = [x for i, x in mean[r["u"]].items() if i in mean[r["v"]]]
        assert abs(r["mean_u"] - sum(common) / len(common)) < 1e-9


def test_best_neighbourhood_reads_pools_in_blocks(spark, small):
    """The plan of the errors has no window over pairs of users and their common items."""
    from corvane.plans import mining

    plan = mining.cf_rmse_by_n(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not [x for x in plan.splitlines() if "Window" in x and "[u#" in x]


def test_predictions_by_pool_match_joins(spark):
    """As from similarities and joins, ties, users without neighbours and unknown ones included; neighbours are not shuffled."""
    rng = np.random.default_rng(14)
    values = (50.01, 50.02, 480.3, 7.7, 0.0)
    data = [(int(u), int(i), float(rng.choice(values))) for u in range(160) for i in rng.choice(60, rng.integers(3, 50), replace=False)]
    data += [(u + 1000, i, r) for u, i, r in data if u < 40] + [(5000, 900, 1.0), (5000, 901, 2.0), (6000, 5, 3.0)]
    train = rows(spark, [x for x in data if (x[0] * 31 + x[1]) % 5 and x[0] != 6000], RATED)
    test = rows(spark, [x for x in data if not (x[0] * 31 + x[1]) % 5 or x[0] == 6000 or x[1] == 900], RATED)
    pairs = recsys.overlap_pool(train, 12).localCheckpoint()
    status = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: status.executorList(False).head().totalShuffleWrite()
    sizes, got = [written()], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        for made in (lambda: recsys.predict(train, test, recsys.pool_cosine(train, pairs), (1, 5, 12)), lambda: recsys.predict_by_pool(train, test, pairs, (1, 5, 12))):
            got.append(sorted((r["n"], r["user"], r["item"], r["rating"], None if r["prediction"] is None else round(r["prediction"], 7)) for r in made().collect()))
            sizes.append(written())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and len(got[0]) == 3 * test.count()
    assert [x[4] for x in got[1] if x[1] == 6000] == [None] * 3
    assert 2 * (sizes[2] - sizes[1]) < sizes[1] - sizes[0]


def test_counts_as_bits_match_products():
    """Rows of up to 255 items in common, where words of bits begin and end, in one piece and in many."""
    from corvane.operators import blocks

    rng = np.random.default_rng(15)

    def block(first, n, names):
        has = rng.random((n, len(names))) < 0.6
        arrays = {"id": first + np.arange(n), "size": has.sum(axis=1).astype(np.int32), "names": np.array(names, np.int64), "code": np.nonzero(has)[1].astype(np.int32)}
        return blocks.Block({k: blocks.pa.array(x) for k, x in arrays.items()})

    for n in (0, 5, 64, 65, 129, 255, 256):
        a, b = block(0, 101, [*range(n), 1000]), block(500, 207, [*range(n), 2000])
        want = np.concatenate([x for *_, x in blocks.product(a, b)])
        for step in (7, 500):
            got = np.concatenate([x for *_, x in blocks._common_bits(blocks._bits(a, np.arange(n)), blocks._bits(b, np.arange(n)), step)]) if n < 256 else want
            assert np.array_equal(got, want)
        assert np.array_equal(blocks.places(want > 40), np.flatnonzero(want > 40))
        kinds = {x.dtype for *_, x in blocks.product(a, b, True)}
        assert kinds == {np.dtype(np.uint8 if n < 256 else np.float32)}


def test_pool_where_few_and_many_items_are_shared(spark):
    """A user of more items than a byte counts keeps its neighbours when later blocks are compared as bits."""
    rng = np.random.default_rng(16)
    data = [(u, i, 1.0) for u in range(8) for i in rng.choice(400, 330, replace=False)]
    data += [(100 + u, int(i), 1.0) for u in range(4100) for i in rng.choice(60, rng.integers(1, 9), replace=False)]
    train = rows(spark, [(int(u), int(i), r) for u, i, r in data], RATED)
    want = recsys.overlap_pool(train, None).where("rk <= 5 and (u < 8 or u % 500 = 0)").select("u", "v", "overlap", "rk")
    got = recsys.overlap_pool(train, 5).where("u < 8 or u % 500 = 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ratings_parse_a_property_once(spark, tmp_path):
    """Odd properties give no rating, as in SQL, and the plan has one parse of them."""
    from corvane.plans import inputs

    odd = [(1, 2.0, '{"k": 3}'), (1, 4.0, '{"k": 3}'), (2, 5.0, '{"k": null}'), (2, 5.0, "{}"), (3, 1.0, None), (4, None, '{"k": 1}'), (None, 1.0, '{"k": 1}')]
    spark.createDataFrame(odd, "user_id bigint, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = inputs.ratings(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, 3, 3.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1


def test_counts_in_pairs_match_sets():
    """Rows of more cells than a byte counts, an odd number of dense ones, and parts of blocks."""
    from corvane.operators import blocks

    rng = np.random.default_rng(17)

    def block(first, n, share):
        has = rng.random((n, 1501)) < share
        arrays = {"id": first + np.arange(n), "size": has.sum(axis=1).astype(np.int32), "names": np.arange(1501), "code": np.nonzero(has)[1].astype(np.int32)}
        return has, blocks.Block({k: blocks.pa.array(x) for k, x in arrays.items()})

    share = np.r_[np.full(701, 0.9), np.full(800, 0.02)]
    (x, a), (y, b) = block(0, 203, share), block(500, 307, share)
    want = x.astype(int) @ y.T.astype(int)
    assert np.array_equal(np.concatenate([c for *_, c in blocks.product(a, b)]), want) and want.max() > 510
    left, runs = blocks._paired(a, np.arange(701), (1, 256), True)
    assert left.shape == (203, 351) and len(runs) > 2 and runs[-1][1] == 351
    at, to = np.arange(0, 203, 3), np.arange(1, 307, 2)
    assert np.array_equal(np.concatenate([c for *_, c in blocks.product(a.part(at), b.part(to))]), want[np.ix_(at, to)])
    least = np.where(want > 0, 1 - want / (a.size[:, None] + b.size[None, :] - want), np.inf).min(axis=1)
    assert (blocks.nearest_possible(a.size, a.known(b), b.size) <= least).all()


def test_rows_that_cannot_be_near_do_not_meet(spark):
    """Texts of two languages or of very different sizes are not multiplied where a distance is given; all near pairs are found."""
    from corvane.operators import blocks

    rng = np.random.default_rng(18)
    data = [(i, [int(x) + i % 2 * 5000 for x in rng.choice(400, 20 if i % 4 < 2 else 200, replace=False)]) for i in range(4000)]
    sets = rows(spark, data, "id bigint, cells array<bigint>").coalesce(1)
    met = lambda **more: blocks.over_blocks(sets, lambda p: blocks.pa.table({"n": [len(p.l) * len(p.r)]}), "n bigint", **more).agg(F.sum("n")).first()[0]
    assert met() == 4000**2
    assert met(limit=lambda strip, *_: np.full(strip.rows, 0.8)) < 4000**2 / 3


def test_links_of_groups_and_anchors_match_brute_force(spark, monkeypatch):
    """The smallest distance of each cluster to each anchor, though later blocks are held against what is known."""
    from corvane.operators import blocks

    texts = noisy_texts(160)
    want = distances(texts)
    group = {i: i % 9 for i in range(len(texts))}
    sets = similarity.with_shingles(rows(spark, list(enumerate(texts)), "id bigint, string string"))
    placed = rows(spark, list(group.items()), "id bigint, cluster_id bigint")
    least = {}
    for (a, b), d in want.items():
        if group[a] != group[b]:
            key = group[a], group[b]
            least[key] = min(d, least.get(key, 2.0))
    for cells in (10**9, 400):
        monkeypatch.setattr(blocks.over_blocks, "__defaults__", (None, cells))
        assert {(r[0], r[1]): r[2] for r in cluster.min_link(sets, placed, 9).collect()} == least
        got = similarity.linked_groups(sets.join(placed.withColumnRenamed("cluster_id", "group"), "id"), 0.3).collect()
        part = lambda edges: sorted(map(tuple, cluster.components(spark.range(9), rows(spark, edges, "l bigint, r bigint")).collect()))
        assert part([(r["l"], r["r"]) for r in got]) == part([k for k, d in least.items() if d <= 0.3])


def test_copied_users_are_one_row_of_the_full_scan(spark, monkeypatch):
    """Neighbours of copies, themselves among each other's, as from joins; the product has a row for each different user."""
    rng = np.random.default_rng(19)
    base = [(int(u), int(i), float(rng.choice((1.0, 2.0, 3.0)))) for u in range(24) for i in rng.choice(14, rng.integers(1, 11), replace=False)]
    data = [(u + 24 * c, i, r) for u, i, r in base for c in (0, 5, 10, 15, 200)[: 1 + u % 5]]
    part = [(u, i, r) for u, i, r in data if (u % 24 + i) % 4 == 0] + [(9000, 1, 1.0), (3, 77, 1.0)]
    train, test = rows(spark, [x for x in data if x not in part], RATED), rows(spark, part, RATED)
    met, whole = [], recsys.packed
    monkeypatch.setattr(recsys, "packed", lambda x, *a, **b: met.append(x.count()) or whole(x, *a, **b))
    exact = lambda x: sorted((r["user"], r["item"], r["rk"], r["v"], round(r["sim"], 8), round(r["dev"], 9)) for r in x.collect())
    for k in (1, 4, 9):
        got = exact(recsys.all_neighbours(train, test, k))
        want = recsys.ranked_neighbours(train, test, recsys.centred_cosine(train, recsys.overlap_pool(train, None))).where(f"rk <= {k}")
        assert got == exact(want) and len(got) > 25
    assert met[0] <= 24
