"""One table of clashing names, nulls, long texts, ties, repeated rows and empty tables for all operators, and plain
Python versions of what SQL cannot express."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontam, langid, linededup, ngram_join, pieces, quality, rules, sharding, toxicity
from corvane.llm import html as pages
from corvane.llm.features import NGrams

#: Names that the operators use inside.
CLASH = "own sigs key key_ n_lines n_dropped _text _clean _toxic at digest label grade t h n m body words start gram g items item cls live blocks root degree other_id bad_id row copies span hit leaf lo hi sig first_id held_out score predicted shard _id _row".split()
BASE = ["doc_id", "text", "lang", "source", "n_chars"]
TEXTS = [None, "", " \n\t ", "word", "word", "word", "a b c d e f g h i j k l", "é" * 50, "x " * 60_000, "one two three four five six\n" * 40, "line that all have in this table\nown one", "line that all have in this table\nown two"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every clashing name beside the columns of documents; some rows and ids are repeated or null."""
    ids = [0, 1, 2, 3, 4, 4, 6, 7, 8, 9, None, 11]
    data = [(i, t, None if k % 3 else "en", "s", len(t or ""), *[f"{c}{k}" for c in CLASH]) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([*data, data[4]], ddl)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 1, 1), (6, 0, 1), (7, 1, 0), (8, None, None), (None, 1, 1), (9, 1, 7)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, None), (3, ""), (None, "line that all")], "item_id bigint, text string")


def plain(df, *but):
    names = [c for c in df.columns if c not in but]
    return sorted(map(repr, df.select(*[F.col(f"`{c}`") for c in names]).collect()))


def test_rows_and_columns_pass(spark, odd, labels, bench, tmp_path):
    whole = plain(odd)
    for made in (toxicity.drop_toxic(odd, labels, threshold=2.0), decontam.drop_contaminated(odd, bench, max_hit_pct=100), decontam.drop_contaminated(odd, bench.where("false"))):
        assert made.columns == odd.columns and plain(made) == whole
    one = ngram_join.keep_one(odd)
    assert one.columns == odd.columns and {r["doc_id"] for r in one.collect()} == {0, 1, 2, 3, 6, 7, 8, 9, None, 11}
    clean = linededup.drop_recurring(odd)
    assert clean.columns == [c for c in odd.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert plain(clean, "text", "n_lines", "n_dropped") == plain(odd, "text", "n_lines", "n_dropped")
    small = linededup.TreeParams(max_broadcast=0)
    assert plain(linededup.drop_recurring(odd, small)) == plain(clean)
    coded = pieces.encode(odd.withColumn("ids", F.lit("mine")).withColumn("N_Tokens", F.lit(1)))
    assert coded.columns.count("ids") == 1 and "N_Tokens" not in coded.columns and all(r["round_trip"] for r in coded.collect())
    back = pieces.decode(coded.withColumn("text", F.lit("old")))
    assert sorted(r["text"] for r in back.collect()) == sorted([*(t or "" for t in TEXTS), TEXTS[4]])
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(odd)
    assert plain(store.read(shard="place"), "place") == whole
    assert [c for c in store.read().columns if c == "shard"] == ["shard"] and store.read().count() == odd.count()


def test_a_result_for_every_row(odd, labels, bench):
    n = odd.count()
    ratings = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    for made in (
        toxicity.score(odd, toxicity.train(odd, labels)), quality.rate(odd, quality.train(odd, ratings)), langid.predict(odd, langid.train(odd)),
        ngram_join.jaccard_components(odd), rules.evaluate(odd), decontam.contamination(odd, bench), linededup.drop_recurring(odd),
    ):
        got = made.collect()
        assert len(got) == n
        twins = [r.asDict() for r in got if r["doc_id"] == 4]
        assert len(twins) == 3 and all({k: v for k, v in t.items() if k not in CLASH} == {k: v for k, v in twins[0].items() if k not in CLASH} for t in twins)


def test_empty_tables(odd, labels, bench, spark):
    none, no_labels, no_bench = odd.where("false"), labels.where("false"), bench.where("false")
    no_ratings = no_labels.select("doc_id", F.lit(0).alias("grade"))
    for made in (
        toxicity.score(none, toxicity.train(none, no_labels)), toxicity.drop_toxic(none, labels), quality.rate(none, quality.train(none, no_ratings)), langid.predict(none, langid.train(none)),
        ngram_join.jaccard_components(none), ngram_join.keep_one(none), rules.evaluate(none), decontam.contamination(none, bench), decontam.contamination(none, no_bench), linededup.drop_recurring(none), pieces.encode(none),
    ):
        assert made.count() == 0
    html = spark.createDataFrame([], "page_id bigint, url string, html string, host string, walk string")
    assert pages.main_texts(html).count() == 0


def test_pipeline_of_odd_and_empty_documents(spark, odd, labels, bench, tmp_path):
    for name, rows in (("odd", odd), ("empty", odd.where("false"))):
        rows.select(*BASE).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.where("toxic = 0").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert all(r["round_trip"] for r in got) and {r["doc_id"] for r in got} >= {0, 1, 2, 7, 9}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


# plain versions


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(1)
    p = toxicity.FtrlParams(bits=6, l1=0.5, epochs=3)
    rows = [np.unique(rng.integers(0, 64, 8)) for _ in range(40)]
    y = rng.integers(0, 2, 40)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == 64 else p.l1
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(40):
            at = [*rows[k].tolist(), 64]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[k]
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * w[i]
                n[i] += g * g
    model = toxicity.fit_ftrl(rows, y, p)
    assert abs(model.intercept - weight(64)) < 1e-9
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)


def test_skip_grams_are_words_and_pairs():
    grams = NGrams(30, (1, 2))
    at = {t: set(grams(t).tolist()) for t in ("a b c", "a b", "b c", "a", "b", "c", "a x c")}
    assert len(at["a b c"]) == 6 and at["a b"] | at["b c"] <= at["a b c"]
    assert len(at["a b c"] & at["a x c"]) == 3  # a, c and the pair over one word


def test_ordinal_fit_has_no_slope_left():
    rng = np.random.default_rng(2)
    p = quality.OrdinalParams(bits=3, epochs=400, l2=0.0, rate=0.1)
    rows = [(np.array([0, 1]), rng.standard_normal(2).astype(np.float32)) for _ in range(300)]
    s = np.array([x @ [1.5, -1.0] for _, x in rows]) + rng.logistic(size=300)
    y = (s > -0.5).astype(int) + (s > 1.0)
    m = quality.fit_ordinal(rows, y, p)

    def loss(w, theta):
        v = np.array([x @ w for _, x in rows])
        cut = np.r_[-np.inf, theta, np.inf]
        sig = lambda u: 1 / (1 + np.exp(-u))
        return -np.log(sig(cut[y + 1] - v) - sig(cut[y] - v)).mean()

    at = np.r_[m.weight[:2].astype(float), m.thresholds]
    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        slope = (loss(*np.split(at + step, [2])) - loss(*np.split(at - step, [2]))) / 2e-4
        assert abs(slope) < 0.05


def test_language_scores_equal_a_plain_version():
    counts = [("de", "haus", 3), ("de", "und", 5), ("en", "house", 4), ("en", "and", 6), ("en", "haus", 1)]
    docs = {"de": 4, "en": 6}
    p = langid.LangParams(max_gram=3)
    model = langid.build([a for a, _, _ in counts], [b for _, b, _ in counts], np.array([n for *_, n in counts]), docs, p)
    words, grams = collections.defaultdict(lambda: [0, 0]), [collections.defaultdict(lambda: [0.0, 0.0]) for _ in range(4)]
    for lang, w, n in counts:
        words[w]["de en".split().index(lang)] += n
    for w, n in words.items():
        for k in (1, 2, 3):
            for i in range(len(w) + 3 - k):
                for j in (0, 1):
                    grams[k][f"<{w}>"[i : i + k]][j] += math.log1p(n[j])

    def logs(table, key):
        v = [math.log((table[key][j] + 0.5) / (sum(x[j] for x in table.values()) + 0.5 * len(table))) for j in (0, 1)]
        return [x - max(v) for x in v]

    def score(text):
        s = [math.log(0.4), math.log(0.6)]
        for w in text.split():
            if w in words:
                got = logs(words, w)
            else:
                for k in (3, 2, 1):
                    found = [logs(grams[k], g) for i in range(len(w) + 3 - k) if (g := f"<{w}>"[i : i + k]) in grams[k]]
                    if found:
                        got = [p.backoff_weight * sum(x[j] for x in found) / len(found) for j in (0, 1)]
                        break
                else:
                    got = [0, 0]
            s = [a + b for a, b in zip(s, got, strict=True)]
        return 1 / (1 + math.exp(s[0] - s[1]))

    one = model.predictor()
    for text in ("haus und", "the house", "hausen", "zz", "und and", "xyhaus"):
        lang, got = one(text)
        en = score(text)
        assert lang == ("en" if en > 0.5 else "de") and got == pytest.approx(max(en, 1 - en), abs=1e-4)


def test_rare_languages_are_learned(spark):
    rows = [(k, "the house is near the river", "en") for k in range(300)] + [(1000 + k, "kuća je blizu rijeke", "hr") for k in range(4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(d, langid.LangParams(max_rows=20))
    assert model.langs == ["en", "hr"] and model.predictor()("kuća je blizu rijeke")[0] == "hr"


def tree_brute(texts, similar=0.6):
    """Lines that a plain template tree finds to recur: leaves by token count and two leading tokens, in which a line
    joins the first template with at least `similar` equal positions."""
    leaves, own = collections.defaultdict(list), []
    for k, text in enumerate(texts):
        for j, line in enumerate(text.split("\n")):
            tokens = ["*" if any(c.isdigit() for c in t) else t for t in line.split()]
            for template in leaves[len(tokens), *tokens[:2]]:
                if sum(a == b for a, b in zip(template["t"], tokens, strict=True)) >= similar * len(tokens):
                    template["t"] = [a if a == b else "*" for a, b in zip(template["t"], tokens, strict=True)]
                    break
            else:
                template = {"t": tokens, "texts": set()}
                leaves[len(tokens), *tokens[:2]].append(template)
            template["texts"].add(k)
            own.append((k, j, template))
    return {(k, j) for k, j, t in own if len(t["texts"]) >= 3 and min(t["texts"]) != k}


def test_line_dedup_recalls_a_plain_tree(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijkl"), 7)) for _ in range(2000)]
    shapes = [list(rng.choice(words, n)) for n in rng.integers(6, 30, 40)]
    texts = []
    for k in range(60):
        lines = []
        for s in rng.choice(len(shapes), 6, replace=False):
            line = list(shapes[s])
            for at in rng.choice(np.arange(2, len(line)), rng.integers(0, 3), replace=False):
                line[at] = str(rng.choice(words)) if rng.random() < 0.7 else str(rng.integers(1000))
            lines.append(" ".join(line))
        lines += [" ".join(rng.choice(words, rng.integers(6, 40))) for _ in range(6)]
        texts.append("\n".join(lines))
    want = tree_brute(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    gone = set()
    for r in linededup.drop_recurring(d).collect():
        kept = collections.Counter(r["text"].split("\n"))
        for j, line in enumerate(texts[r["doc_id"]].split("\n")):
            if kept[line]:
                kept[line] -= 1
            else:
                gone.add((r["doc_id"], j))
    assert len(want) > 100
    assert len(gone & want) / len(want) >= 0.9
    assert not {(k, j) for k, j in gone if j >= 6}  # lines of their own stay


def test_stages_against_plain_versions(spark, small):
    """Decontamination and encoding of the pipeline, from the documents as they are."""
    d = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    split = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() or "a" <= c <= "z" or c > "\x7f" else " " for c in t or "").split(" ") if w]
    grams = set()
    for r in items:
        w = split(r["text"])
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    widths = {len(g) for g in grams}
    want = set()
    for r in d.collect():
        w = split(r["text"])
        if not any(tuple(w[i : i + n]) in grams for n in widths for i in range(len(w) - n + 1)):
            want.add(r["doc_id"])
    stages = dict(corpus_pipeline.STAGES)
    assert {r["doc_id"] for r in stages["benchmark decontamination"](spark, d, small).collect()} == want
    back = pieces.decode(stages["SentencePiece encoding"](spark, d, small))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in d.collect()}


# html


def site(article, extra, tag="div"):
    """A page of nameless elements: menu, notice, the article, a list of links in it, comments, footer."""
    menu = "".join(f"<{tag}><a href='/{k}'>Section {k}</a></{tag}>" for k in range(5))
    body = "".join(f"<p>{x}</p>" for x in article)
    links = "".join(f"<{tag}><a href='/s{extra}{k}'>More {extra} {k}</a></{tag}>" for k in range(3))
    return f"<html><body><{tag}>{menu}</{tag}><{tag}><{tag}>We use cookies.</{tag}><{tag}>Fine</{tag}></{tag}><{tag}><{tag}>Title {extra}</{tag}>{body}<{tag}>{links}</{tag}></{tag}><{tag}>Copyright {extra}</{tag}></body></html>"


def test_the_template_finds_the_article_without_names(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    arts = [[" ".join(rng.choice(words, 30)) + "." for _ in range(rng.integers(2, 6))] for _ in range(12)]
    rows = [(k, f"http://a.example/{k}", site(a, k)) for k, a in enumerate(arts)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.main_texts(df).collect()}
    assert got == {k: " ".join([f"Title {k}", *a]) for k, a in enumerate(arts)}
    alone = pages.extract(rows[0][2])
    assert "Section 1" in alone and "Copyright" in alone  # without the template all of it stays
    host = df.select(F.lit("a").alias("host"), "html")
    assert len(pages.templates(host).first()["walk"]) > 2


def naive_classes(htmls, least=2):
    """Elements of equal occurrence vectors, counted page by page."""
    where = collections.defaultdict(set)
    for k, h in enumerate(htmls):
        for token, element, *_ in pages._counts(h, 100):
            where[token, element].add(k)
    out = collections.defaultdict(set)
    for (token, element), at in where.items():
        if len(at) >= least and 2 * len(at) >= len(htmls):
            out[frozenset(at)].add((token, element))
    return {frozenset(v) for v in out.values()}


def test_classes_equal_a_plain_grouping(spark):
    htmls = [f"<div><ul><li>a</li><li>b</li></ul>{'<div><p>x</p><p>y</p></div>' if k % 3 else ''}<p>Story {k}</p><p>same</p></div>" for k in range(9)]
    df = spark.createDataFrame([("h", h) for h in htmls], "host string, html string")
    rows = pages._page_counts(df, 100).groupBy("token", "element").agg(F.sum("pages").alias("n"), F.sum("vec").alias("v")).where("n >= 4 AND 2 * n >= 9").collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r["n"], r["v"] % (1 << 53)].add((r["token"], r["element"]))
    assert {frozenset(v) for v in got.values()} == {c for c in naive_classes(htmls, 4)}


def test_deep_and_broken_pages_take_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        for page in ("<div>" * n + "</b>" * n, "<b>" * n + "<p>x" * n, "<ul><li>" * n + "</ul>" * n):
            pages.extract(page)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * took(10_000)
