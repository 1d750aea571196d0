"""Edge cases, brute force, round trips and held-out accuracy of the training-data operators."""

import collections
import html
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontam, langid, linededup, ngram_join, pieces, quality, rules, sharding, toxicity
from corvane.llm import html as pages
from corvane.llm.queries import ORACLES, QUERIES

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, key string, h bigint"


def docs(spark, texts, ids=None):
    """documents with columns whose names the operators use inside."""
    data = [(i, t, "en", "s", len(t or ""), 7, "k", 9) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(data, DOC)


ODD = [None, "", " \n\t ", "word", "word", "a b", "é" * 50, "x " * 30_000, "one two three four five six\n" * 40]


# native rules


def repeat_brute(words, width=8):
    seen = collections.Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return len({p for i in range(len(words) - width + 1) if seen[tuple(words[i : i + width])] > 1 for p in range(i, i + width)})


def test_rules_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ODD + [" ".join(rng.choice(list("abc"), n)) for n in (5, 8, 9, 20, 60)]
    got = rules.evaluate(docs(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_repeat_words"] == repeat_brute(words)
        assert not r["kept"] or not r["base_failed"]
    assert rules.evaluate(docs(spark, [])).count() == 0


def test_rules_keep_prose_and_reject_junk(spark):
    prose = "The committee met on Tuesday to discuss the new budget. Nobody objected to the plan, which passed.\n" + " ".join(f"word{i}" for i in range(40)) + "."
    table = "\n".join(f"alpha{i} | beta{i} | gamma{i} | delta{i}" for i in range(20))
    loud = " ".join(f"WORD{i}!!" for i in range(60))
    assert [r["kept"] for r in rules.evaluate(docs(spark, [prose, table, loud, prose + "\nAll rights reserved."])).orderBy("doc_id").collect()] == [True, False, False, True]


# decontamination


def test_decontamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, "Short One"), (3, None), (4, "..."), (5, item)], "item_id bigint, text string")
    texts = ["A " + item.upper() + " b", "x short, ONE y short one", "w0 w1 w2 w3 w4 w5 w6 w7 w8", None, "", "É short one", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"]
    got = {r["doc_id"]: r for r in decontam.contamination(docs(spark, texts), bench).collect()}
    assert [got[i]["n_hit"] for i in range(7)] == [12, 4, 0, 0, 0, 2, 10]
    assert got[0]["items"] == ["1", "5"] and got[1]["items"] == ["2"] and got[6]["items"] == ["1", "5"]
    shuffled = decontam.contamination(docs(spark, texts), bench, max_broadcast_mb=0)
    assert {(r["doc_id"], r["n_hit"]) for r in shuffled.collect()} == {(i, r["n_hit"]) for i, r in got.items()}
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs(spark, texts), bench).collect()} == {2, 3, 4}
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(docs(spark, texts), none).where("contaminated").count() == 0
    twice = decontam.contamination(docs(spark, [item, item], [5, 5]), bench).collect()
    assert [(r["doc_id"], r["n_hit"]) for r in twice] == [(5, 12), (5, 12)]


def test_decontamination_by_items_without_an_id(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, item), (None, "only here"), (4, item + " w12")], "item_id bigint, text string")
    texts = [item, "it is only here", "clean"]
    for most in (256, 0):
        got = decontam.contamination(docs(spark, texts), bench, max_broadcast_mb=most).orderBy("doc_id").collect()
        assert [(r["n_hit"], r["items"], r["contaminated"]) for r in got] == [(12, ["4"], True), (2, [], True), (0, [], False)]
        assert [r["doc_id"] for r in decontam.drop_contaminated(docs(spark, texts), bench, max_broadcast_mb=most).collect()] == [2]


# n-gram join


def jaccard_brute(texts):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(2):
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    low = min(root[i], root[j])
                    old = {root[i], root[j]}
                    root = [low if r in old else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def near_copies(rng, n=30):
    words = [f"v{i}" for i in range(400)]
    out = []
    for _ in range(n // 3):
        base = list(rng.choice(words, rng.integers(3, 120)))
        out.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = "edit"
            out.append(" ".join(copy))
    return out


def test_jaccard_brute_force(spark):
    rng = np.random.default_rng(2)
    chain = [" ".join(f"c{i}" for i in range(k, k + 100)) for k in range(0, 60, 6)]  # linked only step by step
    passage = " ".join(f"p{i}" for i in range(60))
    hot = [passage + " " + " ".join(f"u{k}_{i}" for i in range(k)) for k in range(0, 40, 2)]
    texts = ODD + near_copies(rng, 60) + chain + hot + ["A  B\tC d E f", "a b c D e F"]
    got = ngram_join.jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == jaccard_brute(texts)
    small = ngram_join.JaccardParams(chunk=50, block=100)
    again = ngram_join.jaccard_components(docs(spark, texts), small).orderBy("doc_id").collect()
    assert got == again


def test_jaccard_empty_and_keep_one(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    kept = ngram_join.keep_one(docs(spark, ["a b c d e f", "A b c d e f", None, "", "q"]))
    assert kept.columns == docs(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {0, 2, 3, 4}


# toxicity, quality, language


def accuracy(rows, want):
    return np.mean([got == want[i] for i, got in rows])


def test_toxicity_learns_and_is_held_out(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    label = rng.integers(0, 2, 600)
    texts = [" ".join([*rng.choice(words, 30), *(["awful", "slur"] if y else [])]) for y in label]
    labels = spark.createDataFrame([(i, None, int(y)) for i, y in enumerate(label)] + [(9999, 1, 7)], "doc_id bigint, quality int, toxic int")
    d = docs(spark, texts)
    got = toxicity.score(d, toxicity.train(d, labels)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert accuracy([(r["doc_id"], r["predicted"]) for r in got if r["held_out"]], label) > 0.97
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and abs(kept.count() - (label == 0).sum()) < 12


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    d = docs(spark, ODD)
    got = toxicity.score(d, toxicity.train(d, none)).collect()
    assert len(got) == len(ODD) and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs(spark, []), toxicity.ToxicModel(toxicity.FtrlParams())).count() == 0


def test_ordinal_order_and_edges(spark):
    rng = np.random.default_rng(4)
    grade = rng.integers(0, 3, 400)
    texts = [" ".join(rng.choice([["bad"], ["fair"], ["fine"]][g] + [f"w{i}" for i in range(4)], 25)) for g in grade]
    d = docs(spark, texts)
    rated = spark.createDataFrame([(i, int(g)) for i, g in enumerate(grade)], "doc_id bigint, grade int")
    model = quality.train(d, rated)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = quality.rate(d, model).collect()
    mean = [np.mean([r["expected_grade"] for r in got if r["held_out"] and grade[r["doc_id"]] == g]) for g in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.5 < mean[2]
    assert all(0 <= r["tail_prob"] <= 1 and r["kept"] == (r["tail_prob"] >= 0.5) for r in got)
    untrained = quality.train(d, spark.createDataFrame([], "doc_id bigint, grade int"))
    assert {r["expected_grade"] for r in quality.rate(docs(spark, ODD), untrained).collect()} == {0.0}


def test_language_edges_and_backoff(spark):
    data = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden near the river", "en"), ("das haus und der garten nahe dem fluss", "de")] * 60)]
    d = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    model = langid.train(d)
    new = docs(spark, [None, "", "123 !!", "the gardener", "dem gartenhaus", "日本語", "THE River"])
    got = [r["lang_pred"] for r in langid.predict(new, model).orderBy("doc_id").collect()]
    assert got[:5] == ["und", "und", "und", "en", "de"] and got[5] in ("en", "de") and got[6] == "en"
    empty = langid.train(d.where("false"))
    assert {r["lang_pred"] for r in langid.predict(new, empty).collect()} == {"und"}


def test_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_language_id"](spark, sf).where("held_out").collect()
    assert accuracy([(r["doc_id"], r["lang_pred"]) for r in got], lang) > 0.98


# line dedup


def test_line_dedup(spark):
    line = "this is a shared boilerplate line of many words"
    vary = "order {} was shipped to the customer named {} on a sunny day in the spring"
    texts = [f"own line number one of text {k}\n{line}\n{vary.format(1000 + k, 'xyz'[k % 3])}\nOf." for k in range(4)]
    texts += ["copy of the very same document here"] * 5 + ODD
    for most in (linededup.TreeParams().max_broadcast, 0):
        got = linededup.drop_recurring(docs(spark, texts), linededup.TreeParams(max_broadcast=most)).orderBy("doc_id").collect()
        clean = [r["text"] for r in got]
        assert clean[0] == texts[0]
        assert all(c.split("\n")[-1] == "Of." and line not in c and "shipped" not in c for c in clean[1:4])
        assert clean[4:] == texts[4:]
    assert linededup.drop_recurring(docs(spark, [])).count() == 0


def kept_lines(spark, texts):
    got = linededup.drop_recurring(docs(spark, texts)).orderBy("doc_id").collect()
    return [r["text"].split("\n") for r in got]


def test_line_dedup_of_short_lines(spark):
    gone, stay = ["All rights reserved.", "Released under the MIT License.", "Home", "Page {} of 99"], ["", "---", "{}", "7 8", "Total {}"]
    texts = ["\n".join(x.format(k) for x in [*gone, *stay]) for k in range(12)]
    got = kept_lines(spark, texts)
    assert got[0] == texts[0].split("\n")
    assert got[1:] == [[x.format(k) for x in stay] for k in range(1, 12)]
    few = [f"Home\nAll rights reserved.\nNumber {'abcde'[k]}" for k in range(4)]
    assert kept_lines(spark, few) == [t.split("\n") for t in few]


def test_line_dedup_of_two_texts(spark):
    passage = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    short = "only seven words in this short line"
    one, two, three = f"{passage}\n{short}\nfirst", f"second\n{passage}\n{short}", f"third\n{' '.join(passage.split()[:12])}"
    got = kept_lines(spark, [one, two, one, three, three + "\nmore"])
    assert got == [one.split("\n"), ["second", short], [short, "first"], three.split("\n"), ["third", "more"]]


def test_line_dedup_of_fields(spark):
    names, parts, days = ["Anna", "Boris", "Chen", "Dana"], ["Sports", "Travel", "Music", "Food"], ["Monday", "Tuesday", "Friday", "Sunday"]
    low = ["red", "green", "blue", "grey"]
    lines = ["Posted by {n} in {p} on {d}", "written by some {c} author on {d} evening", "the report of the {c} group was read to all members by {n} and then closed again for the year"]
    texts = ["\n".join([*lines, "12 {c} 7 {n} 3 9", "own {c}"]).format(n=n, p=p, d=d, c=c) for n, p, d, c in zip(names, parts, days, low, strict=True)]
    got = kept_lines(spark, texts)
    assert got[0] == texts[0].split("\n")
    assert got[1:] == [t.split("\n")[-2:] for t in texts[1:]]


def test_line_dedup_without_an_id(spark):
    line = "this is a shared boilerplate line of many words that all of the texts have"
    texts = [f"{line}\n{x}" for x in ("one", "two", "three", "four")]
    for most in (linededup.TreeParams().max_broadcast, 0):
        got = linededup.drop_recurring(docs(spark, texts, [1, 2, None, 3]), linededup.TreeParams(max_broadcast=most)).collect()
        assert {r["doc_id"]: r["text"] for r in got} == {1: texts[0], 2: "two", None: texts[2], 3: "four"}


# pieces


@pytest.fixture(scope="module")
def model_bytes():
    return open(pieces.DEFAULT_MODEL, "rb").read()


def test_pieces_equal_the_library(spark, model_bytes):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    rng = np.random.default_rng(5)
    alphabet = list("▁ abcdeghilnorst" * 2 + "éü.,\n\t😀中\u0000")
    texts = ["", " ", "  a  ", "Hello  world\n é ", "unbelievable unbelievably", "a" * 300, "日本語 text"] + ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 60, 400)]
    got = pieces.Codec(pieces.Model.load(model_bytes)).encode(texts)
    assert [g.tolist() for g in got] == sp.encode(texts)
    rows = pieces.encode(docs(spark, ODD + ["a▁b"])).orderBy("doc_id").collect()
    assert [r["round_trip"] for r in rows] == [True] * len(ODD) + [False]
    assert rows[0]["ids"] == [] and rows[1]["n_tokens"] == 0
    back = pieces.decode(pieces.encode(docs(spark, ODD))).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [t or "" for t in ODD]


def test_words_that_are_met_again_are_encoded_once(model_bytes, monkeypatch):
    model, seen = pieces.Model.load(model_bytes), collections.Counter()
    plain = pieces.PrefixEncoder.packed_sorted
    monkeypatch.setattr(pieces.PrefixEncoder, "packed_sorted", lambda self, words: seen.update(words) or plain(self, words))
    codec, sp = pieces.Codec(model, 40_000), sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    for k in range(30):
        text = "the common words " + " ".join(f"w{k}x{i}" for i in range(20))
        assert [x.tolist() for x in codec.encode([text])] == [sp.encode(text)]
        assert len(codec.words) + len(codec.old) < 160
    assert seen["▁common"] == 1 and len(seen) == 603


def test_unigram_viterbi_is_optimal():
    words = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "▁a": -4.0, "ba": -3.0, "aba": -6.1, "▁ab": -7.0}
    model = pieces.Model(pieces.UNIGRAM, True, {w: (i, s) for i, (w, s) in enumerate(words.items())}, [], None, 99)

    def best(t):
        if not t:
            return 0.0
        return max(words[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in words)

    enc = pieces.PrefixEncoder(model)
    tests = sorted({"▁" + "".join(x) for x in ("ab", "aba", "abab", "baab", "bbb", "aabba", "")})
    names = list(words)
    for w, ids in enc.encode_sorted(tests).items():
        assert "".join(names[i] for i in ids) == w and abs(sum(words[names[i]] for i in ids) - best(w)) < 1e-9


# html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy &amp; now</div><article><h1>Head &lt;1&gt;</h1><p><b>Bold.<br><p>In<i>li</i>ne  text &amp;amp; more.</p><form>f</form></article>
<section id="comments"><article class="comment">Nice!</article></section><aside>Side</aside><footer>&copy; host</footer>"""


def test_extract():
    assert pages.extract(PAGE) == "Head <1> Bold. Inline text &amp; more."
    assert pages.extract(None) == pages.extract("") == ""
    assert pages.extract("<p>a<p>b<div class='cookie-notice'>c</div>d") == "a b d"
    assert pages.extract("plain & <b>text") == "plain & text"


def test_template_text_goes(spark):
    bodies = [f"<html><body><div><p>Story {k} about {k * k}.</p></div><div><h4>Read our best stories here</h4></div></body></html>" for k in range(40)]
    rows = [(k, f"http://h.example/{k}", b) for k, b in enumerate(bodies)] + [(90, "http://h.example/e", None), (91, None, "<p>x"), (92, "http://one.example/", bodies[0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (pages.TemplateParams().max_broadcast, 0):
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.main_texts(df, pages.TemplateParams(max_broadcast=most)).collect()}
        assert all(got[k][0] == f"Story {k} about {k * k}." for k in range(40))
        assert got[90] == ("", 0) and got[91] == ("x", 1) and got[92][0].endswith("stories here")


def test_pages_table(spark, small):
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op1_html_extraction"](spark, small).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", raw[r["page_id"]], re.S)[1]
        inner = re.sub(r"</?b>", "", inner)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


# sharding


def test_plan_merges_similar_sizes():
    t = sharding.Tiering(target_bytes=1000, fanout=4)
    shards = [sharding.Shard(f"s{i}", 1, 10) for i in range(4)] + [sharding.Shard(f"m{i}", 1, 300) for i in range(3)] + [sharding.Shard("big", 1, 990)]
    assert [(sorted(s.path for s in g), n) for g, n in sharding.plan(shards, t)] == [(["s0", "s1", "s2", "s3"], 1)]
    assert sharding.plan([], t) == []


def test_store_versions_conflicts_and_vacuum(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    for k in range(5):
        store.append(docs(spark, [f"text {k}", None], [k, None]).coalesce(1))
    store.append(docs(spark, []))
    version, shards = store.manifest()
    assert version == 6 and len(shards) == 5
    old = store.read(version).drop("shard").collect()
    with pytest.raises(sharding.Conflict):
        store._publish(version, [])
    new = store.compact(sharding.Tiering(target_bytes=1 << 30, fanout=4))
    assert len(store.manifest()[1]) == 1 and new == version + 1
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(store.read().drop("shard").collect(), key=key) == sorted(old, key=key)
    assert store.read(version).count() == 10
    with pytest.raises(sharding.Conflict):
        store.commit([], shards[:1])
    assert store.vacuum() == 5 and store.versions() == [new]
    store._write(docs(spark, ["lost"]), "new")
    assert store.vacuum() == 0 and store.vacuum(orphan_hours=0) >= 1 and store.read().count() == 10


def test_sharding_query_keeps_all(spark, small):
    got = QUERIES["op5_sharding"](spark, small)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").collect())


# pipeline


def test_pipeline(spark, small):
    source = spark.read.parquet(f"{small}/documents.parquet")
    d, texts = source, {r["doc_id"]: r["text"] for r in source.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in d.collect()}
        d = spark.createDataFrame(stage(spark, d, small).collect(), source.schema)
        after = {r["doc_id"]: r["text"] for r in d.collect()}
        assert d.columns == source.columns and after.keys() <= before.keys()
        if name == "line dedup":
            assert after.keys() == before.keys()
        else:
            assert all(after[k] == before[k] for k in after)
        if name.startswith("n-gram"):
            ids = sorted(before)
            roots = jaccard_brute([before[i] for i in ids])
            assert after.keys() == {i for k, i in enumerate(ids) if roots[k][1] == k}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert got.keys() == after.keys() and all(r["round_trip"] for r in got.values())
    assert set(texts) > set(got)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_live_counts_are_exact_and_travel_packed(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(5, 40))) for _ in range(150)]
    p = ngram_join.JaccardParams(chunk=50, block=100)
    live = ngram_join.live_counts(docs(spark, texts).repartition(3), p, 3000)
    assert "HashAggregate" not in live._jdf.queryExecution().toString()
    sets = {}
    for t in texts:
        grams = ngram_join.GramSets(5)(t)
        sets[ngram_join._digest(grams)] = set(grams.tolist())
    want = {k: sum(any(g in other for j, other in sets.items() if j != k) for g in s) for k, s in sets.items()}
    assert {r["cls"]: r["live"] for r in live.collect() if r["live"]} == {k: n for k, n in want.items() if n}
