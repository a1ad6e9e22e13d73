"""Document operators: contracts, edge cases and brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.llm import language_id, lm_scoring, mixing, ngram_join, pieces, quality_model, quality_rules, registry, sharding, substring_dedup

LONG = "lorem ipsum dolor " * 40_000
WORDS = [f"w{i}" for i in range(200)]
PROSE = " ".join(WORDS)
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE.replace("w100", "x100"), "en", "b"),
    (4, "", "de", "b"),
    (5, None, "de", None),
    (None, "alpha beta gamma", None, "c"),
    (6, LONG, "en", "c"),
    (7, "one", None, "a"),
    (7, "one", None, "a"),
    (8, "\n \t\n", "fr", "a"),
    (9, "Mixed CASE words here and there", "fr", "d"),
    (10, "mixed case WORDS here and there", "fr", "d"),
    (11, "ünïcödé ▁ mark 中文 🙂 \n tabs\tand  spaces ", "es", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(name, same_rows):
    same_rows(registry.QUERIES[name], registry.SQL[name])


# mixing


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert sum({k: v[0]["target"] for k, v in by.items()}.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert sum(r["size"] for r in v) == v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9


def test_mix_reruns_agree_and_materialises(docs):
    one, two = (sorted(map(tuple, mixing.mix(d).collect()), key=repr) for d in (docs, docs.repartition(5)))
    assert one == two
    taken = mixing.mix(docs)
    out = mixing.materialise(docs, taken)
    assert out.columns == docs.columns
    unique = {r["doc_id"]: r["taken"] for r in taken.collect() if r["doc_id"] != 7}
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
    assert {k: v for k, v in got.items() if k != 7} == {k: v for k, v in unique.items() if v}


CLASHES = ["words", "taken_words", "taken_id", "taken_part", "span_cuts", "span_id", "own_host", "own_text", "bucket", "scatter", "place", "row", "id", "size", "found", "__key", "__cuts"]


def clashing(docs):
    return docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


def kept_clashes(rows):
    return all(r[c] == f"clash {c}" for r in rows for c in CLASHES)


def test_names_of_other_columns_dont_matter(docs):
    wide = clashing(docs)
    plain = sorted(map(tuple, mixing.materialise(docs, mixing.mix(docs)).collect()), key=repr)
    mixed = mixing.materialise(wide, mixing.mix(wide))
    rows = mixed.collect()
    assert mixed.columns == wide.columns and kept_clashes(rows)
    assert sorted((tuple(r[c] for c in docs.columns) for r in rows), key=repr) == plain
    ruled = quality_rules.quality_rules(wide).collect()
    assert kept_clashes(ruled) and len(ruled) == len(ROWS)
    cut = substring_dedup.remove_spans(wide, substring_dedup.duplicate_spans(wide))
    assert cut.columns == wide.columns and kept_clashes(cut.collect())
    sharded = sharding.shuffle_into_shards(wide, 3)
    assert kept_clashes(sharded.collect()) and sharded.columns == [*wide.columns, "shard", "slot"]
    pieced = pieces.with_pieces(wide.withColumn("decoded", F.lit(1))).collect()
    assert kept_clashes(pieced) and all(r["decoded"] == (r["text"] or "") for r in pieced)


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0


def test_water_fill_clamps_in_turn(spark):
    s = spark.createDataFrame([("a", 10, 8.0), ("b", 100, 1.0), ("c", 100, 1.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(s, F.lit(100.0), 2.0).collect()}
    assert got == {"a": 20.0, "b": 40.0, "c": 40.0}


# sharding


def test_shards_are_level_and_gapless(docs, tmp_path):
    out = sharding.shuffle_into_shards(docs.withColumn("shard", F.lit("clash")).withColumn("bucket", F.lit(1)), 4)
    rows = out.collect()
    assert len(rows) == len(ROWS) and "bucket" in out.columns
    by = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(4)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    sharding.write_shards(out.drop("bucket"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("shard=*")) == [f"shard={k}" for k in range(4)]


def test_shards_of_nothing_and_more_shards_than_rows(none, docs):
    assert sharding.shuffle_into_shards(none, 4).count() == 0
    assert {r["slot"] for r in sharding.shuffle_into_shards(docs, 50).collect()} == {0}


def test_shuffle_is_seeded(docs):
    place = lambda df, seed: sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df, 4, seed=seed).collect() if r["doc_id"] != 7)
    assert place(docs, 1) == place(docs.repartition(2), 1) != place(docs, 2)


def brute_shards(rows, n_shards, seed, n_buckets, hashes):
    """Places by plain lists: scatter into buckets, canonical order, Fisher-Yates, one sequence cut into shards."""
    buckets = [[] for _ in range(n_buckets)]
    for key, h in zip(rows, hashes, strict=True):
        buckets[h % n_buckets].append((h, key))
    sequence = []
    for k, bucket in enumerate(buckets):
        bucket.sort()
        order = np.arange(len(bucket))
        np.random.default_rng([seed, k]).shuffle(order)
        shuffled = [None] * len(bucket)
        for place, (_, key) in zip(order, bucket, strict=True):
            shuffled[place] = key
        sequence += shuffled
    n = len(sequence)
    shard = [i * n_shards // n for i in range(n)]
    return {key: (s, i - shard.index(s)) for i, (key, s) in enumerate(zip(sequence, shard, strict=True))}


def test_shards_equal_brute_force_in_any_session(spark):
    d = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id % 77) AS text")
    hashed = [(r["doc_id"], r["h"]) for r in d.select("doc_id", F.xxhash64(F.lit(3), "doc_id", F.xxhash64("text")).alias("h")).collect()]
    want = brute_shards([k for k, _ in hashed], 7, 3, 10, [h for _, h in hashed])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            out = sharding.shuffle_into_shards(d.repartition(int(width)), 7, seed=3, bucket_rows=50).collect()
            assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_rows_spread_over_buckets_and_shards(spark):
    """Half of the rows are one row; equal brute force over the numbered copies, in any session."""
    rows = [(k, f"text {k}") for k in range(600)] + [(None, "x")] * 600
    d = spark.createDataFrame(rows, "doc_id long, text string")
    base = [r["h"] for r in d.select(F.xxhash64(F.lit(3), "doc_id", F.xxhash64("text")).alias("h")).collect()]
    copies = [r["h"] for r in spark.range(1, 600).select(F.xxhash64(F.lit(base[-1]), F.col("id")).alias("h")).collect()]
    hashes = base[:601] + copies
    want = brute_shards(list(range(1200)), 4, 3, 12, hashes)
    want = Counter((k if k < 600 else None, *v) for k, v in want.items())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            out = sharding.shuffle_into_shards(d.repartition(int(width)), 4, seed=3, bucket_rows=100).collect()
            assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in out) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = Counter(h % 12 for h in hashes)
    assert max(sizes.values()) <= 2 * 100
    in_shard = Counter(r["shard"] for r in out if r["doc_id"] is None)
    assert min(in_shard[k] for k in range(4)) > 100


# quality rules


def brute_rules(t):
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    again = {g for g, k in times.items() if k > 1}
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counters(docs):
    for r in quality_rules.quality_rules(docs).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute_rules(r["text"]), r["doc_id"]
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def test_boilerplate_lines(spark):
    own = lambda i: " ".join("w" + "abcdefghij"[i % 10] * (i // 10 + 1) + "klmnopqrst"[j % 10] * (j // 10 + 1) for j in range(60))
    rows = [(i, f"all rights reserved {i}\n" + own(i), "h") for i in range(30)]
    rows += [(100 + i, ("all rights reserved 7\n" * 60) + f"tail {i}z", "h") for i in range(2)]
    rows += [(200, rows[0][1], "h"), (201, "all rights reserved 1\n" + own(77), None)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[3]["kept"] and out[3]["removed_words"] == 4
    assert not out[100]["kept"] and out[100]["removed_words"] == 240
    assert out[201]["removed_words"] == 0 and out[201]["kept"]


def test_boilerplate_verdict_holds_as_the_host_grows(spark):
    fresh = lambda i: " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}{'efghijklmn'[j % 10]}{'opqrstuvwx'[j // 10]}" for j in range(60))
    rows = [(i, ("one footer here\n" if i < 21 else "rare line\n" if i < 41 else "") + fresh(i), "h") for i in range(1000)]
    for n in (100, 1000):
        out = quality_rules.quality_rules(spark.createDataFrame(rows[:n], "doc_id long, text string, source string"))
        assert {r["doc_id"] for r in out.filter("removed_words = 3").collect()} == set(range(21))
        assert out.filter("removed_words > 0").count() == 21


def test_boilerplate_lines_are_counted_by_documents(spark):
    """Copies of a text count, repeated rows and texts of one id don't; a row without an id is a document."""
    fresh = lambda i: " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'efghijklmn'[j % 10]}{'opqrstuvwx'[j // 10]}" for j in range(60))
    rows = [(i, "copied footer here\n" + fresh(0), "copies") for i in range(15)] + [(20 + i, "copied footer here\n" + fresh(1 + i), "copies") for i in range(6)]
    rows += [(100, "a row again\n" + fresh(10), "repeats")] * 30 + [(101 + i, "a row again\n" + fresh(11 + i), "repeats") for i in range(19)]
    rows += [(200, f"versions of one\n{fresh(30 + i)}", "versions") for i in range(30)]
    rows += [(None, "no id at all\n" + fresh(70), "unnamed")] * 11 + [(300 + i, "no id at all\n" + fresh(71), None if i < 5 else "unnamed") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)

    def brute(numbered):
        holders = {}
        for n, (i, t, h) in enumerate(rows):
            for line in set(t.split("\n")):
                holders.setdefault((h, line), set()).add((i, None) if i is not None and numbered else (None, n))
        return Counter((i, t, h, sum(len(words(x)) for x in t.split("\n") if len(holders[h, x]) > 20)) for i, t, h in rows)

    found = lambda out: Counter((r["doc_id"], r["text"], r["source"], r["removed_words"]) for r in out.collect())
    got = found(quality_rules.quality_rules(docs))
    assert got == brute(True) and {(h, n) for _, _, h, n in got} == {("copies", 3), ("repeats", 0), ("versions", 0), ("unnamed", 4), (None, 0)}
    got = found(quality_rules.quality_rules(docs, id_col=None))
    assert got == brute(False) and {(h, n) for _, _, h, n in got} == {("copies", 3), ("repeats", 3), ("repeats", 63), ("versions", 3), ("unnamed", 4), (None, 0)}


def test_rules_on_nothing(none):
    assert quality_rules.quality_rules(none).count() == 0


# classifier


def test_trees_learn_and_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(quality_model.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    t = quality_model.fit_trees(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = quality_model.fit_trees(x[:10], np.ones(10))
    assert len(set(one.score(x).tolist())) == 1
    assert quality_model.fit_trees(np.empty((0, len(quality_model.STATISTICS))), np.empty(0)).score(x)[0] == pytest.approx(0.5)


def test_trees_walk_as_one_by_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality_model.STATISTICS)))
    t = quality_model.fit_trees(x, (x[:, 1] + x[:, 2] > 0).astype(float), trees=12)

    def walk(row):
        total = t.base
        for k in range(len(t.feature)):
            node = 0
            while node < len(t.feature[k]):
                node = 2 * node + 2 if row[t.feature[k][node]] > t.threshold[k][node] else 2 * node + 1
            total += t.leaf[k][node - len(t.feature[k])]
        return 1 / (1 + np.exp(-total))

    assert t.score(x) == pytest.approx([walk(r) for r in x])


def test_quality_query_is_its_model(spark, sf_dir):
    import pandas as pd

    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    model = quality_model.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = model.score(np.array([quality_model.statistics((t or "").encode()) for t in d["text"]]))
    got = quality_model.op5_quality_model(spark, sf_dir).toPandas().set_index("doc_id").loc[d["doc_id"]]
    assert got["score"].to_numpy() == pytest.approx(want) and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_repeated_ids_are_one_row_of_the_sample(spark):
    d = spark.createDataFrame([(i % 40, f"text {i % 40} " * (i % 7 + 1)) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality_model.with_quality(d, quality_model.fit(d, labels)).count() == 4000


def test_quality_held_out_accuracy(spark, sf_dir):
    import pandas as pd

    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = quality_model.op5_quality_model(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 1), (9, 0), (None, 1), (10, None)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    out = quality_model.with_quality(docs.withColumn("score", F.lit("clash")), model)
    assert out.count() == len(ROWS) and dict(out.dtypes)["score"] == "double"
    assert quality_model.with_quality(none, quality_model.fit(none, labels)).count() == 0


# languages


def test_language_held_out_accuracy(spark, sf_dir):
    import pandas as pd

    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = language_id.op4_language_id(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_forward_sums_all_segmentations():
    pieces_ = ("▁", "a", "b", "ab", "▁a", "▁ab", "ba")
    index = language_id.PieceIndex(pieces_)
    prob = np.random.default_rng(0).random((len(pieces_) + 1, 2))

    def brute(s, k):
        if not s:
            return 1.0
        total = 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in index.of:
                total += prob[index.of[s[:n]], k] * brute(s[n:], k)
            elif n == 1:
                total += prob[-1, k] * brute(s[1:], k)
        return total

    ws = ["ab", "abba", "bz", "a"]
    _, got = index.forward(ws, prob)
    for w, row in zip(ws, got, strict=True):
        assert row == pytest.approx([brute("▁" + w, 0), brute("▁" + w, 1)])
    expected = index.expected(ws, np.ones(4), prob[:, 0])
    # every word is covered once, whatever the segmentation
    sizes = np.array([len(p) for p in pieces_] + [1])
    assert (expected * sizes).sum() == pytest.approx(sum(len(w) + 1 for w in ws))


def test_letters_are_letters():
    assert language_id.words_of("½ ² ⅷ 12 _ ①") == [] and language_id.words_of("a½b ÄÖ x2y") == ["a", "b", "äö", "x", "y"]


def test_long_runs_sum_all_segmentations(spark):
    index = language_id.PieceIndex(("▁", "a", "b", "ab", "▁ab", "aba"))
    prob = np.random.default_rng(1).random((7, 3)) / 8
    w = ["ab" * 20 + "z", "a" * 33, "b"]
    _, p = index.forward(w, prob)
    assert [index.long_word(x, prob).tolist() for x in w] == [pytest.approx(np.log(r).tolist()) for r in p]
    far = index.long_word("ab" * 4000, prob)  # far below the least double
    assert np.isfinite(far).all() and far == pytest.approx(2 * index.long_word("ab" * 2000, prob), rel=1e-3)
    d = spark.createDataFrame([(1, "½ ² ⅷ"), (2, "lorem" * 3000), (3, "the text")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = {r["doc_id"]: r for r in language_id.with_language(d, language_id.fit(d, rounds=1)).collect()}
    assert out[1]["lang_pred"] == "und" and out[1]["score"] == 0 and out[2]["lang_pred"] == "en"


def test_language_query_is_its_model(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(d)
    index = language_id.PieceIndex(model.pieces)
    got = {r["doc_id"]: r for r in language_id.op4_language_id(spark, sf_dir).collect()}
    for r in d.collect()[:60]:
        words_ = Counter(language_id.words_of(r["text"]))
        if not words_:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        ll = np.log(model.prior) + sum(n * index.long_word(w, model.prob) for w, n in words_.items())
        post = np.exp(ll - ll.max())
        assert got[r["doc_id"]]["lang_pred"] == model.languages[int(post.argmax())] and got[r["doc_id"]]["score"] == pytest.approx(1 / post.sum())


def test_language_edges(spark, docs, none):
    model = language_id.fit(docs, sample_docs=50, rounds=1)
    out = {r["doc_id"]: r for r in language_id.with_language(docs.withColumn("score", F.lit("x")), model).collect()}
    assert out[4]["lang_pred"] == out[5]["lang_pred"] == out[8]["lang_pred"] == "und"
    assert out[1]["lang_pred"] in model.languages and len(out) == 12
    empty = language_id.fit(none)
    assert empty.languages == () and {r[0] for r in language_id.with_language(docs, empty).select("lang_pred").collect()} == {"und"}


# language model


def test_lm_scores(spark, docs, none):
    target = spark.createDataFrame([(9,), (10,), (10,), (None,)], "doc_id long")
    out = {r["doc_id"]: r for r in lm_scoring.corpus_scores(docs.withColumn("n_words", F.lit("x")).withColumn("deal", F.lit(1)), target).collect()}
    assert out[4]["ce_difference"] is None and out[5]["n_words"] == 0 and out[1]["n_words"] == 200
    assert out[9]["ce_difference"] < out[1]["ce_difference"] and out[None]["n_words"] == 3


def brute_lm(rows, target, prior=10.0):
    """Losses of both models by plain dictionaries over all words and bigrams."""
    from collections import Counter
    from math import log

    uni, two, ctx = ([Counter(), Counter()] for _ in range(3))
    seqs = [(i, (t or "").encode().lower().split()) for i, t in rows]
    for i, w in seqs:
        for k in (0, 1) if i in target else (0,):
            uni[k].update(w)
            two[k].update(zip([None, *w], w, strict=False))
            ctx[k].update([None, *w][: len(w)])
    n, v = [sum(u.values()) for u in uni], [len(u) for u in uni]
    base = lambda x: (uni[0][x] + 0.5) / (n[0] + 0.5 * v[0])
    near = lambda x: (uni[1][x] + v[1] * base(x)) / (n[1] + v[1]) if n[1] else base(x)
    loss = lambda w, k, p: -sum(log((two[k][a, b] + prior * p(b)) / (ctx[k][a] + prior)) for a, b in zip([None, *w], w, strict=False)) / len(w) if w else None
    return sorted(((i, len(w), loss(w, 1, near), loss(w, 0, base)) for i, w in seqs), key=repr)


@pytest.mark.parametrize("target", [[], [3, 5, 9, 9, None, 40]])
@pytest.mark.parametrize("block_bytes", [600, 1 << 20])
def test_lm_counts_every_word_and_bigram(spark, none, target, block_bytes):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.15, int(rng.integers(0, 200))), 3000))) for i in range(80)]
    rows += [(80, " ".join(f"own{i}" for i in range(3000))), (81, None), (82, " \n"), (None, "w1 W2 w1"), (3, rows[3][1]), (83, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = lm_scoring.corpus_scores(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"), block_bytes=block_bytes)
    got = sorted(((r["doc_id"], r["n_words"], r["target_loss"], r["background_loss"]) for r in out.collect()), key=repr)
    want = brute_lm(rows, {i for i in target if i is not None})
    key = lambda r: (repr(r[0]), r[1])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == (pytest.approx(w[2:], rel=1e-9) if w[1] else (None, None))
    assert lm_scoring.corpus_scores(none, docs.limit(0)).count() == 0


# n-gram join


def brute_groups(rows, width, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {i: grams(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, width, percent):
    rng = np.random.default_rng(width)
    rows = []
    passage = [f"p{j}" for j in range(40)]
    for base in range(25):
        n = int(rng.choice([4, 9, 15, 30, 60, 150]))
        text = [f"b{base}w{j}" for j in range(n)]
        for _ in range(8):
            t = list(text)
            for _ in range(int(rng.integers(0, 1 + max(1, n // 20)))):
                t[int(rng.integers(0, len(t)))] = f"e{int(rng.integers(0, 10**6))}"
            rows.append(" ".join(t))
    rows += [" ".join(passage + [f"z{i}a{j}" for j in range(int(rng.integers(1, 12)))]) for i in range(60)]
    data = [(1000 - i, t) for i, t in enumerate(rows)]
    got = ngram_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), width=width, percent=percent)
    want = brute_groups(data, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_parity_bitmaps_never_count_more_than_the_difference(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for n in (1, 3, 64, 65, 200, 700):
        for m in (n, n + 1, 2 * n):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate((x[: n // 2], rng.integers(0, 1 << 63, m - n // 2).astype(np.uint64))))
            rows.append((ngram_join.parity(x).tolist(), ngram_join.parity(y).tolist()))
            want.append(len(np.setxor1d(x, y)))
    got = spark.createDataFrame(rows, "x array<long>, y array<long>").coalesce(1).select(ngram_join._differing_bits("x", "y").alias("d"), ngram_join._differing_bits("y", "x").alias("e")).collect()
    for r, most in zip(got, want, strict=True):
        assert r["d"] == r["e"] <= most and (most - r["d"]) % 2 == 0 and r["d"] >= 0.2 * most


def test_join_over_common_passages_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    passages = [[f"p{k}x{j}" for j in range(90)] for k in range(3)]
    data = []
    for i in range(240):
        own = [f"o{i}y{j}" for j in range(int(rng.integers(1, 60)))]
        data.append((i, " ".join(passages[i % 3] + own)))
    data += [(1000 + i, " ".join(passages[0][:80] + passages[1] + [f"z{i // 2}"])) for i in range(30)]
    got = ngram_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), width=5, percent=80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_groups(data, 5, 80)


def test_join_edges(docs, none):
    out = ngram_join.jaccard_components(docs.withColumn("node", F.lit("clash")).withColumn("n", F.lit(1)))
    rows = {}
    for r in out.collect():
        rows.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert rows[1][0][1] == rows[2][0][1] == rows[3][0][1] == 1
    assert rows[4] == [(0, 4)] and rows[5] == [(0, 5)] and rows[8] == [(0, 8)]
    assert rows[7] == [(1, 7)] * 2 and rows[10][0][1] == 9 and rows[None][0][1] is None
    assert ngram_join.jaccard_components(none).count() == 0


# substring de-duplication


def test_chunks_resist_shifts():
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)).encode()
    chunks = lambda t: [t[a:b] for a, b in zip([0, *substring_dedup.chunk_ends(t)], substring_dedup.chunk_ends(t), strict=False)]
    assert b"".join(chunks(text)) == text and max(map(len, chunks(text))) <= 131
    moved = b"something new " + text[:900] + b" inserted " + text[900:]
    assert len(set(chunks(text)) & set(chunks(moved))) > 0.9 * len(set(chunks(text)))
    assert substring_dedup.chunk_ends(b"") == [] and substring_dedup.chunk_ends(b"ab") == [2]
    for e in substring_dedup.chunk_ends(("中文" * 300).encode()):
        ("中文" * 300).encode()[:e].decode()


def brute_spans(rows, min_bytes=120):
    """Spans by plain dictionaries over the same chunks."""
    chunks = {}
    for i, t in {(i, t) for i, t in rows if i is not None and t}:
        ends = substring_dedup.chunk_ends(t.encode())
        chunks[i, t] = [(a, b, t.encode()[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    holders = {}
    for (i, _), parts in chunks.items():
        for _, _, c in parts:
            holders.setdefault(c, set()).add(i)
    out = set()
    for (i, t), parts in chunks.items():
        seen, run = set(), []
        for a, b, c in [*parts, (-1, -1, b"")]:
            first = min(holders[c]) if c else i
            source = i if c in seen else first if first != i else None
            if source is None or not c or (run and run[-1][1] != a):
                if run and run[-1][1] - run[0][0] >= min_bytes:
                    out.add((i, t, run[0][0], run[-1][1], run[0][2]))
                run = []
            if source is not None and c:
                run.append((a, b, source))
            seen.add(c)
    return out


def test_spans_equal_brute_force(spark, sf_dir):
    import pandas as pd

    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    rows = list(zip(d["doc_id"].tolist(), d["text"].tolist(), strict=True)) + [(5, "ünï " * 90 + d["text"][9]), (5, d["text"][9]), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.duplicate_spans(docs)
    keys = {r["k"]: r["text"] for r in docs.select(substring_dedup.text_key("text").alias("k"), "text").collect()}
    assert {(r["doc_id"], keys[r["text_key"]], r["start_byte"], r["end_byte"], r["first_id"]) for r in spans.collect()} == brute_spans(rows)


def test_spans_cut_their_own_text_only(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    passage = fresh(80)
    rows = [(1, passage), (2, f"{fresh(50)} {passage}"), (2, "中文字" * 400), (2, "ab"), (3, f"{passage} {fresh(9)}"), (3, f"{passage} {fresh(9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_spans(docs, substring_dedup.duplicate_spans(docs)).collect()
    left = Counter((r["doc_id"], r["text"]) for r in out)
    assert left[1, passage] == 1 and left[2, "ab"] == 1 and len(out) == len(rows)
    assert not any(passage[100:400] in r["text"] for r in out if r["doc_id"] != 1)
    assert sum(r["text"].startswith("中文字") and len(r["text"]) <= 1200 for r in out) == 1


def test_repeated_passages_are_found_and_cut(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    passage = fresh(60)
    rows = [(i, f"{fresh(80)} {passage} {fresh(40)}") for i in range(20)] + [(100 + i, fresh(120)) for i in range(20)]
    rows += [(50, f"{passage} {passage}"), (None, passage), (51, None), (52, ""), (100, rows[20][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.duplicate_spans(docs)
    found = spans.collect()
    assert {r["doc_id"] for r in found} == {*range(1, 20), 50}
    assert all(r["first_id"] < r["doc_id"] or r["doc_id"] == 50 for r in found)
    assert all(r["end_byte"] - r["start_byte"] > 250 for r in found)
    cut = substring_dedup.remove_spans(docs, spans, mark="cut").collect()
    assert len(cut) == len(rows)
    for r in cut:
        if r["doc_id"] in range(1, 20):
            assert r["cut"] and len(r["text"]) < 180 * 7 - 250
        elif r["doc_id"] != 50:
            assert not r["cut"] and (r["doc_id"], r["text"]) in rows
    assert substring_dedup.duplicate_spans(docs.limit(0)).count() == 0


# pieces


def test_pieces_round_trip(docs, none):
    out = pieces.pieces_digest(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r["round_trip"] for r in rows)
    assert all(r["n_tokens"] == len(r["piece_ids"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {0}
    assert pieces.pieces_digest(none).count() == 0


def test_viterbi_is_best():
    v = pieces.Vocabulary((("▁a", -1.5, 300), ("a", -2.0, 301), ("b", -2.5, 302), ("ab", -3.0, 303), ("▁", -1.0, 304), ("▁ab", -5.0, 305), ("ba", -1.2, 306)), tuple(range(256)), ())
    a = pieces.Automaton(v)
    score = {p: s for p, s, _ in v.pieces}
    name = {i: p for p, _, i in v.pieces}

    def brute(s):
        if not s:
            return 0.0
        options = [score[s[:n]] + brute(s[n:]) for n in range(1, len(s) + 1) if s[:n] in score]
        return max(options + [a.byte_score + brute(s[1:])])

    for s in ("▁ab", "▁abba", "▁aabab", "bab"):
        ids = a.viterbi(s)
        assert "".join(name[i] for i in ids) == s
        assert sum(score[name[i]] for i in ids) == pytest.approx(brute(s))
    assert a.viterbi("é") == list("é".encode())


def test_pieces_query_is_the_whole_text_viterbi(spark, sf_dir):
    import zlib

    e = pieces.Encoder(pieces.load_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pieces.op8_sentencepiece(spark, sf_dir).collect()[:80]:
        t = texts[r["doc_id"]] or ""
        assert r["piece_ids"] == (e.automaton.viterbi((" " + t).replace(" ", "▁")) if t and "▁" not in t else r["piece_ids"])
        assert r["text_crc32"] == zlib.crc32(t.encode()) and r["round_trip"]


def test_parts_are_those_of_the_whole_text():
    e = pieces.Encoder(pieces.load_vocabulary())
    t = "The quick brown  fox, jumps over 12 lazy dogs.\nEnd of it"
    assert np.frombuffer(e.encode(t), "<i4").tolist() == e.automaton.viterbi((" " + t).replace(" ", "▁"))
