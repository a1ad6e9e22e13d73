"""The pipeline: columns between stages, decisions that take effect, agreement with brute force."""

import numpy as np

import corpus_pipeline as cp
from tests.llm.test_documents import brute_groups, brute_spans, words
from twinweave.llm import mixing, quality_model


def without(text, spans):
    """The text without the bytes of the spans."""
    raw, out, at = text.encode(), b"", 0
    for start, end in sorted(spans):
        out, at = out + raw[at:start], end
    return (out + raw[at:]).decode()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        before = {r["doc_id"]: r for r in docs.collect()}
        rows = out.collect()
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in rows} <= set(before)
        if name == "quality classifier":
            model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            score = model.score(np.array([quality_model.statistics((r["text"] or "").encode()) for r in before.values()]))
            assert {r["doc_id"] for r in rows} == {i for i, x in zip(before, score, strict=True) if x >= 0.3}
        elif name == "substring dedup":
            spans = {}
            for i, _, start, end, _ in brute_spans([(i, r["text"]) for i, r in before.items()]):
                spans.setdefault(i, []).append((start, end))
            want = {i: without(r["text"], spans[i]) if i in spans else r["text"] for i, r in before.items()}
            want = {i: t for i, t in want.items() if i not in spans or words(t)}
            assert {r["doc_id"]: r["text"] for r in rows} == want
            assert all(r["n_chars"] == (len(r["text"]) if r["doc_id"] in spans else before[r["doc_id"]]["n_chars"]) for r in rows)
        if name == "n-gram Jaccard join":
            groups = brute_groups([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert {r["doc_id"] for r in rows} == {i for i, (_, c) in groups.items() if i == c}
        elif name == "mixing sources":
            total = sum(len(words(r["text"])) for r in before.values())
            assert abs(sum(len(words(r["text"])) for r in rows) - 1.5 * total) <= 20
            want = []
            for r in mixing.mix(docs).collect():
                whole, part = divmod(r["taken"], r["size"]) if r["size"] else (0, 0)
                text = before[r["doc_id"]]["text"]
                want += [(r["doc_id"], text)] * whole + [(r["doc_id"], " ".join(words(text)[:part]))] * (part > 0)
            assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(want)
        elif name == "SentencePiece":
            assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
        if name != cp.STAGES[-1][0]:
            docs = spark.createDataFrame(rows, docs.schema)


def test_run(spark, sf_dir):
    assert len(cp.STAGES) == 5 and cp.run(spark, sf_dir).count() > 0


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_keep_other_columns_and_odd_rows(spark, sf_dir):
    """Nulls in every column, empty texts, repeated rows and clashing names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    kinds = {c: t for c, t in docs.dtypes}
    from pyspark.sql import functions as F

    null = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    empty = docs.limit(1).withColumn("text", F.lit(""))
    odd = docs.union(docs).union(null).union(empty)
    clashes = ("was_cut", "span_id", "taken_words", "score", "predicted", "quality_score", "component_id")
    for c in clashes:
        odd = odd.withColumn(c, F.lit(c))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and not any(r[c] != c for r in out.collect() for c in clashes)
    assert cp.STAGES[-1][1](spark, odd, sf_dir).filter("not round_trip").count() == 0
