"""Embedding near-duplicates: recall, exact links, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.llm import embedding_dedup as e


def brute(x, ids, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (u @ u.T >= threshold) & ~np.eye(len(x), dtype=bool)


def test_hadamard_is_orthogonal():
    h = e.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_recall_and_precision(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0.25, 0.35, 0.44)])
    x = np.concatenate([base, near]).astype(np.float32).astype(float)
    linked = brute(x, None)
    got = e.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), block=64).collect()
    found = sum(r["n_links"] for r in got)
    assert 0.95 * linked.sum() <= found <= linked.sum()
    for r in got:
        assert r["n_links"] <= linked[r["vec_id"]].sum() and r["kept"] == (r["component_id"] == r["vec_id"])


@pytest.mark.parametrize("block", [16, 50, 1024])
def test_hot_bucket_is_counted_once(spark, block):
    rng = np.random.default_rng(5)
    one = rng.normal(size=32)
    x = np.concatenate([one + 0.05 * rng.normal(size=(90, 32)), np.repeat(one[None], 40, 0)])
    rows = [(i + 10, v.tolist()) for i, v in enumerate(x)]
    got = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block).collect()
    assert {r["n_links"] for r in got} == {129} and {r["component_id"] for r in got} == {10}


def test_width_follows_the_table():
    assert [e.Hashing.of(n, 64).width for n in (0, 10_000, 50_000, 2_000_000, 10**9)] == [2, 2, 3, 3, 5]
    rng = np.random.default_rng(7)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for n in (10_000, 1_000_000):
        x, y = (e.bucket_keys(z, e.Hashing.of(n, 64)) for z in (a, b))
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]) > 0.97


@pytest.mark.parametrize(("dim", "n"), [(64, 10**7), (64, 10**11), (256, 10**7), (256, 10**10), (768, 10**7), (768, 3 * 10**10), (1536, 10**9), (1536, 10**11)])
def test_tables_make_up_for_width_and_dimension(dim, n):
    """Of pairs at cosine 0.9 about 99 % meet, whatever the dimension and the number of vectors; a pair's chance is that of all tables together."""
    how = e.Hashing.of(n, dim)
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(48, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * r / np.linalg.norm(r, axis=1, keepdims=True)
    # the share in one table from some tables, at which all of them are reckoned: fewer pairs are needed for the same certainty
    few = e.Hashing(tables=min(how.tables, 24), width=how.width)
    x, y = (e.bucket_keys(z, few).reshape(len(a), few.tables, -1) for z in (a, b))
    met = (x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean()
    assert 1 - (1 - met) ** how.tables > 0.985


def test_components_of_any_size(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=16)
    rows = [(i, (one + 0.01 * rng.normal(size=16)) * scale) for i, scale in enumerate((1e200, 1e200, 1e-200, 1e-200, 1.0, 5e-320, 1e307))] + [(9, rng.normal(size=16) * 1e200)]
    got = e.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {**{i: (6, 0) for i in (0, 1, 2, 3, 4, 5, 6)}, 9: (0, 9)}


def test_edges(spark):
    v = [1.0] * 8
    rows = [(1, v), (2, v), (2, [2.0] * 8), (3, None), (4, []), (5, [0.0] * 8), (6, [float("nan")] * 8), (7, [1.0, None] * 4), (None, v), (8, [1.0, 0.0] * 4), (9, [1.0] * 5), (10, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in e.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (0, 3, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))], key=repr)
    assert e.near_duplicates(df.limit(0)).count() == 0
