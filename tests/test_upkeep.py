"""Components kept up to date equal a full run, and read what they touch."""

import random
import shutil

import pytest

from twinweave.operators.components import connected_components
from twinweave.operators.upkeep import KeptComponents
from twinweave.sources.keyed_store import KeyedStore

PAIR, NODE = "a long, b long", "node long"


def labels(df):
    return {r[0]: r[1] for r in df.collect()}


def brute(edges):
    """Least node of each node's component."""
    at = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(at[a], at[b])
            changed |= at[a] != least or at[b] != least
            at[a] = at[b] = least
    return at


@pytest.mark.parametrize("seed", [1])
def test_updates_equal_a_full_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    kept, edges = KeptComponents(spark, str(tmp_path / "k"), buckets=8), set()
    for step in range(3):
        added = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(25 if step == 0 else 8)}
        gone = set(rng.sample(range(60), 3)) if step else set()
        cut = set(rng.sample(sorted(edges), 3)) if step else set()
        edges = {e for e in edges - cut if not gone & set(e)} | added
        frames = [spark.createDataFrame([p[::-1] for p in added] + [(5, 5), (None, 1)], PAIR), spark.createDataFrame([(n,) for n in gone], NODE), spark.createDataFrame(list(cut), PAIR)]
        kept.update(*frames, source="s", number=step)
        assert labels(kept.read()) == brute(edges)
        assert {(r.a, r.b) for r in kept.edges.read().collect()} == edges
    assert labels(connected_components(spark.createDataFrame(sorted(edges), PAIR), "a", "b")) == brute(edges)
    before = kept.labels.manifest(), kept.edges.manifest()
    kept.update(*frames, source="s", number=step)
    assert (kept.labels.manifest(), kept.edges.manifest()) == before


def test_an_update_that_died_between_its_tables_is_done_again(spark, tmp_path, monkeypatch):
    kept = KeptComponents(spark, str(tmp_path / "k"), buckets=4)
    kept.update(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], PAIR), number=0)
    change = KeyedStore.change

    def dies(self, *args):
        if self is kept.edges:
            raise OSError("killed")
        return change(self, *args)

    more, less = spark.createDataFrame([(2, 3)], PAIR), spark.createDataFrame([(5,)], NODE)
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "change", dies)
        with pytest.raises(OSError):
            kept.update(more, less, number=1)
    kept.update(more, less, number=1)
    assert labels(kept.read()) == {1: 1, 2: 1, 3: 1, 4: 1}
    assert {(r.component, r.a, r.b) for r in kept.edges.read().collect()} == {(1, 1, 2), (1, 2, 3), (1, 3, 4)}


def test_untouched_components_are_not_read(spark, tmp_path):
    kept = KeptComponents(spark, str(tmp_path / "k"), buckets=32)
    kept.update(spark.createDataFrame([(10 * k, 10 * k + 1) for k in range(40)], PAIR), number=0)
    # files of all buckets but those of components 0 and 10 go
    for store, keys in ((kept.labels, [0, 1, 10, 11]), (kept.edges, [0, 10])):
        mine = store.touched(spark.createDataFrame([(k,) for k in keys], f"{store.keys[0]} long"))
        for b, folder in store.manifest().folders.items():
            if b not in mine:
                shutil.rmtree(f"{folder}/bucket={b}")
    kept.update(spark.createDataFrame([(1, 10)], PAIR), number=1)
    near = spark.createDataFrame([(n,) for n in (0, 1, 10, 11)], NODE)
    assert labels(kept.labels.lookup(near)) == {0: 0, 1: 0, 10: 0, 11: 0}
