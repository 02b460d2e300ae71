from __future__ import annotations

import random

import pytest

from callshelf.schemas import SOURCES
from callshelf.session import scratch
from callshelf.sources.store import CatalogStore
from callshelf.streaming.incremental import read_source_stream, start_ingest


def arrive(spark, folder, files: dict[str, str]) -> None:
    rows = [(path, text, None) for path, text in files.items()]
    spark.createDataFrame(rows, SOURCES).coalesce(1).write.mode("append").parquet(folder)


def fold(spark, folder, store, checkpoint, **options) -> None:
    start_ingest(
        read_source_stream(spark, folder, 1), store, checkpoint, base="/w", **options
    ).awaitTermination()


def names(store) -> set[str]:
    return {r.code_name for r in store.metadata().collect()}


def test_arrivals_are_taken_once(spark, store):
    folder, checkpoint = scratch(spark, "in"), scratch(spark, "stream")
    arrive(spark, folder, {"/w/a.py": 'def a():\n    """A."""\n', "/w/x.py": "def broken(:"})
    fold(spark, folder, store, checkpoint)
    assert names(store) == {"a"} and store._versions() == [0, 1]

    arrive(spark, folder, {"/w/b.py": 'def b():\n    """B."""\n'})
    arrive(spark, folder, {"/w/a.py": 'def again():\n    """A."""\n', "/w/__init__.py": ""})
    fold(spark, folder, store, checkpoint)
    # one commit for each file of the table; the known interface stays
    assert names(store) == {"a", "b"} and store._versions() == [0, 1, 2, 3]

    fold(spark, folder, store, checkpoint)
    assert store._versions() == [0, 1, 2, 3]


def test_runs_are_folded(spark, store):
    folder, checkpoint = scratch(spark, "in"), scratch(spark, "stream")
    for name in "abc":
        arrive(spark, folder, {f"/w/{name}.py": f'def {name}():\n    """D."""\n'})
    fold(spark, folder, store, checkpoint, compact_after=2)
    assert names(store) == {"a", "b", "c"} and len(store.runs()) <= 2


def test_a_replayed_batch_changes_nothing(spark, store):
    folder, checkpoint = scratch(spark, "in"), scratch(spark, "stream")
    arrive(spark, folder, {"/w/a.py": 'def a():\n    """A."""\n    return 1\n'})
    # the batch was committed, then the stream died before it noted so
    store.commit(store.codes(), store.metadata(), batch_id=f"{checkpoint}#0")
    fold(spark, folder, store, checkpoint, bypass=True)
    assert store._versions() == [0, 1] and names(store) == set()


def test_versions_of_one_path_in_one_trigger(spark, store):
    """Two files of the table, one trigger: as if each had come in a run of its own."""
    folder, checkpoint = scratch(spark, "in"), scratch(spark, "stream")
    text = 'def a(x):\n    """A."""\n    return {}\n\n\ndef only_{}():\n    """Only {}."""\n'
    for number in (1, 2):
        arrive(spark, folder, {"/w/a.py": text.format(number, number, number)})
    start_ingest(
        read_source_stream(spark, folder), store, checkpoint, base="/w", bypass=True
    ).awaitTermination()
    rows = store.catalog().collect()
    assert sorted(r.code_name for r in rows) == ["a", "only_1", "only_2"]
    (a,) = [r for r in rows if r.code_name == "a"]
    assert "return 2" in a.computer_code  # the later one is written again over the earlier


@pytest.mark.parametrize("bypass", [False, True])
def test_keys_stay_unique_with_repeated_paths(spark, store, bypass):
    from callshelf.plans.ingest import ingest
    from callshelf.session import stage

    rng = random.Random(7)
    for _ in range(2):
        rows = [
            (f"/w/m{rng.randint(0, 3)}.py",
             f'def f{rng.randint(0, 2)}(x):\n    """D."""\n    return {rng.randint(0, 3)}\n',
             None)
            for _ in range(30)
        ]
        sources = stage(spark.createDataFrame(rows, SOURCES), "in")
        ingest(sources, store, base="/w", bypass=bypass)
        for table in (store.codes(), store.metadata()):
            assert table.count() == table.select("cid").distinct().count() > 0
        assert store.catalog().count() == store.metadata().count()


def test_like_batch_runs_in_order(spark, store):
    from callshelf.plans.ingest import ingest
    from callshelf.session import stage

    first = {f"/w/m{i}.py": f'def f{i}(x):\n    """D{i}."""\n    return 1\n' for i in range(5)}
    second = {p: t.replace("return 1", "return 2").replace("def f", "def g") for p, t in first.items()}
    folder, checkpoint = scratch(spark, "in"), scratch(spark, "stream")
    other = CatalogStore.create(spark, scratch(spark, "other"))
    for files in (first, second):
        arrive(spark, folder, files)
        fold(spark, folder, store, checkpoint, bypass=True)
        rows = [(p, t, None) for p, t in files.items()]
        ingest(stage(spark.createDataFrame(rows, SOURCES), "in"), other, base="/w", bypass=True)
    view = lambda s: {tuple(map(str, r)) for r in s.catalog().drop("created_at", "updated_at").collect()}
    assert view(store) == view(other) and names(store) == {f"g{i}" for i in range(5)}
