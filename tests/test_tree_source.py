"""The source tree data source: the same files as the scan and read, pruned in the reader."""

from __future__ import annotations

import os

import pytest

from callshelf.sources.tree import read_sources, scan_sources
from callshelf.sources.tree_source import read_tree


def make(root, *names: str) -> None:
    for name in names:
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"x = '{name}'\n")


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def both(spark, roots, **options):
    listed = read_sources(scan_sources(spark, roots, **options))
    return rows(read_tree(spark, roots, **options)), rows(listed)


@pytest.mark.parametrize("options", [
    {"recursive": True},
    {"recursive": False},
    {"recursive": True, "exclude": ["test_*", "*_backup*", "*_me.py", "old/"]},
    {"recursive": True, "exclude": ["gen", "!gen/keep.py"]},
    {"recursive": True, "exclude": [".*"]},
])
def test_same_as_scan_and_read(spark, tmp_path, options):
    make(
        tmp_path, "valid.py", "src/good.py", ".git/x.py", "venv/x.py", "__pycache__/x.py",
        "__init__.py", "_private.py", "pkg/__init__.py", ".hidden.py", "_pkg/a.py",
        "b.pyc", "h.PY", ".py", "main.py", "test_a.py", "x_backup_2.py", "not_me.py", "old/a.py",
        "deep/old/b.py", "gen/keep.py", "gen/deep/x.py", "a/b/c/d/e/f/y.py",
    )
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'")
    (tmp_path / "empty.py").write_bytes(b"")
    ours, theirs = both(spark, str(tmp_path), **options)
    assert ours == theirs and (ours or options.get("exclude") == [".*"])


def test_many_folders_over_many_tasks(spark, tmp_path):
    make(tmp_path, *[f"f{i}/g{j}/m.py" for i in range(30) for j in range(5)], "top.py")
    ours = read_tree(spark, str(tmp_path), recursive=True)
    assert ours.rdd.getNumPartitions() > 1
    assert rows(ours) == rows(read_sources(scan_sources(spark, str(tmp_path), recursive=True)))


def test_roots_missing_files_links_and_uris(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    make(root, "real.py", "sub/deep.py")
    make(other, "outside.py", "more/x.py")
    (root / "to_file.py").symlink_to(root / "real.py")
    (root / "folder").symlink_to(other / "more")
    (root / "loop").symlink_to(root)
    got = [r.path for r in read_tree(spark, str(root), recursive=True).collect()]
    assert sorted(got) == [str(root / "real.py"), str(root / "sub/deep.py")]
    uri = [r.path for r in read_tree(spark, f"file://{root}", recursive=True).collect()]
    assert sorted(uri) == sorted(got)
    assert read_tree(spark, str(tmp_path / "none"), recursive=True).count() == 0
    assert read_tree(spark, str(root / "real.py"), recursive=True).count() == 0


def test_path_filters_reach_the_reader(spark, tmp_path):
    make(tmp_path, "a/x.py", "a/y.py", "b/z.py", "b/sub/w.py")
    df = read_tree(spark, str(tmp_path), recursive=True)
    below_b = df.where(df.path.startswith(str(tmp_path / "b")))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = below_b._jdf.queryExecution().explainString(mode)
    assert f"PushedFilters: [StringStartsWith(path,{tmp_path / 'b'})]" in plan
    assert sorted(os.path.relpath(r.path, tmp_path) for r in below_b.collect()) == [
        "b/sub/w.py", "b/z.py"]
    ending = df.where(df.path.endswith("y.py"))
    assert [os.path.relpath(r.path, tmp_path) for r in ending.collect()] == ["a/y.py"]


def test_stream_takes_new_and_changed_files_once(spark, tmp_path):
    from callshelf.sources.tree_source import read_tree_stream

    root, sink, checkpoint, state = (tmp_path / n for n in ("root", "sink", "ck", "state"))
    make(root, "a.py", "_pkg/b.py", "venv/skip.py")

    def trigger() -> list[tuple]:
        stream = read_tree_stream(spark, str(root), str(state), recursive=True)
        query = (stream.writeStream.format("parquet").option("path", str(sink))
                 .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted((os.path.relpath(r.path, root), r.content)
                      for r in spark.read.parquet(str(sink)).collect())

    first = trigger()
    assert first == [("_pkg/b.py", "x = '_pkg/b.py'\n"), ("a.py", "x = 'a.py'\n")]
    (root / "a.py").write_text("x = 'changed'\n")
    make(root, "c.py")
    second = trigger()
    assert second == sorted(first + [("a.py", "x = 'changed'\n"), ("c.py", "x = 'c.py'\n")])
    assert trigger() == second  # a restart with nothing new adds nothing
