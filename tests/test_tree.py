from __future__ import annotations

import os

from callshelf.sources.tree import read_sources, scan_sources


def make(root, *names: str) -> None:
    for name in names:
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x = 1\n")


def scanned(spark, root, **options) -> list[str]:
    paths = [r.path for r in scan_sources(spark, str(root), **options).collect()]
    assert len(paths) == len(set(paths))
    return sorted(os.path.relpath(p, root) for p in paths)


def test_recursive_with_defaults(spark, tmp_path):
    excluded = [".git", "venv", ".venv", "node_modules", "__pycache__", "build", "dist", ".vs"]
    make(tmp_path, "valid.py", "src/good.py", *[f"{d}/x.py" for d in excluded])
    assert scanned(spark, tmp_path, recursive=True) == ["src/good.py", "valid.py"]
    assert scanned(spark, tmp_path) == ["valid.py"]


def test_names_that_spark_would_hide(spark, tmp_path):
    make(tmp_path, "__init__.py", "_private.py", "pkg/__init__.py", ".hidden.py", "_pkg/a.py")
    assert scanned(spark, tmp_path, recursive=True) == [
        ".hidden.py", "__init__.py", "_pkg/a.py", "_private.py", "pkg/__init__.py",
    ]


def test_suffixes(spark, tmp_path):
    make(tmp_path, "a.py", "b.pyc", "c.pyx", "d.pyi", "e.txt", "f.json", "g", ".py", "h.PY", "i.py.bak")
    assert scanned(spark, tmp_path, recursive=True) == ["a.py"]


def test_user_patterns(spark, tmp_path):
    make(
        tmp_path, "main.py", "utils.py", "test_a.py", "x_backup_2.py", "not_me.py", "old/a.py",
        "deep/old/b.py",
    )
    exclude = ["test_*", "*_backup*", "*_me.py", "old/"]
    assert scanned(spark, tmp_path, recursive=True, exclude=exclude) == ["main.py", "utils.py"]


def test_excluded_folders_are_not_entered(spark, tmp_path):
    make(tmp_path, "gen/keep.py", "gen/deep/x.py", "a.py")
    found = scanned(spark, tmp_path, recursive=True, exclude=["gen", "!gen/keep.py"])
    assert found == ["a.py"]
    assert scanned(spark, tmp_path, recursive=True, exclude=[".*"]) == []


def test_missing_roots_give_nothing(spark, tmp_path):
    make(tmp_path, "a.py")
    assert scanned(spark, tmp_path / "no") == []
    assert scanned(spark, tmp_path / "a.py", recursive=True) == []
    (tmp_path / "empty").mkdir()
    assert scanned(spark, tmp_path / "empty", recursive=True) == []


def test_several_roots_and_deep_folders(spark, tmp_path):
    make(tmp_path, "a/x.py", "a/b/c/d/e/f/y.py", "c/z.py")
    roots = [str(tmp_path / "a"), str(tmp_path / "c"), str(tmp_path / "a" / "b")]
    paths = [r.path for r in scan_sources(spark, roots, recursive=True).orderBy("path").collect()]
    assert paths == [str(tmp_path / p) for p in ("a/b/c/d/e/f/y.py", "a/x.py", "c/z.py")]


def test_links(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    make(root, "real.py", "sub/deep.py")
    make(other, "outside.py", "more/x.py")
    (root / "to_file.py").symlink_to(root / "real.py")
    (root / "relative.py").symlink_to("real.py")
    (root / "to_outside.py").symlink_to(other / "outside.py")
    (root / "broken.py").symlink_to(root / "none.py")
    (root / "self.py").symlink_to(root / "self.py")
    (root / "folder").symlink_to(other / "more")
    (root / "loop").symlink_to(root)
    assert scanned(spark, root, recursive=True) == ["real.py", "sub/deep.py"]
    assert scanned(spark, root) == ["real.py"]


def test_unreadable_folder_is_skipped(spark, tmp_path):
    make(tmp_path, "a.py", "closed/b.py")
    os.chmod(tmp_path / "closed", 0)
    try:
        found = scanned(spark, tmp_path, recursive=True)
    finally:
        os.chmod(tmp_path / "closed", 0o755)
    assert found == (["a.py", "closed/b.py"] if os.geteuid() == 0 else ["a.py"])


def test_read(spark, tmp_path):
    (tmp_path / "good.py").write_bytes("größe = 1\r\n".encode())
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'")
    (tmp_path / "empty.py").write_bytes(b"")
    names = ["good.py", "bad.py", "empty.py", "gone.py"]
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")
    rows = {os.path.basename(r.path): r for r in read_sources(paths).collect()}
    assert rows["good.py"].content == "größe = 1\r\n" and rows["good.py"].read_error is None
    assert rows["empty.py"].content == "" and rows["empty.py"].read_error is None
    assert rows["bad.py"].content is None and "UTF-8" in rows["bad.py"].read_error
    assert rows["gone.py"].content is None and "No such file" in rows["gone.py"].read_error
