from __future__ import annotations

import itertools
import subprocess

import pytest
from pyspark.sql import functions as F

from callshelf.functions.patterns import ExcludeRules, pattern_rule
from callshelf.sources.tree import exclude_paths

NAMES = ["a", "b.py", "build", "x_test.py", "[z]", "a*b", "q?"]
PATHS = sorted(
    {"/".join(p) for n in (1, 2, 3) for p in itertools.product(NAMES, repeat=n)}
)
SINGLE = [
    "build", "build/", "/build", "/build/", "*.py", "a/b.py", "a/*", "a/**", "**/build", "**",
    "a/**/b.py", "/a/*/b.py", "*_test.py", "?", "[ab]*", "[!a]*", "\\[z\\]", "a\\*b", "a*b", "#x",
    "", "b*/a", "*/a", "**/a/b.py", "a/", "/*", "q\\?", "q[?]", "[a-b].py", "/**/a",
]


def git_ignored(folder, patterns: list[str]) -> set[str]:
    """What git itself says about paths that do not exist (so none is a folder)."""
    (folder / ".gitignore").write_text("\n".join(patterns) + "\n")
    run = subprocess.run(
        ["git", "check-ignore", "--no-index", "-z", "--stdin"],
        cwd=folder, input="\0".join(PATHS), capture_output=True, text=True,
    )
    return set(run.stdout.split("\0")) - {""}


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    folder = tmp_path_factory.mktemp("git")
    subprocess.run(["git", "init", "-q"], cwd=folder, check=True)
    return folder


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").cache()


@pytest.mark.parametrize("pattern", SINGLE)
def test_single_pattern_like_git(paths, repository, pattern):
    rules = ExcludeRules([pattern], defaults=False)
    ours = {r.path for r in paths.where(rules.excludes(F.col("path"))).collect()}
    assert ours == git_ignored(repository, [pattern])


@pytest.mark.parametrize(
    "patterns",
    [
        ["*.py", "!b.py"],
        ["build", "!build/b.py"],
        ["a/*", "!a/build"],
        ["!b.py", "*.py"],
        ["build/*", "!build/a", "build/a/b.py"],
    ],
)
def test_exceptions_like_git(paths, repository, patterns):
    rules = ExcludeRules(patterns, defaults=False)
    assert rules.has_exceptions
    ours = {r.path for r in paths.where(rules.excludes(F.col("path"))).collect()}
    # .py files only: unlike in git, an exception for a folder brings back all below it
    files = {p for p in PATHS if ".py/" not in p}
    assert ours & files == git_ignored(repository, patterns) & files


def test_an_exception_covers_what_lies_below(paths):
    rules = ExcludeRules(["*", "!*/", "!*.py"], defaults=False)
    ours = {r.path for r in paths.where(rules.excludes(F.col("path"))).collect()}
    # top folders other than *.py are excluded, so nothing in them is seen
    assert ours == {p for p in PATHS if not p.split("/")[0].endswith(".py")}


def test_a_folder_pattern_does_not_hit_the_folder_itself(spark):
    """``fr/`` covers what is in the folder, so the folder is entered and an exception can
    bring a file back; ``fr`` covers the folder too."""
    df = spark.createDataFrame([("a/fr/377.py",), ("a/fr/1.py",)], "path string")
    assert [r.path for r in exclude_paths(df, ["fr/", "!*77.py"]).collect()] == ["a/fr/377.py"]
    assert exclude_paths(df, ["fr", "!*77.py"]).count() == 0


def test_white_space_around_a_pattern_is_dropped():
    assert pattern_rule("  build ") == pattern_rule("build")


def test_patterns_without_effect():
    assert [pattern_rule(p) for p in ("", "  ", "/", "# x", "[z-a]", "!")] == [None] * 6


def test_defaults_and_root(spark):
    kept = ["/r/main.py", "/r/src/a.py", "/r/environment/x.py", "/r/builds/x.py"]
    dropped = [
        "/r/__pycache__/x.py", "/r/.git/x.py", "/r/a/venv/x.py", "/r/.venv/x.py", "/r/dist/x.py",
        "/r/node_modules/p/x.py", "/r/.pytest_cache/x.py", "/r/build/x.py", "/r/.env.local/x.py",
        "/r/python_embeded/x.py", "/r/python_embedded/x.py", "/r/.vscode/x.py", "/r/.vs/x.py",
    ]
    df = spark.createDataFrame([(p,) for p in kept + dropped], "path string")
    assert sorted(r.path for r in exclude_paths(df, root="/r").collect()) == sorted(kept)
    # the root's own name does not count
    inside = spark.createDataFrame([("/x/build/a.py",)], "path string")
    assert exclude_paths(inside, root="/x/build").count() == 1


def test_any_pattern_excludes(spark):
    names = ["main.py", "utils.py", "test_a.py", "x_backup_1.py", "not_me.py", "old/x.py"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kept = exclude_paths(df, ["test_*", "*_backup*", "*_me.py", "old/"])
    assert sorted(r.path for r in kept.collect()) == ["main.py", "utils.py"]
