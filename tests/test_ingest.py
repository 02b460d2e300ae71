"""Whole runs against a plain sequential model of the catalog."""

from __future__ import annotations

from datetime import datetime

import pytest

from callshelf.operators import report
from callshelf.plans.ingest import ingest
from callshelf.session import scratch
from callshelf.sources.store import CatalogStore
from callshelf.sources.tree import read_sources, scan_sources
from test_identity import plain_cid

AS_OF = datetime(2024, 5, 1, 12)
SHARED = 'def shared(x):\n    """Same everywhere."""\n    return x'
FILES = {
    "/w/a.py": 'def one(x):\n    """First."""\n    return 1\n\ndef two(y):\n    """Second."""\n',
    "/w/b.py": f"import os\n\n{SHARED}\n\ndef bare(): pass\n",
    "/w/tests/c.py": f'{SHARED}\n\ndef meth(self):\n    """No."""\n\ndef test_x():\n    """T."""\n',
    "/w/d.py": "def broken(:\n",
    "/w/e.py": 'def late(x):\n    """Same interface."""\n    return 1\n'
    'def later(x):\n    """Same interface."""\n    return 2\n',
    "/w/f.py": "",
}


def stats_of(run) -> dict:
    return run.stats.first().asDict()


def codes_of(store) -> dict:
    return {r.cid: (r.version_cid, r.computer_code) for r in store.codes().collect()}


def test_first_run_and_rerun(spark, store, sources):
    run = ingest(sources(FILES), store, base="/w", as_of=AS_OF)
    assert stats_of(run) == {
        "files_scanned": 6,
        "callables_found": 9,
        "skipped_not_standalone": 1,
        "skipped_no_docstring": 1,
        "skipped_duplicates": 1,
        "new_uploads": 6,
        "valid_callables": 7,
        "parse_errors": 1,
        "upload_errors": 0,
        "errors": 1,
    }
    assert run.status.first().status == 1
    assert [r.path for r in run.parse_errors.collect()] == ["/w/d.py"]
    assert run.upload_errors.count() == 0

    shared = plain_cid("def shared(x):" + "Same everywhere." + SHARED)
    rows = {r.file_path: r for r in store.metadata().collect() if r.code_name == "shared"}
    # one interface per file, one code for both
    assert set(rows) == {"w/b.py", "w/tests/c.py"}
    assert {r.code_cid for r in rows.values()} == {shared}
    assert rows["w/b.py"].cid == plain_cid("(x):" + "Same everywhere." + "function" + "w/b.py")
    assert rows["w/b.py"].is_test is False and rows["w/tests/c.py"].is_test is True
    assert rows["w/tests/c.py"].tags == ["c", "tests"]
    assert codes_of(store)[shared] == (shared, SHARED)
    assert store.total().first().total == 5
    assert {r.created_at for r in store.codes().collect()} == {AS_OF}
    names = {r.code_name for r in store.metadata().collect()}
    assert names == {"one", "two", "shared", "test_x", "late"}

    again = stats_of(ingest(sources(FILES), store, base="/w"))
    assert (again["new_uploads"], again["skipped_duplicates"]) == (0, 7)
    # only unknown interfaces are added to a grown tree
    grown = {**FILES, "/w/g.py": 'class New:\n    """Fresh."""\n'}
    more = stats_of(ingest(sources(grown), store, base="/w"))
    assert (more["new_uploads"], more["skipped_duplicates"]) == (1, 7)


def test_bypass_keeps_the_immutable_id(spark, store, sources):
    ingest(sources(FILES), store, base="/w", as_of=AS_OF)
    before = {r.cid: r.code_cid for r in store.metadata().collect()}
    changed = {p: t.replace("return 1", "return 10") for p, t in FILES.items()}
    later = datetime(2024, 6, 1)
    run = ingest(sources(changed), store, base="/w", bypass=True, as_of=later)
    stats = stats_of(run)
    assert (stats["new_uploads"], stats["skipped_duplicates"]) == (7, 0)
    assert {r.cid: r.code_cid for r in store.metadata().collect()} == before

    late = {r.file_path: r for r in store.metadata().collect()}["w/e.py"]
    version, code = codes_of(store)[late.code_cid]
    # the last of the colliding callables wins, whole
    assert late.code_name == "later" and code.startswith("def later") and version != late.code_cid
    assert {r.created_at for r in store.codes().collect()} == {later}
    # two changed codes under their old ids
    assert sum(cid != v for cid, (v, _) in codes_of(store).items()) == 2


def test_dry_run_writes_nothing(spark, store, sources):
    ingest(sources({"/w/a.py": FILES["/w/a.py"]}), store, base="/w")
    run = ingest(sources(FILES), store, dry_run=True, base="/w")
    stats = stats_of(run)
    assert (stats["new_uploads"], stats["skipped_duplicates"]) == (0, 0)
    assert (stats["files_scanned"], stats["callables_found"], stats["valid_callables"]) == (6, 9, 7)
    rows = run.preview.collect()
    assert {r.name for r in rows if r.known} == {"one", "two"}
    assert len(rows) == 7 and all(len(r.short_cid) == 12 for r in rows)
    assert store.total().first().total == 2
    assert run.status.first().status == 2 and run.outcomes is None and run.version is None


def test_entries_that_do_not_fit(spark, store, sources):
    run = ingest(sources(FILES), store, base="/w", limits={"text_max_bytes": 50})
    rows = {r.name: r for r in run.upload_errors.collect()}
    assert set(rows) == {"shared", "late", "later"}
    assert rows["late"].error == "Data too long for column 'computer_code'"
    stats = stats_of(run)
    assert (stats["new_uploads"], stats["upload_errors"], stats["errors"]) == (3, 4, 5)
    assert run.status.first().status == 1
    shown = {(r.kind, r.rank): r for r in run.errors.collect()}
    assert shown["parse", 1].file == "/w/d.py"
    assert shown["upload", 1].file == "/w/b.py" and shown["upload", 1].callable == "shared"

    nothing = ingest(sources(FILES), store, base="/w", limits={"text_max_bytes": 0})
    assert nothing.status.first().status == 2


def test_no_files_is_success(spark, store, sources):
    run = ingest(spark.createDataFrame([], "path string, content string"), store)
    assert set(stats_of(run).values()) == {0}
    assert run.status.first().status == 0


def test_long_code(spark, store, sources):
    body = "\n".join(f"    x{i} = {i}" for i in range(10_000))
    big = sources({"/w/big.py": f'def big():\n    """Big."""\n{body}\n'})
    run = ingest(big, store, limits={"text_max_bytes": 65_535})
    assert [r.error for r in run.upload_errors.collect()] == [
        "Data too long for column 'computer_code'"
    ]
    run = ingest(big, store)  # no limit unless one is given
    assert stats_of(run)["new_uploads"] == 1
    assert store.codes().first().computer_code.count("\n") == 10_001


def test_missing_catalog_stops_the_run(spark, sources):
    with pytest.raises(RuntimeError, match="No catalog"):
        ingest(sources(FILES), CatalogStore(spark, scratch(spark, "none")))


def test_from_folders(spark, store, tmp_path):
    for path, text in FILES.items():
        file = tmp_path / path.removeprefix("/w/")
        file.parent.mkdir(exist_ok=True)
        file.write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff")
    paths = scan_sources(spark, str(tmp_path), recursive=True)
    run = ingest(read_sources(paths), store, base=str(tmp_path))
    stats = stats_of(run)
    assert (stats["files_scanned"], stats["new_uploads"], stats["parse_errors"]) == (7, 6, 2)


def test_error_report_lists_the_first_five(spark):
    parse = spark.createDataFrame([(f"p{i}", f"e{i}") for i in range(9)], "path string, error string")
    upload = spark.createDataFrame(
        [("u", i, f"n{i}", "e") for i in range(3)],
        "path string, line_number int, name string, error string",
    )
    rows = report.error_report(parse, upload).orderBy("kind", "rank").collect()
    assert [(r.kind, r.rank, r.file, r.more) for r in rows] == [
        *[("parse", i + 1, f"p{i}", 4) for i in range(5)],
        *[("upload", i + 1, "u", 0) for i in range(3)],
    ]
    none = spark.createDataFrame([], "path string, error string")
    assert report.error_report(none, upload.limit(0)).count() == 0


@pytest.mark.parametrize(
    "errors, uploads, status", [(0, 0, 0), (0, 5, 0), (3, 1, 1), (1, 0, 2)]
)
def test_status(spark, errors, uploads, status):
    stats = spark.createDataFrame([(errors, uploads)], "errors long, new_uploads long")
    assert report.run_status(stats).first().status == status


def test_stats_are_observed_while_writing(spark, store, sources):
    run = ingest(sources(FILES), store, base="/w", as_of=AS_OF)
    plan = run.stats._jdf.queryExecution().optimizedPlan().toString()
    # one row made on the driver from the observed counters: no table is read
    assert "parquet" not in plan.lower() and "Relation[" not in plan and "Aggregate" not in plan
    assert stats_of(run)["files_scanned"] == 6
