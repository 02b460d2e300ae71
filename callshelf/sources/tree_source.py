"""Source files as a Spark data source: ``spark.read.format("sourcetree")``.

Spark's own file sources hide names that start with ``_`` or ``.`` (every ``__init__.py``),
so the tree is read by a Python data source:

* **Planning.** The driver lists the upper levels of the roots, breadth first, until there
  are ``tasks`` folders or nothing more to enter; those folders become the input
  partitions. Only those levels pass the driver.
* **Reading.** Each task walks its folders to the bottom and reads the files it keeps,
  through a ``pyarrow.fs`` handle for the root's URI (local paths, ``file://`` and any
  store that pyarrow opens). Links are not followed.
* **Pruning.** The exclude rules are judged on each folder before it is entered, and a
  pushed-down ``path`` prefix skips folders outside it; a pushed ``path`` suffix skips files
  before they are read.

Rows: ``(path, content, read_error)``; content is strict UTF-8, a file that is no UTF-8 or
cannot be read has a null content and the reason. Options: ``paths`` (JSON list of roots),
``recursive`` (``true``/``false``), ``exclude`` (JSON list of patterns), ``suffix``
(default ``.py``; empty for all files) and ``tasks``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    StringEndsWith,
    StringStartsWith,
)

from callshelf.functions.patterns import ExcludeRules

NAME = "sourcetree"
SCHEMA = "path string, content string, read_error string"


class _Verdict:
    """The exclude rules in Python: the last rule that matches a relative path decides."""

    def __init__(self, patterns: Sequence[str]) -> None:
        rules = ExcludeRules(patterns).rules
        self.rules = [(excludes, re.compile(rf"(?s)^(?:{regex})\Z")) for excludes, regex in rules]

    def __call__(self, relative: str) -> bool:
        verdict = False
        for excludes, rule in self.rules:
            if rule.match(relative):
                verdict = excludes
        return verdict


def _handle(root: str):
    """File system, path within it, and how its paths are written back as text."""
    from pyarrow import fs

    if "://" not in root:
        return fs.LocalFileSystem(), root.rstrip("/") or "/", ""
    handle, inner = fs.FileSystem.from_uri(root)
    parts = urlsplit(root)
    if parts.scheme == "file":
        return handle, inner.rstrip("/") or "/", ""
    prefix = f"{parts.scheme}://" + ("" if inner.startswith(parts.netloc) else parts.netloc)
    return handle, inner.rstrip("/"), prefix


def _is_link(handle, path: str) -> bool:
    """Links are not followed: a linked folder may lead back up (a loop), and a linked
    file inside the root is read where it lies. Only local file systems have links."""
    from pyarrow import fs

    if not isinstance(handle, fs.LocalFileSystem):
        return False
    import os.path

    return os.path.islink(path)


class _Tree:
    """What both sides know: roots, rules, and the filters Spark pushed."""

    def __init__(self, options: dict) -> None:
        paths = options.get("paths") or json.dumps([options.get("path")])
        self.roots = [r for r in json.loads(paths) if r]
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.suffix = options.get("suffix", ".py")
        self.tasks = int(options.get("tasks", "64"))
        self.prefixes: list[str] = []
        self.suffixes: list[str] = []

    def listing(self, handle, folder: str):
        from pyarrow import fs

        try:
            return handle.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        except OSError:
            return []

    def wanted_file(self, name: str, path: str) -> bool:
        if self.suffix and not (name.endswith(self.suffix) and len(name) > len(self.suffix)):
            return False
        return all(path.endswith(s) for s in self.suffixes) and all(
            path.startswith(p) for p in self.prefixes
        )

    def wanted_folder(self, path: str) -> bool:
        """A folder may hold a wanted path: it lies on the way to each prefix or below it."""
        return all(p.startswith(path + "/") or path.startswith(p) or (path + "/").startswith(p)
                   for p in self.prefixes)


    def walk(self, root: str, folder: str) -> Iterator[tuple]:
        """(handle, file info, path as text) of the wanted files below ``folder`` of ``root``."""
        from pyarrow import fs

        handle, inner, prefix = _handle(root)
        verdict = _Verdict(self.exclude)
        stack = [folder]
        while stack:
            here = stack.pop()
            for entry in sorted(self.listing(handle, here), key=lambda e: e.path):
                relative = entry.path[len(inner.rstrip("/")) + 1:]
                if verdict(relative) or _is_link(handle, entry.path):
                    continue
                if entry.type == fs.FileType.Directory:
                    if self.recursive and self.wanted_folder(prefix + entry.path):
                        stack.append(entry.path)
                elif entry.type == fs.FileType.File:
                    if self.wanted_file(entry.base_name, prefix + entry.path):
                        yield handle, entry, prefix + entry.path

    def snapshot(self) -> dict[str, list]:
        """``{path: [size, modification time in ns]}`` of every wanted file of all roots."""
        from pyarrow import fs

        seen: dict[str, list] = {}
        if self.recursive and _Verdict(self.exclude)("."):
            return seen
        for root in self.roots:
            handle, inner, _ = _handle(root)
            if handle.get_file_info(inner).type != fs.FileType.Directory:
                continue
            for _, entry, shown in self.walk(root, inner):
                seen[shown] = [entry.size, entry.mtime_ns]
        return seen


def _read_file(shown: str, root: str) -> tuple:
    """(path, content, read_error) of one file, by the handle of its root."""
    handle, _, prefix = _handle(root)
    try:
        with handle.open_input_stream(shown.removeprefix(prefix)) as stream:
            data = stream.read()
    except OSError as error:
        return shown, None, str(error)
    try:
        return shown, data.decode("utf-8"), None
    except UnicodeDecodeError:
        return shown, None, f"Not UTF-8 text: {shown}"


class SourceTreeReader(DataSourceReader):
    def __init__(self, tree: _Tree) -> None:
        self.tree = tree

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.tree.prefixes.append(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.tree.suffixes.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Breadth-first over the upper levels until there are ``tasks`` folders."""
        from pyarrow import fs

        tree = self.tree
        work: list[tuple[str, str, bool]] = []  # (root, path, is_folder)
        frontier: list[tuple[str, str]] = []
        for root in tree.roots:
            handle, inner, prefix = _handle(root)
            info = handle.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                frontier.append((root, inner))
        verdict = _Verdict(tree.exclude)
        hidden = tree.recursive and verdict(".")
        while frontier and not hidden and tree.recursive and len(frontier) < tree.tasks:
            deeper: list[tuple[str, str]] = []
            for root, folder in frontier:
                handle, inner, _ = _handle(root)
                for entry in tree.listing(handle, folder):
                    relative = entry.path[len(inner.rstrip("/")) + 1:]
                    if verdict(relative) or _is_link(handle, entry.path):
                        continue
                    if entry.type == fs.FileType.Directory and tree.wanted_folder(
                        _handle(root)[2] + entry.path
                    ):
                        deeper.append((root, entry.path))
                    elif entry.type == fs.FileType.File:
                        work.append((root, entry.path, False))
            frontier = deeper
        if hidden:
            frontier = []
        work += [(root, folder, True) for root, folder in frontier]
        if not tree.recursive:
            work = [(root, folder, True) for root, folder in frontier]
        count = max(1, min(tree.tasks, len(work)))
        return [InputPartition(json.dumps(work[i::count])) for i in range(count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        tree = self.tree
        verdict = _Verdict(tree.exclude)
        for root, path, is_folder in json.loads(partition.value):
            handle, inner, prefix = _handle(root)
            if not is_folder:
                yield from self._file(handle, path, prefix, path.rsplit("/", 1)[-1])
                continue
            stack = [path]
            while stack:
                folder = stack.pop()
                for entry in sorted(tree.listing(handle, folder), key=lambda e: e.path):
                    relative = entry.path[len(inner.rstrip("/")) + 1:]
                    if verdict(relative) or _is_link(handle, entry.path):
                        continue
                    if entry.type == fs.FileType.Directory:
                        if tree.recursive and tree.wanted_folder(prefix + entry.path):
                            stack.append(entry.path)
                    elif entry.type == fs.FileType.File:
                        yield from self._file(handle, entry.path, prefix, entry.base_name)

    def _file(self, handle, path: str, prefix: str, name: str) -> Iterator[tuple]:
        shown = prefix + path
        if not self.tree.wanted_file(name, shown):
            return
        try:
            with handle.open_input_stream(path) as stream:
                data = stream.read()
        except OSError as error:
            yield shown, None, str(error)
            return
        try:
            yield shown, data.decode("utf-8"), None
        except UnicodeDecodeError:
            yield shown, None, f"Not UTF-8 text: {shown}"


class SourceTreeStreamReader(DataSourceStreamReader):
    """Offsets of its own: each offset is a snapshot of (path, size, modification time).

    ``latestOffset`` lists the tree on the driver, as Spark's file streams do, and writes a
    new snapshot to the ``state`` folder only if something changed; a batch reads the files
    that are new or changed between its two snapshots. A file changed between triggers
    arrives once with its content at reading time; a restart finds the last snapshot in
    ``state`` and adds nothing while the tree stays as it was. Deleted files are not
    reported.
    """

    def __init__(self, tree: _Tree, state: str) -> None:
        self.tree, self.state = tree, state.rstrip("/")

    def _store(self):
        from pyarrow import fs

        handle, inner, _ = _handle(self.state)
        handle.create_dir(inner, recursive=True)
        return handle, inner

    def _versions(self) -> list[int]:
        handle, inner = self._store()
        names = [e.base_name for e in self.tree.listing(handle, inner)]
        return sorted(int(n[9:-5]) for n in names if re.fullmatch(r"snapshot-\d+\.json", n))

    def _load(self, version: int) -> dict:
        if not version:
            return {}
        handle, inner = self._store()
        with handle.open_input_stream(f"{inner}/snapshot-{version:020d}.json") as stream:
            return json.loads(stream.read())

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        versions = self._versions()
        last = versions[-1] if versions else 0
        now = self.tree.snapshot()
        if now == self._load(last):
            return {"version": last}
        handle, inner = self._store()
        with handle.open_output_stream(f"{inner}/snapshot-{last + 1:020d}.json") as stream:
            stream.write(json.dumps(now).encode())
        return {"version": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self._load(start["version"]), self._load(end["version"])
        changed = sorted(p for p, facts in after.items() if before.get(p) != facts)
        roots = self.tree.roots
        owner = [next((r for r in roots if p.startswith(r.rstrip("/") + "/")), roots[0])
                 for p in changed]
        work = list(zip(changed, owner))
        count = max(1, min(self.tree.tasks, len(work)))
        return [InputPartition(json.dumps(work[i::count])) for i in range(count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for shown, root in json.loads(partition.value):
            yield _read_file(shown, root)

    def commit(self, end: dict) -> None:
        """Snapshots older than the committed one are no longer needed."""
        handle, inner = self._store()
        for version in self._versions():
            if version < end["version"]:
                handle.delete_file(f"{inner}/snapshot-{version:020d}.json")


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SourceTreeReader(_Tree(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        options = dict(self.options)
        if not options.get("state"):
            raise ValueError("A source tree stream needs a 'state' folder all restarts share")
        return SourceTreeStreamReader(_Tree(options), options["state"])


def read_tree(
    spark: SparkSession,
    roots: str | Sequence[str],
    *,
    recursive: bool = False,
    exclude: Sequence[str] = (),
    suffix: str = ".py",
) -> DataFrame:
    """``DF(path, content, read_error)`` of the files below ``roots``, read by the data source.

    The same files as ``read_sources(scan_sources(...))`` for folders, with the same
    rules; roots may also be URIs of any store that ``pyarrow.fs`` opens. Filters on
    ``path`` (``startswith``, ``endswith``) reach the reader.
    """
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    roots = [roots] if isinstance(roots, str) else list(roots)
    tasks = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
    return (
        spark.read.format(NAME)
        .option("paths", json.dumps(roots))
        .option("recursive", str(recursive).lower())
        .option("exclude", json.dumps(list(exclude)))
        .option("suffix", suffix)
        .option("tasks", str(tasks))
        .load()
    )


def read_tree_stream(
    spark: SparkSession,
    roots: str | Sequence[str],
    state: str,
    *,
    recursive: bool = False,
    exclude: Sequence[str] = (),
    suffix: str = ".py",
) -> DataFrame:
    """A stream of ``(path, content, read_error)``: files that are new or changed since the
    last trigger. ``state`` keeps the snapshots; give the same folder on every restart,
    e.g. beside the checkpoint."""
    spark.dataSource.register(SourceTree)
    tasks = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
    roots = [roots] if isinstance(roots, str) else list(roots)
    return (
        spark.readStream.format(NAME)
        .option("paths", json.dumps(roots))
        .option("state", state)
        .option("recursive", str(recursive).lower())
        .option("exclude", json.dumps(list(exclude)))
        .option("suffix", suffix)
        .option("tasks", str(tasks))
        .load()
    )
