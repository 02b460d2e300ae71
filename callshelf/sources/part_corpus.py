"""A table of Python source files that Spark derives from ``part``.

Ten parts make one file, each part one callable. The kind of a callable follows from
``p_partkey``, so expected results can be stated in SQL on ``part`` alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callshelf.session import parallelism

BASE = "/srv/shop"
FOLDERS = ["src", "tests", "billing_api", "tools-lib"]
BROKEN_EVERY = 17
HEADER = '"""Parts."""\nimport shop\n\n\n'

# One template per kind; {k} part key, {f} file number, {doc} name and brand, {size}
# and {rev}, the revision of the body.
TEMPLATES = [
    'def part_{k}(size: int, names: list[str] = None, *rest: str, exact: bool = False,'
    ' **extra: Any) -> str:\n'
    '    """Parts of file {f}.\n\n    {doc}\n    """\n'
    "    return 'part {k} rev {rev}'",
    'class Part{k}(shop.Base, metaclass=Meta):\n'
    '    """{doc}"""\n\n'
    "    def price(self):\n"
    '        """Not listed."""\n'
    "        return {size} * {rev}",
    "async def fetch_shared(session: Session) -> dict[str, Any]:\n"
    '    """\n    Fetch what all files share.\n    """\n'
    "    return await session.get({rev})",
    "def walk_{k}(limit=None, /, step: int = {size}, *, label):\n"
    '    """{doc}"""\n'
    "    for i in range({rev}, limit, step):\n"
    "        yield i, label",
    "def bare_{k}(size):\n    return size + {rev}",
    'def blank_{k}(size):\n    """   """\n    return size + {rev}',
    'def method_{k}(self, size: int):\n    """{doc}"""\n    return size + {rev}',
    "@staticmethod\n"
    "@shop.route('/part/{k}', methods=['GET', \"POST\"])\n"
    'def route_{k}(size: int):\n    """{doc}"""\n    return size + {rev}',
    "def renamed_{k}(size: int, names: list[str] = (), *rest: str, exact: bool = True,"
    " **extra: Any) -> str:\n"
    '    """Parts of file {f}.\n\n    Second of its kind.\n    """\n'
    "    return 'part {k} rev {rev}'",
    'def test_part_{k}():\n    """{doc}"""\n    assert {size} + {rev}',
]


def write_tree(corpus: DataFrame, root: str) -> int:
    """Write ``corpus(path, content)`` as files below ``root``, a folder that all executors
    mount, with what a scan must cope with: an empty ``__init__.py`` and a file in an excluded
    folder beside each file, and one file that is no UTF-8. Returns the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(i).to_pylist() for i in range(2))):
                place = root + path.removeprefix(BASE)
                folder = os.path.dirname(place)
                os.makedirs(f"{folder}/__pycache__", exist_ok=True)
                for name, data in (
                    (place, content.encode()),
                    (f"{folder}/__init__.py", b""),
                    (f"{folder}/__pycache__/{os.path.basename(place)}", content.encode()),
                    (f"{root}/latin.py", "# caf\xe9\n".encode("latin-1")),
                ):
                    # a task that runs again writes the same
                    with open(name, "wb") as file:
                        file.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = corpus.select("path", "content").mapInArrow(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


_SEPARATOR = "\x1f"


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.split(F.lit(_SEPARATOR.join(values)), _SEPARATOR), number.cast("int"))


def part_corpus(spark: SparkSession, sf_dir: str, revision: int = 1) -> DataFrame:
    """``DF(path, content)``. A second revision changes all bodies and no interface."""
    key, file = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    kind = F.pmod(key, F.lit(10))
    values = {
        "k": key,
        "f": F.col("file"),
        "doc": F.concat_ws(" ", "p_name", "p_brand"),
        "size": F.col("p_size"),
        "rev": F.lit(revision),
    }
    text = _pick(TEMPLATES, kind)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    folder = _pick(FOLDERS, F.pmod(F.col("file"), F.lit(len(FOLDERS))))
    broken = F.when(
        F.pmod(F.col("file"), F.lit(BROKEN_EVERY)) == 0,
        F.concat(F.lit("\n\n\ndef broken_"), F.col("file").cast("string"), F.lit("(:\n")),
    ).otherwise("\n")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return (
        parts.select(key, file.alias("file"), "p_name", "p_brand", "p_size")
        .select("p_partkey", "file", text.alias("text"))
        # the number is given, so that small inputs are not merged into one parsing task
        .repartition(parallelism(spark), "file")
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))).alias("members"))
        .select(
            F.concat(
                F.lit(BASE + "/"), folder, F.lit("/parts_of_"), F.col("file"), F.lit(".py")
            ).alias("path"),
            F.concat(
                F.lit(HEADER), F.array_join("members.text", "\n\n\n"), broken
            ).alias("content"),
        )
    )
