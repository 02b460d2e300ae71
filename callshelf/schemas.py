"""Table shapes. Everything is fixed; nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, BIGINT, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
STRINGS = T.ArrayType(STR)

SOURCES = T.StructType(
    [
        T.StructField("path", STR, False),
        T.StructField("content", STR),
        T.StructField("read_error", STR),
    ]
)

# What the syntax-tree worker hands back: one row per file (``path``, ``error`` if it does
# not parse, the rest null) and one row per top-level definition.
DEFINITIONS = T.StructType(
    [
        T.StructField("path", STR, False),
        T.StructField("line_number", INT),
        T.StructField("keyword", STR),
        T.StructField("name", STR),
        T.StructField("parts", STRINGS),
        T.StructField("returns", STR),
        T.StructField("has_yield", BOOL),
        T.StructField("docstring", STR),
        T.StructField("source_code", STR),
        T.StructField("decorators", STRINGS),
        T.StructField("error", STR),
        # the place of the file's row among the sources: when it came, and what is in it
        T.StructField("arrival", STR),
        T.StructField("twin", BIGINT),
    ]
)

CODES = T.StructType(
    [
        T.StructField("cid", STR, False),
        T.StructField("version_cid", STR, False),
        T.StructField("signature", STR),
        T.StructField("docstring", STR),
        T.StructField("computer_code", STR, False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("cid", STR, False),
        T.StructField("code_cid", STR, False),
        T.StructField("code_name", STR),
        T.StructField("code_type", STR),
        T.StructField("is_test", BOOL),
        T.StructField("file_path", STR),
        T.StructField("tags", STRINGS),
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("version", BIGINT, False),
        T.StructField("is_base", BOOL, False),
        T.StructField("batch_id", STR),
        # the folder of the run's rows, and the runs whose rows it holds anew
        T.StructField("run", STR, False),
        T.StructField("folds", STRINGS),
    ]
)
