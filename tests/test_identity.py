from __future__ import annotations

import base64
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callshelf.functions import identity
from callshelf.operators.entries import constraint_error


def plain_cid(text: str) -> str:
    digest = bytes([0x01, 0x55, 0x12, 0x20]) + hashlib.sha256(text.encode()).digest()
    return "b" + base64.b32encode(digest).decode().lower().rstrip("=")


def test_cid_is_that_of_hashlib(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=50, max_size=200))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for row in df.select("t", identity.cid(F.col("t")).alias("cid")).collect():
            assert row.cid == plain_cid(row.t)
            assert re.fullmatch("bafk[a-z2-7]{55}", row.cid)

    check()


def test_signature_shape(spark):
    cases = {
        "def area(w: float, h: float) -> float:": "(w: float, h: float) -> float:",
        "class Empty:": "",
        "class Child(Parent, Mixin):": "(Parent, Mixin):",
        "async def load(key: bytes) -> list[Any]:": "(key: bytes) -> list[Any]:",
        "def no_parenthesis": "def no_parenthesis",
        "class Nothing": "class Nothing",
        "class A: (x)": "",
        "lambda x: x": "lambda x: x",
        "def f(x: 'a\nb'):": "(x: 'a\nb'):",
        "": "",
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    shapes = df.select("s", identity.signature_shape(F.col("s")).alias("shape"))
    got = {r.s: r.shape for r in shapes.collect()}
    assert got == cases


def test_first_line(spark):
    cases = {"One": "One", "  One \nTwo": "One", "\nTwo": "", "": "", " x\x1f\ny": "x"}
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "d string")
    got = {r.d: r.f for r in df.select("d", identity.first_line(F.col("d")).alias("f")).collect()}
    assert got == {**cases, None: ""}


def test_code_text_and_interface_text(spark):
    df = spark.createDataFrame(
        [("def f(x):", None, "body", "function", "a/b.py")],
        "s string, d string, c string, t string, p string",
    )
    s, d, c, t, p = (F.col(x) for x in "sdctp")
    row = df.select(
        identity.code_text(s, d, c).alias("code"),
        identity.interface_text(s, d, t, p).alias("interface"),
    ).first()
    assert tuple(row) == ("def f(x):body", "(x):functiona/b.py")


def test_constraints(spark):
    cases = [
        (("c", "v", "s", "d", "x", "function"), None),
        (("c", "v", "s", None, "x", "generator"), None),
        (("c", "v", "s", "d", None, "class"), "Column 'computer_code' cannot be null"),
        (("c" * 256, "v", "s", "d", "x", "class"), "Data too long for column 'cid'"),
        (("c", "v", "s" * 65536, "d", "x", "class"), "Data too long for column 'signature'"),
        (("c", "v", "s", "é" * 32768, "x", "class"), "Data too long for column 'docstring'"),
        (("c", "v", "s", "d", "x" * 65535, "class"), None),
        (("c", "v", "s", "d", "x" * 65536, "class"), "Data too long for column 'computer_code'"),
        (("c", "v", "s", "d", "x", "method"), "Data truncated for column 'code_type'"),
    ]
    schema = (
        "n int, cid string, code_cid string, signature string, docstring string, "
        "source_code string, type string"
    )
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], schema)
    got = dict(df.select("n", constraint_error(text_max_bytes=65535).alias("e")).collect())
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    # without a stated limit texts may have any size; the other rules stay
    unlimited = dict(df.select("n", constraint_error().alias("e")).collect())
    sized = {i for i, c in enumerate(cases) if c[1] and c[1].startswith("Data too long") and i != 3}
    assert [unlimited[i] for i in range(len(cases))] == [
        None if i in sized else c[1] for i, c in enumerate(cases)
    ]
