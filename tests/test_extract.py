from __future__ import annotations

from textwrap import dedent

import pytest

from callshelf.operators.extract import callables_only, extract_callables, parse_errors


@pytest.fixture(scope="module")
def extract(spark):
    """Extract a list of texts in one job; a list of row lists comes back."""

    def run(*texts: str):
        files = [(f"/f{i}.py", dedent(text)) for i, text in enumerate(texts)]
        sources = spark.createDataFrame(files, "path string, content string")
        df = callables_only(extract_callables(sources))
        rows = df.orderBy("path", "line_number").collect()
        return [[r for r in rows if r.path == path] for path, _ in files]

    return run


def test_record_shape(extract):
    ((row,),) = extract(
        '''\
        def label(part: str) -> str:
            """Text for a shelf."""
            return f"Shelf {part}"
        '''
    )
    assert row.asDict() == {
        "path": "/f0.py",
        "name": "label",
        "type": "function",
        "signature": "def label(part: str) -> str:",
        "docstring": "Text for a shelf.",
        "source_code": 'def label(part: str) -> str:\n    """Text for a shelf."""\n'
        '    return f"Shelf {part}"',
        "line_number": 1,
        "is_async": False,
        "decorators": [],
    }


def test_types(extract):
    (rows,) = extract(
        '''\
        class A(Base, metaclass=Meta):
            """Doc."""
            def method(self): yield 1
        class B: pass
        async def c(): pass
        async def d(): yield 1
        def e(): yield
        def f():
            def inner():
                yield from g()
        def g(): return lambda: 0
        '''
    )
    assert [(r.name, r.type, r.is_async) for r in rows] == [
        ("A", "class", False),
        ("B", "class", False),
        ("c", "coroutine", True),
        ("d", "coroutine", True),
        ("e", "generator", False),
        ("f", "generator", False),
        ("g", "function", False),
    ]
    assert rows[0].signature == "class A(Base):"
    assert rows[1].signature == "class B:"
    assert rows[2].signature == "async def c():"


def test_only_the_module_body(extract):
    (rows,) = extract(
        """\
        half = lambda weight: weight / 2
        if True:
            def hidden(): pass
        try:
            class Hidden: pass
        except Exception:
            pass
        def outer():
            def inner(): pass
            return inner
        """
    )
    assert [r.name for r in rows] == ["outer"]


def test_signatures(extract):
    (rows,) = extract(
        """\
        def a(x, y=1, *args: int, z: str = "q", w, **kw: Any): pass
        def b(p, /, q, *, r): pass
        def c[T](x: T) -> list[T]: pass
        def d(x: Optional[Dict[str, int]], f: Callable[[int], str]) -> "Tree": pass
        def e(x: None = None, y: ... = 1) -> a.b.C: pass
        def f(x: lambda: 0, y: (1, 2)) -> int | None: pass
        class G(a.B, Generic[T], make("x", k=[1, 'y'], **opts)): pass
        class H(*bases): pass
        """
    )
    assert [r.signature for r in rows] == [
        "def a(x, y, *args: int, z: str, w, **kw: Any):",
        "def b(q, r):",
        "def c(x: T) -> list[T]:",
        "def d(x: Optional[Dict[str, int]], f: Callable[[int], str]) -> 'Tree':",
        "def e(x: None, y: Ellipsis) -> a.b.C:",
        "def f(x: lambda: 0, y: (1, 2)) -> int | None:",
        "class G(a.B, Generic[T], make('x', k=[1, 'y'], None=opts)):",
        "class H(*bases):",
    ]


def test_decorators_and_line_numbers(extract):
    (rows,) = extract(
        '''\
        import os

        def first(): pass


        X = 1

        @staged
        @counted
        def second():
            """Doc."""
            return 1

        @shop.page("/parts", verbs=["READ", "LIST"])
        def third(): pass

        @wrap("it's", b"x", 1.5, True, not_a_list=(1,))
        class Fourth: pass
        '''
    )
    assert [r.line_number for r in rows] == [3, 8, 14, 17]
    assert [r.decorators for r in rows] == [
        [],
        ["staged", "counted"],
        ["shop.page('/parts', verbs=['READ', 'LIST'])"],
        ["wrap('it's', b'x', 1.5, True, not_a_list=(1,))"],
    ]
    assert rows[1].source_code.startswith("@staged\n@counted\ndef second():")
    assert rows[2].source_code.endswith("def third(): pass")


def test_docstrings(extract):
    (rows,) = extract(
        '''\
        def a():
            """
            Two
              lines
            """
        def b():
            """First on the quote line.

            Second.
            """
        def c(): "single"
        def d():
            x = 1
            """Not one."""
        def e(): f"{1}"
        def f(): b"bytes"
        def g(): ""
        def h(): 5
        '''
    )
    assert [r.docstring for r in rows] == [
        "Two\n  lines",
        "First on the quote line.\n\n    Second.",
        "single",
        None,
        None,
        None,
        "",
        None,
    ]


def test_line_ends_and_odd_separators(extract):
    windows, mac, feed = extract(
        "def a():\r\n    '''One\r\n    two'''\r\n",
        "x = 1\rdef b(): pass\r",
        "def c():\n    x = '\x0c'\n    return 1\n",
    )
    assert windows[0].source_code == "def a():\n    '''One\n    two'''"
    assert windows[0].docstring == "One\n    two"
    assert (mac[0].name, mac[0].line_number) == ("b", 2)
    # a form feed counts as a line end for the slice, not for the parser
    assert feed[0].source_code == "def c():\n    x = '\n'"


def test_non_ascii(extract):
    ((row,),) = extract("def café(größe): 'Ü'")
    assert (row.name, row.signature, row.docstring) == ("café", "def café(größe):", "Ü")


def test_empty_files_give_nothing(extract):
    assert extract("", "  \n\n", "# only a comment\nx = 1\n") == [[], [], []]


def test_errors_are_rows(spark, sources):
    files = {
        "/ok.py": "def fine(): pass",
        "/broken.py": "def fine(): pass\ndef broken(:\n",
        "/null.py": "x = '\0'",
        "/bom.py": "﻿def a(): pass",
        "/deep.py": "(" * 5000 + ")" * 5000,
        "/loose.py": 'def a(): "\\ud800"',
    }
    extracted = extract_callables(sources(files)).cache()
    assert [r.name for r in callables_only(extracted).collect()] == ["fine"]
    errors = {r.path: r.error for r in parse_errors(extracted).collect()}
    assert set(errors) == set(files) - {"/ok.py"}
    assert errors["/broken.py"].startswith("Syntax error in /broken.py: ")
    assert "line 2" in errors["/broken.py"]


def test_read_errors_pass_through(spark):
    df = spark.createDataFrame(
        [("/a.py", None, "No such file"), ("/b.py", "def b(): pass", None)],
        "path string, content string, read_error string",
    )
    extracted = extract_callables(df)
    assert [tuple(r) for r in parse_errors(extracted).collect()] == [("/a.py", "No such file")]
    assert [r.name for r in callables_only(extracted).collect()] == ["b"]


def test_more_rows_than_one_batch(spark, sources):
    text = "\n".join(f"def f{i}(): pass" for i in range(5000))
    extracted = extract_callables(sources({"/many.py": text, "/empty.py": ""}))
    assert callables_only(extracted).count() == 5000
    # every file has one row of its own
    assert [r.path for r in extracted.where("name is null").orderBy("path").collect()] == [
        "/empty.py", "/many.py",
    ]
