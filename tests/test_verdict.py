from __future__ import annotations

import pytest

from callshelf.operators.entries import valid_callables, with_reject_reason

DOC = "Documented."


def case(verdict, name, *, kind="function", doc=DOC, code=None, signature=None, decorators=()):
    signature = signature or (f"class {name}:" if kind == "class" else f"def {name}(x):")
    return verdict, (name, kind, signature, doc, code or signature, list(decorators))


CASES = [
    case(None, "add_up"),
    case(None, "Worker", kind="class"),
    case(None, "Child", kind="class", signature="class Child(Base):"),
    case("no_docstring", "f", doc=None),
    case("no_docstring", "f", doc=""),
    case("no_docstring", "f", doc="   \n\t  \r\n   "),
    case("no_docstring", "f", doc="  \x1f"),
    case("not_standalone", "inner", code="    def inner(x):\n        return x"),
    case("not_standalone", "inner", code="\tdef inner(x): pass"),
    case("not_standalone", "Inner", kind="class", code="    class Inner:\n        pass"),
    case("not_standalone", "Inner", kind="class", code="    class Inner (Base):\n        pass"),
    case("not_standalone", "method", signature="def method(self, x):"),
    case("not_standalone", "make", signature="def make(cls):"),
    case(None, "selfish", signature="def selfish(self_test):"),
    case(None, "swapped", signature="def swapped(x, self):"),
    case("not_standalone", "<lambda>", doc=None, signature="lambda x: x"),
    case(None, "fetch", signature="async def fetch(x):"),
    case("not_standalone", "fetch", signature="async def fetch(self):"),
    # the first parameter is looked at for type function only
    case(None, "fetch", kind="coroutine", signature="async def fetch(self):"),
    case(None, "walk", kind="generator", signature="def walk(self):"),
    case("not_standalone", "walk", kind="generator", code="  def walk(self): yield"),
    case("not_standalone", "f", decorators=["staticmethod"]),
    case("not_standalone", "f", decorators=["cached", "classmethod"]),
    case("not_standalone", "f", decorators=["property"]),
    case(None, "f", decorators=["f.setter", "staticmethod()", "abc.staticmethod"]),
    # docstring comes before decorators
    case("no_docstring", "f", doc=" ", decorators=["staticmethod"]),
    # only the first line with the definition counts
    case(None, "f", code="@deco\ndef f(x):\n    def f(y): pass"),
    case("not_standalone", "f", code="@deco(\n    'def f(x)'\n)\ndef f(x): pass"),
    case(None, "f", code="x = 1"),
    case(None, "f", code="    def f2(x): pass\n    def ff(x): pass\ndef f(x): pass"),
    case("not_standalone", "f", code="  undef  f  (x)\ndef f(x): pass"),
    case("not_standalone", "größe", signature="def größe(self):"),
    case(None, "f", signature="def f():"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    schema = (
        "n int, name string, type string, signature string, docstring string, "
        "source_code string, decorators array<string>"
    )
    rows = [(i, *fields) for i, (_, fields) in enumerate(CASES)]
    df = with_reject_reason(spark.createDataFrame(rows, schema))
    kept = {r.n for r in valid_callables(df).collect()}
    return {r.n: r.reject_reason for r in df.collect()}, kept


@pytest.mark.parametrize("n", range(len(CASES)))
def test_verdict(verdicts, n):
    reasons, kept = verdicts
    assert reasons[n] == CASES[n][0], CASES[n]
    assert (n in kept) == (CASES[n][0] is None)
