"""The expression compiler against Python itself, on random rows."""

import math
import random

import pytest

from tessera.functions.expressions import ExpressionError, Node, RowProxy, column, conjuncts, is_attribute, names, parse, trace
from tessera.functions.types import FieldType, parse_type
from tessera.plans.builder import resolver

EXPRESSIONS = [
    "a + b * 2 - 3", "a / 7", "a // 7", "a // -7", "a % 7", "a % -7", "x // 2.5", "-a ** 2", "a < b", "0 <= a < b <= 50", "a == 3 or b != 4 and not a > 2",
    "a in (1, 2, 3)", "a not in (1, 2)", "abs(a) + max(a, b) - min(a, b, 3)", "round(x)", "round(x, 1)", "math.sqrt(abs(x))", "math.floor(x) + math.ceil(x)", "int(x)",
    "float(a) / 3", "len(s)", "s == 'ab'", "1 if a > b else 2", "x <= 0.06 + 0.01", "True", "+a", "a if a else b",
]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-30, 60), rng.randint(-30, 60), rng.choice([0.07, 0.06999999999999999, rng.uniform(-9, 9), -2.5, 0.5, 1.5]), rng.choice(["ab", "", "abc"])) for _ in range(200)]
    return rows, spark.createDataFrame(rows, "a int, b int, x double, s string")


@pytest.mark.parametrize("text", [e for e in EXPRESSIONS if e != "a if a else b"])
def test_compiled_equals_python(numbers, text):
    rows, df = numbers
    got = [r[0] for r in df.select(column(parse(text), resolver(df))).collect()]
    for (a, b, x, s), value in zip(rows, got, strict=True):
        expected = eval(text, {"math": math}, {"a": a, "b": b, "x": x, "s": s})  # noqa: S307 - the oracle
        if isinstance(expected, (bool, str)):
            assert value == expected, (text, a, b, x, s)
        else:
            assert value == pytest.approx(expected, abs=1e-9), (text, a, b, x, s)


def test_whole_numbers_stay_whole(spark):
    values = [9007199254740993, -9007199254740993, 7, -7, 0, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "a long")
    for text in ("a // 1", "a // 7", "a // -7", "a // 1000003", "(a % 1000) ** 3", "a % 7"):
        got = [r[0] for r in df.select(column(parse(text), resolver(df))).collect()]
        assert got == [eval(text, {"a": a}) for a in values] and all(isinstance(x, int) for x in got)  # noqa: S307 - the oracle


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "lambda: 1", "a +", "open('x')", "[a for a in b]", "a in b", "a is None"])
def test_other_syntax_is_refused(numbers, text):
    _, df = numbers
    with pytest.raises(ValueError):
        column(parse(text), resolver(df))


def test_conjuncts_names_and_attributes():
    assert len(conjuncts(parse("a == 1 and b < 2 and (c or d)"))) == 3
    assert names(parse("math.sqrt(a + B) > 1 and c in (1,)")) == {"a", "B", "c"}
    assert is_attribute(parse("a")) and not is_attribute(parse("a + 1"))


def test_traced_lambdas_branch(numbers):
    rows, df = numbers
    for f in (lambda e: max(e.a, e.b), lambda e: e.a % 3 if e.a > 0 else -e.b, lambda e: (e.a, e.b)[1], lambda e: min(e.a, 5, e.b)):
        got = [r[0] for r in df.select(column(trace(f, RowProxy()), resolver(df))).collect()]
        assert got == [f(type("R", (), {"a": a, "b": b})) for a, b, *_ in rows]
    with pytest.raises(ExpressionError):
        bool(Node("name", ("a",)))


def test_type_descriptors():
    assert parse_type("char(25)") == FieldType("char", 25) and parse_type(" int ") == FieldType("int")
    assert [parse_type(x) for x in ("char", "int(4)", "char(3)x", "date", "")] == [None] * 5
    assert FieldType("char", 3).parse("abcd") == "abc" and FieldType("char", 3).parse("a") == "a\0\0"
    assert FieldType("double").parse("1.5") == 1.5 and FieldType("int").default == 0 and FieldType("text", 4).default == ""
    for kind, value in (("byte", 256), ("short", 40000), ("int", 2**31), ("int", None)):
        with pytest.raises(ValueError):
            parse_type(kind).check(value)
