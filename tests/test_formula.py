"""Formulas: terms, levels and columns."""

import pytest

from cohortry.operators import formula


@pytest.mark.parametrize(("text", "want"), [
    ("a + b", ([("a",), ("b",)], True)), ("a*b", ([("a",), ("b",), ("a", "b")], True)), ("a:b + a - 1", ([("a",), ("a", "b")], False)), ("0 + a", ([("a",)], False)), ("(a + b + c)^2 - a:b", ([("a",), ("b",), ("c",), ("a", "c"), ("b", "c")], True)),
    ("a*b*c", ([("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")], True)), ("a + a + b:a + a:b", ([("a",), ("a", "b")], True)), ("log(a) + I(b**2) + C(k):a", ([("log(a)",), ("I(b**2)",), ("C(k)", "a")], True)), ("1", ([], True)), ("a:a", ([("a",)], True)),
])
def test_terms(text, want):
    assert formula.terms(text) == want


@pytest.mark.parametrize("text", ["a +", "a b", "(a", "a ~ b ~", "a:*b", "a ^ b", "a & b", ")"])
def test_errors(text):
    with pytest.raises(ValueError):
        formula.terms(text)


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 2, "x", True, 5.0), (4.0, 3, "z", False, 6.0), (9.0, None, "y", True, 7.0), (1.0, 1, None, True, 8.0)], "a double, b int, k string, t boolean, y double")
    columns, y = formula.design(df, "y ~ sqrt(a) + I(b^2 + 1) + k*a")
    assert list(columns) == ["Intercept", "sqrt(a)", "I(b^2 + 1)", "k[y]", "k[z]", "a", "a:k[y]", "a:k[z]"]
    rows = [tuple(r) for r in df.select(*columns.values(), y).collect()]
    assert rows[0] == (1.0, 1.0, 5.0, 0.0, 0.0, 1.0, 0.0, 0.0, 5.0) and rows[1] == (1.0, 2.0, 10.0, 0.0, 1.0, 4.0, 0.0, 4.0, 6.0) and rows[2][2] is None and rows[3][3] is None
    assert list(formula.design(df, "k + t - 1")[0]) == ["k[x]", "k[y]", "k[z]", "t[True]"]
    assert list(formula.design(df, "C(b)", {"b": [1, 2, 3]})[0]) == ["Intercept", "C(b)[2]", "C(b)[3]"] and formula.design(df, "C(b)")[1] is None
    for bad, why in (("k", "more than"), ("nope(a)", "unknown function")):
        with pytest.raises(ValueError, match=why):
            formula.design(df, bad, most=2)
