"""Designs from formulas: `y ~ a + log(b) * C(c) + I(d^2) - 1` as named columns, in the order of the formula.

Terms are joined by `+` (a term taken out again by `-`); `a:b` is a product, `a*b` stands for `a + b + a:b`, `(a + b)^2` for all terms
and products of up to two of them. A factor is a column, a number to a power (`a^3` within `I()`), a function of a column (log, sqrt, exp, abs, sin,
cos), an expression in `I()`, or `C(c)`: a 0/1 column for each level but the first, or for each in the first categorical term of a
formula without intercept. Text columns are categories by themselves. An intercept comes first unless `- 1` or `+ 0` is there. Levels are
in ascending order; they are found in the data (at most `most` of them) or given.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"log": F.log, "sqrt": F.sqrt, "exp": F.exp, "abs": F.abs, "sin": F.sin, "cos": F.cos}
TOKEN = re.compile(r"\s*(?:(?P<call>[A-Za-z_]\w*)\((?P<inside>[^()]*)\)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<number>\d+)|(?P<sign>\*\*|[-+*:^()]))")
Term = tuple[str, ...]


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the formula at: {text[at:]}")
        out.append("^" if m["sign"] == "**" else m[0].strip())
        at = m.end()
    return out


def _unique(terms: Sequence[Term]) -> list[Term]:
    return list(dict.fromkeys(terms))


def _crossed(a: Sequence[Term], b: Sequence[Term]) -> list[Term]:
    """All products of a term of either; a factor times itself is itself, and the order of factors doesn't tell terms apart."""
    return _unique([tuple(sorted(set(x) | set(y))) for x, y in product(a, b)])


def terms(text: str) -> tuple[list[Term], bool]:
    """The terms of a formula's right side, main effects before products, and whether it has an intercept."""
    tokens, at = _tokens(text), 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def factor() -> list[Term]:
        token = take()
        if token == "(":
            out = total()[0]
            if take() != ")":
                raise ValueError("a bracket isn't closed")
        elif token and token not in "+-*:^)":
            out = [()] if token == "1" else [] if token == "0" else [(token,)]
        else:
            raise ValueError(f"a term is missing before {token or 'the end'}")
        if peek() == "^":
            take()
            n = take()
            if not n.isdigit() or not int(n):
                raise ValueError("a power is a number from 1 on")
            out = _unique([tuple(sorted(set().union(*some))) for k in range(1, int(n) + 1) for some in combinations(out, k)])
        return out

    def products() -> list[Term]:
        out = factor()
        while peek() == ":":
            take()
            out = _crossed(out, factor())
        return out

    def crossings() -> list[Term]:
        out = products()
        while peek() == "*":
            take()
            more = products()
            out = _unique([*out, *more, *_crossed(out, more)])
        return out

    def total() -> tuple[list[Term], bool]:
        out, one, sign = [], True, "+"
        if peek() == "-":
            sign = take()
        while True:
            zero = peek() == "0"
            some = crossings()
            if zero or (sign == "-" and () in some):
                one = sign == "-" if zero else False
            elif () in some:
                one = True
            some = [t for t in some if t]
            out = _unique([*out, *some]) if sign == "+" else [t for t in out if t not in some]
            if peek() not in ("+", "-"):
                return out, one
            sign = take()

    out, one = total()
    if at < len(tokens):
        raise ValueError(f"can't read the formula at: {peek()}")
    return sorted(out, key=len), one


def _number(factor: str) -> Column:
    m = re.fullmatch(r"([A-Za-z_]\w*)\((.*)\)", factor)
    if not m:
        return F.col(factor).cast("double")
    name, inside = m[1], m[2].strip()
    if name == "I":
        return F.expr(re.sub(r"([A-Za-z_]\w*|\d+(?:\.\d+)?)\s*(?:\^|\*\*)\s*(\d+)", r"power(\1, \2)", inside)).cast("double")
    if name not in FUNCTIONS:
        raise ValueError(f"unknown function {name}; known: {', '.join(FUNCTIONS)}")
    return FUNCTIONS[name](F.col(inside).cast("double"))


def design(df: DataFrame, formula: str, levels: dict[str, Sequence] | None = None, most: int = 1000) -> tuple[dict[str, Column], Column | None]:
    """(columns by name, the target or None) of a formula for df."""
    left, _, right = formula.rpartition("~")
    wanted, one = terms(right)
    kinds, known = dict(df.dtypes), dict(levels or {})
    category = {f: (m[1].strip() if (m := re.fullmatch(r"C\((.*)\)", f)) else f) for t in wanted for f in t if f.startswith("C(") or kinds.get(f) in ("string", "boolean")}
    missing = [c for c in dict.fromkeys(category.values()) if c not in known]
    if missing:  # one pass for all of them
        found = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in missing]).first()
        known |= {c: found[c] for c in missing}
    for c in category.values():
        if len(known[c]) > most:
            raise ValueError(f"{c} has {len(known[c])} levels, more than {most}")
    columns: dict[str, Column] = {"Intercept": F.lit(1.0)} if one else {}
    whole = not one  # the first categorical main effect keeps all levels where there is no intercept

    for term in wanted:
        parts = []
        for f in term:
            if f in category:
                c, full = category[f], whole and len(term) == 1
                whole = whole and not full
                parts.append([(f"{f}[{v}]", F.when(F.col(c) == F.lit(v), 1.0).when(F.col(c).isNotNull(), 0.0)) for v in (known[c] if full else known[c][1:])])
            else:
                parts.append([(f, _number(f))])
        for some in product(*parts):
            value = some[0][1]
            for _, c in some[1:]:
                value = value * c
            columns[":".join(n for n, _ in some)] = value
    return columns, _number(left.strip()) if left.strip() else None
