"""A pocket calculator's operations as column expressions, and its keys as a fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import display_float, show

#: What the display says when there is no number to show, and its limits.
ZERO_DIVISION = "Cannot divide by zero"
TOO_LARGE = "Result too large"
MOST, MOST_DIGITS = 1e100, 15
SYMBOLS = {"+": "+", "-": "−", "*": "×", "/": "÷"}


def applied(a: Column, op: Column, b: Column) -> Column:
    """a op b; null where it divides by zero or op is unknown."""
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b))


def computed(a: Column, op: Column, b: Column) -> Column:
    """struct(value, error): the result, or what the display says instead."""
    r = applied(a, op, b)
    error = F.when((op == "/") & (b == 0), F.lit(ZERO_DIVISION)).when(F.abs(r) > MOST, F.lit(TOO_LARGE))
    return F.struct(F.when(error.isNull(), r).alias("value"), error.alias("error"))


def percentage(x: Column) -> Column:
    return x / 100


def symbol(op: Column) -> Column:
    """How an operator is shown; unknown ones as they are."""
    table = F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, op), op)


def shown(x: Column) -> Column:
    return display_float(x)


def _typed(shown: str, key: str) -> str:
    """What a digit or dot makes of the number on the display."""
    if key == ".":
        return shown if "." in shown else shown + "."
    if shown == "0":
        return key
    return shown + key if sum(c.isdigit() for c in shown) < MOST_DIGITS else shown


def _calculate(a: float, op: str, b: float) -> tuple[float, str | None]:
    if op == "/" and b == 0:
        return 0.0, ZERO_DIVISION
    r = {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "/": a.__truediv__}[op](b)
    return (r, None) if abs(r) <= MOST else (0.0, TOO_LARGE)


def press(keys: list[str]) -> str:
    """What the display shows after the keys: digits, dot, + - * /, =, %, ~ (sign), < (backspace), C.

    Operators chain from the left without precedence. After an error any key starts anew.
    """
    fresh_state = ("0", None, None, "digit", None)
    shown, held, op, last, error = fresh_state
    for key in keys:
        if error or key == "C":
            shown, held, op, last, error = fresh_state
            if key in "C=":
                continue
        if key in "+-*/=":
            if (key == "=" or last != "op") and op is not None:
                value, error = _calculate(held, op, float(shown))
                shown, held, op, last = show(value), None, None, "equals"
            if error:
                shown = "Error"
            elif key != "=":
                shown, held, op, last = "0", float(shown), key, "op"
            continue
        if key == "<":
            if last == "equals":
                shown, held, op, last = "0", None, None, "digit"
            elif last != "op":
                shown, last = (shown[:-1] if len(shown) > 1 else "0"), "digit"
            continue
        if key == "%":
            shown = show(float(shown) / 100)
        elif key == "~":
            if shown.startswith("-"):
                shown = shown[1:]
            elif shown != "0" and len(shown) < MOST_DIGITS:
                shown = "-" + shown
        elif last in ("equals", "op"):
            shown = "0." if key == "." else key
        else:
            shown = _typed(shown, key)
        last = "digit"
    return error or shown


def display(keys: Column) -> Column:
    """press() over an array of keys."""
    return F.udf(lambda k: None if k is None else press(k), "string", useArrow=True)(keys)
