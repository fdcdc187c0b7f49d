"""Relative dates, arithmetic expressions, templates."""

from __future__ import annotations

import ast
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_PHRASE = r"(?i)\b(yesterday|today|tomorrow|(?:last|next)\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month))\b"


def resolved(phrase: Column, day: Column) -> Column:
    """The day that a phrase names, seen from a day; null for other phrases."""
    p = F.lower(F.regexp_replace(phrase, r"\s+", " "))
    result = F.lit(None).cast("date")
    for i, name in enumerate(_DAYS):
        # weekday() counts from Monday as 0; "last" and "next" never mean the day itself.
        back = F.pmod(F.weekday(day) - i - 1, F.lit(7)) + 1
        ahead = F.pmod(F.lit(i) - F.weekday(day) - 1, F.lit(7)) + 1
        result = F.when(p == f"last {name}", F.date_sub(day, back)).when(p == f"next {name}", F.date_add(day, ahead)).otherwise(result)
    steps = {"yesterday": F.date_sub(day, 1), "today": day, "tomorrow": F.date_add(day, 1), "last week": F.date_sub(day, 7), "next week": F.date_add(day, 7), "last month": F.add_months(day, -1), "next month": F.add_months(day, 1)}
    for name, value in steps.items():
        result = F.when(p == name, value).otherwise(result)
    return result


def annotated(rows: DataFrame, text: str, day: Column) -> DataFrame:
    """id, phrase, day: the phrases of a text and the days that they name."""
    found = rows.select("id", F.explode(F.regexp_extract_all(text, F.lit(_PHRASE), F.lit(1))).alias("phrase"))
    return found.select("id", F.lower("phrase").alias("phrase"), resolved(F.col("phrase"), day).alias("day"))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
_FUNCTIONS = {"sqrt": math.sqrt, "abs": abs, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log}


def calculated(expression: str) -> float:
    """+ - * / % ^, functions, pi and e, and "x% of y". Nothing else is evaluated."""
    text = re.sub(r"(\d+(?:\.\d+)?)\s*%\s*of\s+", r"(\1/100)*", expression, flags=re.IGNORECASE).replace("^", "**")

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            right = value(node.right)
            if isinstance(node.op, ast.Pow) and abs(right) > 1000:
                raise ValueError("the exponent is too large")
            return _OPERATORS[type(node.op)](value(node.left), right)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Name) and node.id.lower() in ("pi", "e"):
            return getattr(math, node.id.lower())
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id.lower() in _FUNCTIONS and not node.keywords:
            return _FUNCTIONS[node.func.id.lower()](*[value(a) for a in node.args])
        raise ValueError(f"not an expression: {expression}")

    return value(ast.parse(text.strip(), mode="eval"))


def rendered(template: str, columns: list[str]) -> Column:
    """A template's {{name}} marks filled from columns; unknown names give nothing."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{\{\s*([\w.]+)\s*\}\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        else:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("")) if piece in columns else F.lit(""))
    return F.concat(*parts)
