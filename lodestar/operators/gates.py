"""Filters over memories: header gates, governance, conflicts, suppression, metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import scoring


@dataclass(frozen=True)
class Gates:
    """What a scan lets through; None asks for nothing."""

    memory_types: Sequence[str] | None = None
    include_tombstoned: bool = False
    include_contradicted: bool = False
    min_ts_ms: int | None = None
    max_ts_ms: int | None = None
    all_tags: int | None = None
    any_tags: int | None = None
    min_valence: int | None = None
    max_valence: int | None = None
    min_importance: float | None = None
    deep_sleep: bool = False

    def conditions(self, now_ms: int) -> dict[str, Column]:
        """One condition for each gate that asks something, cheap ones first."""
        c = F.col
        found: dict[str, Column] = {}
        if self.memory_types is not None:
            found["tier"] = c("memory_type").isin(*self.memory_types)
        if not self.include_tombstoned:
            found["tombstone"] = ~c("tombstoned")
        if not self.include_contradicted:
            found["contradiction"] = ~c("contradicted")
        if self.min_ts_ms is not None:
            found["from"] = c("ts_ms") >= self.min_ts_ms
        if self.max_ts_ms is not None:
            found["to"] = c("ts_ms") <= self.max_ts_ms
        if self.all_tags:
            found["focus"] = c("tag_mask").bitwiseAND(F.lit(self.all_tags)) == self.all_tags
        if self.any_tags:
            found["tags"] = c("tag_mask").bitwiseAND(F.lit(self.any_tags)) != 0
        if self.min_valence is not None:
            found["valence_from"] = c("valence") >= self.min_valence
        if self.max_valence is not None:
            found["valence_to"] = c("valence") <= self.max_valence
        if self.min_importance is not None:
            found["importance"] = c("importance") >= self.min_importance
        if self.deep_sleep:
            oldest = scoring.age_bucket(c("ts_ms"), F.lit(now_ms)) == 11
            found["deep_sleep"] = ~(oldest & (c("importance") < 1.0) & ~c("pinned") & c("resolved"))
        return found


def gated(rows: DataFrame, gates: Gates, now_ms: int) -> DataFrame:
    """The rows that pass all gates; plain columns only, so the scan can prune by them."""
    for condition in gates.conditions(now_ms).values():
        rows = rows.where(condition)
    return rows


def gate_counts(rows: DataFrame, gates: Gates, now_ms: int) -> DataFrame:
    """gate, passed: how many rows each gate alone lets through, in one pass."""
    found = gates.conditions(now_ms)
    sums = rows.agg(*[F.sum(c.cast("long")).alias(k) for k, c in found.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(F.col(k), F.lit(0)).alias("passed")) for k in found])
    return sums.select(F.explode(pairs).alias("p")).select("p.gate", "p.passed")


def browsed(rows: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows with all of the exact tags."""
    return rows.where(reduce(lambda a, b: a & b, [F.array_contains("tags", t) for t in tags], F.lit(True)))


def suppressed(rows: DataFrame, suppressions: DataFrame, key: str = "id") -> DataFrame:
    """Rows that aren't suppressed."""
    return rows.join(suppressions.select(key).distinct(), key, "left_anti")


def released(scored: DataFrame, now_ms: int, persona: bool = False, min_trust: float = 0.0) -> DataFrame:
    """Governance: no retracted rows, restricted ones for a persona only, and unverified
    ones only with enough score or a decay that recalls have kept up."""
    rows = scored.where(~F.col("retracted"))
    if not persona:
        rows = rows.where(~F.col("restricted"))
    if min_trust > 0:
        bucket = scoring.reconsolidated(scoring.age_bucket(F.col("ts_ms"), F.lit(now_ms)), F.col("agent_recalls"))
        weak = F.col("unverified") & (F.col("score") < min_trust) & (scoring.bucket_decay(bucket) < min_trust)
        rows = rows.where(~weak)
    return rows


def conflicts(scored: DataFrame, mode: str = "FAIL_CLOSED") -> DataFrame:
    """Contradicted rows: FAIL_CLOSED drops them, HIGHEST_CONFIDENCE keeps of those with
    one text (whatever its case) the best, MULTI_EVIDENCE keeps all."""
    if mode == "MULTI_EVIDENCE":
        return scored
    if mode == "FAIL_CLOSED":
        return scored.where(~F.col("contradicted"))
    if mode != "HIGHEST_CONFIDENCE":
        raise ValueError(f"unknown conflict mode {mode}")
    best = Window.partitionBy("contradicted", F.when(F.col("contradicted"), F.lower("text")).otherwise(F.col("id").cast("string"))).orderBy(F.desc("score"), "id")
    return scored.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


# ---- metadata filter language -------------------------------------------------------

_COMPARISONS = ("EQ", "NE", "GT", "GTE", "LT", "LTE", "IN", "NIN", "ISNULL", "ISNOTNULL")


def metadata_filter(expression: tuple, metadata: str = "metadata") -> Column:
    """Compile ("AND", a, b), ("OR", a, b), ("NOT", a), ("GROUP", a) and (op, key, value)
    over a map of strings. A missing key is true for NE and NIN only; numbers compare
    as numbers with a numeric value, all else as text."""
    op = expression[0].upper()
    if op in ("AND", "OR"):
        parts = [metadata_filter(e, metadata) for e in expression[1:]]
        return reduce((lambda a, b: a & b) if op == "AND" else (lambda a, b: a | b), parts)
    if op == "NOT":
        return ~metadata_filter(expression[1], metadata)
    if op == "GROUP":
        return metadata_filter(expression[1], metadata)
    if op not in _COMPARISONS:
        raise ValueError(f"unknown operator {op}")
    held = F.try_element_at(F.col(metadata), F.lit(expression[1]))
    if op == "ISNULL":
        return held.isNull()
    if op == "ISNOTNULL":
        return held.isNotNull()
    value = expression[2]

    def compared(test, v) -> Column:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            number = held.try_cast("double")
            return F.when(number.isNotNull(), test(number, F.lit(float(v)))).otherwise(test(held, F.lit(str(v))))
        return test(held, F.lit(str(v).lower() if isinstance(v, bool) else str(v)))

    tests = {"EQ": lambda a, b: a == b, "NE": lambda a, b: a != b, "GT": lambda a, b: a > b, "GTE": lambda a, b: a >= b, "LT": lambda a, b: a < b, "LTE": lambda a, b: a <= b}
    if op in ("IN", "NIN"):
        found = reduce(lambda a, b: a | b, [compared(tests["EQ"], v) for v in value], F.lit(False))
        result = found if op == "IN" else ~found
    else:
        result = compared(tests[op], value)
    return F.coalesce(result, F.lit(op in ("NE", "NIN")))


def parse_filter(text: str) -> tuple:
    """The text form: ``a == 1 && (b != 'x' || c in ['p', 'q']) && not d``."""
    import re

    found = re.findall(r"""\s*(&&|\|\||==|!=|>=|<=|>|<|\(|\)|\[|\]|,|'[^']*'|"[^"]*"|[\w.+-]+)""", text)
    at = 0

    def peek() -> str:
        return found[at].lower() if at < len(found) else ""

    def take() -> str:
        nonlocal at
        if at >= len(found):
            raise ValueError(f"unexpected end of filter: {text}")
        at += 1
        return found[at - 1]

    def value():
        raw = take()
        if raw[0] in "'\"":
            return raw[1:-1]
        if raw.lower() in ("true", "false"):
            return raw.lower() == "true"
        try:
            return int(raw)
        except ValueError:
            return float(raw)

    def either() -> tuple:
        left = both()
        while peek() in ("||", "or"):
            take()
            left = ("OR", left, both())
        return left

    def both() -> tuple:
        left = one()
        while peek() in ("&&", "and"):
            take()
            left = ("AND", left, one())
        return left

    def listed() -> list:
        if take() != "[":
            raise ValueError(f"a list is expected in filter: {text}")
        values = [value()]
        while peek() == ",":
            take()
            values.append(value())
        if take() != "]":
            raise ValueError(f"a list isn't closed in filter: {text}")
        return values

    def one() -> tuple:
        if peek() == "not":
            take()
            return ("NOT", one())
        if peek() == "(":
            take()
            inner = either()
            if take() != ")":
                raise ValueError(f"a group isn't closed in filter: {text}")
            return ("GROUP", inner)
        key = take()
        op = peek()
        take()
        if op == "is":
            if peek() == "not":
                take()
                take()
                return ("ISNOTNULL", key)
            take()
            return ("ISNULL", key)
        if op == "in":
            return ("IN", key, listed())
        if op in ("nin", "not"):
            if op == "not":
                take()
            return ("NIN", key, listed())
        names = {"==": "EQ", "!=": "NE", ">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE"}
        if op not in names:
            raise ValueError(f"unknown operator {op} in filter: {text}")
        return (names[op], key, value())

    result = either()
    if at != len(found):
        raise ValueError(f"unexpected {found[at]} in filter: {text}")
    return result


@dataclass(frozen=True)
class SearchQuery:
    """A parsed query line."""

    text: str
    mode: str
    top_k: int = 10


def parse_query(line: str | None, has_vector: bool = False) -> SearchQuery:
    """``mode:keyword|vector|hybrid`` and ``k:N`` are directives, the rest is the text.
    A bad k is 10; without a good mode what is there decides it."""
    mode, k, rest = None, 10, []
    for word in (line or "").split():
        name, _, value = word.partition(":")
        if name.lower() == "mode" and value:
            mode = value.upper() if value.upper() in ("KEYWORD", "VECTOR", "HYBRID") else mode
        elif name.lower() == "k" and value:
            k = int(value) if value.isdigit() and int(value) > 0 else 10
        else:
            rest.append(word)
    text = " ".join(rest)
    if mode is None:
        mode = "HYBRID" if text and has_vector else "VECTOR" if has_vector else "KEYWORD"
    return SearchQuery(text, mode, k)


def option_warnings(options: Mapping[str, float]) -> list[str]:
    """What is odd about recall options."""
    found = []
    if options.get("top_k", 10) <= 0:
        found.append("top_k must be positive")
    if not 0 <= options.get("mmr_lambda", 0.5) <= 1:
        found.append("mmr_lambda is outside 0..1")
    if options.get("temperature", 1.0) <= 0:
        found.append("temperature must be positive")
    if options.get("min_valence", -128) > options.get("max_valence", 127):
        found.append("min_valence exceeds max_valence")
    if options.get("alpha", 0.6) + options.get("beta", 0.4) > 1.5:
        found.append("alpha and beta together exceed 1.5")
    if options.get("rerank_depth", 50) > options.get("top_k", 10) * 100:
        found.append("rerank_depth is far beyond top_k")
    return found
