"""Small messy tables for the training-data operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, score string"


def make_words(seed: int, n: int) -> list[str]:
    chooser = random.Random(seed)
    return ["".join(chooser.choice(["ka", "lo", "mi", "ré", "tun", "ves", "ño"]) for _ in range(chooser.randint(1, 4))) for _ in range(n)]


def make_text(seed: int, n: int = 60) -> str:
    found = make_words(seed, n)
    return "\n".join(" ".join(found[i : i + 12]) + "." for i in range(0, n, 12))


@pytest.fixture(scope="session")
def messy_rows():
    rows = [(i, make_text(i), "en", f"s{i % 3}", 10, True, 7, "x") for i in range(40)]
    rows += [(100 + i, make_text(3) + f"\nend {i}", "en", "s0", 10, False, 7, "x") for i in range(12)]  # near copies
    rows += [(200 + i, make_text(5), None, "s1", None, None, None, None) for i in range(6)]  # exact copies
    rows += [(7, make_text(7), "en", "s1", 10, True, 7, "x")] * 2  # repeated rows
    rows += [(300, None, None, None, None, None, None, None), (301, "", "en", "s2", 0, True, 0, "")]
    rows += [(None, make_text(99), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(302, " \n\t \r\n", "en", "s0", 3, True, 1, "x"), (303, "one two", "en", "", 7, True, 1, "x"), (304, "a" * 30_000, "en", "s0", 1, True, 1, "x")]
    rows += [(305, make_text(1234, 6_000), "en", "s0", 1, True, 1, "x"), (1 << 60, "big id " + make_text(8), "en", "s2", 1, True, 1, "x")]
    rows += [(306, "It's <|endoftext|> don't　 x\x1c y\x85z İ ΣΣ é \U0001f600‍!", "en", "s0", 1, True, 1, "x")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
