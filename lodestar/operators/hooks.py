"""Typed hooks for models and readers that the caller brings; each has a plain default.

A hook runs on Arrow batches where the rows are. One that fails on a row, or gives an
answer that doesn't fit, leaves that row as it would be without a hook.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file's bytes -> its text; a query and candidate texts -> their new order; a text -> tags,
#: or -> (name, type) pairs.
Extractor = Callable[[bytes], str]
Judge = Callable[[str, list[str]], list[int]]
Tagger = Callable[[str], list[str]]
EntityFinder = Callable[[str], list[tuple[str, str]]]


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def html_text(data: bytes) -> str:
    """The text of a small HTML file, without scripts, styles and tags."""
    body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", plain_text(data))
    return " ".join(unescape(re.sub(r"<[^<>]*>", " ", body)).split())


#: Readers by suffix. PDF, office, image, audio and video files need a reader of the caller's.
EXTRACTORS: Mapping[str, Extractor] = {"txt": plain_text, "md": plain_text, "csv": plain_text, "json": plain_text, "xml": plain_text, "html": html_text, "htm": html_text}


def extracted(files: DataFrame, extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """path, content -> path, suffix, text, problem: by the reader of the file's suffix.

    A null text has its reason as the problem: no reader, or the reader's error.
    """
    known = {**EXTRACTORS, **(extractors or {})}

    @F.pandas_udf("text string, problem string")
    def read(suffixes: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for suffix, content in zip(suffixes, contents, strict=True):
            if suffix not in known or content is None:
                rows.append((None, "no reader" if content is not None else "no content"))
                continue
            try:
                rows.append((known[suffix](bytes(content)), None))
            except Exception as error:  # a reader of the caller's may fail in any way
                rows.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["text", "problem"])

    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return files.select("path", suffix.alias("suffix"), "content").select("path", "suffix", read("suffix", "content").alias("r")).select("path", "suffix", "r.*")


def reranked(found: DataFrame, texts: DataFrame, queries: DataFrame, judge: Judge, most: int = 20) -> DataFrame:
    """query_id, id, score, rank with the first ``most`` of each query in the judge's order.

    found: query_id, id, score, rank; texts: id, text; queries: query_id, text. A group
    that meets the judge has ``most`` rows. An answer that isn't an order of the
    candidates, or an error, leaves the ranks as they are.
    """
    top = found.where(F.col("rank") <= most).join(texts.select("id", F.col("text").alias("t")), "id").join(queries.select("query_id", F.col("text").alias("q")), "query_id")

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        try:
            order = list(judge(frame["q"].iloc[0] or "", [t or "" for t in frame["t"]]))
        except Exception:  # the judge is the caller's
            order = []
        if sorted(order) != list(range(len(frame))):
            order = list(range(len(frame)))
        out = frame.iloc[order][["query_id", "id", "score"]].copy()
        out["rank"] = sorted(frame["rank"])
        return out

    judged = top.select("query_id", "id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"), "t", "q").groupBy("query_id").applyInPandas(ask, "query_id long, id long, score double, rank long")
    return judged.unionByName(found.where(F.col("rank") > most).select("query_id", "id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank")))


def tagged(rows: DataFrame, tagger: Tagger | None = None, most: int = 8) -> DataFrame:
    """id, text -> id, tags: the tagger's, in lower case, each once; none without one."""

    @F.pandas_udf("array<string>")
    def tags(texts: pd.Series) -> pd.Series:
        result = []
        for text in texts:
            try:
                own = tagger(text) if tagger else []
                result.append(list(dict.fromkeys(t.strip().lower() for t in own if t and t.strip()))[:most])
            except Exception:  # the tagger is the caller's
                result.append([])
        return pd.Series(result, dtype=object)

    return rows.select("id", tags(F.coalesce("text", F.lit(""))).alias("tags"))


def found_entities(rows: DataFrame, finder: EntityFinder) -> DataFrame:
    """id, text -> memory, name, type: what ``entities.interned`` and ``linked`` take."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for key, text in zip(frame["id"], frame["text"], strict=True):
                try:
                    found += [(key, str(n), str(t)) for n, t in finder(text)]
                except Exception:  # the finder is the caller's
                    continue
            yield pd.DataFrame(found, columns=["memory", "name", "type"])

    return rows.where("id IS NOT NULL").select("id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "memory long, name string, type string")
