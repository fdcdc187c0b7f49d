"""Lexical search: postings, BM25, sparse vectors, late interaction, rank fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.sources.journal import Journal
from lodestar.sources.lineage import checkpointed


def analysed(docs: DataFrame, analyzer: Callable[[Column], Column] = t.tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text -> id, dl, terms array<struct<term, tf>> (and the kept columns).

    Counted within the row, so nothing is shuffled: equal terms of a sorted array lie
    side by side.
    """

    def counted(terms: Column) -> Column:
        runs = F.filter(F.transform(terms, lambda x, i: F.struct(x.alias("term"), i.alias("at"), (F.get(terms, i - 1) == x).alias("again"))), lambda e: ~F.coalesce(e["again"], F.lit(False)))
        ends = t.let(runs, lambda r: F.transform(r, lambda e, i: F.struct(e["term"].alias("term"), (F.coalesce(F.get(r, i + 1)["at"], F.size(terms)) - e["at"]).cast("long").alias("tf"))))
        return F.struct(F.size(terms).alias("dl"), ends.alias("terms"))

    rows = docs.select("id", *keep, t.let(F.sort_array(analyzer(F.coalesce("text", F.lit("")))), counted).alias("a"))
    return rows.select("id", *keep, "a.dl", "a.terms")


def postings(docs: DataFrame, analyzer: Callable[[Column], Column] = t.tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text -> term, id, tf, dl (and the kept columns): one row a term of a document."""
    return analysed(docs, analyzer, keep).select("id", *keep, "dl", F.explode("terms").alias("e")).select("e.term", "id", *keep, "e.tf", "dl")


#: Distinct terms of all queries together, up to which they are broadcast (some 100 bytes each).
BROADCAST_TERMS = 80_000


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, k1: float = 1.2, b: float = 0.75, analyzer: Callable[[Column], Column] = t.tokens, partition: str | None = None, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank. docs: id, text; queries: query_id, text.

    A query's repeated terms count again. ``partition`` names a column of the documents
    with statistics of its own for each value. The documents are analysed once.
    """
    return bm25_of(analysed(docs, analyzer, (partition,) if partition else ()), queries, k, k1, b, analyzer, partition, digits)


def bm25_of(rows: DataFrame, queries: DataFrame, k: int | None = 10, k1: float = 1.2, b: float = 0.75, analyzer: Callable[[Column], Column] = t.tokens, partition: str | None = None, digits: int = 6) -> DataFrame:
    """BM25 over analysed documents (see ``analysed``), which are read once.

    That pass keeps the postings of the queries' terms, and one row without a term for
    each document, from which its statistics come; the terms are broadcast if they are
    counted to be few. Scores are partial sums before their shuffle.
    """
    keep = (partition,) if partition else ()
    asked = checkpointed(postings(queries.select(F.col("query_id").alias("id"), "text"), analyzer).select("term", F.col("id").alias("query_id"), F.col("tf").alias("times")))
    terms = asked.select("term").distinct()
    sent = (lambda df: F.broadcast(df)) if terms.count() <= BROADCAST_TERMS else (lambda df: df)
    each = rows.select("id", *keep, "dl", F.explode(F.array_append("terms", F.lit(None))).alias("e")).select("e.term", "id", *keep, "e.tf", "dl")
    hits = checkpointed(each.join(sent(terms.withColumn("_asked", F.lit(True))), "term", "left").where("_asked OR term IS NULL").drop("_asked"))
    stats = hits.where("term IS NULL").groupBy(*keep).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = hits.where("term IS NOT NULL")
    df = hits.groupBy("term", *keep).agg(F.count("*").alias("df"))
    weighed = df.join(stats, list(keep)) if keep else df.crossJoin(F.broadcast(stats))  # one row: no product
    weighed = weighed.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).join(asked, "term")
    scored = hits.join(weighed if keep else sent(weighed), ["term", *keep])
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = scored.groupBy("query_id", "id").agg(F.round(F.sum(part), digits).alias("score"))
    return ranked(found, k)


class KeywordIndex:
    """Analysed documents in a journal: upsert, remove, search without analysing again."""

    def __init__(self, spark: SparkSession, folder: str, analyzer: Callable[[Column], Column] = t.tokens):
        self.spark, self.analyzer = spark, analyzer
        self.journal = Journal(spark, folder, "id long, dl int, terms array<struct<term:string,tf:long>>")

    def upsert(self, docs: DataFrame) -> None:
        """Add documents (id, text), or replace those of the same id."""
        self.journal.put(analysed(docs, self.analyzer))

    def remove(self, ids: DataFrame) -> None:
        self.journal.drop(ids)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return bm25_of(self.journal.rows(), queries, k, analyzer=self.analyzer)

    def compact(self) -> None:
        self.journal.compact()


def ranked(scored: DataFrame, k: int | None, by: str = "score", key: str = "id") -> DataFrame:
    """The best k of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), key)
    found = scored.withColumn("rank", F.row_number().over(order))
    return found if k is None else found.where(F.col("rank") <= k)


def term_weights(docs: DataFrame) -> DataFrame:
    """The plain sparse vector of a text: its words of two letters or more, as often as there."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\W+"), lambda w: F.length(w) >= 2)
    return postings(docs, lambda _: words).select("id", "term", F.col("tf").cast("double").alias("weight"))


def sparse_dot(docs: DataFrame, queries: DataFrame, k: int | None = 10, digits: int = 6) -> DataFrame:
    """docs: id, term, weight; queries: query_id, term, weight. Positive weights count."""
    left = docs.where("weight > 0").select("id", "term", F.col("weight").alias("w"))
    right = queries.where("weight > 0").select("query_id", "term", F.col("weight").alias("q"))
    found = left.join(right, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("q")), digits).alias("score"))
    return ranked(found, k)


def max_sim(candidates: DataFrame, doc_tokens: DataFrame, query_tokens: DataFrame, alpha: float = 0.7, k: int = 10) -> DataFrame:
    """Late interaction: mean over a query's tokens of the best dot product with a
    document's tokens, mixed with the first stage's score.

    candidates: query_id, id, score; doc_tokens: id, vectors; query_tokens: query_id,
    vectors. The token matrices stay in their rows: nothing is exploded.
    """
    rows = candidates.join(doc_tokens.select("id", F.col("vectors").alias("d")), "id").join(query_tokens.select("query_id", F.col("vectors").alias("q")), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = F.transform("q", lambda a: F.array_max(F.transform(F.col("d"), lambda b: dot(a, b))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size("q")
    found = rows.select("query_id", "id", F.round(mean, 6).alias("maxsim"), F.round(alpha * mean + (1 - alpha) * F.col("score"), 6).alias("score"))
    return ranked(found, k)


def fused(legs: list[DataFrame], k: int | None = 10, constant: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of legs (query_id, id, rank)."""
    rows = legs[0].select("query_id", "id", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", "id", "rank"))
    found = rows.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), digits).alias("score"))
    return ranked(found, k)


def hybrid(docs: DataFrame, vectors: DataFrame | None, queries: DataFrame, query_vectors: DataFrame | None, k: int = 10, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A lexical and a vector leg of max(2k, 50) each, fused; a leg may be missing."""
    from lodestar.operators.vector_search import top_k

    wide = max(2 * k, 50)
    legs = [bm25(docs, queries, wide)]
    if vectors is not None and query_vectors is not None:
        legs.append(top_k(vectors, query_vectors, wide, "cosine"))
    found = fused(legs, wide if rerank else k)
    return rerank(found) if rerank else found
