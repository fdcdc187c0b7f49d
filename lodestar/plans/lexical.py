"""Analysis, lexical search, fusion, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.operators import chunking, lexical
from lodestar.plans.vectors import base
from lodestar.sources.memories import read

REGISTERED: dict = {}


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def asked(spark, sf_dir):
    """The stated queries: the benchmark items whose id is divisible by 20."""
    return read(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


_STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
TERMS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))"


def _stem_sql(word: str) -> str:
    cases = []
    for suffix, longer, cut, single in t.STEM_RULES:
        short = f"left({word}, length({word}) - {cut})" if cut else word
        if single:
            end, before = f"right({short}, 1)", f"substr({short}, length({short}) - 1, 1)"
            short = f"CASE WHEN length({short}) >= 2 AND {end} = {before} AND {end} NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({short}, length({short}) - 1) ELSE {short} END"
        cases.append(f"WHEN suffix({word}, '{suffix}') AND length({word}) > {longer} THEN {short}")
    return f"CASE WHEN length({word}) <= 3 THEN {word} {' '.join(cases)} ELSE {word} END"


_add("standard_analyzer", lambda spark, sf_dir: docs(spark, sf_dir).select("id", t.tokens(F.col("text")).alias("terms")), f"SELECT doc_id AS id, {TERMS} AS terms FROM documents")
_add(
    "stemming_analyzer",
    lambda spark, sf_dir: docs(spark, sf_dir).select("id", F.explode(t.tokens(F.col("text"))).alias("w")).select("id", t.stem(F.col("w")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n")),
    f"SELECT stem, count(*) AS n FROM (SELECT {_stem_sql('w')} AS stem FROM (SELECT unnest({TERMS}) AS w FROM documents)) GROUP BY stem",
)

_POST = f"""d AS (SELECT doc_id AS id, source, {TERMS} AS terms FROM documents), x AS (SELECT id, source, len(terms) AS dl, unnest(terms) AS term FROM d),
  tf AS (SELECT term, id, source, dl, count(*) AS tf FROM x GROUP BY ALL),
  q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL)"""
_SCORE = "times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
_BM25 = f"""{_POST}, s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  b AS (SELECT query_id, id, round(sum({_SCORE}), 6) AS score FROM tf JOIN q USING (term) JOIN f USING (term), s GROUP BY query_id, id)"""
_add(
    "bm25_search",
    lambda spark, sf_dir: lexical.bm25(docs(spark, sf_dir), asked(spark, sf_dir), 10),
    f"WITH {_BM25} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10",
)
_add(
    "bm25_partitioned",
    lambda spark, sf_dir: lexical.bm25(docs(spark, sf_dir), asked(spark, sf_dir), 10, partition="source"),
    f"""WITH {_POST}, s AS (SELECT source, count(*) AS n, avg(len(terms)) AS avgdl FROM d GROUP BY source), f AS (SELECT term, source, count(*) AS df FROM tf GROUP BY ALL),
      b AS (SELECT query_id, id, round(sum({_SCORE}), 6) AS score FROM tf JOIN q USING (term) JOIN f USING (term, source) JOIN s USING (source) GROUP BY query_id, id)
      SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10""",
)
_add(
    "posting_list",
    lambda spark, sf_dir: lexical.postings(docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")),
    f"WITH {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term",
)

_W = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-zA-Z0-9_]+'), lambda w: length(w) >= 2)"
_SPARSE = f"""d AS (SELECT id, term, count(*)::DOUBLE AS w FROM (SELECT doc_id AS id, unnest({_W}) AS term FROM documents) GROUP BY ALL),
  q AS (SELECT id AS query_id, term, count(*)::DOUBLE AS q FROM (SELECT item_id AS id, unnest({_W}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
  b AS (SELECT query_id, id, round(sum(w * q), 6) AS score FROM d JOIN q USING (term) GROUP BY ALL)"""


def sparse(spark, sf_dir):
    queries = lexical.term_weights(asked(spark, sf_dir).withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id")
    return lexical.sparse_dot(lexical.term_weights(docs(spark, sf_dir)), queries, 10)


_add("sparse_dot_search", sparse, f"WITH {_SPARSE} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10")

# A query's vector is that of its own number; a document's that of its id modulo the vectors.
_VEC = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), dv AS (SELECT doc_id AS id, v FROM documents JOIN e ON doc_id % (SELECT count(*) FROM e) = vec_id),
  qv AS (SELECT item_id AS query_id, v FROM benchmark JOIN e ON item_id = vec_id WHERE item_id % 20 = 0)"""


def doc_vectors(spark, sf_dir):
    vectors = base(spark, sf_dir).select(F.col("id").alias("v_id"), "vector")
    n = vectors.count()
    return docs(spark, sf_dir).select("id").join(vectors, F.col("id") % F.lit(max(1, n)) == F.col("v_id")).select("id", "vector")


def query_vectors(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id").join(base(spark, sf_dir).select(F.col("id").alias("query_id"), "vector"), "query_id")


def hybrid_search(spark, sf_dir):
    """Lexical and vector search of every stated query, fused by reciprocal ranks."""
    return lexical.hybrid(docs(spark, sf_dir), doc_vectors(spark, sf_dir), asked(spark, sf_dir), query_vectors(spark, sf_dir), 10)


_LEGS = f"""{_BM25}, {_VEC}, l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b),
  vs AS (SELECT query_id, id, round(list_cosine_similarity(qv.v, dv.v), 6) AS score FROM qv, dv),
  w AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs),
  u AS (SELECT * FROM l WHERE rank <= 50 UNION ALL SELECT * FROM w WHERE rank <= 50),
  r AS (SELECT query_id, id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score FROM u GROUP BY ALL)"""
_add("hybrid_search", hybrid_search, f"WITH {_LEGS} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10")
_add(
    "hybrid_keyword_only",
    lambda spark, sf_dir: lexical.hybrid(docs(spark, sf_dir), None, asked(spark, sf_dir), None, 10),
    f"WITH {_BM25}, l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) SELECT query_id, id, round(1 / (60 + rank)::DOUBLE, 9) AS score, rank::INT AS rank FROM l WHERE rank <= 10",
)


def splade_fusion(spark, sf_dir):
    """Sparse ranks fused into the list that lexical and vector ranks were fused into."""
    from lodestar.operators.lexical import fused

    return fused([lexical.hybrid(docs(spark, sf_dir), doc_vectors(spark, sf_dir), asked(spark, sf_dir), query_vectors(spark, sf_dir), 50), sparse(spark, sf_dir)], 10)


_add(
    "sparse_fusion",
    splade_fusion,
    f"""WITH {_LEGS.replace('<= 50', '<= 100')}, h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r),
      sd AS (SELECT id, term, count(*)::DOUBLE AS w FROM (SELECT doc_id AS id, unnest({_W}) AS term FROM documents) GROUP BY ALL),
      sq AS (SELECT id AS query_id, term, count(*)::DOUBLE AS q FROM (SELECT item_id AS id, unnest({_W}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
      sb AS (SELECT query_id, id, round(sum(w * q), 6) AS score FROM sd JOIN sq USING (term) GROUP BY ALL), sr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sb),
      fu AS (SELECT * FROM h WHERE rank <= 50 UNION ALL SELECT * FROM sr WHERE rank <= 10), fs AS (SELECT query_id, id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score FROM fu GROUP BY ALL)
      SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fs) WHERE rank <= 10""",
)


def late_interaction(spark, sf_dir):
    """Candidates of lexical search ranked by token vectors: eight slices of a vector each."""
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, 8))
    tokens = doc_vectors(spark, sf_dir).select("id", cut(F.col("vector")).alias("vectors"))
    queries = query_vectors(spark, sf_dir).select("query_id", cut(F.col("vector")).alias("vectors"))
    return lexical.max_sim(lexical.bm25(docs(spark, sf_dir), asked(spark, sf_dir), 50), tokens, queries)


_add(
    "late_interaction",
    late_interaction,
    f"""WITH {_BM25}, {_VEC}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM b) WHERE n <= 50),
      m AS (SELECT c.query_id, c.id, score, list_sum([list_max([list_dot_product(qv.v[8 * i + 1:8 * i + 8], dv.v[8 * j + 1:8 * j + 8]) for j in range(8)]) for i in range(8)]) / 8 AS s
        FROM c JOIN qv ON c.query_id = qv.query_id JOIN dv ON c.id = dv.id),
      g AS (SELECT query_id, id, round(s, 6) AS maxsim, round(0.7::DOUBLE * s + (1 - 0.7::DOUBLE) * score, 6) AS score FROM m)
      SELECT query_id, id, maxsim, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g) WHERE rank <= 10""",
)
_BARE = r"""regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]+>', ' ', 'gs')"""
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_entity}', '{_char}')"
_BARE = f"trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))"
_add("html_reader", lambda spark, sf_dir: read(spark, sf_dir, "pages").select("page_id", t.html_text(F.coalesce("html", F.lit(""))).alias("text")), f"SELECT page_id, {_BARE} AS text FROM pages")
_add(
    "content_tags",
    lambda spark, sf_dir: read(spark, sf_dir, "pages").select("page_id", t.content_tags(F.col("url"), t.html_text(F.coalesce("html", F.lit("")))).alias("tags")).select("page_id", F.size("tags").alias("n"), F.concat_ws(" ", "tags").alias("tags")),
    f"""WITH b AS (SELECT page_id, url, {_BARE} AS text FROM pages), p AS (SELECT page_id, list_filter(string_split_regex(lower(url), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2) AS path,
        [x.t for x in list_sort([{{'n': -length(w), 't': w}} for w in list_distinct(list_filter(string_split_regex(lower(left(text, 500)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 4))])][1:5] AS words FROM b),
      u AS (SELECT page_id, list_concat(path, words) AS a FROM p), d AS (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:10] AS tags FROM u)
      SELECT page_id, len(tags)::INT AS n, array_to_string(tags, ' ') AS tags FROM d""",
)


def scrub(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", t.scrubbed(F.coalesce("text", F.lit(""))).alias("clean"), "text")
    return rows.select("doc_id", F.md5("clean").alias("digest"), (F.length("clean") - F.length("text")).cast("long").alias("change"))


def _scrub_sql() -> str:
    text = "coalesce(text, '')"
    for pattern, mark in t.SCRUB_RULES:
        flags, bare = "g", pattern
        for prefix in ("(?i)", "(?s)"):
            bare = bare.replace(prefix, "")
            flags += prefix[2] if pattern.startswith(prefix) else ""
        text = f"""regexp_replace({text}, '{bare.replace("'", "''")}', '{mark.replace("$1", chr(92) + "1")}', '{flags}')"""
    return text


_add("pii_scrub", scrub, f"SELECT doc_id, md5(clean) AS digest, (length(clean) - length(text))::BIGINT AS change FROM (SELECT doc_id, text, {_scrub_sql()} AS clean FROM documents)")
_add("sentence_chunks", lambda spark, sf_dir: chunking.chunked(docs(spark, sf_dir), "sentence").select("id", "chunk", "start", F.md5("text").alias("digest")))
_add("token_chunks", lambda spark, sf_dir: chunking.chunked(docs(spark, sf_dir), "token").select("id", "chunk", "start", F.md5("text").alias("digest")))
_add("markdown_chunks", lambda spark, sf_dir: chunking.chunked(docs(spark, sf_dir), "markdown").select("id", "chunk", "start", "heading", F.md5("text").alias("digest")))
_add("stream_chunks", lambda spark, sf_dir: chunking.chunked(docs(spark, sf_dir), "stream").select("id", "chunk", "start", F.md5("text").alias("digest")))
_add("markdown_title", lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", t.markdown_title(F.concat(F.lit("# "), F.col("text")), F.lit("untitled")).alias("title")), "SELECT doc_id, trim(split_part(coalesce(text, ''), chr(10), 1)) AS title FROM documents")
_add("word_tokens", lambda spark, sf_dir: chunking.word_offsets(docs(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.max("end").alias("last")))
