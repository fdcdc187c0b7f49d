"""Entities, work policies, traces, keyword index: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import bits
from lodestar.operators import entities as e
from lodestar.operators import lexical, policies
from lodestar.operators import recall as r
from lodestar.operators import vector_search as vs
from lodestar.plans.lexical import _SCORE, TERMS
from lodestar.plans.lexical import asked as asked_texts
from lodestar.plans.lexical import docs
from lodestar.plans.scoring import _RESULTS, results
from lodestar.plans.vectors import asked, base, label_centres
from lodestar.sources.lineage import shared_folder
from lodestar.sources.memories import EMBEDDED_SQL, MEMORIES_SQL, NOW_MS, embedded, memories, read

REGISTERED: dict = {}


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


# ---- entities ------------------------------------------------------------------------


def mentions(spark, sf_dir):
    """The first five words of each document as entities that its memory mentions."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory"), F.explode(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 5)).alias("name"), F.col("lang").alias("type"))
    return rows


_MENTIONS = "me AS (SELECT doc_id AS memory, unnest(string_split(coalesce(text, ''), ' ')[1:5]) AS name, lang AS type FROM documents), mn AS (SELECT memory, lower(trim(name)) AS name, CASE WHEN trim(coalesce(type, '')) = '' THEN 'OTHER' ELSE type END AS type FROM me WHERE trim(name) <> '')"
_add("entity_intern", lambda spark, sf_dir: e.interned(mentions(spark, sf_dir)), f"WITH {_MENTIONS} SELECT min(memory) AS first_memory, name, arg_min(type, memory) AS type FROM mn GROUP BY name")
_add("entity_links", lambda spark, sf_dir: e.linked(mentions(spark, sf_dir)).select("name", "memory", F.round("weight", 6).alias("weight")), f"WITH {_MENTIONS} SELECT name, memory, round(1 + 0.2::DOUBLE * (count(*) - 1), 6) AS weight FROM mn GROUP BY name, memory")
_add(
    "entity_link_decay",
    lambda spark, sf_dir: e.decayed_links(e.linked(mentions(spark, sf_dir)), 0.9, 1.0).select("name", "memory", F.round("weight", 6).alias("weight")),
    f"WITH {_MENTIONS} SELECT name, memory, round((1 + 0.2::DOUBLE * (count(*) - 1)) * 0.9::DOUBLE, 6) AS weight FROM mn GROUP BY name, memory HAVING (1 + 0.2::DOUBLE * (count(*) - 1)) * 0.9::DOUBLE >= 1",
)


def order_links(spark, sf_dir):
    """Customers as entities of the days of their orders."""
    o = read(spark, sf_dir, "orders")
    rows = o.groupBy(F.col("o_custkey").cast("long").alias("entity"), (F.col("o_orderkey").cast("long") % 97).alias("memory")).agg(F.count("*").alias("n"))
    return rows.select("entity", "memory", (1.0 + 0.2 * (F.col("n") - 1)).alias("weight"))


def order_merges(spark, sf_dir):
    """Even customers are merged into the one of half their number."""
    return read(spark, sf_dir, "customer").where("c_custkey % 2 = 0 AND c_custkey > 0").select(F.col("c_custkey").cast("long").alias("entity"), (F.col("c_custkey") / 2).cast("long").alias("into"))


_MERGES = """mg AS (SELECT c_custkey::BIGINT AS entity, (c_custkey // 2)::BIGINT AS into_ FROM customer WHERE c_custkey % 2 = 0 AND c_custkey > 0{})"""
_CHAIN = """ch AS (SELECT entity, into_ AS canonical, 1 AS n FROM mg UNION ALL SELECT ch.entity, mg.into_, n + 1 FROM ch JOIN mg ON ch.canonical = mg.entity WHERE n < 10),
  en AS (SELECT entity, arg_max(canonical, n) AS canonical FROM ch GROUP BY entity)"""
_add("entity_resolve", lambda spark, sf_dir: e.resolved(order_merges(spark, sf_dir)), f"WITH RECURSIVE {_MERGES.format('')}, {_CHAIN} SELECT entity, canonical FROM en")
_add(
    "entity_unmerge",
    lambda spark, sf_dir: e.resolved(e.unmerged(order_merges(spark, sf_dir), read(spark, sf_dir, "customer").where("c_custkey % 24 = 0").select(F.col("c_custkey").cast("long").alias("entity")))),
    f"WITH RECURSIVE {_MERGES.format(' AND c_custkey % 24 <> 0')}, {_CHAIN} SELECT entity, canonical FROM en",
)
_add(
    "entity_merge_links",
    lambda spark, sf_dir: e.merged_links(order_links(spark, sf_dir), order_merges(spark, sf_dir)).select("entity", "memory", F.round("weight", 6).alias("weight")),
    f"""WITH RECURSIVE {_MERGES.format('')}, {_CHAIN}, ln AS (SELECT o_custkey::BIGINT AS entity, o_orderkey::BIGINT % 97 AS memory, 1 + 0.2::DOUBLE * (count(*) - 1) AS weight FROM orders GROUP BY ALL),
      t AS (SELECT coalesce(canonical, ln.entity) AS entity, memory, weight, canonical IS NULL AS own FROM ln LEFT JOIN en ON ln.entity = en.entity),
      g AS (SELECT entity, memory, max(CASE WHEN own THEN weight END) AS weight, sum((NOT own)::INT) AS more FROM t GROUP BY entity, memory)
      SELECT entity, memory, round(CASE WHEN weight IS NULL THEN 1 + 0.2::DOUBLE * (more - 1) ELSE weight + 0.2::DOUBLE * more END, 6) AS weight FROM g""",
)


def vector_entities(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("name"), F.col("label").cast("string").alias("type"), "vector")


_add(
    "entity_vector_resolution",
    lambda spark, sf_dir: e.similar_entities(vector_entities(spark, sf_dir), label_centres(spark, sf_dir), 0.4),
    """WITH v AS (SELECT vec_id AS id, 'e' || vec_id AS name, label, embedding::DOUBLE[] AS v FROM embeddings)
      SELECT CASE WHEN length(x.name) <= length(y.name) THEN x.id ELSE y.id END AS keep, CASE WHEN length(x.name) <= length(y.name) THEN y.id ELSE x.id END AS "drop", round(1 - pow(list_distance(x.v, y.v), 2) / 2, 4) AS similarity
      FROM v x JOIN v y ON x.id < y.id AND x.label = y.label WHERE list_distance(x.v, y.v) <= sqrt(1.2::DOUBLE)""",
)

# ---- work ----------------------------------------------------------------------------


def tasks(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("sequence"), (F.col("user_id") % 3).alias("priority"))


_TASKS = "ta AS (SELECT event_type AS queue, event_id AS sequence, user_id % 3 AS priority FROM events)"
for _policy, _order in (("REJECT_FAST", "sequence"), ("DROP_OLDEST", "sequence DESC")):
    _add(
        f"task_queue_{_policy.lower()}",
        lambda spark, sf_dir, policy=_policy: policies.admitted(tasks(spark, sf_dir), 25, policy),
        f"""WITH {_TASKS}, a AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY {_order}) AS n FROM ta)
          SELECT queue, sequence, priority, (row_number() OVER (PARTITION BY queue ORDER BY priority DESC, sequence))::INT AS place FROM a WHERE n <= 25""",
    )
_add(
    "task_queue_caller_runs",
    lambda spark, sf_dir: policies.admitted(tasks(spark, sf_dir), 25, "CALLER_RUNS"),
    f"""WITH {_TASKS}, a AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY sequence) AS n FROM ta)
      SELECT queue, sequence, priority, (CASE WHEN n <= 25 THEN row_number() OVER (PARTITION BY queue, n <= 25 ORDER BY priority DESC, sequence) ELSE 0 END)::INT AS place FROM a""",
)
_SUBSCRIPTIONS = [("audit", "*", "u1"), ("sales", "purchase", None), ("alarm", "error", "u2"), ("alarm", "error", "u3"), ("sales", "click", "u0")]
_add(
    "event_bus",
    lambda spark, sf_dir: policies.delivered(
        read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("scope")), spark.createDataFrame(_SUBSCRIPTIONS, "subscriber string, type string, scope string")
    ),
    """WITH s(subscriber, type, scope) AS (VALUES ('audit', '*', 'u1'), ('sales', 'purchase', NULL), ('alarm', 'error', 'u2'), ('alarm', 'error', 'u3'), ('sales', 'click', 'u0')),
      ev AS (SELECT event_id, event_type AS type, 'u' || (user_id % 4) AS scope FROM events)
      SELECT DISTINCT subscriber, event_id, ev.type FROM ev JOIN s ON (s.type = '*' OR s.type = ev.type) AND (s.scope IS NULL OR s.scope = ev.scope)""",
)


def writes(spark, sf_dir):
    """Writes of the last ten seconds, by seven sessions."""
    return embedded(spark, sf_dir).select("id", (F.col("id") % 7).alias("session_id"), (F.lit(NOW_MS) - F.col("id") % 100 * 100).alias("ts_ms"), "vector")


_WRITES = f"""{EMBEDDED_SQL}, wr AS (SELECT id, id % 7 AS session_id, {NOW_MS} - id % 100 * 100 AS ts_ms, vector FROM emb),
  bu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS n FROM wr WHERE {NOW_MS} - ts_ms <= 5000) WHERE n <= 64)"""
_add("session_write_buffer", lambda spark, sf_dir: policies.buffered(writes(spark, sf_dir), NOW_MS).select("session_id", "id", "ts_ms"), f"WITH {_WRITES} SELECT session_id, id, ts_ms FROM bu")


def buffered_recall(spark, sf_dir):
    """Search of the stored vectors, with what the query's session has just written."""
    queries = asked(spark, sf_dir)
    found = vs.top_k(base(spark, sf_dir), queries, 10, "cosine")
    return policies.with_buffer(found, policies.buffered(writes(spark, sf_dir), NOW_MS), queries.withColumn("session_id", F.col("query_id") % 7), 10)


_add(
    "buffered_recall",
    buffered_recall,
    f"""WITH {_WRITES}, ev AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT q.id AS query_id, ev.id, round(list_cosine_similarity(q.v, ev.v), 6) AS score FROM ev q, ev WHERE q.id % 20 = 0),
      t AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM x) WHERE n <= 10),
      b AS (SELECT q.id AS query_id, bu.id, round(list_cosine_similarity(q.v, bu.vector), 6) AS score FROM ev q JOIN bu ON q.id % 7 = bu.session_id WHERE q.id % 20 = 0),
      u AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM b) GROUP BY query_id, id)
      SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 10""",
)
_LAST = NOW_MS - 150 * 3_600_000
_add(
    "circadian_due",
    lambda spark, sf_dir: policies.consolidation_due(memories(spark, sf_dir), _LAST, NOW_MS),
    f"""WITH {MEMORIES_SQL} SELECT memory_type, sum((ts_ms > {_LAST})::BIGINT)::BIGINT AS changes, round(avg(tombstoned::INT), 6) AS tombstone_ratio, sum((ts_ms > {_LAST})::BIGINT) >= 100 AS by_volume, sum((ts_ms > {_LAST})::BIGINT) > 0 AS by_time,
      avg(tombstoned::INT) >= 0.3::DOUBLE AS compact FROM mem GROUP BY memory_type""",
)
_add(
    "rate_limits",
    lambda spark, sf_dir: policies.rate_limited(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts_ms")), "user_id", 86_400_000, 1).select("id", "allowed"),
    "SELECT event_id AS id, row_number() OVER (PARTITION BY user_id, (epoch_us(ts) // 1000) // 86400000 ORDER BY (epoch_us(ts) // 1000), event_id) <= 1 AS allowed FROM events",
)
_add(
    "prefilter_choice",
    lambda spark, sf_dir: policies.prefilter_chosen(memories(spark, sf_dir).groupBy("memory_type", "provenance").agg(F.count_if(F.col("importance") >= 6.5).alias("candidates"), F.count("*").alias("total"))),
    f"WITH {MEMORIES_SQL} SELECT memory_type, provenance, count(*) FILTER (importance >= 6.5) AS candidates, count(*) AS total, count(*) FILTER (importance >= 6.5) <= 0.3::DOUBLE * count(*) AS prefilter FROM mem GROUP BY ALL",
)


def odd_options(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id", (i % 5 - 1).cast("double").alias("top_k"), F.when(i % 3 > 0, (i % 7) / 4.0).alias("mmr_lambda"), ((i % 4) / 2.0 - 0.5).alias("temperature"), (i % 200 - 100).cast("double").alias("min_valence"), F.lit(50.0).alias("max_valence"), ((i % 6) / 4.0).alias("alpha"), F.lit(None).cast("double").alias("beta"))
    return policies.option_warnings(rows).select("doc_id", "warnings")


_add(
    "recall_option_warnings",
    odd_options,
    """SELECT doc_id, list_filter([CASE WHEN doc_id % 5 - 1 <= 0 THEN 'top_k must be positive' END, CASE WHEN doc_id % 3 > 0 AND (doc_id % 7) / 4 > 1 THEN 'mmr_lambda is outside 0..1' END, CASE WHEN (doc_id % 4) / 2 - 0.5 <= 0 THEN 'temperature must be positive' END,
      CASE WHEN doc_id % 200 - 100 > 50 THEN 'min_valence exceeds max_valence' END, CASE WHEN (doc_id % 6) / 4 + 0.4::DOUBLE > 1.5 THEN 'alpha and beta together exceed 1.5' END], lambda x: x IS NOT NULL) AS warnings FROM documents""",
)


def memory_pairs(spark, sf_dir):
    """Each even memory with the one after it."""
    m = memories(spark, sf_dir).select("id", "text", "importance", "tag_mask", F.col("agent_recalls").alias("recalls"))
    a = m.where("id % 2 = 0").select(*[F.col(c).alias("a" if c == "id" else f"a_{c}") for c in m.columns])
    b = m.select(*[F.col(c).alias("b" if c == "id" else f"b_{c}") for c in m.columns])
    return a.join(b, F.col("a") + 1 == F.col("b"))


_add(
    "memory_merge",
    lambda spark, sf_dir: policies.merged_texts(memory_pairs(spark, sf_dir)).select("id", F.md5("text").alias("digest"), F.round("importance", 6).alias("importance"), "tag_mask", "recalls"),
    f"""WITH {MEMORIES_SQL} SELECT a.id, md5(CASE WHEN length(b.text) > length(a.text) THEN b.text ELSE a.text END) AS digest, round(greatest(a.importance, b.importance), 6) AS importance, a.tag_mask | b.tag_mask AS tag_mask, a.agent_recalls + b.agent_recalls AS recalls
      FROM mem a JOIN mem b ON b.id = a.id + 1 WHERE a.id % 2 = 0""",
)
_add(
    "generated_ids",
    lambda spark, sf_dir: memories(spark, sf_dir).select("id", bits.time_sorted_id(F.col("ts_ms"), F.col("id") % 1024, F.col("id") % 4096).alias("tsid"), bits.name_uuid(F.col("text")).alias("uuid")),
    f"""WITH {MEMORIES_SQL}, h AS (SELECT id, ts_ms, md5(text) AS h FROM mem) SELECT id, ((ts_ms - 1577836800000) << 22) | ((id % 1024) << 12) | (id % 4096) AS tsid,
      substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""",
)

# ---- recall --------------------------------------------------------------------------


def trace(spark, sf_dir):
    """Score, gate, fade by age, cut: what each step does to every result."""
    scored = results(spark, sf_dir, 10)
    gated = scored.where("NOT tombstoned AND NOT contradicted")
    faded = gated.withColumn("score", F.round(F.col("score") * (1.0 - F.col("agent_recalls") * 0.0625), 4))
    cut = lexical.ranked(faded.select("query_id", "id", "score"), 5)
    rows = policies.traced({"SCORE": scored, "GATE": gated, "HABITUATION": faded, "CUT": cut}).select("query_id", "id", F.posexplode("steps").alias("step", "s"))
    return rows.select("query_id", "id", "step", "s.phase", F.col("s.score_before").alias("score_before"), F.col("s.score_after").alias("score_after"), F.col("s.candidates_before").alias("candidates_before"), F.col("s.candidates_after").alias("candidates_after"))


_add(
    "recall_trace",
    trace,
    f"""{_RESULTS}, g AS (SELECT res.*, agent_recalls FROM res JOIN mem USING (id) WHERE NOT tombstoned AND NOT contradicted), f AS (SELECT query_id, id, round(score * (1 - agent_recalls * 0.0625::DOUBLE), 4) AS score FROM g),
      c AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM f) WHERE n <= 5),
      st AS (SELECT 0 AS k, 'SCORE' AS phase, query_id, id, score FROM res UNION ALL SELECT 1, 'GATE', query_id, id, score FROM g UNION ALL SELECT 2, 'HABITUATION', query_id, id, score FROM f UNION ALL SELECT 3, 'CUT', query_id, id, score FROM c),
      la AS (SELECT query_id, id, max(k) AS last FROM st GROUP BY ALL), ph(k, phase) AS (VALUES (0, 'SCORE'), (1, 'GATE'), (2, 'HABITUATION'), (3, 'CUT')), nu AS (SELECT query_id, k, count(*) AS n FROM st GROUP BY ALL)
      SELECT la.query_id, la.id, ph.k AS step, ph.phase, b.score AS score_before, a.score AS score_after, coalesce(nb.n, 0) AS candidates_before, coalesce(na.n, 0) AS candidates_after
      FROM la JOIN ph ON ph.k <= la.last + 1 LEFT JOIN st b ON b.query_id = la.query_id AND b.id = la.id AND b.k = ph.k - 1 LEFT JOIN st a ON a.query_id = la.query_id AND a.id = la.id AND a.k = ph.k
      LEFT JOIN nu nb ON nb.query_id = la.query_id AND nb.k = ph.k - 1 LEFT JOIN nu na ON na.query_id = la.query_id AND na.k = ph.k""",
)
_add(
    "expansion_gate",
    lambda spark, sf_dir: r.gate_by_similarity(vs.top_k(base(spark, sf_dir).where("label % 2 = 0"), asked(spark, sf_dir), 1, "cosine"), 0.40).select("query_id", F.round("best", 6).alias("best")),
    """WITH ev AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings) SELECT q.id AS query_id, max(round(list_cosine_similarity(q.v, ev.v), 6)) AS best FROM ev q, ev WHERE q.id % 20 = 0 AND ev.label % 2 = 0
      GROUP BY q.id HAVING max(round(list_cosine_similarity(q.v, ev.v), 6)) < 0.4""",
)


def keyword_updates(spark, sf_dir):
    """An index that documents are added to, changed in and removed from, then searched."""
    index = lexical.KeywordIndex(spark, shared_folder(spark, "keywords"))
    rows = docs(spark, sf_dir)
    index.upsert(rows.where("id % 3 <> 0"))
    index.upsert(rows.where("id % 5 = 0").withColumn("text", F.concat_ws(" ", "text", "source")))
    index.remove(rows.where("id % 7 = 0").select("id"))
    return index.search(asked_texts(spark, sf_dir), 10)


_add(
    "keyword_index_updates",
    keyword_updates,
    f"""WITH dc AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN concat_ws(' ', text, source) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 3 <> 0 OR doc_id % 5 = 0)),
      d AS (SELECT id, {TERMS} AS terms FROM dc), x AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM d), tf AS (SELECT term, id, dl, count(*) AS tf FROM x GROUP BY ALL),
      q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
      s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      b AS (SELECT query_id, id, round(sum({_SCORE}), 6) AS score FROM tf JOIN q USING (term) JOIN f USING (term), s GROUP BY query_id, id)
      SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10""",
)


def index_recall(spark, sf_dir):
    """index, recall: recall@10 of the index searches against exact search, by l2."""
    from lodestar.plans.vectors import REGISTERED as searches

    exact = searches["top_k_l2"][0](spark, sf_dir).select("query_id", "id")
    n = exact.count()
    found = None
    for name in ("ivf_flat_search", "ivf_pq_search", "spectrum_search", "quantized_rescore"):
        own = searches[name][0](spark, sf_dir).select("query_id", "id").join(exact, ["query_id", "id"], "left_semi").agg(F.lit(name).alias("index"), F.round(F.count("*") / F.lit(max(1, n)), 4).alias("recall"))
        found = own if found is None else found.unionByName(own)
    return found


_add("index_recall", index_recall)
