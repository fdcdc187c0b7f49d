"""Cognitive scoring, recall, learning rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import scoring as s
from lodestar.operators import recall as r
from lodestar.operators.gates import Gates
from lodestar.plans.scans import BUCKET_SQL, DECAY_SQL
from lodestar.plans.vectors import asked, base
from lodestar.sources.memories import EMBEDDED_SQL, MEMORIES_SQL, NOW_MS, embedded, epoch_ms, memories, read

REGISTERED: dict = {}


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


NOW = F.lit
AGED = f"{MEMORIES_SQL}, aged AS (SELECT *, {NOW_MS} - ts_ms AS age FROM mem), buck AS (SELECT *, {BUCKET_SQL} AS raw FROM aged)"
_ADJ = "CASE WHEN NOT resolved AND NOT pinned THEN 0 ELSE greatest((raw >> least(agent_recalls, 5)) - least(auto_recalls // 3, 2), 0) END"
_AROUSED = f"least({DECAY_SQL.format(b='b')} * ([1, 1.15, 1.35, 1.65]::DOUBLE[])[(least(arousal // 64, 3) + 1)::INT], 1)"
DECAYED = f"{AGED}, adj AS (SELECT *, {_ADJ} AS b FROM buck), dec AS (SELECT *, {_AROUSED} AS decay, CASE WHEN strength > 1 THEN pow(strength, 0.3::DOUBLE) ELSE 1::DOUBLE END AS boost FROM adj)"

_add(
    "age_buckets",
    lambda spark, sf_dir: memories(spark, sf_dir).groupBy(s.age_bucket(F.col("ts_ms"), F.lit(NOW_MS)).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(s.age_days(F.col("ts_ms"), F.lit(NOW_MS))), 6).alias("days")),
    f"WITH {AGED} SELECT raw AS bucket, count(*) AS n, round(avg(age / 86400000), 6) AS days FROM buck GROUP BY raw",
)
for _preset, (_d, _f) in s.DECAY_PRESETS.items():
    _add(
        f"decay_buckets_{_preset}",
        lambda spark, sf_dir, d=_d, f=_f: memories(spark, sf_dir).select("id", F.round(s.bucket_decay(s.age_bucket(F.col("ts_ms"), F.lit(NOW_MS)), d, f), 6).alias("decay")),
        f"WITH {AGED} SELECT id, round({DECAY_SQL.format(b='raw').replace('0.10::DOUBLE', f'{_f}::DOUBLE').replace('-0.15::DOUBLE', f'-{_d}::DOUBLE')}, 6) AS decay FROM buck",
    )
_add(
    "decay_with_recalls",
    lambda spark, sf_dir: r.with_decay(memories(spark, sf_dir), NOW_MS).select("id", "bucket", F.round("decay", 6).alias("decay"), F.round("boost", 6).alias("boost")),
    f"WITH {DECAYED} SELECT id, b::INT AS bucket, round(decay, 6) AS decay, round(boost, 6) AS boost FROM dec",
)

_EMB_DEC = DECAYED.replace(MEMORIES_SQL, EMBEDDED_SQL).replace("aged AS (SELECT *,", "aged AS (SELECT *,").replace("FROM mem), buck", "FROM emb), buck")
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"


def _recall_sql(score: str, where: str, k: int = 10, columns: str = "") -> str:
    return f"""WITH {_EMB_DEC}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
      x AS (SELECT query_id, id, list_distance(q, vector) AS l2, dec.* EXCLUDE (id) FROM q, dec WHERE {where}),
      y AS (SELECT query_id, id, round({score}, 6) AS score{columns} FROM x)
      SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, {_RANK} FROM y) WHERE rank <= {k}"""


_OPEN = "NOT tombstoned AND NOT contradicted"


def _recalled(wanted):
    return lambda spark, sf_dir: r.recall(embedded(spark, sf_dir), asked(spark, sf_dir), wanted, NOW_MS).select("query_id", "id", "score", "rank")


_add("cognitive_recall", _recalled(r.Recall()), _recall_sql("1 / (1 + l2) * (1 + 0.4::DOUBLE * (importance / 10) * decay * boost) * 1.3::DOUBLE", _OPEN))
_add("semantic_recall_additive", _recalled(r.Recall(additive=True, gates=Gates(memory_types=("SEMANTIC",)))), _recall_sql("0.6::DOUBLE / (1 + l2) + 0.4::DOUBLE * importance * decay", f"{_OPEN} AND memory_type = 'SEMANTIC'"))
_add(
    "recall_with_mask",
    _recalled(r.Recall(query_mask=1 | 1 << 5, gates=Gates(any_tags=1 | 1 << 5))),
    _recall_sql("1 / (1 + l2) * (1 + 0.4::DOUBLE * (importance / 10) * decay * boost) * (1 + bit_count(tag_mask & 33) / 2 * 0.3::DOUBLE)", f"{_OPEN} AND (tag_mask & 33) <> 0"),
)
_PROFILE_WHERE = {}
for _name, _p in s.PROFILES.items():
    _where = _OPEN
    if _p.min_valence != -128:
        _where += f" AND valence >= {_p.min_valence}"
    if _p.max_valence != 127:
        _where += f" AND valence <= {_p.max_valence}"
    if "min_importance" in _p.options:
        _where += f" AND importance >= {_p.options['min_importance']}::DOUBLE"
    if "memory_types" in _p.options:
        _where += " AND memory_type IN ('SEMANTIC', 'PROCEDURAL')"
    _score = f"1 / (1 + l2 * {_p.options.get('strictness', 1.0)}::DOUBLE) * (1 + {_p.beta}::DOUBLE * (importance / 10) * decay * boost)"
    if "query_valence" in _p.options:
        _score += f" * (1 - abs({_p.options['query_valence']} - valence) / 255)"
    _score += f" * 1.3::DOUBLE * {_p.options.get('focus', 1.0)}::DOUBLE"
    _add(f"recall_profile_{_name.lower()}", _recalled(r.options(_name, lateral=False)), _recall_sql(_score, _where))


def lateral(spark, sf_dir):
    wanted = r.Recall(lateral=True, query_mask=1 | 1 << 5)
    return r.recall(embedded(spark, sf_dir), asked(spark, sf_dir), wanted, NOW_MS).where("branch = 'lateral'").select("query_id", "id", "score", "rank")


_add("lateral_recall", lateral, _recall_sql("greatest(0, 1 - 0.25::DOUBLE * pow(l2 * l2 - 2, 2)) * (bit_count(tag_mask & 33) / 2) * (1 + importance / 10 * decay)", f"{_OPEN} AND l2 > 1.2 AND bit_count(tag_mask & 33) / 2 >= 0.5", 3))


def late_text(spark, sf_dir):
    """The texts of what was recalled: joined to the best only."""
    best = r.recall(embedded(spark, sf_dir), asked(spark, sf_dir), r.Recall(k=3), NOW_MS)
    return best.join(memories(spark, sf_dir).select("id", "text", "tags"), "id").select("query_id", "id", "rank", F.md5("text").alias("digest"), "tags")


_add("late_materialization", late_text, _recall_sql("1 / (1 + l2) * (1 + 0.4::DOUBLE * (importance / 10) * decay * boost) * 1.3::DOUBLE", _OPEN, 3).replace("SELECT query_id, id, score, rank::INT AS rank FROM (SELECT", "SELECT query_id, w.id, rank::INT AS rank, md5(mem.text) AS digest, mem.tags FROM (SELECT").replace("FROM y) WHERE", "FROM y) w JOIN mem ON w.id = mem.id WHERE"))


def results(spark, sf_dir, k: int = 10):
    rows = r.recall(embedded(spark, sf_dir), asked(spark, sf_dir), r.Recall(k=k), NOW_MS).select("query_id", "id", "score")
    return rows.join(memories(spark, sf_dir), "id")


_RESULTS = _recall_sql("1 / (1 + l2) * (1 + 0.4::DOUBLE * (importance / 10) * decay * boost) * 1.3::DOUBLE", _OPEN).replace("SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *", ", res AS (SELECT query_id, id, score FROM (SELECT *") + ")"
_add(
    "introspection",
    lambda spark, sf_dir: r.introspected(results(spark, sf_dir), NOW_MS),
    f"""{_RESULTS}, j AS (SELECT res.query_id, mem.* FROM res JOIN mem USING (id)),
      a AS (SELECT query_id, count(*) AS n, avg(importance) AS imp, avg(valence) AS v, avg(({NOW_MS} - ts_ms) / 86400000) AS days, avg(agent_recalls) AS rec, avg((agent_recalls > 0)::INT) AS f FROM j GROUP BY query_id)
      SELECT query_id, n, round(imp, 6) AS importance, round(v, 6) AS valence, round(days, 6) AS age_days,
        round(least(1, n / 20) * 0.4::DOUBLE + f * 0.3::DOUBLE + least(1, imp / 5) * 0.3::DOUBLE, 6) AS confidence,
        (CASE WHEN days < 1 THEN 0 WHEN days < 7 THEN 0.2 WHEN days < 30 THEN 0.5 WHEN days < 90 THEN 0.7 ELSE 0.9 END)::DOUBLE AS staleness,
        round(CASE WHEN days > 0 THEN rec / days ELSE rec END, 6) AS recalls_a_day FROM a""",
)
_BUDGET = " ".join(f"WHEN '{tier}' THEN {int(800 * r.CHARS_PER_TOKEN * share)}" for tier, share in r.PACK_SHARES.items())
_add(
    "context_pack",
    lambda spark, sf_dir: r.context_pack(results(spark, sf_dir), 800),
    f"""{_RESULTS.replace('WITH', 'WITH RECURSIVE', 1)}, it AS (SELECT query_id, memory_type, res.id, length(text) AS len, row_number() OVER (PARTITION BY query_id, memory_type ORDER BY score DESC, res.id) AS n, CASE memory_type {_BUDGET} ELSE 0 END AS budget FROM res JOIN mem ON res.id = mem.id),
      fo AS (SELECT query_id, memory_type, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id, 0::BIGINT AS took FROM it GROUP BY ALL
        UNION ALL SELECT fo.query_id, fo.memory_type, it.n, CASE WHEN used + len <= budget THEN used + len ELSE used END, CASE WHEN used + len <= budget THEN it.id END, took + (used + len <= budget)::INT
        FROM fo JOIN it ON it.query_id = fo.query_id AND it.memory_type = fo.memory_type AND it.n = fo.n + 1)
      SELECT query_id, memory_type, (took - 1)::INT AS place, id FROM fo WHERE id IS NOT NULL""",
)
_add(
    "mmr_rerank",
    lambda spark, sf_dir: r.mmr(results(spark, sf_dir, 30).select("query_id", "id", "score").join(embedded(spark, sf_dir).select("id", "vector"), "id"), 10, 0.5),
    f"""{_RESULTS.replace('WITH', 'WITH RECURSIVE', 1).replace('rank <= 10', 'rank <= 30')}, ca AS MATERIALIZED (SELECT query_id, res.id, score, vector FROM res JOIN emb ON res.id = emb.id),
      pk AS (SELECT query_id, 1 AS place, id, [id] AS taken, [vector] AS tv FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM ca) WHERE n = 1
        UNION ALL SELECT query_id, place + 1, id, list_append(taken, id), list_append(tv, vector) FROM (SELECT pk.query_id, pk.place, ca.id, pk.taken, pk.tv, ca.vector,
          row_number() OVER (PARTITION BY pk.query_id ORDER BY round(0.5::DOUBLE * ca.score - 0.5::DOUBLE * list_max([1 / (1 + list_distance(ca.vector, u)) for u in pk.tv]), 9) DESC, ca.score DESC, ca.id) AS n
          FROM pk JOIN ca ON ca.query_id = pk.query_id AND NOT list_contains(pk.taken, ca.id) WHERE pk.place < 10) WHERE n = 1)
      SELECT query_id, id, place::INT AS place FROM pk""",
)
_add(
    "temperature_softmax",
    lambda spark, sf_dir: r.tempered(results(spark, sf_dir).select("query_id", "id", "score"), 0.5).select("query_id", "id", F.round("score", 6).alias("score")),
    f"""{_RESULTS}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS m, sum(score) OVER (PARTITION BY query_id) AS t FROM res), e AS (SELECT *, exp((score - m) / 0.5::DOUBLE) AS e FROM m)
      SELECT query_id, id, round(e / sum(e) OVER (PARTITION BY query_id) * t, 6) AS score FROM e""",
)
_add("adaptive_temperature", lambda spark, sf_dir: base(spark, sf_dir).select("id", F.round(s.temperature(1.0, F.get("vector", F.lit(0)) * 40.0), 6).alias("temperature")), "SELECT vec_id AS id, round(least(greatest(1 + 0.15::DOUBLE * greatest(embedding[1]::DOUBLE * 40, 0), 0.1), 5), 6) AS temperature FROM embeddings")


def uses(spark, sf_dir):
    """Recalls: the clicks of the events."""
    return read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"), epoch_ms().alias("ts_ms"))


_LAST_MS = 1_706_572_800_000
_add(
    "habituation_and_inhibition",
    lambda spark, sf_dir: r.habituated(memories(spark, sf_dir).select("id", F.col("importance").alias("score")), uses(spark, sf_dir), _LAST_MS).select("id", F.round("penalty", 6).alias("penalty"), F.round("score", 6).alias("score")),
    f"""WITH {MEMORIES_SQL}, u AS (SELECT user_id AS id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'click'), n AS (SELECT id, count(*) AS n, max(t) AS last FROM u GROUP BY id),
      f AS (SELECT DISTINCT id FROM (SELECT id FROM u ORDER BY t DESC, id LIMIT 10)),
      p AS (SELECT mem.id, importance, least(CASE WHEN n IS NULL THEN 1 ELSE 1 / (1 + (n - 1) * 0.2::DOUBLE) END, coalesce(0.1::DOUBLE + 0.9::DOUBLE * least(greatest(({_LAST_MS} - last) / 300000, 0), 1), 1))
        * CASE WHEN f.id IS NULL THEN 1 ELSE 0.5::DOUBLE END AS penalty FROM mem LEFT JOIN n USING (id) LEFT JOIN f ON f.id = mem.id)
      SELECT id, round(penalty, 6) AS penalty, round(importance * penalty, 6) AS score FROM p""",
)


def act_r(spark, sf_dir):
    """Activation of memories that were recalled, from their last three recalls."""
    stamps = uses(spark, sf_dir).groupBy("id").agg(F.collect_list("ts_ms").alias("stamps"))
    rows = memories(spark, sf_dir).join(stamps, "id", "left").withColumn("stamps", F.coalesce("stamps", F.array().cast("array<bigint>")))
    return rows.select("id", F.round(s.activation(F.lit(NOW_MS), F.col("ts_ms"), F.col("stamps")), 6).alias("activation"))


_add(
    "act_r_activation",
    act_r,
    f"""WITH {MEMORIES_SQL}, u AS (SELECT user_id AS id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE event_type = 'click'),
      a AS (SELECT id, {NOW_MS} - least(t, {NOW_MS} - 1000) AS age FROM u WHERE n <= 3), b AS (SELECT id, {BUCKET_SQL} AS b FROM a), d AS (SELECT id, sum({DECAY_SQL.format(b='b')}) AS s FROM b GROUP BY id),
      m AS (SELECT id, {BUCKET_SQL} AS b FROM (SELECT id, {NOW_MS} - ts_ms AS age FROM mem)), t AS (SELECT m.id, d.s + {DECAY_SQL.format(b='b')} AS s FROM m LEFT JOIN d USING (id))
      SELECT id, round(CASE WHEN s IS NULL THEN -1 ELSE s / (s + 1) END, 6) AS activation FROM t""",
)
_add(
    "two_factor_strength",
    lambda spark, sf_dir: r.with_decay(memories(spark, sf_dir), NOW_MS).select("id", F.round(s.strengthened(F.col("strength"), F.col("decay")), 6).alias("strength")),
    f"WITH {DECAYED} SELECT id, round(least(strength + 0.1::DOUBLE * (1 - decay), 5), 6) AS strength FROM dec",
)


def auto_ltp(spark, sf_dir, cooldown_ms: int = 300_000):
    """Recalls that come after the cooldown strengthen: one count and .05, 5 at most."""
    order = Window.partitionBy("id").orderBy("ts_ms")
    rows = uses(spark, sf_dir).distinct().withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(order))
    counted = rows.where(F.col("gap").isNull() | (F.col("gap") >= cooldown_ms)).groupBy("id").agg(F.count("*").alias("n"))
    return memories(spark, sf_dir).join(counted, "id").select("id", (F.col("auto_recalls") + F.col("n")).alias("auto_recalls"), F.round(F.least(F.col("strength") + F.col("n") * 0.05, F.lit(5.0)), 6).alias("strength"))


_add(
    "auto_ltp",
    auto_ltp,
    f"""WITH {MEMORIES_SQL}, u AS (SELECT DISTINCT user_id AS id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'click'), g AS (SELECT id, t - lag(t) OVER (PARTITION BY id ORDER BY t) AS gap FROM u),
      n AS (SELECT id, count(*) AS n FROM g WHERE gap IS NULL OR gap >= 300000 GROUP BY id)
      SELECT mem.id, auto_recalls + n AS auto_recalls, round(least(strength + n * 0.05::DOUBLE, 5), 6) AS strength FROM mem JOIN n USING (id)""",
)


def _u(k, n):
    return (F.col("id") * k % n) / F.lit(float(n))


_add(
    "icnu_importance",
    lambda spark, sf_dir: memories(spark, sf_dir).select("id", F.round(s.icnu(_u(7, 10), _u(3, 7), _u(11, 13), _u(5, 9)), 6).alias("importance"), F.round(s.icnu(_u(7, 10), _u(3, 7), _u(11, 13), _u(5, 9), steepness=0.0), 6).alias("linear")),
    f"""WITH {MEMORIES_SQL}, h AS (SELECT id, (id * 7 % 10) / 10 AS i, (id * 3 % 7) / 7 AS c, (id * 11 % 13) / 13 AS n, (id * 5 % 9) / 9 AS u FROM mem)
      SELECT id, round(least(greatest(0.05::DOUBLE + 9.95::DOUBLE / (1 + exp(-8 * (0.3::DOUBLE * i * n + 0.1::DOUBLE * c + 0.2::DOUBLE * u - 0.2::DOUBLE))), 0.05), 10), 6) AS importance,
        round(least(greatest(0.05::DOUBLE + 9.95::DOUBLE * (0.3::DOUBLE * i + 0.1::DOUBLE * c + 0.4::DOUBLE * n + 0.2::DOUBLE * u), 0.05), 10), 6) AS linear FROM h""",
)
_add(
    "surprise_importance",
    lambda spark, sf_dir: r.running_surprise(read(spark, sf_dir, "events"), "value", ("ts", "event_id"), ("event_type",)).select("event_id", F.round("z", 4).alias("z"), F.round("importance", 4).alias("importance"), "pinned"),
    """WITH w AS (SELECT event_id, value, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s FROM events
        WINDOW p AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      z AS (SELECT event_id, CASE WHEN n >= 20 AND s > 1e-12 THEN (value - m) / s ELSE 0 END AS z FROM w)
      SELECT event_id, round(z, 4) AS z, round(CASE WHEN z > 3 THEN 10 ELSE 0.05::DOUBLE + 9.95::DOUBLE / (1 + exp(-1.2::DOUBLE * (z - 1))) END, 4) AS importance, z > 3 AS pinned FROM z""",
)


def dual_surprise(spark, sf_dir):
    """Surprise of the value and of the gap since the last event, .6 and .4."""
    by = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("gap", (epoch_ms() - F.lag(epoch_ms()).over(by)) / F.lit(1e3))
    first = r.running_surprise(e, "value", ("ts", "event_id"), ("event_type",)).withColumnRenamed("z", "zs").drop("importance", "pinned")
    both = r.running_surprise(first, "gap", ("ts", "event_id"), ("event_type",))
    z = 0.6 * F.col("zs") + 0.4 * F.coalesce("z", F.lit(0.0))
    return both.select("event_id", F.round(s.surprise_importance(z), 2).alias("importance"))


_add(
    "dual_surprise",
    dual_surprise,
    """WITH e AS (SELECT *, ((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1e3 AS gap FROM events),
      w AS (SELECT event_id, value, gap, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s, count(gap) OVER p AS gn, avg(gap) OVER p AS gm, stddev_pop(gap) OVER p AS gs FROM e
        WINDOW p AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      z AS (SELECT event_id, 0.6::DOUBLE * CASE WHEN n >= 20 AND s > 1e-12 THEN (value - m) / s ELSE 0 END + 0.4::DOUBLE * CASE WHEN gn >= 20 AND gs > 1e-12 THEN coalesce((gap - gm) / gs, 0) ELSE 0 END AS z FROM w)
      SELECT event_id, round(0.05::DOUBLE + 9.95::DOUBLE / (1 + exp(-1.2::DOUBLE * (z - 1))), 2) AS importance FROM z""",
)


def valences(spark, sf_dir):
    """Outcomes of a user's events folded in order."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "error", -100).otherwise(10).alias("o"))
    rows = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "o"))), lambda x: x["o"]).alias("o"))
    return rows.select("user_id", s.valence_fold(F.lit(0), F.col("o")).cast("int").alias("valence"), F.size("o").alias("n"))


_add(
    "valence_fold",
    valences,
    """WITH o AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN -100 ELSE 10 END ORDER BY ts, event_id)::DOUBLE[] AS o FROM events GROUP BY user_id)
      SELECT user_id, list_reduce(list_prepend(0::DOUBLE, o), lambda v, x: least(greatest(floor(v * 0.7::DOUBLE + x * 0.3::DOUBLE + 0.5::DOUBLE), -128), 127))::INT AS valence, len(o)::INT AS n FROM o""",
)
_add(
    "reinforce_with_hints",
    lambda spark, sf_dir: memories(spark, sf_dir).select("id", F.round(s.reinforced_with_hints(F.col("importance"), s.icnu(_u(7, 10), _u(3, 7), _u(11, 13), _u(5, 9)), F.col("agent_recalls")), 6).alias("hinted"), F.round(s.reinforced_with_hints(F.col("importance"), None, F.col("agent_recalls")), 9).alias("degree")),
    f"""WITH {MEMORIES_SQL}, h AS (SELECT *, (id * 7 % 10) / 10 AS i, (id * 3 % 7) / 7 AS c, (id * 11 % 13) / 13 AS n, (id * 5 % 9) / 9 AS u FROM mem)
      SELECT id, round(0.5::DOUBLE * importance + 0.5::DOUBLE * least(greatest(0.05::DOUBLE + 9.95::DOUBLE / (1 + exp(-8 * (0.3::DOUBLE * i * n + 0.1::DOUBLE * c + 0.2::DOUBLE * u - 0.2::DOUBLE))), 0.05), 10), 6) AS hinted,
        round(importance * (1 + least(0.3::DOUBLE, 0.05::DOUBLE * agent_recalls)), 9) AS degree FROM h""",
)
_add("profile_detection", lambda spark, sf_dir: read(spark, sf_dir, "events").select("event_id", s.detected_profile(F.array("event_type", F.concat(F.lit("fix-"), F.col("user_id").cast("string")))).alias("profile")).groupBy("profile").agg(F.count("*").alias("n")), "SELECT 'DEBUGGING' AS profile, count(*) AS n FROM events")


def profile_bandit(spark, sf_dir):
    """Outcomes of profiles in contexts (the kind of an event)."""
    e = read(spark, sf_dir, "events")
    names = F.array(*[F.lit(n) for n in ("BALANCED", "EXPLORING", "CRITICAL")])
    rows = e.select(F.col("event_type").alias("context"), F.element_at(names, (F.col("user_id") % 3 + 1).cast("int")).alias("profile"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("reward"), "ts", "event_id")
    return r.bandit(rows, "context", ("ts", "event_id"))


_add(
    "profile_bandit",
    profile_bandit,
    """WITH o AS (SELECT event_type AS context, ['BALANCED', 'EXPLORING', 'CRITICAL'][(user_id % 3 + 1)::INT] AS profile, list((value > 50)::INT ORDER BY ts, event_id)::DOUBLE[] AS r FROM events GROUP BY ALL),
      v AS (SELECT context, profile, len(r) AS n, list_reduce(list_prepend(0.5::DOUBLE, r), lambda m, x: m * (1 - 0.15::DOUBLE) + x * 0.15::DOUBLE) AS value FROM o),
      k AS (SELECT *, sum(n) OVER (PARTITION BY context) AS signals, row_number() OVER (PARTITION BY context ORDER BY value DESC, profile) AS place FROM v)
      SELECT context, CASE WHEN signals >= 10 THEN profile ELSE 'BALANCED' END AS profile, round(value, 6) AS value, signals::BIGINT AS signals FROM k WHERE place = 1""",
)
_add("provenance_confidence", lambda spark, sf_dir: memories(spark, sf_dir).groupBy("provenance").agg(F.round(F.avg(s.confidence_of(F.col("provenance"))), 6).alias("confidence"), F.count("*").alias("n")), f"WITH {MEMORIES_SQL} SELECT provenance, (CASE provenance WHEN 'OBSERVED' THEN 0.9 WHEN 'USER_STATED' THEN 1 WHEN 'REFLECTED' THEN 0.7 WHEN 'INFERRED' THEN 0.5 WHEN 'PROCEDURAL' THEN 1 ELSE 0.6 END)::DOUBLE AS confidence, count(*) AS n FROM mem GROUP BY provenance")
def _hopfield_sql() -> str:
    """Three steps of softmax(8 X q) X, and the energy of the last state."""
    steps = []
    for k in range(3):
        steps.append(f"""z{k} AS (SELECT query_id, x.id, 8 * list_dot_product(q, v) AS z FROM s{k}, x), w{k} AS (SELECT query_id, id, exp(z - max(z) OVER (PARTITION BY query_id)) AS w FROM z{k}),
          s{k + 1} AS MATERIALIZED (SELECT query_id, list(t ORDER BY i) AS q FROM (SELECT query_id, i, sum(w * a) / sum(w) AS t FROM (SELECT query_id, w, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS a FROM w{k} JOIN x USING (id)) GROUP BY query_id, i) GROUP BY query_id)""")
    return f"""WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s0 AS (SELECT id AS query_id, v AS q FROM x WHERE id % 20 = 0), {', '.join(steps)},
      e AS (SELECT query_id, max(z) AS top, z FROM (SELECT query_id, 8 * list_dot_product(q, v) AS z FROM s3, x) GROUP BY query_id, z), t AS (SELECT query_id, max(z) AS top FROM e GROUP BY query_id),
      n AS (SELECT s3.query_id, t.top + ln(sum(exp(8 * list_dot_product(q, v) - t.top))) AS l FROM s3 JOIN t USING (query_id), x GROUP BY s3.query_id, t.top)
      SELECT s3.query_id, [round(y, 4) + 0 for y in q] AS state, round(list_dot_product(q, q) / 2 - l / 8, 5) AS energy FROM s3 JOIN n USING (query_id)"""


_add("hopfield_recall", lambda spark, sf_dir: r.hopfield(base(spark, sf_dir), asked(spark, sf_dir)).select("query_id", F.transform("state", lambda x: F.round(x, 4) + F.lit(0.0)).alias("state"), F.round("energy", 5).alias("energy")), _hopfield_sql())
_add("integrated_information", lambda spark, sf_dir: r.integrated_information(base(spark, sf_dir).select(F.floor(F.col("id") / 8).alias("group_id"), "id", "vector")).select("group_id", F.round("phi", 4).alias("phi"), "n"))


def topic_boost(spark, sf_dir):
    """The largest similarity to a profile's topics (the mean vectors of the labels) as a boost."""
    from lodestar.plans.vectors import label_centres

    centres = label_centres(spark, sf_dir)
    sims = F.array(*[F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) for c in centres])
    return base(spark, sf_dir).select("id", F.round(1.0 + F.greatest(F.array_max(sims), F.lit(0.0)), 5).alias("boost"))


_add("topic_boost", topic_boost, "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY label, i) GROUP BY label) SELECT id, round(1 + greatest(max(list_dot_product(v, m)), 0), 5) AS boost FROM e, c GROUP BY id")
_add(
    "lateral_evaluator",
    lambda spark, sf_dir: memories(spark, sf_dir).agg(F.round(F.avg((F.col("agent_recalls") > 3).cast("double")), 6).alias("used"), F.round(F.avg(F.when(F.col("valence") > 0, 1.0).otherwise(0.0)), 6).alias("success")).withColumn("state", F.when(F.col("used") < 0.05, "DISABLED").when(F.col("used") < 0.10, "RAISED").otherwise("KEPT")),
    f"WITH {MEMORIES_SQL}, a AS (SELECT avg((agent_recalls > 3)::INT) AS u, avg((valence > 0)::INT) AS s FROM mem) SELECT round(u, 6) AS used, round(s, 6) AS success, CASE WHEN u < 0.05 THEN 'DISABLED' WHEN u < 0.10 THEN 'RAISED' ELSE 'KEPT' END AS state FROM a",
)
