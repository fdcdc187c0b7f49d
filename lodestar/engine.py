"""A memory engine over Parquet: remember, recall, forget, consolidate.

State is event-sourced: every write appends the rows that it changes to a journal in
the engine's folder, and ``vacuum`` and ``reflect`` fold it into a snapshot. A write that
fails leaves nothing behind, and an engine opened on the folder again goes on from the
newest state. Recalls only read; ``learn`` writes their effect.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import bits, scoring
from lodestar.operators import changes, consolidation, facts, gates, graph, lexical, policies, recall
from lodestar.sources import sinks
from lodestar.sources.journal import Journal

SCHEMA = (
    "id long, text string, memory_type string, provenance string, tags array<string>, tag_mask long, ts_ms long, importance double, valence int, arousal int, "
    "agent_recalls int, auto_recalls int, strength double, tombstoned boolean, pinned boolean, resolved boolean, contradicted boolean, retracted boolean, unverified boolean, "
    "restricted boolean, session_id long, metadata map<string,string>, vector array<double>"
)
FACTS = "fact_id long, subject long, predicate string, object long, valid_from long, valid_to long, tx_time long, confidence double, retracts long, inferred boolean"
_DEFAULTS = {
    "memory_type": F.lit("EPISODIC"), "provenance": F.lit("OBSERVED"), "importance": F.lit(5.0), "valence": F.lit(0), "arousal": F.lit(0), "agent_recalls": F.lit(0), "auto_recalls": F.lit(0),
    "strength": F.lit(1.0), "tombstoned": F.lit(False), "pinned": F.lit(False), "resolved": F.lit(False), "contradicted": F.lit(False), "retracted": F.lit(False), "unverified": F.lit(False),
    "restricted": F.lit(False), "session_id": F.lit(0).cast("long"), "metadata": F.create_map().cast("map<string,string>"),
}


class MemoryEngine:
    """Memories in a folder that every executor sees."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column], now_ms: Callable[[], int] | None = None):
        import time

        self.spark, self.folder, self.embed = spark, folder, embed
        self.now_ms = now_ms or (lambda: int(time.time() * 1000))
        self.journal = Journal(spark, f"{folder}/memories", SCHEMA)
        self._facts = Journal(spark, f"{folder}/facts", FACTS, "fact_id")
        self._reminders = Journal(spark, f"{folder}/reminders", "id long, trigger_ms long")
        self._notes = Journal(spark, f"{folder}/scratchpad", "name string, text string", "name")
        self._suppressed: set[int] = set()

    # ---- state ----

    @property
    def version(self) -> int:
        """The number of the newest write, 0 for none."""
        return self.journal.version()

    def memories(self) -> DataFrame:
        """All memories, forgotten ones marked."""
        return self.journal.rows()

    # ---- writing ----

    def remember(self, rows: DataFrame) -> None:
        """Add rows of id and text (other columns have defaults); known ids are left alone."""
        new = changes.remembered(self.memories(), rows)
        for name, value in _DEFAULTS.items():
            if name not in new.columns:
                new = new.withColumn(name, value)
        if "tags" not in new.columns:
            new = new.withColumn("tags", F.array().cast("array<string>"))
        if "ts_ms" not in new.columns:
            new = new.withColumn("ts_ms", F.lit(self.now_ms()))
        new = new.withColumn("tag_mask", bits.tag_filter(F.col("tags")))
        if "vector" not in new.columns:
            new = new.withColumn("vector", self.embed(F.col("text")).cast("array<double>"))
        self.journal.put(new)

    def forget(self, *ids: int) -> None:
        """Mark memories as forgotten."""
        self._update(ids, tombstoned=F.lit(True))

    def _update(self, ids: tuple[int, ...], **values: Column) -> None:
        """Append the chosen memories with new values, each from the old ones."""
        self.journal.put(self.memories().where(F.col("id").isin(*ids)).withColumns(values))

    def reinforce(self, memory: int, valence: int = 0) -> None:
        """One more recall: the valence follows, the strength grows."""
        mood = F.least(F.greatest(F.floor(F.col("valence") * 0.7 + valence * 0.3 + 0.5), F.lit(-128)), F.lit(127)).cast("int")
        decay = scoring.bucket_decay(scoring.age_bucket(F.col("ts_ms"), F.lit(self.now_ms())))
        self._update((memory,), valence=mood, agent_recalls=F.col("agent_recalls") + 1, strength=scoring.strengthened(F.col("strength"), decay))

    def resolve(self, *ids: int) -> None:
        """From now on these decay."""
        self._update(ids, resolved=F.lit(True))

    def pin(self, *ids: int) -> None:
        self._update(ids, pinned=F.lit(True))

    def suppress(self, *ids: int) -> None:
        """Leave memories out of recalls, for this engine object."""
        self._suppressed |= set(ids)

    def unsuppress(self, *ids: int) -> None:
        self._suppressed -= set(ids)

    def vacuum(self) -> None:
        """Drop what is forgotten."""
        self.journal.replace(changes.vacuumed(self.memories()))

    def reflect(self, retention_ms: int = 365 * 86_400_000) -> None:
        """Prune, fade, retain."""
        self.journal.replace(consolidation.reflected(self.memories(), self.now_ms(), retention_ms))

    def decay(self, older_ms: int, factor: float) -> None:
        older = self.memories().where(F.lit(self.now_ms()) - F.col("ts_ms") > older_ms)
        self.journal.put(consolidation.bulk_decayed(older, self.now_ms(), older_ms, factor))

    # ---- facts, reminders, notes, replicas ----

    def facts(self, **options) -> DataFrame:
        """The facts that hold, by ``operators.facts.query``'s options."""
        return facts.query(self._facts.rows(), **options)

    def assert_facts(self, new: DataFrame, coexisting: tuple[str, ...] = ()) -> None:
        """Add facts; the open fact of a subject and predicate ends where a new one begins."""
        now = F.lit(self.now_ms())
        defaults = {"valid_from": now, "valid_to": F.lit(facts.OPEN), "tx_time": now, "confidence": F.lit(1.0), "retracts": F.lit(None).cast("long"), "inferred": F.lit(False)}
        rows = new.withColumns({k: v for k, v in defaults.items() if k not in new.columns}).select(*self._facts.columns)
        before = self._facts.rows()
        after = facts.asserted(before, rows, coexisting).select(*self._facts.columns)
        ends = before.select("fact_id", F.col("valid_to").alias("_old"))
        # Only new facts and those whose end has moved are written.
        self._facts.put(after.join(ends, "fact_id", "left").where("_old IS NULL OR _old <> valid_to").drop("_old"))

    def retract(self, fact_id: int, by: int) -> None:
        """Add a fact that retracts another."""
        old = self._facts.rows().where(F.col("fact_id") == fact_id)
        self._facts.put(old.withColumns({"fact_id": F.lit(by).cast("long"), "retracts": F.lit(fact_id).cast("long"), "tx_time": F.lit(self.now_ms())}).select(*self._facts.columns))

    def fact_history(self) -> DataFrame:
        return facts.history(self._facts.rows())

    def multi_evidence(self) -> DataFrame:
        """For each subject and predicate the best fact and what its evidence allows."""
        return facts.evidence(self.facts())

    def remind(self, memory: int, trigger_ms: int) -> None:
        self._reminders.put(self.spark.createDataFrame([(memory, trigger_ms)], "id long, trigger_ms long"))

    def reminders_due(self) -> DataFrame:
        """Memories whose reminder has come, with the highest score."""
        return consolidation.reminders_due(self._reminders.rows(), self.now_ms()).join(self.memories().where(~F.col("tombstoned")).select("id", "text"), "id")

    def note(self, name: str, text: str | None) -> None:
        """Write a note of the scratchpad; none takes it out."""
        if text is None:
            self._notes.drop(self.spark.createDataFrame([(name,)], "name string"))
        else:
            self._notes.put(self.spark.createDataFrame([(name, text)], "name string, text string"))

    def notes(self) -> dict[str, str]:
        return {r["name"]: r["text"] for r in self._notes.rows().collect()}

    def merge_from(self, other: MemoryEngine) -> None:
        """Take over what another replica knows: its memories, and the newer headers."""
        mine, theirs = self.memories(), other.memories()
        header = ("ts_ms", "tag_mask", "importance", "agent_recalls", "valence", "tombstoned", "pinned")
        both = changes.merged(mine.select("id", *header), theirs.select("id", *header)).select("id", *[F.col(c).alias(f"_{c}") for c in header])
        bodies = mine.unionByName(theirs.join(mine.select("id"), "id", "left_anti"))
        rows = bodies.join(both, "id")
        changed = rows.where(" OR ".join(f"NOT ({c} <=> _{c})" for c in header)).withColumns({c: F.col(f"_{c}") for c in header}).select(*self.journal.columns)
        new = theirs.join(mine.select("id"), "id", "left_anti").join(changed.select("id"), "id", "left_anti")
        self.journal.put(changed.unionByName(new.select(*self.journal.columns)))

    def would_change(self, other: MemoryEngine) -> DataFrame:
        """id, change: what merging another replica would alter."""
        header = ("id", "ts_ms", "tag_mask", "importance", "agent_recalls", "tombstoned", "pinned")
        return changes.would_change(self.memories().select(*header), other.memories().select(*header))

    def export_bundle(self, path: str) -> None:
        """Memories and facts as a bundle with checksums."""
        sinks.export_bundle({"memories": self.memories().withColumn("metadata", F.to_json("metadata")), "facts": self._facts.rows()}, path)

    def import_bundle(self, path: str) -> None:
        """Add a bundle's memories that aren't known, and its facts."""
        tables = sinks.import_bundle(self.spark, path)
        memories = tables["memories"].withColumn("metadata", F.from_json("metadata", "map<string,string>"))
        self.journal.put(memories.join(self.memories().select("id"), "id", "left_anti").select(*self.journal.columns))
        self._facts.put(tables["facts"].select(*self._facts.columns))

    # ---- reading ----

    def suppressed(self) -> list[int]:
        return sorted(self._suppressed)

    def unresolved(self) -> DataFrame:
        """Memories that don't decay until they are resolved."""
        return self.memories().where(~F.col("resolved") & ~F.col("tombstoned")).orderBy("id")

    def session(self, session_id: int, last: int | None = None) -> DataFrame:
        """A session's memories in order, or its last ones."""
        rows = self.memories().where((F.col("session_id") == session_id) & ~F.col("tombstoned"))
        return rows.orderBy("ts_ms", "id") if last is None else rows.orderBy(F.desc("ts_ms"), F.desc("id")).limit(last)

    def tombstone_ratios(self) -> DataFrame:
        return changes.tombstone_ratios(self.memories())

    def consolidation_due(self, last_ms: int) -> DataFrame:
        """What is due for a reflection since the last one."""
        return policies.consolidation_due(self.memories(), last_ms, self.now_ms())

    def similar_tags(self, n: int = 5) -> DataFrame:
        """tag, other, n: the tags that occur together most."""
        return graph.associated(graph.co_activation(self.memories().where(~F.col("tombstoned"))), n)

    def graph_recall(self, subject: int, hops: int = 2) -> DataFrame:
        """Paths over the facts from a subject, both ways."""
        edges = self.facts().select(F.col("subject").alias("src"), F.col("predicate").alias("relation"), F.col("object").alias("dst"))
        return graph.paths(edges, self.spark.createDataFrame([(subject,)], "id long"), hops=hops)

    def facts_at(self, time_ms: int) -> DataFrame:
        """Memories with the facts about them that held at their time."""
        return facts.woven(self.memories().where(F.col("ts_ms") <= time_ms).select("id", "ts_ms"), self.facts())

    def replay(self) -> DataFrame:
        """Episodes to go over again, each with the same score."""
        return recall.replay_scores(self.memories().where((F.col("memory_type") == "EPISODIC") & ~F.col("tombstoned")).select("id", "text"))

    def inspect(self, memory: int) -> dict | None:
        row = self.memories().where(F.col("id") == memory).first()
        return None if row is None else row.asDict(recursive=True)

    def browse(self, *tags: str) -> DataFrame:
        return gates.browsed(self.memories().where(~F.col("tombstoned")), tags)

    def listed(self, memory_type: str, offset: int = 0, limit: int = 50) -> DataFrame:
        return self.memories().where((F.col("memory_type") == memory_type) & ~F.col("tombstoned")).orderBy("id").offset(offset).limit(limit)

    def _visible(self) -> DataFrame:
        rows = self.memories()
        return rows.where(~F.col("id").isin(*self._suppressed)) if self._suppressed else rows

    def recall(self, *texts: str, profile: str | None = None, tags: tuple[str, ...] = (), hybrid: bool = True, **changes_) -> DataFrame:
        """query_id, id, score, rank, text of the best memories for each text."""
        mask = 0
        for tag in tags:
            mask |= bits.tag_bits(tag)
        mask = mask - (1 << 64) if mask >> 63 else mask
        detected = profile or self.spark.range(1).select(scoring.detected_profile(F.array(*[F.lit(t) for t in (*tags, *texts)])).alias("p")).first()["p"]
        wanted = recall.options(detected, query_mask=mask, **changes_)
        asked = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        queries = asked.select("query_id", self.embed(F.col("text")).cast("array<double>").alias("vector"))
        found = recall.recall(self._visible(), queries, wanted, self.now_ms())
        if hybrid:
            docs = gates.gated(self._visible(), wanted.gates, self.now_ms()).select("id", "text")
            legs = [found.where("branch = 'main'"), lexical.bm25(docs, asked, max(2 * wanted.k, 50))]
            found = lexical.fused(legs, wanted.k)
        return found.join(self.memories().select("id", "text", "memory_type", "tags", "ts_ms", "importance", "valence", "agent_recalls"), "id")

    def learn(self, results: DataFrame) -> None:
        """What a recall leaves behind: one automatic recall for each result."""
        hits = results.groupBy("id").agg(F.count("*").alias("_n"))
        rows = self.memories().join(hits, "id")
        self.journal.put(rows.withColumn("auto_recalls", (F.col("auto_recalls") + F.col("_n")).cast("int")).withColumn("strength", F.least(F.col("strength") + F.col("_n") * 0.05, F.lit(5.0))))

    def why_not(self, memory: int, text: str, k: int = 20) -> str:
        """Why a memory isn't among the best."""
        if self.inspect(memory) is None:
            return "NOT_FOUND"
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string").select("query_id", self.embed(F.col("text")).cast("array<double>").alias("vector"))
        every = recall.Recall(k=1 << 30, gates=gates.Gates(include_tombstoned=True, include_contradicted=True))
        scored = recall.recall(self.memories(), asked, every, self.now_ms()).select("id", "score").join(self.memories().drop("vector"), "id")
        hidden = self.spark.createDataFrame([(i,) for i in self._suppressed], "id long")
        return recall.why_not(scored, gates.Gates(), self.now_ms(), hidden, k).where(F.col("id") == memory).first()["reason"]

    def introspect(self, *texts: str) -> DataFrame:
        return recall.introspected(self.recall(*texts), self.now_ms())

    def context_pack(self, text: str, tokens: int = 3000) -> DataFrame:
        return recall.context_pack(self.recall(text), tokens)

    def status(self) -> dict[str, int]:
        """Memories of each kind that aren't forgotten."""
        return {r["memory_type"]: r["count"] for r in self.memories().where(~F.col("tombstoned")).groupBy("memory_type").count().collect()}

    def export(self) -> DataFrame:
        return changes.exported(self.memories().drop("vector"))

    def exported_lines(self) -> list[dict]:
        """The export of a small engine as Python objects."""
        return [json.loads(r["json"]) for r in self.export().orderBy("id").collect()]
