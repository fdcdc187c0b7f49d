"""Cognitive scoring as Column expressions: decay, boosts, fused scores, learning rules."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_DAY = 86_400_000.0
#: Upper ends, in hours, of the first eleven age buckets, and the buckets' middles, by
#: which they decay. Fixed values.
AGE_ENDS_HOURS = (1, 6, 24, 72, 168, 672, 2160, 4320, 8760, 17520, 43800)
MIDDLES_HOURS = (0.5, 3.5, 15.0, 48.0, 120.0, 420.0, 1440.0, 3240.0, 6480.0, 13140.0, 30660.0, 61320.0)
#: Decay exponent and floor of the three presets. Fixed values.
DECAY_PRESETS = {"default": (0.15, 0.10), "slow": (0.08, 0.15), "fast": (0.30, 0.05)}
#: Arousal quartiles slow decay by these factors. Fixed values.
AROUSAL_FACTORS = (1.0, 1.15, 1.35, 1.65)
#: Confidence of where a memory comes from. Fixed values.
PROVENANCE_CONFIDENCE = {"OBSERVED": 0.9, "USER_STATED": 1.0, "REFLECTED": 0.7, "INFERRED": 0.5, "PROCEDURAL": 1.0, "TRANSFERRED": 0.6}


def decay_table(exponent: float = 0.15, floor: float = 0.10) -> list[float]:
    """The decay of each age bucket, relative to the first, never below the floor."""
    return [1.0] + [max(floor, (m / MIDDLES_HOURS[0]) ** -exponent) for m in MIDDLES_HOURS[1:]]


def age_days(ts_ms: Column, now_ms: Column) -> Column:
    return F.greatest((now_ms - ts_ms) / F.lit(MS_PER_DAY), F.lit(0.0))


def age_bucket(ts_ms: Column, now_ms: Column) -> Column:
    """0 to 11; an age at a bucket's end is in the next, what lies ahead is new."""
    result = F.lit(len(AGE_ENDS_HOURS))
    for k in range(len(AGE_ENDS_HOURS) - 1, -1, -1):
        result = F.when(now_ms - ts_ms < F.lit(AGE_ENDS_HOURS[k] * 3_600_000), F.lit(k)).otherwise(result)
    return result


def reconsolidated(bucket: Column, agent_recalls: Column, auto_recalls: Column | None = None) -> Column:
    """Recalls make a memory younger: halved for each explicit one, less for automatic ones."""
    shifted = F.floor(bucket / F.pow(F.lit(2.0), F.least(agent_recalls, F.lit(5)))).cast("int")
    if auto_recalls is None:
        return shifted
    return F.greatest(shifted - F.least(F.floor(auto_recalls / 3).cast("int"), F.lit(2)), F.lit(0))


def unresolved_bucket(bucket: Column, resolved: Column, pinned: Column) -> Column:
    """What is neither resolved nor pinned stays as if new."""
    return F.when(~resolved & ~pinned, F.lit(0)).otherwise(bucket)


def bucket_decay(bucket: Column, exponent: float = 0.15, floor: float = 0.10) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in decay_table(exponent, floor)]), bucket + 1)


def aroused(decay: Column, arousal: Column) -> Column:
    """Higher arousal (0..255) decays less, at most to no decay."""
    factor = F.element_at(F.array(*[F.lit(x) for x in AROUSAL_FACTORS]), F.least(F.floor(arousal / 64), F.lit(3)).cast("int") + 1)
    return F.least(decay * factor, F.lit(1.0))


def storage_boost(strength: Column) -> Column:
    return F.when(strength > 1.0, F.pow(strength, F.lit(0.3))).otherwise(F.lit(1.0))


def similarity(distance: Column, strictness: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance * strictness)


def overlap(tags: Column, mask: Column) -> Column:
    """Share of the asked bits that are set; 1 if none is asked."""
    asked = F.bit_count(mask)
    return F.when(asked == 0, F.lit(1.0)).otherwise(F.bit_count(tags.bitwiseAND(mask)) / asked)


def fused(sim: Column, importance: Column, decay: Column, boost: Column, beta: float, tag_overlap: Column, tag_boost: float = 0.3, valence: Column | None = None, query_valence: int | None = None, focus: float = 1.0) -> Column:
    """The multiplicative score of a scan."""
    score = sim * (1.0 + beta * (importance / 10.0) * decay * boost)
    if valence is not None and query_valence is not None:
        score = score * (1.0 - F.abs(F.lit(query_valence) - valence) / 255.0)
    score = score * (1.0 + tag_overlap * tag_boost)
    return score * focus if focus != 1.0 else score


def additive(sim: Column, importance: Column, decay: Column, alpha: float, beta: float) -> Column:
    """The additive score of the nearest-neighbour path, importance as it is."""
    return alpha * sim + beta * importance * decay


def lateral(distance: Column, tag_overlap: Column, importance: Column, decay: Column) -> Column:
    """Far in meaning (about a right angle), near in tags."""
    gap = distance * distance - 2.0
    return F.greatest(1.0 - 0.25 * gap * gap, F.lit(0.0)) * tag_overlap * (1.0 + importance / 10.0 * decay)


def activation(now_ms: Column, created_ms: Column, recalls_ms: Column) -> Column:
    """Base-level activation: s / (s + 1), s the decays of the recalls (the last three)
    and of the first encoding; -1 without a recall."""
    last = F.slice(F.sort_array(recalls_ms, asc=False), 1, 3)
    recalled = F.transform(last, lambda t: bucket_decay(age_bucket(F.least(t, now_ms - 1000), now_ms)))
    s = F.aggregate(recalled, F.lit(0.0), lambda a, x: a + x) + bucket_decay(age_bucket(created_ms, now_ms))
    return F.when(F.size(recalls_ms) > 0, s / (s + 1.0)).otherwise(F.lit(-1.0))


def strengthened(strength: Column, retrievability: Column, gain: float = 0.1, cap: float = 5.0) -> Column:
    """Two factors: what was harder to retrieve gains more."""
    return F.least(strength + gain * (1.0 - retrievability), F.lit(cap))


def habituation(recalls: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.greatest(recalls - 1, F.lit(0)) * 0.2)


def inhibition_of_return(now_ms: Column, last_ms: Column, seconds: float = 300.0, least: float = 0.1) -> Column:
    """Rises from the least to 1 over the seconds since the last recall; 1 without any."""
    part = F.least(F.greatest((now_ms - last_ms) / F.lit(seconds * 1000.0), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.lit(least) + (1.0 - least) * part, F.lit(1.0))


def combined_penalty(habit: Column, inhibition: Column, satiated: Column) -> Column:
    return F.least(habit, inhibition) * F.when(satiated, F.lit(0.5)).otherwise(F.lit(1.0))


def temperature(base: float, z: Column, kappa: float = 0.15, low: float = 0.1, high: float = 5.0) -> Column:
    return F.least(F.greatest(F.lit(base) * (1.0 + kappa * F.greatest(z, F.lit(0.0))), F.lit(low)), F.lit(high))


def surprise_importance(z: Column) -> Column:
    return F.lit(0.05) + 9.95 / (1.0 + F.exp(-1.2 * (z - 1.0)))


def flashbulb(z: Column, importance: Column, limit: float = 3.0) -> Column:
    """(importance, pinned)."""
    return F.struct(F.when(z > limit, F.lit(10.0)).otherwise(importance).alias("importance"), (z > limit).alias("pinned"))


def icnu(interest: Column, challenge: Column, novelty: Column, urgency: Column, weights: tuple[float, float, float, float] = (0.30, 0.10, 0.40, 0.20), threshold: float = 0.2, steepness: float = 8.0) -> Column:
    """Interest, challenge, novelty and urgency as an importance of 0.05 to 10.

    Interest counts with novelty only; a sigmoid gates the sum. Without steepness the
    sum is linear.
    """
    total = sum(weights)
    i, c, n, u = (w / total if total > 0 else w for w in weights)
    if steepness <= 0:
        fused_ = i * interest + c * challenge + n * novelty + u * urgency
    else:
        stimulus = i * (interest * novelty) + c * challenge + u * urgency
        fused_ = F.lit(1.0) / (1.0 + F.exp(-steepness * (stimulus - threshold)))
    return F.least(F.greatest(0.05 + fused_ * 9.95, F.lit(0.05)), F.lit(10.0))


def valence_fold(first: Column, outcomes: Column) -> Column:
    """Ordered outcomes: round(.7 old + .3 new), clamped to a byte."""
    return F.aggregate(outcomes, first.cast("double"), lambda v, o: F.least(F.greatest(F.floor(v * 0.7 + o * 0.3 + 0.5).cast("double"), F.lit(-128.0)), F.lit(127.0)))


def reinforced_with_hints(old: Column, hinted: Column | None, degree: Column) -> Column:
    if hinted is not None:
        return 0.5 * old + 0.5 * hinted
    return old * (1.0 + F.least(F.lit(0.3), 0.05 * degree))


def confidence_of(provenance: Column) -> Column:
    result = F.lit(0.5)
    for name, value in PROVENANCE_CONFIDENCE.items():
        result = F.when(provenance == name, F.lit(value)).otherwise(result)
    return result


@dataclass(frozen=True)
class Profile:
    """Weights and ranges of a recall profile."""

    alpha: float
    beta: float
    gamma: float
    min_valence: int = -128
    max_valence: int = 127
    expansion: float = 0.40
    options: dict = field(default_factory=dict)


#: Fixed values.
PROFILES = {
    "BALANCED": Profile(0.6, 0.4, 0.3),
    "EXPLORING": Profile(0.8, 0.2, 0.1),
    "DEBUGGING": Profile(0.3, 0.7, 0.5, -128, -10, 0.20),
    "RECALLING": Profile(0.4, 0.6, 0.3, 10, 127),
    "CRITICAL": Profile(0.2, 0.8, 0.4, expansion=0.20),
    "HYPERFOCUS": Profile(1.0, 0.0, 0.2, expansion=0.0, options={"focus": 1.5}),
    "SYSTEMATIZER": Profile(0.3, 0.7, 0.3, expansion=0.30, options={"strictness": 10.0}),
    "DIVERGENT": Profile(0.8, 0.2, 0.2, expansion=0.80, options={"lateral": True}),
    "PARANOID_SENTINEL": Profile(0.2, 0.8, 0.5, -128, -1, 0.20, options={"query_valence": -128}),
    "THE_EXECUTOR": Profile(0.3, 0.7, 0.4, expansion=0.20, options={"lateral": False, "strictness": 10.0}),
    "HIGHLY_SENSITIVE": Profile(0.7, 0.3, 0.3, options={"min_importance": 0.01}),
    "DEFAULT_MODE_NETWORK": Profile(0.2, 0.8, 0.1, options={"memory_types": ("SEMANTIC", "PROCEDURAL")}),
    "EXECUTIVE_DYSFUNCTION": Profile(0.3, 0.7, 0.1, expansion=0.80, options={"lateral": True, "associative": True}),
    "SOUL_DERIVED": Profile(0.6, 0.4, 0.3),
}


def profile(name: str | None) -> Profile:
    """A profile by name; an unknown one is the balanced one."""
    return PROFILES.get((name or "").upper(), PROFILES["BALANCED"])


#: Words within tags that choose a profile, the first that fits. Fixed values.
PROFILE_WORDS = (
    ("CRITICAL", "critical|urgent|security|production|outage|data-loss"),
    ("DEBUGGING", "error|bug|crash|fail|exception|timeout|broken|fix"),
    ("RECALLING", "solution|success|working|resolved|pattern|template|best-practice"),
)


def detected_profile(tags: Column) -> Column:
    result = F.lit("BALANCED")
    for name, words in reversed(PROFILE_WORDS):
        result = F.when(F.exists(tags, lambda t: F.lower(t).rlike(words)), F.lit(name)).otherwise(result)
    return result


def softmax_weight(score: Column, largest: Column, t: float) -> Column:
    return F.exp((score - largest) / F.lit(t))


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x))


def with_options(base: Profile, **changes) -> Profile:
    return replace(base, **changes)
