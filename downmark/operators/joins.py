"""Lookups that resolve names, rules and links by equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import labels as L


def resolve_team(asked: DataFrame, teams: DataFrame, candidates=("location", "short_name", "display_name", "name")) -> DataFrame:
    """The first candidate name that matches a known team, in the given order."""
    known = teams.selectExpr(f"{L.norm_name('team')} as _norm", "team").groupBy("_norm").agg(F.min("team").alias("team"))
    out = asked
    for i, c in enumerate(candidates):
        side = known.select(F.col("_norm").alias(f"_n{i}"), F.col("team").alias(f"_t{i}"))
        out = out.withColumn(f"_n{i}", F.expr(f"nullif({L.norm_name(c)}, '')")).join(side, f"_n{i}", "left")
    hits = [f"_t{i}" for i in range(len(candidates))]
    return out.withColumn("team", F.coalesce(*hits)).drop(*hits, *[f"_n{i}" for i in range(len(candidates))])


def resolve_roster(mentions: DataFrame, athletes: DataFrame, by=("team_id",)) -> DataFrame:
    """A mention resolves when exactly one athlete of the roster has the name,
    the jersey agreeing or unknown.  Names are reduced to letters and digits."""
    plain = lambda e: f"regexp_replace(lower(translate({e}, '{L.ACCENTED}', '{L.PLAIN}')), '[^a-z0-9]', '')"
    people = (athletes.selectExpr(*by, "athlete_id", "jersey", "coalesce(full_name, display_name) as person",
                                  "explode(array_compact(array(full_name, display_name, short_name))) as alias")
              .selectExpr(*by, f"{plain('alias')} as _key", "athlete_id", "jersey as _jersey", "person").distinct())
    number = "string(try_cast(nullif(regexp_extract(reported, '^#([0-9]{1,2})\\\\s+', 1), '') as int))"
    asked = mentions.selectExpr("*", f"{number} as _number", "regexp_replace(trim(reported), '^#[0-9]{1,2}\\\\s+', '') as _name").selectExpr(
        "*", f"{plain('_name')} as _key")
    hit = asked.join(people, [*by, "_key"]).filter("_number is null or _jersey is null or _jersey = _number")
    one = hit.groupBy("mention_id").agg(F.count_distinct("athlete_id").alias("candidates"), F.min("athlete_id").alias("athlete_id"),
                                        F.min("person").alias("person"), F.min("_jersey").alias("roster_jersey"))
    out = asked.join(one, "mention_id", "left")
    return out.selectExpr("mention_id", "reported", "coalesce(candidates, 0) as candidates",
                          "if(candidates = 1, athlete_id, null) as athlete_id",
                          "if(candidates = 1, concat(coalesce(concat('#', coalesce(_number, roster_jersey), ' '), ''), person), reported) as label")


RULE_BOUNDS = ("down", "distance", "yards_to_goal", "period", "clock_seconds", "score_diff")
MAX_RULES = 500


def best_rule(situations: DataFrame, rules: DataFrame, key="play_id") -> DataFrame:
    """The matching rule of highest priority and how many match.

    ``rules`` is a hand-made table with optional ``min_x``/``max_x`` bounds, of at most
    ``MAX_RULES`` rows.  It becomes one expression per play, the highest priority
    first, so plays are neither joined nor shuffled."""
    cards = rules.limit(MAX_RULES + 1).collect()
    if len(cards) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; a hand-made table is expected")
    tests = []
    for card in sorted(cards, key=lambda c: (c["priority"], c["rule_id"]), reverse=True):
        hit = F.lit(True)
        for c in RULE_BOUNDS:
            low, high = card[f"min_{c}"], card[f"max_{c}"]
            hit = hit if low is None else hit & (F.col(c) >= low)
            hit = hit if high is None else hit & (F.col(c) <= high)
        tests.append(F.when(hit, F.lit(card["rule_id"])))
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return situations.withColumn("_hits", found).select(key, F.try_element_at("_hits", F.lit(1)).alias("rule_id"), F.size("_hits").cast("long").alias("matching"))
