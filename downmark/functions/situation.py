"""Column functions over a play table: bands, zones, keys, flags, shrinkage.

Arguments are SQL expressions over the play columns (a column name is the usual
one).  The ``*_sql`` forms give the text for use inside larger expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Situation buckets and shrinkage constants.
DOWNS = (1, 2, 3, 4)
BANDS = ("short", "medium", "long")
ZONES = ("own_deep", "own", "mid", "opp", "red")
ZONE_LOW = {"own_deep": 80, "own": 60, "mid": 40, "opp": 20, "red": 1}
ZONE_HIGH = {"own_deep": 99, "own": 79, "mid": 59, "opp": 39, "red": 19}
BAND_PROBE = {"short": 2, "medium": 6, "long": 10}
ZONE_PROBE = {"own_deep": 90, "own": 70, "mid": 50, "opp": 30, "red": 10}
MIN_SAMPLE = 30
SHRINK_K = 60.0
HIGH_CUT, MEDIUM_CUT = 0.50, 0.35
ATTRIBUTION_GAP = 30  # thousandths
EXPLOSIVE_PASS, EXPLOSIVE_RUSH = 15, 10
KNEEL = r"(?i)\\b(?:kneels|kneel down|takes a knee)\\b"


def success_flag(down="down", distance="distance", gained="yards_gained") -> Column:
    return F.expr(f"""coalesce(case when ({down}) is null then false
        when ({down}) = 1 then ({gained}) >= 0.5D * ({distance})
        when ({down}) = 2 then ({gained}) >= 0.7D * ({distance})
        else ({gained}) >= ({distance}) end, false)""")


def band_sql(distance="distance") -> str:
    d = f"({distance})"
    return f"case when {d} < 0 then null when {d} <= 3 then 'short' when {d} <= 7 then 'medium' when {d} > 7 then 'long' end"


def distance_band(distance="distance") -> Column:
    return F.expr(band_sql(distance))


def zone_sql(ytg="yards_to_goal") -> str:
    arms = " ".join(f"when ({ytg}) between {ZONE_LOW[z]} and {ZONE_HIGH[z]} then '{z}'" for z in ZONES)
    return f"case {arms} end"


def field_zone(ytg="yards_to_goal") -> Column:
    return F.expr(zone_sql(ytg))


def down_sql(down="down") -> str:
    return f"case when ({down}) between 1 and 4 then concat('d', cast(cast(({down}) as int) as string)) end"


def down_key(down="down") -> Column:
    return F.expr(down_sql(down))


def distance_key_sql(down="down", distance="distance") -> str:
    return f"concat({down_sql(down)}, '_', {band_sql(distance)})"


def distance_key(down="down", distance="distance") -> Column:
    return F.expr(distance_key_sql(down, distance))


def bucket_sql(down="down", distance="distance", ytg="yards_to_goal", mark="") -> str:
    return f"concat({down_sql(down)}, '_', {band_sql(distance)}, '_{mark}', {zone_sql(ytg)})"


def bucket(down="down", distance="distance", ytg="yards_to_goal") -> Column:
    """``d3_medium_mid``; null when any part is outside the 60 keys."""
    return F.expr(bucket_sql(down, distance, ytg))


def pooled_key(down="down", distance="distance", ytg="yards_to_goal") -> Column:
    return F.expr(bucket_sql(down, distance, ytg, "~"))


ELIGIBLE = (f"(is_pass or is_rush) and not is_special and not is_penalty_only and down is not null "
            f"and distance is not null and yards_to_goal is not null "
            f"and not coalesce(play_text, '') rlike '{KNEEL}'")


def is_eligible() -> Column:
    """A called pass or run in a situation the buckets cover."""
    return F.expr(ELIGIBLE)


def eligible(df: DataFrame) -> DataFrame:
    return df.filter(ELIGIBLE)


EXPLOSIVE = (f"coalesce((is_pass and yards_gained >= {EXPLOSIVE_PASS}) "
             f"or (is_rush and yards_gained >= {EXPLOSIVE_RUSH}), false)")


def explosive() -> Column:
    return F.expr(EXPLOSIVE)


def recency_sql(reference, half_life, season="season") -> str:
    """Half-life decay; infinity keeps every season at full weight."""
    if isinstance(half_life, str):
        return f"case when {half_life} = double('infinity') then 1.0D else power(0.5D, ({reference} - {season}) / {half_life}) end"
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    if math.isinf(half_life):
        return "1.0D"
    return f"power(0.5D, ({reference} - {season}) / {float(half_life)}D)"


def recency_weight(reference, half_life, season="season") -> Column:
    return F.expr(recency_sql(reference, half_life, season))


def number(value) -> str:
    """A double literal, infinity included; SQL text passes through."""
    if isinstance(value, str):
        return value
    return "double('infinity')" if math.isinf(value) else f"{float(value)!r}D"


def weight_sql(n="n", k=SHRINK_K) -> str:
    size, kk = f"coalesce(double({n}), 0.0D)", number(k)
    return (f"case when {kk} <= 0 then 1.0D when {kk} = double('infinity') or {size} <= 0 then 0.0D "
            f"else {size} / ({size} + {kk}) end")


def shrink_weight(n="n", k=SHRINK_K) -> Column:
    """n / (n + k); 1 when k is 0, 0 when k is infinite or n is 0."""
    return F.expr(weight_sql(n, k))


def shrink_sql(raw, weight, target) -> str:
    r, w, t = f"({raw})", f"({weight})", f"({target})"
    return f"case when {r} is null then {t} when {t} is null or {w} >= 1.0D then {r} else {w} * {r} + (1.0D - {w}) * {t} end"


def shrink(raw, weight, target) -> Column:
    return F.expr(shrink_sql(raw, weight, target))


def confidence_sql(weight="weight", high=HIGH_CUT, medium=MEDIUM_CUT) -> str:
    return f"case when ({weight}) >= {high} then 'high' when ({weight}) >= {medium} then 'medium' else 'low' end"


def confidence(weight="weight", high=HIGH_CUT, medium=MEDIUM_CUT) -> Column:
    return F.expr(confidence_sql(weight, high, medium))


def attribute_sql(rate="rate", league="league_rate", weight="weight") -> str:
    mil = lambda x: f"floor(({x}) * 1000 + 0.5D)"
    return (f"coalesce(({weight}) >= {MEDIUM_CUT} and abs({mil(rate)} - {mil(league)}) >= {ATTRIBUTION_GAP}, false)")


def can_attribute(rate="rate", league="league_rate", weight="weight") -> Column:
    """May the number be named after the team?  Whole thousandths, so exact."""
    return F.expr(attribute_sql(rate, league, weight))


def printed_rate(rate="rate", league="league_rate", weight="weight") -> Column:
    return F.expr(f"case when {attribute_sql(rate, league, weight)} then {rate} else {league} end")


def score_band_sql(diff="score_diff") -> str:
    s = f"({diff})"
    return (f"case when {s} <= -9 then 'behind_9plus' when {s} < 0 then 'behind_1to8' when {s} = 0 then 'tied' "
            f"when {s} <= 8 then 'ahead_1to8' when {s} > 8 then 'ahead_9plus' end")


def score_band(diff="score_diff") -> Column:
    return F.expr(score_band_sql(diff))


def phase_sql(period="period", clock="clock_seconds") -> str:
    q, c = f"({period})", f"({clock})"
    return (f"case when {q} is null or {c} is null then null when {q} > 4 then 'overtime' "
            f"when {q} = 4 and {c} <= 120 then 'last_2min' when {q} = 4 and {c} <= 300 then 'last_5min' "
            f"when {q} = 4 then 'fourth' when {q} = 2 and {c} <= 120 then 'half_2min' else 'ordinary' end")


def phase(period="period", clock="clock_seconds") -> Column:
    return F.expr(phase_sql(period, clock))


CONTEXT = f"concat({bucket_sql()}, '|', {score_band_sql()}, '|', {phase_sql()})"


def context() -> Column:
    """Bucket, score band and game phase; null when any of them is unknown."""
    return F.expr(CONTEXT)


HISTORY_CONTEXT = """case when down between 1 and 4 and distance between 1 and 99 and distance <= yards_to_goal
      and yards_to_goal between 1 and 99 and period between 1 and 4 and clock_seconds between 0 and 900 and score_diff is not null
    then concat_ws('|', concat('d', cast(down as string)),
      case when distance <= 3 then 'short' when distance <= 6 then 'medium' else 'long' end,
      case when distance = yards_to_goal then 'goal' when yards_to_goal <= 20 then 'red' else 'open' end,
      case when score_diff >= 9 then 'ahead' when score_diff <= -9 then 'behind' else 'close' end,
      case when period = 4 and clock_seconds <= 300 then 'late' when period = 2 and clock_seconds <= 120 then 'half' else 'ordinary' end)
    end"""


def history_context() -> Column:
    """The coarser key of season profiles; impossible rows are null."""
    return F.expr(HISTORY_CONTEXT)


def stamp(season="season", week="week") -> Column:
    return F.expr(f"coalesce({season}, 0) * 100 + coalesce({week}, 0)")


def logit_sql(p) -> str:
    x = f"greatest(0.001D, least(0.999D, {p}))"
    return f"ln({x} / (1.0D - {x}))"


def calibrated_sql(p, slope, intercept) -> str:
    return f"1.0D / (1.0D + exp(-(({slope}) * {logit_sql(p)} + ({intercept}))))"


def calibrated(p, slope, intercept) -> Column:
    return F.expr(calibrated_sql(p, slope, intercept))


def sample_bin(n="n") -> Column:
    return F.expr(f"""case when {n} < 30 then null when {n} < 50 then '30-49' when {n} < 75 then '50-74'
        when {n} < 125 then '75-124' when {n} < 250 then '125-249' when {n} < 500 then '250-499' when {n} >= 500 then '500+' end""")


def bucket_table(spark: SparkSession) -> DataFrame:
    """The 60 keys with a representative situation for each."""
    rows = [(f"d{d}_{b}_{z}", f"d{d}_{b}", d, b, z, BAND_PROBE[b], ZONE_PROBE[z])
            for d in DOWNS for b in BANDS for z in ZONES]
    return spark.createDataFrame(
        rows, "key string, dist_key string, down int, band string, zone string, distance int, yards_to_goal int")


def neighbors(zone: str) -> tuple[str, ...]:
    """The zone and the zones beside it."""
    i = ZONES.index(zone)
    return ZONES[max(0, i - 1):i + 2]


def zone_neighbors(spark: SparkSession) -> DataFrame:
    """Each zone with itself and the zones beside it: 13 rows."""
    return spark.createDataFrame([(z, t) for z in ZONES for t in neighbors(z)], "zone string, tzone string")
