"""Queries for cells, rungs, the ladder and the export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import situation as S
from ..functions.numbers import r
from ..operators import cells as C
from ..operators import scoring as P
from .oracle import on_eligible, values
from .registry import query
from .situation_queries import ZONE_ROWS, r6
from .views import plays

KEY_ROWS = [(f"d{d}_{b}_{z}", f"d{d}_{b}", f"d{d}_{b}_~{z}", d, b, z) for d in S.DOWNS for b in S.BANDS for z in S.ZONES]
R4 = lambda e: r6(e, 4)


def rates(n="w_n", cols=(("p", "pass_rate"), ("s", "success_rate"), ("e", "explosive_rate"))):
    return ", ".join(f"{R4(f'SUM({c} * w) / SUM(n * w)')} AS {alias}" for c, alias in cols)


def ladder_ctes(src: str = "el", tag: str = "", k: str = "60.0", hl: str = "1.0", group: str = "league") -> str:
    """The ladder as SQL: fine counts, four rungs, league fallback, shrinkage."""
    w = "1.0" if k == "inf_hl" else f"pow(0.5, (2050 - season) / {hl})" if hl != "inf" else "1.0"
    weight = f"CASE WHEN rung = 5 THEN 0.0 ELSE {R4(f'sample_size / (sample_size + {k})') if k != '0' else '1.0'} END"
    def shrunk(r):
        return (f"{R4(f'CASE WHEN raw_{r} IS NULL THEN tgt_{r} WHEN tgt_{r} IS NULL OR w >= 1.0 THEN raw_{r} ELSE w * raw_{r} + (1.0 - w) * tgt_{r} END')}")
    pick = lambda c: f"CASE rung WHEN 1 THEN a.{c} WHEN 2 THEN b.{c} WHEN 3 THEN c.{c} END"
    return f"""
fine{tag} AS (SELECT {group}, offense AS team, down, band, zone, season, COUNT(*) AS n,
  SUM(CASE WHEN is_pass THEN 1 ELSE 0 END)::DOUBLE AS p, SUM(CASE WHEN success THEN 1 ELSE 0 END)::DOUBLE AS s,
  SUM(CASE WHEN explosive THEN 1 ELSE 0 END)::DOUBLE AS e, {w}::DOUBLE AS w FROM {src} GROUP BY {group}, offense, down, band, zone, season),
{values(ZONE_ROWS, "zone, tzone", f"zmap{tag}")},
{values(KEY_ROWS, "key, dkey, pkey, down, band, zone", f"keys{tag}")},
r1{tag} AS (SELECT {group}, team, down, band, zone, SUM(n)::BIGINT AS sample_size, {rates()} FROM fine{tag} GROUP BY {group}, team, down, band, zone),
r2{tag} AS (SELECT {group}, team, down, band, tzone AS zone, SUM(n)::BIGINT AS sample_size, {rates()} FROM fine{tag} JOIN zmap{tag} USING (zone) GROUP BY {group}, team, down, band, tzone),
r3{tag} AS (SELECT {group}, team, down, band, SUM(n)::BIGINT AS sample_size, {rates()} FROM fine{tag} GROUP BY {group}, team, down, band),
r5{tag} AS (SELECT {group}, down, band, zone, SUM(n)::BIGINT AS sample_size, {rates()} FROM fine{tag} GROUP BY {group}, down, band, zone),
ov{tag} AS (SELECT {group}, SUM(n)::BIGINT AS sample_size, SUM(p) / SUM(n) AS global_rate, {rates()} FROM fine{tag} GROUP BY {group}),
teams{tag} AS (SELECT DISTINCT {group}, team FROM fine{tag}),
walk{tag} AS (SELECT t.{group}, t.team, k.key, k.down, k.band, k.zone,
    CASE WHEN a.sample_size >= 30 THEN 1 WHEN b.sample_size >= 30 THEN 2 WHEN c.sample_size >= 30 THEN 3 ELSE 5 END AS rung,
    COALESCE(a.sample_size, 0) AS n1, COALESCE(b.sample_size, 0) AS n2, COALESCE(c.sample_size, 0) AS n3, l.sample_size AS league_n, l.pass_rate AS situation_rate, o.global_rate,
    k.pkey, k.dkey,
    COALESCE(CASE rung WHEN 1 THEN a.sample_size WHEN 2 THEN b.sample_size WHEN 3 THEN c.sample_size ELSE l.sample_size END, 0) AS sample_size,
    {pick('pass_rate')} AS raw_pass, {pick('success_rate')} AS raw_success, {pick('explosive_rate')} AS raw_explosive,
    COALESCE(l.pass_rate, o.pass_rate) AS tgt_pass, COALESCE(l.success_rate, o.success_rate) AS tgt_success, COALESCE(l.explosive_rate, o.explosive_rate) AS tgt_explosive
  FROM teams{tag} t CROSS JOIN keys{tag} k
  LEFT JOIN r1{tag} a ON a.{group} = t.{group} AND a.team = t.team AND a.down = k.down AND a.band = k.band AND a.zone = k.zone
  LEFT JOIN r2{tag} b ON b.{group} = t.{group} AND b.team = t.team AND b.down = k.down AND b.band = k.band AND b.zone = k.zone
  LEFT JOIN r3{tag} c ON c.{group} = t.{group} AND c.team = t.team AND c.down = k.down AND c.band = k.band
  LEFT JOIN r5{tag} l ON l.{group} = t.{group} AND l.down = k.down AND l.band = k.band AND l.zone = k.zone
  LEFT JOIN ov{tag} o ON o.{group} = t.{group}),
lad{tag} AS (SELECT *, CASE rung WHEN 2 THEN pkey WHEN 3 THEN dkey ELSE key END AS matched_key,
    CASE WHEN w >= 0.5 THEN 'high' WHEN w >= 0.35 THEN 'medium' ELSE 'low' END AS confidence,
    {shrunk('pass')} AS pass_rate, {shrunk('success')} AS success_rate, {shrunk('explosive')} AS explosive_rate
  FROM (SELECT *, {weight} AS w FROM walk{tag}) q)"""


FINE_SQL = """SELECT league, offense AS team, down, band, zone, season, COUNT(*) AS n, CAST(SUM(CASE WHEN is_pass THEN 1 ELSE 0 END) AS BIGINT) AS n_pass,
CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS n_success, CAST(SUM(CASE WHEN explosive THEN 1 ELSE 0 END) AS BIGINT) AS n_explosive FROM el GROUP BY ALL"""


@query("agg01_fine_cells", on_eligible(FINE_SQL))
def fine(spark, sf):
    return C.fine_cells(plays(spark, sf))


@query("agg02_rung_tables", on_eligible(ladder_ctes(), """
SELECT league, 1 AS rung, team, 'd' || down || '_' || band || '_' || zone AS key, sample_size, pass_rate, success_rate, explosive_rate FROM r1
UNION ALL SELECT league, 2, team, 'd' || down || '_' || band || '_~' || zone, sample_size, pass_rate, success_rate, explosive_rate FROM r2
UNION ALL SELECT league, 3, team, 'd' || down || '_' || band, sample_size, pass_rate, success_rate, explosive_rate FROM r3
UNION ALL SELECT league, 5, NULL, 'd' || down || '_' || band || '_' || zone, sample_size, pass_rate, success_rate, explosive_rate FROM r5"""))
def rungs(spark, sf):
    return C.rung_tables(C.decayed(C.fine_cells(plays(spark, sf))))


@query("agg03_league_overall", on_eligible(ladder_ctes(), f"""
SELECT league, sample_size AS overall_n, {r6('global_rate')} AS global_rate, pass_rate, success_rate, explosive_rate FROM ov"""))
def overall(spark, sf):
    return C.league_summary(C.decayed(C.fine_cells(plays(spark, sf)))).selectExpr(
        "league", "overall_n", f"{r('global_rate')} as global_rate", "o_pass as pass_rate", "o_success as success_rate",
        "o_explosive as explosive_rate")


LADDER_OUT = """SELECT league, team, key, rung, matched_key, sample_size, w AS shrink_weight, confidence, raw_pass AS pass_rate_raw,
  tgt_pass AS league_pass_rate, pass_rate, success_rate, explosive_rate FROM {lad}"""
LADDER_COLS = ["league", "team", "key", "rung", "matched_key", "sample_size", "shrink_weight", "confidence", "pass_rate_raw",
               "league_pass_rate", "pass_rate", "success_rate", "explosive_rate"]


@query("jn02_ladder_lookup", on_eligible(ladder_ctes(), LADDER_OUT.format(lad="lad")))
def lookup(spark, sf):
    return C.ladder(plays(spark, sf)).select(*LADDER_COLS)


@query("agg04_build_recent", on_eligible(
    "recent AS (SELECT * FROM el WHERE season >= 1999)", ladder_ctes("recent", k="100.0", hl="2.0"), LADDER_OUT.format(lad="lad")))
def build(spark, sf):
    df = plays(spark, sf).filter(F.col("season") >= 1999)
    return C.ladder(df, half_life=2.0, k=100.0).select(*LADDER_COLS)


@query("jn01_zone_widening", on_eligible(
    values(ZONE_ROWS, "zone, tzone", "zmap"), "f AS (" + FINE_SQL + ")",
    "SELECT league, team, down, band, tzone AS zone, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(n_pass) AS BIGINT) AS n_pass FROM f JOIN zmap USING (zone) GROUP BY ALL"))
def widening(spark, sf):
    fine_rows = C.fine_cells(plays(spark, sf))
    return (fine_rows.join(F.broadcast(S.zone_neighbors(spark)), "zone")
            .groupBy("league", "team", "down", "band", F.col("tzone").alias("zone"))
            .agg(F.sum("n").alias("n"), F.sum("n_pass").alias("n_pass")))


@query("jn03_league_baseline", on_eligible("early AS (SELECT * FROM el WHERE NOT (season <= 1998 AND down = 4 AND zone = 'red') AND season <= 1998)",
                                           ladder_ctes("early"), """
SELECT o.league, k.key, COALESCE(l.sample_size, 0) AS sample_size, COALESCE(l.pass_rate, o.pass_rate) AS pass_rate, l.pass_rate IS NULL AS fell_back
FROM ov o CROSS JOIN keys k LEFT JOIN r5 l ON l.league = o.league AND l.down = k.down AND l.band = k.band AND l.zone = k.zone"""))
def baseline(spark, sf):
    df = plays(spark, sf).filter((F.col("season") <= 1998) & ~((F.col("down") == 4) & (F.col("yards_to_goal") < 20)))
    cells = C.decayed(C.fine_cells(df))
    keys = ", ".join(repr(k[0]) for k in KEY_ROWS)
    return (C.league_summary(cells).selectExpr("league", "buckets", "o_pass", f"explode(array({keys})) as key")
            .selectExpr("league", "key", "coalesce(buckets[key].n, 0) as sample_size",
                        "coalesce(buckets[key].pass, o_pass) as pass_rate", "buckets[key] is null as fell_back"))


EXPORT_CTES = f"""ex AS (SELECT league, team, key, {r6('pass_rate', 3)} AS pass_rate, {r6('raw_pass', 3)} AS pass_rate_raw, sample_size, w AS shrink_weight, rung,
  {r6('tgt_pass', 3)} AS league_rate, confidence, league_n FROM lad WHERE rung < 5),
shipped AS (SELECT *, confidence <> 'low' AND abs(floor(pass_rate*1000.0+0.5) - floor(league_rate*1000.0+0.5)) >= 30 AS can_attribute FROM ex)"""


@query("src08_export_cells", on_eligible(ladder_ctes(), EXPORT_CTES, """
SELECT league, team, key, pass_rate, pass_rate_raw, sample_size, shrink_weight, rung, can_attribute FROM shipped"""))
def export(spark, sf):
    return C.export_rows(C.ladder(plays(spark, sf))).drop("league_rate", "confidence", "league_n")


@query("agg66_export_report", on_eligible(ladder_ctes(), EXPORT_CTES, """base AS (SELECT league, COUNT(*) AS baseline_buckets, 60 - COUNT(*) AS empty_buckets, SUM(CASE WHEN sample_size < 30 THEN 1 ELSE 0 END) AS thin FROM r5 GROUP BY league)""", """
SELECT s.league, COUNT(DISTINCT team) AS teams, COUNT(*) AS cells, SUM(CASE WHEN can_attribute THEN 1 ELSE 0 END)::BIGINT AS attributable,
  any_value(baseline_buckets) AS baseline_buckets, any_value(empty_buckets) AS empty_buckets, any_value(thin)::BIGINT AS thin_buckets FROM shipped s JOIN base USING (league) GROUP BY s.league"""))
def report(spark, sf):
    answers = C.ladder(plays(spark, sf))
    shipped = C.export_rows(answers).groupBy("league").agg(
        F.count_distinct("team").alias("teams"), F.count("*").alias("cells"), F.count_if("can_attribute").alias("attributable"))
    base = answers.groupBy("league", "key").agg(F.max("league_n").alias("n")).groupBy("league").agg(
        F.count("n").alias("baseline_buckets"), (F.lit(60) - F.count("n")).alias("empty_buckets"),
        F.count_if(F.col("n") < S.MIN_SAMPLE).alias("thin_buckets"))
    return shipped.join(base, "league")
