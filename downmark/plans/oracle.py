"""Shared DuckDB text for the SQL twins: the play view and its usual subsets."""

from __future__ import annotations

_VIEW = """
raw AS (
  SELECT CASE WHEN l.l_orderkey % 2 = 0 THEN 'cfb' ELSE 'nfl' END AS league,
    CAST(year(l.l_shipdate) AS INT) AS season,
    CAST(1 + FLOOR((dayofyear(l.l_shipdate) - 1) / 25.0) AS INT) AS week,
    concat(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING)) AS play_id,
    sn.n_name AS offense, cn.n_name AS defense,
    CAST(1 + l.l_partkey % 4 AS INT) AS period,
    CAST((l.l_orderkey * 7 + l.l_partkey * 13) % 901 AS INT) AS clock_seconds,
    CAST(1 + (l.l_linenumber - 1) % 4 AS INT) AS down,
    CAST(1 + CAST(l.l_quantity AS INT) % 12 AS INT) AS distance,
    CAST(1 + l.l_partkey % 99 AS INT) AS yards_to_goal,
    CAST(l.l_orderkey % 23 AS INT) - 5 AS yards_gained,
    CAST(l.l_partkey % 41 AS INT) AS off_score_post, CAST(l.l_orderkey % 37 AS INT) AS def_score_post,
    CASE WHEN l.l_returnflag = 'N' AND o.o_orderpriority = '1-URGENT' THEN 'special'
         WHEN l.l_returnflag = 'N' AND o.o_orderpriority = '5-LOW' THEN 'penalty'
         WHEN l.l_returnflag = 'A' THEN 'pass' WHEN l.l_returnflag = 'R' THEN 'rush'
         WHEN l.l_linestatus = 'O' THEN 'pass' ELSE 'rush' END AS category,
    l.l_orderkey AS ok, l.l_partkey AS pk, l.l_suppkey AS sk, l.l_shipdate AS shipped,
    CAST(l.l_quantity AS INT) AS qty, o.o_orderstatus
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
    JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey),
copies AS (SELECT *, row_number() OVER (PARTITION BY play_id ORDER BY shipped, pk, sk, qty) AS copy_no,
  concat(offense, '-', CAST(season AS STRING), '-', CAST(week AS STRING)) AS game_id,
  CASE WHEN pk % 50 = 0 THEN 'Fumble Recovery (Own)' WHEN pk % 53 = 0 THEN 'Mystery' WHEN pk % 59 = 0 THEN 'Timeout'
       WHEN category = 'penalty' THEN 'Penalty' WHEN category = 'special' THEN 'Punt' WHEN category = 'rush' THEN 'Rush'
       WHEN ok % 23 > 5 THEN 'Pass Reception' ELSE 'Pass Incompletion' END AS play_type_raw,
  category = 'pass' AS is_pass, category = 'rush' AS is_rush, category = 'special' AS is_special, category = 'penalty' AS is_penalty_only,
  off_score_post - def_score_post AS score_diff,
  concat('(', lpad(CAST(CAST(FLOOR(clock_seconds / 60.0) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(clock_seconds % 60 AS STRING), 2, '0'), ') ',
    CASE WHEN category = 'penalty' THEN 'PENALTY AAA holding 10 yards from AAA20. NO PLAY.'
         WHEN category = 'special' THEN '#9 K.Foot punt 40 yards'
         WHEN category = 'rush' AND qty = 50 THEN '#1 Q.Back takes a knee'
         WHEN category = 'rush' THEN concat('#', CAST(20 + sk % 5 AS STRING), ' R.Back', CAST(sk % 5 AS STRING), ' rush middle for ', CAST(yards_gained AS STRING), ' yards')
         WHEN yards_gained > 0 THEN concat('Shotgun #1 Q.Back pass complete short left to #', CAST(80 + sk % 7 AS STRING), ' W.Out', CAST(sk % 7 AS STRING), ' for ', CAST(yards_gained AS STRING), ' yards')
         ELSE concat('#1 Q.Back pass incomplete deep right to #', CAST(80 + sk % 7 AS STRING), ' W.Out', CAST(sk % 7 AS STRING)) END) AS play_text,
  CASE WHEN down = 1 THEN yards_gained * 10 >= distance * 5 WHEN down = 2 THEN yards_gained * 10 >= distance * 7 ELSE yards_gained >= distance END AS success
  FROM raw),
plays AS (SELECT * FROM copies WHERE copy_no = 1)"""

_ELIGIBLE = """,
el AS (SELECT *, CASE WHEN distance <= 3 THEN 'short' WHEN distance <= 7 THEN 'medium' ELSE 'long' END AS band,
    CASE WHEN yards_to_goal >= 80 THEN 'own_deep' WHEN yards_to_goal >= 60 THEN 'own' WHEN yards_to_goal >= 40 THEN 'mid' WHEN yards_to_goal >= 20 THEN 'opp' ELSE 'red' END AS zone,
    CASE WHEN score_diff <= -9 THEN 'behind_9plus' WHEN score_diff < 0 THEN 'behind_1to8' WHEN score_diff = 0 THEN 'tied' WHEN score_diff <= 8 THEN 'ahead_1to8' ELSE 'ahead_9plus' END AS score_band,
    CASE WHEN period = 4 AND clock_seconds <= 120 THEN 'last_2min' WHEN period = 4 AND clock_seconds <= 300 THEN 'last_5min' WHEN period = 4 THEN 'fourth'
         WHEN period = 2 AND clock_seconds <= 120 THEN 'half_2min' ELSE 'ordinary' END AS phase,
    (is_pass AND yards_gained >= 15) OR (is_rush AND yards_gained >= 10) AS explosive
  FROM plays WHERE (is_pass OR is_rush) AND NOT contains(play_text, 'takes a knee'))"""


def _join(base: str, parts) -> str:
    *ctes, final = parts
    return "WITH " + base + "".join(",\n" + c for c in ctes) + "\n" + final


def on_plays(*parts: str) -> str:
    """``ctes..., final`` on top of the ``plays`` and ``copies`` views."""
    return _join(_VIEW, parts)


def on_eligible(*parts: str) -> str:
    """The same, with ``el`` (eligible plays and their situation parts) added."""
    return _join(_VIEW + _ELIGIBLE, parts)


def values(rows, columns: str, name: str) -> str:
    """An inline CTE for a small fixed table."""
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"
