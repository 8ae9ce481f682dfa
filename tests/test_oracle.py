"""A spread of registered queries against DuckDB on the smallest tables."""

import check_oracle
import pytest

from downmark.plans import catalog

REG = catalog.load()
SF = "/root/testdata/sf0.001"
NAMES = ["prj04_bucket", "prj12_classify", "agg02_rung_tables", "jn02_ladder_lookup", "agg08_reliability", "agg09_deciles", "val13_ladder_invariants", "src12_content_hash",
         "win02_presnap_score", "top01_total_order", "agg28_two_stage_tuning", "jn12_coach_transition", "win07_cusum", "sim01_team_bootstrap", "rpt13_settled_yards", "rpt16_describe",
         "jn15_as_of_state", "jn16_last_forecast", "win16_repetition", "str01_poll_revisions", "str10_pick_settlement", "str03_delayed_release", "rpt11_end_situation", "jn20_rule_cards", "agg43_mann_whitney",
         "rpt06_named_hurry", "rpt08_players", "rpt10_fix_situation", "rpt18_movement", "rpt22_action", "rpt23_drive_ending", "win08_drive_continuity", "agg37_drive_summary", "agg37_drive_progress",
         "agg60_review_moments", "sim09_truncated_history", "str02_appended_log", "str04_late_reports", "str05_stream_breaks", "str07_shown_situations", "str09_running_insights", "str11_compacted_log", "str12_delay_samples"]


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    out = check_oracle.compare(REG.QUERIES[name](spark, SF), con, REG.ORACLES[name])
    assert out.startswith("ok"), out


def test_every_oracle_has_a_query():
    assert set(REG.ORACLES) <= set(REG.QUERIES)
