"""Steps that grew too fast: state read once a game, words read once a report, reports described once."""

from pyspark.sql import Row

from downmark.functions import labels as L
from downmark.plans import report_queries
from downmark.streaming.revisions import Revisions

SF = "/root/testdata/sf0.001"


class Listed:
    """A list state that counts how often it is asked."""

    def __init__(self):
        self.rows, self.asked = [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.asked += 1
        return iter(self.rows)

    def put(self, rows):
        self.asked += 1
        self.rows = rows


def test_revisions_read_state_once_a_game():
    state, job = Listed(), Revisions()
    job.init(state)
    report = lambda e, p, c: Row(event_id=e, play=p, at=e, content=c)
    told = lambda rows: [(r.play, r.event_id, r.version, r.late) for r in job.handleInputRows((1,), iter(rows), None)]
    first = [report(10 + k, f"p{k}", "x") for k in range(50)] + [report(90, "p0", "x"), report(91, "p1", "y"), report(92, None, "z")]
    got = told(reversed(first))
    assert state.asked == 2 and len(got) == 52 and ("p1", 91, 2, False) in got and (None, 92, 1, False) in got
    assert told([report(89, "p0", "y"), report(95, "p1", "y"), report(96, "p2", "w")]) == [("p0", 89, 2, True), ("p2", 96, 2, False)]
    assert state.asked == 4 and ("p0", "y", 2, 90) in state.rows and ("p1", "y", 2, 95) in state.rows


def test_verbs_are_read_once(spark):
    rows = [("Rush", "(01:02) a pass", "rush", "table"), ("Fumble", "Sacked, then a run", "pass", "text"), ("Odd", "RUN left", "rush", "unknown-type-text"),
            ("Odd", "(x KICK good) run", "rush", "unknown-type-text"), (None, "nothing", "drop", "unknown-type-unresolved"), (None, None, "drop", "unknown-type-unresolved"),
            ("Timeout", "punt", "drop", "admin"), ("Rush", "No Play", "penalty", "explicit-no-play"), ("Rush", "run Original Play: NO PLAY", "rush", "table")]
    df = spark.createDataFrame(rows, "play_type_raw string, play_text string, c string, h string")
    out = L.classified(df).filter("category <> 'none'").selectExpr("c", "h", "category", "how", "category = 'rush' as is_rush", f"{L.text_clock()} as clock")
    assert all(r.c == r.category and r.h == r.how for r in out.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_instr(") == 3 and plan.count("regexp_extract(") == 2


def test_observations_describe_reports_once(spark):
    plan = report_queries.observations(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "l_orderkey" not in plan
