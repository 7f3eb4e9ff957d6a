"""History as of a time, against plain Python and against the wide panel."""

import random

import pytest

from cutline.operators import backtest
from cutline.plans.history import HISTORY, as_of


def summary(facts, key, at):
    best = {}
    for k, t, v in facts:
        if k == key and key is not None and t is not None and v is not None and at is not None and t < at:
            best[t] = max(v, best.get(t, v))
    times = sorted(best)
    if not times:
        return (0,) + (None,) * 7
    last, second = times[-1], times[-2] if len(times) > 1 else None
    values = list(best.values())
    return (len(times), sum(values), min(values), max(values), best[last], last, best.get(second), second)


@pytest.mark.parametrize("span", [1, 3, 7, 4096])
def test_running_state_over_spans(spark, table, span):
    rng = random.Random(span)
    facts = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *range(-9, 30)]), rng.choice([None, *range(50)]))
             for _ in range(300)]
    targets = [(i, rng.choice(["a", "b", "hot", "new", None]), rng.choice([None, *range(-12, 40)])) for i in range(120)]
    targets += [targets[0]]
    got = as_of(
        table("id int, k string, at int", targets), table("k string, t int, v int", facts), ["k"], "at", "t", "v", span
    ).collect()
    assert len(got) == len(targets)
    for r in got:
        assert tuple(r[c] for c in HISTORY) == summary(facts, r.k, r.at), r


def test_no_facts_and_no_targets(spark, table):
    facts, targets = table("k string, t int, v int", [("a", 1, 2)]), table("k string, at int", [("a", 5)])
    assert as_of(targets, facts.limit(0), ["k"], "at", "t", "v").first().depth == 0
    assert as_of(targets.limit(0), facts, ["k"], "at", "t", "v").count() == 0


def test_open_cases_see_years_of_no_calendar(spark, table):
    schema = ("college_id string, college_code string, branch_id string, branch_code string, program_type string, category string, "
              "year int, closing_rank int")
    combo = ("1", "c", "b", "B", "ENGINEERING", "GM")
    rows = [(*combo, y, r) for y, r in [(1890, 5), (1990, 10), (1990, 8), (2050, 40), (3000, 100)]]
    got = {r.target_year: r for r in backtest.open_cases(table(schema, rows), "year").collect()}
    assert set(got) == {1890, 1990, 2050, 3000} and got[1890].depth == 0 and got[1890].median is None
    last = got[3000]
    assert (last.actual, last.depth, last.latest, last.second, last.second_year) == (100.0, 3, 40.0, 10.0, 1990)
    assert (last.median, last.lowest, last.highest, last.mad) == (10.0, 5.0, 40.0, 5.0)
    assert last.mean == pytest.approx(55 / 3)
    assert {r.target_year for r in backtest.open_cases(table(schema, rows), "year", [2050]).collect()} == {2050}


def test_lineage_finds_a_planted_future_record(spark, table):
    schema = ("college_id string, college_code string, branch_id string, branch_code string, program_type string, category string, "
              "year int, closing_rank int, record_id string")
    combo = ("1", "c", "b", "B", "ENGINEERING", "GM")
    facts = [("r1", 2019, "R1", "PUBLISHED"), ("r2", 2020, "R1", "PUBLISHED"), ("r3", 2021, "R1", "PUBLISHED"), ("r4", 2030, "R1", "PUBLISHED"),
             ("r5", 2018, "R3", "SUPERSEDED")]
    held = table("record_id string, academic_year int, round_code string, status string", facts)
    clean = [(*combo, 2019, 10, "r1"), (*combo, 2019, 8, "r0"), (*combo, 2020, 20, "r2"), (*combo, 2021, 30, "r3")]

    def counts(rows):
        tested = backtest.open_cases(table(schema, rows), "year", record="record_id")
        return {r.target_year: tuple(r)[1:] for r in backtest.leakage_by_lineage(tested, held).collect()}

    assert counts(clean) == {2020: (1, 0, 0, 0, 0), 2021: (2, 0, 0, 0, 0)}
    # a record of 2030 that claims to be of 2018, one of another round, and one that no fact has
    planted = clean + [(*combo, 2018, 5, "r4"), (*combo, 2017, 5, "r5"), (*combo, 2016, 5, "nowhere")]
    assert counts(planted)[2021] == (5, 1, 1, 1, 1)


def _exchanges_of_rows(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_facts_are_read_once(spark, table, tmp_path, monkeypatch):
    """Cases and histories are written down before they are read again by other columns."""
    from cutline.plans import history

    written, kept = [], history.kept
    keep = lambda df, purpose: written.append((purpose, _exchanges_of_rows(df))) or kept(df, purpose)
    monkeypatch.setattr(history, "kept", keep)
    monkeypatch.setattr(backtest, "kept", keep)
    facts = table("k string, t int, v int", [("a", t, t * t) for t in range(40)])
    got = as_of(table("k string, at int", [("a", 7), ("a", 33)]), facts, ["k"], "at", "t", "v", 10)
    assert sorted((r.at, r.depth, r.latest, r.second) for r in got.collect()) == [(7, 7, 36, 25), (33, 33, 1024, 961)]
    assert [p for p, _ in written] == ["states"] and written[0][1] <= 2
    schema = ("college_id string, college_code string, branch_id string, branch_code string, program_type string, category string, "
              "year int, closing_rank int")
    rows = [("1", "c", "b", "B", "ENGINEERING", "GM", y, y) for y in (2001, 2002, 2003)]
    cases = backtest.open_cases(table(schema, rows), "year")
    assert {r.target_year: r.depth for r in cases.collect()} == {2001: 0, 2002: 1, 2003: 2}
    assert [p for p, _ in written] == ["states", "ranks", "states"]
