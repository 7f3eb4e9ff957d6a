import random

import pytest

from panel_data import build

from cutline.operators import longitudinal as lon
from cutline.operators import lookups as look
from cutline.plans.calendar import ADMISSIONS
from cutline.plans.panel import canonical_panel, terminal_states


@pytest.fixture
def data(table):
    return build(table)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_panel_uses_canonical_branches(data):
    rows = data["panel"].collect()
    assert {r.branch_code for r in rows} == {"CS", "EC", "AT"}
    assert len(rows) == 19
    kept = canonical_panel(data["cutoffs"], data["colleges"], data["branches"], data["rounds"], branch_id="ec",
                           academic_year=2024, category="GM", round_code="R1", college_id="c2", program_type="ENGINEERING")
    assert [r.closing_rank for r in kept.collect()] == [5000]


def test_terminal_state_falls_back(data):
    found = by(terminal_states(data["wide"]), "college_id", "branch_id", "academic_year")
    assert found[("c1", "cs", 2023)].closing_rank == 1600
    assert found[("c2", "ec", 2023)].round_code == "R3"
    assert found[("c2", "ec", 2026)].closing_rank == 30000
    assert found[("c1", "cs", 2026)].round_code == "R4"
    assert ("c1", "cs", 2025) in found


def test_year_over_year(data):
    items = by(lon.yoy_items(data["wide"], [(2023, 2024), (2024, 2026), (2023, 2026)]), "college_id", "branch_id", "transition")
    cs = items[("c1", "cs", "2023->2024")]
    assert (cs.absolute_movement, cs.relative_movement, cs.direction) == (100, 0.1, "LATER_NUMERICALLY")
    # alias and canonical branch meet in one slot: the greater rank stays
    assert items[("c2", "ec", "2023->2024")].absolute_movement == -500
    agg = by(lon.yoy_aggregate(lon.yoy_items(data["wide"], [(2023, 2024)])), "program_type", "category")
    row = agg[("ENGINEERING", "GM")]
    assert (row.matched_pairs, row.earlier_count, row.later_count, row.unchanged_count) == (2, 1, 1, 0)
    assert row.median_absolute_movement == -200 and row.mean_absolute_movement == -200


def test_counts_add_up_to_pairs(data):
    for row in lon.round_progression(data["wide"]).collect():
        assert row.earlier_count + row.later_count + row.unchanged_count == row.matched_pairs


def test_terminal_scope_is_strict_in_movement(data):
    items = lon.yoy_items(data["wide"], [(2023, 2024)], "TERMINAL").collect()
    assert [(r.college_id, r.from_round, r.to_round, r.comparability) for r in items] == [
        ("c1", "CONSOLIDATED_FINAL", "R3", "PARTIAL")]


def test_incomparable_years_give_nothing(data):
    assert lon.yoy_items(data["wide"], [(2024, 2025)], "R2_PHASE2").count() == 0
    with pytest.raises(ValueError):
        lon.yoy_items(data["wide"], [(2026, 2023)])


def test_volatility(data):
    rows = by(lon.volatility_metrics(data["wide"]), "college_id", "branch_id", "category")
    cs = rows[("c1", "cs", "GM")]
    assert cs.observation_count == 4 and cs.years_observed == [2023, 2024, 2025, 2026]
    assert (cs.mean, cs.median, cs.mad, cs.min_rank, cs.max_rank, cs.rank_range) == (1750, 1750, 100, 1600, 1900, 300)
    assert cs.sequential_absolute_movements == [100, 100, 100] and cs.volatility_data_quality == "OBSERVABLE"
    ec = rows[("c2", "ec", "GM")]
    assert ec.missing_years == [2024, 2025] and ec.volatility_data_quality == "SPARSE"
    assert ec.sequential_relative_movements == [4.0]
    single = by(lon.volatility_metrics(data["wide"], "R1"), "college_id", "branch_id")[("c1", "ec")]
    assert single.mean == 600 and single.standard_deviation is None and single.mad is None
    assert by(lon.volatility_metrics(data["wide"], min_n=3), "college_id").keys() == {("c1",)}


def test_volatility_by_n(data):
    rows = by(lon.volatility_by_n(data["wide"]), "program_type", "category", "observation_count")
    assert rows[("ENGINEERING", "GM", 4)].median_absolute_movement == 100
    assert rows[("ENGINEERING", "GM", 2)].combination_count == 1


def test_progression_and_recency(data):
    rows = by(lon.round_progression(data["wide"]), "academic_year", "from_round", "to_round", "category")
    assert rows[(2026, "R3", "R4", "GM")].earlier_count == 1
    assert (2025, "R3", "R4", "GM") not in rows
    recency = by(lon.recency_evidence(data["wide"], 2026), "program_type", "category")[("ENGINEERING", "GM")]
    assert (recency.evaluated_triples, recency.recent_closer_count, recency.recent_closer_percentage) == (1, 1, 100)
    assert recency.recent_median_absolute_distance == 200 and recency.older_median_absolute_distance == 300
    assert lon.recency_evidence(data["wide"], 2026, "MOCK").count() == 0


def test_coverage(data):
    rows = by(lon.coverage_counts(data["all"]), "grain", "academic_year", "round_code", "category", "program_type")
    everything = rows[("ALL", None, None, None, None)]
    assert (everything.total_records, everything.published_records, everything.superseded_records) == (20, 19, 1)
    # both rows of the alias collision count here
    assert rows[("YEAR_ROUND", 2023, "R1", None, None)].published_records == 3
    depth = by(lon.observation_depth(data["panel"]), "depth", "program_type")
    assert depth[(4, "ENGINEERING")].combinations == 1 and depth[(2, None)].combinations == 1
    patterns = by(lon.year_patterns(data["panel"]), "pattern")
    assert patterns[("2023,2024,2026",)].combinations == 1
    excluded = lon.excluded_records(data["cutoffs"], data["colleges"], data["branches"]).collect()
    assert [r.closing_rank for r in excluded] == [9999]


def test_sparsity(data):
    row = by(lon.sparsity(data["panel"], ADMISSIONS), "college_id", "branch_id", "category")[("c2", "ec", "GM")]
    assert row.missing_years == [2025] and row.consecutive_transition_count == 1 and not row.is_sparse
    assert row.latest_observation_year == 2026


def test_anomalies(data):
    found = lon.anomaly_details(lon.anomalies(data["panel"], data["wide"])).collect()
    kinds = sorted((r.anomaly_type, r.college_code, r.branch_code) for r in found)
    assert kinds == [
        ("BACKWARD_ROUND_MOVEMENT", "E001", "CS"), ("INVALID_RANK_VALUE", "E001", "EC"), ("MISSING_PROVENANCE", "E001", "CS")]
    backward = next(r for r in found if r.anomaly_type == "BACKWARD_ROUND_MOVEMENT")
    assert backward.rank_delta == -100 and "from 2000 in R3 to 1900 in R4" in backward.details


def test_shapes(data):
    matrix = by(lon.progression_matrix(data["wide"]), "college_id", "branch_id", "category", "academic_year")
    assert matrix[("c1", "cs", "GM", 2023)].final == 1600 and matrix[("c1", "cs", "GM", 2023)].round_2 == 1200
    assert matrix[("c1", "cs", "KKR", 2026)].round_2 == 4000
    assert ("c3", "at", "GM", 2023) not in matrix
    ladder = [r for r in lon.round_ladder(data["wide"]).collect() if (r.college_id, r.branch_id, r.academic_year) == ("c1", "cs", 2026)
              and r.category == "GM"]
    assert [(r.round_code, r.delta, r.step) for r in sorted(ladder, key=lambda r: r.position)] == [
        ("R1", None, None), ("R3", 700, "expansion"), ("R4", -100, "contraction")]
    highest = by(lon.highest_round(data["wide"]), "college_id", "branch_id", "category", "academic_year")
    assert highest[("c1", "cs", "GM", 2023)].round_code == "CONSOLIDATED_FINAL"


def test_boundary(data, table):
    asked = table("college_id string, candidate_rank int", [("c1", 600), ("c2", 5001)])
    found = by(lon.college_boundary(data["panel"], asked), "college_id")
    assert found[("c1",)].within_boundary and not found[("c2",)].within_boundary


def test_report_has_every_section(data):
    rows = lon.report(data["all"], data["wide"], [(2023, 2024), (2024, 2026)], 2026).collect()
    assert {r.section for r in rows} == {
        "coverage", "depth", "pattern", "volatility_by_n", "progression", "yoy", "recency", "anomalies"}


def test_lookups(data):
    d = data
    found = look.find_cutoffs(d["cutoffs"], d["colleges"], d["branches"], d["rounds"])
    assert found.filter("round_code = 'KKR_SPECIAL'").count() == 0 and found.filter("college_id = 'c3'").count() == 0
    special = look.find_cutoffs(d["cutoffs"], d["colleges"], d["branches"], d["rounds"], round_code="kkr_special")
    assert special.count() == 1
    everyone = look.find_cutoffs(d["cutoffs"], d["colleges"], d["branches"], d["rounds"], institution_type="ALL",
                                 program_type="ALL", include_special=True)
    assert look.total(everyone).first().total == 19
    page = look.page(found, [found.closing_rank, found.record_id], 2, 1).collect()
    assert [r.closing_rank for r in page] == [1000, 1100]


def test_search_takes_text_literally(data):
    assert look.search_colleges(data["colleges"], "second").count() == 1
    assert look.search_colleges(data["colleges"], "%").count() == 0
    assert look.search_colleges(data["colleges"], location="hubballi", institution_type="ALL").count() == 1
    assert look.search_branches(data["branches"], "electronics", canonical=None).count() == 2


def test_resolve(data, table):
    entities = data["colleges"].selectExpr("college_id AS entity_id", "college_code AS code", "original_name AS short_name")
    terms = table("term string", [("C1",), ("e002",), ("IRS",), ("zzz",)])
    assert {r.term: r.entity_id for r in look.resolve_entities(terms, entities).collect()} == {
        "C1": "c1", "e002": "c2", "IRS": "c1", "zzz": None}


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    first = [r.id for r in look.sample_rows(df, "id", 5, 3).collect()]
    assert first == [r.id for r in look.sample_rows(df.repartition(7), "id", 5, 3).collect()]
    assert first != [r.id for r in look.sample_rows(df, "id", 5, 4).collect()]


def test_names_are_found_through_their_rarest_letters(spark, table):
    rng = random.Random(3)
    names = [(f"e{i}", f"K{rng.randint(0, 40):03}", "".join(rng.choices("abcé ", k=rng.randint(0, 12)))) for i in range(80)] + [("none", "A", None)]
    terms = {n[i : i + rng.randint(1, 6)] for _, _, n in names if n for i in range(len(n))} | {"zzz", "abz", "", "AB", "e5", "k007"}
    terms = sorted(terms)
    found = look.resolve_entities(
        table("term string", [(t,) for t in terms] + [(None,)]), table("entity_id string, code string, short_name string", names)
    ).collect()
    got = {r.term: r.entity_id for r in found}

    def want(term):
        low = term.lower()
        same = [i for i, _, _ in names if i.lower() == low] or sorted(i for i, c, _ in names if c.lower() == low)[:1]
        parts = sorted((c, i) for i, c, n in names if low and n and low in n.lower())
        return same[0] if same else parts[0][1] if parts else None

    assert got == {t: want(t) for t in terms} | {None: None} and len(found) == len(terms) + 1
    index = look.names_containing(table("_t string", [("abc",)]), table("_name string, code string, entity_id string", [("x" * 500 + "abc", "c", "1")]))
    assert index.first()._by_name == "1"
