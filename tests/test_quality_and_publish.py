import random

import pytest

from cutline import schemas
from cutline.functions.sql import columns
from cutline.operators import publish as pub
from cutline.operators import quality as dq
from cutline.plans.calendar import ADMISSIONS
from cutline.sources import registry, sinks

BASE = dict(college_code="E001", branch_code="CS", category_code="GM", round_code="R1", opening_rank=500, closing_rank=1420)


@pytest.fixture
def known(table):
    return (
        table("college_code string", [("E001",), ("E002",)]),
        table("branch_code string", [("CS",), ("AE",)]),
    )


@pytest.fixture
def cutoff(table, known):
    def check(*changes):
        rows = []
        for i, c in enumerate(changes):
            r = {**BASE, **c}
            rows.append((i, r["college_code"], r["branch_code"], r["category_code"], r["round_code"], r["opening_rank"],
                         r["closing_rank"], 2026, None))
        tagged = dq.validate_cutoffs(table(schemas.RAW_CUTOFFS, rows), *known, ["GM", "KKR"])
        return tagged, sorted(tagged.collect(), key=lambda r: r.row_idx)

    return check


@pytest.mark.parametrize(
    "change, errors, anomalies",
    [
        ({}, [], []),
        ({"college_code": "E999"}, ["UNKNOWN_COLLEGE_CODE"], []),
        ({"branch_code": None}, ["UNKNOWN_BRANCH_CODE"], []),
        ({"round_code": "R2"}, ["INVALID_COUNSELLING_ROUND"], []),
        ({"category_code": "XX", "closing_rank": 0}, ["INVALID_CLOSING_RANK"], ["UNEXPECTED_CATEGORY"]),
        ({"opening_rank": 0}, ["INVALID_OPENING_RANK"], []),
        ({"opening_rank": 5000}, ["OPENING_GREATER_THAN_CLOSING"], []),
        ({"opening_rank": None, "closing_rank": 250001}, [], ["ANOMALOUS_HIGH_RANK"]),
    ],
)
def test_cutoff_rules(cutoff, change, errors, anomalies):
    row = cutoff(change)[1][0]
    assert (row.error_codes, row.anomalies, row.is_valid) == (errors, anomalies, not errors)


def test_duplicates_count_among_rows_that_pass(cutoff):
    tagged, rows = cutoff({"closing_rank": 0}, {}, {}, {"category_code": None, "closing_rank": 300000},
                          {"category_code": None, "closing_rank": 300000})
    assert [r.error_codes for r in rows] == [
        ["INVALID_CLOSING_RANK"], [], ["DUPLICATE_LOGICAL_RECORD"], [], ["DUPLICATE_LOGICAL_RECORD"]]
    assert rows[4].anomalies == ["UNEXPECTED_CATEGORY", "ANOMALOUS_HIGH_RANK"]
    assert {r.status for r in dq.valid_rows(tagged).collect()} == {"PUBLISHED"}
    errors = dq.error_rows(tagged, "CUTOFF").collect()
    assert sorted(r.severity for r in errors) == ["ERROR"] * 3 + ["WARNING"] * 4
    assert {r.entity_identifier for r in errors} == {"cutoff_rec_0", "cutoff_rec_2", "cutoff_rec_3", "cutoff_rec_4"}


SEATS = [
    (("E001", "AE", "R1", "GM", 2026, None, 5, 5, None), []),
    (("", "AE", "R1", "GM", 2026, None, 5), ["MISSING_COLLEGE_CODE"]),
    (("E001", "", "R1", "GM", 2026, None, 5), ["MISSING_BRANCH_CODE"]),
    (("E001", "AE", "R1", "GM", 2026), ["MISSING_SEAT_VALUES"]),
    (("E999", "AE", "R1", "GM", 2026, None, 5), ["UNKNOWN_COLLEGE_CODE"]),
    (("E001", "ZZ", "R1", "GM", 2026, None, 5), ["UNKNOWN_BRANCH_CODE"]),
    (("E001", "AE", "R1", "GM", 2026, -1, -1), ["INVALID_TOTAL_SEATS", "INVALID_VACANT_SEATS"]),
    (("E001", "AE", "R1", "GM", 2026, 10, 15), ["VACANCY_EXCEEDS_TOTAL_SEATS"]),
    (("E001", "AE", "R1", "GM", 2026, 6, None, 4, 3), ["SEAT_SUM_EXCEEDS_TOTAL"]),
    (("E001", "AE", "R1", "GM", 2026, None, 5, 4, 3), ["SEAT_SUM_EXCEEDS_VACANCY"]),
    (("E001", "AE", "R1", "GM", 2026, None, 3), ["DUPLICATE_LOGICAL_RECORD"]),
    (("E001", "AE", None, None, 2026, None, 3), []),
    (("E001", "AE", None, None, 2026, None, 4), ["DUPLICATE_LOGICAL_RECORD"]),
]


def test_seat_rules(table, known):
    rows = table(schemas.RAW_SEATS, [(i, *r, *(None,) * (9 - len(r)), None) for i, (r, _) in enumerate(SEATS)])
    found = {r.row_idx: r.error_codes for r in dq.validate_seats(rows, *known).collect()}
    assert found == {i: e for i, (_, e) in enumerate(SEATS)}


FEES = [
    (("E001", "CS", 2026, "322000", "302000", "20000"), []),
    (("E001", None, 2026, "250000"), []),
    (("E001", None, 2025, "-100"), ["INVALID_TOTAL_FEE"]),
    (("E001", "CS", 2025, "100000", "150000"), ["TUITION_EXCEEDS_TOTAL_FEE"]),
    (("E001", "CS", 2025, "100000", None, "150000"), ["OTHER_FEE_EXCEEDS_TOTAL_FEE"]),
    (("E001", "CS", 2025, "300000", "200000", "50000"), ["FEE_COMPONENTS_MISMATCH"]),
    (("E001", "CS", 2025, "300000", "200000", "99900"), []),
    (("E001", "CS", 2026, "1"), ["DUPLICATE_LOGICAL_RECORD"]),
    (("", "CS", 2024, "1"), ["MISSING_COLLEGE_CODE"]),
    (("E001", "CS", 2024, None), ["MISSING_TOTAL_FEE"]),
    (("E009", "CS", 2024, "1"), ["UNKNOWN_COLLEGE_CODE"]),
    (("E001", "ZZ", 2024, "1"), ["UNKNOWN_BRANCH_CODE"]),
    (("E001", "CS", 2024, "x", "-2", "y"), ["NON_NUMERIC_TOTAL_FEE", "INVALID_TUITION_FEE", "NON_NUMERIC_OTHER_FEE"]),
]


def test_fee_rules(table, known):
    rows = table(schemas.RAW_FEES, [(i, *r, *(None,) * (6 - len(r)), None) for i, (r, _) in enumerate(FEES)])
    found = {r.row_idx: r.error_codes for r in dq.validate_fees(rows, *known).collect()}
    assert found == {i: e for i, (_, e) in enumerate(FEES)}


GATE = [
    ("CUTOFF_PDF", "ENGINEERING", 30, None, None, "SUSPICIOUS_LOW_COUNT"),
    ("CUTOFF_PDF", "ARCHITECTURE", 4, None, None, None),
    ("CUTOFF_PDF", "ARCHITECTURE", 3, None, None, "SUSPICIOUS_LOW_COUNT"),
    ("CUTOFF_PDF", "ARCHITECTURE", 0, None, 0, "SUSPICIOUS_LOW_COUNT"),
    ("CUTOFF_PDF", "ARCHITECTURE", 1, None, 1, None),
    ("UNKNOWN", None, 100, None, None, "UNKNOWN_DOCUMENT_TYPE"),
    (None, None, 100, None, None, "UNKNOWN_DOCUMENT_TYPE"),
    ("CUTOFF_PDF", "ENGINEERING", 60, 1000, None, "SUSPICIOUS_LOW_COUNT"),
    ("CUTOFF_PDF", "ENGINEERING", 60, 100, None, None),
    ("CUTOFF_PDF", None, 49, None, None, "SUSPICIOUS_LOW_COUNT"),
    ("FEE_STRUCTURE_PDF", "ENGINEERING", 50, 1000, None, None),
    ("NOTIFICATION_PDF", None, 0, None, None, None),
]


def test_completeness(spark, table):
    schema = "id int, document_type string, program_type string, extracted_count bigint, baseline_count bigint, minimum int, is_corrigendum boolean"
    docs = table(schema, [(i, *g[:5], False) for i, g in enumerate(GATE)] + [(99, "CUTOFF_PDF", "ENGINEERING", 1, None, None, True)])
    found = {r.id: r.error_code for r in dq.completeness_gate(docs, dq.thresholds_frame(spark)).collect()}
    assert found == {**{i: g[5] for i, g in enumerate(GATE)}, 99: None}
    strict = dq.thresholds_frame(spark, {("CUTOFF_PDF", "ARCHITECTURE"): 10})
    assert {r.id for r in dq.completeness_gate(docs, strict).filter("error_code IS NOT NULL").collect()} >= {1}


def test_one_bad_seat_row_holds_the_document_back(table, spark):
    schema = "source_version_id string, branch_code string, is_valid boolean, error_codes array<string>, anomalies array<string>"
    rows = [("cut", "CS", i > 0, [], []) for i in range(52)] + [("seat", "CS", i > 0, [], []) for i in range(52)]
    rows += [("arch", "AT", True, [], [])] * 5
    docs = table(
        "source_version_id string, document_type string, program_type string, baseline_count bigint, minimum int, is_corrigendum boolean",
        [("cut", "CUTOFF_PDF", "ENGINEERING", None, None, False), ("seat", "SEAT_MATRIX_PDF", "ENGINEERING", None, None, False),
         ("arch", "CUTOFF_PDF", "ENGINEERING", None, None, False), ("void", "CUTOFF_PDF", "ENGINEERING", None, None, False)])
    tagged = table(schema, rows)
    out = dq.document_outcomes(tagged, docs, dq.thresholds_frame(spark))
    assert {r.source_version_id: r.failure_reason for r in out.collect()} == {
        "cut": None, "seat": "VALIDATION_FAILED", "arch": None, "void": "SUSPICIOUS_LOW_COUNT"}
    kept = dq.publishable_rows(tagged, out).groupBy("source_version_id").count().collect()
    assert {r[0]: r[1] for r in kept} == {"cut": 51, "arch": 5}


def test_document_anomaly(spark):
    docs = spark.createDataFrame([("CUTOFF_PDF", 0, True), ("CUTOFF_PDF", 5, False), ("BE_COLLEGES_HTML", 0, True)],
                                 "document_type string, extracted_count int, is_usable_text boolean")
    found = [r.a for r in docs.selectExpr(f"{dq.DOCUMENT_ANOMALY} AS a").collect()]
    assert found == ["SUSPICIOUSLY_EMPTY_DOCUMENT", "SCANNED_OR_EMPTY_PDF", None]


# publishing -------------------------------------------------------------------

STATE = "college_id string, branch_id string, category_code string, round_code string, academic_year int, opening_rank int, closing_rank int, source_version_id string, status string"
ROW = ("c1", "cs", "GM", "R1", 2026, None)
ARRIVAL = "CAST(substring(source_version_id, 2) AS INT)"


def test_versions_supersede_and_never_change(table, spark):
    rounds = ADMISSIONS.rounds_frame(spark)
    empty = table(STATE, [])

    def step(state, *rows):
        found = pub.publish_outcomes(table(STATE, [(*r, "PUBLISHED") for r in rows]), state, rounds, ["GM", "KKR"])
        after = pub.publish_state(found, state, ARRIVAL)
        plain = sorted((r.source_version_id, r.closing_rank, r.status) for r in after.collect())
        outcomes = sorted(r.outcome for r in found.collect())
        return outcomes, plain, table(STATE, [tuple(r[c] for c in (f.split(" ")[0] for f in STATE.split(", "))) for r in after.collect()])

    outcomes, plain, state = step(empty, (*ROW, 1500, "v1"))
    assert outcomes == ["PUBLISHED"] and plain == [("v1", 1500, "PUBLISHED")]
    outcomes, plain, state = step(state, (*ROW, 1600, "v2"))
    assert plain == [("v1", 1500, "SUPERSEDED"), ("v2", 1600, "PUBLISHED")]
    again, same, _ = step(state, (*ROW, 1600, "v2"))
    assert again == ["UNCHANGED"] and same == plain
    outcomes, same, _ = step(state, (*ROW, 1700, "v2"))
    assert outcomes == ["FACTUAL_MUTATION_REJECTED"] and same == plain
    outcomes, same, _ = step(state, ("c1", "cs", "GM", "R9", 2026, None, 5, "v3"), ("c1", "cs", "XX", "R1", 2026, None, 5, "v3"))
    assert outcomes == ["UNKNOWN_CATEGORY", "UNKNOWN_COUNSELLING_ROUND"] and same == plain
    _, both, _ = step(empty, (*ROW, 10, "v1"), (*ROW, 20, "v2"))
    assert both == [("v1", 10, "SUPERSEDED"), ("v2", 20, "PUBLISHED")]


def test_the_last_of_ten_versions_survives(table, spark):
    rows = [(*ROW, 100 * n, f"v{n}", "PUBLISHED") for n in range(1, 11)]
    held = table(STATE, [(*ROW, 7, "v0", "PUBLISHED")])
    found = pub.publish_outcomes(table(STATE, rows), held, ADMISSIONS.rounds_frame(spark))
    after = pub.publish_state(found, held, ARRIVAL).collect()
    assert len(after) == 11 and [r.source_version_id for r in after if r.status == "PUBLISHED"] == ["v10"]
    late = found.filter("source_version_id IN ('v9', 'v10')")
    counts = {r.source_version_id: r.superseded_records for r in pub.publish_report(late, held, ARRIVAL).collect()}
    assert counts == {"v9": 1, "v10": 0}


def test_publish_report(table, spark):
    state = table(STATE, [(*ROW, 1500, "v1", "PUBLISHED")])
    found = pub.publish_outcomes(table(STATE, [(*ROW, 1600, "v2", "PUBLISHED")]), state, ADMISSIONS.rounds_frame(spark))
    row = pub.publish_report(found, state, ARRIVAL).first()
    assert (row.published_records, row.superseded_records, row.verified_unchanged_records) == (1, 1, 0)


def test_seats_publish_once_with_null_keys(table):
    schema = "source_version_id string, college_id string, branch_id string, category_code string, round_code string, academic_year int"
    rows = table(schema, [("v", "c", "b", None, None, 2026), ("v", "c", "b", "GM", None, 2026)])
    first = pub.publish_absent(rows, table(schema, []), pub.SEAT_KEY)
    assert first.count() == 2
    assert pub.publish_absent(rows, first, pub.SEAT_KEY).count() == 0


def test_facts_are_rewritten_by_year(table, tmp_path, spark):
    path = str(tmp_path / "facts")
    schema = "college_id string, closing_rank int, academic_year int"
    sinks.write_facts(table(schema, [("a", 1, 2023), ("b", 2, 2024)]), path)
    sinks.write_facts(table(schema, [("c", 3, 2024)]), path)
    assert {tuple(r) for r in sinks.read_facts(spark, path, schema).collect()} == {("a", 1, 2023), ("c", 3, 2024)}


def test_college_upsert(table):
    schema = "college_code string, college_name string, original_name string, location string, institution_type string"
    old = table(schema, [("E1", "One", "ONE", "", "ENGINEERING"), ("E2", "Two", "TWO", "Mysuru", "ENGINEERING"), ("E4", "F", "F", None, "DENTAL")])
    new = table(schema, [("E1", "Uno", "UNO", "Hassan", None), ("E2", "Two", "TWO", "Elsewhere", "ARCHITECTURE"), ("E3", "Three", "THREE", None, None)])
    found = {r.college_code: r for r in pub.upsert_colleges(new, old).collect()}
    assert (found["E1"].college_name, found["E1"].location, found["E1"].outcome) == ("One", "Hassan", "UPDATED")
    assert (found["E2"].location, found["E2"].institution_type) == ("Mysuru", "ARCHITECTURE")
    assert (found["E3"].outcome, found["E3"].institution_type) == ("INSERTED", "ENGINEERING")
    assert found["E4"].outcome == "KEPT"


def test_branch_rules(table):
    found = pub.classify_branches(table("branch_code string, branch_name string", [
        ("AT", "x"), ("BDC", "Design"), ("DC", "y"), ("BPL", "z"), ("CM", "c"), ("XY", "Urban Planning"), ("ECS", "e"), ("QQ", "Bachelor of Design")]))
    rows = {r.branch_code: (r.program_type, r.is_canonical, r.canonical_code) for r in found.collect()}
    assert rows == {
        "AT": ("ARCHITECTURE", True, None), "BDC": ("DESIGN", False, "DC"), "DC": ("DESIGN", True, None), "BPL": ("OTHER", False, None),
        "CM": ("ENGINEERING", False, None), "XY": ("OTHER", True, None), "ECS": ("ENGINEERING", False, None), "QQ": ("DESIGN", True, None)}


def test_rounds_move(table, spark):
    facts = table("round_code string, academic_year int", [("R2", 2026), ("R2", 2023), ("R1", 2026)])
    moved = sorted(tuple(r) for r in pub.remap_rounds(facts, {"R2": "KKR_SPECIAL"}, [2025, 2026]).collect())
    assert moved == [("KKR_SPECIAL", 2026), ("R1", 2026), ("R2", 2023)]
    assert pub.drop_unused_rounds(facts, {"R2": "x"}).count() == 1


def test_review_queue(table):
    items = table("item_id string, source_id string, document_url string, failure_reason string, status string, reviewed_by string, review_notes string, created_at timestamp, source_version_id string",
                  [("1", "s", "u", "old", "PENDING_REVIEW", None, "n", None, "v1"), ("2", "s", "u", "old", "APPROVED", None, None, None, "v2")])
    import datetime
    t = datetime.datetime(2026, 1, 1)
    failures = table("source_id string, document_url string, failure_reason string, review_notes string, created_at timestamp, failure_id string",
                     [("s", "u", "first", None, t, "f1"), ("s", "u", "last", None, t, "f2"), ("s", "w", "new", "hi", t, "f3")])
    queue = pub.upsert_reviews(items, failures)
    rows = {r.item_id: r for r in queue.collect()}
    assert rows["1"].failure_reason == "last" and rows["1"].review_notes == "n"
    assert rows["2"].failure_reason == "old" and rows["f3"].status == "PENDING_REVIEW" and len(rows) == 3
    moves = table("item_id string, new_status string, reviewer string, notes string", [("1", "APPROVED", "r", "fine"), ("f3", "REJECTED", "", "")])
    moved = {r.item_id: r for r in pub.move_reviews(queue, moves).collect()}
    assert (moved["1"].status, moved["1"].reviewed_by, moved["1"].review_notes) == ("APPROVED", "r", "n | fine")
    assert (moved["f3"].status, moved["f3"].review_notes, moved["2"].status) == ("REJECTED", "hi", "APPROVED")
    closed = {r.item_id: r for r in pub.resolve_reviews(items, table("source_version_id string", [("v1",)])).collect()}
    assert closed["1"].status == "APPROVED" and closed["1"].review_notes == "n [Resolved: validated and published]"


def test_seeds_and_sources(table, spark):
    categories = registry.seed_categories(spark, table(schemas.CATEGORIES, [("GM", "mine", "")]))
    assert {r.category_code: r.category_name for r in categories.collect()}["GM"] == "mine" and categories.count() == 3
    rounds = registry.seed_rounds(table(schemas.ROUNDS, [(2026, "KKR_SPECIAL", "k", 2, True)]), ADMISSIONS)
    assert rounds.filter("academic_year = 2026 AND round_code = 'KKR_SPECIAL' AND NOT is_general_round").count() == 1
    assert rounds.count() == 21
    fields = "source_code string, url string, title string, authority_level string, is_enabled boolean, check_frequency_hours int, document_type string, parser_version string"
    old = table("source_id string, " + fields + ", last_seen_hash string", [
        ("1", "A", "u1", "t", "x", True, 1, "d", "v0", "h1"), ("2", None, "u2", "t", "x", True, 1, "d", "v0", "h2"), ("3", "C", "u3", "t", "x", True, 1, "d", "v0", "h3")])
    new = table(fields, [("A", "other", "n", "y", False, 9, "e", "v1"), ("B", "u2", "n", "y", False, 9, "e", "v1"), ("N", "u9", "n", "y", False, 9, "e", "v1")])
    rows = {r.source_code: r for r in registry.sync_sources(old, new).collect()}
    assert (rows["A"].url, rows["A"].title, rows["A"].last_seen_hash) == ("u1", "n", "h1")
    assert rows["B"].source_id == "2" and rows["N"].outcome == "INSERTED" and rows["C"].outcome == "KEPT"


def test_sql_columns_helper(spark):
    assert spark.range(1).withColumns(columns({"a": "id + 1"})).first().a == 1


def test_baseline_counts_are_kept_up(spark, table):
    schema = "branch_id string, academic_year int, round_code string, status string"
    branches = table("branch_id string, program_type string", [("cs", "ENGINEERING"), ("at", "ARCHITECTURE")])
    rng = random.Random(1)
    parts = {p: [] for p in range(4)}
    counts = pub.published_counts(table(schema, []), branches)
    for _ in range(4):  # each batch rewrites some parts of the store
        touched = rng.sample(range(4), 2)
        before = [r for p in touched for r in parts[p]]
        for p in touched:
            kept = [(*r[:3], rng.choice(["PUBLISHED", "SUPERSEDED"])) for r in parts[p] if rng.random() < 0.8]
            parts[p] = kept + [(rng.choice(["cs", "at"]), rng.choice([2020, 2021]), rng.choice(["R1", "R3"]), "PUBLISHED") for _ in range(5)]
        after = [r for p in touched for r in parts[p]]
        counts = table("academic_year int, round_code string, program_type string, baseline_count bigint", [
            tuple(r) for r in pub.updated_counts(counts, table(schema, before), table(schema, after), branches).collect()])
    everything = pub.published_counts(table(schema, [r for p in parts.values() for r in p]), branches)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, everything.collect()))


def test_documents_are_held_against_what_was_published(spark, table):
    rows = table("source_version_id string, branch_code string, is_valid boolean", [("a", "CS", True)] * 60 + [("b", "CS", True)] * 60 + [("c", "CS", True)] * 20)
    documents = table(
        "source_version_id string, document_type string, program_type string, baseline_count bigint, minimum int, is_corrigendum boolean, "
        "academic_year int, counselling_round string, is_usable_text boolean",
        [("a", "CUTOFF_PDF", "ENGINEERING", None, None, False, 2024, "R1", True), ("b", "CUTOFF_PDF", "ENGINEERING", None, None, False, 2025, "R1", False),
         ("c", "CUTOFF_PDF", "ENGINEERING", None, None, True, 2024, "R1", True), ("d", "SEAT_MATRIX_PDF", "ENGINEERING", None, None, False, 2024, "R1", True)],
    )
    baseline = table("academic_year int, round_code string, program_type string, baseline_count bigint", [(2024, "R1", "ENGINEERING", 201)])
    got = {r.source_version_id: r for r in dq.document_outcomes(rows, documents, dq.thresholds_frame(spark), baseline).collect()}
    assert (got["a"].error_code, got["a"].baseline_count) == (None, 201)  # 60 is 30 % of 201, rounded down
    assert (got["b"].error_code, got["b"].baseline_count, got["b"].document_anomaly) == (None, None, "SCANNED_OR_EMPTY_PDF")
    assert got["c"].error_code is None and got["d"].document_anomaly == "SUSPICIOUSLY_EMPTY_DOCUMENT"
    more = baseline.selectExpr("academic_year", "round_code", "program_type", "204L AS baseline_count")
    again = {r.source_version_id: r.error_code for r in dq.document_outcomes(rows, documents, dq.thresholds_frame(spark), more).collect()}
    assert again["a"] == "SUSPICIOUS_LOW_COUNT" and again["c"] is None
    one = spark.sql("SELECT 'The Corrigendum of May' AS t, CAST(NULL AS STRING) AS u").selectExpr(dq.corrigendum("t", "u")).first()
    assert one[0] is True


def test_versions_follow_their_round(table):
    got = pub.remap_versions(table("counselling_round string", [("R2",), ("R3",), (None,)]), {"R2": "KKR_SPECIAL"}).collect()
    assert [r[0] for r in got] == ["KKR_SPECIAL", "R3", None]
