"""Atomic commits, pruned parts, and ingest that does not depend on triggers."""

import random

import pytest

from cutline.plans.calendar import ADMISSIONS
from cutline.sources.store import Store, bucket, with_status
from cutline.streaming import ingest as ingest_module
from cutline.streaming.ingest import CutoffIngest

RAW = ("row_idx bigint, college_code string, branch_code string, category_code string, round_code string, opening_rank int, "
       "closing_rank int, academic_year int, row_identifier string, source_version_id string")
DOCS = "source_version_id string, document_type string, program_type string, baseline_count bigint, minimum int, is_corrigendum boolean"


def ingest(spark, table, path, documents=None):
    return CutoffIngest(
        str(path),
        table("college_code string, college_id string", [(f"E{i:03}", f"c{i}") for i in range(1, 9)]),
        table("branch_code string, branch_id string", [("CS", "cs"), ("AT", "at")]),
        ADMISSIONS.rounds_frame(spark),
        ["GM", "KKR"],
        "CAST(substring_index(source_version_id, 'v', -1) AS INT)",
        None if documents is None else table(DOCS, documents),
        parts=4,
    )


def facts_of(job):
    return sorted(map(tuple, job.facts().collect()), key=repr)


def row(idx, college, rank, version, branch="CS", category="GM", year=2026):
    return (idx, f"E{college:03}", branch, category, "R1", None, rank, year, f"r{idx}", version)


def test_one_row_per_trigger_gives_the_facts_of_one_batch(spark, table, tmp_path):
    documents = [("a-v1", "CUTOFF_PDF", "ENGINEERING", None, 4, False), ("a-v2", "CUTOFF_PDF", "ENGINEERING", None, 2, False),
                 ("s-v1", "SEAT_MATRIX_PDF", "ENGINEERING", None, 1, False), ("late-v1", "CUTOFF_PDF", "ENGINEERING", None, 3, False)]
    rows = [row(i, i, 1000 + i, "a-v1") for i in (1, 2, 3, 4)]
    rows += [row(0, 2, 55, "a-v1")]  # copies of a key: the smallest index counts
    rows += [row(1, 1, 2000, "a-v2"), row(2, 7, 2100, "a-v2"), row(1, 5, 10, "s-v1"), row(2, 99, 10, "s-v1")]
    once = ingest(spark, table, tmp_path / "once", documents)
    once.process(table(RAW, rows), 0)
    expected = facts_of(once)
    assert len(expected) == 6 and {r[4] for r in expected} == {"a-v1", "a-v2"}
    random.seed(3)
    random.shuffle(rows)
    job = ingest(spark, table, tmp_path / "each", documents)
    for i, one in enumerate(rows):
        job.process(table(RAW, [one]), i)
    assert facts_of(job) == expected
    assert {r.outcome for r in job.outcomes().collect()} >= {"PUBLISHED"}


def test_facts_follow_the_rows_so_far(spark, table, tmp_path):
    documents = [("a-v1", "SEAT_MATRIX_PDF", "ARCHITECTURE", None, 1, False)]
    job = ingest(spark, table, tmp_path / "s", documents)
    job.process(table(RAW, [row(5, 1, 100, "a-v1")]), 0)
    assert [r[6] for r in facts_of(job)] == [100]
    job.process(table(RAW, [row(2, 1, 90, "a-v1")]), 1)  # the earlier row of the key, and the other one is now a copy
    assert facts_of(job) == []  # one rejected row holds a seat document back
    assert {(r.batch, r.outcome) for r in job.outcomes().collect()} == {(0, "PUBLISHED"), (1, "WITHDRAWN")}


def test_the_same_rows_again(spark, table, tmp_path):
    job = ingest(spark, table, tmp_path / "s")
    first = [row(1, 1, 100, "a-v1"), row(2, 2, 200, "a-v1"), row(3, 3, 300, "a-v1", category="ODD")]
    job.process(table(RAW, first), 0)
    before, outcomes = facts_of(job), sorted(map(tuple, job.outcomes().collect()), key=repr)
    assert [o[9] for o in outcomes].count("PUBLISHED") == 2 and [o[9] for o in outcomes].count("UNKNOWN_CATEGORY") == 1
    job.process(table(RAW, first[:1] + [row(2, 2, 999, "a-v1")]), 1)
    assert facts_of(job) == before
    assert sorted(r.outcome for r in job.outcomes().where("batch = 1").collect()) == ["FACTUAL_MUTATION_REJECTED", "UNCHANGED"]
    job.process(table(RAW, [row(8, 8, 1, "a-v1")]), 0)  # a replay, whatever it holds, is skipped
    assert facts_of(job) == before and sorted(map(tuple, job.outcomes().where("batch = 0").collect()), key=repr) == outcomes


def test_a_crash_before_the_switch_changes_nothing(spark, table, tmp_path, monkeypatch):
    job = ingest(spark, table, tmp_path / "s")
    job.process(table(RAW, [row(1, 1, 100, "a-v1")]), 0)
    before = facts_of(job)
    with monkeypatch.context() as patch:
        patch.setattr(Store, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            job.process(table(RAW, [row(1, 1, 50, "a-v2"), row(1, 2, 60, "b-v1")]), 1)
    assert facts_of(job) == before and job.outcomes().where("batch = 1").isEmpty()
    job.process(table(RAW, [row(1, 1, 50, "a-v2"), row(1, 2, 60, "b-v1")]), 1)
    assert [(r[4], r[8]) for r in facts_of(job)] == [("a-v1", "SUPERSEDED"), ("a-v2", "PUBLISHED"), ("b-v1", "PUBLISHED")]


def test_an_older_version_that_comes_late_is_superseded(spark, table, tmp_path):
    job = ingest(spark, table, tmp_path / "s")
    for batch, (version, rank) in enumerate([("a-v10", 10), ("a-v9", 9), ("a-v11", 11)]):
        job.process(table(RAW, [row(1, 1, rank, version)]), batch)
    assert {(r[4], r[8]) for r in facts_of(job)} == {("a-v9", "SUPERSEDED"), ("a-v10", "SUPERSEDED"), ("a-v11", "PUBLISHED")}


def test_only_touched_parts_are_read_and_rewritten(spark, table, tmp_path):
    job = ingest(spark, table, tmp_path / "s")
    job.process(table(RAW, [row(100 * y + i, i, 100 + i, "a-v1", year=y) for y in (2024, 2025) for i in range(1, 9)]
                      + [row(20 + i, i, 7, "b-v1", year=2026) for i in range(1, 9)]), 0)
    store = job.store()
    first = store.snapshot()
    job.process(table(RAW, [row(1, 1, 50, "c-v2", year=2025)]), 1)
    second = store.snapshot()
    changed = {p for p in second.tables["facts"] if second.tables["facts"][p] != first.tables["facts"][p]}
    assert len(changed) == 1 and all(p.startswith("academic_year=2025/") for p in changed)
    pruned = store.read(first, "facts", "college_id string, academic_year int, part int", changed)
    assert 0 < len(pruned.inputFiles()) < len(store.read(first, "facts", "college_id string").inputFiles())
    assert all("academic_year=2025" in f for f in pruned.inputFiles())
    facts = {(r[0], r[4], r[9]): r[8] for r in facts_of(job)}
    assert facts["c1", "a-v1", 2025] == "SUPERSEDED" and facts["c1", "c-v2", 2025] == "PUBLISHED"


def test_store_reads_old_states_and_sweeps(spark, table, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    assert store.snapshot().number == -1 and store.read(store.snapshot(), "x", "k int").count() == 0
    states = [store.snapshot()]
    for n in range(4):
        staged = store.stage(table("k int, v int", [(1, n), (2 + n % 2, n)]), "x", ["k"])
        states.append(store.commit(states[-1], n, replace=[(staged, ["k=1", "k=2", "k=3"])]))
    read = lambda s: sorted(map(tuple, store.read(s, "x", "v int, k int").collect()))
    assert read(store.snapshot(1)) == [(1, 1), (1, 3)] and read(states[-1]) == [(3, 1), (3, 3)]
    assert states[-1].batches == ((0, 3),) and states[-1].done(2) and not states[-1].done(4)
    with pytest.raises(RuntimeError):
        store.commit(states[1], 9)
    assert store.sweep(keep=1) == 3 and read(store.snapshot()) == [(3, 1), (3, 3)]
    store.commit(store.snapshot(), 7, append=[store.stage(table("k int, v int", [(3, 9)]), "x", ["k"])])
    assert read(store.snapshot()) == [(3, 1), (3, 3), (9, 3)] and store.snapshot().batches == ((0, 3), (7, 7))


def test_parts_and_status(spark, table):
    df = table("college_id string, source_version_id string", [("a", "v2"), ("a", "v10"), ("b", "v1")])
    got = with_status(df, ["college_id"], "CAST(substring(source_version_id, 2) AS INT)").collect()
    assert {(r.college_id, r.source_version_id): r.status for r in got} == {
        ("a", "v2"): "SUPERSEDED", ("a", "v10"): "PUBLISHED", ("b", "v1"): "PUBLISHED"}
    assert {r[0] for r in spark.range(500).selectExpr(bucket("id", 4)).collect()} == {0, 1, 2, 3}


def test_rows_without_version_or_index_and_empty_batches(spark, table, tmp_path):
    job = ingest(spark, table, tmp_path / "s")
    job.process(table(RAW, []), 0)
    job.process(table(RAW, [(None, "E001", "CS", "GM", "R1", None, 5, 2026, None, "a-v1"), row(1, 1, 5, None)]), 1)
    assert job.facts().isEmpty() and job.store().snapshot().batches == ((0, 1),)


def test_a_first_batch_joins_nothing_that_is_not_there(spark, table, tmp_path, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    staged, stage = {}, Store.stage
    monkeypatch.setattr(Store, "stage", lambda self, rows, name, by=(): staged.setdefault(name, []).append(plan(rows)) or stage(self, rows, name, by))
    job = ingest(spark, table, tmp_path / "s", [("a-v1", "CUTOFF_PDF", "ENGINEERING", None, 1, False)])
    job.process(table(RAW, [row(i, i, 100 + i, "a-v1") for i in (1, 2, 3)]), 0)
    assert len(facts_of(job)) == 3 and len(staged["tagged"]) == 1
    # rows are validated once, and joined neither to facts nor to a log that are empty
    assert "FullOuter" not in staged["judged"][0] and staged["judged"][0].count("Join ") == 1  # the rounds
    assert "Join " not in staged["facts"][0] and "Join " not in staged["outcomes"][0]
    job.process(table(RAW, [row(1, 1, 101, "a-v1"), row(4, 4, 104, "a-v1")]), 1)
    assert len(facts_of(job)) == 4 and "Join " in staged["outcomes"][1]
    assert {r.outcome for r in job.outcomes().where("batch = 1").collect()} >= {"UNCHANGED", "PUBLISHED"}


def test_rows_are_shuffled_once(spark, table, tmp_path, monkeypatch):
    plans, write = {}, Store._write
    names = ("classic.shuffleDependency.fileCleanup.enabled", "adaptive.coalescePartitions.initialPartitionNum", "adaptive.advisoryPartitionSizeInBytes")
    settings = lambda: [spark.conf.get(f"spark.sql.{n}", None) for n in names]
    before = settings()

    def seen(self, rows, name, by):
        if name in ("log", "tagged"):
            rows.collect()
            plans[name] = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return write(self, rows, name, by)

    monkeypatch.setattr(Store, "_write", seen)
    job = ingest(spark, table, tmp_path / "s", [("a-v1", "CUTOFF_PDF", "ENGINEERING", None, 1, False)])
    job.process(table(RAW, [row(i, i % 8 + 1, 100 + i, "a-v1") for i in range(40)]), 0)
    assert len(facts_of(job)) == 8
    # the log is written where its rows are; of the rows to judge, both sides of the join that finds copies share one shuffle
    assert "Exchange" not in plans["log"]
    dealt = [line.lstrip(" :+-") for line in plans["tagged"].split("\n") if "REPARTITION_BY_COL" in line]
    assert len(dealt) == 2 and sum(line.startswith("ReusedExchange") for line in dealt) == 1
    assert "isnull(source_version_id" not in plans["tagged"]
    assert "32), REPARTITION" in dealt[0]  # four times the session's 8, so that sorts stay in memory
    assert settings() == before


def test_only_what_is_committed_stays_on_disk(spark, table, tmp_path):
    job = ingest(spark, table, tmp_path / "s", [("a-v1", "CUTOFF_PDF", "ENGINEERING", None, 1, False)])
    for batch in range(2):
        job.process(table(RAW, [row(i, i, 100 + i, "a-v1") for i in range(1 + batch, 8)]), batch)
    left = {f.relative_to(tmp_path / "s").parts[0] for f in (tmp_path / "s").rglob("*.parquet")}
    assert left == {"log", "facts", "outcomes"} and len(facts_of(job)) == 7


def test_parts_of_rows_have_the_names_of_their_folders(spark, table, tmp_path):
    rows = table("v int, academic_year int, part int", [(1, 2025, 3), (2, 2025, 3), (3, None, 0), (4, 1999, 11)])
    staged = Store(spark, str(tmp_path / "t")).stage(rows, "x", ["academic_year", "part"])
    assert ingest_module._parts(rows) == list(staged.parts) and len(staged.parts) == 3


def test_refused_rows_count_for_their_document_only(spark, table, tmp_path):
    # one copy, one rank of 0 and one unknown college among 6 rows; 3 rows pass, so that a-v1 is complete and b-v1 is not
    bad = lambda v: [row(4, 1, 99, v), row(5, 2, 0, v), row(6, 99, 10, v)]
    good = lambda v: [row(i, i, 100 + i, v) for i in (1, 2, 3)]
    job = ingest(spark, table, tmp_path / "s", [
        ("a-v1", "CUTOFF_PDF", "ENGINEERING", None, 3, False), ("b-v1", "CUTOFF_PDF", "ENGINEERING", None, 4, False),
        ("c-v1", "SEAT_MATRIX_PDF", "ENGINEERING", None, 1, False)])
    job.process(table(RAW, [r for v in ("a-v1", "b-v1", "c-v1") for r in good(v) + bad(v)]), 0)
    assert [(r[0], r[4], r[6]) for r in facts_of(job)] == [("c1", "a-v1", 101), ("c2", "a-v1", 102), ("c3", "a-v1", 103)]
