import datetime
import random

from cutline.plans.calendar import ADMISSIONS
from cutline.sources.store import Store
from cutline.sources.workdir import shared_folder
from cutline.streaming import arrivals
from cutline.streaming.ingest import CutoffIngest

RAW = ("row_idx bigint, college_code string, branch_code string, category_code string, round_code string, opening_rank int, "
       "closing_rank int, academic_year int, row_identifier string, source_version_id string")


def test_ingest_is_incremental_and_idempotent(spark, table, tmp_path):
    job = CutoffIngest(
        str(tmp_path / "store"),
        table("college_code string, college_id string", [("E001", "c1")]),
        table("branch_code string, branch_id string", [("CS", "cs")]),
        ADMISSIONS.rounds_frame(spark),
        ["GM", "KKR"],
        "CAST(substring(source_version_id, 2) AS INT)",
    )
    inbox, state = str(tmp_path / "inbox"), str(tmp_path / "state")

    def arrive(*rows):
        table(RAW, list(rows)).coalesce(1).write.mode("append").parquet(inbox)
        job.run(spark.readStream.schema(RAW).parquet(inbox), state, lambda batch: batch)
        return sorted((r.source_version_id, r.round_code, r.closing_rank, r.status) for r in job.facts().collect())

    first = (1, "E001", "CS", "GM", "R1", None, 1500, 2026, "a", "v1")
    bad = (2, "E999", "CS", "GM", "R1", None, 1500, 2026, "b", "v1")
    other_year = (3, "E001", "CS", "GM", "R1", None, 900, 2024, "c", "v1")
    assert arrive(first, bad, other_year) == [("v1", "R1", 900, "PUBLISHED"), ("v1", "R1", 1500, "PUBLISHED")]
    second = (1, "E001", "CS", "GM", "R1", None, 1600, 2026, "a", "v2")
    after = [("v1", "R1", 900, "PUBLISHED"), ("v1", "R1", 1500, "SUPERSEDED"), ("v2", "R1", 1600, "PUBLISHED")]
    assert arrive(second) == after
    assert arrive(second) == after  # the same version again changes nothing
    job.process(table(RAW, [second]), 99)
    assert sorted((r.source_version_id, r.round_code, r.closing_rank, r.status) for r in job.facts().collect()) == after
    assert {r.outcome for r in job.outcomes().filter("batch = 99").collect()} == {"UNCHANGED"}


def test_arrivals_over_several_batches(spark, table, tmp_path):
    schema = "source_id string, ts timestamp, content string"
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        table(schema, [(s, datetime.datetime(2026, 1, d, h), c) for s, d, h, c in rows]).coalesce(1).write.mode("append").parquet(inbox)
        arrivals.run_arrivals(spark.readStream.schema(schema).parquet(inbox), out, state)

    arrive(("s", 1, 1, "a"), ("s", 1, 2, "a"), ("s", 1, 3, "b"), ("t", 2, 1, "a"))
    arrive(("s", 1, 9, "a"), ("s", 2, 9, "a"))
    daily = arrivals.daily_arrivals(spark, out)
    found = sorted((r.source_id, r.day, r.documents, r.arrivals, r.copies) for r in daily.collect())
    assert found == [("s", "2026-01-01", 2, 4, 2), ("s", "2026-01-02", 1, 1, 0), ("t", "2026-01-02", 1, 1, 0)]
    stale = {r.source_id: r.status for r in arrivals.staleness(daily, "2026-01-04", 24).collect()}
    assert stale == {"s": "HEALTHY", "t": "HEALTHY"}


def test_late_arrivals_count_in_any_order(spark, table, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("st"), datetime.datetime(2026, 1, rng.randint(1, 28), 5), rng.choice("abc")) for _ in range(120)]
    rows += [("s", None, "a")]
    rng.shuffle(rows)
    store, schema = Store(spark, str(tmp_path / "out")), "source_id string, ts timestamp, content string"
    for i in range(0, len(rows), 11):
        arrivals.count_batch(store, table(schema, rows[i : i + 11]), i // 11)
    arrivals.count_batch(store, table(schema, rows), 3)  # a replay is skipped
    got = {(r.source_id, r.day): (r.documents, r.arrivals) for r in arrivals.daily_arrivals(spark, str(tmp_path / "out")).collect()}
    days = {}
    for source, ts, content in rows:
        days.setdefault((source, ts and f"{ts:%Y-%m-%d}"), []).append(content)
    assert got == {k: (len(set(v)), len(v)) for k, v in days.items()}
    late, newest = 0, None
    for i in range(0, len(rows), 11):
        times = [r[1] for r in rows[i : i + 11] if r[1]]
        late += sum(newest is not None and t < newest - datetime.timedelta(days=7) for t in times)
        newest = max(times + [newest] if newest else times)
    assert sum(r.late for r in arrivals.late_arrivals(spark, str(tmp_path / "out")).collect()) == late > 0
    assert max(map(len, store.snapshot().tables["arrivals"].values())) < arrivals.MERGE_FROM


def test_shared_folder_follows_the_session(spark):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://all/share/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_folder(Session(), "x").startswith("hdfs://all/share/x-")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
