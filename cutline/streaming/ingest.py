"""Incremental ingest: rows are logged, and the documents they belong to are judged anew from all their rows.

The result after the last trigger does not depend on how the rows were dealt to triggers. Whether a document is complete
and which of two equal rows counts can only be said of the whole document, so a trigger appends its rows to a log and
then validates, gates and publishes every document it touched from the log. A document that gets no more rows is never
read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions.sql import texts
from cutline.operators import publish, quality
from cutline.plans.pooled import broadcast_within, lookup
from cutline.schemas import CUTOFF_KEY
from cutline.session import settings, smaller_partitions
from cutline.sources.store import Snapshot, Staged, Store, bucket, with_status

FACTS = (
    "college_id string, branch_id string, category_code string, round_code string, source_version_id string, "
    "opening_rank int, closing_rank int, row_identifier string, status string, academic_year int, part int"
)
RAW = [
    "row_idx", "college_code", "branch_code", "category_code", "round_code", "opening_rank", "closing_rank",
    "academic_year", "row_identifier", "source_version_id",
]
OUTCOMES = (
    "college_id string, branch_id string, category_code string, round_code string, academic_year int, "
    "source_version_id string, opening_rank int, closing_rank int, row_identifier string, outcome string, batch bigint"
)
_PART = ["academic_year", "part"]


def _parts(rows: DataFrame) -> list[str]:
    """The parts of the facts that rows fall into, by the names that the store gives them."""
    return sorted(
        "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if r[c] is None else r[c]}" for c in _PART)
        for r in rows.select(*_PART).distinct().collect()
    )


def _has_earlier(before: Snapshot, logged: Staged) -> bool:
    """Whether the log may hold earlier rows of the documents of a batch; if not, none need to be looked for."""
    return any(p in before.tables.get("log", {}) for p in logged.parts)


@dataclass(frozen=True)
class CutoffIngest:
    """One ingest of cutoff rows into the store below ``path``.

    ``colleges`` (college_id, college_code), ``branches`` (branch_id,
    branch_code) and ``rounds`` are the registered dimensions. ``documents`` has
    one row per source version, for the completeness gate; without it no
    document is held back. ``parts`` is the number of parts that colleges, and
    documents of the log, are dealt to: a batch reads and rewrites only the
    parts its rows fall into.
    """

    path: str
    colleges: DataFrame
    branches: DataFrame
    rounds: DataFrame
    categories: Sequence[str]
    version_order: str  # SQL text over facts that grows with the arrival of a version
    documents: DataFrame | None = None
    parts: int = 16

    def store(self) -> Store:
        return Store(self.colleges.sparkSession, self.path)

    def facts(self) -> DataFrame:
        """The published and superseded facts of the last commit; empty before the first."""
        store = self.store()
        return store.read(store.snapshot(), "facts", FACTS).drop("part")

    def outcomes(self) -> DataFrame:
        """What each batch did: one row per fact it changed and per row it refused."""
        store = self.store()
        return store.read(store.snapshot(), "outcomes", OUTCOMES)

    def process(self, rows: DataFrame, batch_id: int) -> None:
        """Publish one batch of raw rows. A batch that was committed before is skipped, and keeps its outcomes.

        Nothing of the store changes before the commit at the end. A row is known by its document and ``row_idx``;
        sent again it never replaces the first one: with the same rank it is UNCHANGED, with another one
        FACTUAL_MUTATION_REJECTED. Rows without a version or an index cannot be told apart and are left out. Until a
        document is complete its facts follow from the rows so far, so a later row may still change or withdraw them
        (REVISED, WITHDRAWN).
        """
        store = self.store()
        before = store.snapshot()
        if before.done(batch_id):
            return
        # the rows of a stream belong to a session of their own
        with settings(rows.sparkSession, smaller_partitions(rows.sparkSession)):
            with settings(store.spark, smaller_partitions(store.spark)):
                self._process(store, before, rows, batch_id)

    def _process(self, store: Store, before: Snapshot, rows: DataFrame, batch_id: int) -> None:
        # dealt to parts by the tasks that read them, as what follows deals them anew by other columns
        logged = store.stage_in_place(
            rows.select(*RAW).where("source_version_id IS NOT NULL AND row_idx IS NOT NULL")
            .withColumns({"batch": F.lit(batch_id).cast("bigint"), "part": F.expr(bucket("source_version_id", self.parts))}),
            "log", ["part"],
        )
        if not logged.parts:
            store.commit(before, batch_id)
            return
        valid, parts = self._valid(store, before, logged)
        touched = store.staged(logged).select("source_version_id").distinct()
        held = store.read(before, "facts", FACTS, parts)
        of_touched = lookup(held, touched.withColumn("_touched", F.lit(True)), ["source_version_id"])
        judged = publish.publish_outcomes(
            store.staged(valid), of_touched.where("_touched").drop("_touched"), self.rounds, list(self.categories)
        )
        judged = store.stage(judged, "judged")
        accepted = store.staged(judged).where("outcome NOT LIKE 'UNKNOWN%'")
        columns = [c.split(" ")[0] for c in FACTS.split(", ")]
        state = with_status(
            of_touched.where("_touched IS NULL").drop("_touched").unionByName(accepted.select(*columns)),
            CUTOFF_KEY, self.version_order,
        )
        facts = store.stage(state, "facts", _PART)
        changes = store.stage(self._changes(store, judged, of_touched, before, logged, batch_id), "outcomes")
        store.commit(before, batch_id, replace=[(facts, parts)], append=[logged, changes])
        for done in (valid, judged):
            store.discard(done)

    def _valid(self, store: Store, before: Snapshot, logged: Staged) -> tuple[Staged, list[str]]:
        """Rows to publish of all documents of the batch, from the whole log, and the parts of the facts of all valid rows.

        Rows are dealt once, by document and ``row_idx``, and stay there until they are written; of a row that is
        refused only its document is. The registries and the documents that pass go to the rows, if they are small.
        """
        if _has_earlier(before, logged):
            everything = store.read(before, "log", logged.schema, logged.parts, also=logged)
            touched = store.staged(logged).select("source_version_id").distinct()
            rows = lookup(everything, touched.withColumn("_touched", F.lit(True)), ["source_version_id"], "inner")
        else:
            rows = store.staged(logged)  # nothing else was logged for these documents
        rest = [c for c in RAW if c not in ("source_version_id", "row_idx")]
        row = ["source_version_id", "row_idx"]
        # the condition holds for all rows; a join adds it to one side, and the sides would not share their shuffle
        rows = rows.where("source_version_id IS NOT NULL AND row_idx IS NOT NULL")
        first = rows.select(*row, "batch", *rest).repartition(*row).groupBy(*row).agg(
            F.expr(f"min(struct(batch, {', '.join(rest)})) AS _first")
        ).selectExpr(*row, "_first.*")
        colleges = broadcast_within(self.colleges.select("college_code", "college_id"))
        branches = broadcast_within(self.branches.select("branch_code", "branch_id"))
        tagged = quality.validate_cutoffs(
            first, colleges, branches, self.categories, batch=["source_version_id"], dealt=True
        )
        # read by the gate and by what passes it: Spark would validate all rows anew for each
        of_valid = [f"CASE WHEN is_valid THEN {c} END AS {c}" for c in ("row_idx", "batch", *rest)]
        aside = [store.stage(tagged.selectExpr("source_version_id", "is_valid", *of_valid), "tagged")]
        tagged = store.staged(aside[0])
        keyed = lookup(quality.valid_rows(tagged), colleges, ["college_code"], "inner")
        keyed = lookup(keyed, branches, ["branch_code"], "inner").select(
            *CUTOFF_KEY, "source_version_id", "opening_rank", "closing_rank", "row_identifier", "status", "row_idx",
            "batch", F.expr(f"{bucket('college_id', self.parts)} AS part"),
        )
        parts = _parts(keyed)
        if self.documents is not None:
            outcomes = quality.document_outcomes(tagged, self.documents, quality.thresholds_frame(store.spark))
            passed = outcomes.where("failure_reason IS NULL").select("source_version_id").distinct()
            aside.append(store.stage(passed, "passed"))
            keyed = lookup(keyed, broadcast_within(store.staged(aside[1])), ["source_version_id"], "inner")
        valid = store.stage(keyed, "valid")
        for done in aside:
            store.discard(done)
        return valid, parts

    def _changes(
        self, store: Store, judged: Staged, of_touched: DataFrame, before: Snapshot, logged: Staged, batch_id: int
    ) -> DataFrame:
        """Outcome rows of a batch."""
        key = [*CUTOFF_KEY, "source_version_id"]
        values = [*key, "opening_rank", "closing_rank", "row_identifier"]
        rows = store.staged(judged)
        found = rows.where(f"outcome IN {texts(['PUBLISHED', 'FACTUAL_MUTATION_REJECTED'])} OR (outcome LIKE 'UNKNOWN%' AND batch = {batch_id})")
        found = found.selectExpr(*values, "replace(outcome, 'FACTUAL_MUTATION_REJECTED', 'REVISED') AS outcome")
        gone = (
            of_touched.where("_touched").join(rows.where("outcome NOT LIKE 'UNKNOWN%'").select(*key), key, "left_anti")
            .selectExpr(*values, "'WITHDRAWN' AS outcome")
        )
        again = (
            store.staged(logged).selectExpr("source_version_id", "row_idx", "closing_rank AS _rank")
            .join(rows.where(f"batch < {batch_id}"), ["source_version_id", "row_idx"])
            .selectExpr(*values, "CASE WHEN _rank <=> closing_rank THEN 'UNCHANGED' ELSE 'FACTUAL_MUTATION_REJECTED' END AS outcome")
        )
        out = found.union(gone)
        return (out.union(again) if _has_earlier(before, logged) else out).withColumn("batch", F.lit(batch_id).cast("bigint"))

    def run(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame]) -> None:
        """Process all rows of a stream that are there, and stop; ``prepare`` makes raw rows of a batch."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            self.process(prepare(batch), batch_id)

        query = (
            stream.writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
