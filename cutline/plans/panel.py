"""The canonical panel and its wide form, one row per combo.

The panel is the star join of the cutoff facts with alias branches mapped to
their canonical branch. The wide form is one aggregate over it: a row per
(college, branch, program, category) with the closing ranks of every
(year, round) slot of the calendar. Year pairs, year triples, progressions and
histories are then expressions on one row instead of self-joins, so all
longitudinal operators need a single shuffle, on the combo.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions.ranks import nonzero
from cutline.functions.sql import case, inline, text
from cutline.plans.calendar import STRICT_SCOPE, TERMINAL_SCOPES, RoundCalendar

NO_RANK = "CAST(NULL AS INT)"
COMBO = ["college_id", "college_code", "branch_id", "branch_code", "program_type", "category"]


def canonical_branches(branches: DataFrame) -> DataFrame:
    """Every branch with the identity to report it under (one hop along the alias)."""
    target = branches.selectExpr(
        "branch_id AS _tid", "branch_code AS _tcode", "branch_name AS _tname", "program_type AS _tprog"
    )
    points = F.expr("CASE WHEN NOT is_canonical THEN canonical_branch_id END")
    joined = branches.withColumn("_points", points).join(target, F.col("_points") == F.col("_tid"), "left")
    return joined.selectExpr(
        "branch_id AS raw_branch_id",
        "coalesce(_tid, branch_id) AS branch_id",
        "nvl2(_tid, _tcode, branch_code) AS branch_code",
        "nvl2(_tid, _tname, branch_name) AS branch_name",
        "nvl2(_tid, _tprog, program_type) AS program_type",
    )


def canonical_panel(
    cutoffs: DataFrame,
    colleges: DataFrame,
    branches: DataFrame,
    rounds: DataFrame,
    *,
    categories: DataFrame | None = None,
    academic_year: int | None = None,
    program_type: str | None = None,
    category: str | None = None,
    round_code: str | None = None,
    status: str | None = "PUBLISHED",
    college_id: str | None = None,
    branch_id: str | None = None,
) -> DataFrame:
    """Cutoffs with their dimensions, on canonical branches, one row per fact.

    An alias branch and its canonical branch may both hold a row for a slot;
    both are kept here, and ``wide_panel`` takes the greatest closing rank.
    """
    facts = cutoffs
    for name, value in [
        ("status", status),
        ("academic_year", academic_year),
        ("category_code", category),
        ("round_code", round_code),
        ("college_id", college_id),
    ]:
        if value is not None:
            facts = facts.filter(F.col(name) == value)
    if categories is not None:
        facts = facts.join(categories.select("category_code"), "category_code")
    canon = canonical_branches(branches)
    rounds = rounds.select("academic_year", "round_code", "round_number", "is_general_round")
    panel = (
        facts.withColumnRenamed("branch_id", "_raw_branch")
        .join(rounds, ["academic_year", "round_code"])
        .join(canon, F.col("_raw_branch") == F.col("raw_branch_id"), "left")
        .join(colleges.select("college_id", "college_code", "college_name", "institution_type"), "college_id")
        .selectExpr(
            "record_id",
            "academic_year",
            "closing_rank",
            "opening_rank",
            "college_id",
            "college_code",
            "college_name",
            "institution_type",
            "coalesce(branch_id, _raw_branch) AS branch_id",
            "coalesce(branch_code, 'UNKNOWN') AS branch_code",
            "coalesce(branch_name, 'UNKNOWN') AS branch_name",
            "coalesce(program_type, 'ENGINEERING') AS program_type",
            "category_code AS category",
            "round_code",
            "round_number",
            "is_general_round",
            "source_version_id",
            "status",
        )
    )
    if program_type is not None:
        panel = panel.filter(F.col("program_type") == program_type)
    if branch_id is not None:
        panel = panel.filter(F.col("branch_id") == branch_id)
    return panel


@dataclass(frozen=True)
class WidePanel:
    """One row per combo, one column per calendar slot. Ranks are named as SQL text."""

    frame: DataFrame
    calendar: RoundCalendar

    def rank(self, year: int, round_code: str | None) -> str:
        """Closing rank of a slot, NULL where the calendar has no such slot."""
        if (year, round_code) not in self.calendar.slots:
            return NO_RANK
        return slot_name(year, round_code)

    def final_rank(self, year: int) -> str:
        """Closing rank of the final state: the nominal round, else its fallback; 0 counts as missing."""
        options = [nonzero(self.rank(year, r)) for r in self.calendar.terminal.get(year, [])]
        return f"coalesce({', '.join(options)})" if options else NO_RANK

    def scope_rank(self, year: int, scope: str) -> str:
        """Closing rank a round scope means in one year."""
        if scope in TERMINAL_SCOPES:
            return self.final_rank(year)
        if scope == STRICT_SCOPE:
            return self.rank(year, self.calendar.final_round(year))
        if scope not in self.calendar.held.get(year, []):
            return NO_RANK
        return self.rank(year, scope)

    def where(self, program_type: str | None = None, category: str | None = None) -> WidePanel:
        frame = self.frame
        if program_type is not None:
            frame = frame.filter(F.col("program_type") == program_type)
        if category is not None:
            frame = frame.filter(F.col("category") == category)
        return WidePanel(frame, self.calendar)

    def long(self, columns: Sequence[str], rows: Sequence[Mapping[str, str]]) -> DataFrame:
        """Several rows out of each combo."""
        return self.frame.selectExpr(*columns, inline(rows))


def slot_name(year: int, round_code: str) -> str:
    return f"r{year}_{round_code}"


def wide_panel(panel: DataFrame, calendar: RoundCalendar) -> WidePanel:
    """Fold the panel to one row per combo.

    Where several rows fall in one slot (an alias beside its canonical branch),
    the greatest closing rank is kept. ``max`` of whole numbers combines on the
    map side, so a combo with very many rows costs one row per map task.
    """
    places = list(enumerate(calendar.slots))
    place = case(
        *[
            (
                f"academic_year = {year}",
                case(*[(f"round_code = {text(code)}", str(i)) for i, (y, code) in places if y == year]),
            )
            for year in sorted({y for y, _ in calendar.slots})
        ]
    )
    # the place is worked out once per row; each slot then compares one number
    slots = [
        F.expr(f"max(CASE WHEN _place = {i} THEN closing_rank END) AS {slot_name(year, code)}")
        for i, (year, code) in places
    ]
    rows = panel.selectExpr(*COMBO, "closing_rank", f"{place} AS _place")
    return WidePanel(rows.groupBy(*COMBO).agg(*slots), calendar)


def terminal_states(wide: WidePanel) -> DataFrame:
    """Long rows (combo, year, final rank, round it came from)."""
    cal = wide.calendar
    states = [
        {
            "academic_year": str(year),
            "closing_rank": wide.final_rank(year),
            "round_code": case(
                *[(f"{nonzero(wide.rank(year, c))} IS NOT NULL", text(c)) for c in cal.terminal.get(year, [])]
            ),
        }
        for year in cal.years
    ]
    return wide.long(COMBO, states).filter("closing_rank IS NOT NULL")
