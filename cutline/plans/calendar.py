"""The round calendar: which rounds a year has, which one is final, which follow one another.

A calendar is configuration, a few dozen rows. Every operator takes one as an
argument, so other years and other sets of rounds need no new code.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECT, PARTIAL, NONE = "DIRECT", "PARTIAL", "NONE"
TERMINAL_SCOPES = ("TERMINAL", "TERMINAL_ALLOTMENT")
STRICT_SCOPE = "STRICT_TERMINAL"


@dataclass(frozen=True)
class RoundCalendar:
    """Rounds by year.

    ``seeded``: year -> [(code, name, number, is_general)], the rounds that exist as a dimension.
    ``held``: year -> codes of the rounds with published data.
    ``terminal``: year -> codes that can stand for the final state, best first.
    ``progressions``: year -> [(from, to)].
    ``same_role``: code -> (years in which it played one role, status outside those years).
    """

    seeded: dict[int, list[tuple[str, str, int, bool]]]
    held: dict[int, list[str]]
    terminal: dict[int, list[str]]
    progressions: dict[int, list[tuple[str, str]]]
    same_role: dict[str, tuple[frozenset[int], str]]
    always_direct: frozenset[str] = frozenset({"R1", "MOCK"})
    always_partial: frozenset[str] = frozenset({"R4"})
    special: frozenset[str] = frozenset({"KKR_SPECIAL"})
    recency: dict[str, tuple[int, int]] = field(default_factory=dict)

    @cached_property
    def years(self) -> list[int]:
        return sorted(self.held)

    @cached_property
    def slots(self) -> list[tuple[int, str]]:
        """Every (year, round) that can hold a value, in time order."""
        numbers = {(y, r[0]): r[2] for y, rs in self.seeded.items() for r in rs}
        found = {(y, r[0]) for y, rs in self.seeded.items() for r in rs}
        found |= {(y, r) for y, rs in self.held.items() for r in rs}
        return sorted(found, key=lambda s: (s[0], numbers.get(s, 0), s[1]))

    def final_round(self, year: int) -> str | None:
        return (self.terminal.get(year) or [None])[0]

    def round_in_scope(self, year: int, scope: str) -> str | None:
        """The one round that a strict scope means in a year."""
        if scope in TERMINAL_SCOPES or scope == STRICT_SCOPE:
            return self.final_round(year)
        return scope

    def rounds_frame(self, spark: SparkSession) -> DataFrame:
        """Seeded rounds as rows. VALUES keeps it a local relation, whose size the optimizer knows."""
        rows = [
            f"({y}, '{c}', '{n}', {num}, {str(g).lower()}, {str(c == self.final_round(y)).lower()}, "
            f"{self.terminal[y].index(c) + 1 if c in self.terminal.get(y, []) else 'CAST(NULL AS INT)'})"
            for y in sorted(self.seeded)
            for c, n, num, g in self.seeded[y]
        ]
        return spark.sql(
            f"SELECT * FROM VALUES {', '.join(rows)} AS r(academic_year, round_code, round_name, "
            "round_number, is_general_round, is_terminal, fallback_rank)"
        )

    def progressions_frame(self, spark: SparkSession) -> DataFrame:
        rows = [f"({y}, '{a}', '{b}')" for y in sorted(self.progressions) for a, b in self.progressions[y]]
        return spark.sql(
            f"SELECT * FROM VALUES {', '.join(rows)} AS p(academic_year, from_round, to_round)"
        )

    def is_terminal(self, year: Column, code: Column) -> Column:
        known = [year.eqNullSafe(F.lit(y)) & code.eqNullSafe(F.lit(self.final_round(y))) for y in self.terminal]
        out = F.lit(False)
        for test in known:
            out = out | test
        return out

    def comparability(self, year1: Column, round1: Column, year2: Column, round2: Column) -> Column:
        """How far two published rounds may be compared; the order of the rules matters."""
        same = round1 == round2
        special1, special2 = round1.isin(*self.special), round2.isin(*self.special)
        out = F.when(special1 & special2 & same, DIRECT).when(special1 | special2, NONE)
        out = out.when(self.is_terminal(year1, round1) & self.is_terminal(year2, round2), PARTIAL)
        out = out.when(same & round1.isin(*self.always_direct), DIRECT)
        for code, (years, outside) in self.same_role.items():
            alike = year1.isin(*sorted(years)) & year2.isin(*sorted(years))
            out = out.when(same & (round1 == code), F.when(alike, DIRECT).otherwise(outside))
        return out.when(same & round1.isin(*self.always_partial), PARTIAL).otherwise(NONE)

    def compare(self, year1: int, round1: str | None, year2: int, round2: str | None) -> str:
        """The same rules for one pair known before the plan is built."""
        if not round1 or not round2:
            return NONE
        if {round1, round2} & self.special:
            return DIRECT if round1 == round2 else NONE
        if self.final_round(year1) == round1 and self.final_round(year2) == round2:
            return PARTIAL
        if round1 != round2:
            return NONE
        if round1 in self.always_direct:
            return DIRECT
        if round1 in self.same_role:
            years, outside = self.same_role[round1]
            return DIRECT if {year1, year2} <= years else outside
        return PARTIAL if round1 in self.always_partial else NONE


# ---------------------------------------------------------------------------
# The published admission calendar, 2023-2026
# ---------------------------------------------------------------------------

_MOCK = ("MOCK", "Mock Round", 0, True)
_R1 = ("R1", "Round 1", 1, True)
_KKR_PHASE_1 = ("KKR_SPECIAL", "Round 2 Phase 1 KKR Special Allotment", 2, False)
_KKR = ("KKR_SPECIAL", "Round 2 KKR Special Allotment", 2, False)
_PHASE_2 = ("R2_PHASE2", "Round 2 Phase 2", 2, True)
_R3 = ("R3", "Round 3", 3, True)
_R4 = ("R4", "Round 4", 4, True)
_FINAL = ("CONSOLIDATED_FINAL", "Consolidated Cutoff After All Rounds", 99, True)

ADMISSIONS = RoundCalendar(
    seeded={
        2023: [_MOCK, _R1, _KKR_PHASE_1, _PHASE_2, _R3, _FINAL],
        2024: [_MOCK, _R1, _KKR_PHASE_1, _PHASE_2, _R3],
        2025: [_MOCK, _R1, _KKR, _R3, _R4],
        2026: [_MOCK, _R1, _KKR, _R3, _R4],
    },
    held={
        2023: ["MOCK", "R1", "KKR_SPECIAL", "R2_PHASE2", "R3", "CONSOLIDATED_FINAL"],
        2024: ["MOCK", "R1", "KKR_SPECIAL", "R2_PHASE2", "R3"],
        2025: ["R4"],
        2026: ["MOCK", "R1", "KKR_SPECIAL", "R3", "R4"],
    },
    terminal={
        2023: ["CONSOLIDATED_FINAL", "R3"],
        2024: ["R3"],
        2025: ["R4"],
        2026: ["R4", "R3"],
    },
    progressions={
        2023: [("R1", "R2_PHASE2"), ("R2_PHASE2", "R3"), ("R3", "CONSOLIDATED_FINAL")],
        2024: [("R1", "R2_PHASE2"), ("R2_PHASE2", "R3")],
        2025: [],
        2026: [("R1", "R3"), ("R3", "R4")],
    },
    same_role={
        "R2_PHASE2": (frozenset({2023, 2024}), NONE),
        "R3": (frozenset({2023, 2024}), PARTIAL),
    },
    recency={"R1": (2024, 2023), "TERMINAL": (2025, 2023)},
)
