"""A small hand-made panel: full history, one year only, gaps, fallbacks, an alias, cold starts."""

from cutline import schemas
from cutline.plans.calendar import ADMISSIONS
from cutline.plans.panel import canonical_panel, wide_panel

COLLEGES = [
    ("c1", "E001", "First College", "FIRST", "Bengaluru", None, "ENGINEERING"),
    ("c2", "E002", "Second College", "SECOND", "Mysuru", None, "ENGINEERING"),
    ("c3", "A003", "Third College", "THIRD", "Hubballi", None, "ARCHITECTURE"),
]
BRANCHES = [
    ("cs", "CS", "Computer Science", "CS", "ENGINEERING", True, None),
    ("ec", "EC", "Electronics", "EC", "ENGINEERING", True, None),
    ("ecs", "ECS", "Electronics Old", "ECS", "ENGINEERING", False, "ec"),
    ("at", "AT", "Architecture", "AT", "ARCHITECTURE", True, None),
]
# college, branch, category, round, year, opening, closing, status
FACTS = [
    ("c1", "cs", "GM", "R1", 2023, 10, 1000, "PUBLISHED"),
    ("c1", "cs", "GM", "R2_PHASE2", 2023, 10, 1200, "PUBLISHED"),
    ("c1", "cs", "GM", "R3", 2023, 10, 1500, "PUBLISHED"),
    ("c1", "cs", "GM", "CONSOLIDATED_FINAL", 2023, 10, 1600, "PUBLISHED"),
    ("c1", "cs", "GM", "R1", 2024, 10, 1100, "PUBLISHED"),
    ("c1", "cs", "GM", "R3", 2024, 10, 1700, "PUBLISHED"),
    ("c1", "cs", "GM", "R4", 2025, 10, 1800, "PUBLISHED"),
    ("c1", "cs", "GM", "R1", 2026, 10, 1300, "PUBLISHED"),
    ("c1", "cs", "GM", "R3", 2026, 10, 2000, "PUBLISHED"),
    ("c1", "cs", "GM", "R4", 2026, 10, 1900, "PUBLISHED"),
    ("c1", "cs", "GM", "R1", 2026, 10, 9999, "SUPERSEDED"),
    ("c1", "cs", "KKR", "KKR_SPECIAL", 2026, 10, 4000, "PUBLISHED"),
    ("c2", "ec", "GM", "R1", 2023, 10, 5000, "PUBLISHED"),
    ("c2", "ecs", "GM", "R1", 2023, 10, 5500, "PUBLISHED"),
    ("c2", "ecs", "GM", "R1", 2024, 10, 5000, "PUBLISHED"),
    ("c2", "ec", "GM", "R3", 2023, 10, 6000, "PUBLISHED"),
    ("c2", "ec", "GM", "R3", 2026, 10, 30000, "PUBLISHED"),
    ("c1", "ec", "GM", "R1", 2026, 700, 600, "PUBLISHED"),
    ("c3", "at", "GM", "R1", 2024, 10, 50, "PUBLISHED"),
    ("c3", "at", "GM", "R1", 2026, 10, 60, "PUBLISHED"),
]


def build(table):
    facts = [
        (f"f{i:02d}", None if i == 11 else "v1", c, b, cat, r, y, o, k, None, None, s)
        for i, (c, b, cat, r, y, o, k, s) in enumerate(FACTS)
    ]
    cutoffs = table(schemas.CUTOFFS, facts)
    colleges = table(schemas.COLLEGES, COLLEGES)
    branches = table(schemas.BRANCHES, BRANCHES)
    rounds = ADMISSIONS.rounds_frame(cutoffs.sparkSession)
    # 2025 holds R4 only, but its rounds are seeded
    panel = canonical_panel(cutoffs, colleges, branches, rounds, status=None)
    published = panel.filter("status = 'PUBLISHED'")
    return {
        "cutoffs": cutoffs, "colleges": colleges, "branches": branches, "rounds": rounds,
        "all": panel, "panel": published, "wide": wide_panel(published, ADMISSIONS),
    }
