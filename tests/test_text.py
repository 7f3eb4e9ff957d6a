import datetime

import pytest
from pyspark.sql import functions as F

from cutline.functions import text as tx

CASES = [
    (tx.college_code, " e001 ", "E001"),
    (tx.college_code, "E157.", "E157"),
    (tx.college_code, "E-205", "E205"),
    (tx.college_code, "College Code", ""),
    (tx.clean_text, " a \n b\t", "a b"),
    (tx.clean_text, None, ""),
    (tx.college_name, "B.M.S. COLLEGE OF ENGINEERING", "B.M.S. College of Engineering"),
    (tx.college_name, "r.v. college of engineering", "R.V. College of Engineering"),
    (tx.college_name, "the oxford college", "The Oxford College"),
    (tx.college_name, "", ""),
    (tx.location, "BENGALURU  rural", "Bengaluru Rural"),
    (tx.location, None, None),
    (tx.branch_code, " cs ", "CS"),
    (tx.branch_code, "AIF-", "AIF"),
    (tx.branch_name, "Electronics & Communicat- ion Engineering", "Electronics & Communication Engineering"),
    (tx.branch_name, "Foo- Bar&Baz", "Foo-Bar & Baz"),
    (tx.category_code, " general ", "GM"),
    (tx.category_code, "gm", "GM"),
    (tx.category_code, "kkr", "KKR"),
    (tx.document_type, "Engineering Cut-Off Ranks after Round 1", "CUTOFF_PDF"),
    (tx.document_type, "Engineering Vacant Seats after Round 2", "VACANT_SEATS_PDF"),
    (tx.document_type, "Seat Matrix and Availability", "SEAT_MATRIX_PDF"),
    (tx.document_type, "Fee Structure", "FEE_STRUCTURE_PDF"),
    (tx.document_type, "Counselling Process Guideline", "NOTIFICATION_PDF"),
    (tx.document_type, "nothing here", "UNKNOWN"),
    (tx.document_round, "2023-Engineering-After-All-Rounds-27_05_2024", "CONSOLIDATED_FINAL"),
    (tx.document_round, "2025-Engineering-After-All-Rounds-07.07.2026", "R4"),
    (tx.document_round, "Round_3 cutoff", "R3"),
    (tx.document_round, "ground 1", None),
    (tx.document_round, "Round 2", "KKR_SPECIAL"),
    (tx.document_round, "kkr special r1", "KKR_SPECIAL"),
    (tx.document_program, "B.Arch list", "ARCHITECTURE"),
    (tx.publication_date, "x Notified on 3.7.26 y", datetime.date(2026, 7, 3)),
    (tx.publication_date, "Notified_on_31-02-2026", None),
    (tx.publication_date, "no date", None),
    (tx.link_type, "seat and fee", "SEAT_MATRIX_PDF"),
    (tx.digits_int, "1,420", 1420),
    (tx.digits_int, "--", None),
    (tx.sha256_hex, "abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"),
    (tx.is_web_address, "https://a.b/c", True),
    (tx.is_web_address, "ftp://a.b/c", False),
    (tx.is_web_address, "nonsense", False),
]


@pytest.mark.parametrize("rule, given, expected", CASES)
def test_rule(one, rule, given, expected):
    assert one(rule(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize(
    "given, code, number",
    [("Round 1", "R1", 1), ("Mock Allotment", "MOCK", 0), ("ROUND 2 PHASE 1", "KKR_SPECIAL", 2),
     ("ROUND 2 PHASE 2", "R2_PHASE2", 2), ("CONSOLIDATED_FINAL", "CONSOLIDATED_FINAL", 99), ("R2", "KKR_SPECIAL", 2),
     ("spot!", "SPOT", 99), ("", "UNKNOWN", 99)],
)
def test_round(one, given, code, number):
    found = one(tx.round_of(F.lit(given)))
    assert (found.code, found.number) == (code, number)


def test_year_needs_its_own_word(one):
    assert one(tx.document_year(F.lit("list_2024 of 2023"), 2026)) == 2023
    assert one(tx.document_year(F.lit("list_2024"), 2026)) == 2026


def test_split_course(one):
    assert tuple(one(tx.split_course(F.lit("AE-Aero- Nautical")))) == ("AE", "Aero-Nautical")
    assert tuple(one(tx.split_course(F.lit("Mechanical")))) == ("MECH", "Mechanical")


def test_amount(one):
    assert float(one(tx.amount(F.lit("Rs 1,234.50")))) == 1234.5
    assert one(tx.amount(F.lit("1.2.3"))) is None
