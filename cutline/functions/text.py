"""Text rules as Column expressions: cleaning, normal forms, and document classification.

Everything here is built from built-in functions, so it runs inside the scan's
own stage. Word boundaries are spelled out with letter and digit classes: the
shorthand ``\\b`` means different things to different regex engines once text
is not ASCII.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

HEADER_WORDS = ["COLLEGECODE", "COLLEGE", "CODE", "SLNO", "INSTITUTE"]

ACRONYMS = [
    "RV", "R.V.", "BMS", "B.M.S.", "PES", "P.E.S.", "MSRIT", "MS", "M.S.",
    "BVB", "BVBCET", "KLE", "K.L.E.", "JSS", "J.S.S.", "BIT", "B.I.T.",
    "BMSIT", "BNMIT", "NIE", "N.I.E.", "NMIT", "NMAMIT", "SMVIT", "S.M.V.I.T.",
    "SJCE", "S.J.C.E.", "SDM", "S.D.M.", "BLDEA", "BLDE", "AIT", "A.I.T.",
    "ACS", "AMC", "MVJ", "ATRIA", "CMR", "CMRIT", "DSCE", "DSATM", "KSIT",
    "KSSEM", "RNSIT", "RNS", "SCT", "TJS", "HKES", "PDA", "AIET", "AJIET",
    "SCEM", "CEC", "SCE", "GSSSIETW", "EWIT", "SVCE", "SKIT", "DBIT",
    "RRCE", "RRIT", "SAMBHRAM", "SEA", "SJCIT", "BGS", "BGSIT", "CIT", "C.I.T.",
    "GMIT", "UBDT", "BIET", "STJIT", "RYMEC", "VDRIT", "KLS", "GIT", "SGBIT",
    "AGMR", "SEC", "VCET", "YIT", "MIT", "MITE", "PESITM", "JNNCE", "KVG",
    "IIIT", "IIT", "NIT", "AI", "ML", "CSE", "ECE", "EEE", "ISE", "IOT",
    "VLSI", "AR", "VR", "IT",
]

SMALL_WORDS = ["of", "and", "&", "in", "for", "at", "the", "on", "to"]

GENERAL_CATEGORY_WORDS = ["GENERAL", "GEN", "OPEN", "GM"]

CUTOFF_WORDS = ["cut-off", "cutoff", "cut_off", "cut off"]

LINK_WORDS = CUTOFF_WORDS + ["seat", "fee", "notification", "counselling"]

NOTICE_WORDS = [
    "notification", "guideline", "process", "instruction", "procedure",
    "brochure", "information bulletin",
]

ARCHITECTURE_WORDS = ["architecture", "b.arch", "barch", "b arch", "nata"]

# (code, display name, number, spellings); the first row with a spelling in the text wins
ROUND_NAMES = [
    ("MOCK", "Mock Round", 0, ["MOCK"]),
    ("R1", "Round 1", 1, ["ROUND 1", "ROUND-1", "R1", "ROUND_1"]),
    ("KKR_SPECIAL", "Round 2 Phase 1 KKR Special Allotment", 2, ["PHASE 1", "PHASE1"]),
    ("R2_PHASE2", "Round 2 Phase 2", 2, ["PHASE 2", "PHASE2"]),
    ("KKR_SPECIAL", "Round 2 KKR Special Allotment", 2,
     ["KKR", "ROUND 2", "ROUND-2", "R2", "ROUND_2"]),
    ("CONSOLIDATED_FINAL", "Consolidated Cutoff After All Rounds", 99,
     ["CONSOLIDATED", "AFTER ALL ROUNDS"]),
    ("R3", "Round 3", 3, ["ROUND 3", "ROUND-3", "R3", "ROUND_3"]),
    ("R4", "Round 4", 4, ["ROUND 4", "ROUND-4", "R4", "ROUND_4"]),
]

PUBLISHED_ON = r"(?i)Notified[_\s]+(?:on[_\s]+)?(\d{1,2})[._/-](\d{1,2})[._/-](\d{2,4})"

NOT_WORD = r"[^\p{L}\p{N}_]"

# ---------------------------------------------------------------------------


def has_any(text: Column, words: Sequence[str]) -> Column:
    """True if the text contains one of the words, as plain substrings."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def _whole_word(body: str) -> str:
    return f"(?:^|{NOT_WORD})(?:{body})(?:{NOT_WORD}|$)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column) -> Column:
    """Any run of (Unicode) whitespace becomes one space; trimmed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def code_only(text: Column) -> Column:
    """Upper case, with only A-Z and 0-9 left."""
    return F.regexp_replace(F.upper(clean_text(text)), "[^A-Z0-9]", "")


def college_code(text: Column) -> Column:
    """Normal form of a college code; words of a repeated header row become ''."""
    return _let(code_only(text), lambda code: F.when(code.isin(HEADER_WORDS), F.lit("")).otherwise(code))


def branch_code(text: Column) -> Column:
    return code_only(text)


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(_rest(word)))


def _rest(word: Column) -> Column:
    return F.substring(word, F.lit(2), F.greatest(F.length(word), F.lit(1)))


def college_name(text: Column) -> Column:
    """Word-by-word casing: acronyms stay upper, small words lower, the rest capitalised."""
    def cased(word: Column) -> Column:
        bare = F.upper(F.regexp_replace(word, "[^A-Za-z0-9.]", ""))
        acronym = bare.isin(ACRONYMS) | F.replace(bare, F.lit("."), F.lit("")).isin(ACRONYMS)
        return (
            F.when(acronym, F.upper(word))
            .when(F.lower(word).isin(SMALL_WORDS), F.lower(word))
            .otherwise(_capital(word))
        )

    name = F.array_join(F.transform(F.split(clean_text(text), " "), cased), " ")
    return _let(name, lambda n: F.concat(F.upper(F.substring(n, 1, 1)), _rest(n)))


def location(text: Column) -> Column:
    """Each word capitalised; NULL if nothing is left."""
    words = F.transform(F.split(clean_text(text), " "), _capital)
    joined = F.array_join(words, " ")
    return F.when(joined != "", joined)


def branch_name(text: Column) -> Column:
    """Join words split by a line-break hyphen, keep real hyphens, space out '&'."""
    name = clean_text(text)
    name = F.regexp_replace(name, r"([A-Za-z]+)-\s+([a-z]+)", "$1$2")
    name = F.regexp_replace(name, r"([A-Za-z]+)-\s+([A-Z][a-z]+)", "$1-$2")
    name = F.regexp_replace(name, r"\s*&\s*", " & ")
    return clean_text(name)


def category_code(text: Column) -> Column:
    return _let(
        F.upper(clean_text(text)), lambda code: F.when(code.isin(GENERAL_CATEGORY_WORDS), F.lit("GM")).otherwise(code)
    )


def round_of(text: Column) -> Column:
    """struct(code, name, number) of a round label; an unknown label keeps its letters, number 99."""
    label = F.upper(clean_text(text))

    def as_struct(code: Column, name: Column, number: int) -> Column:
        return F.struct(code.alias("code"), name.alias("name"), F.lit(number).alias("number"))

    letters = F.regexp_replace(label, "[^A-Z0-9]", "")
    out = as_struct(
        F.when(letters == "", F.lit("UNKNOWN")).otherwise(letters), F.coalesce(text, F.lit("")), 99
    )
    for code, name, number, spellings in reversed(ROUND_NAMES):
        out = F.when(has_any(label, spellings), as_struct(F.lit(code), F.lit(name), number)).otherwise(out)
    return out


def document_type(text: Column) -> Column:
    """Type of a document from its title, link text or address."""
    s = F.lower(text)
    return (
        F.when(has_any(s, CUTOFF_WORDS), "CUTOFF_PDF")
        .when(has_any(s, ["vacant", "vacancy"]), "VACANT_SEATS_PDF")
        .when(
            s.contains("seat") & has_any(s, ["matrix", "allocation", "allotment", "available"]),
            "SEAT_MATRIX_PDF",
        )
        .when(has_any(s, ["fee", "tuition"]), "FEE_STRUCTURE_PDF")
        .when(has_any(s, ["branches offered", "branch code", "courses offered"]), "BRANCHES_OFFERED_PDF")
        .when(has_any(s, NOTICE_WORDS), "NOTIFICATION_PDF")
        .when(s.contains("member-institutions"), "MEMBER_INSTITUTIONS_HTML")
        .when(s.contains("be-colleges"), "BE_COLLEGES_HTML")
        .when(s.contains("counselling-document"), "COUNSELLING_PORTAL_HTML")
        .otherwise("UNKNOWN")
    )


def link_type(text: Column) -> Column:
    """The link finder's own, coarser guess of a document type."""
    s = F.lower(text)
    return (
        F.when(has_any(s, CUTOFF_WORDS), "CUTOFF_PDF")
        .when(has_any(s, ["seat", "vacant"]), "SEAT_MATRIX_PDF")
        .when(s.contains("fee"), "FEE_STRUCTURE_PDF")
        .when(has_any(s, ["notification", "guide", "process"]), "NOTIFICATION_PDF")
        .when(has_any(s, ["branch", "course"]), "BRANCHES_OFFERED_PDF")
        .otherwise("OTHER")
    )


def document_year(text: Column, default: int) -> Column:
    """The first year 2020-2029 that stands as its own word."""
    found = F.regexp_extract(text, f"(?:^|{NOT_WORD})(202[0-9])(?:{NOT_WORD}|$)", 1)
    # most texts name no such year, and a substring test is far cheaper than the pattern
    year = F.when(text.contains("202"), F.nullif(found, F.lit("")))
    return F.coalesce(year.cast("int"), F.lit(default))


def document_round(text: Column, default_year: int = 2026) -> Column:
    """Round named by a document title. The order of the tests is not that of ``round_of``."""
    s = F.translate(F.lower(text), "_-", "  ")
    all_rounds = F.when(document_year(text, default_year) == 2025, "R4").otherwise("CONSOLIDATED_FINAL")

    def numbered(k: int) -> Column:
        return s.contains(str(k)) & s.rlike(_whole_word(rf"round\s*{k}|r\s*{k}"))

    return (
        F.when(s.contains("mock"), F.lit("MOCK"))
        .when(has_any(s, ["kkr special", "r2 kkr", "phase 1", "phase1"]), F.lit("KKR_SPECIAL"))
        .when(has_any(s, ["phase 2", "phase2"]), F.lit("R2_PHASE2"))
        .when(numbered(1), F.lit("R1"))
        .when(numbered(3), F.lit("R3"))
        .when(numbered(4), F.lit("R4"))
        .when(has_any(s, ["all rounds", "consolidated"]), all_rounds)
        .when(numbered(2) | s.contains("kkr"), F.lit("KKR_SPECIAL"))
    )


def document_program(text: Column) -> Column:
    return F.when(has_any(F.lower(text), ARCHITECTURE_WORDS), "ARCHITECTURE").otherwise("ENGINEERING")


def publication_date(text: Column) -> Column:
    """Date after "Notified on"; two-digit years are 20xx; an impossible date is NULL."""
    day, month, year = (F.regexp_extract(text, PUBLISHED_ON, i) for i in (1, 2, 3))
    full_year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    iso = F.concat_ws("-", F.lpad(full_year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "", F.try_to_date(iso, "yyyy-MM-dd"))


def digits_int(text: Column) -> Column:
    """Only the digits, as a number; NULL if there are none."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def amount(text: Column) -> Column:
    """Only digits and dots, as decimal(12,2); NULL if that is no number."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("decimal(12,2)")


def split_course(text: Column) -> Column:
    """struct(code, name) of a cell such as ``AE-Aeronautical Engineering``."""
    code, name = course_parts(clean_text(text))
    return F.struct(code.alias("code"), name.alias("name"))


def course_parts(course: Column) -> tuple[Column, Column]:
    """Code and name of a cleaned course cell."""
    dashed = course.contains("-")
    head = F.when(dashed, F.substring_index(course, "-", 1)).otherwise(F.substring(course, 1, 4))
    tail = F.when(dashed, F.regexp_replace(course, "^[^-]*-", "")).otherwise(course)
    return branch_code(head), branch_name(tail)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def is_web_address(url: Column) -> Column:
    """http or https, with a host."""
    return F.coalesce(
        F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https")
        & F.try_parse_url(url, F.lit("HOST")).isNotNull(),
        F.lit(False),
    )
