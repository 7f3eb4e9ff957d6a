"""Table grids of published documents, turned into rows.

A grid row holds the header and the cells of one table line. Which column
means what follows from the header, so wide tables are unfolded by position
and every cell finds its own heading.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import text as tx
from cutline.functions.sql import once

# Fixed values
CUTOFF_HEADINGS = ["cutoff", "cut-off", "cut off"]
CATEGORY_HEADINGS = ["gm", "kkr", "hkr", "general"]
VACANCY_WORDS = ["vacant", "vacancy"]


def _some(array: str, words: list[str]) -> str:
    tests = " OR ".join(f"contains(h, '{w}')" for w in words)
    return f"exists({array}, h -> {tests})"


def cutoff_rows(grids: DataFrame) -> DataFrame:
    """Closing ranks from grids in any of three layouts.

    VERTICAL: four columns, one rank per line, category GM. CATEGORIES: one
    column per category. WIDE: one column per branch (heading ``CODE-Name``),
    category in the third column. ``grids`` also has round_code.
    """
    # white space matters to the headings of cutoffs alone: no other word that is looked for holds a space
    lowered = F.transform(F.coalesce("header", F.expr("array()")), lambda h: F.lower(F.coalesce(h, F.lit(""))))
    cleaned = r"regexp_replace(h, r'(?U)\s+', ' ')"
    cutoff = f"exists(transform(slice(_h, 3, 2), h -> {cleaned}), h -> " + " OR ".join(
        f"contains(h, '{w}')" for w in CUTOFF_HEADINGS
    ) + ")"
    layout = (
        f"CASE WHEN size(_h) = 4 AND {_some('slice(_h, 2, 2)', ['course', 'branch'])} AND {cutoff} THEN 'VERTICAL' "
        f"WHEN size(_h) >= 4 AND {_some('slice(_h, 2, 2)', ['course'])} "
        f"AND {_some('slice(_h, 4, size(_h))', CATEGORY_HEADINGS)} THEN 'CATEGORIES' ELSE 'WIDE' END"
    )
    # what belongs to the line is worked out before its cells are unfolded
    lines = once(once(grids, {"_h": lowered}), {"layout": layout}).filter(
        "size(cells) >= CASE WHEN layout = 'WIDE' THEN 3 ELSE 4 END AND nullif(get(cells, 0), '') IS NOT NULL"
    )
    own = tx.category_code(F.expr("coalesce(nullif(get(cells, 2), ''), 'GM')"))
    lines = once(
        lines,
        {
            "college_code": tx.college_code(F.expr("get(cells, 0)")),
            "college_name": tx.college_name(F.expr("coalesce(get(cells, 1), '')")),
            "_own": F.when(F.col("layout") == "WIDE", own),
        },
    ).filter("college_code <> ''")
    # arrays of the line are put beside each other, so that a cell does not carry them along
    cells = (
        lines.select(
            "doc_id", "page", "row_no", "layout", "academic_year", "round_code", "college_code", "college_name", "_own",
            F.expr("get(cells, 2) AS _course"),
            F.posexplode(F.arrays_zip(
                F.expr("slice(cells, 4, size(cells))").alias("cell"),
                F.expr("slice(coalesce(header, array()), 4, size(_h))").alias("head"),
                F.expr("slice(_h, 4, size(_h))").alias("low"),
            )).alias("_i", "_at"),
        )
        .selectExpr("*", "_at.cell AS _cell", "_at.low AS _heading", "CASE WHEN layout = 'WIDE' THEN _at.head ELSE _course END AS _branch")
        .filter("nullif(_cell, '') IS NOT NULL AND (layout <> 'VERTICAL' OR _i = 0)")
        .filter("nullif(_branch, '') IS NOT NULL AND (layout <> 'WIDE' OR contains(_branch, '-'))")
    )
    by_heading = F.expr(
        "CASE WHEN contains(_heading, 'gm') OR contains(_heading, 'general') THEN 'GM' "
        "WHEN contains(_heading, 'kkr') OR contains(_heading, 'hkr') THEN 'KKR' END"
    )
    category = (
        F.when(F.col("layout") == "VERTICAL", "GM").when(F.col("layout") == "CATEGORIES", by_heading)
        .otherwise(F.col("_own"))
    )
    ranked = once(cells, {"closing_rank": tx.digits_int(F.col("_cell")), "category_code": category}).filter(
        "category_code IS NOT NULL AND closing_rank > 0"
    )
    code, name = tx.course_parts(F.col("_clean"))
    rows = once(
        once(ranked, {"_clean": tx.clean_text(F.col("_branch"))}), {"_course_code": code, "_course_name": name}
    ).filter("_course_code <> ''")
    return rows.selectExpr(
        "doc_id", "layout", "college_code", "college_name", "category_code",
        "_course_code AS branch_code", "_course_name AS branch_name", "academic_year", "round_code",
        "CAST(NULL AS INT) AS opening_rank", "closing_rank", "page AS page_number",
        "concat('p', page, '_r', row_no, '_', college_code, '_', category_code, '_', _course_code) AS row_identifier",
    )


def seat_and_fee_rows(grids: DataFrame) -> DataFrame:
    """Each usable grid line with its seat values, fee values and error, if any.

    ``seat_rows``, ``fee_rows`` and ``malformed_rows`` take them apart. ``grids``
    also has counselling_round.
    """
    lowered = F.transform("header", lambda h: F.lower(tx.clean_text(h)))
    named = F.concat_ws(" ", F.lower("document_type"), F.lower("title"), F.array_join("_h", " "))
    rows = (
        grids.withColumn("_h", lowered)
        .withColumn("_vacancy_named", tx.has_any(named, VACANCY_WORDS))
        .withColumn("_raw", F.expr("get(cells, 0)"))
        .filter(
            "size(cells) >= 4 AND nullif(_raw, '') IS NOT NULL AND nullif(get(cells, 2), '') IS NOT NULL "
            "AND NOT contains(lower(_raw), 'college') AND NOT contains(lower(_raw), 'code')"
        )
        .withColumns(
            {
                "college_code": tx.college_code(F.col("_raw")),
                "college_name": tx.college_name(F.expr("coalesce(get(cells, 1), '')")),
                "_course": tx.split_course(F.expr("get(cells, 2)")),
                "_vacancy": F.expr(
                    "_vacancy_named OR (size(cells) < 7 AND NOT exists(_h, h -> contains(h, 'fee')))"
                ),
                **{f"_n{i}": tx.digits_int(F.expr(f"get(cells, {i})")).cast("int") for i in (3, 4, 5)},
                **{f"_d{i}": tx.amount(F.expr(f"get(cells, {i})")) for i in (6, 7, 8)},
            }
        )
        .filter("college_code <> '' AND _course.code <> ''")
    )
    six = "(size(cells) >= 6 AND size(_h) >= 6 AND contains(get(_h, 4), 'gm') AND contains(get(_h, 5), 'kkr'))"
    five = "size(cells) = 5"
    total_gm = "(size(_h) >= 5 AND contains(get(_h, 3), 'total') AND contains(get(_h, 4), 'gm'))"
    heading = "coalesce(get(_h, 3), '')"
    one_kkr, one_gm = f"contains({heading}, 'kkr')", f"contains({heading}, 'gm')"

    def vacancy(six_col: str, total_and_gm: str, gm_and_kkr: str, kkr: str, gm: str, other: str) -> str:
        return (
            f"CASE WHEN {six} THEN {six_col} WHEN {five} AND {total_gm} THEN {total_and_gm} "
            f"WHEN {five} THEN {gm_and_kkr} WHEN {one_kkr} THEN {kkr} WHEN {one_gm} THEN {gm} ELSE {other} END"
        )

    split = "coalesce({a}, 0) + coalesce({b}, 0)"
    vacant = vacancy(
        f"coalesce(_n3, {split.format(a='_n4', b='_n5')})", "_n3", split.format(a="_n3", b="_n4"), "_n3", "_n3", "_n3"
    )
    gm = vacancy("_n4", "_n4", "_n3", "NULL", "_n3", "NULL")
    kkr = vacancy("_n5", "NULL", "_n4", "_n3", "NULL", "NULL")
    category = vacancy("NULL", "NULL", "NULL", "'KKR'", "'GM'", "NULL")
    total_fee = "CASE WHEN size(cells) > 8 THEN _d8 ELSE _d6 END"
    zero = "CAST(0 AS DECIMAL(12,2))"
    return rows.selectExpr(
        "doc_id", "college_code", "college_name", "_course.code AS branch_code", "_course.name AS branch_name",
        "academic_year", "counselling_round", "page AS page_number",
        "concat_ws('_', college_code, _course.code, page, row_no) AS row_identifier",
        "CASE WHEN NOT _vacancy THEN _n3 END AS total_seats",
        f"CASE WHEN _vacancy THEN {vacant} END AS vacant_seats",
        f"CASE WHEN _vacancy THEN {gm} ELSE _n4 END AS gm_seats",
        f"CASE WHEN _vacancy THEN {kkr} ELSE _n5 END AS kkr_seats",
        f"CASE WHEN _vacancy THEN {category} END AS category_code",
        f"NOT _vacancy AND ({total_fee} IS NOT NULL OR _d6 IS NOT NULL) AS has_fee",
        f"coalesce(nullif({total_fee}, {zero}), _d6, {zero}) AS total_fee",
        "_d6 AS tuition_fee",
        "_d7 AS other_fee",
        "'INR' AS currency",
        "_vacancy AS is_vacancy",
    )


SEAT_COLUMNS = [
    "doc_id", "college_code", "college_name", "branch_code", "branch_name", "academic_year", "counselling_round",
    "total_seats", "vacant_seats", "gm_seats", "kkr_seats", "category_code", "page_number", "row_identifier",
]
FEE_COLUMNS = [
    "doc_id", "college_code", "branch_code", "academic_year", "total_fee", "tuition_fee", "other_fee", "currency",
    "page_number", "row_identifier",
]


def seat_rows(lines: DataFrame) -> DataFrame:
    return lines.filter("coalesce(total_seats, vacant_seats) IS NOT NULL").select(*SEAT_COLUMNS)


def fee_rows(lines: DataFrame) -> DataFrame:
    return lines.filter("has_fee").select(*FEE_COLUMNS)


def malformed_rows(lines: DataFrame) -> DataFrame:
    """Vacancy lines without a readable number."""
    return lines.filter("is_vacancy AND vacant_seats IS NULL").selectExpr(
        "doc_id", "row_identifier", "concat('Malformed vacancy row ', row_identifier) AS error"
    )


def document_states(documents: DataFrame, rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Documents (doc_id) with their row counts: PARSED, or NEEDS_REVIEW without rows or with errors."""
    have = rows.groupBy("doc_id").agg(F.expr("count(1) AS _rows"))
    out = documents.join(have, "doc_id", "left")
    if errors is None:
        out = out.withColumn("_errors", F.lit(0).cast("long"))
    else:
        out = out.join(errors.groupBy("doc_id").agg(F.expr("count(1) AS _errors")), "doc_id", "left")
    return out.selectExpr(
        *documents.columns,
        "coalesce(_rows, 0L) AS row_count",
        "coalesce(_errors, 0L) AS error_count",
        "CASE WHEN coalesce(_errors, 0L) = 0 AND coalesce(_rows, 0L) > 0 THEN 'PARSED' ELSE 'NEEDS_REVIEW' END AS status",
    )


def discovered_colleges(rows: DataFrame) -> DataFrame:
    """First name seen of each college code."""
    named = rows.filter("college_name <> ''")
    return named.groupBy("college_code").agg(
        F.expr("min_by(college_name, struct(doc_id, page_number, row_identifier)) AS college_name")
    )


def discovered_branches(rows: DataFrame) -> DataFrame:
    """First name seen of each branch code."""
    return rows.groupBy("branch_code").agg(
        F.expr("min_by(branch_name, struct(doc_id, page_number, row_identifier)) AS branch_name")
    )


# parser registry ------------------------------------------------------------------

Parser = Callable[[DataFrame], DataFrame]

PARSERS: dict[str, Parser] = {
    "CUTOFF_PDF": cutoff_rows,
    "SEAT_MATRIX_PDF": seat_and_fee_rows,
    "VACANT_SEATS_PDF": seat_and_fee_rows,
    "FEE_STRUCTURE_PDF": seat_and_fee_rows,
}


# fixed values: the reason such documents are reviewed for, and the one type that is read without a parser of rows
UNSUPPORTED = "UNKNOWN_DOCUMENT_TYPE"
PORTAL_PAGE = "COUNSELLING_PORTAL_HTML"


def parse(grids: DataFrame, document_type: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Rows of the grids of one document type, by the parser registered for it."""
    table = PARSERS if parsers is None else parsers
    if document_type not in table:
        raise KeyError(f"no parser for {document_type}")
    return grids.filter(F.col("document_type") == document_type).transform(table[document_type])


def without_parser(documents: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Documents of a type nobody can parse; they go to review."""
    known = [*(PARSERS if parsers is None else parsers), PORTAL_PAGE]
    kind: Column = F.col("document_type")
    return documents.filter(kind.isNull() | ~kind.isin(known)).withColumn("failure_reason", F.lit(UNSUPPORTED))
