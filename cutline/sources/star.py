"""Binding of an order-and-line star schema onto the engine's tables.

It lets the engine run on any orders/lineitem data: a supplier plays the
college, a part type the branch, an order's year the academic year, its
priority the round, and the return flag the category. The engine itself knows
nothing of this.

Line facts are reduced to one row per logical key before any dimension is
joined, so only the reduced rows meet the supplier table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.sql import case, inline, text, texts
from cutline.operators.predict import MODELS
from cutline.plans.calendar import PARTIAL, RoundCalendar
from cutline.plans.panel import WidePanel, canonical_branches, canonical_panel, wide_panel
from cutline.schemas import CUTOFF_KEY
from cutline.sources.workdir import kept

# ---------------------------------------------------------------------------
# The calendar of this binding
# ---------------------------------------------------------------------------

YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
BASE_YEAR = 1996  # requests for earlier years are refused

_ROUNDS = [
    ("MOCK", "Mock Round", 0, True),
    ("R1", "Round 1", 1, True),
    ("KKR_SPECIAL", "Round 2 KKR Special Allotment", 2, False),
    ("R3", "Round 3", 3, True),
    ("R4", "Round 4", 4, True),
]

CALENDAR = RoundCalendar(
    seeded={y: _ROUNDS for y in YEARS},
    held={y: [r[0] for r in _ROUNDS] for y in YEARS},
    terminal={y: ["R3"] if y == 1999 else ["R4", "R3"] for y in YEARS},
    progressions={y: [("R1", "R3")] if y == 1999 else [("R1", "R3"), ("R3", "R4")] for y in YEARS},
    same_role={"R3": (frozenset({1995, 1996, 1997, 1998, 2000, 2001}), PARTIAL)},
    recency={"R1": (2000, 1999), "TERMINAL": (2000, 1998)},
)

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

ALIAS_OF = {"PROMO": "STANDARD"}
ARCHITECTURE_TYPES = ["LARGE"]
ARCHITECTURE_REGION = 4

# ---------------------------------------------------------------------------


ROUND_OF_PRIORITY = case(
    *[(f"substring(o_orderpriority, 1, 1) = '{i}'", text(r[0])) for i, r in enumerate(_ROUNDS, start=1)]
)
CATEGORY_OF_FLAG = case(("l_returnflag = 'N'", "'GM'"), ("l_returnflag = 'R'", "'KKR'"), default="'HKR'")
VERSION_OF_STATUS = case(("l_linestatus = 'F'", "'v1'"), default="'v2'")


@dataclass(frozen=True)
class Star:
    """The tables below one directory, and the engine's tables derived from them."""

    spark: SparkSession
    path: str

    calendar = CALENDAR

    def table(self, name: str) -> DataFrame:
        """A table with its declared schema, which also saves the job that would infer one."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")

    # dimensions -----------------------------------------------------------

    def colleges(self) -> DataFrame:
        supplier, nation = self.table("supplier"), self.table("nation")
        return supplier.join(nation, F.expr("s_nationkey = n_nationkey")).selectExpr(
            "CAST(s_suppkey AS STRING) AS college_id",
            "format_string('S%05d', s_suppkey) AS college_code",
            "replace(s_name, '#', ' ') AS college_name",
            "s_name AS original_name",
            "n_name AS location",
            f"CASE WHEN n_regionkey = {ARCHITECTURE_REGION} THEN 'ARCHITECTURE' ELSE 'ENGINEERING' END "
            "AS institution_type",
        )

    def branches(self) -> DataFrame:
        """One row per part type; the distinct is combined on the map side and stays tiny."""
        target = case(*[(f"p_type = {text(a)}", text(c)) for a, c in ALIAS_OF.items()])
        return self.table("part").select("p_type").distinct().selectExpr(
            "p_type AS branch_id",
            "p_type AS branch_code",
            "concat(initcap(p_type), ' Engineering') AS branch_name",
            "p_type AS original_name",
            f"CASE WHEN coalesce({target}, p_type) IN {texts(ARCHITECTURE_TYPES)} THEN 'ARCHITECTURE' "
            "ELSE 'ENGINEERING' END AS program_type",
            f"({target}) IS NULL AS is_canonical",
            f"{target} AS canonical_branch_id",
        )

    def rounds(self) -> DataFrame:
        return self.calendar.rounds_frame(self.spark)

    # facts ----------------------------------------------------------------

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of files, be it one file or a folder of them; an error if there is neither."""
        self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")
        # a stream takes a plain path for a folder; a pattern may match a file as well
        return self.spark.readStream.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parque[t]")

    def lines(self, line: DataFrame | None = None) -> DataFrame:
        """Line items with the order's year, round and status, and the part's type."""
        line = self.table("lineitem") if line is None else line
        # short forms and the narrower join first: on large tables, lines go through a shuffle for each join
        order = self.table("orders").selectExpr(
            "o_orderkey", "year(o_orderdate) AS _year", "substring(o_orderpriority, 1, 1) AS o_orderpriority", "o_orderstatus"
        )
        part = self.table("part")
        return (
            line.join(part, F.expr("l_partkey = p_partkey"))
            .join(order, F.expr("l_orderkey = o_orderkey"))
            .selectExpr(
                "CAST(l_suppkey AS STRING) AS college_id",
                "format_string('S%05d', l_suppkey) AS college_code",
                "p_type AS branch_id",
                "_year AS academic_year",
                f"{ROUND_OF_PRIORITY} AS round_code",
                f"{CATEGORY_OF_FLAG} AS category_code",
                f"{VERSION_OF_STATUS} AS source_version_id",
                "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id",
                *line.columns,
                "o_orderstatus",
                "p_retailprice",
            )
        )

    def cutoffs(self) -> DataFrame:
        """One fact per logical key and version; where v2 exists, v1 is superseded.

        Lines are grouped by their own columns; names are made up afterwards,
        from the few columns of the groups.
        """
        bounds = [
            F.expr(f"{f}(CASE WHEN {VERSION_OF_STATUS} = '{v}' THEN l_extendedprice END) AS {v}_{f}")
            for v in ("v1", "v2")
            for f in ("min", "max")
        ]
        facts = [
            {
                "source_version_id": text(v),
                "opening_rank": f"CAST(floor({v}_min) AS INT)",
                "closing_rank": f"CAST(floor({v}_max) AS INT)",
                "status": status,
            }
            for v, status in (
                ("v1", "CASE WHEN v2_max IS NULL THEN 'PUBLISHED' ELSE 'SUPERSEDED' END"),
                ("v2", "'PUBLISHED'"),
            )
        ]
        groups = (
            self.table("lineitem")
            .join(self.table("orders"), F.expr("l_orderkey = o_orderkey"))
            .join(self.table("part"), F.expr("l_partkey = p_partkey"))
            .groupBy(
                "l_suppkey", "p_type", "l_returnflag", F.expr("left(o_orderpriority, 1) AS o_orderpriority"),
                F.expr("year(o_orderdate) AS academic_year"),
            )
            .agg(*bounds)
        )
        rows = groups.selectExpr(
            "CAST(l_suppkey AS STRING) AS college_id",
            "p_type AS branch_id",
            f"{CATEGORY_OF_FLAG} AS category_code",
            f"{ROUND_OF_PRIORITY} AS round_code",
            "academic_year",
            inline(facts),
        )
        return rows.filter("closing_rank IS NOT NULL").selectExpr(
            "*",
            "concat_ws('|', college_id, branch_id, academic_year, round_code, category_code, source_version_id) "
            "AS record_id",
        )

    def version_facts(self, where: str) -> DataFrame:
        """Facts of the lines that pass a filter, one per logical key and version, all published."""
        return (
            self.lines()
            .filter(where)
            .groupBy(*CUTOFF_KEY, "source_version_id")
            .agg(
                F.expr("CAST(floor(min(l_extendedprice)) AS INT) AS opening_rank"),
                F.expr("CAST(floor(max(l_extendedprice)) AS INT) AS closing_rank"),
            )
            .withColumn("status", F.lit("PUBLISHED"))
        )

    def raw_cutoffs(
        self, line: DataFrame | None = None, document: str = "concat(college_code, '-', source_version_id)"
    ) -> DataFrame:
        """Line items as raw cutoff rows with the faults a validator must find; ``document`` names the version of each."""
        line = (self.table("lineitem") if line is None else line).selectExpr(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
            "CASE WHEN l_discount > 0.02 THEN l_quantity END AS l_quantity", "floor(l_extendedprice) AS l_extendedprice",
        )
        return self.lines(line).selectExpr(
            "line_id AS row_idx",
            "college_code",
            "branch_id AS branch_code",
            "category_code",
            "CASE WHEN round_code = 'KKR_SPECIAL' AND o_orderstatus = 'P' THEN 'R2' ELSE round_code END AS round_code",
            "CAST(l_quantity AS INT) * 2000 - 2000 AS opening_rank",
            "CAST(l_extendedprice AS INT) * 3 - 15000 AS closing_rank",
            "academic_year",
            "CAST(NULL AS STRING) AS row_identifier",
            f"{document} AS source_version_id",
        )

    # a document of one round and year, with the rows of all colleges
    ROUND_DOCUMENT = "concat(source_version_id, '-', academic_year, '-', round_code)"

    def round_documents(self) -> DataFrame:
        """One document per version, year and round; some correct others, some cannot be read as text."""
        return self.rounds().selectExpr(
            "explode(array('v1', 'v2')) AS version", "academic_year", "round_code AS counselling_round",
        ).selectExpr(
            "concat(version, '-', academic_year, '-', counselling_round) AS source_version_id", "version", "academic_year",
            "counselling_round", "'CUTOFF_PDF' AS document_type", "'ENGINEERING' AS program_type",
            "CASE WHEN academic_year % 3 = 0 AND counselling_round = 'R3' THEN 'Corrigendum to the list' ELSE 'List' END AS title",
            "CAST(NULL AS INT) AS minimum", "academic_year % 2 = 0 OR counselling_round <> 'R4' AS is_usable_text",
        )

    def ship_cells(self) -> DataFrame:
        """First-round lines on canonical branches as long cells of the year they were shipped in, which no calendar lists."""
        canon = canonical_branches(self.branches()).withColumnRenamed("raw_branch_id", "_raw")
        lines = self.lines().where("round_code = 'R1'").withColumnRenamed("branch_id", "_line_branch")
        return lines.join(canon, F.expr("_line_branch = _raw")).selectExpr(
            "college_id", "college_code", "branch_id", "branch_code", "program_type", "category_code AS category",
            "year(l_shipdate) AS ship_year", "CAST(floor(l_extendedprice) AS INT) AS closing_rank",
        )

    def raw_seats(self) -> DataFrame:
        """Line items as raw seat rows."""
        return self.lines().selectExpr(
            "line_id AS row_idx",
            "CASE WHEN l_tax < 0.005 THEN '' ELSE college_code END AS college_code",
            "CASE WHEN l_tax BETWEEN 0.005 AND 0.015 THEN NULL ELSE branch_id END AS branch_code",
            "CASE WHEN round_code <> 'MOCK' THEN round_code END AS counselling_round",
            "CASE WHEN category_code <> 'HKR' THEN category_code END AS category_code",
            "academic_year",
            "CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS INT) - 2 END AS total_seats",
            "CASE WHEN l_linestatus <> 'O' THEN l_linenumber * 5 - 6 END AS vacant_seats",
            "CASE WHEN l_discount > 0.045 THEN l_linenumber END AS gm_seats",
            "CASE WHEN l_discount > 0.015 THEN CAST(l_quantity AS INT) % 9 - 1 END AS kkr_seats",
            "CAST(NULL AS STRING) AS row_identifier",
        )

    def raw_fees(self) -> DataFrame:
        """Line items as raw fee rows; amounts are text."""
        total = "CAST(round(p_retailprice * 100) AS BIGINT)"
        share = "CAST(round(l_discount * 100) AS BIGINT)"
        tax = "CAST(round(l_tax * 100) AS BIGINT)"
        qty = "CAST(l_quantity AS INT)"
        return self.lines().selectExpr(
            "line_id AS row_idx",
            f"CASE WHEN {qty} = 3 THEN NULL ELSE college_code END AS college_code",
            f"CASE WHEN {qty} = 4 THEN '' ELSE branch_id END AS branch_code",
            "academic_year",
            f"CASE WHEN {qty} = 5 THEN NULL WHEN {qty} = 6 THEN 'n/a' WHEN {qty} = 7 THEN '-100' "
            f"ELSE CAST({total} AS STRING) END AS total_fee",
            f"CASE WHEN {qty} = 8 THEN 'x' WHEN {qty} = 9 THEN CAST({total} + 1 AS STRING) WHEN {qty} = 10 THEN NULL "
            f"ELSE CAST({total} - {share} * 900 AS STRING) END AS tuition_fee",
            f"CASE WHEN {qty} = 11 THEN '-1' WHEN {qty} IN (8, 12) THEN 'y' "
            f"ELSE CAST({share} * 900 + ({tax} - 4) * 30 AS STRING) END AS other_fee",
            "CAST(NULL AS STRING) AS row_identifier",
        )

    def raw_documents(self) -> DataFrame:
        """One document per supplier and version, with the counts of the year before."""
        held = self.table("lineitem").groupBy("l_suppkey").agg(F.expr("count(1) * 2 AS baseline_count"))
        return (
            self.table("supplier")
            .join(held, F.expr("s_suppkey = l_suppkey"), "left")
            .selectExpr(
                "format_string('S%05d', s_suppkey) AS _code",
                "CASE WHEN s_nationkey < 12 THEN 'CUTOFF_PDF' WHEN s_nationkey < 22 THEN 'SEAT_MATRIX_PDF' "
                "WHEN s_nationkey < 24 THEN 'NOTIFICATION_PDF' ELSE 'UNKNOWN' END AS document_type",
                "CASE WHEN s_nationkey % 2 = 0 THEN 'ENGINEERING' ELSE 'ARCHITECTURE' END AS program_type",
                "baseline_count",
                "CAST(NULL AS INT) AS minimum",
                "s_acctbal < 500 AS is_corrigendum",
                "explode(array('v1', 'v2')) AS _version",
            )
            .withColumn("source_version_id", F.expr("concat(_code, '-', _version)"))
            .drop("_code", "_version")
        )

    def registry_colleges(self) -> DataFrame:
        """Colleges with an account in credit; rows of the others are unknown."""
        return self.table("supplier").filter("s_acctbal >= 0").selectExpr(
            "format_string('S%05d', s_suppkey) AS college_code", "CAST(s_suppkey AS STRING) AS college_id"
        )

    def registry_branches(self) -> DataFrame:
        return self.branches().filter("is_canonical").select("branch_code", "branch_id")

    def seats(self) -> DataFrame:
        """Seats per college, branch, year and round; lines of the first round carry no round."""
        return (
            self.lines()
            .groupBy("college_id", "branch_id", "academic_year", F.expr("nullif(round_code, 'MOCK') AS round_code"))
            .agg(
                F.expr("CAST(sum(l_quantity) AS INT) AS total_seats"),
                F.expr("CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS INT) AS vacant_seats"),
                F.expr("max(source_version_id) AS source_version_id"),
                F.expr("max(l_shipdate) AS created_at"),
            )
            .selectExpr(
                "concat_ws('|', college_id, branch_id, academic_year, coalesce(round_code, '-')) AS record_id",
                "*",
                "CAST(NULL AS STRING) AS category_code",
                "'PUBLISHED' AS status",
            )
        )

    def fees(self) -> DataFrame:
        """Fees per college, branch and year, from retail prices."""
        return (
            self.lines()
            .groupBy("college_id", "branch_id", "academic_year")
            .agg(F.expr("CAST(max(p_retailprice) * 100 AS DECIMAL(12,2)) AS total_fee"))
            .withColumn("tuition_fee", F.expr("CAST(total_fee * 0.90BD AS DECIMAL(12,2))"))
            .selectExpr(
                "concat_ws('|', college_id, branch_id, academic_year) AS record_id",
                "college_id", "branch_id", "academic_year", "total_fee", "tuition_fee",
                "CAST(total_fee - tuition_fee AS DECIMAL(12,2)) AS other_fee",
                "'INR' AS currency",
                "'PUBLISHED' AS status",
            )
        )

    def requests(self, cutoffs: DataFrame | None = None) -> DataFrame:
        """One prediction request per cutoff record, asked as if its round had not closed yet.

        Some requests name unknown entities, a program that does not fit or a
        round that cannot be asked for, so every refusal occurs.
        """
        first = "source_version_id = 'v1'"
        supplier = "CAST(college_id AS INT)"
        asked = "CASE WHEN round_code = 'MOCK' THEN 'TERMINAL' ELSE round_code END"
        models = f"array(CAST(NULL AS STRING), {', '.join(text(m) for m in MODELS)})"
        return (self.cutoffs() if cutoffs is None else cutoffs).selectExpr(
            "record_id AS request_id",
            f"CASE WHEN {first} AND {supplier} % 29 = 0 THEN concat('X', college_id) ELSE college_id END AS college_id",
            f"CASE WHEN {first} AND branch_id = 'SMALL' AND academic_year = 1997 THEN 'TINY' ELSE branch_id END "
            "AS branch_id",
            "academic_year",
            f"CASE WHEN {first} THEN lower({asked}) ELSE {asked} END AS round",
            "category_code AS category",
            f"CASE WHEN branch_id IN {texts(ARCHITECTURE_TYPES)} OR (branch_id = 'MEDIUM' AND academic_year = 2001) "
            "THEN 'ARCHITECTURE' WHEN branch_id = 'ECONOMY' AND academic_year = 2000 THEN 'DESIGN' "
            "ELSE 'ENGINEERING' END AS program_type",
            f"get({models}, ({supplier} + academic_year) % 10) AS model_type",
            f"CASE WHEN {first} AND {supplier} % 31 = 0 THEN 0 ELSE opening_rank END AS candidate_rank",
        )

    # documents derived from the tables ---------------------------------------

    def portal_pages(self) -> DataFrame:
        """Link lists in HTML, one page per fifty suppliers."""
        context = case(
            ("s_nationkey % 5 = 0", "'Engineering Cut-Off Ranks after Round 1'"),
            ("s_nationkey % 5 = 1", "'Vacant Seats after Round-3 2024'"),
            ("s_nationkey % 5 = 2", "'B.Arch Fee Structure 2025 after all rounds'"),
            ("s_nationkey % 5 = 3", "'Counselling process of the Mock Allotment'"),
            default="'General news'",
        )
        href = case(
            ("s_suppkey % 7 = 0", "'#top'"),
            ("s_suppkey % 7 = 1", "'javascript:void(0)'"),
            ("s_suppkey % 3 = 0", "concat('/files/doc-', s_suppkey % 70, '.pdf')"),
            default="concat('notice.html?id=', s_suppkey)",
        )
        label = "CASE WHEN s_suppkey % 2 = 0 THEN concat('File ', s_suppkey % 10) ELSE concat('Document number ', s_suppkey) END"
        day = "concat_ws('.', s_suppkey % 31 + 1, s_suppkey % 12 + 1, CASE WHEN s_suppkey % 4 = 0 THEN 24 ELSE 2023 + s_suppkey % 3 END)"
        item = f"concat('<li>', {context}, ' <a href=\"', {href}, '\">', {label}, '</a> Notified on ', {day}, '</li>')"
        return self._pages_of_suppliers(item, "<html><body><ul>", "</ul></body></html>", "https://portal.example.org/docs/page-")

    def directory_pages(self) -> DataFrame:
        """Supplier directories as HTML tables, one page per fifty suppliers."""
        item = (
            "concat('<tr><td> ', lower(format_string('S%05d', s_suppkey)), '. </td><td>', replace(s_name, '#', ' college of '), "
            "'</td><td>', n_name, '</td></tr>')"
        )
        head = "<div><h2>Engineering list</h2><table><tr><th>COLLEGE CODE</th><th>Colleges</th><th>Location</th></tr>"
        return self._pages_of_suppliers(item, head, "</table></div>", "https://portal.example.org/list/")

    def branch_pages(self) -> DataFrame:
        """A page per part that lists it as a branch, with a table outside the listing block beside it."""
        code = "lower(concat(left(p_name, 1), left(substring_index(p_name, ' ', -1), 1), p_size % 10))"
        return self.table("part").selectExpr(
            "p_partkey AS page_id",
            "concat('<div class=\"txt-content wide\"><h2>Branches offered for B.E. courses</h2><table><tr><td>No</td><td>Branch</td>"
            "<td>Branch Code</td></tr><tr><td>1</td><td>', p_name, '</td><td>', "
            f"{code}, '</td></tr></table></div><table><tr><td>1</td><td>Other</td><td>zz</td></tr></table>') AS html",
        )

    def _pages_of_suppliers(self, item: str, head: str, tail: str, url: str) -> DataFrame:
        # fifty rows a page, by construction
        return (
            self.table("supplier")
            .join(self.table("nation"), F.expr("s_nationkey = n_nationkey"))
            .groupBy(F.expr("CAST(floor(s_suppkey / 50) AS BIGINT) AS page_id"))
            .agg(F.expr(f"array_sort(collect_list(struct(s_suppkey, {item} AS item))) AS items"))
            .selectExpr(
                "page_id",
                f"concat({text(url)}, page_id, '.html') AS url",
                f"concat({text(head)}, array_join(items.item, ''), {text(tail)}) AS html",
            )
        )

    def _grid(self, rows: DataFrame, header: list[str], cells: list[str], title: str) -> DataFrame:
        return rows.selectExpr(
            "concat(college_id, '-', academic_year, '-', source_version_id) AS doc_id", "1 AS page", "0 AS table_no",
            f"array({', '.join(header)}) AS header", "CAST(_row AS INT) AS row_no", f"array({', '.join(cells)}) AS cells",
            "'CUTOFF_PDF' AS document_type", f"{text(title)} AS title", "academic_year", "round_code",
            "round_code AS counselling_round",
        )

    def _grid_facts(self) -> DataFrame:
        code = "format_string('S%05d', CAST(college_id AS BIGINT))"
        return self.version_facts("true").selectExpr(
            "*", f"{code} AS code", "concat('Supplier ', college_id) AS name",
            "pmod(xxhash64(branch_id, category_code, round_code), 1000000) AS _row",
        )

    def wide_grid(self) -> DataFrame:
        """One line per college, category, year, round and version; a column per branch."""
        types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
        ranks = [F.expr(f"max(CASE WHEN branch_id = '{t}' THEN closing_rank END) AS {t}") for t in types]
        rows = (
            self.version_facts("true")
            .groupBy("college_id", "category_code", "academic_year", "round_code", "source_version_id")
            .agg(*ranks)
            .withColumn("_row", F.lit(1))
        )
        header = ["'College Code'", "'College Name'", "'Category'", *[f"'{t}-{t.title()} Engineering'" for t in types]]
        code = "lower(format_string('S%05d', CAST(college_id AS BIGINT)))"
        cells = [code, "concat('SUPPLIER ', college_id)", "CASE category_code WHEN 'GM' THEN ' general ' ELSE lower(category_code) END",
                 *[f"coalesce(format_number({t}, 0), '--')" for t in types]]
        return self._grid(rows, header, cells, "Cut-off ranks")

    def vertical_grid(self) -> DataFrame:
        """One line per general-merit fact."""
        facts = self._grid_facts().filter("category_code = 'GM'")
        return self._grid(
            facts,
            ["'College Code'", "'College Name'", "'Course Name'", "'Cutoff Rank'"],
            ["code", "name", "concat(branch_id, '-', branch_id, ' Communicat- ion&Systems')",
             "CASE WHEN closing_rank % 11 = 0 THEN '0' ELSE format_number(closing_rank, 0) END"],
            "Cut-off ranks",
        )

    def category_grid(self) -> DataFrame:
        """One line per course, with a column per category."""
        rows = (
            self._grid_facts()
            .groupBy("college_id", "code", "name", "branch_id", "academic_year", "round_code", "source_version_id")
            .agg(
                F.expr("max(CASE WHEN category_code = 'GM' THEN closing_rank END) AS gm"),
                F.expr("max(CASE WHEN category_code = 'KKR' THEN closing_rank END) AS kkr"),
            )
            .withColumn("_row", F.lit(1))
        )
        return self._grid(
            rows,
            ["'College Code'", "'College Name'", "'Course Name'", "'GM Rank'", "'HKR'"],
            ["code", "name", "branch_id", "CAST(gm AS STRING)", "CAST(kkr AS STRING)"],
            "Cut-off ranks",
        )

    def seat_grid(self) -> DataFrame:
        """Seats as grid lines; the year decides the layout: four, five, six or nine columns."""
        rows = self.seats().selectExpr(
            "*", "format_string('S%05d', CAST(college_id AS BIGINT)) AS code", "concat('Supplier ', college_id) AS name",
            "total_seats - vacant_seats AS rest",
        )
        base = ["'College Code'", "'College Name'", "'Course'"]
        own = ["code", "name", "concat(branch_id, '-', branch_id, ' Engineering')"]
        layouts = {
            1995: (["'Total Seats Vacant'"], ["CASE WHEN vacant_seats % 5 = 0 THEN 'none' ELSE CAST(vacant_seats AS STRING) END"]),
            1996: (["'KKR Seats Vacant'"], ["CAST(vacant_seats AS STRING)"]),
            1997: (["'GM Seats'", "'KKR Seats'"], ["CAST(rest AS STRING)", "CASE WHEN vacant_seats > 0 THEN CAST(vacant_seats AS STRING) ELSE '' END"]),
            1998: (["'Total Seats Vacant'", "'GM Seats Vacant'"], ["CAST(total_seats AS STRING)", "CAST(rest AS STRING)"]),
            1999: (["'Total Seats Vacant'", "'GM Seats Vacant'", "'KKR Seats Vacant'"],
                   ["CASE WHEN total_seats % 3 = 0 THEN '-' ELSE CAST(total_seats AS STRING) END", "CAST(rest AS STRING)", "CAST(vacant_seats AS STRING)"]),
            2000: (["'Total'", "'GM'", "'KKR'", "'Tuition Fee'", "'Other Fee'", "'Total Fee'"],
                   ["CAST(total_seats AS STRING)", "CAST(rest AS STRING)", "CAST(vacant_seats AS STRING)",
                    "concat('Rs ', format_number(total_seats * 1000, 0))", "CAST(vacant_seats * 10 AS STRING)",
                    "CASE WHEN total_seats % 2 = 0 THEN '0' ELSE format_number(total_seats * 1000 + vacant_seats * 10, 2) END"]),
            2001: (["'Total'", "'GM'", "'KKR'", "'Tuition Fee'"],
                   ["CAST(total_seats AS STRING)", "CAST(rest AS STRING)", "CAST(vacant_seats AS STRING)", "CAST(total_seats * 1000 AS STRING)"]),
        }
        def by_year(arrays: dict[int, list[str]]) -> str:
            return case(*[(f"academic_year = {y}", f"array({', '.join(a)})") for y, a in arrays.items()])

        return rows.selectExpr(
            "concat(college_id, '-', academic_year) AS doc_id", "1 AS page", "0 AS table_no",
            by_year({y: base + h for y, (h, _) in layouts.items()}) + " AS header",
            "1 AS row_no",
            by_year({y: own + c for y, (_, c) in layouts.items()}) + " AS cells",
            "'SEAT_MATRIX_PDF' AS document_type", "'Seats' AS title", "academic_year", "round_code",
            "round_code AS counselling_round",
        )

    # provenance and operation, from the event stream -----------------------

    def aliases(self) -> DataFrame:
        """Two spellings of each college."""
        spellings = F.array("original_name", F.concat_ws(", ", "college_name", "location"))
        return self.colleges().select(
            "college_id", F.explode(spellings).alias("alias"), F.lit("REGISTRY").alias("source")
        )

    def sources(self) -> DataFrame:
        """One source per user; it was last checked when its user last viewed something."""
        user = F.col("user_id")
        return (
            self.table("events")
            .groupBy("user_id")
            .agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_checked_at"))
            .select(
                user.cast("string").alias("source_id"),
                F.when(user % 3 != 0, F.format_string("SRC-%d", user)).alias("source_code"),
                F.format_string("Source %d", user).alias("title"),
                (user % 17 != 0).alias("is_enabled"),
                (user % 24 + 1).cast("int").alias("check_frequency_hours"),
                "last_checked_at",
            )
        )

    def versions(self) -> DataFrame:
        """One document version per event."""
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").cast("string").alias("source_version_id"),
            F.col("user_id").cast("string").alias("source_id"),
            F.concat_ws(" ", F.lit("Document"), "event_id").alias("source_title"),
            F.sha2("props", 256).alias("content_hash"),
            F.when(kind == "purchase", "PUBLISHED")
            .when(kind == "view", "PARSED")
            .when(kind == "click", "DOWNLOADED")
            .when(kind == "signup", "DISCOVERED")
            .otherwise("REJECTED")
            .alias("processing_status"),
            F.col("ts").alias("created_at"),
        )

    def reviews(self) -> DataFrame:
        """Failed arrivals go to review; the larger values still wait."""
        return self.table("events").filter(F.col("event_type") == "error").select(
            F.col("event_id").cast("string").alias("item_id"),
            F.col("user_id").cast("string").alias("source_id"),
            F.concat(F.lit("doc-"), F.get_json_object("props", "$.k")).alias("document_url"),
            F.concat(F.lit("value "), F.col("value").cast("decimal(12,2)").cast("string")).alias("failure_reason"),
            F.when(F.col("value") >= 150, "PENDING_REVIEW")
            .when(F.col("value") >= 50, "APPROVED")
            .otherwise("REJECTED")
            .alias("status"),
            F.col("ts").alias("created_at"),
        )

    def errors(self) -> DataFrame:
        """Validation errors: one per failed arrival, graded by its value."""
        return self.table("events").filter(F.col("event_type") == "error").select(
            F.col("event_id").cast("string").alias("source_version_id"),
            F.when(F.col("value") >= 100, "CRITICAL").when(F.col("value") >= 20, "ERROR")
            .otherwise("WARNING").alias("severity"),
        )

    def runs(self) -> DataFrame:
        """One ingestion run per day."""
        failed = F.count_if(F.col("event_type") == "error")
        return (
            self.table("events")
            .groupBy(F.to_date("ts").alias("day"))
            .agg(
                F.min("ts").alias("started_at"),
                F.max("ts").alias("finished_at"),
                F.count_distinct("user_id").alias("source_count"),
                F.count_if(F.col("event_type") == "purchase").alias("published_count"),
                failed.alias("rejected_count"),
                F.when(failed * 5 < F.count(F.lit(1)), "SUCCESS")
                .when(failed * 4 < F.count(F.lit(1)), "PARTIAL_SUCCESS")
                .otherwise("FAILED")
                .alias("status"),
            )
            .select(F.date_format("day", "yyyy-MM-dd").alias("run_id"), "started_at", "finished_at",
                    "status", "source_count", "published_count", "rejected_count")
        )

    # the panel ------------------------------------------------------------

    def panel(self, cutoffs: DataFrame | None = None, **filters) -> DataFrame:
        facts = self.cutoffs() if cutoffs is None else cutoffs
        return canonical_panel(facts, self.colleges(), self.branches(), self.rounds(), **filters)

    def wide(self) -> WidePanel:
        return wide_panel(self.panel(), self.calendar)

    def kept(self) -> tuple[DataFrame, WidePanel]:
        """The facts and their wide panel, written once for queries that read them several times.

        Readers of either take different columns, so Spark would join and group all lines anew for each of them.
        """
        facts = kept(self.cutoffs(), "facts")
        wide = wide_panel(self.panel(facts), self.calendar)
        return facts, WidePanel(kept(wide.frame, "wide"), self.calendar)
