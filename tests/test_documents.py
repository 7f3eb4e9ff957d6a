import datetime
import time

from cutline import schemas
from cutline.operators import monitor as mon
from cutline.sources import grids, pages
from cutline.sources.html import PageReader

GRID = schemas.GRIDS + ", round_code string, counselling_round string"


def grid(table, header, *lines, kind="CUTOFF_PDF", title="t", year=2026):
    head = ["College Code", "College Name", *header]
    rows = [("d", 1, 0, head, i, list(cells), kind, title, year, "R1", "R1") for i, cells in enumerate(lines, start=1)]
    return table(GRID, rows)


def ranks(df):
    return sorted((r.college_code, r.category_code, r.branch_code, r.closing_rank, r.row_identifier) for r in grids.cutoff_rows(df).collect())


def test_vertical_grid(table):
    df = grid(table, ["Course Name", "Cutoff Rank"], ["e001", "X", "CS-Computer Science", "1,420"], ["E002", "Y", "Mechanical", "--"],
              ["", "Y", "CS-C", "5"], ["E003", "Z", "Mechanical", "77"])
    assert ranks(df) == [("E001", "GM", "CS", 1420, "p1_r1_E001_GM_CS"), ("E003", "GM", "MECH", 77, "p1_r4_E003_GM_MECH")]


def test_category_grid(table):
    df = grid(table, ["Course Name", "GM", "HKR rank", "Note"], ["E001", "X", "CS-Computer", "10", "20", "30"], ["E002", "X", "CS-Computer", None, "0", ""])
    assert ranks(df) == [("E001", "GM", "CS", 10, "p1_r1_E001_GM_CS"), ("E001", "KKR", "CS", 20, "p1_r1_E001_KKR_CS")]


def test_wide_grid(table):
    df = grid(table, ["Category", "CS-Computer Science", "EC-Electronics", "Remarks"],
              ["E001", "X", "general", "1,420", "--", "9"], ["E002", "Y", None, "", "0", None], ["E003", "Z", "kkr", "5"])
    assert ranks(df) == [("E001", "GM", "CS", 1420, "p1_r1_E001_GM_CS"), ("E003", "KKR", "CS", 5, "p1_r3_E003_KKR_CS")]
    assert {r.college_code for r in grids.discovered_colleges(grids.cutoff_rows(df)).collect()} == {"E001", "E003"}
    assert grids.discovered_branches(grids.cutoff_rows(df)).first().branch_name == "Computer Science"


def seat(table, header, *values, **kw):
    df = grid(table, ["Course", *header], ["E001", "X", "AE-Aeronautical Engineering", *values], kind="VACANT_SEATS_PDF", **kw)
    return grids.seat_and_fee_rows(df)


def only(df):
    r = grids.seat_rows(df).first()
    return (r.total_seats, r.vacant_seats, r.gm_seats, r.kkr_seats, r.category_code)


def test_vacancy_layouts(table):
    assert only(seat(table, ["Total Seats Vacant"], "12")) == (None, 12, None, None, None)
    assert only(seat(table, ["KKR Seats Vacant"], "3")) == (None, 3, None, 3, "KKR")
    assert only(seat(table, ["Total Vacant Seats - GM"], "9")) == (None, 9, 9, None, "GM")
    assert only(seat(table, ["GM Seats", "KKR Seats"], "10", "4")) == (None, 14, 10, 4, None)
    assert only(seat(table, ["Total Seats", "GM Seats"], "10", "4")) == (None, 10, 4, None, None)
    assert only(seat(table, ["Total Seats Vacant", "GM Seats Vacant", "KKR Seats Vacant"], "8", "6", "2")) == (None, 8, 6, 2, None)


def test_malformed_vacancy_goes_to_review(table):
    lines = seat(table, ["Total Seats Vacant"], "INVALID_NOT_A_NUMBER")
    assert grids.seat_rows(lines).count() == 0
    errors = grids.malformed_rows(lines)
    assert errors.first().error.startswith("Malformed vacancy row")
    documents = table("doc_id string", [("d",), ("empty",)])
    states = {r.doc_id: (r.row_count, r.status) for r in grids.document_states(documents, grids.seat_rows(lines), errors).collect()}
    assert states == {"d": (0, "NEEDS_REVIEW"), "empty": (0, "NEEDS_REVIEW")}


def test_seat_and_fee_table(table):
    header = ["Course", "Total", "GM", "KKR", "Tuition Fee", "Other Fee", "Total Fee"]
    df = grid(table, header, ["E001", "X", "AE-Aero", "60", "50", "10", "302,000", "20,000", "322000"],
              ["College Code", "", "Course", "x", "", "", "", "", ""], ["E002", "X", "AE-Aero", "60", "", "", "100", "", "0"], kind="SEAT_MATRIX_PDF")
    lines = grids.seat_and_fee_rows(df)
    assert {(r.college_code, r.total_seats, r.gm_seats) for r in grids.seat_rows(lines).collect()} == {("E001", 60, 50), ("E002", 60, None)}
    fees = {r.college_code: (float(r.total_fee), float(r.tuition_fee)) for r in grids.fee_rows(lines).collect()}
    assert fees == {"E001": (322000.0, 302000.0), "E002": (100.0, 100.0)}


def test_parser_registry(table):
    df = grid(table, ["Course Name", "Cutoff Rank"], ["E001", "X", "CS-C", "5"])
    assert grids.parse(df, "CUTOFF_PDF").count() == 1
    docs = table("doc_id string, document_type string", [("a", "CUTOFF_PDF"), ("b", "NOTIFICATION_PDF"), ("c", None)])
    assert {r.doc_id for r in grids.without_parser(docs).collect()} == {"b", "c"}


PAGE = """<html><script>var a='<a href="/no">';</script><div>
<ul><li>2025 list <a href="/f/cutoff.pdf">Engineering Cut-Off Ranks Round 1</a> Notified on 5.6.25</li>
<li><a href="#x">seat</a> <a href="">seat</a> <a href="javascript:go()">seat</a></li>
<li>news <a href="https://other.org/a">about us</a></li>
<li>seat matrix <a href="m.html">list</a></li></ul>
<p>again <a href="/f/cutoff.pdf">second mention of fee</a></div></html>"""


def test_links(table):
    df = table("page_id bigint, url string, html string", [(1, "https://p.org/d/page", PAGE), (2, "https://p.org/e/", PAGE), (3, None, None)])
    found = {r.url: r for r in pages.discover_links(pages.anchors(df), 2026).collect()}
    assert set(found) == {"https://p.org/f/cutoff.pdf", "https://p.org/d/m.html", "https://p.org/e/m.html"}
    pdf = found["https://p.org/f/cutoff.pdf"]
    assert (pdf.page_id, pdf.position, pdf.document_type, pdf.counselling_round, pdf.academic_year) == (1, 0, "CUTOFF_PDF", "R1", 2025)
    assert pdf.publication_date == datetime.date(2025, 6, 5) and pdf.title == "Engineering Cut-Off Ranks Round 1"
    assert found["https://p.org/d/m.html"].title == "seat matrix list"
    seen = table("url string", [("https://p.org/f/cutoff.pdf",)])
    assert pages.discover_links(pages.anchors(df), 2026, seen).count() == 2


COLLEGES = """<h3>Architecture institutions</h3><table><tr><th>Code</th><th>College</th><th>City</th></tr>
<tr><td>E003</td><td>Third college</td><td>HASSAN</td></tr><tr><td>A009</td><td>of arts</td></tr></table>
<table><tr><th>COLLEGE CODE</th><th>ENGINEERING COLLEGES</th><th>LOCATION</th></tr>
<tr><td>E001 </td><td>r.v. college</td><td>BENGALURU</td></tr><tr><td>E003</td><td>Other name</td><td>BENGALURU</td></tr></table>"""


def test_college_tables(table):
    df = table("page_id bigint, html string", [(1, COLLEGES), (2, "<p>no table</p>")])
    found = {r.college_code: r for r in pages.colleges_from_tables(pages.html_tables(df)).collect()}
    assert (found["E001"].location, found["E001"].institution_type, found["E001"].college_name) == ("Bengaluru", "ENGINEERING", "R.V. College")
    assert (found["E003"].college_name, found["E003"].location, found["E003"].institution_type) == ("Third College", "Hassan", "ENGINEERING")
    assert found["A009"].institution_type == "ARCHITECTURE" and found["A009"].college_name == "Of Arts"


def _reading_time(items):
    html = "".join(f"<li>item {i}</b>" for i in range(items))
    start = time.perf_counter()
    page = PageReader().read(html + '<a href="x">last</a>')
    assert page.links[0][0].text == "last" and page.links[0][1].text == f"item {items - 1}last"
    return time.perf_counter() - start


def test_unclosed_items_are_read_in_linear_time():
    _reading_time(1000)
    assert _reading_time(80_000) < 40 * _reading_time(8_000)  # ten times as many; a quadratic reader takes a hundred times


def test_unclosed_elements_hold_what_follows():
    page = PageReader().read("<table><tr><td>a<td>b<script>x</script><tr><th>c</table>d<tr/><br>e")
    (table,) = page.tables
    assert [[c.text for c in row.cells] for row in table.rows] == [["abc", "bc", "c"], ["c"]]
    assert table.text == "abc" and page.lists[0][-2:] == ["d", "e"]


def test_branch_table(table):
    html = """<div class="txt-content wide"><h2>Branches offered for B.E. courses</h2><table><tr><td>No</td><td>Branch</td><td>Branch Code</td></tr>
    <tr><td>1</td><td>Communicat- ion</td><td>ec</td></tr></table></div><table><tr><td>1</td><td>Other</td><td>zz</td></tr></table>"""
    df = table("page_id bigint, html string", [(1, html)])
    assert [tuple(r) for r in pages.branches_from_pages(df).collect()] == [("EC", "Communication")]


def test_integrity(table):
    df = table("id int, body string, pdf boolean", [(1, "%PDF-1.7 x", True), (2, "", True), (3, "%PDF-" + "x" * 200, True),
                                                  (4, "<!DOCTYPE html><html>", True), (5, "<html>", False), (6, "junk", True)])
    found = {r.id: r.reason for r in pages.integrity(df, "body", "pdf", max_bytes=100).collect()}
    assert found == {1: None, 2: "empty", 3: "exceeds maximum size limit", 4: "returned HTML content", 5: None, 6: "not a PDF"}


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 body")
    (tmp_path / "b.pdf").write_bytes(b"<html>error</html>")
    docs = pages.read_documents(spark, str(tmp_path))
    assert sorted(r.is_ok for r in pages.integrity(docs, "content", "true").collect()) == [False, True]


def test_fingerprints(table):
    docs = table("id bigint, source string, body string", [(1, "s", "a"), (2, "s", "a"), (3, "s", "b"), (4, "t", "a"), (5, "s", "a")])
    found = pages.fingerprints(docs, "source", "id", "body")
    assert {r.id: r.version_no for r in found.collect()} == {1: 1, 2: None, 3: 2, 4: 1, 5: None}
    archive = found.filter("id = 1")
    assert {r.id for r in pages.not_archived(found, archive, "source").collect()} == {3, 4}


def test_freshness(table):
    now = datetime.datetime(2026, 6, 1)
    hour = datetime.timedelta(hours=1)
    sources = table(
        "source_id string, source_code string, title string, is_enabled boolean, check_frequency_hours int, last_checked_at timestamp",
        [("1", None, "off", False, 1, None), ("2", "B", "t", True, 1, None), ("3", "C", "t", True, 24, now - hour),
         ("4", "D", "t", True, 24, now - 49 * hour), ("5", "E", "t", True, 24, now - 48 * hour)])
    versions = table("source_id string, source_version_id string, source_title string, processing_status string, created_at timestamp",
                     [("5", "a", "first", "PUBLISHED", now - 9 * hour), ("5", "b", "second", "PARSED", now - hour)])
    reviews = table("source_id string, status string", [("3", "PENDING_REVIEW"), ("5", "APPROVED")])
    rows = {r.source_id: r for r in mon.source_freshness(sources, versions, reviews, "TIMESTAMP'2026-06-01'").collect()}
    assert [rows[k].status for k in "12345"] == ["DISABLED", "NEVER_CHECKED", "HAS_REVIEW_ITEMS", "STALE", "HEALTHY"]
    assert rows["1"].source_code == "off" and rows["5"].latest_document_title == "second"
    assert rows["5"].latest_published_at == now - 9 * hour and rows["5"].total_versions == 2


def test_cutoff_rows_work_out_each_text_rule_once(table):
    df = grid(table, ["Category", "CS-Computer Science"], ["E001", "X", "general", "1,420"])
    plan = grids.cutoff_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    digits, spaces = plan.count("[^0-9]"), plan.count("(?U)")
    assert digits == 1 and spaces <= 12, (digits, spaces)


def test_pages_of_one_partition_are_read_by_many_tasks(spark):
    html = "<div class='txt-content'><h2>Branches offered for B.E.</h2><table><tr><td>1</td><td>N</td><td>c{}</td></tr></table></div>"
    few = spark.createDataFrame([(i, html.format(i)) for i in range(64)], "page_id long, html string").coalesce(1)
    found = pages.branches_from_pages(few)
    assert found.count() == 64
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan[plan.index("MapInPandas"):]
