"""Links, tables and integrity of web pages, and fingerprints of any content.

Only the step from HTML to flat rows runs in Python, over Arrow batches.
Resolving, classifying and deduplicating are built-in functions. Many links
point to the same place, so the first one is found by a combined aggregate.
"""

from __future__ import annotations

import itertools
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import text as tx
from cutline.plans.pooled import first_per_key, numbered
from cutline.sources.html import PageReader

# Fixed values
MAX_BYTES = 50 * 1024 * 1024
TITLE_LENGTH = 500
SHORT_TITLE = 10
USABLE_CUTOFF_CHARS = 100
USABLE_SEAT_CHARS = 50

ANCHORS = "page_id bigint, position int, href string, url string, link_text string, parent_text string"
TABLES = (
    "page_id bigint, table_no int, before string, header array<string>, row_no int, cells array<string>"
)
BRANCH_ROWS = "page_id bigint, row_no int, cells array<string>"


def _read(html: str | None) -> PageReader:
    return PageReader().read(html or "")


def _frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in schema.split(", ")])


def _anchor_rows(batches):
    for batch in batches:
        rows = []
        for page_id, url, html in zip(batch.page_id, batch.url, batch.html):
            for position, (link, parent) in enumerate(_read(html).links):
                href = link.attrs["href"].strip()
                try:
                    full = urljoin(url or "", href)
                except ValueError:  # a malformed address resolves to nothing
                    full = None
                rows.append((page_id, position, href, full, link.text, parent.text if parent else ""))
        yield _frame(rows, ANCHORS)


def anchors(pages: DataFrame) -> DataFrame:
    """Every link of every page (page_id, url, html), resolved against the page's address."""
    rows = pages.select("page_id", "url", "html").mapInPandas(_anchor_rows, ANCHORS)
    return rows.withColumns({c: tx.clean_text(F.col(c)) for c in ("link_text", "parent_text")}).filter(
        "href <> '' AND NOT startswith(href, '#') AND NOT startswith(href, 'javascript:') AND url IS NOT NULL"
    )


def discover_links(links: DataFrame, default_year: int, seen: DataFrame | None = None) -> DataFrame:
    """Relevant links, each address once (its first relevant place), classified.

    ``seen`` holds addresses (url) known before.
    """
    both = F.trim(F.concat_ws(" ", "parent_text", "link_text"))
    found = links.withColumn("context", F.when(both == "", F.col("url")).otherwise(both))
    relevant = F.endswith(F.lower("url"), F.lit(".pdf")) | tx.has_any(F.lower("context"), tx.LINK_WORDS)
    found = found.filter(relevant)
    if seen is not None:
        found = found.join(seen.select("url"), "url", "left_anti")
    first = found.groupBy("url").agg(
        F.expr("min_by(struct(page_id, position, link_text, parent_text, context), struct(page_id, position)) AS _l")
    )
    context = F.col("context")
    title = F.expr(
        f"substring(coalesce(nullif(CASE WHEN length(link_text) > {SHORT_TITLE} THEN link_text ELSE parent_text END, ''), "
        f"substring_index(url, '/', -1)), 1, {TITLE_LENGTH})"
    )
    return first.select("url", "_l.*").select(
        "url",
        "page_id",
        "position",
        title.alias("title"),
        tx.document_type(context).alias("document_type"),
        tx.link_type(context).alias("guessed_type"),
        tx.document_year(context, default_year).alias("academic_year"),
        tx.document_round(context).alias("counselling_round"),
        F.coalesce(tx.publication_date(context), tx.publication_date(F.col("url"))).alias("publication_date"),
    )


def _table_rows(batches):
    for batch in batches:
        rows = []
        for page_id, html in zip(batch.page_id, batch.html):
            for table_no, table in enumerate(_read(html).tables):
                if not table.rows:
                    continue
                before = table.before.text if table.before else ""
                first, *others = table.rows
                header = [c.text for c in first.cells]
                for row_no, row in enumerate(others, start=1):
                    rows.append((page_id, table_no, before, header, row_no, [c.stripped for c in row.cells]))
        yield _frame(rows, TABLES)


def html_tables(pages: DataFrame) -> DataFrame:
    """Data rows of every table, with the table's header and the heading before it."""
    return pages.filter("contains(lower(html), '<table')").select("page_id", "html").mapInPandas(
        _table_rows, TABLES
    )


def _institution_type(header: str, before: str) -> Column:
    """Type named in the header, else in the text before the table, else ENGINEERING."""
    kinds = ("ARCHITECTURE", "DENTAL", "MEDICAL", "ENGINEERING")
    tests = [f"WHEN contains({where}, '{k}') THEN '{k}'" for where in (header, before) for k in kinds]
    return F.expr(f"CASE {' '.join(tests)} ELSE 'ENGINEERING' END")


def colleges_from_tables(tables: DataFrame) -> DataFrame:
    """College records from tables with code and name columns, one per code.

    The first row of a code gives name and place. If any table lists the code
    under engineering, it is an engineering college.
    """
    headers = F.transform("header", lambda h: F.upper(tx.clean_text(h)))
    # as the columns are scanned in order, the last one that fits wins
    last = "CAST(array_max(transform(_h, (h, i) -> CASE WHEN {test} THEN i END)) AS INT)"
    code, place = "contains(h, 'CODE')", "contains(h, 'LOCATION') OR contains(h, 'CITY') OR contains(h, 'DISTRICT')"
    name = "contains(h, 'COLLEGE') OR contains(h, 'INSTITUT')"
    rows = tables.withColumns(
        {"_h": headers, "_joined": F.array_join(headers, " "), "_before": F.upper("before")}
    ).withColumns(
        {
            "_code": F.expr(last.format(test=code)),
            "_name": F.expr(last.format(test=f"NOT ({code}) AND ({name})")),
            "_place": F.expr(last.format(test=f"NOT ({code}) AND NOT ({name}) AND ({place})")),
            "_type": _institution_type("_joined", "_before"),
        }
    )
    fallback = "_code IS NULL AND size(_h) >= 3"
    rows = rows.withColumns(
        {
            "_c": F.expr(f"CASE WHEN {fallback} THEN 0 ELSE _code END"),
            "_n": F.expr(f"CASE WHEN {fallback} THEN 1 ELSE _name END"),
            "_p": F.expr(f"CASE WHEN {fallback} THEN 2 ELSE _place END"),
        }
    ).filter("_c IS NOT NULL AND _n IS NOT NULL AND size(cells) > greatest(_c, _n)")
    rows = rows.select(
        "page_id", "table_no", "row_no", "_type",
        tx.college_code(F.expr("get(cells, _c)")).alias("college_code"),
        tx.college_name(F.expr("get(cells, _n)")).alias("college_name"),
        tx.clean_text(F.expr("get(cells, _n)")).alias("original_name"),
        tx.location(F.expr("get(cells, _p)")).alias("location"),
    ).filter("college_code <> '' AND college_name <> ''")
    first = (
        "min_by(struct(college_name, original_name, location, _type), struct(page_id, table_no, row_no)) AS _f"
    )
    return (
        rows.groupBy("college_code")
        .agg(F.expr(first), F.expr("bool_or(_type = 'ENGINEERING') AS _engineering"))
        .selectExpr(
            "college_code", "_f.college_name", "_f.original_name", "_f.location",
            "CASE WHEN _engineering THEN 'ENGINEERING' ELSE _f._type END AS institution_type",
        )
    )


def branches_from_pages(
    pages: DataFrame, heading: str = "Branches offered for B.E.", container: str = "txt-content"
) -> DataFrame:
    """Branch codes and names from tables in the block that has the given heading."""

    def branch_rows(batches):
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.page_id, batch.html):
                page, row_no = _read(html), 0
                blocks = set()
                for element in page.headings:
                    if heading in element.text:
                        fitting = (d.number for d in element.divs() if container in (d.attrs.get("class") or "").split())
                        blocks.update(itertools.islice(fitting, 1))
                for table in page.tables if blocks else ():
                    for row in table.rows:
                        cells = [c.stripped for c in row.cells if c.tag == "td"]
                        if len(cells) >= 3 and any(d.number in blocks for d in row.divs()):
                            rows.append((page_id, row_no, cells))
                            row_no += 1
            yield _frame(rows, BRANCH_ROWS)

    # a page costs much time for its few bytes, so pages of one file are dealt to all tasks
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pages.select("page_id", "html").repartition(tasks).mapInPandas(branch_rows, BRANCH_ROWS).select(
        "page_id", "row_no", F.upper(F.get("cells", 2)).alias("_raw"),
        tx.branch_code(F.get("cells", 2)).alias("branch_code"),
        tx.branch_name(F.get("cells", 1)).alias("branch_name"),
    )
    return (
        found.filter("_raw <> 'BRANCH CODE' AND branch_code <> '' AND branch_name <> ''")
        .groupBy("branch_code")
        .agg(F.expr("max_by(branch_name, struct(page_id, row_no)) AS branch_name"))
    )


def integrity(documents: DataFrame, content: str, claims_pdf: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``is_ok`` and ``reason``. ``content`` is a string or binary column, ``claims_pdf`` SQL text."""
    size = f"octet_length({content})"
    head = f"lower(CAST(substring(CAST({content} AS BINARY), 1, 200) AS STRING))"
    reason = (
        f"CASE WHEN {content} IS NULL OR {size} = 0 THEN 'empty' "
        f"WHEN {size} > {max_bytes} THEN 'exceeds maximum size limit' "
        f"WHEN ({claims_pdf}) AND NOT startswith(CAST({content} AS STRING), '%PDF-') THEN "
        f"CASE WHEN contains({head}, '<html') OR contains({head}, '<!doctype') OR contains({head}, 'error') THEN 'returned HTML content' "
        "ELSE 'not a PDF' END END"
    )
    return documents.withColumn("reason", F.expr(reason)).withColumn("is_ok", F.expr("reason IS NULL"))


def read_documents(spark, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Raw files with their content; one row per file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def fingerprints(documents: DataFrame, source: str, row_id: str, content: str) -> DataFrame:
    """Hash each document, and mark those whose content its source has sent before.

    New content of a source gets the next version number, in the order of
    ``row_id`` (a unique whole number). Neither step gathers the documents of
    one source in one task.
    """
    hashed = documents.withColumn("content_hash", tx.sha256_hex(F.col(content))).drop(content)
    marked = first_per_key(hashed, [source, "content_hash"], row_id, flag="is_new")
    versions = numbered(marked.filter("is_new").select(source, row_id), [source], row_id, "version_no")
    return marked.join(versions.select(row_id, "version_no"), row_id, "left")


def not_archived(hashed: DataFrame, archive: DataFrame, source: str) -> DataFrame:
    """Documents whose (source, hash) is not in the archive yet."""
    return hashed.join(archive.select(source, "content_hash"), [source, "content_hash"], "left_anti")


def text_state(first_pages_chars: Column, all_chars: Column, document_type: Column) -> Column:
    """NEEDS_REVIEW for documents without usable text, PARSED otherwise."""
    cutoff = document_type == "CUTOFF_PDF"
    few = F.when(cutoff, first_pages_chars < USABLE_CUTOFF_CHARS).otherwise(all_chars < USABLE_SEAT_CHARS)
    return F.when(F.coalesce(few, F.lit(True)), "NEEDS_REVIEW").otherwise("PARSED")
