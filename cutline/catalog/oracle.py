"""The same questions in plain SQL, written row-wise and independently of the engine."""

from __future__ import annotations

YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def dec(expr: str, digits: int) -> str:
    """Round half up on the decimal form, as the engine does."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30,9)), {digits}) AS DOUBLE)"


CODE = "printf('S%05d', {})"

COLLEGES = f"""
colleges AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS college_id, {CODE.format('s_suppkey')} AS college_code,
         replace(s_name, '#', ' ') AS college_name, s_name AS original_name, n_name AS location,
         CASE WHEN n_regionkey = 4 THEN 'ARCHITECTURE' ELSE 'ENGINEERING' END AS institution_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

BRANCHES = """
branches AS (
  SELECT p_type AS branch_id, p_type AS branch_code,
         upper(p_type[1]) || lower(p_type[2:]) || ' Engineering' AS branch_name, p_type AS original_name,
         CASE WHEN p_type = 'LARGE' THEN 'ARCHITECTURE' ELSE 'ENGINEERING' END AS program_type,
         p_type <> 'PROMO' AS is_canonical,
         CASE WHEN p_type = 'PROMO' THEN 'STANDARD' END AS canonical_branch_id
  FROM (SELECT DISTINCT p_type FROM part) t)"""

LINES = f"""
lines AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS college_id, {CODE.format('l_suppkey')} AS college_code,
         p_type AS branch_id, CAST(year(o_orderdate) AS INTEGER) AS academic_year,
         CASE o_orderpriority[1] WHEN '1' THEN 'MOCK' WHEN '2' THEN 'R1' WHEN '3' THEN 'KKR_SPECIAL'
              WHEN '4' THEN 'R3' WHEN '5' THEN 'R4' END AS round_code,
         CASE l_returnflag WHEN 'N' THEN 'GM' WHEN 'R' THEN 'KKR' ELSE 'HKR' END AS category_code,
         CASE l_linestatus WHEN 'F' THEN 'v1' ELSE 'v2' END AS source_version_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id,
         lineitem.*, o_orderstatus, p_retailprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

CUTOFFS = """
versions AS (
  SELECT college_id, branch_id, category_code, round_code, academic_year, source_version_id,
         CAST(floor(min(l_extendedprice)) AS INTEGER) AS opening_rank,
         CAST(floor(max(l_extendedprice)) AS INTEGER) AS closing_rank
  FROM lines GROUP BY ALL),
cutoffs AS (
  SELECT v.*,
         CASE WHEN source_version_id = 'v1' AND EXISTS (
                SELECT 1 FROM versions n WHERE n.source_version_id = 'v2' AND n.college_id = v.college_id
                  AND n.branch_id = v.branch_id AND n.category_code = v.category_code
                  AND n.round_code = v.round_code AND n.academic_year = v.academic_year)
              THEN 'SUPERSEDED' ELSE 'PUBLISHED' END AS status,
         concat_ws('|', college_id, branch_id, academic_year, round_code, category_code,
                   source_version_id) AS record_id
  FROM versions v)"""

PANEL = """
panel_all AS (
  SELECT record_id, academic_year, closing_rank, opening_rank, c.college_id, college_code, college_name,
         institution_type, coalesce(b.canonical_branch_id, b.branch_id) AS branch_id,
         coalesce(b.canonical_branch_id, b.branch_code) AS branch_code,
         t.branch_name, t.program_type, category_code AS category, round_code,
         CAST(CASE round_code WHEN 'MOCK' THEN 0 WHEN 'R1' THEN 1 WHEN 'KKR_SPECIAL' THEN 2
              WHEN 'R3' THEN 3 ELSE 4 END AS INTEGER) AS round_number,
         round_code <> 'KKR_SPECIAL' AS is_general_round, source_version_id, status
  FROM cutoffs f JOIN colleges c USING (college_id) JOIN branches b ON f.branch_id = b.branch_id
  JOIN branches t ON t.branch_id = coalesce(b.canonical_branch_id, b.branch_id)),
panel AS (SELECT * FROM panel_all WHERE status = 'PUBLISHED'),
cells AS (
  SELECT college_id, college_code, branch_id, branch_code, program_type, category, academic_year,
         round_code, round_number, max(closing_rank) AS closing_rank
  FROM panel GROUP BY ALL)"""

TERMINAL = """
finals AS (
  SELECT college_id, college_code, branch_id, branch_code, program_type, category, academic_year,
         coalesce(max(CASE WHEN round_code = 'R4' AND academic_year <> 1999 THEN closing_rank END),
                  max(CASE WHEN round_code = 'R3' THEN closing_rank END)) AS closing_rank,
         CASE WHEN max(CASE WHEN round_code = 'R4' AND academic_year <> 1999 THEN closing_rank END)
                   IS NOT NULL THEN 'R4' ELSE 'R3' END AS round_code
  FROM cells WHERE round_code IN ('R3', 'R4') GROUP BY ALL
  HAVING coalesce(max(CASE WHEN round_code = 'R4' AND academic_year <> 1999 THEN closing_rank END),
                  max(CASE WHEN round_code = 'R3' THEN closing_rank END)) IS NOT NULL)"""

ALIAS_NOTE = "an alias branch beside its canonical one: the greatest closing rank is kept"

BASE = f"WITH {COLLEGES}, {BRANCHES}, {LINES}, {CUTOFFS}, {PANEL}, {TERMINAL}"
COMBO = "college_id, college_code, branch_id, branch_code, program_type, category"
PARTITION = "program_type, category"

STEPS = """
pairs(academic_year, from_round, to_round) AS (
  SELECT CAST(y AS INTEGER), 'R1', 'R3' FROM range(1995, 2002) t(y)
  UNION ALL SELECT CAST(y AS INTEGER), 'R3', 'R4' FROM range(1995, 2002) t(y) WHERE y <> 1999),
steps AS (
  SELECT p.academic_year, p.from_round, p.to_round, a.college_id, a.college_code, a.branch_id,
         a.branch_code, a.program_type, a.category, a.closing_rank AS from_rank,
         b.closing_rank AS to_rank, b.closing_rank - a.closing_rank AS move,
         (b.closing_rank - a.closing_rank) / CAST(a.closing_rank AS DOUBLE) AS rel
  FROM pairs p JOIN cells a ON a.academic_year = p.academic_year AND a.round_code = p.from_round
  JOIN cells b ON b.academic_year = p.academic_year AND b.round_code = p.to_round
   AND b.college_id = a.college_id AND b.branch_id = a.branch_id AND b.category = a.category)"""

YOY_PAIRS = [(1995, 1996), (1996, 1997), (1997, 1998), (1998, 1999), (1999, 2000), (2000, 2001), (1995, 2001)]

_YOY_R1 = f"""
yoy AS (
  SELECT a.college_id, a.college_code, a.branch_id, a.branch_code, a.program_type, a.category,
         a.academic_year AS from_year, 'R1' AS from_round, a.closing_rank AS from_rank,
         b.academic_year AS to_year, 'R1' AS to_round, b.closing_rank AS to_rank,
         'DIRECT' AS comparability, a.academic_year || '->' || b.academic_year AS transition,
         b.closing_rank - a.closing_rank AS absolute_movement,
         (b.closing_rank - a.closing_rank) / CAST(a.closing_rank AS DOUBLE) AS relative_movement,
         CASE WHEN b.closing_rank < a.closing_rank THEN 'EARLIER_NUMERICALLY'
              WHEN b.closing_rank > a.closing_rank THEN 'LATER_NUMERICALLY' ELSE 'UNCHANGED' END AS direction
  FROM (VALUES {', '.join(map(str, YOY_PAIRS))}) p(y1, y2)
  JOIN cells a ON a.academic_year = y1 AND a.round_code = 'R1'
  JOIN cells b ON b.academic_year = y2 AND b.round_code = 'R1' AND b.college_id = a.college_id
   AND b.branch_id = a.branch_id AND b.category = a.category)"""

_YOY_TERMINAL = _YOY_R1.replace("a.round_code = 'R1'", "a.round_code = t1.r").replace(
    "b.round_code = 'R1'", "b.round_code = t2.r"
).replace("'R1' AS from_round", "t1.r AS from_round").replace("'R1' AS to_round", "t2.r AS to_round").replace(
    "'DIRECT' AS comparability", "'PARTIAL' AS comparability"
).replace(
    "p(y1, y2)",
    "p(y1, y2) JOIN term t1 ON t1.y = y1 JOIN term t2 ON t2.y = y2",
).replace("\nyoy AS", "\nterm(y, r) AS (SELECT y, CASE WHEN y = 1999 THEN 'R3' ELSE 'R4' END FROM range(1995, 2002) t(y)),\nyoy AS")

_MOVES = f"""
  count(*) AS matched_pairs, {dec('avg(absolute_movement)', 6)} AS mean_absolute_movement,
  {dec('avg(relative_movement)', 6)} AS mean_relative_movement,
  count(*) FILTER (absolute_movement < 0) AS earlier_count,
  count(*) FILTER (absolute_movement > 0) AS later_count,
  count(*) FILTER (absolute_movement = 0) AS unchanged_count,
  median(absolute_movement) AS median_absolute_movement,
  {dec('median(relative_movement)', 6)} AS median_relative_movement"""

_SERIES = """
seq AS (
  SELECT *, closing_rank - lag(closing_rank) OVER w AS move,
         (closing_rank - lag(closing_rank) OVER w) / CAST(lag(closing_rank) OVER w AS DOUBLE) AS rel,
         median(closing_rank) OVER (PARTITION BY college_id, branch_id, category) AS mid
  FROM {source} WINDOW w AS (PARTITION BY college_id, branch_id, category ORDER BY academic_year)),
vol AS (
  SELECT college_id, college_code, branch_id, branch_code, program_type, category,
         CAST(count(*) AS INTEGER) AS observation_count,
         string_agg(CAST(academic_year AS VARCHAR), ',' ORDER BY academic_year) AS years_observed,
         list_sort(list(academic_year)) AS ys,
         avg(closing_rank) AS mean, median(closing_rank) AS median,
         CASE WHEN count(*) > 1 THEN stddev_samp(closing_rank) END AS sd,
         CASE WHEN count(*) > 1 THEN stddev_samp(closing_rank) / avg(closing_rank) END AS cv,
         CASE WHEN count(*) > 1 THEN median(abs(closing_rank - mid)) END AS mad,
         min(closing_rank) AS min_rank, max(closing_rank) AS max_rank,
         max(closing_rank) - min(closing_rank) AS rank_range,
         coalesce(string_agg(CAST(move AS VARCHAR), ',' ORDER BY academic_year), '') AS moves
  FROM seq GROUP BY ALL)"""

_QUALITY = "CASE observation_count WHEN 1 THEN 'INSUFFICIENT' WHEN 2 THEN 'SPARSE' ELSE 'OBSERVABLE' END"


def _volatility(source: str, scope: str) -> str:
    return f"""{BASE}, {_SERIES.format(source=source)}
SELECT {COMBO}, '{scope}' AS round_scope, observation_count, years_observed,
  array_to_string(list_filter({YEARS}, lambda y: NOT list_contains(ys, y)), ',') AS missing_years,
  {dec('mean', 6)} AS mean, median, {dec('sd', 6)} AS standard_deviation,
  {dec('cv', 6)} AS coefficient_of_variation, mad, min_rank, max_rank, rank_range,
  moves AS sequential_absolute_movements, {_QUALITY} AS volatility_data_quality
FROM vol"""


_DEPTH = f"""
depth AS (
  SELECT {COMBO}, count(DISTINCT academic_year) AS n, max(academic_year) AS latest,
         string_agg(DISTINCT CAST(academic_year AS VARCHAR), ',' ORDER BY CAST(academic_year AS VARCHAR)) AS pattern,
         list_sort(list(DISTINCT academic_year)) AS ys
  FROM panel GROUP BY ALL)"""

_BACKWARD = """
  SELECT 'BACKWARD_ROUND_MOVEMENT' AS anomaly_type, academic_year, college_code, branch_code, program_type,
         category, from_round, to_round, from_rank, to_rank, move AS rank_delta,
         'EARLIER_NUMERICALLY' AS direction
  FROM steps WHERE move < 0 AND category IN ('GM', 'KKR')"""


def longitudinal() -> dict[str, str]:
    return {
        "panel": f"""{BASE}
SELECT record_id, academic_year, closing_rank, opening_rank, college_id, college_code, college_name,
       institution_type, branch_id, branch_code, branch_name, program_type, category, round_code,
       round_number, is_general_round, source_version_id, status FROM panel""",
        "yoy_items": f"""{BASE}, {_YOY_R1} SELECT {COMBO}, from_year, from_round, from_rank, to_year, to_round,
       to_rank, comparability, transition, absolute_movement, {dec('relative_movement', 6)} AS relative_movement,
       direction FROM yoy""",
        "yoy_aggregate": f"""{BASE}, {_YOY_R1} SELECT from_year, to_year, from_round, to_round, {PARTITION},
       comparability, {_MOVES} FROM yoy GROUP BY ALL""",
        "yoy_terminal": f"""{BASE}, {_YOY_TERMINAL} SELECT from_year, to_year, from_round, to_round, {PARTITION},
       comparability, {_MOVES} FROM yoy GROUP BY ALL""",
        "comparability": f"""{BASE}, grid AS (
  SELECT DISTINCT academic_year AS y, round_code AS r FROM panel_all)
SELECT a.y AS year1, a.r AS round1, b.y AS year2, b.r AS round2,
  CASE WHEN a.r = 'KKR_SPECIAL' OR b.r = 'KKR_SPECIAL' THEN CASE WHEN a.r = b.r THEN 'DIRECT' ELSE 'NONE' END
       WHEN a.r = (CASE WHEN a.y = 1999 THEN 'R3' ELSE 'R4' END)
        AND b.r = (CASE WHEN b.y = 1999 THEN 'R3' ELSE 'R4' END) THEN 'PARTIAL'
       WHEN a.r <> b.r THEN 'NONE'
       WHEN a.r IN ('R1', 'MOCK') THEN 'DIRECT'
       WHEN a.r = 'R3' THEN CASE WHEN a.y <> 1999 AND b.y <> 1999 THEN 'DIRECT' ELSE 'PARTIAL' END
       ELSE 'PARTIAL' END AS comparability
FROM grid a JOIN grid b ON a.y < b.y""",
        "coverage_counts": f"""{BASE}
SELECT CASE WHEN g = 15 THEN 'ALL' WHEN g = 7 THEN 'YEAR' WHEN g = 3 THEN 'YEAR_ROUND' WHEN g = 13 THEN 'CATEGORY'
            ELSE 'PROGRAM' END AS grain, academic_year, round_code, category, program_type,
       total_records, published_records, total_records - published_records AS superseded_records
FROM (SELECT grouping(academic_year, round_code, category, program_type) AS g, academic_year, round_code,
             category, program_type, count(*) AS total_records,
             count(*) FILTER (status = 'PUBLISHED') AS published_records
      FROM panel_all GROUP BY GROUPING SETS ((), (academic_year), (academic_year, round_code), (category),
                                             (program_type)))""",
        "coverage_entities": f"""{BASE} SELECT academic_year, count(DISTINCT college_id) AS colleges,
       count(DISTINCT branch_id) AS branches FROM panel GROUP BY ALL""",
        "coverage_depth": f"""{BASE}, {_DEPTH} SELECT CAST(n AS INTEGER) AS depth, program_type, count(*) AS combinations
FROM depth GROUP BY GROUPING SETS ((n), (n, program_type))""",
        "year_patterns": f"{BASE}, {_DEPTH} SELECT pattern, count(*) AS combinations FROM depth GROUP BY ALL",
        "excluded_records": f"""{BASE}
SELECT record_id, academic_year, college_code, college_name, branch_code, program_type,
       category_code AS category, round_code, status, closing_rank, source_version_id
FROM cutoffs JOIN colleges USING (college_id) JOIN branches USING (branch_id) WHERE status <> 'PUBLISHED'""",
        "terminal_state": f"{BASE} SELECT {COMBO}, academic_year, closing_rank, round_code FROM finals",
        "volatility": _volatility("finals", "TERMINAL"),
        "volatility_strict": _volatility(
            "(SELECT * FROM cells WHERE round_code = CASE WHEN academic_year = 1999 THEN 'R3' ELSE 'R4' END)",
            "STRICT_TERMINAL",
        ),
        "volatility_r1": _volatility("(SELECT * FROM cells WHERE round_code = 'R1')", "R1"),
        "volatility_by_n": f"""{BASE}, {_SERIES.format(source='finals')},
a AS (SELECT {PARTITION}, observation_count, count(*) AS combination_count, avg(cv) AS mean_cv,
             min(cv) AS min_cv, max(cv) AS max_cv, median(cv) AS median_cv
      FROM vol WHERE observation_count >= 2 GROUP BY ALL),
b AS (SELECT program_type, category, observation_count, count(*) AS move_count,
             median(abs(move)) AS median_absolute_movement, median(abs(rel)) AS median_relative_movement
      FROM seq JOIN vol USING (college_id, branch_id, program_type, category)
      WHERE move IS NOT NULL GROUP BY ALL)
SELECT program_type, category, observation_count, combination_count, {dec('mean_cv', 6)} AS mean_cv,
       {dec('min_cv', 6)} AS min_cv, {dec('max_cv', 6)} AS max_cv, {dec('median_cv', 6)} AS median_cv,
       move_count, median_absolute_movement, {dec('median_relative_movement', 6)} AS median_relative_movement,
       {_QUALITY} AS volatility_data_quality
FROM a JOIN b USING (program_type, category, observation_count)""",
        "progression": f"""{BASE}, {STEPS}
SELECT academic_year, from_round, to_round, {PARTITION}, {_MOVES}
FROM (SELECT *, move AS absolute_movement, rel AS relative_movement FROM steps) GROUP BY ALL""",
        "recency": f"""{BASE}, t AS (
  SELECT {PARTITION}, max(closing_rank) FILTER (academic_year = 2001) AS a,
         max(closing_rank) FILTER (academic_year = 2000) AS n, max(closing_rank) FILTER (academic_year = 1999) AS o
  FROM cells WHERE round_code = 'R1' GROUP BY {PARTITION}, college_id, branch_id
  HAVING a IS NOT NULL AND n IS NOT NULL AND o IS NOT NULL)
SELECT CAST(2001 AS INTEGER) AS anchor_year, CAST(2000 AS INTEGER) AS recent_year,
  CAST(1999 AS INTEGER) AS older_year, 'R1' AS comparison_round, {PARTITION},
  count(*) AS evaluated_triples,
  count(*) FILTER (abs(a - n) < abs(a - o)) AS recent_closer_count,
  count(*) FILTER (abs(a - n) > abs(a - o)) AS older_closer_count,
  count(*) FILTER (abs(a - n) = abs(a - o)) AS equal_distance_count,
  median(abs(a - n)) AS recent_median_absolute_distance, median(abs(a - o)) AS older_median_absolute_distance,
  {dec('median(abs(a - n) / CAST(n AS DOUBLE))', 6)} AS recent_median_relative_distance,
  {dec('median(abs(a - o) / CAST(o AS DOUBLE))', 6)} AS older_median_relative_distance,
  {dec('count(*) FILTER (abs(a - n) < abs(a - o)) / CAST(count(*) AS DOUBLE) * 100', 6)} AS recent_closer_percentage
FROM t GROUP BY {PARTITION}""",
        "sparsity": f"""{BASE}, {_DEPTH}
SELECT {COMBO}, CAST(n AS INTEGER) AS observation_count, pattern AS years_observed,
  array_to_string(list_filter({YEARS}, lambda y: NOT list_contains(ys, y)), ',') AS missing_years,
  CAST(len(list_filter(ys, lambda y: list_contains(ys, y + 1))) AS INTEGER) AS consecutive_transition_count,
  latest AS latest_observation_year, n < 3 AS is_sparse FROM depth""",
        "anomalies": f"""{BASE}, {STEPS} {_BACKWARD}
UNION ALL SELECT 'INVALID_RANK_VALUE', academic_year, college_code, branch_code, program_type, category,
  round_code, NULL, CASE WHEN closing_rank > 0 THEN opening_rank END, closing_rank, NULL, NULL
FROM panel WHERE closing_rank <= 0 OR opening_rank > closing_rank""",
        "progression_matrix": f"""{BASE}, m AS (
  SELECT {COMBO}, academic_year, max(closing_rank) FILTER (round_code = 'R1') AS round_1,
         max(closing_rank) FILTER (round_code = 'KKR_SPECIAL' AND category = 'KKR') AS round_2,
         max(closing_rank) FILTER (round_code = 'R3') AS round_3,
         max(closing_rank) FILTER (round_code = 'R4') AS final
  FROM cells GROUP BY ALL)
SELECT * FROM m WHERE coalesce(round_1, round_2, round_3, final) IS NOT NULL""",
        "round_ladder": f"""{BASE}, l AS (
  SELECT {COMBO}, academic_year, round_code, round_number AS position, closing_rank,
         closing_rank - lag(closing_rank) OVER (PARTITION BY college_id, branch_id, category, academic_year
                                                ORDER BY round_number) AS delta FROM cells)
SELECT *, CASE WHEN delta > 0 THEN 'expansion' WHEN delta < 0 THEN 'contraction' WHEN delta = 0 THEN 'Unchanged'
          END AS step FROM l""",
        "highest_round": f"""{BASE}
SELECT {COMBO}, academic_year, arg_max(round_code, round_number) AS round_code,
       arg_max(closing_rank, round_number) AS closing_rank FROM cells GROUP BY ALL""",
        "college_boundary": f"""{BASE}
SELECT r.college_id, candidate_rank, lowest_cutoff, candidate_rank <= lowest_cutoff AS within_boundary
FROM (SELECT college_id, CAST(avg(opening_rank) AS INTEGER) AS candidate_rank FROM
      (SELECT college_id, floor(avg(opening_rank)) AS opening_rank FROM cutoffs GROUP BY ALL) GROUP BY ALL) r
JOIN (SELECT college_id, min(closing_rank) AS lowest_cutoff FROM panel GROUP BY ALL) USING (college_id)""",
    }


SEATS = """
seats AS (
  SELECT concat_ws('|', college_id, branch_id, academic_year, coalesce(r, '-')) AS record_id, college_id,
         branch_id, academic_year, r AS round_code, CAST(sum(l_quantity) AS INTEGER) AS total_seats,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS INTEGER) AS vacant_seats,
         max(source_version_id) AS source_version_id, max(l_shipdate) AS created_at, 'PUBLISHED' AS status
  FROM (SELECT *, nullif(round_code, 'MOCK') AS r FROM lines) GROUP BY college_id, branch_id, academic_year, r)"""

FEES = """
fees AS (
  SELECT *, CAST(total_fee * CAST(0.90 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS tuition_fee,
         CAST(total_fee - CAST(total_fee * CAST(0.90 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS other_fee
  FROM (SELECT concat_ws('|', college_id, branch_id, academic_year) AS record_id, college_id, branch_id,
               academic_year, CAST(max(p_retailprice) * 100 AS DECIMAL(12,2)) AS total_fee, 'INR' AS currency,
               'PUBLISHED' AS status
        FROM lines GROUP BY ALL))"""

FACTS = f"{BASE}, {SEATS}, {FEES}"

_ENGINEERING = """college_id IN (SELECT college_id FROM colleges WHERE institution_type = 'ENGINEERING')
  AND branch_id IN (SELECT branch_id FROM branches WHERE program_type = 'ENGINEERING')"""

OPERATION = """
sources AS (
  SELECT CAST(user_id AS VARCHAR) AS source_id,
         CASE WHEN user_id % 3 <> 0 THEN 'SRC-' || user_id END AS source_code, 'Source ' || user_id AS title,
         user_id % 17 <> 0 AS is_enabled, CAST(user_id % 24 + 1 AS INTEGER) AS check_frequency_hours,
         max(ts) FILTER (event_type = 'view') AS last_checked_at
  FROM events GROUP BY user_id),
versions AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS source_version_id, CAST(user_id AS VARCHAR) AS source_id,
         'Document ' || event_id AS source_title, sha256(props) AS content_hash,
         CASE event_type WHEN 'purchase' THEN 'PUBLISHED' WHEN 'view' THEN 'PARSED' WHEN 'click' THEN 'DOWNLOADED'
              WHEN 'signup' THEN 'DISCOVERED' ELSE 'REJECTED' END AS processing_status, ts AS created_at
  FROM events),
reviews AS (
  SELECT CAST(event_id AS VARCHAR) AS item_id, CAST(user_id AS VARCHAR) AS source_id,
         'doc-' || json_extract_string(props, '$.k') AS document_url,
         'value ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS failure_reason,
         CASE WHEN value >= 150 THEN 'PENDING_REVIEW' WHEN value >= 50 THEN 'APPROVED' ELSE 'REJECTED' END AS status,
         ts AS created_at
  FROM events WHERE event_type = 'error'),
errors AS (
  SELECT CAST(event_id AS VARCHAR) AS source_version_id,
         CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 20 THEN 'ERROR' ELSE 'WARNING' END AS severity
  FROM events WHERE event_type = 'error'),
runs AS (
  SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS run_id, min(ts) AS started_at, max(ts) AS finished_at,
         CASE WHEN count(*) FILTER (event_type = 'error') * 5 < count(*) THEN 'SUCCESS'
              WHEN count(*) FILTER (event_type = 'error') * 4 < count(*) THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS status,
         count(DISTINCT user_id) AS source_count, count(*) FILTER (event_type = 'purchase') AS published_count,
         count(*) FILTER (event_type = 'error') AS rejected_count
  FROM events GROUP BY ALL)"""

OPS = f"WITH {OPERATION}"

_FRESH = """
fresh AS (
  SELECT s.source_id, coalesce(source_code, s.title) AS source_code, is_enabled,
         CASE WHEN NOT is_enabled THEN 'DISABLED' WHEN last_checked_at IS NULL THEN 'NEVER_CHECKED'
              WHEN coalesce(p.n, 0) > 0 THEN 'HAS_REVIEW_ITEMS'
              WHEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_checked_at)
                   > check_frequency_hours * 2 * 3600000000 THEN 'STALE' ELSE 'HEALTHY' END AS status,
         check_frequency_hours, v.title AS latest_document_title, coalesce(v.n, 0) AS total_versions,
         coalesce(p.n, 0) AS pending_review_count
  FROM sources s
  LEFT JOIN (SELECT source_id, count(*) AS n, arg_max(source_title, (created_at, event_id)) AS title
             FROM versions GROUP BY 1) v USING (source_id)
  LEFT JOIN (SELECT source_id, count(*) AS n FROM reviews WHERE status = 'PENDING_REVIEW' GROUP BY 1) p
       USING (source_id))"""


def lookups() -> dict[str, str]:
    return {
        "cutoff_page": f"""{BASE} SELECT college_id, branch_id, category_code, round_code, academic_year,
  source_version_id, opening_rank, closing_rank, status, record_id FROM cutoffs
WHERE status = 'PUBLISHED' AND category_code = 'GM' AND round_code <> 'KKR_SPECIAL' AND {_ENGINEERING}
ORDER BY closing_rank, record_id LIMIT 50 OFFSET 100""",
        "cutoff_total": f"""{BASE} SELECT count(*) AS total FROM cutoffs
WHERE status = 'PUBLISHED' AND round_code <> 'KKR_SPECIAL' AND {_ENGINEERING}""",
        "seat_page": f"""{FACTS} SELECT record_id, college_id, branch_id, academic_year, round_code, total_seats,
  vacant_seats, source_version_id, strftime(created_at, '%Y-%m-%d') AS created_at, status FROM seats
WHERE (round_code IS NULL OR round_code <> 'KKR_SPECIAL') AND {_ENGINEERING}
ORDER BY created_at DESC, record_id LIMIT 50 OFFSET 50""",
        "fee_page": f"""{FACTS} SELECT record_id, college_id, branch_id, academic_year,
  CAST(total_fee AS DOUBLE) AS total_fee, CAST(tuition_fee AS DOUBLE) AS tuition_fee,
  CAST(other_fee AS DOUBLE) AS other_fee, currency, status FROM fees
WHERE {_ENGINEERING} ORDER BY fees.total_fee DESC, record_id LIMIT 50 OFFSET 20""",
        "college_search": f"""WITH {COLLEGES} SELECT * FROM colleges WHERE contains(lower(college_name), 'nation_1')
  OR contains(lower(college_code), 'nation_1') OR contains(lower(location), 'nation_1')""",
        "branch_search": f"""WITH {BRANCHES} SELECT * FROM branches
WHERE branch_name ILIKE '%m%' OR branch_code ILIKE '%m%' OR original_name ILIKE '%m%'""",
        "college_detail": f"""WITH {COLLEGES} SELECT c.*, alias, 'REGISTRY' AS alias_source FROM colleges c,
  LATERAL (SELECT unnest([original_name, college_name || ', ' || location]) AS alias)""",
        "source_catalogue": f"""{OPS} SELECT source_id, source_code, title, is_enabled, check_frequency_hours,
  source_version_id, source_title AS version_title, processing_status FROM sources LEFT JOIN versions USING (source_id)""",
        "entity_resolve": f"""WITH {COLLEGES}, terms AS (
  SELECT DISTINCT unnest([CAST(c_custkey AS VARCHAR), printf('s%05d', c_custkey), split_part(c_name, '#', 2)]) AS term
  FROM customer)
SELECT term, coalesce(max(i.college_id), max(c.college_id), arg_min(n.college_id, n.college_code)) AS entity_id
FROM terms LEFT JOIN colleges i ON lower(i.college_id) = lower(term)
LEFT JOIN colleges c ON lower(c.college_code) = lower(term)
LEFT JOIN colleges n ON contains(lower(n.original_name), lower(term)) GROUP BY term""",
        "compare": f"""{FACTS} SELECT c.college_id, college_code, latest_cutoff, CAST(annual_fee AS DOUBLE) AS annual_fee
FROM colleges c
LEFT JOIN (SELECT college_id, min(closing_rank) AS latest_cutoff FROM cutoffs WHERE status = 'PUBLISHED'
           AND round_code <> 'KKR_SPECIAL' AND {_ENGINEERING} GROUP BY 1) a USING (college_id)
LEFT JOIN (SELECT college_id, max(total_fee) AS annual_fee FROM fees WHERE {_ENGINEERING} GROUP BY 1) b
     USING (college_id)""",
        "rank_containment": f"""{BASE} SELECT record_id, college_id, closing_rank, opening_rank,
  opening_rank * 2 <= closing_rank AS within, abs(opening_rank * 2 - closing_rank) AS difference,
  CASE WHEN opening_rank * 2 <= closing_rank THEN 'Within by ' ELSE 'Beyond by ' END
  || format('{{:,}}', abs(opening_rank * 2 - closing_rank)) AS label FROM panel""",
        "top_closing_ranks": f"""{BASE} SELECT closing_rank, count(*) AS records FROM cutoffs GROUP BY 1
ORDER BY records DESC, closing_rank LIMIT 10""",
        "custom_order": f"""{BASE} SELECT record_id, round_code, closing_rank FROM cutoffs
ORDER BY CASE round_code WHEN 'R4' THEN 1 WHEN 'R3' THEN 2 WHEN 'R1' THEN 3 ELSE 4 END, closing_rank, record_id LIMIT 40""",
        "sample_cutoffs": f"{BASE} SELECT record_id, closing_rank FROM cutoffs ORDER BY md5('7|' || record_id), record_id LIMIT 30",
        "provenance_sample": f"""WITH {COLLEGES}, {OPERATION} SELECT college_id, college_code, v.source_version_id, v.content_hash
FROM (SELECT college_id, college_code FROM colleges ORDER BY md5('7|' || college_id), college_id LIMIT 4) c,
  (SELECT source_version_id, content_hash FROM versions WHERE processing_status = 'PUBLISHED' ORDER BY source_version_id LIMIT 1) v""",
        "distinct_counts": f"""{BASE} SELECT 'colleges' AS name, count(DISTINCT college_id) AS keys FROM cutoffs
UNION ALL SELECT 'branches', count(DISTINCT branch_id) FROM cutoffs UNION ALL SELECT 'combos', count(DISTINCT (college_id, branch_id)) FROM cutoffs
UNION ALL SELECT 'cells', count(DISTINCT (college_id, branch_id, category_code, round_code)) FROM cutoffs""",
        "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS records FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "run_history": f"{OPS} SELECT run_id, status, source_count, published_count, rejected_count FROM runs",
        "college_prefixes": f"WITH {COLLEGES} SELECT college_code[1:1] AS prefix, count(*) AS colleges FROM colleges GROUP BY 1",
        "part_prefixes": "SELECT p_name[1:1] AS prefix, count(*) AS records FROM part GROUP BY 1",
        "latest_versions": f"""{OPS} SELECT source_id, source_version_id, source_title, content_hash, processing_status
FROM versions QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, event_id DESC) = 1""",
        "freshness": f"{OPS}, {_FRESH} SELECT * FROM fresh",
        "freshness_summary": f"""{OPS}, {_FRESH} SELECT status, count(*) AS sources,
  CAST(sum(total_versions) AS BIGINT) AS versions, CAST(sum(pending_review_count) AS BIGINT) AS pending_reviews
FROM fresh GROUP BY 1""",
        "data_health": f"""{FACTS}, {OPERATION.replace('versions AS', 'docs AS')}
SELECT 'branch_count' AS measure, count(*) AS value FROM branches
UNION ALL SELECT 'cutoff_record_count', count(*) FROM cutoffs WHERE status = 'PUBLISHED'
UNION ALL SELECT 'seat_record_count', count(*) FROM seats UNION ALL SELECT 'fee_record_count', count(*) FROM fees
UNION ALL SELECT 'source_count', count(*) FROM sources
UNION ALL SELECT 'warnings_anomalies_count', count(*) FROM errors WHERE severity IN ('WARNING', 'ERROR')
UNION ALL SELECT 'college_count', count(*) FROM colleges
UNION ALL SELECT 'college_count:' || institution_type, count(*) FROM colleges GROUP BY institution_type
UNION ALL SELECT 'canonical_branch_count', count(*) FROM branches WHERE is_canonical
UNION ALL SELECT 'canonical_branch_count:' || program_type, count(*) FROM branches WHERE is_canonical GROUP BY program_type
UNION ALL SELECT 'source_version_count', count(*) FROM docs
UNION ALL SELECT 'pending_validation_records', count(*) FROM docs
          WHERE processing_status IN ('DISCOVERED', 'DOWNLOADED', 'PARSED')
UNION ALL SELECT 'rejected_records', count(*) FROM docs WHERE processing_status = 'REJECTED'""",
        "recent_runs": f"""{OPS} SELECT run_id, status, source_count, published_count, rejected_count FROM runs
ORDER BY started_at DESC, run_id LIMIT 5""",
        "latest_good_run": f"""{OPS} SELECT run_id, status, source_count, published_count, rejected_count FROM runs
WHERE status IN ('SUCCESS', 'PARTIAL_SUCCESS') ORDER BY started_at DESC, run_id LIMIT 1""",
        "pending_reviews": f"""{OPS} SELECT item_id, source_id, document_url, failure_reason, status FROM reviews
WHERE status = 'PENDING_REVIEW' ORDER BY created_at DESC, item_id LIMIT 50""",
        "reviews_by_status": f"{OPS} SELECT status, count(*) AS items FROM reviews GROUP BY 1",
        "round_counts": f"""{FACTS} SELECT coalesce(round_code, 'NO_ROUND') AS round_code,
  CASE WHEN round_code = 'KKR_SPECIAL' THEN 'SPECIAL_QUOTA' ELSE 'GENERAL' END AS kind, count(*) AS records
FROM seats GROUP BY ALL""",
        "records_by_source": f"""{OPS} SELECT source_version_id, source_title, coalesce(l.n, 0) AS records,
  coalesce(e.n, 0) AS errors FROM versions
LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS source_version_id, count(*) AS n FROM lineitem GROUP BY 1) l
     USING (source_version_id)
LEFT JOIN (SELECT source_version_id, count(*) AS n FROM errors GROUP BY 1) e USING (source_version_id)""",
        "reconcile": f"""{BASE}, t AS (
  SELECT 'lines' AS name, (SELECT count(*) FROM lineitem) AS left_rows, (SELECT count(*) FROM lines) AS right_rows
  UNION ALL SELECT 'orders with lines', (SELECT count(*) FROM orders), (SELECT count(DISTINCT l_orderkey) FROM lineitem)
  UNION ALL SELECT 'panel', (SELECT count(*) FROM cutoffs), (SELECT count(*) FROM panel_all)
  UNION ALL SELECT 'published', (SELECT count(*) FROM cutoffs WHERE status = 'PUBLISHED'), (SELECT count(*) FROM panel))
SELECT *, CASE WHEN left_rows = right_rows THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM t""",
    }


_MODELS = ["NULL", *[f"'{m}'" for m in (
    "MODEL_A_LATEST_HISTORICAL", "MODEL_B_PREVIOUS_YEAR", "MODEL_C_HISTORICAL_MEAN", "MODEL_D_HISTORICAL_MEDIAN",
    "MODEL_E_RECENT_MEDIAN", "MODEL_F_PRECEDING_ROUND", "MODEL_G1_ADDITIVE_MOVEMENT",
    "MODEL_G2_MULTIPLICATIVE_MOVEMENT", "MODEL_H_HYBRID")]]

REQUESTS = f"""
reqs AS (
  SELECT record_id AS request_id,
         CASE WHEN source_version_id = 'v1' AND CAST(college_id AS INTEGER) % 29 = 0 THEN 'X' ELSE '' END
         || college_id AS college_id,
         CASE WHEN source_version_id = 'v1' AND branch_id = 'SMALL' AND academic_year = 1997 THEN 'TINY'
              ELSE branch_id END AS raw_branch_id, academic_year,
         CASE round_code WHEN 'MOCK' THEN 'TERMINAL' ELSE round_code END AS round, category_code AS category,
         CASE WHEN branch_id = 'LARGE' OR (branch_id = 'MEDIUM' AND academic_year = 2001) THEN 'ARCHITECTURE'
              WHEN branch_id = 'ECONOMY' AND academic_year = 2000 THEN 'DESIGN' ELSE 'ENGINEERING' END AS program_type,
         ([{', '.join(_MODELS)}])[1 + (CAST(college_id AS INTEGER) + academic_year) % 10] AS model,
         CASE WHEN source_version_id = 'v1' AND CAST(college_id AS INTEGER) % 31 = 0 THEN 0 ELSE opening_rank END
         AS candidate_rank
  FROM cutoffs),
checked AS (
  SELECT r.*, coalesce(b.canonical_branch_id, r.raw_branch_id) AS branch_id, b.program_type AS own_program,
    CASE WHEN c.college_id IS NULL THEN 'UNKNOWN_COLLEGE' WHEN b.branch_id IS NULL THEN 'UNKNOWN_BRANCH'
         WHEN r.program_type NOT IN ('ENGINEERING', 'ARCHITECTURE') THEN 'UNSUPPORTED_PROGRAM'
         WHEN b.program_type <> r.program_type THEN 'PROGRAM_MISMATCH'
         WHEN category NOT IN ('GM', 'KKR') THEN 'UNSUPPORTED_CATEGORY'
         WHEN round = 'KKR_SPECIAL' THEN 'SPECIAL_ROUND'
         WHEN r.program_type = 'ARCHITECTURE' AND round NOT IN ('R1', 'TERMINAL') THEN 'ROUND_NOT_APPLICABLE'
         WHEN academic_year < 1996 THEN 'YEAR_BEFORE_BASELINE' END AS error_code
  FROM reqs r LEFT JOIN colleges c USING (college_id) LEFT JOIN branches b ON b.branch_id = r.raw_branch_id),
series AS (
  SELECT round_code AS family, * EXCLUDE (round_code, round_number) FROM cells WHERE round_code IN ('R1', 'R3')
  UNION ALL SELECT 'TERMINAL', * EXCLUDE (round_code) FROM finals),
moves AS (
  SELECT CAST(t AS INTEGER) AS academic_year, a.program_type, a.category, median(b.closing_rank - a.closing_rank) AS move,
         median((b.closing_rank - a.closing_rank) / CAST(a.closing_rank AS DOUBLE)) AS rel
  FROM range(1995, 2002) r(t) JOIN cells a ON a.academic_year < t AND a.round_code = 'R1'
  JOIN cells b ON b.academic_year = a.academic_year AND b.round_code = 'R3' AND b.college_id = a.college_id
   AND b.branch_id = a.branch_id AND b.category = a.category GROUP BY ALL)"""

SCORING = f"""
asked AS (
  SELECT *, CASE WHEN round IN ('R1', 'R3') THEN round ELSE 'TERMINAL' END AS family FROM checked WHERE {{where}}),
past AS (
  SELECT request_id, count(s.closing_rank) AS n, CAST(arg_max(s.closing_rank, s.academic_year) AS DOUBLE) AS latest,
         max(s.academic_year) AS latest_year, avg(s.closing_rank) AS mean, median(s.closing_rank) AS med,
         CAST(max(s.closing_rank) FILTER (s.academic_year = a.academic_year - 1) AS DOUBLE) AS prev,
         CAST((list(s.closing_rank ORDER BY s.academic_year DESC))[2] AS DOUBLE) AS second
  FROM asked a LEFT JOIN series s ON s.family = a.family AND s.college_id = a.college_id AND s.branch_id = a.branch_id
   AND s.category = a.category AND s.academic_year < a.academic_year GROUP BY request_id),
known AS (
  SELECT a.*, p.* EXCLUDE (request_id), CAST(c.closing_rank AS DOUBLE) AS pre, coalesce(m.move, 0) AS move, coalesce(m.rel, 0) AS rel
  FROM asked a JOIN past p USING (request_id)
  LEFT JOIN cells c ON c.college_id = a.college_id AND c.branch_id = a.branch_id AND c.category = a.category
   AND c.academic_year = a.academic_year
   AND c.round_code = CASE a.family WHEN 'R3' THEN 'R1' WHEN 'TERMINAL' THEN 'R3' END
  LEFT JOIN moves m ON m.academic_year = a.academic_year AND m.program_type = a.program_type AND m.category = a.category),
picked AS (
  SELECT *, CASE
    WHEN family = 'R1' THEN CASE WHEN model[7] IN ('B', 'C', 'D', 'E') THEN model[7] ELSE 'A' END
    WHEN family = 'R3' THEN CASE
      WHEN pre IS NULL OR coalesce(model[7], 'G') NOT IN ('F', 'G', 'H') THEN 'A'
      WHEN model IS NULL OR (model[7] = 'H' AND n = 0) THEN 'G1'
      WHEN model[7] = 'G' THEN model[7:8] ELSE model[7] END
    ELSE CASE WHEN pre IS NOT NULL THEN CASE WHEN model[7:8] = 'G1' THEN 'G1' WHEN model[7] = 'H' AND n > 0 THEN 'H' ELSE 'F' END
              WHEN model[7] IN ('A', 'B', 'C') THEN model[7] ELSE 'D' END END AS m
  FROM known),
estimated AS (
  SELECT *, CASE m WHEN 'A' THEN latest WHEN 'B' THEN prev WHEN 'C' THEN mean WHEN 'D' THEN med
      WHEN 'E' THEN CASE WHEN n > 1 THEN (latest + second) / 2 ELSE latest END WHEN 'F' THEN pre
      WHEN 'G1' THEN pre + CASE family WHEN 'R3' THEN move ELSE 3800 END WHEN 'G2' THEN pre * (1 + rel)
      WHEN 'H' THEN CASE family WHEN 'R3' THEN (pre + move) * 0.7::DOUBLE + latest * 0.3::DOUBLE
                                ELSE pre * 0.7::DOUBLE + med * 0.3::DOUBLE END END AS p FROM picked),
bounded AS (
  SELECT *, CASE WHEN family = 'TERMINAL' THEN 'VOLATILITY_ADAPTIVE_WIDE' ELSE 'ASYMMETRIC_RELATIVE_EMPIRICAL' END AS kind,
    greatest(1, CASE WHEN family <> 'TERMINAL' THEN p * 0.85::DOUBLE WHEN p < 10000 THEN p * 0.90::DOUBLE
                     WHEN p < 25000 THEN p * 0.85::DOUBLE ELSE p * 0.70::DOUBLE END) AS lo,
    CASE WHEN family <> 'TERMINAL' THEN p * 1.55::DOUBLE WHEN p < 10000 THEN p + 4000 WHEN p < 25000 THEN p + 12000
         ELSE least(120000, greatest(p * 1.55::DOUBLE, p + 45000)) END AS hi
  FROM estimated)"""

_MODEL_NAME = """CASE WHEN p IS NULL THEN 'FAIL_CLOSED_HANDLER' ELSE CASE family || m
  WHEN 'R1A' THEN 'Model A (Latest Historical R1 - ' || latest_year || ')'
  WHEN 'R1B' THEN 'Model B (Previous Year ' || (academic_year - 1) || ' R1)'
  WHEN 'R1C' THEN 'Model C (Historical Mean R1)' WHEN 'R1D' THEN 'Model D (Historical Median R1)'
  WHEN 'R1E' THEN 'Model E (Recent 2-Year Median R1)'
  WHEN 'R3A' THEN 'Model A (Latest Historical R3 - ' || latest_year || ')'
  WHEN 'R3F' THEN 'Model F (Within-Year Preceding R1 Alone)'
  WHEN 'R3G1' THEN 'Model G1 (Preceding R1 + Additive Movement [+' || format('{:,}', CAST(round_even(move, 0) AS BIGINT)) || ' ranks])'
  WHEN 'R3G2' THEN printf('Model G2 (Preceding R1 * [1 + %.1f%% Relative Movement])', rel * 100)
  WHEN 'R3H' THEN 'Model H (Hybrid: 70% Intra-Year Movement + 30% Historical R3)'
  WHEN 'TERMINALA' THEN 'Model A (Latest Historical Terminal - ' || latest_year || ')'
  WHEN 'TERMINALB' THEN 'Model B (Strict Previous Year ' || (academic_year - 1) || ' Terminal)'
  WHEN 'TERMINALC' THEN 'Model C (Historical Mean Terminal)' WHEN 'TERMINALD' THEN 'Model D (Historical Median Terminal)'
  WHEN 'TERMINALF' THEN 'Model F (Within-Year Preceding R3 Alone)'
  WHEN 'TERMINALG1' THEN 'Model G1 (Preceding R3 + Additive Expansion [+3,800 ranks])'
  ELSE 'Model H (Hybrid: 70% Preceding R3 + 30% Historical Median Terminal)' END END"""

_STRENGTH = """CASE WHEN p IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN pre IS NOT NULL OR n >= 3 THEN 'STRONG'
       WHEN n = 2 THEN 'MODERATE' WHEN n = 1 THEN 'SPARSE' ELSE 'INSUFFICIENT_EVIDENCE' END"""


def _scored(where: str) -> str:
    return f"{BASE}, {REQUESTS}, {SCORING.format(where=where)}"


def _prediction(where: str) -> str:
    return f"""{_scored("error_code IS NULL AND " + where)}
SELECT request_id, college_id, branch_id, academic_year, category, program_type,
  CASE WHEN p IS NOT NULL THEN family ELSE round END AS round,
  CASE WHEN p IS NOT NULL THEN 'SUCCESS' ELSE 'INSUFFICIENT_EVIDENCE' END AS status,
  {dec('p', 1)} AS predicted_closing_rank,
  CASE WHEN p IS NOT NULL THEN {dec('lo', 1)} END AS lower_bound, CASE WHEN p IS NOT NULL THEN {dec('hi', 1)} END AS upper_bound,
  CASE WHEN p IS NOT NULL THEN kind END AS interval_type,
  CASE WHEN p IS NOT NULL THEN CASE kind WHEN 'VOLATILITY_ADAPTIVE_WIDE' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END END AS target_coverage,
  CASE WHEN p IS NOT NULL THEN {dec('hi - lo', 1)} END AS interval_width,
  CASE WHEN p > 0 THEN {dec('(hi - lo) / p', 4)} WHEN p IS NOT NULL THEN 0 END AS relative_width,
  {_STRENGTH} AS evidence_strength,
  CAST(CASE WHEN p IS NULL THEN 0 ELSE n + CASE WHEN pre IS NOT NULL THEN 1 ELSE 0 END END AS INTEGER) AS observation_count,
  CASE WHEN p IS NOT NULL THEN coalesce(latest_year, academic_year) END AS latest_comparable_year,
  CASE WHEN p IS NOT NULL THEN 'NONE' ELSE 'NO_HISTORICAL_RECORDS' END AS cold_start_reason,
  {_MODEL_NAME} AS model_name
FROM bounded"""


_TESTS = """
tests AS (
  SELECT t.academic_year AS target_year, t.program_type, t.category, t.college_id, t.branch_id,
         CAST(t.closing_rank AS DOUBLE) AS actual, CAST(count(h.closing_rank) AS INTEGER) AS depth,
         list(CAST(h.closing_rank AS DOUBLE) ORDER BY h.academic_year DESC) FILTER (h.closing_rank IS NOT NULL) AS v,
         list(h.academic_year ORDER BY h.academic_year DESC) FILTER (h.closing_rank IS NOT NULL) AS y
  FROM series t LEFT JOIN series h ON h.family = t.family AND h.college_id = t.college_id AND h.branch_id = t.branch_id
   AND h.category = t.category AND h.academic_year < t.academic_year
  WHERE t.family = '{family}' GROUP BY ALL),
stat AS (SELECT *, v[1] AS latest, list_aggregate(v, 'median') AS med, list_aggregate(v, 'avg') AS mean FROM tests WHERE depth > 0),
stat2 AS (SELECT *, CASE WHEN depth > 1 THEN nullif(list_aggregate(list_transform(v, lambda x: abs(x - med)), 'median'), 0) END AS mad FROM stat),
points AS (
  SELECT *, unnest([{{'model': 'Baseline A (Lag-1 Latest)', 'f': latest}}, {{'model': 'Baseline B (Historical Median)', 'f': med}},
    {{'model': 'Baseline C (Historical Mean)', 'f': mean}},
    {{'model': 'Recency Weighted (70/30)', 'f': CASE WHEN depth > 1 THEN latest * 0.7::DOUBLE + v[2] * 0.3::DOUBLE ELSE latest END}},
    {{'model': 'Baseline E (Linear Trend)', 'f': CASE WHEN depth > 1 THEN greatest(1, latest + (latest - v[2]) / (y[1] - y[2]) * (target_year - y[1])) ELSE latest END}}],
    recursive := true) FROM stat2),
spans AS (
  SELECT *, unnest([{{'model': 'Empirical [Min, Max] Range', 'lo': list_aggregate(v, 'min'), 'hi': list_aggregate(v, 'max')}},
    {{'model': 'Median +- 1.5 * MAD', 'lo': greatest(1, med - coalesce(mad, latest * 0.15::DOUBLE) * 1.5::DOUBLE), 'hi': med + coalesce(mad, latest * 0.15::DOUBLE) * 1.5::DOUBLE}},
    {{'model': 'Lag-1 +- 25% Width', 'lo': greatest(1, latest * 0.75::DOUBLE), 'hi': latest * 1.25::DOUBLE}},
    {{'model': 'Lag-1 +- 35% Width', 'lo': greatest(1, latest * 0.65::DOUBLE), 'hi': latest * 1.35::DOUBLE}}],
    recursive := true) FROM stat2)"""


def _tests(family: str) -> str:
    return f"{BASE}, {REQUESTS}, {_TESTS.format(family=family)}"


_POINT = f"""count(*) AS sample_size, {dec('avg(abs(actual - f))', 2)} AS mae, {dec('median(abs(actual - f))', 2)} AS med_ae,
  {dec('sqrt(avg((actual - f) * (actual - f)))', 2)} AS rmse, {dec('median(abs(actual - f) / actual)', 4)} AS mdape"""
_SPAN = f"""count(*) AS sample_size, {dec('avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END)', 4)} AS coverage,
  {dec('median(greatest(0, hi - lo))', 1)} AS median_width, {dec('avg(greatest(0, hi - lo))', 1)} AS mean_width,
  {dec('median(greatest(0, hi - lo) / actual)', 4)} AS median_rel_width,
  {dec('avg(CASE WHEN actual < lo THEN 1.0::DOUBLE ELSE 0 END)', 4)} AS below_lower_rate,
  {dec('avg(CASE WHEN actual >= lo AND actual > hi THEN 1.0::DOUBLE ELSE 0 END)', 4)} AS above_upper_rate"""
_WINDOW = "target_year, program_type, category"


def prediction() -> dict[str, str]:
    return {
        "pred_r1": _prediction("round = 'R1'"),
        "pred_r3": _prediction("round = 'R3'"),
        "pred_terminal": _prediction("round IN ('R4', 'TERMINAL')"),
        "pred_evidence": f"""{_scored("error_code IS NULL")}, ok AS (
  SELECT *, pre IS NOT NULL AND (family = 'TERMINAL' OR m IN ('F', 'G1', 'G2', 'H')) AS within FROM estimated WHERE p IS NOT NULL),
items AS (
  SELECT request_id, 0 AS k, 'PRECEDING_ROUND' AS source_type, academic_year, CASE family WHEN 'R3' THEN 'R1' ELSE 'R3' END AS round_code,
         pre AS closing_rank, NULL::DOUBLE AS weight, academic_year || CASE family WHEN 'R3' THEN ' Round 1' ELSE ' Round 3' END
         || ' preceding closing rank: ' || format('{{:,}}', CAST(pre AS BIGINT)) AS description FROM ok WHERE within
  UNION ALL SELECT request_id, 1, 'HISTORICAL_MOVEMENT', NULL, 'R1_TO_R3', move, NULL,
         'Median R1->R3 expansion learned from prior years: +' || format('{{:,}}', CAST(round_even(move, 0) AS BIGINT)) || ' ranks'
  FROM ok WHERE within AND family = 'R3' AND m = 'G1'
  UNION ALL SELECT request_id, s.academic_year, 'HISTORICAL_CUTOFF', s.academic_year, s.family, CAST(s.closing_rank AS DOUBLE),
         CASE WHEN o.family = 'R1' AND s.academic_year = latest_year AND coalesce(model[7], 'A') = 'A' THEN 1.0::DOUBLE END,
         s.academic_year || CASE s.family WHEN 'R1' THEN ' Round 1 official published closing rank: '
            WHEN 'R3' THEN ' Round 3 official closing rank: ' ELSE ' terminal official closing rank: ' END
         || format('{{:,}}', s.closing_rank)
  FROM ok o JOIN series s ON s.family = o.family AND s.college_id = o.college_id AND s.branch_id = o.branch_id
   AND s.category = o.category AND s.academic_year < o.academic_year
  WHERE NOT within AND (o.family <> 'R3' OR s.academic_year = latest_year))
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY k) - 1 AS INTEGER) AS position, * EXCLUDE (request_id, k) FROM items""",
        "request_rejects": f"""{BASE}, {REQUESTS} SELECT request_id, error_code,
  CASE WHEN error_code IN ('UNKNOWN_COLLEGE', 'UNKNOWN_BRANCH') THEN 'NOT_FOUND' ELSE 'INVALID' END AS error_class
FROM checked WHERE error_code IS NOT NULL""",
        "learned_movement": f"""{BASE}, {REQUESTS} SELECT academic_year, program_type, category, CAST(move AS DOUBLE) AS median_move,
  {dec('rel', 6)} AS median_relative_move FROM moves""",
        "intervals": f"""{_scored("error_code IS NULL")}, q AS (
  SELECT request_id, {dec('p', 1)} AS p FROM estimated WHERE p IS NOT NULL),
k AS (SELECT request_id, p, unnest([
    {{'interval_type': 'VOLATILITY_ADAPTIVE_WIDE', 'target_coverage': 0.90::DOUBLE,
      'lo': CASE WHEN p < 10000 THEN p * 0.90::DOUBLE WHEN p < 25000 THEN p * 0.85::DOUBLE ELSE p * 0.70::DOUBLE END,
      'hi': CASE WHEN p < 10000 THEN p + 4000 WHEN p < 25000 THEN p + 12000 ELSE least(120000, greatest(p * 1.55::DOUBLE, p + 45000)) END}},
    {{'interval_type': 'ASYMMETRIC_RELATIVE_EMPIRICAL', 'target_coverage': 0.70::DOUBLE, 'lo': p * 0.85::DOUBLE, 'hi': p * 1.55::DOUBLE}},
    {{'interval_type': 'ADDITIVE_EMPIRICAL', 'target_coverage': 0.65::DOUBLE, 'lo': p - 5000, 'hi': p + 20000}},
    {{'interval_type': 'SYMMETRIC_RELATIVE', 'target_coverage': 0.48::DOUBLE, 'lo': p * 0.75::DOUBLE, 'hi': p * 1.25::DOUBLE}}], recursive := true)
  FROM q)
SELECT request_id, p AS predicted_closing_rank, {dec('greatest(1, lo)', 1)} AS lower_bound, {dec('hi', 1)} AS upper_bound,
  interval_type, target_coverage, {dec('hi - greatest(1, lo)', 1)} AS interval_width,
  CASE WHEN p > 0 THEN {dec('(hi - greatest(1, lo)) / p', 4)} ELSE 0 END AS relative_width FROM k""",
        "decision": f"""{_scored("error_code IS NULL AND program_type = 'ENGINEERING' AND candidate_rank > 0")}, d AS (
  SELECT request_id, {dec('lo', 1)} AS lo, {dec('p', 1)} AS p, {dec('hi', 1)} AS hi, pre, n FROM bounded),
e AS (SELECT *, CASE WHEN candidate_rank <= 0 THEN 'INVALID_CANDIDATE_RANK'
        WHEN program_type NOT IN ('ENGINEERING', 'ARCHITECTURE') THEN 'UNSUPPORTED_PROGRAM'
        WHEN program_type = 'ARCHITECTURE' THEN CASE WHEN error_code IN ('UNKNOWN_COLLEGE', 'UNKNOWN_BRANCH') THEN error_code
             WHEN own_program <> 'ARCHITECTURE' THEN 'PROGRAM_MISMATCH' END ELSE error_code END AS code FROM checked)
SELECT request_id, college_id, branch_id, academic_year, category, program_type, candidate_rank,
  CASE round WHEN 'TERMINAL' THEN 'R4' ELSE round END AS round,
  CASE WHEN code IS NULL THEN CASE WHEN p IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUCCESS' END END AS prediction_status,
  p AS predicted_closing_rank, CASE WHEN p IS NOT NULL THEN lo END AS lower_bound, CASE WHEN p IS NOT NULL THEN hi END AS upper_bound,
  CASE WHEN code IS NULL THEN CASE WHEN p IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN candidate_rank < lo THEN 'NUMERICALLY_BELOW_LOWER_BOUND'
       WHEN candidate_rank <= p THEN 'WITHIN_LOWER_HALF' WHEN candidate_rank <= hi THEN 'WITHIN_UPPER_HALF'
       ELSE 'NUMERICALLY_ABOVE_UPPER_BOUND' END END AS evidence_state,
  CASE WHEN code IS NULL THEN {_STRENGTH} END AS evidence_strength,
  CAST(CASE WHEN code IS NULL THEN CASE WHEN p IS NULL THEN 0 ELSE n + CASE WHEN pre IS NOT NULL THEN 1 ELSE 0 END END END AS INTEGER) AS observation_count,
  code AS error_code
FROM e LEFT JOIN d USING (request_id)""",
        "bt_windows": f"""{_tests('R1')} SELECT {_WINDOW}, count(*) AS total_test_combinations,
  count(*) FILTER (depth > 0) AS evaluated_combinations, count(*) FILTER (depth = 0) AS cold_start_combinations FROM tests GROUP BY ALL""",
        "bt_r1_points": f"{_tests('R1')} SELECT {_WINDOW}, model, {_POINT} FROM points GROUP BY ALL",
        "bt_r1_intervals": f"{_tests('R1')} SELECT {_WINDOW}, model, {_SPAN} FROM spans GROUP BY ALL",
        "bt_terminal": f"{_tests('TERMINAL')} SELECT {_WINDOW}, model, {_POINT} FROM points GROUP BY ALL",
        "bt_terminal_intervals": f"{_tests('TERMINAL')} SELECT {_WINDOW}, model, {_SPAN} FROM spans GROUP BY ALL",
        "bt_depth": f"""{_tests('R1')} SELECT {_WINDOW}, depth, {_POINT} FROM points
WHERE model = 'Baseline A (Lag-1 Latest)' GROUP BY ALL""",
        "leakage_violations": f"""{BASE} SELECT CAST(t AS INTEGER) AS target_year, count(*) AS train_records,
  count(*) FILTER (academic_year >= t) AS future_records, count(*) FILTER (round_code <> 'R1') AS other_rounds,
  count(*) FILTER (status <> 'PUBLISHED') AS unpublished_records
FROM range(1995, 2002) r(t) JOIN panel ON round_code = 'R1' AND academic_year < t GROUP BY 1""",
        "seat_correlation": f"""{FACTS}, held AS (
  SELECT college_id, coalesce(canonical_branch_id, branch_id) AS branch_id,
         coalesce(nullif(max(total_seats) FILTER (academic_year = 2001), 0), max(total_seats) FILTER (academic_year = 2000)) AS seats
  FROM seats JOIN branches USING (branch_id) GROUP BY ALL),
w AS (SELECT college_id, branch_id, max(closing_rank) FILTER (academic_year = 2001) AS now,
             max(closing_rank) FILTER (academic_year = 2000) AS before
      FROM cells WHERE round_code = 'R1' AND program_type = 'ENGINEERING' AND category = 'GM' GROUP BY ALL)
SELECT count(*) AS sample_size,
  CASE WHEN count(*) >= 10 THEN {dec('coalesce(corr(seats, abs(now - before)), 0)', 4)} END AS correlation_seats_to_prediction_error,
  CASE WHEN count(*) >= 10 THEN {dec('coalesce(corr(seats, now), 0)', 4)} END AS correlation_seats_to_closing_rank,
  CASE WHEN count(*) >= 10 THEN 'NEGLIGIBLE_PREDICTIVE_SIGNAL' ELSE 'INSUFFICIENT_DATA' END AS assessment
FROM w JOIN held USING (college_id, branch_id) WHERE now IS NOT NULL AND before IS NOT NULL AND seats IS NOT NULL""",
    }


_REGISTRY = f"""
good_colleges AS (SELECT {CODE.format('s_suppkey')} AS college_code FROM supplier WHERE s_acctbal >= 0)"""

_RAW_CUTOFFS = """
raw AS (
  SELECT line_id AS row_idx, college_code, branch_id AS branch_code, category_code,
    CASE WHEN round_code = 'KKR_SPECIAL' AND o_orderstatus = 'P' THEN 'R2' ELSE round_code END AS round_code,
    CASE WHEN l_discount > 0.02::DOUBLE THEN CAST(l_quantity AS INTEGER) * 2000 - 2000 END AS o,
    CAST(floor(l_extendedprice) AS INTEGER) * 3 - 15000 AS c, academic_year,
    college_code || '-' || source_version_id AS source_version_id FROM lines),
step1 AS (
  SELECT *, CASE WHEN college_code NOT IN (SELECT college_code FROM good_colleges) THEN 'UNKNOWN_COLLEGE_CODE'
      WHEN branch_code NOT IN ('ECONOMY', 'LARGE', 'STANDARD', 'MEDIUM', 'SMALL') THEN 'UNKNOWN_BRANCH_CODE'
      WHEN round_code = 'R2' THEN 'INVALID_COUNSELLING_ROUND' END AS early,
    CASE WHEN c <= 0 THEN 'INVALID_CLOSING_RANK' WHEN o <= 0 THEN 'INVALID_OPENING_RANK'
      WHEN o > c THEN 'OPENING_GREATER_THAN_CLOSING' END AS ranks FROM raw),
tagged AS (
  SELECT *, concat_ws(',', CASE WHEN early IS NULL AND category_code = 'HKR' THEN 'UNEXPECTED_CATEGORY' END,
                CASE WHEN early IS NULL AND ranks IS NULL AND c > 250000 THEN 'ANOMALOUS_HIGH_RANK' END) AS anomalies,
    CASE WHEN coalesce(early, ranks) IS NULL THEN row_number() OVER (
      PARTITION BY coalesce(early, ranks) IS NULL, college_code, branch_code, category_code, round_code, academic_year{batch}
      ORDER BY row_idx) END AS k FROM step1),
final AS (SELECT *, CASE WHEN k > 1 THEN 'DUPLICATE_LOGICAL_RECORD' ELSE coalesce(early, ranks, '') END AS error_codes, k IS NOT NULL AND k = 1 AS is_valid FROM tagged)"""


def _numeric(codes: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in codes.items()) + ")"


def _rules(raw: str, early: str, numeric: str, late: str, key: str) -> str:
    return f"""{BASE}, {_REGISTRY}, raw AS ({raw}),
a AS (SELECT *, {early} AS early, {numeric} AS each, {late} AS late FROM raw),
b AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN each <> '' THEN each ELSE coalesce(late, '') END AS err FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY err = '', {key} ORDER BY row_idx) AS k FROM b)
SELECT row_idx, CASE WHEN err = '' AND k > 1 THEN 'DUPLICATE_LOGICAL_RECORD' ELSE err END AS error_codes, '' AS anomalies,
  err = '' AND k = 1 AS is_valid FROM d"""


_KNOWN_BRANCH = "branch_code IN ('ECONOMY', 'LARGE', 'STANDARD', 'MEDIUM', 'SMALL')"

_DOCS = f"""
docs AS (
  SELECT {CODE.format('s_suppkey')} || '-' || v AS source_version_id,
    CASE WHEN s_nationkey < 12 THEN 'CUTOFF_PDF' WHEN s_nationkey < 22 THEN 'SEAT_MATRIX_PDF'
         WHEN s_nationkey < 24 THEN 'NOTIFICATION_PDF' ELSE 'UNKNOWN' END AS document_type,
    CASE WHEN s_nationkey % 2 = 0 THEN 'ENGINEERING' ELSE 'ARCHITECTURE' END AS program_type,
    (SELECT count(*) * 2 FROM lineitem WHERE l_suppkey = s_suppkey) AS baseline, s_acctbal < 500 AS corrigendum
  FROM supplier, (VALUES ('v1'), ('v2')) t(v)),
counted AS (
  SELECT d.*, coalesce(n, 0) AS candidate_records, coalesce(ok, 0) AS extracted_count
  FROM docs d LEFT JOIN (SELECT source_version_id, count(*) AS n, count(*) FILTER (is_valid) AS ok FROM final GROUP BY 1) USING (source_version_id)),
gate AS (
  SELECT *, CAST(CASE program_type WHEN 'ARCHITECTURE' THEN 4 ELSE 50 END AS INTEGER) AS minimum_rows,
    CASE WHEN corrigendum THEN NULL WHEN document_type = 'UNKNOWN' THEN 'UNKNOWN_DOCUMENT_TYPE'
      WHEN document_type = 'NOTIFICATION_PDF' THEN NULL WHEN extracted_count <= 0 THEN 'SUSPICIOUS_LOW_COUNT'
      WHEN document_type = 'CUTOFF_PDF' AND program_type = 'ENGINEERING' AND baseline > 100
       AND extracted_count < floor(baseline * 0.3::DOUBLE) THEN 'SUSPICIOUS_LOW_COUNT'
      WHEN extracted_count < CASE program_type WHEN 'ARCHITECTURE' THEN 4 ELSE 50 END THEN 'SUSPICIOUS_LOW_COUNT' END AS error_code
  FROM counted),
outcome AS (
  SELECT *, candidate_records - extracted_count AS rejected_records,
    CASE WHEN document_type = 'SEAT_MATRIX_PDF' AND candidate_records > extracted_count THEN 'VALIDATION_FAILED' ELSE error_code END AS failure_reason
  FROM gate)"""

_FACTS_OF = """
{name} AS (SELECT college_id, branch_id, category_code, round_code, academic_year, source_version_id,
  CAST(floor(min(l_extendedprice)) AS INTEGER) AS opening_rank, CAST(floor(max(l_extendedprice)) AS INTEGER) AS closing_rank
  FROM lines WHERE {where} GROUP BY ALL)"""

_KEY = "college_id, branch_id, category_code, round_code, academic_year"

_PUBLISH = f"""{BASE}, {_FACTS_OF.format(name='store', where="source_version_id = 'v1' OR o_orderstatus <> 'O'")},
{_FACTS_OF.format(name='inc', where="source_version_id = 'v2'")},
res AS (
  SELECT i.*, CASE WHEN i.academic_year = 1999 AND i.round_code = 'R4' THEN 'UNKNOWN_COUNSELLING_ROUND'
      WHEN s.closing_rank IS NULL THEN 'PUBLISHED' WHEN s.closing_rank <> i.closing_rank THEN 'FACTUAL_MUTATION_REJECTED'
      ELSE 'UNCHANGED' END AS outcome
  FROM inc i LEFT JOIN store s USING ({_KEY}, source_version_id))"""

_FOUND = """
found AS (
  SELECT upper(p_name[1] || split_part(p_name, ' ', -1)[1]) AS branch_code,
    max(p_name || CASE p_type WHEN 'ECONOMY' THEN ' and Planning' WHEN 'LARGE' THEN ' Architecture'
                              WHEN 'SMALL' THEN ' Bachelor of Design' ELSE '' END) AS branch_name
  FROM part GROUP BY 1)"""


def _program(name: str) -> str:
    return f"""CASE WHEN branch_code = 'AT' OR contains(upper({name}), 'ARCHITECTURE') THEN 'ARCHITECTURE'
  WHEN branch_code IN ('BD', 'BDC', 'BI', 'BIN', 'DC', 'DF', 'DI', 'DL') OR contains(upper({name}), 'BACHELOR OF DESIGN')
    OR contains(upper({name}), 'B. DESIGN') THEN 'DESIGN'
  WHEN branch_code IN ('BP', 'BPL', 'IMP') OR contains(upper({name}), 'PLANNING') THEN 'OTHER' ELSE 'ENGINEERING' END"""


_CANONICAL = "branch_code NOT IN ('BDC', 'BIN', 'BPL', 'ECV', 'ECS', 'CM')"


def quality() -> dict[str, str]:
    rules = _RAW_CUTOFFS.format(batch="")
    by_doc = _RAW_CUTOFFS.format(batch=", source_version_id")
    fee = {
        c: f"CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS DECIMAL(20,4)) IS NULL THEN 'NON_NUMERIC_{c.upper()}' "
        f"WHEN TRY_CAST({c} AS DECIMAL(20,4)) < 0 THEN 'INVALID_{c.upper()}' END"
        for c in ("total_fee", "tuition_fee", "other_fee")
    }
    total, share, tax = ("CAST(round(p_retailprice * 100) AS BIGINT)", "CAST(round(l_discount * 100) AS BIGINT)",
                         "CAST(round(l_tax * 100) AS BIGINT)")
    qty = "CAST(l_quantity AS INTEGER)"
    return {
        "dq_cutoff": f"{BASE}, {_REGISTRY}, {rules} SELECT row_idx, error_codes, anomalies, is_valid FROM final",
        "dq_errors": f"""{BASE}, {_REGISTRY}, {rules}
SELECT 'CUTOFF' AS entity_type, error_code, severity, count(*) AS found FROM (
  SELECT error_codes AS error_code, 'ERROR' AS severity FROM final WHERE error_codes <> ''
  UNION ALL SELECT unnest(string_split(anomalies, ',')), 'WARNING' FROM final WHERE anomalies <> '') GROUP BY ALL""",
        "dq_seat": _rules(
            """SELECT line_id AS row_idx, CASE WHEN l_tax < 0.005::DOUBLE THEN '' ELSE college_code END AS college_code,
  CASE WHEN l_tax BETWEEN 0.005::DOUBLE AND 0.015::DOUBLE THEN NULL ELSE branch_id END AS branch_code,
  nullif(round_code, 'MOCK') AS counselling_round, nullif(category_code, 'HKR') AS category_code, academic_year,
  CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS INTEGER) - 2 END AS total_seats,
  CASE WHEN l_linestatus <> 'O' THEN l_linenumber * 5 - 6 END AS vacant_seats,
  CASE WHEN l_discount > 0.045::DOUBLE THEN l_linenumber END AS gm_seats,
  CASE WHEN l_discount > 0.015::DOUBLE THEN CAST(l_quantity AS INTEGER) % 9 - 1 END AS kkr_seats FROM lines""",
            f"""CASE WHEN college_code = '' THEN 'MISSING_COLLEGE_CODE' WHEN branch_code IS NULL THEN 'MISSING_BRANCH_CODE'
  WHEN total_seats IS NULL AND vacant_seats IS NULL THEN 'MISSING_SEAT_VALUES'
  WHEN college_code NOT IN (SELECT college_code FROM good_colleges) THEN 'UNKNOWN_COLLEGE_CODE'
  WHEN NOT {_KNOWN_BRANCH} THEN 'UNKNOWN_BRANCH_CODE' END""",
            _numeric({f"INVALID_{c.upper()}": f"{c} < 0" for c in ("total_seats", "vacant_seats", "gm_seats", "kkr_seats")}),
            """CASE WHEN vacant_seats > total_seats THEN 'VACANCY_EXCEEDS_TOTAL_SEATS'
  WHEN gm_seats + kkr_seats > total_seats THEN 'SEAT_SUM_EXCEEDS_TOTAL'
  WHEN gm_seats + kkr_seats > vacant_seats THEN 'SEAT_SUM_EXCEEDS_VACANCY' END""",
            "college_code, branch_code, counselling_round, category_code, academic_year",
        ),
        "dq_fee": _rules(
            f"""SELECT line_id AS row_idx, CASE WHEN {qty} = 3 THEN NULL ELSE college_code END AS college_code,
  CASE WHEN {qty} = 4 THEN '' ELSE branch_id END AS branch_code, academic_year,
  CASE {qty} WHEN 5 THEN NULL WHEN 6 THEN 'n/a' WHEN 7 THEN '-100' ELSE CAST({total} AS VARCHAR) END AS total_fee,
  CASE {qty} WHEN 8 THEN 'x' WHEN 9 THEN CAST({total} + 1 AS VARCHAR) WHEN 10 THEN NULL
       ELSE CAST({total} - {share} * 900 AS VARCHAR) END AS tuition_fee,
  CASE WHEN {qty} = 11 THEN '-1' WHEN {qty} IN (8, 12) THEN 'y' ELSE CAST({share} * 900 + ({tax} - 4) * 30 AS VARCHAR) END AS other_fee
FROM lines""",
            f"""CASE WHEN college_code IS NULL THEN 'MISSING_COLLEGE_CODE' WHEN total_fee IS NULL THEN 'MISSING_TOTAL_FEE'
  WHEN college_code NOT IN (SELECT college_code FROM good_colleges) THEN 'UNKNOWN_COLLEGE_CODE'
  WHEN branch_code <> '' AND NOT {_KNOWN_BRANCH} THEN 'UNKNOWN_BRANCH_CODE' END""",
            f"concat_ws(',', {', '.join(fee.values())})",
            """CASE WHEN TRY_CAST(tuition_fee AS DECIMAL(20,4)) > TRY_CAST(total_fee AS DECIMAL(20,4)) THEN 'TUITION_EXCEEDS_TOTAL_FEE'
  WHEN TRY_CAST(other_fee AS DECIMAL(20,4)) > TRY_CAST(total_fee AS DECIMAL(20,4)) THEN 'OTHER_FEE_EXCEEDS_TOTAL_FEE'
  WHEN abs(TRY_CAST(tuition_fee AS DECIMAL(20,4)) + TRY_CAST(other_fee AS DECIMAL(20,4)) - TRY_CAST(total_fee AS DECIMAL(20,4))) > 100
  THEN 'FEE_COMPONENTS_MISMATCH' END""",
            "college_code, branch_code, academic_year",
        ),
        "dq_completeness": f"""{BASE}, {_REGISTRY}, {by_doc}, {_DOCS}
SELECT source_version_id, document_type, program_type, candidate_records, extracted_count, rejected_records, minimum_rows,
  error_code, failure_reason, CASE WHEN failure_reason IS NULL THEN 'PUBLISHED' ELSE 'NEEDS_REVIEW' END AS processing_status
FROM outcome""",
        "dq_publishable": f"""{BASE}, {_REGISTRY}, {by_doc}, {_DOCS}
SELECT source_version_id, count(*) AS publishable FROM final JOIN outcome USING (source_version_id)
WHERE is_valid AND failure_reason IS NULL GROUP BY 1""",
        "dq_audit": f"""{FACTS}
SELECT 'college_suspicious' AS check, count(*) AS violations FROM colleges
  WHERE regexp_matches(college_code, '(?i)^(TEST|COLLEGE|CODE|UNKNOWN|SAMPLE|DUMMY)') OR regexp_matches(college_name, '(?i)(TEST|SAMPLE|DUMMY|COLLEGE NAME)')
UNION ALL SELECT 'college_placeholder', count(*) FROM colleges
  WHERE regexp_matches(college_code || ' ' || college_name, '(?i)^(COLLEGECODE|COLLEGE|BRANCH|COURSE|CODE|UNKNOWN|TEST|SAMPLE|DUMMY)')
UNION ALL SELECT 'branch_suspicious', count(*) FROM branches WHERE regexp_matches(branch_name, '(?i)(TEST|SAMPLE|DUMMY)')
UNION ALL SELECT 'branch_placeholder', count(*) FROM branches
  WHERE regexp_matches(branch_code, '(?i)^(COLLEGECODE|COLLEGE|BRANCH|COURSE|CODE|UNKNOWN|TEST|SAMPLE|DUMMY)')
UNION ALL SELECT 'cutoff_opening_above_closing', count(*) FROM cutoffs WHERE opening_rank > closing_rank
UNION ALL SELECT 'cutoff_not_positive', count(*) FROM cutoffs WHERE closing_rank <= 0
UNION ALL SELECT 'cutoff_missing_key', count(*) FROM cutoffs WHERE college_id IS NULL OR branch_id IS NULL OR round_code IS NULL
UNION ALL SELECT 'seat_negative', count(*) FROM seats WHERE total_seats < 0 OR vacant_seats < 0
UNION ALL SELECT 'seat_vacant_above_total', count(*) FROM seats WHERE vacant_seats > total_seats
UNION ALL SELECT 'seat_missing_key', count(*) FROM seats WHERE college_id IS NULL OR branch_id IS NULL
UNION ALL SELECT 'fee_negative', count(*) FROM fees WHERE total_fee < 0 UNION ALL SELECT 'fee_zero', count(*) FROM fees WHERE total_fee = 0
UNION ALL SELECT 'college_duplicate_code', count(*) FROM (SELECT college_code FROM colleges GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'branch_duplicate_code', count(*) FROM (SELECT branch_code FROM branches GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'cutoff_duplicate_key', count(*) FROM (SELECT {_KEY} FROM cutoffs GROUP BY ALL HAVING count(*) > 1)""",
        "dq_orphans": f"""{BASE}, {REQUESTS} SELECT request_id, r.college_id FROM reqs r
WHERE r.college_id NOT IN (SELECT college_id FROM colleges)""",
        "publish_outcome": f"{_PUBLISH} SELECT * FROM res",
        "publish_state": f"""{_PUBLISH}
SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM res r WHERE r.outcome = 'PUBLISHED' AND r.college_id = s.college_id AND r.branch_id = s.branch_id
    AND r.category_code = s.category_code AND r.round_code = s.round_code AND r.academic_year = s.academic_year)
  THEN 'SUPERSEDED' ELSE 'PUBLISHED' END AS status FROM store s
UNION ALL SELECT * EXCLUDE (outcome), 'PUBLISHED' FROM res WHERE outcome = 'PUBLISHED'""",
        "publish_report": f"""{_PUBLISH}
SELECT source_version_id, count(*) AS candidate_records, count(*) FILTER (outcome = 'PUBLISHED') AS published_records,
  count(*) FILTER (outcome = 'UNCHANGED') AS verified_unchanged_records,
  count(*) FILTER (outcome = 'FACTUAL_MUTATION_REJECTED') AS rejected_records,
  count(*) FILTER (outcome = 'UNKNOWN_COUNSELLING_ROUND') AS unknown_dimensions,
  (SELECT count(*) FROM store JOIN res n USING ({_KEY}) WHERE n.outcome = 'PUBLISHED') AS superseded_records
FROM res GROUP BY 1""",
        "publish_seats": f"""{FACTS} SELECT record_id, college_id, branch_id, academic_year, round_code, total_seats, vacant_seats,
  source_version_id, status FROM seats WHERE source_version_id <> 'v1' AND round_code IS NOT NULL""",
        "publish_fees": f"""{FACTS}, v AS (SELECT *, CASE WHEN total_fee % 200 < 100 THEN 'v1' ELSE 'v2' END AS source_version_id FROM fees)
SELECT * FROM v WHERE academic_year > 1998 AND source_version_id = 'v1'""",
        "college_upsert": f"""WITH {COLLEGES}, c AS (SELECT *, CAST(split_part(location, '_', 2) AS INTEGER) AS n FROM colleges)
SELECT college_code, college_name, original_name, location,
  CASE WHEN n < 3 THEN institution_type WHEN n < 8 THEN 'MEDICAL' ELSE institution_type END AS institution_type,
  CASE WHEN n >= 15 THEN 'INSERTED' WHEN n < 3 THEN 'KEPT' WHEN n < 8 THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome
FROM (SELECT college_code, college_name, original_name, CASE WHEN n < 3 THEN NULL ELSE location END AS location, institution_type, n FROM c)""",
        "branch_classify": f"""WITH {_FOUND}, alias(a, c) AS (VALUES ('BDC', 'DC'), ('BIN', 'BI'), ('BPL', 'BP'), ('ECV', 'ED'), ('ECS', 'EC'))
SELECT branch_code, branch_name, {_program('branch_name')} AS program_type, {_CANONICAL} AS is_canonical,
  (SELECT c FROM alias WHERE a = branch_code AND c IN (SELECT branch_code FROM found)) AS canonical_code FROM found""",
        "branch_upsert": f"""WITH {_FOUND} SELECT branch_code, branch_name,
  CASE WHEN branch_code >= 'S' THEN 'ENGINEERING' ELSE {_program('branch_name')} END AS program_type,
  CASE WHEN branch_code >= 'S' THEN true ELSE {_CANONICAL} END AS is_canonical, CAST(NULL AS VARCHAR) AS canonical_code,
  CASE WHEN branch_code <= 'M' THEN 'INSERTED' WHEN branch_code >= 'S' THEN 'KEPT'
       WHEN {_program('branch_name')} <> 'ENGINEERING' OR NOT {_CANONICAL} THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome FROM found""",
        "round_remap": f"""{BASE} SELECT academic_year, CASE WHEN academic_year <= 1996 AND round_code = 'MOCK' THEN 'R1'
  WHEN academic_year <= 1996 AND round_code = 'R3' THEN 'R4' ELSE round_code END AS round_code, count(*) AS records
FROM cutoffs GROUP BY ALL""",
        "type_backfill": f"""WITH {COLLEGES} SELECT college_code, CASE college_code WHEN 'S00001' THEN 'MEDICAL' WHEN 'S00002' THEN 'DENTAL'
  ELSE CASE WHEN starts_with(college_code, 'S0000') THEN 'ARCHITECTURE' ELSE institution_type END END AS institution_type FROM colleges""",
        "review_upsert": f"""{OPS}, late AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, document_url ORDER BY created_at DESC, item_id DESC) AS k
  FROM reviews WHERE created_at >= TIMESTAMP '2024-01-16'),
old AS (SELECT * FROM reviews WHERE created_at < TIMESTAMP '2024-01-16')
SELECT o.item_id, o.source_id, o.document_url, coalesce(l.failure_reason, o.failure_reason) AS failure_reason, o.status,
  CASE WHEN l.item_id IS NOT NULL THEN 'again' ELSE 'first' END AS review_notes
FROM old o LEFT JOIN late l ON l.k = 1 AND o.status = 'PENDING_REVIEW' AND l.source_id = o.source_id AND l.document_url = o.document_url
UNION ALL SELECT item_id, source_id, document_url, failure_reason, 'PENDING_REVIEW', 'again' FROM late l
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.status = 'PENDING_REVIEW' AND o.source_id = l.source_id AND o.document_url = l.document_url)""",
        "review_moves": f"""{OPS} SELECT item_id, source_id, document_url, failure_reason,
  CASE status WHEN 'PENDING_REVIEW' THEN 'APPROVED' ELSE status END AS status,
  CASE status WHEN 'PENDING_REVIEW' THEN source_id END AS reviewed_by,
  CASE WHEN status = 'PENDING_REVIEW' AND source_id < '5' THEN document_url || ' | seen' ELSE document_url END AS review_notes FROM reviews""",
    }


def _any(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_CUTOFF_WORDS = ("cut-off", "cutoff", "cut_off", "cut off")


def _doc_type(s: str) -> str:
    return f"""CASE WHEN {_any(s, _CUTOFF_WORDS)} THEN 'CUTOFF_PDF' WHEN {_any(s, ('vacant', 'vacancy'))} THEN 'VACANT_SEATS_PDF'
  WHEN contains({s}, 'seat') AND {_any(s, ('matrix', 'allocation', 'allotment', 'available'))} THEN 'SEAT_MATRIX_PDF'
  WHEN {_any(s, ('fee', 'tuition'))} THEN 'FEE_STRUCTURE_PDF'
  WHEN {_any(s, ('branches offered', 'branch code', 'courses offered'))} THEN 'BRANCHES_OFFERED_PDF'
  WHEN {_any(s, ('notification', 'guideline', 'process', 'instruction', 'procedure', 'brochure', 'information bulletin'))} THEN 'NOTIFICATION_PDF'
  WHEN contains({s}, 'member-institutions') THEN 'MEMBER_INSTITUTIONS_HTML' WHEN contains({s}, 'be-colleges') THEN 'BE_COLLEGES_HTML'
  WHEN contains({s}, 'counselling-document') THEN 'COUNSELLING_PORTAL_HTML' ELSE 'UNKNOWN' END"""


def _guess(s: str) -> str:
    return f"""CASE WHEN {_any(s, _CUTOFF_WORDS)} THEN 'CUTOFF_PDF' WHEN {_any(s, ('seat', 'vacant'))} THEN 'SEAT_MATRIX_PDF'
  WHEN contains({s}, 'fee') THEN 'FEE_STRUCTURE_PDF' WHEN {_any(s, ('notification', 'guide', 'process'))} THEN 'NOTIFICATION_PDF'
  WHEN {_any(s, ('branch', 'course'))} THEN 'BRANCHES_OFFERED_PDF' ELSE 'OTHER' END"""


_NW = r"[^\p{L}\p{N}_]"


def _year(s: str) -> str:
    return f"CAST(coalesce(nullif(regexp_extract({s}, '(?:^|{_NW})(202[0-9])(?:{_NW}|$)', 1), ''), '2026') AS INTEGER)"


def _round(s: str) -> str:
    t = f"translate({s}, '_-', '  ')"

    def word(k: int) -> str:
        return f"regexp_matches({t}, '(?:^|{_NW})(?:round\\s*{k}|r\\s*{k})(?:{_NW}|$)')"

    return f"""CASE WHEN contains({t}, 'mock') THEN 'MOCK' WHEN {_any(t, ('kkr special', 'r2 kkr', 'phase 1', 'phase1'))} THEN 'KKR_SPECIAL'
  WHEN {_any(t, ('phase 2', 'phase2'))} THEN 'R2_PHASE2' WHEN {word(1)} THEN 'R1' WHEN {word(3)} THEN 'R3' WHEN {word(4)} THEN 'R4'
  WHEN {_any(t, ('all rounds', 'consolidated'))} THEN CASE WHEN {_year(s)} = 2025 THEN 'R4' ELSE 'CONSOLIDATED_FINAL' END
  WHEN {word(2)} OR contains({t}, 'kkr') THEN 'KKR_SPECIAL' END"""


_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_GRID = f"""{BASE}, g AS (
  SELECT college_id, branch_id, category_code, academic_year, round_code, source_version_id, CAST(floor(max(l_extendedprice)) AS INTEGER) AS closing
  FROM lines GROUP BY ALL)"""


def _grid_select(layout: str, category: str, name: str, where: str) -> str:
    return f"""{_GRID} SELECT college_id || '-' || academic_year || '-' || source_version_id AS doc_id, '{layout}' AS layout, {CODE.format('CAST(college_id AS BIGINT)')} AS college_code,
  'Supplier ' || college_id AS college_name, {category} AS category_code, {name[0]} AS branch_code, {name[1]} AS branch_name, academic_year,
  round_code, CAST(closing AS BIGINT) AS closing_rank, CAST(1 AS INTEGER) AS page_number FROM g WHERE closing > 0 AND {where}"""


_SEATS_READ = f"""{FACTS}, r AS (
  SELECT *, {CODE.format('CAST(college_id AS BIGINT)')} AS college_code, total_seats - vacant_seats AS rest,
    {CODE.format('CAST(college_id AS BIGINT)')} || '_' || branch_id || '_1_1' AS row_identifier FROM seats),
read AS (
  SELECT *, CASE WHEN academic_year >= 2000 THEN total_seats END AS total,
    CASE academic_year WHEN 1995 THEN CASE WHEN vacant_seats % 5 <> 0 THEN vacant_seats END WHEN 1996 THEN vacant_seats
      WHEN 1997 THEN rest + vacant_seats WHEN 1998 THEN total_seats
      WHEN 1999 THEN CASE WHEN total_seats % 3 = 0 THEN rest + vacant_seats ELSE total_seats END END AS vacant,
    CASE WHEN academic_year >= 1997 THEN rest END AS gm,
    CASE WHEN academic_year IN (1996, 1999, 2000, 2001) OR (academic_year = 1997 AND vacant_seats > 0) THEN vacant_seats END AS kkr,
    CASE WHEN academic_year = 1996 THEN 'KKR' END AS cat FROM r)"""


def documents() -> dict[str, str]:
    ctx = """CASE s_nationkey % 5 WHEN 0 THEN 'Engineering Cut-Off Ranks after Round 1' WHEN 1 THEN 'Vacant Seats after Round-3 2024'
      WHEN 2 THEN 'B.Arch Fee Structure 2025 after all rounds' WHEN 3 THEN 'Counselling process of the Mock Allotment' ELSE 'General news' END"""
    year = "CASE WHEN s_suppkey % 4 = 0 THEN 24 ELSE 2023 + s_suppkey % 3 END"
    return {
        "anchors": """SELECT page_id, CAST(k - 1 AS INTEGER) AS position, href, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS url, t AS link_text, t AS parent_text
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS t,
             generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS k FROM pages)""",
        "links": f"""WITH a AS (
  SELECT s_suppkey, s_suppkey // 50 AS page_id, {ctx} AS ctx, s_suppkey % 31 + 1 AS d, s_suppkey % 12 + 1 AS m, {year} AS y,
    CASE WHEN s_suppkey % 2 = 0 THEN 'File ' || s_suppkey % 10 ELSE 'Document number ' || s_suppkey END AS label,
    CASE WHEN s_suppkey % 3 = 0 THEN 'https://portal.example.org/files/doc-' || s_suppkey % 70 || '.pdf'
         ELSE 'https://portal.example.org/docs/notice.html?id=' || s_suppkey END AS url,
    row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) - 1 AS position
  FROM supplier),
b AS (SELECT *, ctx || ' ' || label || ' Notified on ' || d || '.' || m || '.' || y AS parent FROM a WHERE s_suppkey % 7 > 1),
c AS (SELECT *, parent || ' ' || label AS both, lower(parent || ' ' || label) AS s FROM b),
f AS (SELECT * FROM c WHERE url LIKE '%.pdf' OR {_any('s', _CUTOFF_WORDS + ('seat', 'fee', 'notification', 'counselling'))}
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, position) = 1)
SELECT url, page_id, CAST(position AS INTEGER) AS position, CASE WHEN length(label) > 10 THEN label ELSE parent END AS title, {_doc_type('s')} AS document_type,
  {_guess('s')} AS guessed_type, {_year('s')} AS academic_year, {_round('s')} AS counselling_round,
  TRY_CAST(printf('%04d-%02d-%02d', CASE WHEN y < 100 THEN y + 2000 ELSE y END, m, d) AS DATE) AS publication_date FROM f""",
        "html_tables": f"""SELECT {CODE.format('s_suppkey')} AS college_code, 'Supplier College of ' || split_part(s_name, '#', 2) AS college_name,
  replace(s_name, '#', ' college of ') AS original_name, upper(n_name[1]) || lower(n_name[2:]) AS location, 'ENGINEERING' AS institution_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
        "branch_tables": """SELECT upper(p_name[1] || split_part(p_name, ' ', -1)[1]) || p_size % 10 AS branch_code, arg_max(p_name, p_partkey) AS branch_name
FROM part GROUP BY 1""",
        "doc_class": f"""SELECT doc_id, {_doc_type('lower(text)')} AS document_type, {_guess('lower(text)')} AS guessed_type, {_round('lower(text)')} AS round_code,
  {_year('lower(text)')} AS academic_year, CASE WHEN {_any('lower(text)', ('architecture', 'b.arch', 'barch', 'b arch', 'nata'))} THEN 'ARCHITECTURE' ELSE 'ENGINEERING' END AS program_type
FROM documents""",
        "round_names": """WITH l AS (SELECT DISTINCT unnest([o_orderpriority, (['Round 1', 'mock allotment', 'ROUND 2 PHASE 1', 'Round 2 Phase 2', 'r2', 'after all rounds',
  'Round-3', 'R4', '%%'])[1 + o_orderkey % 9]]) AS label FROM orders)
SELECT label, CASE label WHEN 'Round 1' THEN 'R1' WHEN 'mock allotment' THEN 'MOCK' WHEN 'ROUND 2 PHASE 1' THEN 'KKR_SPECIAL' WHEN 'Round 2 Phase 2' THEN 'R2_PHASE2'
    WHEN 'r2' THEN 'KKR_SPECIAL' WHEN 'after all rounds' THEN 'CONSOLIDATED_FINAL' WHEN 'Round-3' THEN 'R3' WHEN 'R4' THEN 'R4' WHEN '%%' THEN 'UNKNOWN'
    ELSE regexp_replace(upper(label), '[^A-Z0-9]', '', 'g') END AS round_code,
  CASE label WHEN 'Round 1' THEN 'Round 1' WHEN 'mock allotment' THEN 'Mock Round' WHEN 'ROUND 2 PHASE 1' THEN 'Round 2 Phase 1 KKR Special Allotment'
    WHEN 'Round 2 Phase 2' THEN 'Round 2 Phase 2' WHEN 'r2' THEN 'Round 2 KKR Special Allotment' WHEN 'after all rounds' THEN 'Consolidated Cutoff After All Rounds'
    WHEN 'Round-3' THEN 'Round 3' WHEN 'R4' THEN 'Round 4' ELSE label END AS round_name,
  CAST(CASE label WHEN 'Round 1' THEN 1 WHEN 'mock allotment' THEN 0 WHEN 'ROUND 2 PHASE 1' THEN 2 WHEN 'Round 2 Phase 2' THEN 2 WHEN 'r2' THEN 2
    WHEN 'Round-3' THEN 3 WHEN 'R4' THEN 4 ELSE 99 END AS INTEGER) AS round_number FROM l""",
        "name_rules": f"""WITH p AS (SELECT *, trim(regexp_replace(' ' || p_name || '  of b.m.s. AND ' || p_type || ' at  ' || p_brand || '- ion', '{_SPACE}', ' ', 'g')) AS c FROM part),
w AS (SELECT *, string_split(c, ' ') AS ws FROM p),
n AS (SELECT *, array_to_string(list_transform(ws, lambda x: CASE WHEN upper(x) = 'B.M.S.' THEN 'B.M.S.' WHEN lower(x) IN ('of', 'and', 'at') THEN lower(x)
       ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS name FROM w)
SELECT p_partkey, c AS cleaned, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS code, upper(name[1]) || name[2:] AS college_name,
  array_to_string(list_transform(ws, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS location,
  p_name || 'ion & ' || p_type || '-Design' AS branch_name, CASE WHEN p_size % 2 = 0 THEN 'GM' ELSE p_type END AS category,
  CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS digits, p_size % 3 <> 0 AS is_url, format('{{:,}}', p_partkey * 1234) AS thousands FROM n""",
        "doc_integrity": """WITH r AS (SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN strlen(html) > 52428800 THEN 'exceeds maximum size limit'
  WHEN page_id % 3 = 0 AND NOT starts_with(html, '%PDF-') THEN CASE WHEN regexp_matches(lower(html[1:200]), '<html|<!doctype|error')
    THEN 'returned HTML content' ELSE 'not a PDF' END END AS reason FROM pages) SELECT page_id, reason IS NULL AS is_ok, reason FROM r""",
        "fingerprint_dedup": """WITH h AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY source, content_hash ORDER BY doc_id) = 1 AS is_new FROM h)
SELECT *, CASE WHEN is_new THEN count(*) FILTER (is_new) OVER (PARTITION BY source ORDER BY doc_id) END AS version_no FROM f""",
        "not_archived": """WITH h AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents)
SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h a WHERE a.doc_id % 3 = 0 AND a.source = h.source AND a.content_hash = h.content_hash)""",
        "usable_text": """SELECT doc_id, CASE WHEN CASE WHEN doc_id % 2 = 0 THEN length(split_part(text, chr(10), 1)) < 100 ELSE length(text) < 50 END THEN 'NEEDS_REVIEW' ELSE 'PARSED' END AS status FROM documents""",
        "grid_wide": _grid_select("WIDE", "category_code", ("branch_id", "upper(branch_id[1]) || lower(branch_id[2:]) || ' Engineering'"), "true"),
        "grid_vertical": _grid_select("VERTICAL", "'GM'", ("branch_id", "branch_id || ' Communication & Systems'"), "category_code = 'GM' AND closing % 11 <> 0"),
        "grid_categories": _grid_select("CATEGORIES", "category_code", ("branch_id[1:4]", "branch_id"), "category_code IN ('GM', 'KKR')"),
        "seat_grid": f"""{_SEATS_READ} SELECT college_code, branch_id AS branch_code, academic_year, round_code AS counselling_round, total AS total_seats, vacant AS vacant_seats,
  gm AS gm_seats, kkr AS kkr_seats, cat AS category_code, row_identifier FROM read WHERE coalesce(total, vacant) IS NOT NULL""",
        "fee_grid": f"""{_SEATS_READ} SELECT college_code, branch_id AS branch_code, academic_year, row_identifier,
  CAST(CASE WHEN academic_year = 2000 AND total_seats % 2 <> 0 THEN total_seats * 1000 + vacant_seats * 10 ELSE total_seats * 1000 END AS DOUBLE) AS total_fee,
  CAST(total_seats * 1000 AS DOUBLE) AS tuition_fee, CAST(CASE WHEN academic_year = 2000 THEN vacant_seats * 10 END AS DOUBLE) AS other_fee FROM read WHERE academic_year >= 2000""",
        "grid_states": f"""{_SEATS_READ} SELECT college_id || '-' || academic_year AS doc_id, academic_year, count(*) FILTER (coalesce(total, vacant) IS NOT NULL) AS row_count,
  count(*) FILTER (coalesce(total, vacant) IS NULL) AS error_count,
  CASE WHEN count(*) FILTER (coalesce(total, vacant) IS NULL) = 0 THEN 'PARSED' ELSE 'NEEDS_REVIEW' END AS status FROM read GROUP BY college_id, academic_year""",
        "source_sync": f"""{OPS}, conf AS (
  SELECT CASE WHEN n_nationkey < 10 THEN 'SRC-' ELSE 'NEW-' END || n_nationkey AS code, CASE WHEN n_nationkey < 20 THEN 'http://' ELSE 'http://n/' END || n_nationkey AS u, n_name FROM nation),
m AS (SELECT conf.*, coalesce(a.source_id, b.source_id) AS id FROM conf LEFT JOIN sources a ON a.source_code = code LEFT JOIN sources b ON 'http://' || b.source_id = u),
best AS (SELECT id, max(code) AS code, arg_max(n_name, code) AS n_name FROM m WHERE id IS NOT NULL GROUP BY id)
SELECT CASE WHEN id IS NULL THEN source_code ELSE code END AS source_code, 'http://' || source_id AS url, CASE WHEN id IS NULL THEN title ELSE n_name END AS title,
  CASE WHEN id IS NULL THEN 'LOW' ELSE 'HIGH' END AS authority_level, id IS NOT NULL OR is_enabled AS is_enabled,
  CAST(CASE WHEN id IS NULL THEN check_frequency_hours ELSE 12 END AS INTEGER) AS check_frequency_hours, CASE WHEN id IS NULL THEN 'OTHER' ELSE 'CUTOFF_PDF' END AS document_type,
  CASE WHEN id IS NULL THEN 'v1' ELSE 'v2' END AS parser_version, CASE WHEN id IS NULL THEN 'KEPT' ELSE 'UPDATED' END AS outcome
FROM sources LEFT JOIN best ON id = source_id
UNION ALL SELECT code, u, n_name, 'HIGH', true, 12, 'CUTOFF_PDF', 'v2', 'INSERTED' FROM m WHERE id IS NULL""",
        "seed_rounds": f"""{BASE}, seen AS (SELECT DISTINCT academic_year, round_code FROM cutoffs WHERE academic_year < 1999),
cal AS (SELECT CAST(y AS INTEGER) AS academic_year, c AS round_code, n AS round_name, CAST(k AS INTEGER) AS round_number, c <> 'KKR_SPECIAL' AS g FROM range(1995, 2002) t(y),
  (VALUES ('MOCK', 'Mock Round', 0), ('R1', 'Round 1', 1), ('KKR_SPECIAL', 'Round 2 KKR Special Allotment', 2), ('R3', 'Round 3', 3), ('R4', 'Round 4', 4)) r(c, n, k))
SELECT academic_year, round_code, CASE WHEN s.academic_year IS NOT NULL THEN round_code ELSE round_name END AS round_name,
  CAST(CASE WHEN s.academic_year IS NOT NULL THEN 9 ELSE round_number END AS INTEGER) AS round_number, g AS is_general_round
FROM cal LEFT JOIN seen s USING (academic_year, round_code)""",
        "document_report": f"""{BASE}, {_REGISTRY}, {_RAW_CUTOFFS.format(batch=', source_version_id')}, {_DOCS}, n AS (
  SELECT source_version_id, CAST(sum(CASE WHEN anomalies = '' THEN 0 ELSE len(string_split(anomalies, ',')) END) AS BIGINT) AS needs_review_records,
    count(DISTINCT college_code) FILTER (is_valid) AS unique_college_count, count(DISTINCT branch_code) FILTER (is_valid) AS unique_branch_count,
    count(DISTINCT category_code) FILTER (is_valid) AS category_count FROM final GROUP BY 1)
SELECT source_version_id, candidate_records, extracted_count AS validated_records, rejected_records, coalesce(needs_review_records, 0) AS needs_review_records,
  coalesce(unique_college_count, 0) AS unique_college_count, coalesce(unique_branch_count, 0) AS unique_branch_count, coalesce(category_count, 0) AS category_count,
  CASE WHEN failure_reason IS NULL THEN 'PUBLISHED' ELSE 'NEEDS_REVIEW' END AS processing_status FROM outcome LEFT JOIN n USING (source_version_id)""",
        "run_report": f"""{BASE}, {_REGISTRY}, {_RAW_CUTOFFS.format(batch=', source_version_id')}, {_DOCS}, n AS (
  SELECT sum(CASE WHEN anomalies = '' THEN 0 ELSE len(string_split(anomalies, ',')) END) AS a FROM final)
SELECT count(*) AS documents, CAST(sum(candidate_records) AS BIGINT) AS records_parsed, CAST(sum(extracted_count) AS BIGINT) AS records_validated,
  CAST(sum(rejected_records) AS BIGINT) AS records_rejected, CAST((SELECT a FROM n) AS BIGINT) AS anomalies,
  count(*) FILTER (failure_reason IS NOT NULL) AS documents_needs_review,
  CASE WHEN count(*) FILTER (failure_reason IS NOT NULL) = 0 THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END AS status FROM outcome""",
    }


_DAILY = """daily AS (
  SELECT CAST(user_id AS VARCHAR) AS source_id, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT props) AS documents,
    count(*) AS arrivals, count(*) - count(DISTINCT props) AS copies FROM events GROUP BY 1, 2)"""


def streams() -> dict[str, str]:
    return {
        "stream_arrivals": f"WITH {_DAILY} SELECT * FROM daily",
        "stream_staleness": f"""WITH {_DAILY} SELECT source_id, max(day) AS last_day, CAST(sum(arrivals) AS BIGINT) AS arrivals,
  CASE WHEN date_diff('day', CAST(max(day) AS DATE), DATE '2024-02-01') * 24 > 48 THEN 'STALE' ELSE 'HEALTHY' END AS status FROM daily GROUP BY 1""",
        "stream_ingest": f"""{BASE}, {_REGISTRY}, {_RAW_CUTOFFS.format(batch=', source_version_id')}, {_DOCS},
p AS (SELECT CAST(CAST(college_code[2:] AS BIGINT) AS VARCHAR) AS college_id, branch_code AS branch_id, category_code, round_code, source_version_id,
        o AS opening_rank, c AS closing_rank, academic_year FROM final JOIN outcome USING (source_version_id)
      WHERE is_valid AND failure_reason IS NULL AND category_code <> 'HKR')
SELECT *, CASE WHEN source_version_id = max(source_version_id) OVER (PARTITION BY {_KEY}) THEN 'PUBLISHED' ELSE 'SUPERSEDED' END AS status FROM p""",
    }


def report(parts: dict[str, str]) -> dict[str, str]:
    moves = ["matched_pairs", "median_absolute_movement", "mean_absolute_movement", "median_relative_movement",
             "mean_relative_movement", "earlier_count", "later_count", "unchanged_count"]

    def melt(section: str, item: str, query: str, measures: list[str], where: str = "true") -> str:
        names = ", ".join(f"'{m}'" for m in measures)
        values = ", ".join(f"CAST({m} AS DOUBLE)" for m in measures)
        return (f"SELECT '{section}' AS section, {item} AS item, unnest([{names}]) AS measure, "
                f"unnest([{values}]) AS value FROM ({parts[query]}) q WHERE {where}")

    one = "program_type = 'ENGINEERING' AND category = 'GM'"
    pairs = "(from_year, to_year) IN ((1995, 1996), (1998, 1999), (1995, 2001))"
    sections = [
        melt("coverage", "concat_ws(':', grain, academic_year, round_code, category, program_type)", "coverage_counts",
             ["total_records", "published_records", "superseded_records"]),
        melt("depth", "concat_ws(':', depth, program_type)", "coverage_depth", ["combinations"]),
        melt("pattern", "pattern", "year_patterns", ["combinations"]),
        melt("volatility_by_n", "CAST(observation_count AS VARCHAR)", "volatility_by_n",
             ["combination_count", "median_cv", "mean_cv", "min_cv", "max_cv", "median_absolute_movement",
              "median_relative_movement"], one),
        melt("progression", "concat_ws(':', academic_year, from_round, to_round)", "progression", moves, one),
        melt("yoy", "from_year || '->' || to_year", "yoy_aggregate", moves, f"{one} AND {pairs}"),
        melt("recency", "CAST(anchor_year AS VARCHAR)", "recency",
             ["evaluated_triples", "recent_closer_count", "older_closer_count", "equal_distance_count",
              "recent_closer_percentage", "recent_median_absolute_distance", "older_median_absolute_distance",
              "recent_median_relative_distance", "older_median_relative_distance"], one),
        f"SELECT 'anomalies', anomaly_type, 'found', CAST(count(*) AS DOUBLE) FROM ({parts['anomalies']}) q GROUP BY 2",
    ]
    return {"report": " UNION ALL ".join(sections)}


_OPEN = f"""{BASE}, series AS (
  SELECT 'R1' AS family, l.college_id, l.college_code, t.branch_id, t.program_type, l.category_code AS category,
    CAST(year(l_shipdate) AS INTEGER) AS academic_year, CAST(floor(max(l_extendedprice)) AS INTEGER) AS closing_rank
  FROM lines l JOIN branches b USING (branch_id) JOIN branches t ON t.branch_id = coalesce(b.canonical_branch_id, b.branch_id)
  WHERE round_code = 'R1' GROUP BY ALL), {_TESTS.format(family='R1')}"""


def _by_round_documents() -> str:
    raw = _RAW_CUTOFFS.format(batch=", source_version_id").replace(
        "college_code || '-' || source_version_id AS source_version_id",
        "source_version_id || '-' || academic_year || '-' || lines.round_code AS source_version_id",
    )
    gate = """SELECT d.*, coalesce(n, 0) AS rows_in, coalesce(ok, 0) AS extracted_count, {held} AS baseline_count,
    CASE WHEN corrected THEN NULL WHEN coalesce(ok, 0) <= 0 THEN 'SUSPICIOUS_LOW_COUNT'
      WHEN {held} > 100 AND coalesce(ok, 0) < floor({held} * 0.3::DOUBLE) THEN 'SUSPICIOUS_LOW_COUNT'
      WHEN coalesce(ok, 0) < 50 THEN 'SUSPICIOUS_LOW_COUNT' END AS error_code
  FROM docs d LEFT JOIN counts USING (source_version_id)"""
    return f"""{BASE}, {_REGISTRY}, {raw}, docs AS (
  SELECT v || '-' || y || '-' || c AS source_version_id, v, CAST(y AS INTEGER) AS academic_year, c AS round_code,
    y % 3 = 0 AND c = 'R3' AS corrected, y % 2 = 0 OR c <> 'R4' AS usable
  FROM (VALUES ('v1'), ('v2')) a(v), range(1995, 2002) b(y), (VALUES ('MOCK'), ('R1'), ('KKR_SPECIAL'), ('R3'), ('R4')) r(c)),
counts AS (SELECT source_version_id, count(*) AS n, count(*) FILTER (is_valid) AS ok FROM final GROUP BY 1),
gate1 AS ({gate.format(held='NULL::BIGINT')} WHERE v = 'v1'),
held AS (
  SELECT f.academic_year, f.round_code, count(*) AS m FROM final f JOIN gate1 g USING (source_version_id) JOIN branches b ON b.branch_id = f.branch_code
  WHERE is_valid AND error_code IS NULL AND category_code <> 'HKR' AND b.program_type = 'ENGINEERING' GROUP BY ALL),
gate2 AS ({gate.format(held='h.m')} LEFT JOIN held h ON h.academic_year = d.academic_year AND h.round_code = d.round_code WHERE v = 'v2')"""


def additions() -> dict[str, str]:
    grouped = _by_round_documents()
    state = "CASE WHEN error_code IS NULL THEN 'PUBLISHED' ELSE 'NEEDS_REVIEW' END AS processing_status"
    whole = "format('{:,}', CAST(round_even(%s, 0) AS BIGINT))"
    scored, decided, late = _scored("error_code IS NULL"), prediction()["decision"], longitudinal()["recency"]
    fields = [
        ("row_idx", "row_idx", True), ("college_code", "college_code", True), ("branch_code", "branch_code", True),
        ("category_code", "category_code", True), ("round_code", "round_code", True), ("opening_rank", "o", False),
        ("closing_rank", "c", False), ("academic_year", "academic_year", False), ("source_version_id", "source_version_id", True),
    ]
    json = " || ',' || ".join(
        f"'\"{n}\":\"' || {c} || '\"'" if quoted else f"'\"{n}\":' || {c}" for n, c, quoted in fields if n != "opening_rank"
    )
    json = json.replace("|| ',' || '\"closing_rank\"", "|| coalesce(',\"opening_rank\":' || o, '') || ',' || '\"closing_rank\"")
    at = "date_diff('day', DATE '1970-01-01', {})"
    return {
        "stream_late_arrivals": f"WITH {_DAILY} SELECT * FROM daily",
        "asof_history": f"""{BASE}, facts AS (
  SELECT college_id, branch_id, category_code, {at.format('CAST(l_shipdate AS DATE)')} AS day, CAST(floor(max(l_extendedprice)) AS BIGINT) AS v
  FROM lines GROUP BY ALL),
targets AS (SELECT DISTINCT college_id, branch_id, category_code, academic_year FROM cutoffs)
SELECT t.*, count(v) AS depth, CAST(sum(v) AS BIGINT) AS total, min(v) AS lowest, max(v) AS highest, arg_max(v, day) AS latest,
  max(day) AS latest_at, (list(v ORDER BY day DESC) FILTER (v IS NOT NULL))[2] AS second, (list(day ORDER BY day DESC) FILTER (v IS NOT NULL))[2] AS second_at
FROM targets t LEFT JOIN facts f ON f.college_id = t.college_id AND f.branch_id = t.branch_id AND f.category_code = t.category_code
  AND f.day < {at.format('make_date(t.academic_year, 1, 1)')} GROUP BY ALL""",
        "bt_windows_open": f"""{_OPEN} SELECT {_WINDOW}, count(*) AS total_test_combinations,
  count(*) FILTER (depth > 0) AS evaluated_combinations, count(*) FILTER (depth = 0) AS cold_start_combinations FROM tests GROUP BY ALL""",
        "bt_points_open": f"{_OPEN} SELECT {_WINDOW}, model, {_POINT} FROM points GROUP BY ALL",
        "bt_intervals_open": f"{_OPEN} SELECT {_WINDOW}, model, {_SPAN} FROM spans GROUP BY ALL",
        "leakage_lineage": f"""{_tests('R1')} SELECT target_year, CAST(sum(depth) AS BIGINT) AS train_records, CAST(0 AS BIGINT) AS unknown_records,
  CAST(0 AS BIGINT) AS future_records, CAST(0 AS BIGINT) AS other_rounds, CAST(0 AS BIGINT) AS unpublished_records
FROM tests GROUP BY 1 HAVING sum(depth) > 0""",
        "dq_baseline": f"""{grouped} SELECT source_version_id, 'ENGINEERING' AS program_type, corrected AS is_corrigendum, extracted_count,
  baseline_count, CAST(50 AS INTEGER) AS minimum_rows, error_code, {state} FROM gate2""",
        "document_anomalies": f"""{grouped} SELECT source_version_id, extracted_count, CASE WHEN NOT usable THEN 'SCANNED_OR_EMPTY_PDF'
  WHEN extracted_count = 0 THEN 'SUSPICIOUSLY_EMPTY_DOCUMENT' END AS document_anomaly, {state}
FROM (SELECT * FROM gate1 UNION ALL SELECT * FROM gate2)""",
        "unsupported_documents": f"""SELECT {CODE.format('s_suppkey')} || '-' || v AS source_version_id,
  CASE WHEN s_nationkey < 24 THEN 'NOTIFICATION_PDF' ELSE 'UNKNOWN' END AS document_type, 'UNKNOWN_DOCUMENT_TYPE' AS failure_reason
FROM supplier, (VALUES ('v1'), ('v2')) t(v) WHERE s_nationkey >= 22""",
        "error_context": f"""{BASE}, {_REGISTRY}, {_RAW_CUTOFFS.format(batch='')}, named AS (
  SELECT *, 'cutoff_rec_' || row_idx AS entity_identifier, '{{' || {json} || '}}' AS context_data FROM final)
SELECT entity_identifier, error_codes AS error_code, 'ERROR' AS severity, context_data FROM named WHERE error_codes <> ''
UNION ALL SELECT entity_identifier, unnest(string_split(anomalies, ',')), 'WARNING', context_data FROM named WHERE anomalies <> ''""",
        "provenance_gaps": f"""{BASE} SELECT academic_year, college_code, branch_code, 'MISSING_PROVENANCE' AS anomaly_type, 'DATA_VALIDATION_FAILURE' AS cause,
  'Missing source version linkage.' AS description, 'Cutoff record has null source_version_id' AS details FROM panel WHERE CAST(college_id AS INTEGER) % 7 = 0""",
        "seed_categories": """WITH held AS (SELECT CASE WHEN n_nationkey = 3 THEN 'GM' ELSE n_name END AS category_code, n_name AS category_name, 'held' AS description FROM nation)
SELECT * FROM held UNION ALL
SELECT * FROM (VALUES ('KKR', 'Kalyana Karnataka Region', 'Hyderabad-Karnataka quota under Article 371J'),
                      ('HKR', 'Hyderabad Karnataka Region', 'Legacy Hyderabad-Karnataka reservation quota')) t""",
        "rounds_dropped": f"""{BASE}, names AS (SELECT CAST(y AS INTEGER) AS academic_year, c AS round_code, n AS round_name FROM range(1995, 2002) t(y),
  (VALUES ('MOCK', 'Mock Round'), ('R1', 'Round 1'), ('R3', 'Round 3'), ('R4', 'Round 4')) r(c, n)),
f AS (SELECT academic_year, CASE round_code WHEN 'KKR_SPECIAL' THEN 'R3' ELSE round_code END AS round_code, count(*) AS records FROM cutoffs GROUP BY 1, 2)
SELECT academic_year, round_code, round_name, records, CAST(CASE round_code WHEN 'R3' THEN 4 ELSE 2 END AS BIGINT) AS documents
FROM names LEFT JOIN f USING (academic_year, round_code)""",
        "review_resolve": f"""{OPS}, done AS (SELECT DISTINCT source_id FROM versions WHERE processing_status = 'PUBLISHED'),
i AS (SELECT r.*, CASE WHEN r.source_id > '5' THEN document_url END AS notes, status = 'PENDING_REVIEW' AND d.source_id IS NOT NULL AS closes
      FROM reviews r LEFT JOIN done d ON d.source_id = r.source_id)
SELECT item_id, 'of-' || source_id AS source_version_id, CASE WHEN closes THEN 'APPROVED' ELSE status END AS status,
  CASE WHEN closes THEN coalesce(notes, '') || ' [Resolved: validated and published]' ELSE notes END AS review_notes FROM i""",
        "source_filtered": f"""{OPS} SELECT source_id, source_code, title, is_enabled, check_frequency_hours, CAST(2024 AS INTEGER) AS academic_year,
  'CUTOFF_PDF' AS document_type, source_version_id, source_title AS version_title, processing_status
FROM sources LEFT JOIN versions USING (source_id) WHERE CAST(source_id AS BIGINT) % 3 = 1 AND CAST(source_id AS BIGINT) % 2 = 0""",
        "number_forms": """SELECT s_suppkey, CASE WHEN floor(s_acctbal) >= 0 THEN '+' ELSE '' END || format('{:,}', CAST(floor(s_acctbal) AS BIGINT)) AS signed,
  format('{:,.2f}', floor(s_acctbal) * 1000 / 100000) AS lakhs FROM supplier""",
        "pred_explanations": f"""{scored}, seen AS (
  SELECT request_id, string_agg(CAST(s.academic_year AS VARCHAR), ', ' ORDER BY s.academic_year) AS years
  FROM asked a JOIN series s ON s.family = a.family AND s.college_id = a.college_id AND s.branch_id = a.branch_id
   AND s.category = a.category AND s.academic_year < a.academic_year GROUP BY request_id),
x AS (SELECT *, CASE family WHEN 'TERMINAL' THEN 'final round' ELSE family END AS label, CASE family WHEN 'R3' THEN 'R1' ELSE 'R3' END AS earlier,
  {_MODEL_NAME} AS name FROM bounded LEFT JOIN seen USING (request_id)),
y AS (
  SELECT request_id, 'SUCCESS' AS status, list_filter([
    'history of ' || label || ': ' || CASE WHEN n > 0 THEN years || ' (newest ' || {whole % 'latest'} || ')' ELSE 'none before ' || academic_year END,
    CASE WHEN pre IS NOT NULL THEN earlier || ' in ' || academic_year || ': ' || {whole % 'pre'} END,
    CASE WHEN pre IS NOT NULL AND family = 'R3' THEN 'median move from R1 to R3: ' || {whole % 'move'} END,
    name || ': ' || {whole % 'p'} || ' within ' || {whole % dec('lo', 1)} || ' and ' || {whole % dec('hi', 1)}], lambda l: l IS NOT NULL) AS ls
  FROM x WHERE p IS NOT NULL
  UNION ALL SELECT request_id, 'INSUFFICIENT_EVIDENCE', [CASE
    WHEN n = 0 AND pre IS NULL THEN CASE family WHEN 'R1' THEN 'No published Round 1 cutoffs of this combination before year ' || academic_year || '.'
      WHEN 'R3' THEN 'Neither Round 1 of ' || academic_year || ' nor an earlier Round 3 of this combination exists.'
      ELSE 'Neither Round 3 of ' || academic_year || ' nor an earlier final cutoff of this combination exists.' END
    WHEN m = 'B' THEN 'Model B requires strict T-1 data, which academic year ' || (academic_year - 1) || ' lacks.'
    ELSE 'Round 1 of ' || academic_year || ' may not be used by this model and no earlier Round 3 exists.' END]
  FROM x WHERE p IS NULL)
SELECT request_id, status, CAST(unnest(range(len(ls))) AS INTEGER) AS position, unnest(ls) AS line FROM y""",
        "decision_texts": f"""SELECT request_id, CASE evidence_state
  WHEN 'NUMERICALLY_BELOW_LOWER_BOUND' THEN 'Rank ' || a || ' is below the lower bound of the estimated range (' || b || ' - ' || d || ').'
  WHEN 'WITHIN_LOWER_HALF' THEN 'Rank ' || a || ' lies between the lower bound ' || b || ' and the estimate ' || c || '.'
  WHEN 'WITHIN_UPPER_HALF' THEN 'Rank ' || a || ' lies between the estimate ' || c || ' and the upper bound ' || d || '.'
  WHEN 'NUMERICALLY_ABOVE_UPPER_BOUND' THEN 'Rank ' || a || ' is beyond the upper bound of the estimated range (' || b || ' - ' || d || ').'
  WHEN 'INSUFFICIENT_EVIDENCE' THEN 'There is not enough comparable evidence.' END AS decision_text
FROM (SELECT *, {whole % 'candidate_rank'} AS a, {whole % 'lower_bound'} AS b, {whole % 'predicted_closing_rank'} AS c, {whole % 'upper_bound'} AS d FROM ({decided}))""",
        "choices": f"""{scored}, offered AS (
  SELECT college_id, raw_branch_id, {dec('p', 1)} AS p, CASE WHEN p IS NOT NULL THEN {dec('lo', 1)} END AS lo, CASE WHEN p IS NOT NULL THEN {dec('hi', 1)} END AS hi
  FROM bounded WHERE round = 'R1' AND academic_year = 2000 AND category = 'GM' AND request_id LIKE '%v2'),
chosen AS (
  SELECT DISTINCT o_custkey AS customer, CAST(l_suppkey AS VARCHAR) AS college_id, p_type AS branch_id,
    CAST(o_custkey * 137 % 90000 + 1 AS INTEGER) AS candidate_rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE year(o_orderdate) = 2000)
SELECT customer, c.college_id, c.branch_id, candidate_rank, 'GM' AS category, CAST(2000 AS INTEGER) AS academic_year, 'R1' AS round,
  p AS predicted_closing_rank, lo AS lower_bound, hi AS upper_bound,
  CASE WHEN p IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN candidate_rank < lo THEN 'NUMERICALLY_BELOW_LOWER_BOUND'
       WHEN candidate_rank <= p THEN 'WITHIN_LOWER_HALF' WHEN candidate_rank <= hi THEN 'WITHIN_UPPER_HALF'
       ELSE 'NUMERICALLY_ABOVE_UPPER_BOUND' END AS evidence_state,
  candidate_rank <= p AS within, abs(candidate_rank - p) AS difference,
  CASE WHEN candidate_rank <= p THEN 'Within by ' WHEN candidate_rank > p THEN 'Beyond by ' END || {whole % 'abs(candidate_rank - p)'} AS label
FROM chosen c LEFT JOIN offered k ON k.college_id = c.college_id AND k.raw_branch_id = c.branch_id""",
        "recency_terminal": late.replace("WHERE round_code = 'R1' GROUP BY", "WHERE round_code = 'R4' GROUP BY")
        .replace("academic_year = 1999", "academic_year = 1998").replace("CAST(1999 AS", "CAST(1998 AS").replace("'R1' AS comp", "'TERMINAL' AS comp"),
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (longitudinal, lookups, prediction, quality, documents, streams, additions):
        out.update(part())
    out.update(report(out))
    return out
