"""Filtered lookups, searches, details, comparison of chosen colleges.

A lookup returns all matching rows; ``page`` cuts one page out of them and
``total`` counts them. Nested lists of the details are returned as rows, one
per element: the elements of one parent have no bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.ranks import containment
from cutline.plans.pooled import lookup

ALL = "ALL"


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; end ``order`` with an id so that ties have one order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def _wanted(value: str | None) -> bool:
    return bool(value) and value.upper() != ALL


def _of_dimensions(
    facts: DataFrame,
    colleges: DataFrame,
    branches: DataFrame,
    institution_type: str | None,
    program_type: str | None,
) -> DataFrame:
    """Keep facts of one institution type and program; a dimension is joined only if it filters."""
    if _wanted(institution_type):
        kept = colleges.filter(F.col("institution_type") == institution_type.upper()).select("college_id")
        facts = facts.join(kept, "college_id", "left_semi")
    if _wanted(program_type):
        kept = branches.filter(F.col("program_type") == program_type.upper()).select("branch_id")
        facts = facts.join(kept, "branch_id", "left_semi")
    return facts


def _equal(facts: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        if value is not None:
            facts = facts.filter(F.col(name) == value)
    return facts


def find_cutoffs(
    cutoffs: DataFrame,
    colleges: DataFrame,
    branches: DataFrame,
    rounds: DataFrame,
    *,
    institution_type: str | None = "ENGINEERING",
    program_type: str | None = "ENGINEERING",
    college_id: str | None = None,
    branch_id: str | None = None,
    academic_year: int | None = None,
    category: str | None = None,
    round_code: str | None = None,
    include_special: bool = False,
) -> DataFrame:
    """Published cutoffs; unless a round is named, special rounds are left out."""
    facts = _equal(
        cutoffs.filter(F.col("status") == "PUBLISHED"),
        college_id=college_id,
        branch_id=branch_id,
        academic_year=academic_year,
        category_code=category.upper() if category else None,
        round_code=round_code.upper() if round_code else None,
    )
    if not round_code and not include_special:
        general = rounds.filter("is_general_round").select("academic_year", "round_code")
        facts = facts.join(general, ["academic_year", "round_code"], "left_semi")
    return _of_dimensions(facts, colleges, branches, institution_type, program_type)


def find_seats(
    seats: DataFrame,
    colleges: DataFrame,
    branches: DataFrame,
    rounds: DataFrame,
    *,
    institution_type: str | None = "ENGINEERING",
    program_type: str | None = "ENGINEERING",
    college_id: str | None = None,
    branch_id: str | None = None,
    academic_year: int | None = None,
    round_code: str | None = None,
    include_special: bool = False,
) -> DataFrame:
    """Published seats; rows without a round belong to the general pathway."""
    facts = _equal(
        seats.filter(F.col("status") == "PUBLISHED"),
        college_id=college_id,
        branch_id=branch_id,
        academic_year=academic_year,
        round_code=round_code.upper() if round_code else None,
    )
    if not round_code and not include_special:
        flags = rounds.select("academic_year", "round_code", "is_general_round")
        facts = (
            facts.join(flags, ["academic_year", "round_code"], "left")
            .filter(F.col("round_code").isNull() | F.col("is_general_round"))
            .drop("is_general_round")
        )
    return _of_dimensions(facts, colleges, branches, institution_type, program_type)


def find_fees(
    fees: DataFrame,
    colleges: DataFrame,
    branches: DataFrame,
    *,
    institution_type: str | None = "ENGINEERING",
    program_type: str | None = "ENGINEERING",
    college_id: str | None = None,
    branch_id: str | None = None,
    academic_year: int | None = None,
) -> DataFrame:
    facts = _equal(
        fees.filter(F.col("status") == "PUBLISHED"),
        college_id=college_id,
        branch_id=branch_id,
        academic_year=academic_year,
    )
    return _of_dimensions(facts, colleges, branches, institution_type, program_type)


def _contains(column: str, term: str) -> Column:
    return F.lower(F.col(column)).contains(term.strip().lower())


def _any_contains(columns: Sequence[str], term: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(_contains(c, term), F.lit(False))
    return found


def search_colleges(
    colleges: DataFrame,
    query: str | None = None,
    location: str | None = None,
    institution_type: str | None = "ENGINEERING",
) -> DataFrame:
    """Case-insensitive search by part of the name, code or place; the text is taken literally."""
    if _wanted(institution_type):
        colleges = colleges.filter(F.col("institution_type") == institution_type.upper())
    if query:
        colleges = colleges.filter(
            _any_contains(["college_name", "college_code", "original_name", "location"], query)
        )
    if location:
        colleges = colleges.filter(_contains("location", location))
    return colleges


def search_branches(
    branches: DataFrame,
    query: str | None = None,
    program_type: str | None = "ENGINEERING",
    canonical: bool | None = True,
) -> DataFrame:
    if _wanted(program_type):
        branches = branches.filter(F.col("program_type") == program_type.upper())
    if canonical is not None:
        branches = branches.filter(F.col("is_canonical") == canonical)
    if query:
        branches = branches.filter(_any_contains(["branch_name", "branch_code", "original_name"], query))
    return branches


def college_details(colleges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every college with its aliases, one row per alias; a college without any keeps one row."""
    return colleges.join(aliases.select("college_id", "alias", F.col("source").alias("alias_source")),
                         "college_id", "left")


def source_catalogue(
    sources: DataFrame,
    versions: DataFrame,
    academic_year: int | None = None,
    document_type: str | None = None,
) -> DataFrame:
    """Every source with its versions, one row per version, to be ordered newest first."""
    kept = _equal(sources, academic_year=academic_year, document_type=document_type)
    held = versions.select(
        "source_id",
        "source_version_id",
        F.col("source_title").alias("version_title"),
        "processing_status",
        F.col("created_at").alias("version_created_at"),
    )
    return kept.join(held, "source_id", "left")


GRAM = 3


def _grams(text: str, width: int) -> str:
    """SQL text of the distinct pieces of ``width`` letters of a text; none if it is shorter."""
    return (
        f"CASE WHEN length({text}) >= {width} THEN array_distinct(transform(sequence(1, length({text}) - {width - 1}), "
        f"i -> substring({text}, i, {width}))) ELSE array() END"
    )


def names_containing(terms: DataFrame, names: DataFrame) -> DataFrame:
    """For each term (_t) that is part of a name (_name, code, entity_id) the entity of the smallest code, as ``_by_name``.

    An index holds three-letter pieces of the names, as many rows as letters. A term meets only the names that share
    its rarest piece, and is then looked for in them; a term with a piece that no name has meets none. Terms of one or
    two letters are looked up among the pieces of that length.
    """
    best = "min(struct(code, entity_id)).entity_id AS _by_name"
    index = names.selectExpr("_name", "code", "entity_id", f"explode({_grams('_name', GRAM)}) AS _gram")
    pieces = terms.where(f"length(_t) >= {GRAM}").select("_t").distinct().selectExpr("_t", f"explode({_grams('_t', GRAM)}) AS _gram")
    counts = index.groupBy("_gram").agg(F.expr("count(1) AS _n"))
    rarest = lookup(pieces, counts, ["_gram"]).groupBy("_t").agg(
        F.expr("min(struct(coalesce(_n, 0L) AS n, _gram)) AS _rarest")
    ).where("_rarest.n > 0").selectExpr("_t", "_rarest._gram AS _gram")
    long = rarest.join(index, "_gram").where("contains(_name, _t)").groupBy("_t").agg(F.expr(best))
    short = names.selectExpr(
        "code", "entity_id", f"explode(concat({', '.join(_grams('_name', w) for w in range(1, GRAM))})) AS _t"
    ).groupBy("_t").agg(F.expr(best))
    return long.union(short)


def resolve_entities(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """Find the entity each term means: by id, else by code, ignoring case, else by part of a short name.

    ``terms(term)`` holds what was asked for; ``entities(entity_id, code, short_name)`` is what can be found. Of several
    names with the term in them the one with the smallest code counts. An empty term means nothing.
    """
    ids = entities.select(F.lower("entity_id").alias("_id"), F.col("entity_id").alias("_by_id"))
    codes = entities.groupBy(F.lower("code").alias("_code")).agg(F.min("entity_id").alias("_by_code"))
    asked = terms.withColumn("_t", F.lower("term"))
    named = names_containing(asked, entities.selectExpr("lower(short_name) AS _name", "code", "entity_id"))
    return (
        asked.join(ids, F.col("_t") == F.col("_id"), "left")
        .join(codes, F.col("_t") == F.col("_code"), "left")
        .join(named, "_t", "left")
        .select("term", F.coalesce("_by_id", "_by_code", "_by_name").alias("entity_id"))
    )


def compare_colleges(
    chosen: DataFrame,
    cutoffs: DataFrame,
    fees: DataFrame,
    colleges: DataFrame,
    branches: DataFrame,
    rounds: DataFrame,
) -> DataFrame:
    """Per chosen college: lowest closing rank of a general round, and its highest fee."""
    lowest = (
        find_cutoffs(cutoffs, colleges, branches, rounds)
        .groupBy("college_id")
        .agg(F.min("closing_rank").alias("latest_cutoff"))
    )
    fee = F.coalesce(F.nullif(F.col("total_fee"), F.lit(0).cast("decimal(12,2)")), F.col("tuition_fee"))
    highest = (
        find_fees(fees, colleges, branches).groupBy("college_id").agg(F.max(fee).alias("annual_fee"))
    )
    return chosen.join(lowest, "college_id", "left").join(highest, "college_id", "left")


def rank_containment(cutoffs: DataFrame, candidate_rank: str) -> DataFrame:
    """Whether a candidate's rank (SQL text) lies within each closing rank, and by how much."""
    found = containment(candidate_rank, "closing_rank")
    return cutoffs.selectExpr("*", *[f"{v} AS {n}" for n, v in found.items()])


def sample_rows(df: DataFrame, id_column: str, size: int, seed: int) -> DataFrame:
    """A repeatable random sample: the rows with the smallest seeded hash of their id."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column)))
    return df.orderBy(mixed, id_column).limit(size)


def provenance_sample(
    entities: DataFrame, id_column: str, versions: DataFrame, size: int, seed: int
) -> DataFrame:
    """A sample of entities, each beside the one document version they all come from.

    The version is a single row, found by its smallest id and read as a scalar subquery.
    """
    source = versions.orderBy("source_version_id").limit(1).select(F.struct(*versions.columns).alias("v"))
    picked = sample_rows(entities, id_column, size, seed)
    return picked.withColumn("_v", source.scalar()).select(*picked.columns, "_v.*")


def distinct_counts(facts: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Number of distinct keys by name of the key; a key may have several columns."""
    parts = [
        facts.select(*key).distinct().agg(F.expr("count(1) AS keys")).select(F.lit(name).alias("name"), "keys")
        for name, key in groups.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def duplicate_keys(facts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return facts.groupBy(*key).agg(F.expr("count(1) AS records")).filter("records > 1")


def prefix_counts(df: DataFrame, column: str, length: int = 1) -> DataFrame:
    """Number of rows by the first ``length`` characters of a column."""
    return df.groupBy(F.substring(column, 1, length).alias("prefix")).agg(F.expr("count(1) AS records"))


def most_frequent(df: DataFrame, column: str, size: int = 10) -> DataFrame:
    """The most frequent values of a column with their number of rows, ties by value."""
    return page(df.groupBy(column).agg(F.expr("count(1) AS records")), [F.col("records").desc(), F.col(column)], size)


def in_custom_order(df: DataFrame, column: str, ranking: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Order by a position list; values outside the list come last."""
    position = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(r) for r in ranking]), F.col(column)), F.lit(0)),
        F.lit(len(ranking) + 1),
    )
    return df.orderBy(position, *tie)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by a combined aggregate, so a key with very many rows is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return newest.select(*keys, "_row.*")
