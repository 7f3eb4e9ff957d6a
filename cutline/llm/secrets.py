"""Secret scans: candidate strings, judged by a random forest. DataFrame and SQL functions only.

Candidates are long strings without white space that hold digits or stand after an assignment, values of any form that
a keyword is assigned, and bodies of private keys. Features are numbers that Spark computes: length, character
transitions, dictionary coverage, known token forms, the path, and neighbouring words.
The forest is trained from labelled findings and removes false positives.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import broadcast_if_small, saved, table

LEAST = 16  # characters of a candidate
LEAST_ASSIGNED = 4  # characters of a value that a keyword is assigned
SAMPLE = 20_000  # labelled findings the forest is grown from, at most, those of smallest hash
CONTEXT = 48  # characters looked at on either side
_BLOCK = 256  # pieces of a text whose lengths are summed at once
THRESHOLD = 0.5
MASK = "[SECRET]"

_KEYWORDS = "token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private"
_SIGN = "[:=] {0,4}[\"']?"
# a key's body line by line, to its end; then what a keyword is assigned, up to a quote, white space or the next
# parameter; then long strings, where "=" only pads the end, so that the key of KEY=value stands before its value.
# Possessive repeats run in a loop, so that neither lines nor groups have a bound
CANDIDATE = (
    "(?<=PRIVATE KEY-----(?:\\r?\\n|\\\\n| ))[A-Za-z0-9+/]{16,}(?:(?:\\r?\\n|\\\\n)[A-Za-z0-9+/]++(?=[=\\s\\\\-]|$))*+={0,2}"
    f"|(?<={_SIGN})(?<=(?i:{_KEYWORDS})(?i:[a-z_ -]{{0,24}})[\"']? {{0,4}}{_SIGN})(?=[^\\s\"'<>]{{{LEAST_ASSIGNED}}})"
    "[^\\s\"'<>,;&]++(?:[,;&]++(?!\\s|$|[\\w.-]{1,40}=)[^\\s\"'<>,;&]*+)*+"
    f"|[A-Za-z0-9+/_.~-]{{{LEAST},}}(?:={{1,2}}(?![A-Za-z0-9+/_=.~-]))?"
)
_SQL_CANDIDATE = "'" + CANDIDATE.replace("\\", "\\\\").replace("'", "\\'") + "'"
_SQL_GROUP = f"'({_SQL_CANDIDATE[1:-1]})'"
# tokens that their issuers give a prefix and a length
TOKEN_FORM = (
    "^((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}"
    "|xox[abeoprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}"
    "|hf_[A-Za-z0-9]{30,}|SG\\.[A-Za-z0-9_-]{16,}\\.[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]*)$"
)
_KEY_BODY = "PRIVATE KEY-----(\\s|\\\\n)*$"
# forms that are clearly no secret: numbers, hosts and addresses, files, UUIDs; and digests that are called so
_PLAIN = (
    "^([0-9.+/_~-]+|([a-z0-9-]+\\.)+[a-z]{2,}(/.*)?|[A-Za-z0-9_./~-]*/[A-Za-z0-9_.-]*\\.[a-z]{1,5}"
    "|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
)
_ADDRESS = "^//([a-z0-9-]+\\.)+[a-z]{2,}(/[a-z.-]*)*$"  # what follows the colon of a URL, without digits in its path
_DIGEST = "(commit|revision|sha-?(1|224|256|384|512)|md5|checksum|digest|etag)[ :=]*[\"']?$"
_EXAMPLES = "example|sample|dummy|placeholder|changeme|your|test|fake|xxxx|lorem"
_EXAMPLE_WORD = f"(^|[^a-z@.])({_EXAMPLES})([^a-z.]|$)"  # a word by itself, not a host's name
FEATURES = [
    "length", "digits", "uppers", "symbols", "kinds", "transitions", "hexadecimal", "runs", "coverage", "vowels",
    "assigned", "quoted", "keyword", "keyword_near", "example", "form", "words_before", "words_after", "path_example", "path_depth",
]


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate of every whole text: doc_id, start, candidate, before, after, path.

    Candidates have ``LEAST`` characters, or ``LEAST_ASSIGNED`` and any form but white space and quotes where a keyword
    is assigned; the body of a private key is one. A text is cut once into candidates and what stands between them.
    Starts (in code points, from 0) are the lengths of the pieces before, summed by blocks of ``_BLOCK`` pieces first;
    context comes from neighbouring pieces. So a text costs in proportion to its candidates, and only they leave it.
    """
    source = F.col(path).cast("string") if path in docs.columns else F.lit("")
    cut = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("path"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    ).where(F.col("t").rlike(CANDIDATE))

    def let(value: str, name: str, body: str) -> str:
        # a variable of a lambda function is computed once, whatever the optimizer does with columns
        return f"transform(array({value}), {name} -> {body})[0]"

    cuts = f"named_struct('g', split(t, {_SQL_CANDIDATE}, -1), 'c', regexp_extract_all(t, {_SQL_GROUP}, 1))"
    # gap, candidate, gap, ..., gap: candidate k is piece 2k
    pieces = "concat(flatten(zip_with(slice(x.g, 1, size(x.c)), x.c, (g, c) -> array(g, c))), slice(x.g, -1, 1))"
    measured = (
        "named_struct('c', x.c, 'l', transform(p, y -> char_length(y)),"
        f" 'tails', transform(p, y -> right(y, {CONTEXT})), 'heads', transform(p, y -> left(y, {CONTEXT})))"
    )
    summed = (
        f"transform(sequence(0, (size(m.l) - 1) DIV {_BLOCK}), b ->"
        f" aggregate(slice(m.l, b * {_BLOCK} + 1, {_BLOCK}), 0L, (a, y) -> a + y))"
    )
    bases = "transform(sequence(0, size(s) - 1), b -> aggregate(slice(s, 1, b), 0L, (a, y) -> a + y))"
    block = f"((2 * k - 1) DIV {_BLOCK})"
    # no piece but a gap is empty, so 2 * CONTEXT + 1 pieces hold CONTEXT characters
    reach = 2 * CONTEXT + 1
    found = (
        "transform(m.c, (c, i) -> " + let("CAST(i + 1 AS INT)", "k", "named_struct("
        "'candidate', c,"
        f" 'start', o[CAST({block} AS INT)] + aggregate(slice(m.l, CAST({block} * {_BLOCK} + 1 AS INT), CAST((2 * k - 1) % {_BLOCK} AS INT)), 0L, (a, y) -> a + y),"
        f" 'before', right(array_join(slice(m.tails, greatest(1, 2 * k - {reach}), least({reach}, 2 * k - 1)), ''), {CONTEXT}),"
        f" 'after', left(array_join(slice(m.heads, 2 * k + 1, {reach}), ''), {CONTEXT}))") + ")"
    )
    every = let(cuts, "x", let(pieces, "p", let(measured, "m", let(summed, "s", let(bases, "o", found)))))
    # outer: an inner explode would be guarded by a filter that computes the same array once more
    placed = cut.select("doc_id", "path", F.explode_outer(F.expr(every)).alias("f")).select(
        "doc_id", "path", "f.start", "f.candidate", "f.before", "f.after"
    )
    return placed.where("candidate RLIKE '[0-9]' OR before RLIKE '[:=] *[\"\\']?$'")


def dictionary(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """Letter triples that words of the corpus are made of: those in at least ``least`` distinct words' places.

    Counted over all texts, combined before the shuffle; there are at most 26 ** 3, so the table is small by nature.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"))).alias("w"))
    triples = words.where("length(w) BETWEEN 3 AND 40").selectExpr(
        "explode(array_distinct(transform(sequence(1, length(w) - 2), k -> substr(w, k, 3)))) AS triple"
    )
    return triples.groupBy("triple").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("triple")


def features(found: DataFrame, triples: DataFrame) -> DataFrame:
    """Add the columns of ``FEATURES``."""
    # one row: for each of the 26 ** 3 triples, whether it is there
    place = "(ascii(triple) - 97) * 676 + (ascii(substr(triple, 2, 1)) - 97) * 26 + ascii(substr(triple, 3, 1)) - 97"
    known = triples.agg(F.collect_set(F.expr(place)).alias("seen")).selectExpr(
        f"transform(sequence(0, {26**3 - 1}), i -> array_contains(seen, i)) AS known"
    )
    # each letter's number, then that of each triple: zipped, as letters are far to find by place in a long string
    letters = "transform(split(lower(candidate), ''), c -> if(c BETWEEN 'a' AND 'z', ascii(c) - 97, CAST(NULL AS INT)))"
    after = lambda k: f"slice({letters}, {k}, length(candidate))"
    numbers = f"zip_with(zip_with({letters}, {after(2)}, (a, b) -> a * 26 + b), {after(3)}, (ab, c) -> ab * 26 + c)"
    kinds = "translate(candidate, 'bcdefghijklmnopqrstuvwxyzBCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'aaaaaaaaaaaaaaaaaaaaaaaaaAAAAAAAAAAAAAAAAAAAAAAAAA000000000')"
    count = lambda what: f"length(candidate) - length(regexp_replace(candidate, '{what}', ''))"
    return (
        found.join(F.broadcast(known))
        .withColumn("length", F.expr("CAST(length(candidate) AS DOUBLE)"))
        .withColumn("kinds_", F.expr(kinds))
        .withColumns({
            "digits": F.expr(f"({count('[0-9]')}) / length"),
            "uppers": F.expr(f"({count('[A-Z]')}) / length"),
            "symbols": F.expr(f"({count('[^A-Za-z0-9]')}) / length"),
            "kinds": F.expr("CAST(size(array_distinct(split(kinds_, ''))) AS DOUBLE)"),
            "transitions": F.expr("length(regexp_replace(kinds_, '(.)\\\\1*', 'x')) / length"),
            "hexadecimal": F.expr("CAST(candidate RLIKE '^([0-9a-f]+|[0-9A-F]+)$' AS DOUBLE)"),
            "runs": F.expr("length(regexp_replace(candidate, '(.)\\\\1+', '$1')) / length"),
            "coverage": F.expr(
                f"size(filter({numbers}, x -> x IS NOT NULL AND known[x])) / (length - 2)"
            ),
            "vowels": F.expr(f"({count('[aeiouAEIOU]')}) / length"),
            "assigned": F.expr("CAST(before RLIKE '[:=] *[\"\\']?$' AS DOUBLE)"),
            "quoted": F.expr("CAST(before RLIKE '[\"\\']$' AND after RLIKE '^[\"\\']' AS DOUBLE)"),
            "keyword": F.expr(f"CAST(lower(before) RLIKE '({_KEYWORDS})[a-z_ -]*[\"\\']? *[:=] *[\"\\']?$' AS DOUBLE)"),
            "keyword_near": F.expr(f"CAST(lower(concat(before, ' ', after)) RLIKE '({_KEYWORDS})' AS DOUBLE)"),
            "example": F.expr(
                f"CAST(lower(candidate) RLIKE '({_EXAMPLES})' OR lower(before) RLIKE '{_EXAMPLE_WORD}' OR lower(after) RLIKE '{_EXAMPLE_WORD}' AS DOUBLE)"
            ),
            "form": (F.col("candidate").rlike(TOKEN_FORM) | F.col("before").rlike(_KEY_BODY)).cast("double"),
            "words_before": F.expr("CAST(size(split(trim(before), '\\\\s+')) AS DOUBLE)"),
            "words_after": F.expr("CAST(size(split(trim(after), '\\\\s+')) AS DOUBLE)"),
            "path_example": F.expr(f"CAST(lower(path) RLIKE '({_EXAMPLES}|fixture|mock|docs?/)' AS DOUBLE)"),
            "path_depth": F.expr("CAST(size(split(path, '/')) AS DOUBLE)"),
        })
        .drop("known", "kinds_")
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where none were reviewed: clear cases only.

    1: a token of a known form or the body of a private key, and a string of letters and digits that a keyword is
    assigned, both without an example word. 0: the same with an example word; a keyword's unquoted value that is letters
    alone; URLs of letters; and, without assignment, keyword near or known form, strings that words cover, numbers, addresses, files,
    UUIDs and digests called so. Others, such as random strings without a keyword, stay without a label.
    """
    keyword, form, example, apart = F.expr("keyword = 1"), F.expr("form = 1"), F.expr("example = 1"), F.expr("assigned = 0 AND keyword_near = 0")
    plain = (
        F.expr("coverage >= 0.75") | F.col("candidate").rlike(_PLAIN) | F.col("before").rlike("(@|://)$")
        | (F.lower("before").rlike(_DIGEST) & F.expr("hexadecimal = 1"))
    )
    label = (
        F.when((keyword | form) & example, 0)
        .when(form, 1)
        .when(keyword & F.expr("digits BETWEEN 0.1 AND 0.95 AND transitions > 0.2"), 1)
        .when(keyword & F.expr("quoted = 0") & F.col("candidate").rlike("^[A-Za-z]?[a-z]+[.:!?)]*$"), 0)
        .when(F.col("candidate").rlike(_ADDRESS) | (apart & plain), 0)
    )
    return found.withColumn("label", label).where("label IS NOT NULL")


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = 24, depth: int = 6) -> RandomForestClassificationModel | None:
    """Grow the forest from labelled findings (``FEATURES`` and ``label`` 0/1), at most ``sample`` of them.

    None if there is no finding of either label; then nothing is confirmed or removed by it.
    """
    chosen = saved(
        labelled.where("label IN (0, 1)").select(*FEATURES, F.col("label").cast("double"), F.xxhash64("candidate", "before").alias("_o"))
        .orderBy("_o", *FEATURES).limit(sample).coalesce(1),
        "findings",
    )
    if chosen.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, maxBins=32, subsamplingRate=0.8
    )
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate with its verdict: ``doc_id, start, length, candidate, before, after, score, is_secret``.

    ``labelled``: reviewed findings with the columns of ``candidates`` and ``label``; without them, clear cases of the
    documents themselves label the sample. NULL and empty texts have no candidate, NULL ids are carried along, repeated
    rows give repeated findings, a missing or NULL path is empty. Without reviewed findings, tokens of a known form are
    secrets however few the forest saw. If the forest has only one label to learn from, the labelled rule stands in:
    what follows an assigned keyword is a secret.
    """
    found = saved(features(candidates(docs, id, text, path), dictionary(docs, text)), "candidates")
    known = rule_labels(found) if labelled is None else features(labelled, dictionary(docs, text))
    forest = train(known)
    if forest is None:
        scored = found.withColumn("score", F.col("keyword") * (1 - F.col("example")))
    else:
        scored = (
            forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
            .withColumn("score", vector_to_array("probability")[1])
        )
    if labelled is None:
        scored = scored.withColumn("score", F.expr("greatest(score, form * (1 - example))"))
    return scored.select(
        "doc_id", "start", F.expr("CAST(length AS BIGINT) AS length"), "candidate", "before", "after", "score",
        (F.col("score") >= THRESHOLD).alias("is_secret"),
    )


def redact(docs: DataFrame, findings: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put ``MASK`` in the place of each confirmed secret; other rows and all columns stay as they are."""
    secrets = findings.where("is_secret AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("candidate").alias("_secrets_"))
    # a document's own findings: no longer than its text; the longest go first, as one may hold another
    secrets = secrets.withColumn("_secrets_", F.expr("array_sort(_secrets_, (a, b) -> length(b) - length(a))"))
    joined = docs.join(broadcast_if_small(saved(secrets.withColumnRenamed("doc_id", "_id_"), "secrets")), F.col(id) == F.col("_id_"), "left")
    # a short one only where it stands by itself
    alone = r"concat('(?<![A-Za-z0-9])\\Q', replace(s, '\\E', '\\E\\\\E\\Q'), '\\E(?![A-Za-z0-9])')"
    masked = F.expr(
        f"aggregate(coalesce(_secrets_, array()), {text}, (t, s) -> if(char_length(s) < {LEAST},"
        f" regexp_replace(t, {alone}, '{MASK}'), replace(t, s, '{MASK}')))"
    )
    return joined.withColumn(text, masked).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked; rows without an id, or that share one, like all others.

    Findings are tied to the text they were found in, by a number of its own, as an id need not tell texts apart.
    """
    own = "xxhash64(text)"  # a shared number only adds the other text's secrets, which are masked where they occur
    numbered = docs.withColumn("_text_", F.expr(own))
    return redact(numbered, scan(numbered, id="_text_"), id="_text_").select(*docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret"
    )
