"""Mixing and spelling variants against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from cutline.llm import mixing, spelling

SIGNS = re.compile("[^\x20\x09-\x0d]+")


def shares(sizes: dict, weights, share, most) -> dict:
    """Targets by rounds: share what is left by weight, fill those above their bound, share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    bound = {s: Fraction(most * sizes[s]) for s in names}
    fixed: dict = {}
    total = share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        left, by = total - sum(fixed.values()), sum(weight[s] for s in open_)
        want = {s: left * weight[s] / by for s in open_}
        above = [s for s in open_ if want[s] >= bound[s]]
        if not above:
            return {s: float(v) for s, v in (fixed | want).items()}
        fixed |= {s: bound[s] for s in above}
        if len(fixed) == len(names):
            return {s: float(v) for s, v in fixed.items()}


def checked(spark, rows, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'c' AS _key")
    got = mixing.mix(docs, weights, share, most).collect()
    size = lambda t: len(SIGNS.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goal = shares(sizes, weights, share, most)
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=repr) == sorted(((i, s, size(t)) for i, t, s in rows), key=repr)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source], rel=1e-12, abs=1e-9)
        assert 0 <= r.taken <= most * r.size
        assert r.passes * r.size <= r.taken <= (r.passes + 1) * r.size
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    partly = Counter(r.source for r in got if r.size and r.taken % r.size)
    assert all(n == 1 for n in partly.values())
    used = mixing.mixed(docs, weights, share, most).collect()
    assert Counter({s: sum(u.words for u in used if u.source == s) for s in sizes}) == taken
    assert all(u.words == size(u.text) > 0 for u in used)
    return got


def test_shares_and_cuts(spark):
    random.seed(4)
    rows = [(i, " ".join(["w"] * random.randint(0, 60)), random.choice(["a", "a", "a", "b", "B", "é", "", None])) for i in range(400)]
    checked(spark, rows)
    checked(spark, rows, (1,), Fraction(1, 3), 1)
    checked(spark, rows, (7, 3), Fraction(9, 4), 3)
    checked(spark, rows, (1, 2), Fraction(5, 1), 2)


def test_small_sources_are_full_one_after_another(spark):
    rows = [(1, "w " * 3, "a"), (2, "w " * 5, "b"), (3, "w " * 40, "c"), (4, "w " * 1000, "d"), (5, "", "e"), (6, None, "f")]
    got = {r.doc_id: r for r in checked(spark, rows)}
    assert (got[1].target, got[2].target) == (6.0, 10.0) and got[5].target == got[6].target == 0.0


def test_equal_rows_share_what_is_taken(spark):
    rows = [(7, "one two three", "a")] * 50 + [(None, "x y", "a")] * 50 + [(7, "other text of the id", "a")] * 3 + [(None, None, "a")] * 3
    got = checked(spark, rows, (1,), Fraction(1, 2), 1)
    assert sum(r.taken for r in got) == 132


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted(map(tuple, mixing.mix(docs.coalesce(1)).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(13, "lang")).collect()))
    assert one != sorted(map(tuple, mixing.mix(docs, seed="other").collect()))


def test_mix_of_awkward_rows(spark, awkward, nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    checked(spark, [(r.doc_id, r.text, r.source) for r in awkward.collect()])
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0.0, 0)] * 2


def test_running_sums_over_partitions(spark):
    rows = [(random.Random(i).randint(0, 50), i) for i in range(500)]
    out = mixing.running(spark.createDataFrame(rows, "v long, k long").repartition(7), ["v", "k"], {"t": "v", "c": "1"}, "t").collect()
    total = 0
    for i, r in enumerate(sorted(out, key=lambda r: (r.v, r.k))):
        total += r.v
        assert (r.t, r.c) == (total, i + 1)


def words_of(rows) -> Counter:
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 7 and n >= 2})


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words: Counter) -> list:
    near = defaultdict(list)
    listed = sorted(words)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and is_near(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in listed:
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w in listed:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def compared(spark, rows):
    got = spelling.group_variants(spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == variants(words_of(rows))


def test_variants_by_hand(spark):
    random.seed(8)
    base = ["letters", "better", "Étudiant", "aaaaaaaa", "mississippi", "strasse", "übergrößen", "internationalisation"]
    pool = []
    for _ in range(300):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 2)):
            i = random.randrange(len(w))
            w[i : i + random.randint(0, 1)] = random.choice(["", "a", "s", "ß", "pp"])
        pool.append("".join(w))
    rows = [(i, " ".join(random.choices(pool, k=20)) + " " + " ".join([random.choice(base)] * 15)) for i in range(60)]
    compared(spark, rows + [(None, rows[0][1]), (3, None), (4, ""), (5, "1 2 3 --"), (6, rows[0][1]), (6, rows[0][1])])


def test_chains_of_forms(spark):
    words = [("aaaaaaa", 2), ("aaaaaaab", 20), ("aaaaaaabc", 200), ("aaaaaaabcd", 2000), ("zzzzzzz", 5), ("zzzzzzy", 5), (None, 9)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaaaaaa"].root == "aaaaaaabcd" and got["aaaaaaa"].form == "aaaaaaab"
    assert got["zzzzzzz"].root == "zzzzzzz" and got["zzzzzzz"].n_near == 1 and len(got) == 6


def test_very_long_runs(spark):
    long = "ab" * 40_000
    compared(spark, [(1, long), (2, long), (3, long + "c"), (4, long + "c"), (5, "short only")])


def test_no_words(spark, nothing, awkward):
    assert spelling.group_variants(spelling.count_words(nothing)).count() == 0
    assert spelling.group_variants(spelling.count_words(awkward)).count() == 0


def test_nodes_are_numbered_across_ranges(spark):
    random.seed(2)
    words = sorted({"".join(random.choices("ab", k=random.randint(1, 9))) for _ in range(400)} | {"abababab" * 3, "ß", "", "zé"})
    frame = spark.createDataFrame([(w, 1, 0) for w in words], "word string, n long, w long")
    for parts in (1, 3, 50):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rows = spelling._numbered_nodes(frame, "word", "trie").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert [r.key for r in sorted(rows, key=lambda r: r.rank)] == words
        number = {}
        for r in rows:
            assert len(r.nodes) == len(r.key) + 1
            assert r.first == [i == 0 or r.key[i] != r.key[i - 1] for i in range(len(r.key))]
            for i, node in enumerate(r.nodes):
                assert number.setdefault(r.key[:i], node) == node
        assert len(set(number.values())) == len(number)


@pytest.mark.parametrize("words", [10**8, 7 * 10**8, 3 * 10**9, 10**15])
def test_targets_of_many_words(spark, words):
    # of 7 * 10^8 words, what is left is below 2^31, and its product with a weight is not
    sizes = {"a": 4 * words // 10, "b": words // 20, "c": words // 20, "d": words // 2}
    rows = spark.createDataFrame([(False, s, n) for s, n in sizes.items()], "_none boolean, _source string, source_size long")
    got = {r["_source"]: r["target"] for r in mixing.targets(rows, (5, 2, 1), Fraction(3, 2), 2).collect()}
    assert got == pytest.approx(shares(sizes, (5, 2, 1), Fraction(3, 2), 2), rel=1e-12)
