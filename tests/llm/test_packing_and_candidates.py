"""Packing against exhaustive search, and candidates of secret scans against slices of the text."""

import random
import time
from collections import Counter

import pytest
import regex

from cutline.llm import packing, secrets


def fewest_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            at = rooms.index(room)
            place(i + 1, [*rooms[:at], room - items[i], *rooms[at + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def checked(lengths, capacity, **more):
    bins, proven = packing.pack_proven(lengths, capacity, **more)
    used = Counter()
    for filling, times in bins:
        assert sum(filling) <= capacity
        for piece in filling:
            used[piece] += times
    assert used == Counter(lengths)
    return sum(times for _, times in bins), proven


@pytest.mark.parametrize("capacity", [7, 10, 17, 30, 100])
def test_packing_is_optimal_and_proven_on_small_instances(capacity):
    rng = random.Random(capacity)
    for _ in range(80):
        items = [rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 11))]
        assert checked(Counter(items), capacity) == (fewest_bins(items, capacity), True)


def test_bins_cut_from_full_ones_are_put_together_again():
    rng = random.Random(5)
    for _ in range(40):
        full, items = rng.randint(8, 21), []
        for _ in range(full):
            cuts = [0, *sorted(rng.sample(range(1, 2048), rng.randint(2, 5))), 2048]
            items += [b - a for a, b in zip(cuts, cuts[1:])]
        assert checked(Counter(items), 2048) == (full, True)


def test_a_spent_budget_leaves_a_whole_packing():
    rng = random.Random(2)
    lengths = Counter(rng.randint(300, 1100) for _ in range(4000))
    size, _ = checked(lengths, 2048, budget=3000)
    assert packing.lower_bound(lengths, 2048) <= size <= sum(t for _, t in packing.best_fit(lengths, 2048))


def test_candidates_lie_where_they_say_with_the_text_around_them(spark):
    rng = random.Random(3)
    token = lambda n=40: "".join(rng.choice("abcdefABCDEF0123456789") for _ in range(n))
    texts = [
        f'token=a&bcd=12345678 key="é😀{token()}" x',
        " ".join(token() for _ in range(700)),
        "password: a;b;c;d1 " * 40,
        token(),
        "token=a&b1=c1 token=a&b1=c1 " * 60,
        "secret=abcd" * 30,
        "x" * 5000 + " " + "ü" * 300 + f" api_key = {token()}\n",
        f"-----BEGIN PRIVATE KEY-----\n{token(64)}\n{token(64)}\n-----END PRIVATE KEY-----\n",
        "",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["candidate"], r["before"], r["after"]) for r in secrets.candidates(docs).collect()}
    near = secrets.CONTEXT
    expected = set()
    for doc, text in enumerate(texts):
        for m in regex.finditer(secrets.CANDIDATE, text or "", regex.V0):
            before = text[max(0, m.start() - near) : m.start()]
            if regex.search("[0-9]", m.group()) or regex.search("[:=] *[\"']?$", before):
                expected.add((doc, m.start(), m.group(), before, text[m.end() : m.end() + near]))
    assert found == expected and len(found) > 700


def test_the_cost_of_a_text_is_in_proportion_to_its_candidates(spark):
    rng = random.Random(4)

    def seconds(n):
        text = " ".join("".join(rng.choice("abcdef0123456789") for _ in range(40)) for _ in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert secrets.candidates(docs).selectExpr("count(after) AS n", "sum(start) AS s").first()["n"] == n
        return time.perf_counter() - began

    seconds(500)
    few = min(seconds(5000) for _ in range(2))
    assert seconds(20_000) < 4 * 2.5 * few
