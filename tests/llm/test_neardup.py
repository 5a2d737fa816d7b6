import random
import re

import numpy as np
import pytest

from factweave.llm import neardup, queries
from factweave.llm.components import components
from tests.oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, size, percent=80):
    sets = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_equals_sql(spark):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES["op2_minhash"], queries.SQL["op2_minhash"])


def test_near_copies_and_chains(spark):
    rng = random.Random(3)
    docs = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.choice([12, 60, 200]))]
        docs.append(" ".join(base))
        for _ in range(8):  # a chain: each is an edit of the one before
            base = base[:]
            base[rng.randrange(len(base))] = f"new{rng.random()}"
            docs.append(" ".join(base).title() if rng.random() < 0.3 else " ".join(base))
    docs += ["", None, " \n", "a", "A", "a b", "a b c", "a  b\tc", "x" * 5000, "É a b c d", "é a b c d"]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    out = neardup.groups(spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id long, text string, component_id string, id int"), size=5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    assert got == brute(rows, 5)


def test_a_bucket_of_many_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(40):
        own = base[:]
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(80)] = f"n{rng.random()}"
        docs.append((i, " ".join(own)))
    out = neardup.groups(spark.createDataFrame(docs, "doc_id long, text string"), size=4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute(docs, 4)


def test_empty_nulls_and_repeated_rows(spark):
    assert neardup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.groups(docs).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert sorted(r.doc_id or -1 for r in neardup.unique(docs).collect()) == [-1, -1, 3]


def test_texts_that_share_an_id_are_one_document(spark):
    """Repeated ids with different texts join what any of their texts is linked with, and one of their rows stays."""
    rng = random.Random(8)
    texts = [" ".join(f"g{g}w{i}" for i in range(90)) for g in range(9)]
    near = [t.replace("w7 ", "x7 ") for t in texts]
    rows = [(5, texts[0]), (5, texts[1]), (9, near[0]), (11, near[1]), (11, texts[2]), (20, near[2]), (30, texts[3]), (2, texts[4]), (2, texts[5]), (2, texts[6]), (2, near[6]), (40, texts[7]), (40, None), (41, "")]
    rows += [(3, texts[4]), (50, texts[5]), (50, texts[8]), (51, near[8]), (5, texts[0])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, f"{k}", "m") for k, r in enumerate(rows)], "doc_id long, text string, id string, `_id.x` string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.groups(docs).collect()}
    group = {5: 5, 9: 5, 11: 5, 20: 5, 30: 30, 2: 2, 3: 2, 50: 2, 51: 2, 40: 40, 41: 41}
    assert {i: c for (i, _), c in got.items()} == group and neardup.groups(docs).count() == len(rows)
    one, two = ([sorted(map(repr, neardup.unique(d).collect()))] for d in (docs, docs.repartition(7)))
    assert one == two and len(one[0]) == 5
    alike = spark.createDataFrame([(7, f"{t} {i}") for i, t in enumerate(texts * 20)], "doc_id long, text string")
    assert {r.component_id for r in neardup.groups(alike).collect()} == {7}


def test_estimate_is_unbiased_and_the_room_is_wide():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8):
        guesses = []
        for _ in range(60):
            n = 400
            both = int(n * 2 * share / (1 + share))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n : 2 * n - both])))
            mins = neardup.minima(np.concatenate((a, b)), np.array([0, n, 2 * n]))
            x, y = neardup.pack(mins)
            v = x ^ y
            v |= v >> np.uint64(2)
            v |= v >> np.uint64(1)
            apart = np.bitwise_count(v & np.uint64(int("1" * neardup.LANES, 16))).sum()
            guesses.append(((1 - apart / neardup.K) - 2.0**-neardup.B) / (1 - 2.0**-neardup.B))
        assert abs(np.mean(guesses) - share) < 0.03
        assert share < 0.8 or min(guesses) > neardup.room(0.8)


@pytest.mark.parametrize("n", [1, 50])
def test_components_of_a_path_and_a_star(spark, n):
    rows = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n + 1)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n + 1)}
