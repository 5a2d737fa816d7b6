import hashlib
import random
import re

import pytest

from factweave.llm import queries, substrings
from tests.oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone |= set(range(k, k + window))
            seen.add(key)
        left = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), " ".join(left))
    return out


def check(spark, docs, window, gram):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, start int, id string")
    want = brute(docs, window)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(frame, window, gram).collect()}
    assert got == {i: (a, b, hashlib.sha256(t.encode()).hexdigest()) for i, (a, b, t) in want.items()}
    cut = {r.doc_id: " ".join(WORD.findall(r.text)) for r in substrings.remove(frame, window, gram).collect()}
    assert cut == {i: t for i, (_, _, t) in want.items() if t}


def test_equals_sql(spark):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES["op9_substrings"], queries.SQL["op9_substrings"])


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghij"])
def test_random_and_periodic_texts(spark, letters):
    rng = random.Random(len(letters))
    docs = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, " \n\t"), (103, "é x " * 30), (104, docs[5][1]), (105, (docs[3][1] + "\n\n" + docs[4][1]).replace(" ", "\t\r\n"))]
    check(spark, docs, 5, 3)


def test_long_text_and_default_window(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    passage = " ".join(f"p{i}" for i in range(55))
    docs = [(1, long), (2, f"x y z {passage} tail"), (3, f"{passage} other"), (4, " ".join(long.split()[100:119])), (5, " ".join(long.split()[100:120])), (6, "a b c d e f " * 2000)]
    check(spark, docs, substrings.WINDOW, substrings.GRAM)


def test_null_ids_empty_tables_and_repeated_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert substrings.report(frame([])).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    got = sorted((r.doc_id or -1, r.n_removed) for r in substrings.report(frame([(None, text), (7, text), (7, text), (8, text + " end")])).collect())
    assert got == [(-1, 0), (7, 25), (7, 25), (8, 25)]
    assert sorted(r.n_removed for r in substrings.report(frame([(7, text), (7, text)])).collect()) == [0, 0]


def test_texts_that_share_an_id_are_documents_apart(spark):
    """Null and repeated ids: the earlier of two such texts, by hash, keeps what both hold, wherever it starts."""
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, f"{text} {i}") for i in range(40)] + [(5, f"{text} x"), (5, f"{text} y"), (5, f"{text} y")]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, __starts string, _doc int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.report(frame).collect())
    assert got == sorted([(-1, 26, 0)] + [(-1, 26, 25)] * 39 + [(5, 26, 25)] * 3)
    left = substrings.remove(frame).collect()
    assert sorted(len(r.text.split()) for r in left) == [1] * 42 + [26] and left[0].asDict().keys() == set(frame.columns)


def test_many_null_ids(spark):
    from pyspark.sql import functions as F

    frame = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c d e f g h i j k l m n o p q r s "), F.col("id").cast("string"), F.lit(" z")).alias("text"))
    got = substrings.report(frame).agg(F.sum("n_removed"), F.count("*"), F.max("n_words")).first()
    assert tuple(got) == (0, 100_000, 21)


def test_intervals_merge():
    import numpy as np

    assert substrings.merge(np.array([5, 3, 9, 30, 29]), 4) == [(3, 13), (29, 34)]
    assert substrings.merge(np.array([], int), 4) == []
