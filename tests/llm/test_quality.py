import re
from collections import Counter

from factweave.llm import queries, quality
from tests.oracle import same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_words string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def test_equals_sql(spark):
    same(spark, SF, queries.QUERIES["op1_line_quality"], queries.SQL["op1_line_quality"])


def test_figures_on_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a b a b a b a b", "é|ü #\x0b x y z", "l\nl\n l\nl", "w " * 30_000, "x" * 200_000, "one\r\ntwo\r\none\r\n", "a b c\na b c\nd", "𐍈 𐍈 𐍈 𐍈"]
    rows = [(i if i else None, t, None if i % 2 else "s", "x", 1) for i, t in enumerate(texts)]
    out = quality.judge(spark.createDataFrame(rows, SCHEMA)).toPandas()
    got = sorted(map(tuple, out[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].to_numpy().tolist()))
    assert got == sorted(figures(t or "") for t in texts)
    assert not out[out.n_words < 50].kept.any()


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality.clean(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frequent_lines_go_and_depleted_documents_too(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    rows = [(i, f"{own[i]}\nCommon  LINE here", "h", "x", 1) for i in range(30)]
    rows += [(100 + i, "\n".join(["common line here"] * 25), "h", "x", 1) for i in range(5)]
    rows += [(200, f"{own[0]} z\ncommon line here", "other", "x", 1), (201, f"{own[1]} z\nrare line", None, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert sorted(out) == [*range(30), 200, 201]
    assert out[3].text == own[3] and out[200].text.endswith("common line here") and out[3].n_words == "x"
    assert quality.clean(docs).columns == docs.columns


def test_repeated_rows_each_count(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "h", "x", 1)] * 3, SCHEMA)
    assert quality.judge(docs).filter("kept").count() == 3 and quality.clean(docs).count() == 3


def test_columns_of_any_name_pass_through(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "h", "x", 1, "y")], "doc_id long, text string, source string, __note string, _gone int, `a.b` string")
    (row,) = quality.clean(docs).collect()
    assert tuple(row) == (1, text, "h", "x", 1, "y") and list(row.asDict()) == docs.columns
