"""Exact substring deduplication: word windows that also start earlier in the corpus are cut out.

Every ``window``-word window has a Rabin-Karp hash. To count them without shuffling them all, a window is first known by its
minimiser, the smallest hash among the GRAM-word grams inside it: equal windows have equal minimisers, and a document has about
one minimiser per eight words. Minimisers that occur once in the corpus settle their windows as unique. The windows of the
others are counted one by one on 96 bits of their Rabin-Karp hashes; all but the first of equal windows mark their words, and
marked words merge into maximal intervals. Texts with the words of an earlier text are settled whole, before any window is counted.

A null text has no words. A document is a ``doc_id`` with its text: rows that repeat both are one document at one place and
take nothing from each other; texts that share a ``doc_id`` are ordered by a hash. A null ``doc_id`` orders before all others,
and is an id like any other that texts share. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.store import keep, named, outlive, redealt, rewritten, spare, tidy
from factweave.llm.wordhash import U, Words, mix, rolling, slices

WINDOW, GRAM = 20, 8
NO_ID = -(1 << 63)
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2127599BF4325C37)


def _slide(values: np.ndarray, k: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every k consecutive values."""
    size = 1
    while 2 * size <= k:
        values = pick(values[: max(len(values) - size, 0)], values[size:])
        size *= 2
    over = k - size
    return pick(values[: max(len(values) - over, 0)], values[over:]) if over else values


class Windows:
    """Window starts of some documents, their minimisers, and where grams are the minimiser of some window."""

    def __init__(self, column: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.words = words = Words(column)
        self.hashes = words.hashes()
        self.at, self.bounds = words.windows(window)
        self.grams = mix(rolling(self.hashes, gram, BASES[2])) if len(self.hashes) >= gram else np.zeros(0, U)
        w = window - gram + 1
        low = _slide(self.grams, w, np.minimum)
        self.minimiser = low[self.at] if len(self.at) else np.zeros(0, U)
        over = np.zeros(len(self.grams) + w - 1, U)
        over[self.at + w - 1] = self.minimiser
        self.chosen = np.flatnonzero(_slide(over, w, np.maximum) == self.grams) if len(self.at) else np.zeros(0, np.int64)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            split = [(t.as_py() or "").encode().split() for t in batch.column(2)]
            digest = [hashlib.sha256(b" ".join(w)) for w in split]
            halves = np.frombuffer(b"".join(d.digest()[:16] for d in digest), "<i8").reshape(-1, 2)
            columns = [*batch.columns[:2], pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(map(len, split), pa.int64()), pa.array([d.hexdigest() for d in digest], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "doc", "h1", "h2", "n_words", "all_sha256"])


def _minimisers(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Windows(batch.column(2), window, gram)
                doc = np.searchsorted(found.words.first, found.chosen, side="right") - 1
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(found.grams[found.chosen].view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick)], names=["gram", "id", "tie"])

    return run


def _candidates(window: int, gram: int):
    """The windows whose minimiser is among the document's repeated ones, with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Windows(batch.column(2), window, gram)
                grams, cuts = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(U), batch.column(3).offsets.to_numpy()
                cuts = cuts - cuts[0]
                doc = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(cuts))
                mark = U(BASES[0])
                own = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(found.bounds))
                hit = np.flatnonzero(np.isin(mix(found.minimiser + own * mark), mix(grams + doc * mark)))
                at, doc = found.at[hit], own[hit].astype(np.int64)
                k1 = mix(rolling(found.hashes, window, BASES[0]))[at] if len(at) else np.zeros(0, U)
                k2 = mix(rolling(found.hashes, window, BASES[1]))[at] if len(at) else np.zeros(0, U)
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array((k2 >> U(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array((at - found.words.first[doc]).astype(np.int32))],
                    names=["k1", "k2", "id", "tie", "start"],
                )

    return run


def merge(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of the words that windows at ``starts`` cover."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate(([0], new + 1))].tolist(), (starts[np.concatenate((new, [len(starts) - 1]))] + window).tolist(), strict=True))


def _digest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, digest = [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words, left, at = text.as_py().encode().split(), [], 0
                for a, b in merge(np.array(starts.as_py()), window):
                    left += words[at:a]
                    at = b
                left += words[at:]
                gone.append(len(words) - len(left))
                digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc", "cut", "cut_sha256"])

    return run


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _doc() -> Column:
    """A document in one number: its id and text."""
    return F.xxhash64(_id(), "text")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(summary, marked): summary has (id, doc, n_words, all_sha256, later) of every row, later = the words are those of an earlier
    document; marked has (doc, text, starts) of the other documents in which windows start that also start earlier."""
    with tidy(docs.sparkSession):
        text = docs.select(_id().alias("id"), _doc().alias("doc"), "text")
        seen = keep(text.mapInArrow(_summary, "id long, doc long, h1 long, h2 long, n_words long, all_sha256 string"), "texts")
        # few ids have several texts, if any; only there a document's number goes with its id through the shuffles
        torn = keep(seen.groupBy("id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").select(redealt("id"), F.lit(True).alias("torn")), "torn")

        def told_apart(rows: DataFrame) -> DataFrame:
            return rows.join(torn, "id", "left").withColumn("tie", F.when(F.col("torn"), F.col("doc")).otherwise(F.lit(0).cast("long"))).drop("torn")

        first = seen.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(redealt("h1"), "h2", "first")
        later = seen.join(first, ["h1", "h2"], "left").withColumn("later", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
        summary = keep(told_apart(later.drop("first", "h1", "h2")), "summary")
        late = summary.filter("later").select("id", "tie").distinct()
        told = told_apart(text)
        chosen = told.select("id", "tie", "text").mapInArrow(_minimisers(window, gram), "gram long, id long, tie long")

        def repeated(rows: DataFrame) -> DataFrame:
            often = rows.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select(redealt("gram"))
            return rows.join(often, "gram")

        some = keep(repeated(chosen), "minimisers")
        ours = keep(some.join(late, ["id", "tie"], "left_anti"), "minimisers")
        by_doc = repeated(ours).groupBy("id", "tie").agg(F.collect_set("gram").alias("grams"))
        affected = keep(told.join(by_doc, ["id", "tie"]).select("id", "tie", "text", "grams", "doc"), "affected")
        # cheaper to hash again than to store: one pass finds the first place of each window, the other compares with it
        windows = affected.drop("doc").mapInArrow(_candidates(window, gram), "k1 long, k2 int, id long, tie long, start int")
        place = F.struct("id", "tie", "start")
        origin = windows.groupBy("k1", "k2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").select(redealt("k1"), "k2", "origin")
        again = windows.join(origin, ["k1", "k2"]).filter(place > F.col("origin")).groupBy("id", "tie").agg(F.collect_set("start").alias("starts"))
        return outlive(summary.drop("tie"), "summary"), outlive(affected.select("id", "tie", "doc", "text").join(again, ["id", "tie"]).select("doc", "text", "starts"), "marked")


def report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (kept words joined by one blank)."""
    summary, marked = repeats(docs, window, gram)
    cut = marked.mapInArrow(_digest(window), "doc long, cut long, cut_sha256 string").dropDuplicates(["doc"])  # rows of a document are equal
    whole = F.col("later") & (F.col("n_words") >= window)
    return summary.join(cut, "doc", "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"),
    )


def _cut(window: int):
    """The last column has the starts of the windows that go; the others come out, the text without them."""

    def run(batches: Iterator[pa.RecordBatch], at_text: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch.column(at_text), batch.column(batch.num_columns - 1), strict=True):
                raw = text.as_py()
                if starts.is_valid and raw:
                    words = Words(pa.array([raw]))
                    data, left, at = raw.encode(), [], 0
                    for a, b in merge(np.array(starts.as_py()), window):
                        left.append(data[at : words.starts[a]])
                        at = int(words.starts[b]) if b < len(words.starts) else len(data)
                    raw = b"".join([*left, data[at:]]).decode()
                out.append(raw)
            yield batch.select(list(range(batch.num_columns - 1))).set_column(at_text, batch.schema.names[at_text], pa.array(out, pa.string()))

    return run


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without the repeated words (their following white space goes with them); documents left without a word go."""
    summary, marked = repeats(docs, window, gram)
    doc, starts, whole = spare(docs, "doc", "starts", "whole")
    all_gone = summary.filter(F.col("later") & (F.col("n_words") >= window)).select("doc", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    cuts = marked.select("doc", F.sort_array("starts").alias("starts"), F.lit(False).alias("whole")).unionByName(all_gone).dropDuplicates(["doc"])
    cuts = cuts.select(F.col("doc").alias(doc), F.col("starts").alias(starts), F.col("whole").alias(whole))
    found = docs.join(cuts, _doc() == F.col(doc), "left").filter(~F.coalesce(F.col(whole), F.lit(False))).select(*named(docs), starts)
    return rewritten(docs, found, _cut(window)).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
