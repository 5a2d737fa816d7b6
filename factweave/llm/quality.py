"""Cross-document line frequency: boilerplate lines of a host go, and documents that consist of them are rejected.

Null text is an empty document; a null source is a host of its own; a null ``doc_id`` passes through. Every row counts as
one document, so repeated rows count repeatedly. Other input columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.store import keep, named, outlive, redealt, rewritten, spare, tidy
from factweave.llm.wordhash import SPACE, Words, mix, per_doc, rolling, slices

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
PROFILE = (
    "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, line_hash array<long>, line_words array<int>"
)


TO_BLANK = {i: i + 32 for i in range(65, 91)} | dict.fromkeys((9, 11, 12, 13), 32)


def _plain(line: str) -> tuple[str, int]:
    """The normalised line (ASCII lower case, one blank between words) and its number of words."""
    words = [w for w in line.translate(TO_BLANK).split(" ") if w]
    return " ".join(words), len(words)


def _repeated_words(words: Words) -> np.ndarray:
    """Words of each document that lie in a 3-word window found twice or more in it."""
    at, bounds = words.windows(3)
    hit = np.zeros(len(words.starts) + 1, bool)
    if len(at):
        grams = rolling(words.hashes(), 3, 0xA0761D6478BD642F)[at]
        doc = np.repeat(np.arange(words.docs, dtype=np.uint64), np.diff(bounds))
        grams = mix(grams + doc * np.uint64(0xE7037ED1A0B428DB))
        order = np.argsort(grams)
        ranked = grams[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(ranked), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = at[order[twice]]
        for k in range(3):
            hit[found + k] = True
    return per_doc(hit[:-1], words.first)


def _lines(text: str, host: str) -> tuple[int, list[int], list[int]]:
    """(lines equal to an earlier one, hashes of the distinct normalised lines, their words in all)."""
    raw, found, again = set(), Counter(), 0
    for line in text.split("\n"):
        plain, n = _plain(line)
        if n:
            again += line in raw
            raw.add(line)
            found[plain] += n
    return again, [xxhash.xxh3_64_intdigest(f"{host}\n{x}") for x in found], list(found.values())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, texts, hosts, hashes = (batch.column(i) for i in range(4))
            words = Words(texts)
            seen = ~words.space & ((words.data & 0xC0) != 0x80)
            lines = [_lines(t or "", f"+{h}" if h is not None else "-") for t, h in zip(texts.to_pylist(), hosts.to_pylist(), strict=True)]
            sizes = np.concatenate(([0], np.cumsum([len(x[1]) for x in lines]))).astype(np.int32)
            flat = np.array([h for x in lines for h in x[1]], np.uint64).view(np.int64)
            in_line = np.array([n for x in lines for n in x[2]], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    hosts.cast(pa.string()),
                    hashes,
                    pa.array(words.counts, pa.int64()),
                    pa.array(per_doc(seen, words.offs), pa.int64()),
                    pa.array(per_doc(SYMBOL[words.data], words.offs), pa.int64()),
                    pa.array([x[0] for x in lines], pa.int64()),
                    pa.array(_repeated_words(words), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(in_line)),
                ],
                names=["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"],
            )


def judge(
    docs: DataFrame,
    min_docs: int = 20,
    max_share: float = 0.01,
    min_left_words: int = 25,
    min_left_share: float = 0.3,
    min_words: int = 50,
    max_repeat_share: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): figures, removed lines and the verdict.

    A normalised line is above its host's limit when more than ``min_docs`` documents and more than ``max_share`` of the
    documents of that host hold it. All its occurrences on the host go. A document is depleted when fewer than
    ``min_left_words`` words, or less than ``min_left_share`` of its words, are left.
    """
    with tidy(docs.sparkSession):
        rows = docs.select("doc_id", "text", F.col("source").alias("host"), F.xxhash64("text").alias("text_hash"))
        profile = keep(rows.mapInArrow(_profile, PROFILE).withColumn("row_id", F.monotonically_increasing_id()), "lines")
        lines = profile.select("row_id", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("line")).select("row_id", "host", "line.*")
        hosts = profile.groupBy("host").agg(F.count("*").alias("host_docs"))
        counted = lines.groupBy("line_hash").agg(F.count("*").alias("held_by"), F.first("host").alias("line_host")).filter(F.col("held_by") > min_docs)
        frequent = counted.join(hosts, F.col("line_host").eqNullSafe(F.col("host"))).filter(F.col("held_by") > F.col("host_docs") * max_share).select(redealt("line_hash"))
        removed = lines.join(frequent, "line_hash").groupBy("row_id").agg(F.sum("line_words").alias("removed_words"), F.collect_set("line_hash").alias("removed_lines"))
        base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat_share)
        left = F.col("n_words") - F.col("removed_words")
        verdict = (
            profile.drop("line_hash", "line_words")
            .join(removed, "row_id", "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
            .withColumn("base_failed", base)
            .withColumn("depleted", (left < min_left_words) | (left < F.col("n_words") * min_left_share))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
            .drop("row_id")
        )
        return outlive(verdict, "verdicts")


def _without(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The last two columns are the host and the lines that go; the others come out, the text without those lines."""
    for batch in batches:
        texts, hosts, gone = (batch.column(i).to_pylist() for i in (at, batch.num_columns - 2, batch.num_columns - 1))
        out = []
        for text, host, lines in zip(texts, hosts, gone, strict=True):
            if lines and text:
                bad, own = set(lines), f"+{host}" if host is not None else "-"
                left = []
                for line in text.split("\n"):
                    plain, n = _plain(line)
                    h = xxhash.xxh3_64_intdigest(f"{own}\n{plain}") if n else None
                    if h is None or (h - (1 << 64) if h >> 63 else h) not in bad:
                        left.append(line)
                text = "\n".join(left)
            out.append(text)
        yield batch.select(list(range(batch.num_columns - 2))).set_column(at, batch.schema.names[at], pa.array(out, pa.string()))


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents, all columns of ``docs``, without their lines above the limit; ``n_chars`` follows the text."""
    doc, host, text_hash, gone = spare(docs, "id", "host", "hash", "gone")
    verdict = judge(docs, **limits).filter("kept").groupBy("doc_id", "host", "text_hash").agg(F.first("removed_lines").alias(gone))
    verdict = verdict.select(F.col("doc_id").alias(doc), F.col("host").alias(host), F.col("text_hash").alias(text_hash), gone)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(host)) & (F.xxhash64("text") == F.col(text_hash))
    found = docs.join(verdict, same).select(*named(docs), host, gone)
    return rewritten(docs, found, _without)
