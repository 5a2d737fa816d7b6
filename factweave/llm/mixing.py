"""Mixing sources to target weights, to the exact word.

Documents get hash-random keys. The key space is cut in ranges; sums of sizes over ranges, and inside ranges, give every
document its place in its source's random order without gathering a source anywhere. A source's budget is met by whole
passes over it and a last pass that stops in the middle of a document if need be.

A null text has size 0; a null source is a source, ordered last. The key hangs on ``doc_id`` and text, so that null or repeated
ids spread over the key space; rows equal in both and in source are one place in the order with a number of copies, which are
taken one after the other. Extra columns pass through, whatever their names.

Sources are counted on the driver (one row a source); more than ``max_sources`` are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factweave.llm.store import keep, named, one_each, rewritten, spare

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS, MAX_SOURCES, COPIES = 3, 100_000, 10_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> dict[str | None, float]:
    """Words to take of each source: all words shared by weight, none above ``epochs`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, share, out = sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(order, key=lambda s: epochs * sizes[s] / weight[s]):
        if s not in out and epochs * sizes[s] < rest / share * weight[s]:
            out[s] = float(epochs * sizes[s])
            rest, share = rest - epochs * sizes[s], share - weight[s]
    return {s: out.get(s, rest / share * weight[s] if share else 0.0) for s in order}


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: str = "mix", max_sources: int = MAX_SOURCES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, text_hash."""
    own = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\n"), F.coalesce("text", F.lit("")))
    key = F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"), F.xxhash64("text").alias("text_hash"))
    rows = keep(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "sizes")
    rows = rows.withColumn("bucket", F.shiftright("key", 44)).withColumn("named", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["source"]: r["n"] for r in totals}
    plan = [("-" if s is None else f"+{s}", sizes[s], t) for s, t in targets(sizes, weights, epochs).items()]
    goal = rows.sparkSession.createDataFrame(plan, T.StructType([T.StructField("named", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))

    # prefix sums: over groups of 256 ranges, over the ranges of a group, inside a range
    sums = rows.groupBy("named", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).withColumn("group", F.shiftright("bucket", 8))
    upto = sums.withColumn("in_group", F.sum("n").over(Window.partitionBy("named", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    groups = sums.groupBy("named", "group").agg(F.sum("n").alias("g"))
    groups = groups.withColumn("before_group", F.sum("g").over(Window.partitionBy("named").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))).drop("g")
    start = upto.join(groups, ["named", "group"]).select("named", "bucket", (F.coalesce("in_group", F.lit(0)) + F.coalesce("before_group", F.lit(0))).alias("base"))
    inside = Window.partitionBy("named", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))).join(start, ["named", "bucket"]).join(F.broadcast(goal), "named")
    # copies come out in two steps, so that no array grows with their number
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    placed = placed.select("*", many.alias("lot")).withColumn("copy", F.explode(F.sequence("lot", F.least(F.col("lot") + COPIES, "copies") - 1)))
    budget = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    last = budget - passes * F.col("source_size") - F.col("base") - F.col("ahead") - F.col("copy") * F.col("size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash")


def _copies(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The last two columns are sizes and words to take; the others come out, each row as often as it is taken."""
    for batch in batches:
        size, taken = (batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))
        whole = [i for i in range(batch.num_rows) for _ in range(taken[i] // size[i])]
        part = [i for i in range(batch.num_rows) if taken[i] % size[i]]
        base = batch.select(list(range(batch.num_columns - 2)))
        yield base.take(pa.array(whole, pa.int64()))
        if part:
            texts = []
            for i in part:
                data = batch.column(at)[i].as_py().encode()
                rest = data.split(None, taken[i] % size[i])[-1]
                texts.append(data[: len(data) - len(rest)].rstrip(b" \t\n\r\x0b\x0c").decode())
            yield base.take(pa.array(part, pa.int64())).set_column(at, base.schema.names[at], pa.array(texts, pa.string()))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, all columns of ``docs``: documents as often as they are taken, the last of a source cut to its budget.

    Of rows equal in doc_id, text and source, one stands for all; which one, its other columns settle.
    """
    doc, source, text_hash, size, taken = spare(docs, "id", "source", "hash", "size", "taken")
    found = mix(docs, **how).groupBy("doc_id", "source", "text_hash").agg(F.max("size").alias(size), F.sum("taken").alias(taken)).filter(F.col(taken) > 0)
    found = found.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("text_hash").alias(text_hash), size, taken)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.xxhash64("text") == F.col(text_hash))
    return rewritten(docs, one_each(docs.join(found, same), doc, source, text_hash).select(*named(docs), size, taken), _copies)
