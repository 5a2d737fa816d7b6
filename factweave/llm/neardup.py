"""Near-duplicate groups by b-bit MinHash, exact in the end.

1. One pass over the texts gives each document its set of word shingles as a fingerprint, K minima of which the low B bits are
   packed into a signature, and one key per band of minima. Documents with equal sets are one representative from here on.
2. Each band bucket names a pivot; members are compared with it by bit counts of the packed signatures, corrected for chance
   collisions. Estimates that may reach the threshold are confirmed on the full sets. The links found this way form groups.
3. Members of a bucket that are still in different groups are compared with one another, in blocks: those outside the
   bucket's largest group against all. Pairs inside one group need no further link. Again the full sets decide.
4. Connected components over all links.

With R minima a band and K / R bands, a pair at the threshold of 0.8 shares no band with probability (1 - 0.8**R) ** (K / R),
5e-8 for R = 4 and K = 128; the estimate is given Z = 4.5 standard deviations of room.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.llm.components import components
from factweave.llm.store import keep, one_each, outlive, redealt, spare, tidy
from factweave.llm.wordhash import U, Words, mix, rolling, slices

K, R, B, Z = 128, 4, 4, 4.5
BANDS, LANES = K // R, 64 // B
BLOCK = 256
GRAM_BASE = 0xA24BAED4963EE407
TILE = 1 << 15
_seed = np.random.Generator(np.random.PCG64(20_26))
MUL = _seed.integers(0, 1 << 63, K, dtype=np.uint64) * U(2) + U(1)
ADD = _seed.integers(0, 1 << 63, K, dtype=np.uint64)
SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_hi long, set_lo long, signature array<long>, bands array<long>"


def room(threshold: float, k: int = K, b: int = B, z: float = Z) -> float:
    """The least estimate that a pair at ``threshold`` may show."""
    chance = 2.0**-b
    agree = threshold + (1 - threshold) * chance
    return threshold - z * math.sqrt(agree * (1 - agree) / k) / (1 - chance)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, one document after another; bounds). Shorter documents have their whole sequence."""
    h = words.hashes()
    at, bounds = words.windows(size)
    grams = rolling(h, size, GRAM_BASE)[at] if len(at) else np.zeros(0, U)
    grams = mix(grams + U(size))
    out, n = [], np.zeros(words.docs, np.int64)
    for d in range(words.docs):
        if words.counts[d] >= size:
            own = np.unique(grams[bounds[d] : bounds[d + 1]])
        elif words.counts[d]:
            own = mix(rolling(h[words.first[d] : words.first[d + 1]], int(words.counts[d]), GRAM_BASE) + U(int(words.counts[d])))
        else:
            continue
        out.append(own)
        n[d] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate(([0], np.cumsum(n)))


def minima(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """K minima of each non-empty set, as rows."""
    starts = bounds[:-1]
    out = np.full((K, len(starts)), np.iinfo(np.uint64).max, U)
    at = 0
    while at < len(starts):  # tiles of whole sets that stay in the cache
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TILE, side="right")) - 1)
        part, cuts = sets[bounds[at] : bounds[to]], starts[at:to] - bounds[at]
        room_ = np.empty(len(part), U)
        for i in range(K):
            np.multiply(part, MUL[i], out=room_)
            room_ += ADD[i]
            out[i, at:to] = np.minimum.reduceat(room_, cuts)
        at = to
    return out.T


def pack(mins: np.ndarray) -> np.ndarray:
    """The signature: B bits of each minimum, LANES to a 64-bit word."""
    low = ((mins >> U(17)) & U((1 << B) - 1)).reshape(len(mins), K // LANES, LANES)
    return (low << (np.arange(LANES, dtype=np.uint64) * U(B))).sum(2, dtype=np.uint64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    parts = mins.reshape(len(mins), BANDS, R)
    key = np.arange(BANDS, dtype=np.uint64) * U(0x9FB21C651E98DF25)
    for i in range(R):
        key = mix(key + parts[:, :, i])
    return key


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(1), lower=True)
                sets, bounds = shingle_sets(words, size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                tight = np.concatenate((bounds[full], bounds[-1:]))
                hi, lo = np.zeros(len(n), U), np.zeros(len(n), U)
                sig, keys = np.zeros((0, K // LANES), U), np.zeros((0, BANDS), U)
                if len(full):
                    hi[full] = mix(np.add.reduceat(sets, tight[:-1]) + n[full].astype(U))
                    lo[full] = mix(np.add.reduceat(mix(sets ^ U(0x2545F4914F6CDD1D)), tight[:-1]))
                    mins = minima(sets, tight)
                    sig, keys = pack(mins), band_keys(mins)

                def rows(a: np.ndarray) -> pa.Array:
                    cuts = np.concatenate(([0], np.cumsum(np.where(n > 0, a.shape[1], 0)))).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(a.reshape(-1).view(np.int64)))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), rows(sig), rows(keys)],
                    names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "signature", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, bounds = shingle_sets(Words(batch.column(1), lower=True), size)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "shingles"]
                )

    return run


def _confirm(threshold: float):
    """Of pairs with their full sets, those with 100 * intersection >= 100 * threshold * union."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def estimate(x, y):
    """Similarity of two packed signature columns: lanes that differ are counted by bits, agreement is freed of chance."""
    lane = int("1" * LANES, 16) if B == 4 else None
    signed = lane - (1 << 64) if lane >> 63 else lane

    def differ(a, b):
        v = a.bitwiseXOR(b)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        return F.bit_count(v.bitwiseAND(F.lit(signed)))

    apart = F.aggregate(F.zip_with(x, y, differ), F.lit(0), lambda n, v: n + v)
    return ((F.lit(1.0) - apart / K) - 2.0**-B) / (1 - 2.0**-B)


CELL = ["bucket", "r", "c"]


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by cell, as tables of whole cells with the bounds of each; a cell never spans two tables."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        keys = [np.asarray(rows[c]) for c in CELL]
        starts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(starts):
            yield rows.slice(0, starts[-1]), [0, *starts.tolist()]
        held = rows.slice(starts[-1]) if len(starts) else rows
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = np.asarray(column.combine_chunks().flatten() if column.num_chunks != 1 else column.chunk(0).flatten())
    return values.reshape(len(column), -1)


def _cells(least: float, threshold: float):
    """Of each cell, the documents that may be similar to one of another group: (bucket, r, c, id, ids of the other ones).

    A pair is named by one side only, and only in the first band that both share.
    """
    lanes = U(int("1" * LANES, 16))
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _by_cell(batches):
            ids, grp, n, role, outer, bucket = (np.asarray(rows[c]) for c in ("id", "grp", "n_shingles", "role", "outer", "bucket"))
            sig, bands = _matrix(rows["signature"]).view(U), _matrix(rows["bands"])
            out_at, out_id, out_others = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                left, right = lo + np.flatnonzero(role[lo:hi] == 0), lo + np.flatnonzero(role[lo:hi] == 1)
                named: dict[int, list[int]] = {}
                for i in left:
                    # two outsiders meet twice; the smaller id keeps the pair
                    j = right[(grp[right] != grp[i]) & (~outer[right] | (ids[right] > ids[i])) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
                    if len(j):
                        v = sig[j] ^ sig[i]
                        v |= v >> U(2)
                        v |= v >> U(1)
                        apart = np.bitwise_count(v & lanes).sum(1)
                        j = j[((1 - apart / K) - 2.0**-B) / (1 - 2.0**-B) >= least]
                    if len(j):
                        j = j[bands[i][(bands[j] == bands[i]).argmax(1)] == bucket[i]]
                    if len(j):
                        named[int(ids[i])] = ids[j].tolist()
                        for x in ids[j].tolist():
                            named.setdefault(x, [])
                out_at += [lo] * len(named)
                out_id += named.keys()
                out_others += named.values()
            at = pa.array(out_at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(rows[c].combine_chunks().take(at) for c in CELL), pa.array(out_id, pa.int64()), pa.array(out_others, pa.list_(pa.int64()))], names=[*CELL, "id", "others"]
            )

    return run


def _settle(threshold: float):
    """Of each cell, the links between its named documents by their full sets, as few as join the same ones."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _by_cell(batches):
            ids, others = rows["id"].to_pylist(), rows["others"].to_pylist()
            raw = rows["shingles"].to_pylist()
            links: list[tuple[int, int]] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                sets = {ids[k]: np.frombuffer(raw[k], U) for k in range(lo, hi)}
                root = {i: i for i in sets}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for k in range(lo, hi):
                    a, own = ids[k], sets[ids[k]]
                    open_ = [b for b in others[k] if find(b) != find(a)]
                    for at in range(0, len(open_), 256):
                        some = open_[at : at + 256]
                        every = np.concatenate([sets[b] for b in some])
                        sizes = np.array([len(sets[b]) for b in some])
                        place = np.minimum(np.searchsorted(own, every), len(own) - 1)
                        both = np.add.reduceat((own[place] == every).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                        for b in np.array(some)[100 * both >= percent * (sizes + len(own) - both)].tolist():
                            x, y = find(a), find(b)
                            if x != y:
                                root[x] = y
                                links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def groups(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z. Documents are linked when intersection / union of their sets of ``size``-word shingles reaches
    ``threshold``; a document of fewer words has its whole sequence as its set, one without words (or null text) no set and no
    link. ``component_id`` is the smallest ``doc_id`` reachable, ``kept`` marks the row that bears it. Texts that share a
    ``doc_id`` are one document, linked through each of them. Repeated rows are copies like any other, and all rows that bear the
    component's id are kept. A null ``doc_id`` takes no part: its component is null and it is kept. Extra columns are ignored.
    """
    with tidy(docs.sparkSession):
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        least = room(threshold)
        seen = keep(text.mapInArrow(_signatures(size), SIGNATURE), "signatures")
        part = seen.filter("n_shingles > 0 and doc_id is not null")
        # representatives: each set under the id of its smallest document; where a document is that of several sets, all but
        # one of them get a number beyond all ids
        first = part.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        several = first.groupBy("first").agg(F.count("*").alias("n"), F.min(F.struct("set_hi", "set_lo")).alias("own")).filter("n > 1").select(redealt("first"), "own")
        other = F.col("own").isNotNull() & (F.struct("set_hi", "set_lo") != F.col("own"))
        beyond = F.lit(1 << 62) + F.pmod(F.xxhash64("first", "set_hi", "set_lo"), F.lit(1 << 62))
        first = keep(first.join(several, "first", "left").select("set_hi", "set_lo", "first", "copies", F.when(other, beyond).otherwise(F.col("first")).alias("id")), "sets")
        copied = first.filter("copies > 1 or id <> first").select(redealt("set_hi"), redealt("set_lo"), "first", "id")
        known = part.join(copied, ["set_hi", "set_lo"], "left").withColumn("id", F.coalesce("id", "doc_id"))
        member = keep(known.select("doc_id", "id").distinct(), "members")
        reps = known.filter("first is null or doc_id = first").select("id", "doc_id", "text_hash", "n_shingles", "signature", "bands")
        reps = keep(reps.dropDuplicates(["id"]), "representatives")  # rows of an id have one set
        torn = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select(redealt("doc_id"), "a")
        same = member.join(torn, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
        entries = reps.select("id", F.explode("bands").alias("bucket"))
        crowded = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select(redealt("bucket"))
        shared = keep(entries.join(crowded, "bucket"), "buckets")
        pivots = shared.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", "bucket")).alias("pivot")).select(redealt("bucket"), "pivot")
        met = shared.join(pivots, "bucket")
        involved = shared.select("id").distinct()
        facts = keep(reps.join(involved, "id", "left_semi"), "facts")
        ours = text.join(facts.select("id", "doc_id", "text_hash"), ["doc_id", "text_hash"]).select("id", "text")
        sets = keep(ours.mapInArrow(_sets(size), "id long, shingles binary"), "sets").dropDuplicates(["id"])

        def confirmed(pairs: DataFrame) -> DataFrame:
            x, y = (sets.select(F.col("id").alias(e), F.col("shingles").alias(f"s{e}")) for e in "ab")
            return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(threshold), "a long, b long")

        # members against pivots: the four most promising pivots of each member
        x, y = (facts.select(F.col("id").alias(e), F.col("signature").alias(f"g{e}"), F.col("n_shingles").alias(f"n{e}")) for e in "ab")
        star = met.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
        likely = star.join(y, "b").join(x, "a").filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold).select("a", "b", estimate(F.col("ga"), F.col("gb")).alias("guess")).filter(F.col("guess") >= least)
        best = likely.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("guess"), "b"))).filter("r <= 4").select("a", "b")
        links = keep(confirmed(best).unionByName(same), "links")
        grouped = components(links)

        # what is still apart inside a bucket
        placed = shared.join(grouped.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("grp"))
        by_group = placed.groupBy("bucket", "grp").agg(F.count("*").alias("n"))
        split = (
            by_group.groupBy("bucket").agg(F.sum("n").alias("n"), F.max_by("grp", F.struct("n", "grp")).alias("main"), F.max("n").alias("n_main")).filter("n > n_main")
            .select("bucket", "main", F.ceil(F.col("n") / BLOCK).alias("across"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).alias("down"))
        )
        apart = placed.join(split, "bucket").withColumn("outer", F.col("grp") != F.col("main")).withColumn("h", F.xxhash64("id"))
        own_row, own_column = F.pmod("h", F.col("down")), F.pmod("h", F.col("across"))
        as_left = apart.filter("outer").select("*", F.lit(0).alias("role"), own_row.alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("c"))
        as_right = apart.select("*", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("r"), own_column.alias("c"))
        blocks = as_left.select("bucket", "id", "grp", "outer", "role", "r", "c").unionByName(as_right.select("bucket", "id", "grp", "outer", "role", "r", "c"))
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # cells are small but cost time

        def dealt(rows: DataFrame) -> DataFrame:
            return rows.repartition(parts, *CELL).sortWithinPartitions(*CELL)

        cells = dealt(blocks.join(facts, "id").select(*blocks.columns, "n_shingles", "signature", "bands"))
        named = cells.mapInArrow(_cells(least, threshold), "bucket long, r long, c long, id long, others array<long>")
        more = dealt(named.join(sets, "id")).select(*CELL, "id", "others", "shingles").mapInArrow(_settle(threshold), "a long, b long")
        final = components(links.unionByName(more))

        placed = member.select("doc_id", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id")).distinct()
        found = (
            seen.select("doc_id", "n_shingles")
            .join(placed, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("doc_id").isNull() | (F.coalesce("component_id", "doc_id") == F.col("doc_id"))).alias("kept"))
        )
        return outlive(found, "groups")


def unique(docs: DataFrame, **how) -> DataFrame:
    """One document of each group, all columns of ``docs``. Of rows that repeat the kept ``doc_id`` one stays; which one, their
    columns settle."""
    (doc,) = spare(docs, "id")
    kept = groups(docs, **how).filter("kept and doc_id is not null").select(F.col("doc_id").alias(doc)).distinct()
    known = one_each(docs.join(kept, F.col("doc_id") == F.col(doc), "left_semi"), "doc_id")
    return known.unionByName(docs.filter("doc_id is null"))
