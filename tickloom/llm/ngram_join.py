"""Near-duplicate documents by the Jaccard similarity of their word n-gram sets.

Rare-first prefix filtering. Shingles are ordered by (document frequency, key); two sets that
are similar enough share a shingle of their prefixes. A frequency above `SATURATED` counts as
`SATURATED`, which is still one order for all documents.

1. Texts become sets of 64-bit shingle keys. Sets that are equal become one set from then on.
2. One shuffle brings the keys, packed by hash range, to where they are counted. Keys of one
   set only can match nothing; they stay behind, but count as the rarest in their set.
3. A set can only be similar to another if its shared keys reach the threshold. The others end here.
4. Sets that share prefix keys form clusters (connected components over key -> smallest set).
   Clusters are cut into blocks; each pair of blocks is a task's group.
5. In a group, pairs with a common prefix key pass the length, positional and suffix filters and
   are verified once, unless both sides are connected already. A group returns a spanning forest.
6. Components of all forests.

No pair is a row anywhere, so a group of copies costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import (
    U64, components, longs, mixed, parts, shingle_keys, slices, stored, whole_groups, word_keys, words_of,
)
from tickloom.session import ship_by_value

SATURATED = 65_536
BLOCK = 1_024
PER_RANGE = 2_000_000
PIVOTS = 16
BATCH = 1_000_000


def signature(keys: np.ndarray) -> int | None:
    """A 64-bit name for a set of keys; none for the empty set."""
    if len(keys) == 0:
        return None
    return int(mixed(np.array([mixed(keys ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) + U64(len(keys))], U64)).view(np.int64)[0])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = word_keys()
        for ids, texts in slices(batches):
            sets = [shingle_keys(seen.of(words_of(t)), n) for t in texts]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64())],
                names=["id", "n", "sig"],
            )

    return run


def _ranges(n: int, ranges: int):
    """Per hash range, the keys of the sets of a batch: names, sizes, how many keys of each fall here, keys."""

    def pack(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        sigs = np.array(list(held), np.int64)
        sizes = np.array([len(s) for s in held.values()], np.int32)
        keys = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(sigs), dtype=np.int32), sizes)
        at = ((keys >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        at, keys, owner = at[order], keys[order], owner[order]
        cuts = np.searchsorted(at, np.arange(ranges + 1))
        rows = []
        for r in range(ranges):
            a, b = cuts[r], cuts[r + 1]
            if a < b:
                who, counts = np.unique(owner[a:b], return_counts=True)
                rows.append((r, sigs[who].tobytes(), sizes[who].tobytes(), counts.astype(np.int32).tobytes(), keys[a:b].tobytes()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["range", "sigs", "sizes", "counts", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, total = word_keys(), {}, 0
        for (texts,) in slices(batches):
            for t in texts:
                s = shingle_keys(seen.of(words_of(t)), n)
                name = signature(s)
                if name is not None and name not in held:
                    held[name] = s
                    total += len(s)
                if total >= BATCH:
                    yield pack(held)
                    held, total = {}, 0
        if held:
            yield pack(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the keys of one or more hash ranges, those in two sets at least, with their frequency."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    heavy = np.empty(0, U64)
    size, limit = 0, 4 * PER_RANGE

    def batch(keys, sigs, sizes, df) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            j = slice(i, i + 100_000)
            yield pa.record_batch([pa.array(sigs[j]), pa.array(sizes[j]), longs(keys[j]), pa.array(df[j])], names=["sig", "n", "key", "df"])

    def merged() -> tuple[np.ndarray, ...]:
        """Distinct (key, set), sorted, and the frequency of each row's key."""
        keys, sigs, sizes = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((sigs, keys))
        keys, sigs, sizes = keys[order], sigs[order], sizes[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (sigs[1:] != sigs[:-1])]
        keys, sigs, sizes = keys[new], sigs[new], sizes[new]
        _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return keys, sigs, sizes, counts[at].astype(np.int32)

    for source in batches:
        for row in zip(*[c.to_pylist() for c in source.columns[1:]]):
            sigs, sizes, counts, keys = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int32, np.int32, U64)))
            sigs, sizes = np.repeat(sigs, counts), np.repeat(sizes, counts)
            if len(heavy):
                known = np.isin(keys, heavy)
                yield from batch(keys[known], sigs[known], sizes[known], np.full(int(known.sum()), SATURATED, np.int32))
                keys, sigs, sizes = keys[~known], sigs[~known], sizes[~known]
            held.append((keys, sigs, sizes))
            size += len(keys)
        if size > limit:
            keys, sigs, sizes, df = merged()
            over = df >= SATURATED
            yield from batch(keys[over], sigs[over], sizes[over], np.full(int(over.sum()), SATURATED, np.int32))
            heavy = np.union1d(heavy, keys[over])
            held = [(keys[~over], sigs[~over], sizes[~over])]
            size = len(held[0][0])
            limit = max(limit, 2 * size)
    if held:
        keys, sigs, sizes = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        equal = keys[order[1:]] == keys[order[:-1]]
        again = order[np.r_[False, equal] | np.r_[equal, False]]
        held = [(keys[again], sigs[again], sizes[again])]
        del keys, sigs, sizes, order
        keys, sigs, sizes, df = merged()
        more = df > 1
        yield from batch(keys[more], sigs[more], sizes[more], np.minimum(df[more], SATURATED))


def _prefixed(percent: int):
    """Sets whose shared keys reach the threshold, with these keys rare first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["sig"]):
            sig, n, key, df = (frame[c].to_numpy() for c in ("sig", "n", "key", "df"))
            cuts = np.r_[0, np.flatnonzero(sig[1:] != sig[:-1]) + 1, len(sig)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                keys, first = np.unique(key[a:b], return_index=True)  # a heavy key comes once for each batch
                if 100 * len(keys) >= percent * n[a]:
                    order = np.lexsort((keys, df[a:b][first]))
                    size = int(n[a])
                    prefix = size - -(-percent * size // 100) + 1
                    mine = max(0, prefix - (size - len(keys)))
                    out.append((int(sig[a]), size, mine, keys[order].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["sig", "n", "prefix", "keys"])

    return run


def linked_pairs(sig, n, prefix, lists, side, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs of one block (all sides 0) or across two (sides 0 and 1)."""
    m = len(sig)
    shared = np.array([len(x) for x in lists])
    alone = n - shared
    flat, owner = np.concatenate(lists), np.repeat(np.arange(m), shared)
    place = np.concatenate([np.arange(k) for k in shared]) if m else np.empty(0, int)
    rest = np.repeat(n - alone, shared) - place  # keys from here to the end of the set, this one included
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    alpha = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
    maybe = np.zeros((m, m), bool)
    at = np.flatnonzero((place < np.repeat(prefix, shared)) & (counts[column] > 1))
    at = at[np.argsort(column[at], kind="stable")]
    cuts = np.r_[0, np.flatnonzero(np.diff(column[at])) + 1, len(at)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            who, left = owner[at[a:b]], rest[at[a:b]]
            box = np.ix_(who, who)
            maybe[box] |= np.minimum.outer(left, left) >= alpha[box]  # positional filter
    maybe &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)  # length filter
    if side.any():
        maybe &= side[:, None] != side[None, :]
    if not maybe.any():
        return []
    # columns in one set only cannot add to an overlap; the others become bits
    kept = counts > 1
    number = np.cumsum(kept) - 1
    use = kept[column]
    cols, rows = number[column[use]], owner[use]
    width = int(kept.sum())
    bits = np.zeros((m, -(-width // 64)), U64)
    for lo in range(0, width, 8192):
        inside = (cols >= lo) & (cols < lo + 8192)
        wide = np.zeros((m, 8192), np.uint8)
        wide[rows[inside], cols[inside] - lo] = 1
        packed = np.packbits(wide, axis=1).view(U64)
        bits[:, lo // 64 : lo // 64 + 128] = packed[:, : bits.shape[1] - lo // 64]
    piece = np.zeros((m, PIVOTS), np.int64)
    np.add.at(piece, (rows, cols * PIVOTS // max(width, 1)), 1)
    own = n - piece.sum(1)
    label, edges = np.arange(m), []
    for a in range(m):
        other = np.flatnonzero(maybe[a, a + 1 :]) + a + 1
        other = other[label[other] != label[a]]
        if len(other) == 0:
            continue
        # suffix filter: sets cut at common pivots differ at least by the differences of their parts
        apart = own[a] + own[other] + np.abs(piece[other] - piece[a]).sum(1)
        other = other[(n[a] + n[other] - apart) >= 2 * alpha[a, other]]
        for lo in range(0, len(other), 512):
            some = other[lo : lo + 512]
            some = some[label[some] != label[a]]
            both = np.bitwise_count(bits[some] & bits[a]).sum(1, dtype=np.int64)
            good = some[100 * both >= percent * (n[a] + n[some] - both)]
            for b in good:
                if label[b] != label[a]:
                    edges.append((int(sig[a]), int(sig[b])))
                    label[label == label[b]] = label[a]
    return edges


def _verified(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["cluster", "i", "j"]
        for frame in whole_groups(frames, keys):
            out = []
            for _, g in frame.groupby(keys, sort=False):
                lists = [np.frombuffer(x, np.int64) for x in g["keys"]]
                side = (g["block"] != g["i"]).to_numpy()
                out += linked_pairs(g["sig"].to_numpy(), g["n"].to_numpy(), g["prefix"].to_numpy(), lists, side, percent)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (id, n_shingles, component_id).

    Documents link when 100 * |A & B| >= percent * |A | B|; component_id is the smallest id
    reachable by links, itself included. Null and blank texts have no shingles and link with
    nothing; texts shorter than n words are one shingle. Repeated ids are returned as often as
    they come; a null id keeps its row and names no component. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    sets = stored(base.mapInArrow(_sets(n), "id long, n long, sig long"), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, spark.sparkContext.defaultParallelism, -(-total // PER_RANGE))
    packed = base.select("text").mapInArrow(_ranges(n, ranges), "range int, sigs binary, sizes binary, counts binary, keys binary")
    shared = packed.repartitionById(ranges, F.col("range")).mapInArrow(_shared, "sig long, n int, key long, df int")
    likely = stored(
        shared.repartition(parts(spark), "sig").sortWithinPartitions("sig").mapInPandas(_prefixed(percent), "sig long, n long, prefix long, keys binary"),
        "likely",
    )
    prefixes = stored(likely.where("prefix > 0").mapInPandas(_prefix_rows, "sig long, key long"), "prefixes")
    heads = prefixes.groupBy("key").agg(F.min("sig").alias("head")).join(prefixes, "key")
    cluster = stored(components(heads.select(F.col("sig").alias("a"), F.col("head").alias("b"))).withColumnRenamed("component_id", "cluster"), "clusters")
    blocks = cluster.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = cluster.join(blocks, "cluster").join(likely.withColumnRenamed("sig", "id"), "id")
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    groups = members.select("cluster", F.col("id").alias("sig"), "n", "prefix", "keys", "block", other)
    groups = groups.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    edges = (
        groups.repartition(parts(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        .mapInPandas(_verified(percent), "a long, b long")
    )
    same = components(edges).select(F.col("id").alias("sig"), F.col("component_id").alias("set_component"))
    named = sets.join(same, "sig", "left").select("id", "n", F.coalesce("set_component", "sig").alias("g"))
    least = named.where("g is not null").groupBy("g").agg(F.min("id").alias("component_id"))
    return named.join(least, "g", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
    )


def _prefix_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keys = [np.frombuffer(k, np.int64)[:p] for k, p in zip(frame["keys"], frame["prefix"])]
        yield pd.DataFrame({"sig": np.repeat(frame["sig"].to_numpy(), [len(k) for k in keys]), "key": np.concatenate(keys) if keys else []})


ship_by_value(__name__)
