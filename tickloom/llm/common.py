"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_dir, ship_by_value

U64 = np.uint64
MIX = U64(0x9E3779B97F4A7C15)  # fixed value: the odd multiplier 2^64 / golden ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_cache(name: str, make):
    """One object per Python worker process, kept over its tasks. What the task before did not ask for is cleared.

    Workers go from stage to stage, so without that each would hold the memories of all of them; likewise what Arrow keeps of freed buffers.
    """
    home = sys.modules.setdefault("_tickloom_process_cache", types.ModuleType("_tickloom_process_cache"))
    task = TaskContext.get()
    now = task.taskAttemptId() if task else None
    if "kept" not in home.__dict__:
        home.kept, home.used, home.task = {}, set(), now
    if home.task != now:
        for other in home.kept.keys() - home.used:
            home.kept[other].clear()
        pa.default_memory_pool().release_unused()
        home.used, home.task = set(), now
    home.used.add(name)
    if name not in home.kept:
        home.kept[name] = make()
    return home.kept[name]


class WordKeys(dict):
    """Word (bytes) -> 64-bit key; 2^-64 is the chance that two words share one. Emptied when it grows large."""

    LIMIT, LONG = 100_000, 64

    def __missing__(self, word: bytes) -> int:
        key = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.LONG:
            self[word] = key
        return key

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def word_keys() -> WordKeys:
    return process_cache("word_keys", WordKeys)


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased."""
    return text.lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit keys."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)  # fixed values of a public finaliser
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def shingle_keys(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of the n-word shingles, sorted; fewer words are one shingle, none give none."""
    if len(words) == 0:
        return np.empty(0, U64)
    k = min(n, len(words))
    size = len(words) - k + 1
    h = np.full(size, U64(k))
    for i in range(k):
        h = (h ^ (h >> U64(29))) * MIX + words[i : i + size]
    return np.unique(mixed(h))


def slices(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[list[list]]:
    """Columns of short runs of rows as Python lists, so that no task holds a whole batch as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [column.to_pylist() for column in part.columns]


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """From frames sorted by keys, frames that hold groups whole. Only one group is carried over."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        ends = frame[keys].iloc[[0, -1]]
        if rest and ends.iloc[0].tolist() == ends.iloc[1].tolist() == rest[-1][keys].iloc[-1].tolist():
            rest.append(frame)
            continue
        frame = pd.concat([*rest, frame], ignore_index=True)
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = int(last.argmax())
        if cut:
            yield frame.iloc[:cut]
        rest = [frame.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component_id), the smallest id reachable.

    Alternating large-star and small-star rounds as joins: each round is a minimum per node
    (combined before the shuffle) joined back to the edges, so no node's neighbours meet in a
    task. Rounds grow with the logarithm of the longest chain. The driver sees two numbers.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges = edges.where("a <> b and a is not null and b is not null")
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(v, u))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(both.join(low, "u").where(v > u).select(v.alias("u"), m.alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != m).select(v.alias("u"), m.alias("v"))
        edges = stored(small.union(low.select("u", m.alias("v"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(u.alias("id"), v.alias("component_id")).union(edges.select(v, v).distinct())


def hashed_sample(rows: DataFrame, name: str, n: int) -> list:
    """The n distinct values of a column with the smallest hashes; the driver gets hashes, then only these values."""
    hashed = rows.where(F.col(name).isNotNull()).select(F.xxhash64(name).alias("h"), F.col(name).alias("value"))
    mark = hashed.groupBy("h").agg(F.lit(1)).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if mark is None:
        return []
    found = hashed.where(F.col("h") <= mark).groupBy("h").agg(F.min("value").alias("value"))
    return [r["value"] for r in sorted(found.collect(), key=lambda r: r["h"])]


FUNCTIONS = 3
LARGEST = 1 << 27


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over the one long column of `keys`, as 64-bit words.

    32 bits a key, but never more than 16 MB: beyond that it lets more keys through, so it may
    only come before an exact join. Spark ors the words; the driver gets at most that size.
    """
    (name,) = keys.columns
    bits = 1 << 16
    while bits < min(32 * keys.count(), LARGEST):
        bits *= 2

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.concatenate([spread(frame[name].to_numpy().view(U64), i, bits) for i in range(FUNCTIONS)])
            yield pd.DataFrame({"word": (at >> U64(6)).astype(np.int64), "bit": (U64(1) << (at & U64(63))).view(np.int64)})

    rows = keys.mapInPandas(words, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bit")).toPandas()
    filled = np.zeros(bits // 64, U64)
    filled[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64).view(U64)
    return filled


def spread(keys: np.ndarray, i: int, size: int) -> np.ndarray:
    """The i-th hash function: keys to 0 .. size - 1, size a power of two."""
    return mixed(keys + U64((i + 1) * int(MIX) & (1 << 64) - 1)) & U64(size - 1)


def in_bloom(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the keys that may be in the filter."""
    at = np.arange(len(keys))
    for i in range(FUNCTIONS):
        h = spread(keys[at], i, len(filled) * 64)
        at = at[(filled[h >> U64(6)] >> (h & U64(63))) & U64(1) == 1]
    return at


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ship_by_value(__name__)
