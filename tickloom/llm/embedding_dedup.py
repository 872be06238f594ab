"""Near-duplicate vectors by cosine, with randomised-rotation binary codes.

A unit vector is rotated at random and only the signs are kept. With the stored factor <signs, vector>
the product of another vector with the signs gives an unbiased estimate of the cosine, and a
confidence bound that shrinks with the root of the dimensions. Only pairs whose upper bound reaches the
threshold are computed again exactly.

Candidates meet in buckets: bands of the same sign bits. The number of bits grows with the
logarithm of the vectors, so buckets stay small; the number of bands follows from the wanted
chance to find a pair at the threshold (pairs above it have more). Equal vectors are one from the
start. Large buckets are cut into blocks, and each pair of blocks is a task's group. A
group returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import components, parts, stored, whole_groups
from tickloom.session import ship_by_value

BUCKET = 64
BLOCK = 1_024
FOUND = 0.99
CONFIDENCE = 4.0


def rotations(dim: int, bits: int) -> np.ndarray:
    """Independent random rotations side by side (dim x a multiple of dim columns), the same on every worker."""
    rng = np.random.default_rng(dim)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(turns, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bands_of(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The key of each vector in each band."""
    return signs[:, : bits * bands].reshape(len(signs), bands, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def links_in_block(no, copies, x, signs, factors, side, band: int, bits: int, bands: int, threshold: float):
    """Link counts (by copies) and a spanning forest of the pairs that share this band first."""
    m, dim = x.shape
    turns = signs.shape[1] // dim
    rotated = (x @ rotations(dim, signs.shape[1])).astype(np.float32)
    estimate, width = np.zeros((m, m), np.float32), np.zeros(m, np.float32)
    for r in range(turns):
        cut = slice(r * dim, (r + 1) * dim)
        code = (2 * signs[:, cut].astype(np.float32) - 1) / np.float32(math.sqrt(dim))
        estimate += (rotated[:, cut] @ code.T) / factors[None, :, r] / turns
        width += (1 - factors[:, r] ** 2).clip(0) / factors[:, r] ** 2 / turns**2 / max(dim - 1, 1)
    bound = CONFIDENCE * np.sqrt(width)
    # either side can be the coded one: both bounds have to let the pair pass
    maybe = (estimate + bound[None, :] >= threshold) & (estimate.T + bound[:, None] >= threshold)
    maybe = np.triu(maybe, 1)
    if side.any():
        maybe &= side[:, None] != side[None, :]
    links, label, edges = np.zeros(m, np.int64), np.arange(m), []
    keys = bands_of(signs, bits, bands)
    a, b = np.nonzero(maybe)
    for lo in range(0, len(a), 65_536):
        i, j = a[lo : lo + 65_536], b[lo : lo + 65_536]
        first = (keys[i] == keys[j]).argmax(1) == band
        i, j = i[first], j[first]
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[exact], j[exact]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while len(i):  # one edge for each two parts that are still apart
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if len(i):
                edges.append((int(no[i[0]]), int(no[j[0]])))
                label[label == label[j[0]]] = label[i[0]]
    return links, edges


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    Vectors of one length link at a cosine of `threshold` or more in double precision. Null, empty and zero vectors
    and those with null or non-finite components link with nothing. Repeated ids and null ids keep their
    rows; every other row with the same vector counts as a link. kept marks the smallest id of a component.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0)
    distinct = base.where(good).groupBy("x").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    distinct = stored(distinct.withColumn("no", F.monotonically_increasing_id()), "vectors")
    n = distinct.count()
    angle = 1 - math.acos(threshold) / math.pi
    bits = max(1, math.ceil(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 1
    bands = max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - angle**bits)))

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, g in frame.groupby(frame["x"].map(len)):
                x = unit(np.stack(g["x"].to_list()).astype(np.float64))
                rotated = x @ rotations(dim, bits * bands)
                signs = rotated > 0
                factors = (np.abs(rotated).reshape(len(x), -1, dim).sum(2) / math.sqrt(dim)).astype(np.float32)
                keys = bands_of(signs, bits, bands)
                for at in range(0, len(g), 1000):
                    some = slice(at, at + 1000)
                    yield pd.DataFrame({
                        "no": g["no"].to_numpy()[some], "copies": g["copies"].to_numpy()[some], "dim": dim, "keys": list(keys[some]),
                        "signs": [s.tobytes() for s in np.packbits(signs[some], axis=1)], "factors": [f.tobytes() for f in factors[some]],
                        "v": [v.tobytes() for v in x[some]],
                    })

    schema = "no long, copies long, dim int, keys array<long>, signs binary, factors binary, v binary"
    codes = stored(distinct.select("no", "copies", "x").mapInPandas(coded, schema), "codes")
    placed = codes.select("*", F.posexplode("keys").alias("band", "bucket")).drop("keys")
    sizes = codes.select("dim", F.posexplode("keys").alias("band", "bucket")).groupBy("dim", "band", "bucket").agg(F.count("*").alias("size"))
    placed = placed.join(sizes.where("size > 1"), ["dim", "band", "bucket"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("no"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["dim", "band", "bucket", "i", "j"]
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "size")

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            out = []
            for (dim, band, _, i, _), g in frame.groupby(keys, sort=False):
                width = -(-bits * bands // dim) * dim
                x = np.frombuffer(b"".join(g["v"]), np.float64).reshape(-1, dim)
                signs = np.unpackbits(np.frombuffer(b"".join(g["signs"]), np.uint8).reshape(len(g), -1), axis=1, count=width).astype(bool)
                factors = np.frombuffer(b"".join(g["factors"]), np.float32).reshape(len(g), -1)
                no, copies = g["no"].to_numpy(), g["copies"].to_numpy()
                links, edges = links_in_block(no, copies, x, signs, factors, (g["block"] != i).to_numpy(), int(band), bits, bands, threshold)
                at = np.flatnonzero(links)
                out += [(int(no[k]), None, int(links[k])) for k in at] + [(a, b, 0) for a, b in edges]
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "links"]).astype({"b": "Int64"})

    found = placed.repartition(parts(spark), *keys).sortWithinPartitions(*keys).mapInPandas(linked, "a long, b long, links long")
    found = stored(found, "links")
    linked_to = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "no")
    same = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "no").withColumnRenamed("component_id", "g")
    named = distinct.select("x", "no", "least", "copies").join(linked_to, "no", "left").join(same, "no", "left").withColumn("g", F.coalesce("g", "no"))
    root = named.groupBy("g").agg(F.min("least").alias("root"))
    named = named.join(root, "g").select("x", "root", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = base.join(named, "x", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


ship_by_value(__name__)
