"""Shards by a hierarchical weighted hash tree.

A topology has regions, racks in them and shards in these. A row descends from the root: at each level every child draws
-ln(u) / weight, u being a hash of the row's key and of the child, and the smallest draw wins, so children get rows in
proportion to their weights. A draw depends on nothing but key, child and weight. So when a weight grows, rows
move only into that child; movement is confined to the subtrees whose weights changed, and inside the others every
draw is as before. A new shard that is a region of its own changes no other weight at all: rows move into it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.ranks import ranked

HEADER = 16
RACK, REGION = 5, 20


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(count: int, added: int = 0) -> list[Shard]:
    """`count` shards of equal weight, 5 to a rack and 4 racks to a region, and `added` later ones, each a region of its own.

    So every shard added takes rows only into itself.
    """
    inside = [Shard(f"region{i // REGION}", f"rack{i // RACK}", i) for i in range(count)]
    return inside + [Shard(f"single{i}", f"rack{i}", i) for i in range(count, count + added)]


def draw(key: Column, node: str, weight: float) -> Column:
    """Exponential with rate `weight`, from the first 52 bits of the MD5 of key and node, which any engine can recompute."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key, F.lit("-")), F.lit(f"|{node}"))), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(2**52))) / F.lit(weight)


def winner(key: Column, path: str, children: dict[str, float]) -> Column:
    """The index of the child with the smallest draw."""
    names = list(children)
    if len(names) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(draw(key, f"{path}/{n}", children[n]).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(names)]))["i"]


def switch(index: Column, results: list[Column]) -> Column:
    out = F.when(index == 0, results[0])
    for i, result in enumerate(results[1:], 1):
        out = out.when(index == i, result)
    return out


def placed(rows: DataFrame, key: Column, shards: list[Shard], name: str) -> DataFrame:
    """Add the shard of each row. Shards without weight get no rows."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in shards:
        if s.weight > 0:
            tree.setdefault(s.region, {}).setdefault(s.rack, {})[s.shard] = s.weight
    if not tree:
        raise ValueError("no shard has a weight")
    region, rack, leaf = f"{name}_region", f"{name}_rack", f"{name}_leaf"
    weights = {r: {k: sum(v.values()) for k, v in racks.items()} for r, racks in tree.items()}
    out = rows.withColumn(region, winner(key, "", {r: sum(w.values()) for r, w in weights.items()}))
    out = out.withColumn(rack, switch(F.col(region), [winner(key, f"/{r}", weights[r]) for r in tree]))
    inner, labels = [], []
    for r, racks in tree.items():
        inner.append(switch(F.col(rack), [winner(key, f"/{r}/{k}", {str(n): w for n, w in v.items()}) for k, v in racks.items()]))
        labels.append(F.array(*[F.array(*[F.lit(n) for n in v]) for v in racks.values()]))
    out = out.withColumn(leaf, switch(F.col(region), inner))
    label = switch(F.col(region), [F.get(F.get(ls, F.col(rack)), F.col(leaf)) for ls in labels])
    return out.withColumn(name, label).drop(region, rack, leaf)


def sharded(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, size, text_crc32, law, shard, slot, grown_shard).

    Law `key`: id and topology decide. size is the UTF-8 bytes of the text and a header of 16; a null text has no bytes, and the CRC of
    none. Rows with one id, repeated or null, share a shard. Slots number the rows of a shard from 0 by id, nulls first; rows that repeat an id
    follow in any order. A shard may hold any share of the rows: its slots are numbered in runs (`ranked`).
    """
    key = F.col("id").cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = placed(rows, key, shards, "shard")
    rows = placed(rows, key, grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    out = ranked(rows, ["shard"], ["id", "row"])
    return out.select("id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("position").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: list[Shard], path: str, id_col: str = "doc_id", folder: str = "_shard") -> None:
    """The rows of docs as Parquet, one folder a shard; a shard is written by as many tasks as its rows need."""
    rows = placed(docs, F.col(id_col).cast("string"), shards, folder)
    rows.repartitionByRange(folder, F.col(id_col)).write.partitionBy(folder).parquet(path)
