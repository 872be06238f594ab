"""A Merkle manifest of a dataset: one tree of arity 16 for each source, and one tree over their roots.

Nodes are kept in van Emde Boas order. A tree is cut at half its height into a top and aligned bottom
subtrees, and these again, until a subtree is at most BLOCK levels high; such a block is one row of the
manifest, with its nodes in one binary. Inside a block the same halving goes on down to single nodes: `address`
gives the place of a node, at any depth, by arithmetic alone. Blocks are built bottom-up: the roots of the
blocks of one tier are the leaves of the next. Proofs come top-down: the siblings above a block are
found once, in the blocks above it, and handed to all its leaves. Thus a hot source is as many independent
blocks as it has leaves, and no task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import parts, slices, stored
from tickloom.llm.ranks import ranked
from tickloom.session import ship_by_value

ARITY = 16
BLOCK = 3
DIGEST = 32


def subtree_size(height: int) -> int:
    """Nodes of a full subtree."""
    return (ARITY ** (height + 1) - 1) // (ARITY - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes `index` at `depth` in the van Emde Boas order of a full tree.

    The top half comes first, then the bottom subtrees one after another, each laid out likewise.
    """
    if height == 0:
        return np.zeros_like(index)
    top = (height - 1) // 2
    if depth <= top:
        return address(top, depth, index)
    low, below = height - top - 1, depth - top - 1
    subtree, inner = np.divmod(index, ARITY**below)
    return subtree_size(top) + subtree * subtree_size(low) + address(low, below, inner)


def height_of(leaves: int) -> int:
    height = 0
    while ARITY**height < leaves:
        height += 1
    return height


def tiers(height: int) -> list[int]:
    """Heights of the blocks from the leaves up: halves of halves, until each fits a block."""
    return [height] if height <= BLOCK else tiers(height - height // 2) + tiers(height // 2)


def digest_of(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def field(name: str, column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def laid_out(leaves: list[bytes], height: int) -> bytes:
    """The nodes of a subtree over these leaves in van Emde Boas order; places of missing nodes are zero."""
    places = np.zeros((subtree_size(height), DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        places[address(height, depth, np.arange(len(level)))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, DIGEST)
        if depth:
            hexed = b"".join(level).hex().encode()
            step = ARITY * DIGEST * 2
            level = [sha256(hexed[at : at + step]).digest() for at in range(0, len(hexed), step)]
    return places.tobytes().rstrip(b"\0")


def levels_of(nodes: bytes, height: int, leaves: int) -> list[str]:
    """For each level of a block, leaves first, the digests of its nodes as one hex text."""
    places = np.zeros((subtree_size(height), DIGEST), np.uint8)
    places.reshape(-1)[: len(nodes)] = np.frombuffer(nodes, np.uint8)
    out = []
    for depth in range(height, -1, -1):
        out.append(places[address(height, depth, np.arange(leaves))].tobytes().hex())
        leaves = -(-leaves // ARITY)
    return out


BLOCKS = "tree long, block long, leaves int, height int, size long, top binary, nodes binary, ids array<long>, altered array<binary>"
ARROW = {"tree": pa.int64(), "block": pa.int64(), "leaves": pa.int32(), "height": pa.int32(), "size": pa.int64(), "top": pa.binary(), "nodes": pa.binary(), "ids": pa.list_(pa.int64()), "altered": pa.list_(pa.binary())}


def block_builder(full: int):
    """Blocks from nodes sorted by (tree, position); only the rows of one block are held."""

    def rows(batches):
        for columns in slices(batches):
            yield from zip(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for (tree, block), group in groupby(rows(batches), key=lambda r: (r[0], r[1])):
            _, _, sizes, digests, ids, altered = zip(*group)
            height = full if sizes[0] > ARITY**full else height_of(sizes[0])
            nodes = laid_out(list(digests), height)
            out.append((tree, block, len(digests), height, sizes[0], nodes[:DIGEST].ljust(DIGEST, b"\0"), nodes, list(ids), list(altered)))
            held += len(digests)
            if held >= ARITY**BLOCK:
                yield batch(out, ARROW)
                out, held = [], 0
        if out:
            yield batch(out, ARROW)

    return run


def batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def build(nodes: DataFrame, heights: list[int]) -> list[DataFrame]:
    """The stored blocks of all trees, one table a tier, leaves first; nodes: tree, position, size, digest, id, altered."""
    out = []
    for height in heights:
        placed = nodes.select("tree", F.floor(F.col("position") / ARITY**height).alias("block"), "position", "size", "digest", "id", "altered")
        placed = placed.repartition(parts(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "position").drop("position")
        blocks = stored(placed.mapInArrow(block_builder(height), BLOCKS), "blocks")
        out.append(blocks)
        none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("altered")]
        nodes = blocks.select("tree", F.col("block").alias("position"), F.ceil(F.col("size") / ARITY**height).alias("size"), F.col("top").alias("digest"), *none)
    return out


@dataclass(frozen=True)
class Manifest:
    """`sources`: blocks of the trees of the sources by tier; `top`: those of the tree over them, in which leaf i is tree i."""

    sources: list[DataFrame]
    heights: list[int]
    top: list[DataFrame]
    top_heights: list[int]
    root: str

    def root_path(self) -> DataFrame:
        """The path of the root block: nothing is above it."""
        return self.top[0].sparkSession.createDataFrame([(0, 0, self.root, b"", "")], PATHS)


def leaves_of(docs: DataFrame, id_col="doc_id", source_col="source", lang_col="lang", chars_col="n_chars", text_col="text") -> DataFrame:
    """(source, id, leaf, altered): digests of each row, `altered` after lower-casing A-Z where the row is one to tamper with."""
    def leaf(text: Column) -> Column:
        return digest_of(F.concat(*[field(c, F.col(c)) for c in (id_col, source_col, lang_col, chars_col)], field(text_col, text)))

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col(id_col).cast("string")) % 5 == 0
    return docs.select(
        F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), leaf(F.col(text_col)).alias("leaf"),
        F.when(tampered, leaf(F.translate(F.col(text_col), upper, upper.lower()))).alias("altered"), F.monotonically_increasing_id().alias("row"),
    )


def manifest(docs: DataFrame, **columns: str) -> Manifest | None:
    """The trees of a dataset; None where it is empty."""
    leaves = stored(leaves_of(docs, **columns), "leaves")
    placed = stored(ranked(leaves, ["source"], ["id", "leaf", "row"]), "placed-leaves")
    count = placed.agg(F.max("group_size").alias("largest"), (F.max("group_no") + 1).alias("trees")).first()
    if count["largest"] is None:
        return None
    nodes = placed.select(F.col("group_no").alias("tree"), "position", F.col("group_size").alias("size"), F.col("leaf").alias("digest"), "id", "altered")
    heights, top_heights = tiers(height_of(count["largest"])), tiers(height_of(count["trees"]))
    sources = build(nodes, heights)
    none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("altered")]
    subroots = sources[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.lit(count["trees"]).cast("long").alias("size"), F.col("top").alias("digest"), *none)
    top = build(subroots, top_heights)
    return Manifest(sources, heights, top, top_heights, bytes(top[-1].select("top").first()[0]).hex())


#: Paths: the digest of a node and, from its level up, turns (its place in the run and the number of others, a byte each) and the others.
PATHS = "tree long, position long, digest string, turns binary, others string"
PATH_ARROW = {"tree": pa.int64(), "position": pa.int64(), "digest": pa.string(), "turns": pa.binary(), "others": pa.string()}
PROOFS = "id long, leaf string, subroot string, proof_sha256 string, folded_root string"
PROOF_ARROW = {"id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string()}


def siblings(levels: list[str], index: int) -> tuple[bytes, str]:
    """Turns (place in the run, number of others; a byte each) and the digests of the others of each level."""
    turns, others, wide = bytearray(), [], DIGEST * 2
    for level in levels[:-1]:
        own, at = index % ARITY, index // ARITY * ARITY * wide
        run = level[at : at + ARITY * wide]
        turns += bytes((own, len(run) // wide - 1))
        others.append(run[: own * wide] + run[(own + 1) * wide :])
        index //= ARITY
    return bytes(turns), "".join(others)


def folded(digest: str, turns: bytes, others: str) -> str:
    """The root that follows from a digest and its siblings."""
    at, wide = 0, DIGEST * 2
    for own, count in zip(turns[::2], turns[1::2]):
        left, end = at + own * wide, at + count * wide
        digest = sha256((others[at:left] + digest + others[left:end]).encode()).hexdigest()
        at = end
    return digest


def paths_below(full: int):
    """The path of each leaf of a block: its siblings inside, then what lies above the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 1):
            for tree, block, leaves, height, nodes, turns, others in zip(*rows):
                levels, out = levels_of(nodes, height, leaves), []
                for i in range(leaves):
                    near, beside = siblings(levels, i)
                    out.append((tree, block * ARITY**full + i, levels[0][i * 64 : i * 64 + 64], near + turns, beside + others))
                yield batch(out, PATH_ARROW)

    return run


def proofs_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof and folded root of each row of a block of the lowest tier."""
    for rows in slices(batches, 4):
        out = []
        for subroot, leaves, height, nodes, ids, altered, turns, others in zip(*rows):
            levels = levels_of(nodes, height, leaves)
            for i, (number, other) in enumerate(zip(ids, altered)):
                leaf = levels[0][i * 64 : i * 64 + 64]
                near, beside = siblings(levels, i)
                proof = beside + others
                seen = leaf if other is None else other.hex()
                out.append((number, leaf, subroot, sha256(proof.encode()).hexdigest(), folded(seen, near + turns, proof)))
        yield batch(out, PROOF_ARROW)


def joined(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path above them; one row of each side for a key."""
    paths = paths.select(F.col("tree").alias("of"), F.col("position").alias("at"), "turns", "others")
    return blocks.join(paths, (F.col("tree") == F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")


def descend(tables: list[DataFrame], heights: list[int], paths: DataFrame) -> DataFrame:
    """From the paths of the roots of these trees to those of the leaves of the given tiers."""
    for blocks, full in reversed(list(zip(tables, heights))):
        into = joined(blocks, paths).select("tree", "block", "leaves", "height", "nodes", "turns", "others")
        paths = into.mapInArrow(paths_below(full), PATHS)
    return paths


def proofs(m: Manifest) -> DataFrame:
    """(id, leaf, subroot, proof_sha256, folded_root) of every row of the dataset."""
    begin = m.root_path()
    roots = descend(m.top, m.top_heights, begin)
    roots = stored(roots.select(F.col("position").alias("tree"), F.lit(0).cast("long").alias("position"), "digest", "turns", "others"), "root-paths")
    paths = descend(m.sources[1:], m.heights[1:], roots)
    named = roots.select(F.col("tree").alias("named"), F.col("digest").alias("subroot"))
    lowest = joined(m.sources[0], paths)
    lowest = lowest.join(named, F.col("tree") == F.col("named"))
    return lowest.select("subroot", "leaves", "height", "nodes", "ids", "altered", "turns", "others").mapInArrow(proofs_below, PROOFS)


def dataset_manifest(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per row of docs: (id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Null fields are spelled `-`, so a null source is a source of its own and comes first. Rows of one source are
    ordered by id, nulls first, and then by leaf digest: rows that repeat an id keep their rows, and equal rows are
    alike in any order. A null id is never tampered with. Texts count whole. An empty table gives no rows; a
    single row is leaf, subroot and root at once, and its proof is the digest of nothing.
    """
    m = manifest(docs, **columns)
    if m is None:
        return docs.sparkSession.createDataFrame([], f"{PROOFS}, root string, verified boolean")
    return proofs(m).withColumns({"root": F.lit(m.root), "verified": F.col("folded_root") == F.lit(m.root)})


ship_by_value(__name__)
