"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing: pieces are spread evenly, each partition packs its own by best
fit, longest first. Bins that are nearly full are done. The others go up a tree as items: each
node packs the bins of its children by best fit again, until one node is left. A node hands on
at most `HANDED` bins, those with most room; the rest of its bins are done as they are, so no
task grows with the input and no piece is ever dropped.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import process_cache, slices, stored, whole_groups
from tickloom.session import ship_by_value

LENGTH = 2048
FULL = 0.98
PER_NODE = 20_000
FAN_IN = 8
HANDED = 20_000


class Generations(dict):
    """A bounded memory for `make`: what was asked for lately, and what was before that, so what is common stays."""

    LIMIT, LONG = 160_000, 64

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) > self.LIMIT:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.LONG:
            self[key] = found
        return found


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of whole texts, word by word: a word's ids do not depend on its neighbours.

    The tokenizer drops white space, splits the rest into runs of letters, single digits and runs of
    other characters, and encodes each alone. Words of Latin letters and ASCII are split here and only
    their runs go to the tokenizer's model; any other word goes through the whole tokenizer.
    """

    # Latin-1 letters have fixed lower-case forms and are already composed
    EASY = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.runs = Generations(self.word), Generations(self.run)
        # byte-level models name bytes by printable characters: those that are printable name themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def clear(self) -> None:
        for memory in (self.words, self.runs):
            memory.clear()
            memory.old = {}

    def run(self, run: str) -> bytes:
        named = run if run.isascii() else "".join(map(self.names.__getitem__, run.encode()))
        return packed([t.id for t in self.model.tokenize(named)])

    def word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters are one run
            return self.run(word.lower().decode())
        text = word.decode("utf-8", "replace")
        if self.EASY.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.runs.__getitem__, self.RUNS.findall(text.lower())))
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: bytes | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, (text or b"").split())), "<u4")


def encoder(path: str) -> Encoder:
    return process_cache(f"encoder:{path}", lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32), the ids being the text's and then end_id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for names, texts in slices(batches):
            out = []
            for name, text in zip(names, texts):
                ids = np.append(encode.ids(text), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    out.append((name, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.int64()] * 3))], names=["id", "piece", "start", "length", "ids_crc32"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return base.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first, each into the fullest bin with room: bin and offset of each, and the fill of each bin."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: a bin with room r is there
    fill: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), length
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


def _node(length: int, last: bool):
    """Pack the items of each node of this level; members of an item keep their order inside it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["node"]):
            for node, g in frame.groupby("node", sort=False):
                sizes = g["size"].to_numpy()
                bins, offsets, fill = best_fit(sizes, length)
                order = np.argsort(bins, kind="stable")
                order = order[np.lexsort((offsets[order], bins[order]))]
                cuts = np.searchsorted(bins[order], np.arange(len(fill) + 1))
                open_ = np.flatnonzero(fill < FULL * length)
                open_ = open_[np.argsort(fill[open_], kind="stable")][:HANDED]
                up = np.zeros(len(fill), bool)
                up[open_] = not last
                members = g["members"].to_list()
                yield pd.DataFrame({
                    "node": node, "bin": np.arange(len(fill)), "size": fill, "up": up,
                    "members": [b"".join(members[i] for i in order[cuts[b] : cuts[b + 1]]) for b in range(len(fill))],
                })

    return run


ROW = np.dtype([("row", "<i8"), ("length", "<i4")])


def pack(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows with a column `length` (1 to `length`) get sequence_id and offset; each sequence is gapless from 0.

    Rows without length, or none at all, give an empty result; equal rows are packed each.
    """
    spark = rows.sparkSession
    rows = stored(rows.where(F.col("length").between(1, length)).withColumn("row", F.monotonically_increasing_id()), "pieces")
    nodes = max(1, -(-rows.count() // PER_NODE))
    # an even mixture in each node, so that the bins left open differ little from node to node
    level = rows.select(F.pmod(F.xxhash64("row"), F.lit(nodes)).alias("node"), F.col("length").alias("size"), "row").mapInPandas(_single, "node long, size long, members binary")
    done, depth = [], 0
    while True:
        out = level.repartition(min(nodes, 4096), "node").sortWithinPartitions("node").mapInPandas(_node(length, nodes == 1), "node long, bin long, size long, up boolean, members binary")
        out = stored(out, "bins")
        done.append(out.where("not up").select((F.lit(depth << 56) + F.shiftleft(F.col("node"), 28) + F.col("bin")).alias("sequence_id"), "members"))
        if nodes == 1:
            break
        level = out.where("up").select((F.col("node") / FAN_IN).cast("long").alias("node"), "size", "members")
        nodes, depth = -(-nodes // FAN_IN), depth + 1
    bins = done[0]
    for more in done[1:]:
        bins = bins.union(more)
    placed = bins.mapInPandas(_placed, "row long, sequence_id long, offset long")
    return rows.join(placed, "row").drop("row")


def _single(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        one = np.empty(len(f), ROW)
        one["row"], one["length"] = f["row"], f["size"]
        yield pd.DataFrame({"node": f["node"], "size": f["size"], "members": [x.tobytes() for x in one]})


def _placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        counts = [len(m) // ROW.itemsize for m in f["members"]]
        m = np.frombuffer(b"".join(f["members"]), ROW)
        before = np.cumsum(m["length"], dtype=np.int64) - m["length"]
        first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
        yield pd.DataFrame({"row": m["row"], "sequence_id": np.repeat(f["sequence_id"].to_numpy(), counts), "offset": before - np.repeat(before[first], counts)})


def best_fit_packing(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: its piece is the end id alone. Repeated documents are packed
    each; a null id stays null. An empty table packs into nothing. Other columns are ignored.
    """
    return pack(pieces(docs, tokenizer_path, id_col, text_col, length), length).withColumnRenamed("id", id_col)


ship_by_value(__name__)
