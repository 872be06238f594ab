"""Benchmark decontamination by spaced seeds.

A mask picks some positions of a window of words; the picked words are hashed. Windows that
differ only at ignored positions share the hash, so a passage with substituted words still hits.
The hashes of all benchmark windows are joined with those of the training windows, and around
each hit the words of both sides are compared on its diagonal.

Training windows are first looked up in a Bloom filter of the benchmark hashes (of a fixed
largest size), so almost only true hits are shuffled; the join that follows is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import MIX, U64, bloom, in_bloom, mixed, slices, stored, word_keys, words_of
from tickloom.session import ship_by_value

MASKS = ("111010011", "1101000111", "110010101011", "10110001101")  # fixed values: six words each are compared
SPAN = max(map(len, MASKS))
MIN_WORDS = 13
MIN_SHARE = 0.75
MISMATCH = 2.0


def seeds(words: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each window under each mask, and of whole windows of the short lengths."""
    hashes, starts = [], []
    picked = [(i, [k for k, c in enumerate(mask) if c == "1"], len(mask)) for i, mask in enumerate(MASKS)]
    picked += [(len(MASKS) + size, list(range(size)), size) for size in short]
    for name, at, span in picked:
        size = len(words) - span + 1
        if size > 0:
            h = np.full(size, U64(name + 1))
            for k in at:
                h = (h ^ (h >> U64(29))) * MIX + words[k : k + size]
            hashes.append(mixed(h))
            starts.append(np.arange(size, dtype=np.int32))
    if not hashes:
        return np.empty(0, U64), np.empty(0, np.int32)
    return np.concatenate(hashes), np.concatenate(starts)


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """On a diagonal (place in doc less place in item) the run with the best score: start in doc, end, matches."""
    lo, hi = max(0, diagonal), min(len(doc), len(item) + diagonal)
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    run = np.r_[0.0, np.cumsum(np.where(same, 1.0, -MISMATCH))]
    low = np.minimum.accumulate(run)
    end = int((run - low).argmax())
    start = int(np.flatnonzero(run[: end + 1] == low[end])[-1])
    return lo + start, lo + end, int(same[start:end].sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """Rows (id, item, start_word, end_word, n_words, n_match): the best overlap of each document and item.

    An overlap counts if it matches at least 13 words, or three quarters of a shorter item, and
    more than two thirds of its words. Items shorter than the longest mask have to occur whole.
    Null and blank texts overlap with nothing. Equal items are found each; documents that repeat
    an id are looked at each, their best overlap is returned. Null ids are kept as ids.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = word_keys()
        for ids, texts in slices(batches):
            words = [keys.of(words_of(t)) for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int32()), pa.array([w.tobytes() for w in words], pa.binary())], names=["item", "size", "words"])

    items = stored(items.mapInArrow(keyed, "item long, size int, words binary").where("size > 0"), "items")
    texts = stored(items.groupBy("words", "size").agg(F.min("item").alias("one")).withColumn("text_no", F.monotonically_increasing_id()), "item-texts")
    short = sorted(r["size"] for r in texts.where(F.col("size") < SPAN).select("size").distinct().collect())

    def item_seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for no, size, words in zip(frame["text_no"], frame["size"], frame["words"]):
                h, at = seeds(np.frombuffer(words, U64), [s for s in short if s == size])
                yield pd.DataFrame({"hash": h.view(np.int64), "text_no": no, "item_at": at})

    wanted = stored(texts.mapInPandas(item_seeds, "hash long, text_no long, item_at int"), "item-seeds")
    filled = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select("hash").distinct()))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = word_keys()
        for ids, batch in slices(batches):
            out = []
            for i, t in zip(ids, batch):
                words = keys.of(words_of(t))
                h, at = seeds(words, short)
                hit = in_bloom(filled.value, h)
                if len(hit):
                    out.append((i, words.tobytes(), h[hit].view(np.int64).tolist(), at[hit].tolist()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())))], names=["id", "doc_words", "hashes", "places"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    likely = base.mapInArrow(looked_up, "id long, doc_words binary, hashes array<long>, places array<int>")
    likely = stored(likely.withColumn("row", F.monotonically_increasing_id()), "likely-leaks")
    hits = likely.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("row", F.col("s.hashes").alias("hash"), F.col("s.places").alias("doc_at"))
    diagonals = hits.join(wanted, "hash").select("row", "text_no", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
    pairs = diagonals.join(likely.select("row", "id", "doc_words"), "row").join(texts.select("text_no", F.col("words").alias("item_words")), "text_no")

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, no, d, a, b in zip(frame["id"], frame["text_no"], frame["diagonal"], frame["doc_words"], frame["item_words"]):
                item = np.frombuffer(b, U64)
                start, end, match = best_overlap(np.frombuffer(a, U64), item, d)
                whole = len(item) if len(item) < SPAN else int(np.ceil(MIN_SHARE * len(item)))
                if match >= min(MIN_WORDS, whole):
                    out.append((i, no, start, end, end - start, match))
            if out:
                yield pd.DataFrame(out, columns=["id", "text_no", "start_word", "end_word", "n_words", "n_match"]).astype({"id": "Int64"})

    best = F.max_by(F.struct("start_word", "end_word", "n_words", "n_match"), F.struct("n_match", -F.col("start_word"), "end_word"))
    found = pairs.select("id", "text_no", "diagonal", "doc_words", "item_words").mapInPandas(verified, "id long, text_no long, start_word int, end_word int, n_words int, n_match int")
    found = found.groupBy("id", "text_no").agg(best.alias("b"))
    named = items.join(texts.select("words", "text_no"), "words").select("item", "text_no")
    return found.join(named, "text_no").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.*").distinct()


ship_by_value(__name__)
