"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds one bit per language, so and-ing
the slots of an n-gram gives the set of all languages that contain it. A text's languages are
compared by how many of its n-grams each contains, less the share of hits that the filter's
fill makes expect by chance.

N-grams are four bytes of the lower-cased letters in UTF-8, other characters being one space. A
language contains an n-gram if it makes up at least `RARE` of the language's n-grams and its
share there is at least `RATIO` of its largest share anywhere. So no language contains more than
1 / RARE n-grams, whatever the corpus, and the filter has a fixed largest size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import U64, slices, spread
from tickloom.session import ship_by_value

RARE = 1e-6
RATIO = 0.2
HASHES = 3
UNKNOWN = "und"


def plain(text: str | None) -> bytes:
    """Padded letters of a text; empty if it has no letter."""
    letters = re.sub(r"[\W\d_]+", " ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, letters)):
        return b""
    return b"  " + letters.encode("utf-8", "replace") + b"    "


def grams(joined: bytes) -> np.ndarray:
    """Four-byte windows that start at each byte (the last three wrap into zeros)."""
    b = np.frombuffer(joined + b"\0\0\0", np.uint8).astype(np.uint32)
    return b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))


@dataclass(frozen=True)
class Filter:
    languages: list[str]
    slots: np.ndarray  # (slot, word): a bit per language, 64 languages a word
    chance: np.ndarray  # of each language to contain an n-gram that it does not

    def masks(self, g: np.ndarray) -> np.ndarray:
        keys = g.astype(U64)
        found = self.slots[spread(keys, 0, len(self.slots))]
        for i in range(1, HASHES):
            found &= self.slots[spread(keys, i, len(self.slots))]
        return found

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Per text and language, n-grams contained, corrected for false positives."""
        sizes = np.array([len(t) for t in texts])
        counts = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(sizes)
        if len(full) == 0:
            return counts
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        found = self.masks(grams(b"".join(texts)))
        for k in range(len(self.languages)):
            bit = (found[:, k // 64] >> found.dtype.type(k % 64)) & found.dtype.type(1)
            counts[full, k] = np.add.reduceat(bit.astype(np.int64), starts)
        chance = self.chance[None, :]
        return np.maximum(0, (counts - sizes[:, None] * chance) / (1 - chance))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filter:
    """Count the n-grams of all labelled texts and build the filter."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            for lang, texts in held.items():
                g, n = np.unique(grams(b"".join(texts)), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        held: dict[str, list[bytes]] = {}
        size = 0
        for texts, langs in slices(batches):
            for t, lang in zip(texts, langs):
                p = plain(t)
                held.setdefault(lang, []).append(p)
                size += len(p)
                if size > 8_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    rows = labelled.where(F.col(lang_col).isNotNull()).select(text_col, lang_col)
    counts = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filter([], np.zeros((1, 1), np.uint8), np.zeros(0))
    words = -(-len(languages) // 64)
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, float(totals[k]))]), F.col("lang"))
    kept = counts.withColumn("share", share).groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("by"))
    contains = F.filter("by", lambda x: (x["share"] >= RARE) & (x["share"] >= RATIO * F.col("most")))

    def mask(word: int):
        bits = F.create_map(*[v for i, k in enumerate(languages) for v in (F.lit(k), F.expr(f"shiftleft(1L, {i % 64})") if i // 64 == word else F.lit(0).cast("long"))])
        return F.aggregate(contains, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.element_at(bits, x["lang"]))).alias(f"m{word}")

    table = kept.where(F.col("most") >= RARE).select("gram", *map(mask, range(words))).toPandas()
    gram = table["gram"].to_numpy(np.int64).astype(U64)
    masks = np.stack([table[f"m{w}"].to_numpy(np.int64).view(U64) for w in range(words)], axis=1)
    size = 1 << 16
    while size < 8 * len(gram):
        size *= 2
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * np.dtype(t).itemsize), np.uint64)
    slots = np.zeros((size, words), kind)
    for i in range(HASHES):
        np.bitwise_or.at(slots, spread(gram, i, size), masks.astype(kind))
    fill = np.array([((slots[:, k // 64] >> kind(k % 64)) & kind(1)).mean() for k in range(len(languages))])
    return Filter(languages, slots, fill**HASHES)


def language_id(docs: DataFrame, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_pred (string) and score (double, 0 to 1) in place of columns of those names.

    A null text and one without a letter are `und` with score 0, and so is every text if nothing
    is labelled. A tie goes to the first language by name; without evidence for any language the
    score is 0. The score is the best language's share of the evidence.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(labelled, text_col, lang_col))
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = rest.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [plain(t) for t in part.column(at).to_pylist()]
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m.languages:
                    seen = m.evidence(texts)
                    top, total = seen.argmax(1), seen.sum(1)
                    score = np.where(total > 0, seen.max(1) / np.maximum(total, 1e-300), 0.0)
                    best = [m.languages[k] if t else UNKNOWN for k, t in zip(top, texts)]
                yield pa.record_batch([*part.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*rest, "lang_pred", "score"])

    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*rest).mapInArrow(predict, schema)


ship_by_value(__name__)
