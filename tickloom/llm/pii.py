"""Personal data: fixed patterns, and terms that reveal a protected entity.

Patterns find e-mail and IP addresses, card and phone numbers; each distinct value is a protected
entity. The method then asks of all terms of the documents that hold an entity how much they tell
about it. Over the whole corpus,

    disclosure(t -> e) = log(p(e, t) / (p(e) p(t))) / -log p(e)

is the pointwise mutual information of term and entity over the information content of the
entity: 0 if the term says nothing, 1 if it gives the entity away. p(t) is the term's share of
all documents. A term is disclosing from `GENERALISE` on if so many meetings come by chance with
probability `CHANCE` at most (copies of one passage count once). It is generalised to its kind, or
removed from `REMOVE` on. An entity in one document is judged too:
the larger the corpus, the less a rare term stands there by chance. Every place of a disclosing term
is cut in every document that holds the entity.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import U64, bloom, in_bloom, longs, process_cache, slices, stored
from tickloom.session import ship_by_value

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 100  # characters on each side of an entity that tell copies of one passage; they bound nothing else
CHANCE = 0.01
GENERALISE = 0.8
REMOVE = 0.95

# fixed values: the patterns of the contract. A digit before the match cannot start one, as the run is taken whole.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        rest = DOMAIN.match(text, at) if start < at else None
        if rest:
            yield start, rest.end()
            end = rest.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; offsets in code points."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The protected entities of a text, each once: its key, and a key of the text around all its places."""
    around = {}
    for kind, a, b in spans:
        near = key(text[max(0, a - CONTEXT) : a] + "\0" + text[b : b + CONTEXT])
        around.setdefault(key(f"{kind}:{text[a:b].lower()}"), set()).add(near)
    return [{"e": e, "w": key(",".join(map(str, sorted(w))))} for e, w in around.items()]


def terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms outside all base spans."""
    taken, i = sorted((a, b) for _, a, b in spans), 0
    reach = list(accumulate((b for _, b in taken), max))
    for m in TERM.finditer(text):
        s, e = m.span()
        while i < len(taken) and reach[i] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:
            yield m[0].lower(), s, e


FOUND = "id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, text string, entities array<struct<e: long, w: long>>"
ENTITIES = pa.list_(pa.struct([("e", pa.int64()), ("w", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, keys, texts in slices(batches):
        rows = []
        for i, k, t in zip(ids, keys, texts):
            t = t or ""
            spans = base_spans(t)
            n = Counter(kind for kind, _, _ in spans)
            rows.append((i, k, n["email"], n["ip"], n["card"], n["phone"], written(spans), t if spans else None, entities(t, spans)))
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 6, pa.string(), pa.string(), ENTITIES))],
            names=["id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "text", "entities"],
        )


def read_spans(base: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, t): the distinct terms of each document that holds an entity."""
    for batch in batches:
        for rows, bases, texts in slices([batch], 64):
            known = process_cache("term_keys", TermKeys)
            if len(known) > 150_000:
                known.clear()
            at, keys = [], []
            for r, base, text in zip(rows, bases, texts):
                found = {t for t, _, _ in terms(text, read_spans(base))}
                keys += map(known.__getitem__, found)
                at += [r] * len(found)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(keys, pa.int64())], names=["row", "t"])


CUTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())]))


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans, then every place of the disclosing terms."""
    for batch in batches:
        for part in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):
            *rest, bases, texts, told = part.columns
            out = []
            for base, text, some in zip(bases.to_pylist(), texts.to_pylist(), told.to_pylist()):
                spans = read_spans(base)
                cuts = [(k, a, b, True) for k, a, b in spans]
                if some:
                    wanted = {x["t"]: x["remove"] for x in some}
                    cuts += [("term", a, b, wanted[k]) for t, a, b in terms(text, spans) if (k := key(t)) in wanted]
                out.append([dict(zip(("kind", "start", "end", "remove"), c)) for c in cuts])
            yield pa.record_batch([*rest, bases, pa.array(out, CUTS)], names=[*part.schema.names[:-2], "cuts"])


class TermKeys(dict):
    def __missing__(self, term: str) -> int:
        found = self[term] = key(term)
        return found


def document_frequency(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, df): in how many of all texts each wanted term stands. Texts are counted before the shuffle."""
    filled = texts.sparkSession.sparkContext.broadcast(bloom(terms))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = process_cache("term_keys", TermKeys)
        held, size = [], 0

        def flush():
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([longs(t), pa.array(n)], names=["t", "df"])

        for (some,) in slices(batches):
            for text in some:
                if len(known) > 150_000:
                    known.clear()
                words = set(TERM.findall(text.lower())) if text else ()
                keys = np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(U64)
                hit = keys[in_bloom(filled.value, keys)]
                if len(hit):
                    held.append(hit)
                    size += len(hit)
            if size > 500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = texts.mapInArrow(counted, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    return counts.join(terms, "t")


def log_chance(n_et: Column, support: Column, n_e: Column, df: Column, total: int) -> Column:
    """Upper bound of the log probability that so many meetings come by chance: m^n / n!, m = n_e df / total.

    Bounds the hypergeometric tail; n! from below by Stirling. n are the meetings in different
    surroundings, and where k copies stand for one, n_e and df shrink by k as well.
    """
    n = F.least(support, n_et).cast("double")
    k = F.greatest(n_et / support, F.lit(1.0))
    m = n_e * df / (k * k * F.lit(float(total)))
    return n * F.log(m) - (n * F.log(n) - n + 0.5 * F.log(F.lit(2 * math.pi) * n))


FIELDS = ["id", "text_key", "n_email", "n_ip", "n_card", "n_phone"]


def disclosing(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(e, t, remove) of the pairs that disclose, and (row, e, t) of the documents they may stand in.

    Meetings are counted in whole documents. As n_et is at most n_e, a term of df documents can only reach
    `GENERALISE` where df <= total^(1 - GENERALISE) n_e^GENERALISE; other pairs are never made. The entities that
    stand in one same document only are alike for every term, so one stands for all of them.
    """
    total = found.count()
    held = found.where(F.size("entities") > 0)
    stand = held.select("row", F.inline("entities"))
    words = stored(held.select("row", "base", "text").mapInArrow(_terms, "row long, t long"), "terms")
    df = document_frequency(texts, words.select("t").distinct())
    n_e = stand.groupBy("e").agg(F.count("*").alias("n_e"))
    stand = stand.join(n_e, "e").groupBy("row", F.when(F.col("n_e") > 1, F.col("e")).alias("shared")).agg(
        F.min("e").alias("e"), F.min("w").alias("w"), F.first("n_e").alias("n_e"))
    stand = stored(stand.drop("shared"), "entities")
    most = F.pow(F.lit(float(max(total, 1))), F.lit(1 - GENERALISE)) * F.pow(F.col("n_e"), F.lit(GENERALISE)) * (1 + 1e-9)
    largest = stand.groupBy("row").agg(F.max(most).alias("largest"))
    rare = words.join(df, "t").join(largest, "row").where(F.col("df") <= F.col("largest")).drop("largest")
    pairs = stored(rare.join(stand, "row").where(F.col("df") <= most).select("row", "e", "w", "t", "n_e", "df"), "entity-terms")
    met = pairs.groupBy("e", "t").agg(F.count_distinct("w").alias("support"), F.count_distinct("row").alias("n_et"), F.first("n_e").alias("n_e"), F.first("df").alias("df"))
    pmi = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("df")))
    judged = met.withColumn("disclosure", pmi / F.log(F.lit(float(total)) / F.col("n_e")))
    chance = log_chance(F.col("n_et"), F.col("support"), F.col("n_e"), F.col("df"), total)
    told = judged.where((F.col("disclosure") >= GENERALISE) & (chance <= math.log(CHANCE)))
    return told.select("e", "t", (F.col("disclosure") >= REMOVE).alias("remove")), pairs.select("row", "e", "t")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_key, n_email, n_ip, n_card, n_phone, base_sha256, spans, cuts.

    spans is kind:start:end of all spans by kind (email, ip, card, phone, term), then start, comma-joined;
    cuts has them as an array of (kind, start, end, remove). A null text is an empty one: no spans, the hash
    of nothing. Repeated documents and null ids keep their rows. text_key names the text. Other columns are
    ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    found = stored(base.mapInArrow(_found, FOUND).withColumn("row", F.monotonically_increasing_id()), "found")
    told, pairs = disclosing(found, docs.select(F.col(text_col).cast("string").alias("text")))
    terms = pairs.join(told, ["e", "t"]).groupBy("row", "t").agg(F.max("remove").alias("remove"))
    terms = terms.groupBy("row").agg(F.collect_list(F.struct("t", "remove")).alias("told"))
    joined = found.join(terms, "row", "left").select(*FIELDS, "base", "text", "told")
    cut = joined.mapInArrow(_cuts, f"{', '.join(f'{c} long' for c in FIELDS)}, base string, cuts array<struct<kind: string, start: int, end: int, remove: boolean>>")
    return cut.select(
        F.col("id").alias(id_col), *FIELDS[1:], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("cuts", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("spans"), "cuts",
    )


def sanitised(text: str | None, cuts: list[dict] | None) -> str | None:
    """The text with spans replaced: base spans and generalised terms by their kind, removed terms by nothing."""
    if not text or not cuts:
        return text
    out, at = [], 0
    for c in sorted(cuts, key=lambda c: (c["start"], -c["end"])):
        if c["start"] >= at:
            out += [text[at : c["start"]], "" if c["kind"] == "term" and c["remove"] else f"[{c['kind'].upper()}]"]
        at = max(at, c["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data and disclosing terms taken out of the text; all rows and columns stay."""
    found = find_private(docs, id_col, text_col).where("size(cuts) > 0")
    cuts = found.select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"), "cuts").dropDuplicates(["__id", "__key"]).withColumnRenamed("cuts", "__cuts")
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__key"))
    joined = docs.join(cuts, same, "left").drop("__id", "__key")
    columns, at = docs.columns, docs.columns.index(text_col)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, cut = batch.columns
            held = cut.is_valid().to_numpy(zero_copy_only=False)
            if held.any():
                texts = [sanitised(t, c) for t, c in zip(rest[at].to_pylist(), cut.to_pylist())]
                rest[at] = pa.array(texts, rest[at].type)
            yield pa.record_batch(rest, names=columns)

    return joined.mapInArrow(replaced, docs.schema)


ship_by_value(__name__)
