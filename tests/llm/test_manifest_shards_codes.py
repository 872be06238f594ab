"""Product codes, Merkle manifest and shards: against plain Python, and on odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle, vector_codes as vc
from tickloom.llm.merkle import address, dataset_manifest, folded, laid_out, levels_of, siblings, subtree_size, tiers
from tickloom.llm.queries import ORACLES, QUERIES
from tickloom.llm.ranks import ranked
from tickloom.llm.sharding import Shard, placed, sharded, topology, write_shards
from tickloom.llm.vector_codes import decoded, fingerprint, vector_codes
from tickloom.session import shared_dir


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_merkle_manifest", "op13_sharding"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


# --- ranks -----------------------------------------------------------------------------------


def test_ranks_of_a_hot_group_spread_over_tasks(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 > 0, F.col("id").cast("string")).alias("g"), "id")
    got = ranked(rows, ["g"], ["id"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r)
    order = sorted(by, key=lambda g: (g is not None, g or ""))
    assert len(got) == 5000 and [by[g][0]["group_no"] for g in order] == list(range(len(order)))
    for rs in by.values():
        assert [r["position"] for r in sorted(rs, key=lambda r: r["id"])] == list(range(len(rs))) and {r["group_size"] for r in rs} == {len(rs)}
    assert ranked(rows.limit(0), ["g"], ["id"]).count() == 0


# --- manifest --------------------------------------------------------------------------------


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars); returns doc_id -> list of result tuples."""
    def f(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return H(f(r[0]), f(r[3]), f(r[2]), f(r[4]), f(text))

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        steps = []
        for level in tree[:-1]:
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            steps.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
            i //= 16
        return steps

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    out = []
    for t, s in enumerate(sources):
        for i, (_, _, d, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[t], i) + path(top, t)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            cur = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])) if tampered else d
            for own, others in steps:
                cur = H(*others[:own], cur, *others[own:])
            out.append((r[0], d, trees[t][-1][0], top[-1][0], H(*[x for _, o in steps for x in o]), cur, cur == top[-1][0]))
    return sorted(out, key=str)


FIELDS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, position int, id string, top int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], DOCS)


def got_manifest(spark, rows):
    return sorted((tuple(r) for r in dataset_manifest(docs_frame(spark, rows)).select(*FIELDS).collect()), key=str)


def test_manifest_equals_brute_force_on_odd_rows(spark):
    rows = [(i, f"Text {i}" if i % 4 else None, "en" if i % 3 else None, None if i % 5 == 0 else "hot" if i % 5 < 4 else f"s{i}", i if i % 2 else None) for i in range(900)]
    rows += [(7, "Text 7", "en", "hot", 7)] * 3 + [(None, "A", "en", "hot", 1), (None, "B", None, "ÿ", 1), (None, "", "", "", 0), (5000, "É" * 20_000, "fr", "ÿ", 2), (5001, "x", "z", "😀", 1)]
    assert got_manifest(spark, rows) == brute_manifest(rows)
    assert {r[6] for r in brute_manifest(rows)} == {True, False}


def test_manifest_of_blocks_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 1)
    rows = [(i, f"Text {i}", "en", "a" if i < 4500 else f"s{i}", i) for i in range(4530)]
    assert tiers(4) == [1, 1, 1, 1] and got_manifest(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_sizes_at_the_edges(spark, n):
    rows = [(i, f"T{i}", "en", "a", i) for i in range(n)]
    assert got_manifest(spark, rows) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert dataset_manifest(docs_frame(spark, [])).select(*FIELDS).collect() == []


@pytest.mark.parametrize("height", [0, 1, 2, 3, 4])
def test_addresses_are_a_bijection_with_aligned_subtrees(height):
    places = np.concatenate([address(height, d, np.arange(16**d)) for d in range(height + 1)])
    assert sorted(places) == list(range(subtree_size(height)))
    if height > 1:  # a bottom subtree is one stretch
        top = (height - 1) // 2
        low = height - top - 1
        for s in (0, 3):
            stretch = np.concatenate([address(height, top + 1 + d, s * 16**d + np.arange(16**d)) for d in range(low + 1)])
            assert stretch.max() - stretch.min() + 1 == len(stretch) == subtree_size(low)


def test_siblings_fold_to_the_root():
    leaves = [sha256(bytes([i % 256, i // 256])).digest() for i in range(300)]
    nodes = laid_out(leaves, 3)
    levels = levels_of(nodes, 3, 300)
    for i in (0, 15, 16, 255, 256, 299):
        assert folded(leaves[i].hex(), *siblings(levels, i)) == nodes[:32].hex()
        assert folded(leaves[i - 1].hex(), *siblings(levels, i)) != nodes[:32].hex()


# --- shards ----------------------------------------------------------------------------------


def shard_of(rows, shards, n=20_000):
    keys = rows.range(n).withColumn("k", F.col("id").cast("string"))
    return {r["id"]: r["s"] for r in placed(keys, F.col("k"), shards, "s").collect()}


def test_shares_follow_the_weights(spark):
    shards = [Shard("a", "1", 0, 1.0), Shard("a", "1", 1, 2.0), Shard("a", "2", 2, 3.0), Shard("b", "1", 3, 4.0), Shard("b", "9", 4, 0.0)]
    seen = Counter(shard_of(spark, shards).values())
    for s in shards:
        p = s.weight / 10
        assert abs(seen[s.shard] - 20_000 * p) <= 5 * math.sqrt(20_000 * p * (1 - p)) + 1e-9


def test_a_new_region_takes_rows_only_into_itself(spark):
    for n, added in ((1, 0), (7, 0), (19, 0), (40, 0), (40, 5)):
        before, after = shard_of(spark, topology(n, added), 5000), shard_of(spark, topology(n, added + 1), 5000)
        assert {after[k] for k in before if before[k] != after[k]} == {n + added}


def test_movement_stays_inside_the_changed_subtree(spark):
    shards = topology(40)
    grown = [Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 7 else 1.0) for s in shards]
    before, after = shard_of(spark, shards), shard_of(spark, grown)
    region = {s.shard: s.region for s in shards}
    rack = {s.shard: s.rack for s in shards}
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved
    for a, b in moved:
        if region[a] == region[b] == "region0":
            assert b == 7 if rack[a] == rack[b] else rack[b] == rack[7]
        else:
            assert region[a] == "region1" and region[b] == "region0"


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(i, f"é{i}") for i in range(300)] + [(None, "a"), (None, None), (5, "é5"), (5, "other"), (6, ""), (7, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, shard int, row string, position int")
    got = sharded(docs, topology(40), topology(40, 1)).collect()
    assert len(got) == len(rows)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by, ids = defaultdict(list), defaultdict(set)
    for r in got:
        by[r["shard"]].append(r["slot"])
        ids[r["id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in ids.values())
    assert sharded(docs.limit(0), topology(40)).collect() == []
    with pytest.raises(ValueError):
        sharded(docs, [Shard("a", "b", 0, 0.0)])
    path = shared_dir(spark, "shards")
    write_shards(docs, topology(5), path)
    back = spark.read.parquet(path)
    assert back.count() == len(rows) and back.select("_shard").distinct().count() == 5


# --- codes -----------------------------------------------------------------------------------


def brute_codes(v, parts=4, entries=256, rounds=4):
    n, width = len(v), v.shape[1] // parts
    cut = v.reshape(n, parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        code = np.stack([((cut[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], axis=1)
        if r == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = cut[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    error = sum(((cut[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
    return code, error, books


def vectors(spark, x, labels=None, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(i, v if v is None else [c if c is None else float(c) for c in v], None if labels is None else labels[k], "x", 1, "y") for k, (i, v) in enumerate(zip(ids, x))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, state string, id int, v string")


@pytest.mark.parametrize("scale", [1, 50_000])
def test_codes_equal_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((1500, 16)) * scale, 2)
    x[700:800] = x[3]
    labels = [None if i % 7 == 0 else 1 if i % 3 else i for i in range(1500)]
    got, books = vector_codes(vectors(spark, x, labels))
    rows = {r["id"]: r for r in got.collect()}
    code, error, want = brute_codes(np.floor(x * 1024).astype(np.int64))
    sums = Counter()
    for k, e in zip(labels, error):
        sums[k] += int(e)
    assert (books == want).all() and len(rows) == 1500
    for i in range(1500):
        assert rows[i]["code"] == bytes(code[i].astype(np.uint8)).hex() and rows[i]["error"] == error[i] and rows[i]["label_error"] == sums[labels[i]]
    assert sum(r["scans"] for r in rows.values()) < 1500 * 4 * 4 * 5  # bounds do spare scans
    assert abs(decoded(rows[9]["code"], books) - x[9]).max() < 5 * scale


def test_bounds_by_net_displacement_are_never_looser():
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.integers(-9, 10, (5, 32, 4)), axis=0)
    net = vc.displacement(walk[0], walk[-1])
    summed = sum(vc.displacement(walk[i], walk[i + 1]) for i in range(4))
    assert (net <= summed + 1e-9).all() and (net < summed - 1e-9).any()


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((40, 8))
    good[5] = good[6] = 0
    odd = [None, [], [None] * 8, [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7]
    ids = [*range(20), *range(20), None, 99, 100, 101, 102]
    got, books = vector_codes(vectors(spark, [*good.tolist(), *odd], None, ids))
    assert books.shape == (4, 40, 2) and Counter(r["id"] for r in got.collect()) == Counter([*range(20), *range(20)])
    order = sorted(range(40), key=lambda k: (ids[k], np.floor(good[k] * 1024).tolist()))
    code, error, want = brute_codes(np.floor(good[order] * 1024).astype(np.int64))
    assert (books == want).all() and sorted(r["error"] for r in got.collect()) == sorted(error)
    none, empty = vector_codes(vectors(spark, odd[:2]))
    assert none.collect() == [] and fingerprint(empty) == sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vector_codes(vectors(spark, [[1.0] * 8, [1.0] * 4]))
    with pytest.raises(ValueError):
        vector_codes(vectors(spark, [[1e15] * 8]))
