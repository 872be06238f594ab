"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import html_extract, lm_scoring, packing, pii
from tickloom.llm.chat import chat_digest, chat_formatting, formatted, read_back, reply_paths
from tickloom.llm.common import components, table
from tickloom.llm.decontaminate import contaminated
from tickloom.llm.embedding_dedup import embedding_dedup
from tickloom.llm.language_id import language_id
from tickloom.llm.ngram_join import linked_pairs, ngram_join
from tickloom.llm.queries import QUERIES, tokenizer_path
from tickloom.llm.warc import read_warc, warc_round_trip, write_warc
from tickloom.session import shared_dir

LONG = " ".join(f"w{i % 7919}x{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, id string, n int, sig string, row string, key string, word string, score string"


def frame(spark, rows):
    """(doc_id, text, lang) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "a", 1, "b", "c", "d", "e", "f") for r in rows], SCHEMA)


def messy(spark):
    base = " ".join(f"tok{i}" for i in range(60))
    rows = [
        (1, base, "en"), (2, base + " more", "en"), (2, base + " more", "en"), (3, base, "de"), (4, None, "en"), (5, "", None), (6, " \n\t ", "en"),
        (7, "only three words", "en"), (8, "ONLY three  words", "en"), (9, LONG, "en"), (10, LONG + " tail", "en"), (None, base, "en"), (11, "é" * 5000, "fr"), (12, "12 !! 34", "en"),
    ]
    return frame(spark, rows)


def components_of(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(rows):
    sets = {i: shingles(t) for i, t in rows}
    has = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            has[h].append(i)
    pairs = []
    for i, s in sets.items():
        for j, k in Counter(j for h in s for j in has[h] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                pairs.append((i, j))
    same = components_of(list(sets), pairs)
    return {i: (len(sets[i]), same[i]) for i in sets}


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (9, 9), (3, 160)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 3 for i in [3, *range(100, 161)]}, 5: 5, 7: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op2_ngram_join"](spark, sf).collect()}
    assert got == brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_ngram_join_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    words = [f"q{i}" for i in range(120)]
    rows = []
    for i in range(150):
        mine = list(words)
        for at in rng.choice(120, rng.integers(1, 8), replace=False):
            mine[at] = f"z{rng.integers(40)}"
        rows.append((1000 - i, " ".join(mine), "en"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(frame(spark, rows)).collect()}
    assert got == brute_join([r[:2] for r in rows])


def test_ngram_join_odd_rows(spark):
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join(messy(spark)).collect()), key=str)
    by = dict((i, (n, c)) for i, n, c in got)
    assert len(got) == 14 and by[1][1] == by[2][1] == by[3][1] == by[-1][1] == 1
    assert by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (0, 6) and by[7] == by[8] == (1, 7) and by[10][1] == 9
    assert ngram_join(frame(spark, [])).count() == 0


def test_blocks_across_link_only_across():
    lists = [np.arange(50), np.arange(50), np.arange(50) + 1]
    n, prefix = np.array([50] * 3), np.array([11] * 3)
    assert len(linked_pairs(np.arange(3), n, prefix, lists, np.array([False] * 3), 80)) == 2
    assert linked_pairs(np.arange(2), n[:2], prefix[:2], lists[:2], np.array([True, True]), 80) == []


def test_embedding_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(int(i), (base[i % 40] + rng.standard_normal(16) * rng.uniform(0, 0.6)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(2000, [2 * x for x in rows[0][1]])]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None, 1.0]), (3004, []), (3005, [float("inf"), 1.0]), (3006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, x, 1, "a", 2) for i, x in rows + odd], "vec_id long, embedding array<double>, label int, no string, x int")
    got = {r["vec_id"]: r for r in embedding_dedup(df).collect()}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    same = components_of(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(s)) if a < b])
    found = sum(got[i]["n_links"] for i in ids.tolist())
    assert 0.97 * s.sum() <= found <= s.sum() and all(got[int(i)]["n_links"] <= k for i, k in zip(ids, s.sum(1)))
    assert np.mean([got[i]["component_id"] == same[i] for i in ids.tolist()]) > 0.97
    assert got[1003]["component_id"] == got[2000]["component_id"] == got[0]["component_id"]
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in odd)
    assert embedding_dedup(df.where("false")).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    item = [f"item{i}" for i in range(40)]
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    filler = [f"f{i}" for i in range(500)]
    docs = frame(spark, [
        (1, " ".join(filler + item + filler), "en"), (2, " ".join(filler[:50] + changed), "en"), (3, " ".join(filler), "en"), (4, " ".join(item[:9] + filler), "en"), (5, None, "en"),
        (6, "", "en"), (7, "say five short words here now", "en"), (1, " ".join(filler + item + filler), "en"), (None, " ".join(item), "en"), (8, " ".join(item).upper(), "en"), (9, LONG, "en")])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "five short words here"), (3, None), (4, ""), (5, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}
    assert {k[0] for k in got if k[1] == 1} == {1, 2, 8, None} == {k[0] for k in got if k[1] == 5} and {k for k in got if k[1] == 2} == {(7, 2)}
    assert got[1, 1]["start_word"] == 500 and got[1, 1]["n_match"] == 40 and got[2, 1]["n_match"] >= 34
    assert contaminated(docs.where("false"), bench).count() == 0 == contaminated(docs, bench.where("false")).count()


def test_decontamination_finds_every_long_overlap(spark, sf):
    key = lambda t: (t or "").encode().lower().split()
    windows = defaultdict(set)
    for r in table(spark, sf, "benchmark").collect():
        w = key(r["text"])
        for i in range(len(w) - 12):
            windows[tuple(w[i : i + 13])].add(r["item_id"])
    wanted = {(r["doc_id"], i) for r in table(spark, sf, "documents").collect() for w in [key(r["text"])] for k in range(len(w) - 12) for i in windows.get(tuple(w[k : k + 13]), ())}
    assert wanted <= {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontaminate"](spark, sf).collect()}


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op6_language_id"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    docs = messy(spark)
    got = {r["doc_id"]: r for r in language_id(docs, docs).collect()}
    assert [got[i]["lang_pred"] for i in (4, 5, 6, 12)] == ["und"] * 4 and got[11]["lang_pred"] == "fr" and got[1]["id"] == "a"
    assert {r["lang_pred"] for r in language_id(docs, docs.where("false")).collect()} == {"und"} and language_id(docs.where("false"), docs).count() == 0


PATTERNS = [  # fixed values
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(sum(divmod(v * (1 + i % 2), 10)) for i, v in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(4)
    alphabet = list("a@.-_+ 0123456789()é\n") + ["@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (724) 555-7058"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("a@b.c@d.e a@b@c.d 1.2.3.256 0001.2.3.4") == brute_spans("a@b.c@d.e a@b@c.d 1.2.3.256 0001.2.3.4")
    assert pii.base_spans("9" * 200_000 + "a" * 200_000 + "+" * 1000) == []


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"In round {i} the person Zyxwo wrote from box {i} at zy@mail.example.com about item {i} and more", "en") for i in range(6)]
    rows += [(100 + i, f"The person of case {i} wrote about more and more", "en") for i in range(60)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "one@mail.example.com next to Unique text", "en"), (0, rows[0][1], "en"), (None, "call +1 (724) 555-7058 now", "en"), (203, LONG, "en")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in pii.find_private(docs).collect()}
    assert pii.find_private(docs).count() == len(rows)
    terms = {rows[1][1][c["start"] : c["end"]] for c in got[1]["cuts"] if c["kind"] == "term"}
    assert "Zyxwo" in terms and not terms & {"the", "person", "wrote", "about", "more"}
    assert all("term" not in got[i]["spans"] for i in (200, 201, 202, 203, 130)) and got[200]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = pii.sanitise(docs)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert "Zyxwo" not in texts[1] and "[EMAIL]" in texts[1] and texts[None] == "call [PHONE] now" and texts[130] == rows[36][1] and texts[200] is None and texts[203] == LONG
    assert pii.find_private(docs.where("false")).count() == 0


def test_entities_of_one_and_two_documents(spark):
    rows = [(i, f"Plain case {i} of the day and more", "en") for i in range(4000)]
    rows += [(5000, "Write to one@mail.example.com the Zyxwo of the day", "en")]
    rows += [(5001 + i, f"Case {i} and two@mail.example.com the Qevrab of the day", "en") for i in range(2)]
    cut = {r["doc_id"]: [rows[-3 + r["doc_id"] - 5000][1][c["start"] : c["end"]] for c in r["cuts"] if c["kind"] == "term"] for r in pii.find_private(frame(spark, rows)).where("doc_id >= 5000").collect()}
    assert "Zyxwo" in cut[5000] and cut[5001] == cut[5002] == ["Qevrab"]
    assert not {w.lower() for some in cut.values() for w in some} & {"the", "day", "case", "and"}
    few = pii.find_private(frame(spark, rows[-3:] + rows[:40])).where("doc_id = 5000").first()
    assert "term" not in few["spans"]  # among 43 documents any rare term may stand there by chance


def test_disclosing_terms_far_from_the_entity(spark):
    gap = " of the day and more" * 30
    rows = [(i, f"Plain case {i}{gap}", "en") for i in range(300)]
    rows += [(5000 + i, f"Write in case {i} to far@mail.example.com or far@mail.example.com{gap} Zyxwo{gap} ZYXWO", "en") for i in range(5)]
    rows += [(6000, f"Case 9 of Zyxwo{gap}", "en")]
    got = {r["doc_id"]: r for r in pii.find_private(frame(spark, rows)).collect()}
    for i in range(5):
        text = rows[300 + i][1]
        assert [text[c["start"] : c["end"]] for c in got[5000 + i]["cuts"] if c["kind"] == "term" and c["start"] > 200] == ["Zyxwo", "ZYXWO"]
    assert got[6000]["spans"] == "" and got[5000]["n_email"] == 2


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path())
    odd = ["Ça va, l'été n'est-ce pas? DON'T 12½ x²", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ nb wide \x1f odd", "東京 タワー é", "%%%a*** b### $$$", "a" * 3000, LONG, None, "", "'ll 've it's"]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(odd)] + [(None, "x", "en"), (3, odd[3], "en")])
    docs = docs.select("doc_id", "text").union(table(spark, sf, "documents").select(F.col("doc_id") + 1000, "text"))
    rows = packing.best_fit_packing(docs, tokenizer_path()).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    wanted = Counter()
    for i, some in texts.items():
        for t in some:
            ids = np.array([*known.encode(t, add_special_tokens=False).ids, 0], "<u4")
            wanted.update((i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    assert wanted == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in bins.values():
        some.sort()
        assert some[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(some, some[1:])) and sum(some[-1]) <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= math.ceil(total / 2048) * 1.02 + 1
    assert packing.best_fit_packing(docs.where("false"), tokenizer_path()).count() == 0


def test_packing_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_NODE", 50)
    rows = spark.range(2000).select((F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("length"), "id")
    got = packing.pack(rows, 100).toPandas()
    assert sorted(got["id"]) == list(range(2000)) and got.groupby("sequence_id")["length"].sum().max() <= 100
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 100 + 40


def test_lm_windows_score_each_symbol_once():
    for size in (1, 5, 31, 32, 33, 56, 57, 400):
        windows, real = lm_scoring.windows_of(np.arange(size), -1)
        assert sorted(windows[:, 1:][real]) == list(range(size))


def test_lm_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = QUERIES["op3_lm_scoring"](spark, sf).collect()
    out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), None] for r in docs.collect()}
    c = Counter(w for i, t in texts.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    odd = frame(spark, [(1, "the cat sat on the mat " * 50, "en"), (2, None, "en"), (3, "", "en"), (3, "", "en"), (None, "the cat", "en"), (4, LONG, "en")])
    got = lm_scoring.lm_scores(odd, F.lit(False), tokenizer_path()).collect()
    assert len(got) == 6 and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (2, 3))
    nothing = lm_scoring.lm_scores(odd, F.lit(True), tokenizer_path()).collect()
    assert all((r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0) for r in nothing)
    assert lm_scoring.lm_scores(odd.where("false"), F.lit(False), tokenizer_path()).count() == 0


def test_lm_learns_from_context():
    symbols = np.tile(np.arange(4), 400)
    windows, real = lm_scoring.windows_of(symbols, 4)
    w = lm_scoring.fit(lm_scoring.first_weights(np.bincount(symbols, minlength=5)), windows.astype(np.int64), real, epochs=40, batch=8)
    model = lm_scoring.Model(np.arange(5), np.zeros(5), w)
    assert lm_scoring.log_likelihoods(model, [symbols[:100]])[0] > lm_scoring.log_likelihoods(model, [np.zeros(100, int)])[0]
    assert lm_scoring.log_likelihoods(model, [symbols[:100]])[0] / 100 > -0.3


def test_warc_round_trip_whatever_the_ranges(spark):
    page = "<p>" + "x\x1f" * 200
    rows = [(5, "http://a/é b\r\nX: y", page), (3, None, page), (7, "http://c", page), (1, "http://d", "short"), (2, "http://e", "short"), (4, "http://f", None), (6, "http://g", ""), (8, "u", LONG), (None, "n", page), (9, "h", "a\r\n\r\nb" * 30)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")
    for step in (100, 1 << 20):
        got = {r["page_id"]: r for r in warc_round_trip(pages, step).collect()}
        assert len(got) == len(rows)
        for i, _, h in rows:
            data = (h or "").encode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
            assert got[i]["refers_to"] == (3 if i in (5, 7, None) else None) and got[i]["record_type"] == ("revisit" if i in (5, 7, None) else "response")
    assert warc_round_trip(pages.where("false")).count() == 0


def test_warc_reader_passes_over_what_is_no_record(spark):
    import gzip
    import os

    from tickloom.llm.warc import record

    good = [record(f"urn:page:{i}", "http://a", b"payload %d" % i * 50, "d", None) for i in range(4)]
    fake = gzip.compress(b"no record at all") + b"\x1f\x8b\x08junk" + b"\x1f\x8b"
    data = fake + good[0] + fake + good[1] + good[2] + b"\0" * 300 + good[3] + good[0][: len(good[0]) // 2]
    folder = shared_dir(spark, "odd")
    os.makedirs(folder)
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(data)
    manifest = spark.createDataFrame([(f"{folder}/a.warc.gz", len(data))], "file string, bytes long")
    for step in (7, 64, 1 << 20):
        got = sorted((r["record_id"], bytes(r["payload"])) for r in read_warc(manifest, step).collect())
        assert got == [(f"urn:page:{i}", b"payload %d" % i * 50) for i in range(4)]


def test_html_blocks():
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>T &amp; t</h1><p>One<br>two  <b>three</b><p>Four &lt;x&gt;<script>var a='</p>';</script><!-- no --></article>"
    found = html_extract.blocks(page)
    assert [b.text for b in found] == ["Home", "T & t", "One two three", "Four <x>"] and html_extract.silver(found).tolist() == [False, True, True, True]
    assert html_extract.blocks(None) == html_extract.blocks("") == html_extract.blocks("<p> </p>") == []
    assert [b.text for b in html_extract.blocks("a < b <p class=\"x>y\">c</p")] == ["a < b", "c</p"]


def test_html_extraction(spark, sf):
    pages = table(spark, sf, "pages")
    wanted = {r["page_id"]: "\n".join(b.text for b, y in zip(f, html_extract.silver(f)) if y) for r in pages.collect() for f in [html_extract.blocks(r["html"])]}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in QUERIES["op8_html_extraction"](spark, sf).collect()}
    assert got.keys() == wanted.keys() and np.mean([got[i][0] == t for i, t in wanted.items()]) >= 0.98 and all(n == len(t) for t, n in got.values())
    model = html_extract.train(pages)
    plain = "<body><div class='site-header'>Top</div><ul class='menu'><li><a href='/'>Home</a></ul><div class='content'><p>The story starts with this long sentence here.</p><p>It ends with another long sentence here.</p></div><div class='comments'><div class='comment'><p>I liked this story very much, thank you.</p></div></div></body>"
    odd = spark.createDataFrame([(1, plain, "a"), (2, None, "b"), (3, "", "c"), (3, "", "c"), (None, "<nav>x</nav>", "d"), (4, "<article>" + "<p>word</p>" * 3000 + "</article>", "e")], "page_id long, html string, text string")
    rows = {r["page_id"]: r for r in html_extract.extract(odd, model).collect()}
    assert rows[1]["text"] == "The story starts with this long sentence here.\nIt ends with another long sentence here." and rows[2]["text"] == rows[3]["text"] == "" and rows[4]["n_chars"] > 14_000
    assert html_extract.extract(odd.where("false"), html_extract.train(odd.where("false"))).count() == 0


def test_chat_escapes_are_reversible(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\\\|<|", "a\\n<\\|b", "", None, "<\\\\|", "\n\\\n"]
    rows = [(1, i, r, t) for i, t in enumerate(odd) for r in ("assistant", "us\ner\\n<|")] + [(1, 0, None, "x"), (1, 0, None, "x"), (None, 0, "user", "hi"), (2, None, "assistant", "é" * 3)]
    turns = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, id int")
    chats = chat_formatting(turns)
    got = {r["conv_id"]: r for r in chat_digest(chats).join(chats.select("c", "conv_id"), "c").collect()}
    for conv in (1, 2, None):
        mine = sorted([(t is not None, t or 0, r is not None, r or "", x is not None, x or "") for c, t, r, x in rows if c == conv])
        texts = "".join(f"{r}\n{x}\n" for *_, r, _, x in mine)
        loss = "".join(x for *_, r, _, x in mine if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(mine), hashlib.sha256(texts.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_formatting(turns.where("false")).count() == 0


def test_reply_trees_take_the_best_branch(spark):
    #      1 - 2 - 3 (5, 1)        7 - 8 - 7 runs in a circle; 9 answers it; 20 has an unknown parent
    #        \ 4 - 5 - 6 (2, 2, 9)
    rows = [(1, None, 0.0), (2, 1, 5.0), (3, 2, 1.0), (4, 1, 2.0), (5, 4, 2.0), (6, 5, 9.0), (7, 8, 1.0), (8, 7, 1.0), (9, 8, 1.0), (20, 99, None)]
    messages = spark.createDataFrame([("x", *r) for r in rows] + [("y", 1, None, 1.0)], "c string, id long, parent long, score double")
    got = sorted((r["c"], r["branch"], r["rank"], r["depth"], r["id"]) for r in reply_paths(messages, 2).collect())
    assert got == [("x", 3, 2, 0, 1), ("x", 3, 2, 1, 2), ("x", 3, 2, 2, 3), ("x", 6, 1, 0, 1), ("x", 6, 1, 1, 4), ("x", 6, 1, 2, 5), ("x", 6, 1, 3, 6), ("y", 1, 1, 0, 1)]
    chain = spark.range(200).select(F.lit("z").alias("c"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"))
    assert [r["depth"] for r in reply_paths(chain).orderBy("depth").collect()] == list(range(200))
    turns = reply_paths(messages).withColumn("role", F.lit("assistant")).withColumn("text", F.col("id").cast("string"))
    assert {r["loss"] for r in read_back(formatted(turns.where("c = 'x'"))).collect()} == {"1", "4", "5", "6"}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {i: t for i, t in docs.items() if any(map(str.isalpha, t or ""))}
    kept = {i: kept[i] for i, (_, c) in brute_join(kept.items()).items() if i == c}
    leaks = {r["doc_id"] for r in QUERIES["op5_decontaminate"](spark, sf).collect()}
    assert {r["doc_id"] for r in rows} == set(kept) - leaks and sum(r["length"] for r in rows) > 0
    odd = messy(spark).selectExpr("doc_id", "text", "lang", "'s' source", "cast(length(text) as long) n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.count() <= 14, name
        assert stage(spark, odd.where("false"), sf).count() == 0, name
