"""Cases that contracts name: doubles, long texts, repeated rows, ties and clashing columns."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from umbra.llm import ann, langid, mixing, ngram_join, quality, urls
from umbra.llm.common import arrow_batches


def test_nearest_keeps_doubles(spark):
    rows = [(0, [1e300, 0.0], "x"), (1, [1.0, 1e-12], "x"), (2, [1.0, 0.0], "x"), (3, [1e-300, 1e-300], "x"), (4, [1.0 + 1e-9, 1.0], "x")]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")).orderBy("rank").collect()
    vectors = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows}
    cosine = lambda b: float(vectors[0] @ vectors[b] / np.sqrt((vectors[0] @ vectors[0]) * (vectors[b] @ vectors[b])))
    assert [r.vec_id for r in got][:2] == [1, 2] and len(got) == 4
    assert all(abs(r.score - cosine(r.vec_id)) < 1e-15 for r in got)


def test_compound_suffixes_are_a_parameter(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.z",)], "host string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.host: (r.domain, r.suffix) for r in urls.reputation(hosts, none).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "x.y.z": ("y.z", "z")}
    assert {r.domain for r in urls.reputation(hosts, none, compound=("y.z",)).collect()} == {"co.uk", "x.y.z"}


def test_long_urls_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/" + "p" * 200_000, "x", 1), (1, "http://a.com/" + "p" * 200_000, "x", 1)], "page_id long, url string, rule string, bad int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.result(pages, labels).collect()
    assert len(got) == 2 and all(len(r.path) == 200_001 and r.verdict == "allow" for r in got)


def test_hosts_of_many_labels(spark):
    deep = "a." * 60_000 + "com"
    urls_ = [(1, f"http://{deep}/en/1"), (2, f"http://{'b.' * 20_000}example.com/en/7"), (3, "http://COM/en/"), (4, "http://com"), (5, "http:///en/")]
    pages = spark.createDataFrame(urls_, "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urls.result(pages, labels).collect()}
    assert got == {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("com/en/", "block"), 4: (None, "allow"), 5: (None, "allow")}
    assert time.time() - began < 120


def test_many_cells_are_fitted_as_few_are(spark, monkeypatch):
    rows = [(f"s{i}", f"l{j}", f"t{k}", 10 + (37 * i + 101 * j + 53 * k) % 400, 1) for i in range(5) for j in range(3) for k in range(4) if (i + j + k) % 7] + [("s0", "l0", "t9", 2, 1), ("s1", "l9", "t0", 0, 1)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, documents long")
    key = lambda r: (r.source, r.lang, r.topic)
    few = {key(r): (r.expected, r.off, r.probability) for r in mixing.calibrated(cells, mixing.POWERS).collect()}
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    many = {key(r): (r.expected, r.off, r.probability) for r in mixing.calibrated(cells, mixing.POWERS).collect()}
    assert few.keys() == many.keys() and all(np.allclose(few[k], many[k], atol=1e-6) for k in few)


def test_unmet_marginals_are_told(spark):
    """A source that is all of one language can't have half of all tokens while that language has a tenth."""
    cells = spark.createDataFrame([("a", "x", "t", 100, 1), ("b", "y", "t", 900, 1), ("b", "x", "t", 10, 1)], "source string, lang string, topic string, tokens long, documents long")
    wanted = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.1, "y": 0.9}, "topic": 1.0}
    got = mixing.calibrated(cells, wanted, 0.9).collect()
    assert max(r.off for r in got) > 0.1 and all(0 <= r.probability <= 1 for r in got)


def test_scarce_values_give_all_they_have(spark):
    rows = [(s, "x", t, n, 1) for s, t, n in [("a", "p", 5000), ("a", "q", 3), ("b", "p", 4000), ("b", "r", 2500), ("a", "r", 2500)]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, documents long")
    wanted = {"source": 1.0, "lang": 1.0, "topic": {"p": 0.5, "q": 0.1, "r": 0.4}}
    got = {(r.source, r.topic): r for r in mixing.calibrated(cells, wanted).collect()}
    assert got["a", "q"].probability > 0.99 and got["a", "q"].off > 0.9  # three tokens can't be a tenth
    expected = {k: r.probability * r.tokens for k, r in got.items()}
    total, p = sum(expected.values()), sum(v for k, v in expected.items() if k[1] == "p")
    assert abs(total / 14003 - 0.5) < 1e-3 and abs(p / (total - 3) - 5 / 9) < 1e-3


def test_quality_with_a_fitted_model(spark):
    good = [(i, f"Some plain sentence number {i} about a quiet garden. It rains today.", "en", "a", 60, 1.0) for i in range(60)]
    junk = [(1000 + i, "BUY!! NOW!! $$$ " * 5 + str(i), "en", "b", 90, 1.0) for i in range(60)]
    more = [(5, "Some plain sentence " * 30_000, None, None, None, 1.0), (None, None, None, None, None, 1.0), (2000, "", "", "", 0, 1.0), (2001, "BUY!! NOW!! $$$ " * 9, "en", "b", -5, 1.0), (2001, "BUY!! NOW!! $$$ " * 9, "en", "b", -5, 1.0)]
    docs = spark.createDataFrame(good + junk + more, "doc_id long, text string, lang string, source string, n_chars long, quality_score double")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good[:40] + junk[:40]] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(good) + len(junk) + len(more)
    assert all(0 <= r.quality_score <= 1 and r.accepted == (r.quality_score >= 0.3) for r in got)
    assert not any(r.accepted for r in got if r.doc_id == 2001) and sum(r.accepted for r in got if r.doc_id is not None and 40 <= r.doc_id < 60) >= 19
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 2001").count() == 0


def test_language_ties_repeats_and_long_texts(spark):
    rows = [(i, "aa bb", "xx" if i % 2 else "yy", 1) for i in range(40)] + [(0, "aa bb", "yy", 1)]  # both languages alike
    rows += [(500, "aa " * 200_000, None, 2), (500, "aa " * 200_000, None, 2), (501, "   ", None, 3)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, letters int")).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got if r.doc_id == 501] == ["und"]
    long = [(r.lang_pred, r.score) for r in got if r.doc_id == 500]
    assert len(long) == 2 and len(set(long)) == 1 and long[0][0] in ("xx", "yy")


def test_components_with_many_others_in_parts(spark):
    """A main component with postings of other ones in its lists, dealt to parts of two rows."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[:k] + [f"z{j}x{i}" for i in range(40 - k)]) for j, k in enumerate([40, 39, 38, 37, 36, 20, 20, 20, 10, 10, 5])] * 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in ngram_join.result(docs).collect()}
    sets = ngram_join.staged(ngram_join.shingle_sets(docs))
    names = {r["row"]: r["doc_id"] for r in sets.select("row", "doc_id").collect()}
    found = {names[r["node"]]: names[r["root"]] for r in ngram_join.components_of(sets, sets, 400, part_rows=2, main_rows=2).collect()}
    groups = lambda x: {frozenset(k for k in x if x[k] == v) for v in set(x.values())}
    assert groups({i: found.get(i, i) for i in range(len(texts))}) == groups(whole)


def test_batch_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with arrow_batches(spark, rows=7, size=1000):
        assert spark.conf.get(key) == "7"
        assert spark.range(20).select(F.sum("id")).first()[0] == 190
    assert spark.conf.get(key) == before
