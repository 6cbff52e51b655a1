"""The training-data operators on small fixtures, held against brute force.

Fixtures have nulls in any column, empty and very long texts, ties, repeated rows and extra columns
whose names clash with the operators' own.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import ann, attention, components, dedup, graph_index, langid, lm, mixing, ngram_join, packing, pii, quality, urls
from umbra.llm.subwords import encoder, packed_encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size int, kept string, token string, digest string, hash long, tokens int, topic string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong green tea near old stone bridges".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1) + i * i * seed) % len(WORDS)] + str((seed * i) % 9) for i in range(n))


def long_text() -> str:
    return " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


ROWS = [
    (1, sentence(1, 40), "en", "a", 200),
    (2, sentence(1, 40).replace(" ", "\t\n"), "en", "a", None),
    (3, sentence(1, 40), "en", None, 200),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, "   \n", "fr", "b", 4),
    (7, "word", "fr", "b", 4),
    (8, "Word", "fr", "a", 4),
    (9, sentence(2, 60), "en", "c", 300),
    (9, sentence(2, 60), "en", "c", 300),
    (10, sentence(2, 60) + " zzz", "en", "c", 304),
    (11, long_text(), "en", "c", 9),
    (12, long_text() + " tail end", "en", "c", 9),
    (None, sentence(3, 30), "de", "a", 100),
    (14, "né à l'été — ça va, 12 €", None, "d", 20),
    (15, sentence(4, 5), "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 7, "x", "x", "x", 7, 7, "x") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# exact dedup


def test_exact_dedup_against_brute_force(docs):
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    got = dedup.result(docs).collect()
    assert len(got) == len(ROWS)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    for row in got:
        group = by_digest[row.text_sha256]
        assert row.group_size == len(group)
        assert row.keep_id == (None if group[0][1] else group[0][2])
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_hot_group_and_stage(spark, docs, nothing):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("same"), F.repeat(F.lit(" "), F.lit(2)))).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = dedup.result(many)
    assert got.where("kept").count() == 1001
    assert got.agg(F.max("group_size")).first()[0] == 2000
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"\s", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", r[1] or "") for r in ROWS})
    assert dedup.result(nothing).count() == 0 and dedup.drop_copies(nothing).count() == 0


# packing


def test_packing_round_trip(docs):
    pieces = packing.pack(docs, size=64, windows=4, with_ids=True).collect()
    encode = encoder()
    want = Counter()
    for doc_id, text, *_ in ROWS:
        want[doc_id, tuple([*encode(text or ""), 0])] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length > 0
        by_doc[p.doc_id, p.doc_tokens].append((p.start, p.ids))
        sequences[p.sequence_id].append((p.offset, p.length))
    for (doc_id, total), parts in by_doc.items():
        copies = sum(n for (d, ids), n in want.items() if d == doc_id and len(ids) == total)
        covered = Counter()
        for start, ids in parts:
            covered.update(range(start, start + len(ids) // 4))
        assert covered == Counter({i: copies for i in range(total)})
        if copies == 1:
            ids = np.frombuffer(b"".join(x for _, x in sorted(parts)), "<u4")
            assert (doc_id, tuple(ids.tolist())) in want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


def test_packing_pads_little_and_takes_nothing(docs, nothing):
    one = packing.padding(packing.pack(docs, size=256, windows=8), 256).first()
    assert one.padding < 0.05
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \n b", "x \n", " lead", "tail ", "tab\t x", "a b", "日本 語 text", "don't  stop <|endoftext|> 12 345", "<|endoftext|><|endoftext|>x  <|endoftext", " <|endoftext|> ", "\n\n a", "a\r\n b  ", "😀 😀"])
def test_packed_encoder_equals_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packed_encoder()(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


# n-gram join


def brute_sets(rows, width=5):
    out = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)})
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    return sets, {i: min((rows[m][0] for m in ms if rows[m][0] is not None), default=None) for ms in members.values() for i in ms}


def compare_components(spark_rows, rows):
    sets, component = brute_components(rows)
    want = Counter((r[0], len(s), component[i]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in spark_rows) == want


def test_ngram_join_against_brute_force(docs, nothing):
    compare_components(ngram_join.result(docs).collect(), ROWS)
    assert ngram_join.result(nothing).count() == 0


def test_ngram_join_chains_and_dense_groups(spark):
    """Near copies of one text with random edits: many just above or below the threshold, linked by chains."""
    random = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in random.choice(60, random.integers(0, 4), replace=False):
            words[at] = f"e{random.integers(0, 40)}"
        rows.append((i, " ".join(words[: random.integers(52, 61)])))
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(20)) + " shared passage that is found in very many of the texts here") for i in range(40)]
    compare_components(ngram_join.result(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_ngram_join_stage_keeps_one_of_each_group(docs):
    kept = [r.doc_id for r in ngram_join.drop_similar(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4, 5, 6, 7, 9, 11, 14, 15]
    assert len(kept) == 10


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    assert got.count() == 201 and got.where("root <> 0").count() == 0
    assert components.components(links.limit(0)).count() == 0


# nearest neighbours


def test_graph_search_against_brute_force(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(1500, 16)).astype(np.float32)
    x[700:1100] = x[3]  # a common vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [None] * 16, 1), (None, [1.0] * 16, 1), (5200, [], 1), (5250, [1.0, 2.0], 1)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int"), shard_rows=400).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits, by_query = 0, defaultdict(list)
    for r in got:
        by_query[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(by_query) == set(range(0, 1500, 50))
    for q, found in by_query.items():
        score = np.round(unit @ unit[q], 12)
        score[q] = -2
        want = np.lexsort((np.arange(1500), -score))[:5]
        found = sorted(found)
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(unit[q] @ unit[f[1]] - f[2]) < 1e-9 for f in found)
        hits += len({f[1] for f in found} & set(want.tolist()))
    assert hits / (5 * len(by_query)) >= 0.9
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rep int")).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_reaches_every_node():
    x = graph_index.unit(np.repeat(np.random.default_rng(1).normal(size=(40, 8)), 10, axis=0) + 1e-5 * np.random.default_rng(2).normal(size=(400, 8)))
    edges, entry = graph_index.build(x, degree=6, beam=12)
    met, front = {entry}, [entry]
    while front:
        front = [n for f in front for n in set(edges[f].tolist()) - met - {-1} if not met.add(n)]
    assert len(met) == 400


# language-model scores


def test_lm_base_score_against_brute_force(docs, nothing):
    texts = [(d, [*(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()), b""]) for d, t, *_ in ROWS]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for d, ws in texts if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, held(d), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in texts)
    for frequent in (1e-6, 0.01):  # all words known to the tasks, or most looked up by the join
        got = lm.scores(docs, frequent=frequent, learners=2, rounds=1).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.scores(nothing).count() == 0


def test_attention_learns_and_is_a_distribution():
    words = attention.Vocabulary.of(np.array([50.0, 40, 30, 20, 10, 5, 3, 1]), at_once=3, size=2, own=6, shared=2)
    text = np.array([0, 1, 2, 5] * 60)
    x, goal, _ = attention.windows([text] * 8, words)
    start = attention.initial(words, 8)
    learned = attention.train(start, words, 8, [(x, goal)], least_steps=150)
    before, after = (attention.Scorer(f, words, 8).log_probabilities(x, goal).sum() for f in (start, learned))
    assert after > before / 2
    prefix = np.array([0, 1, 2])
    total = 0.0
    for token in range(8):
        x, goal, _ = attention.windows([np.append(prefix, token)], words)
        total += math.exp(attention.Scorer(learned, words, 8).log_probabilities(x, goal)[0, 3])
    assert abs(total - 1) < 1e-4


def test_attention_gradient():
    random = np.random.default_rng(0)
    words = attention.Vocabulary.of(random.integers(0, 100, 300).astype(float), at_once=4, size=7, own=20, shared=10)
    p = attention.unflat(attention.initial(words, 8).astype(np.float64), words, 8)
    x, goal, _ = attention.windows([random.integers(0, 300, n) for n in (50, 1, 17)], words)
    _, slope = attention.gradient(p, words, x, goal)
    for name, values in p.items():
        at = (x[0, -1], 3) if name == "embed" else tuple(s // 2 for s in values.shape)
        kept, losses = values[at], []
        for step in (1e-5, -1e-5):
            values[at] = kept + step
            losses.append(attention.gradient(p, words, x, goal)[0])
        values[at] = kept
        assert abs((losses[0] - losses[1]) / 2e-5 - slope[name][at]) < 1e-6


def test_scores_do_not_look_ahead():
    words = attention.Vocabulary.of(np.arange(50.0, 0, -1), at_once=4, size=7, own=20, shared=10)
    model = attention.Scorer(attention.initial(words, 8), words, 8)
    a = np.arange(45) % 50
    b = a.copy()
    b[30:] = (b[30:] + 7) % 50
    one, two = (model.log_probabilities(*attention.windows([t], words)[:2]).ravel() for t in (a, b))
    assert np.allclose(one[:30], two[:30], atol=1e-5) and not np.allclose(one[30:45], two[30:45], atol=1e-5)


# language identification


def test_language_id(spark, nothing):
    samples = {"en": "the house and the garden were quiet that morning", "de": "der garten und das haus waren an diesem morgen ruhig", "fr": "la maison et le jardin étaient calmes ce matin"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang) for i in range(120) for lang, t in [list(samples.items())[i % 3]]]
    rows += [(900, None, "en"), (901, "12 34 !!", "en"), (902, "", None), (903, "gardens mornings", None), (None, "das haus", None), (905, "jardins maisons", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == list(samples)[i % 3] and 0 < got[i].score <= 1 for i in range(120))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "en" and got[None].lang_pred == "de" and got[905].lang_pred == "fr"
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


# quality


def test_quality_learns_from_text(spark, docs, nothing):
    good = [(i, sentence(i, 30) + ".", "en", "a", 150) for i in range(200)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(i, 30).split()), "en", "a", 200) for i in range(200)]
    table = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good[:60] + junk[:60]] + [(None, 1, 0), (5, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.classify(table, labels).collect()
    assert sum(r.accepted == (r.doc_id < 1000) for r in scored) >= 0.98 * len(scored) and len(scored) == 400
    assert quality.classify(docs, labels.limit(0)).where("accepted and quality_score = 0.5").count() == len(ROWS)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert quality.classify(nothing, labels).count() == 0


# mixing


def test_raking_fits_all_marginals(spark):
    rows = [(s, l, t, float(1 + 3 * i + 7 * j + 2 * k)) for i, s in enumerate("abc") for j, l in enumerate("xy") for k, t in enumerate("pq")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    wanted = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": 0.5}
    got = mixing.rake(cells, wanted, tolerance=1e-6).toPandas()
    w, total = {(r[0], r[1], r[2]): r[3] for r in rows}, sum(r[3] for r in rows)
    topic = {t: sum(v for k, v in w.items() if k[2] == t) ** 0.5 for t in "pq"}
    goals = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.6, "y": 0.4}, {t: v / sum(topic.values()) for t, v in topic.items()}]
    for _ in range(200):  # brute force
        for d, goal in enumerate(goals):
            sums = defaultdict(float)
            for k, v in w.items():
                sums[k[d]] += v
            w = {k: v * goal[k[d]] * total / sums[k[d]] for k, v in w.items()}
    assert all(abs(r.weight - w[r.source, r.lang, r.topic]) < 1e-3 * total for r in got.itertuples())


def test_mixing_probabilities_and_sample(spark, docs, nothing):
    many = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"), F.concat_ws(" ", F.lit("several words about something"), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
    )
    rows = mixing.result(many).cache()
    assert rows.count() == 4000 and rows.where("probability > 1 or probability < 0").count() == 0
    table = rows.toPandas()
    table["expected"] = table.probability * table.tokens
    share = table.expected.sum() / table.tokens.sum()
    for dimension, power in mixing.POWERS.items():
        seen = table.groupby(dimension).tokens.sum()
        goal = seen**power / (seen**power).sum()
        got = table.groupby(dimension).expected.sum() / table.expected.sum()
        assert (abs(got / goal - 1) < 0.01).all()
        assert share <= max(0.5, (seen / (goal * seen.sum())).min()) + 1e-3  # no value gives more tokens than it has
    assert 0.5 <= share + 1e-3 and share <= 0.9 and (table.off <= 1e-3).all()
    assert abs(table[table.kept].tokens.sum() / table.tokens.sum() - share) < 0.03
    assert mixing.result(docs).count() == len(ROWS) and mixing.result(nothing).count() == 0
    sample = mixing.sampled(docs)
    assert sample.columns == docs.columns and {4, 5, 6} <= {r.doc_id for r in sample.collect()}


# urls


def test_url_parts_rules_and_reputation(spark):
    pages = [
        (1, "http://A.Example.com/en/7x?q"), (2, "https://example.com/en/8"), (3, "ftp://x.net/de/1#f"), (4, "no scheme/com/en/"), (5, None), (6, "http://notcom/en/"),
        (7, "http://b.example.net/de/8"), (8, "//?http://spam.org/es"), (9, "http://bad.io/a"), (10, "http://good.io/a"), (10, "http://good.io/a"), (11, ""), (12, "http://sub.bad.io?x"),
    ]
    many = [(100 + i, f"http://bad.io/{i}") for i in range(60)] + [(200 + i, f"http://good.io/{i}") for i in range(60)]
    frame = spark.createDataFrame([(*p, "x") for p in pages + many], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, int(i == 0), 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(None, 0, 0), (3, None, 0), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.result(frame, labels).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict) == ("com/en/", "block")
    assert (got[3].host, got[3].path, got[3].rule) == ("x.net", "/de/1", "net/de/")
    assert (got[4].host, got[4].path, got[4].rule) == ("", "", None) and (got[5].host, got[5].path) == ("", "")
    assert (got[6].host, got[6].rule) == ("notcom", None)
    assert got[7].rule == "example.net/de/8"
    assert (got[8].host, got[8].path, got[8].verdict) == ("spam.org", "/es", "allow")
    assert got[9].verdict == "block" and got[10].verdict == "allow"
    assert (got[12].host, got[12].path) == ("sub.bad.io", "")
    assert urls.result(frame, labels).count() == len(pages) + len(many)
    assert urls.result(frame.limit(0), labels).count() == 0
    assert urls.result(frame, labels.limit(0)).where("verdict = 'block' and rule is null").count() == 0


# personal data

TRICKY = [
    "a@b.com_x@c.org, me.you+z@mail-1.example.co.uk. x@y no@dot", "1.2.3.4.5.6.7.8 and 300.1.1.1 then 010.000.255.1 0.0.0.0", "4111 1111 1111 1111, 4111-1111-1111-1112; 1234567890123456789012",
    "+1 (386) 555-3733 or +49.30.1234567- +12", "é😀 a@b.cd 😀 10.0.0.1", "", None, "9" * 5000, "a" * 5000 + "@" + "b" * 50, "+1 2 3 4 5 6 7 8 9 a@b.c 4111111111111111",
]


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    def ok_card(d):
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: ok_card(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, pattern, ok in kinds for m in re.finditer(pattern, text) if ok(m[0])]


def test_base_spans_against_brute_force(spark, nothing):
    rows = [(i, t, 1, "x") for i, t in enumerate(TRICKY)] + [(0, TRICKY[0], 1, "x")]
    got = pii.result(spark.createDataFrame(rows, "doc_id long, text string, row int, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_spans(TRICKY[r.doc_id] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and r.spans == written
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in ("email", "ip", "card", "phone")]
    assert pii.result(nothing).count() == 0


def test_terms_that_disclose_an_entity_are_found_and_removed(spark):
    rows = [(i, f"note {i} on {sentence(i, 4)}: Zorbla writes from z@corp.example often") for i in range(5)]
    rows += [(10, "Zorbla alone, and zorbla9 not"), (11, None)] + [(20 + i, sentence(i, 30) + " often writes note from") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.result(table).collect()}
    assert got[10].spans == "term:0:6" and got[20].spans == "" and "term:" in got[0].spans and got[0].n_email == 1
    clean = {r.doc_id: r.text for r in pii.sanitised(table).collect()}
    assert clean[10] == " alone, and zorbla9 not" and clean[11] == "" and clean[20] == rows[7][1]
    assert "[EMAIL]" in clean[0] and "Zorbla" not in clean[0]


def test_copies_alone_prove_nothing(spark):
    rows = [(i, "the same text with Quibble near q@corp.example here") for i in range(50)] + [(100 + i, sentence(i, 20)) for i in range(50)]
    assert pii.result(spark.createDataFrame(rows, "doc_id long, text string")).where("spans like '%term%'").count() == 0
