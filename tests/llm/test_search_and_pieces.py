"""Piece encoding against the library, ranked search and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm import hard_negatives, lexical, pieces
from umbra.llm.ball_tree import BallTree, Best
from umbra.llm.rtree import NO_ID, NONE, RTree, Search, tiles

TEXTS = ["", " ", "a", "  a  b ", "▁a", "hello\nworld", "\ta", "Ａｂ", "<s></s><0x41>", "\x00", "a\r\nb", "日本語", "🙂🙂", "a" * 3000, "ab" * 2000, " " * 700, "\n" * 50, "Ünïcode café naïve"]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece

    return pieces.Pieces(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def packed(library, text: str) -> bytes:
    return np.array(library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


def test_pieces_agree_with_the_library(model):
    own, library = model
    some = random.Random(7)
    made = ["".join(some.choice("aabcdehinorst  .,\n\t<>/01_-éèñ▁日🙂=()") for _ in range(some.randrange(40))) for _ in range(3000)]
    joined = ["".join(some.choice(own.names[259:]) for _ in range(some.randrange(15))) for _ in range(1000)]
    texts = TEXTS + made + joined
    assert own.encode(texts) == [packed(library, t) for t in texts]
    assert all(own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist()) for ids in own.encode(texts))


def test_any_ids_decode_as_the_library_does(model):
    own, library = model
    some = random.Random(8)
    for _ in range(2000):
        ids = [some.randrange(3, 259) if some.random() < 0.5 else some.randrange(len(own.names)) for _ in range(some.randrange(12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_one_word_and_many_words_split_alike(text):
    own = _own()
    assert own.encode([text, text + " x"])[0] == own.begin.to_bytes(4, "little") + b"".join(own._packed(p) for p in own.parts("▁" + text.replace(" ", "▁")) if text) + own.end.to_bytes(4, "little")


def _own(kept=[]):  # noqa: B006
    if not kept:
        kept.append(pieces.Pieces())
    return kept[0]


def test_tables_follow_the_definition():
    own = _own()
    for word in ("▁international", "aaaaaaa", "▁▁▁▁▁x", "Straße", "www", "ééé"):
        assert [own._name(t) for t in own.tokens(word)] == own.merged(word)


def test_pieces_result(spark, model):
    own, library = model
    rows = [(i, t, 9) for i, t in enumerate(TEXTS)] + [(50, None, 1), (None, "x", 1), (50, None, 1), (51, "w " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = pieces.result(docs).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())] += 1
    assert Counter(map(tuple, got)) == want
    assert pieces.result(docs.limit(0)).count() == 0
    assert [r.text for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()] == [""]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """The contract in plain Python."""
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    number, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            n = sum(bag.values())
            m = 100 - 90 + (90 * n * number) // length if length else 0
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t]
            )
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def test_search_against_plain_python(spark):
    some = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "ÀB", "x2"]
    text = lambda n: some.choice([" ", "-", "\n"]).join(words[min(int(some.expovariate(0.07)), 63)].swapcase() if some.random() < 0.2 else words[min(int(some.expovariate(0.07)), 63)] for _ in range(n))
    docs = [(i, text(some.randrange(1, 40))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(1001, docs[5][1])] * 2 + [(None, docs[5][1]), (2000, None), (2001, ""), (2002, "--- ..."), (2003, "w1 " * 60_000)]
    items = [(i, text(12)) for i in range(25)] + [(3, docs[5][1]), (3, docs[5][1]), (None, "w1"), (90, None), (91, "!!"), (92, "nowhere")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score long")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    want = ranked(docs, items)
    for options in ({}, {"tree_rows": 50, "leaf": 4, "block_items": 7}):
        assert Counter(map(tuple, lexical.search(d, i, **options).collect())) == want
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0


def test_trees_prune_and_lose_nothing():
    some = np.random.default_rng(0)
    groups = [some.choice(400, 12, replace=False) for _ in range(20)]
    rows = [np.unique(some.choice(groups[i % 20], 9)) for i in range(2000)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms, values = np.concatenate(rows), some.integers(1, 1_000_000, starts[-1])
    tree, met = BallTree(starts, terms, values, 16), 0
    for group in groups:
        best, names, weights = Best(10), np.sort(group), np.full(len(group), 3)
        met += tree.search(names, weights, list(range(2000)), best)
        scores = np.array([3 * values[a:b][np.isin(terms[a:b], names)].sum() for a, b in zip(starts, starts[1:])])
        order = np.lexsort((np.arange(2000), -scores))[:10]
        assert sorted(best.rows(), key=lambda x: (-x[0], x[1])) == [(int(scores[i]), int(i)) for i in order]
        bounds = tree.bounds(np.searchsorted(tree.names, names), weights)
        assert all(bounds[node] >= scores[tree.order[a:b]].max() for node, (a, b, _, _) in enumerate(tree.nodes))
    assert met < 20 * sum(left < 0 for *_, left, _ in tree.nodes) / 2


def mined(rows):
    """The contract in plain Python; equal rows count once."""
    good = {}
    for i, vec, label in rows:
        if i is not None and vec and label is not None and all(x is not None and math.isfinite(x) for x in vec):
            good[i, tuple(vec), label] = (i, [math.floor(256 * float(np.float32(x))) for x in vec], (label + 1) % 10 if i % 7 == 0 else label)
    rows, out = list(good.values()), []
    for a, x, label in rows:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, own == label) for i, y, own in rows if i != a and len(y) == len(x))
        for far, p, _ in [s for s in scored if s[2]][:5]:
            window = [(f, i) for f, i, same in scored if not same and 50 * -far <= 100 * -f <= 95 * -far]
            out += [(a, p, r, i, -far, -f) for r, (f, i) in enumerate(window[:3], 1)]
    return Counter(out)


def test_hard_negatives_against_plain_python(spark):
    some = np.random.default_rng(5)
    centres = some.normal(size=(10, 8))
    rows = [(i, (centres[i % 10] * 0.3 + some.normal(size=8) * 0.25).tolist(), i % 10) for i in range(900)]
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 3) for i in range(300)] + [rows[50], rows[50]]
    rows += [(1500, None, 1), (1501, [1.0] * 8, None), (1502, [float("nan")] * 8, 1), (1503, [None] * 8, 1), (None, [1.0] * 8, 1), (1550, [0.5] * 3, 2), (1551, [0.4] * 3, 2), (1552, [0.3] * 3, 4), (1600, [0.0] * 8, 5), (1650, [], 1), (1700, [math.inf] * 8, 1)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, rank int")
    want = mined(rows)
    for options in ({}, {"shards": 3, "page": 70, "leaf": 5, "wave": 5}):
        assert Counter(map(tuple, hard_negatives.mine(frame, **options).collect())) == want
    assert hard_negatives.mine(frame.limit(0)).count() == 0


def test_huge_components_do_not_crash(spark):
    frame = spark.createDataFrame([(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e299, 2.0], 2), (50, [1.0, 1.0], 1), (51, [0.5, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert all(r.positive_score > 0 for r in hard_negatives.mine(frame).collect())


def test_boxes_hold_all_products_and_prune():
    some = np.random.default_rng(1)
    x = np.floor(some.normal(size=(3000, 6)) * 256)
    labels, ids = some.integers(0, 4, 3000), some.permutation(3000)
    assert sorted(np.concatenate(tiles(x, 20)).tolist()) == list(range(3000)) and max(map(len, tiles(x, 20))) <= 20
    tree = RTree(x, labels, ids, 16)
    q = np.floor(some.normal(size=(40, 6)) * 256)
    low, high = np.full((40, 1), NONE + 1), np.full((40, 1), NO_ID - 1)
    search = Search(q, some.integers(0, 4, 40), np.full(40, -1), low, high, 3, False)
    least, most = search._intervals(tree, np.arange(40), slice(0, len(tree.low)))
    for leaf, (a, b) in enumerate(tree.span):
        scores = q @ tree.x[a:b].T
        assert (scores.min(axis=1) >= least[:, leaf]).all() and (scores.max(axis=1) <= most[:, leaf]).all()
    opened = []
    whole = Search._leaf
    try:
        Search._leaf = lambda self, t, queries, box: (opened.append(len(queries)), whole(self, t, queries, box))[1]
        search.page(tree)
    finally:
        Search._leaf = whole
    assert sum(opened) < 40 * tree.leaves / 2
