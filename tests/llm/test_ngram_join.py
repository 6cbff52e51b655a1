"""The n-gram join where frequent lists are split, against brute force."""

from __future__ import annotations

from itertools import combinations

import pytest

from umbra.llm import ngram_join
from umbra.llm.common import staged


def brute_roots(sets: dict[int, set], num: int = 4, den: int = 5) -> dict[int, int]:
    root = {r: r for r in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {r: low if x == high else x for r, x in root.items()}
    return root


@pytest.mark.parametrize("part_rows", [1, 2, 50])
def test_parts_of_frequent_lists_lose_no_link(spark, part_rows):
    texts = [" ".join(f"w{g}x{i}" for i in range(40)) + f" end{k}" for g in range(25) for k in range(2 + (g % 3 == 0))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = staged(ngram_join.shingle_sets(docs))
    # lists of two or three rows, which a split leaves alone in their parts
    got = {r["node"]: r["root"] for r in ngram_join.components_of(sets, sets, 10**6, part_rows=part_rows, main_rows=part_rows).collect()}
    rows = {r["row"]: r["doc_id"] for r in sets.select("row", "doc_id").collect()}
    words = {row: texts[i].split() for row, i in rows.items()}
    want = brute_roots({row: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for row, w in words.items()})
    assert {row: got.get(row, row) for row in want} == want
    assert len(set(want.values())) == 25


def test_stage_keeps_every_group_when_ids_are_null_or_repeat(spark):
    text = lambda g, end="": " ".join(f"w{g}x{i}" for i in range(40)) + end
    rows = [
        (None, text("a")), (None, text("a", " z")), (None, text("b")), (None, text("c")),  # three groups without ids
        (7, text("d")), (7, text("e")),  # two texts of one id
        (3, text("f")), (8, text("f", " z")), (8, text("g")),  # 8 goes once and stays once
        (9, text("h")), (9, text("h")),  # equal rows
        (None, ""), (None, None), (4, " "), (4, " "),  # without words
    ]
    got = ngram_join.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    full = sorted((r.doc_id or 0, r.text.split()[0]) for r in got if r.text and r.text.strip())
    assert full == [(0, "wax0"), (0, "wbx0"), (0, "wcx0"), (3, "wfx0"), (7, "wdx0"), (7, "wex0"), (8, "wgx0"), (9, "whx0")]
    assert len(got) - len(full) == 4
