"""Language identification where most words are too rare to go to the tasks."""

from __future__ import annotations

from umbra.llm import langid


def test_rare_words_stay_known(spark):
    rows = [(i, f"same words here {'orbel' if lang == 'en' else 'zanti'}{i}q", lang) for i in range(60) for lang in ["en" if i % 2 else "de"]]
    rows += [(1000 + i, f"same words here {r[1].split()[-1]}", None) for i, r in enumerate(rows)]  # not learned from
    rows += [(2000, "same orbel999q", None), (2001, "zanti999q", None), (2002, "ÿÿÿ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_ = ({r.doc_id: (r.lang_pred, round(r.score, 4)) for r in langid.identify(docs, most_words=x).collect()} for x in (3, 10**6))
    assert few == all_ and len(few) == len(rows)
    assert few[2000][0] == "en" and few[2001][0] == "de"
    assert all(few[1000 + i][0] == r[2] for i, r in enumerate(rows[:60]))
