"""Terms are counted over all texts before they meet the terms asked for."""

from umbra.llm.common import staged
from umbra.llm.pii import document_frequency


def test_terms_are_counted_before_the_join(spark):
    texts = spark.createDataFrame([(0, "alpha beta alpha"), (1, "beta gamma"), (2, "beta")], "row long, text string")
    terms = spark.createDataFrame([("alpha",), ("beta",), ("delta",)], "term string")
    found = document_frequency(texts, staged(terms))
    assert {tuple(r) for r in found.select("term", "documents").collect()} == {("alpha", 1), ("beta", 3)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
