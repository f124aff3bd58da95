"""Questions beside pages: what depends on one side alone stays below the join."""

import pytest

from gleaner import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rk12_rule_evidence", "an1_extractive_answers", "an5_support_ratios", "an6_numeric_repairs", "an7_best_sentences", "an8_confidence"])
def test_pages_are_tokenised_before_the_join(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join ")]
    assert "regexp_extract_all" not in above and "split(" not in above
