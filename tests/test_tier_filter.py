from riskweave.operators import pii
from riskweave.sources import tree


def test_filter_by_tier_searches_nothing_again(spark):
    """Spark moves a filter by tier down and repeats what the tier is made of; that must be plain columns."""
    rows = pii.tiered(tree.named(spark.createDataFrame([("a.py", "cpf\n529.982.247-25")], "path string, text string"))).where("tier = 'high'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "RLIKE" not in above and "tax_id" not in above and rows.count() == 1
