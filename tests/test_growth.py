"""Matches and keywords in one search."""

import re

import pytest
from pyspark.sql import functions as F

from riskweave.functions import columns, rules
from riskweave.operators.matches import FEW, found_in


@pytest.mark.parametrize("text", ["a 12 3", "x12y\n\n12 1", "12\n12", "1212\n1 12", "1\n2\n3\n4\n5\n6 😀\n7", "𝔘\n\n 44", "111 11\n1"])
def test_places_of_few_matches(spark, text):
    """A value that stands elsewhere too, or in part of a longer number, doesn't give its match's place."""
    pattern = r"(?<!\d)\d{1,2}(?!\d)"
    want = [(m[0], text.count("\n", 0, m.start()) + 1, m.start()) for m in re.finditer(pattern, text)]
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(F.expr(found_in("text", "n", pattern))).alias("m")).select("m.*").collect()
    assert [(r["value"], r["line"], r["at"]) for r in rows] == want and FEW < 7


def test_lone_match_needs_no_second_search():
    sql = found_in("text", "n", "some pattern")
    head = sql[: sql.index("regexp_replace")]
    assert head.count("some pattern") == 1 and "locate(" in head


@pytest.mark.parametrize("kind", sorted(rules.KEYWORDS))
def test_keyword_of_near_lines(spark, kind):
    words = [*rules.KEYWORDS[kind], "xmail", "none", "Σ", "E-Mail.", "zip2"]
    near = ["\n".join(words[i % len(words)].upper() + " " + words[(i * j + j) % len(words)] for i in range(k, k + 4)) for k in range(len(words)) for j in (1, 2, 3)]
    each = F.expr(f"get(filter(transform(split(t, '\\n', -1), l -> {columns.keyword_sql('l', kind)}), h -> h IS NOT NULL), 0)")
    rows = spark.createDataFrame([(t,) for t in near], "t string").select(each.alias("a"), F.expr(columns.keyword_near_sql("lower(t)", kind)).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and any(r["a"] for r in rows)
