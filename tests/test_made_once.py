from riskweave.operators import order


def test_rows_are_made_once_before_they_are_dealt(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(1000, numPartitions=4).mapInArrow(count, "id long")
    got = order.numbered(rows, ["id"], "place").collect()
    assert sorted((r["id"], r["place"]) for r in got) == [(i, i + 1) for i in range(1000)] and made.value == 1000
