"""Names that are equally common on one floor at one elevation."""

from ashlar.operators import rules, summaries


def test_the_first_name_labels_a_floor(spark):
    for names in (["b", "a", "c"], ["Supplier#000000838", "Supplier#000000423"], [f"s{i}" for i in range(20)]):
        rows = spark.createDataFrame([("m", n, 5.0, f"g{n}") for n in names], "model_name string, storey_name string, elevation_mm double, storey_guid string")
        label = summaries.floor_labels(summaries.cluster_elevations(rows)).first()
        assert (label.most_common, label.n) == (min(names), len(names))
        own = rules.federated_floors(rows, rule=lambda c: c.most_common_name)
        assert {r.label for r in own.collect()} == {min(names)}
