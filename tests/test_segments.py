"""Segments of merged meshes are worked out without moving the meshes."""

from ashlar.operators import meshes
from ashlar.plans import shape_model


def test_segments_of_sizes_are_those_of_merged_meshes(spark):
    t = shape_model.tables(spark, "/root/testdata/sf0.001")
    whole = meshes.segments(meshes.merged(meshes.product_meshes(t, "local")))
    sized = meshes.sized_fragments(t)
    assert not {"vertices", "indices"} & set(sized.columns)
    assert sorted(tuple(r) for r in meshes.segments_of(sized).collect()) == sorted(tuple(r) for r in whole.collect())
