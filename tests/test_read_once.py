"""A result or a skeleton is read once a row, however many of its fields are shown."""

from quire import registry

FOLDER = "/root/testdata/sf0.001"


def reads(spark, name, what):
    """How often the optimized plan of a query reads JSON."""
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    return plan.count(what)


def test_artifacts(spark):
    assert reads(spark, "n11_artifact_rows", "parseJson") == 1


def test_flattened_results(spark):
    assert reads(spark, "n7_flattened_result", "parseJson") == reads(spark, "n7_results_without_facets", "parseJson") == 1


def test_facet_values(spark):
    assert reads(spark, "x1_facet_values", "parseJson") == 1


def test_whole_skeleton(spark):
    assert reads(spark, "n5_whole_skeleton", "json_tuple") == 1


def test_patches_in_order(spark):
    """The metadata and every body once."""
    for name in ("m2_json_patches_in_order", "m2_json_patch", "m4_json_puts_in_order", "m4_json_merge_put"):
        assert reads(spark, name, "from_json(MapType") + reads(spark, name, "from_json(ArrayType(MapType") == 2, name
