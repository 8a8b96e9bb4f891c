"""What the plans must keep to at any size: filters and columns at the scan, joins without cross products, no Python."""

import pytest

from tessera import catalog


def plan(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "missing_targets")
    assert "EqualTo(l_returnflag,R)" in text and "LeftAnti" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text
    text = plan(spark, sf_dir, "existing_tiles")
    assert "GreaterThan(l_quantity,45.0)" in text and "LeftSemi" in text


@pytest.mark.parametrize(("name", "columns"), [("prune_sections", {"l_suppkey", "l_quantity"}), ("intensity_histogram", {"l_extendedprice"}), ("best_registration", {"l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber"}), ("acquisition_timings", {"event_id", "ts", "user_id", "event_type", "value"})])
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    schemas = [line for line in plan(spark, sf_dir, name).splitlines() if line.startswith("ReadSchema")]
    read = {c.split(":")[0] for s in schemas for c in s.split("struct<")[1].rstrip(">").split(",")}
    assert read == columns


#: Queries over XML and binary files, whose parsers and writers no expression can stand for: they run on Arrow batches.
FILES = {"elements_parsed", "saved_elements", "lost_stubs", "stack_headers", "stack_tiles", "stack_pixels", "exported_tiles", "viewer_sections"}


@pytest.mark.parametrize("name", sorted(FILES))
def test_files_are_parsed_in_batches_without_cross_products(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - FILES - {"stream_windows", "stream_sessions", "to_root_closure", "slice_to_volume", "root_closure_of_graph", "cascade_clean"}))
def test_no_python_and_no_cross_products(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "Python" not in text and "MapInPandas" not in text and "CartesianProduct" not in text
