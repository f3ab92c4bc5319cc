"""Files are few bytes and much work: how they get to tasks."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur.operators import dealing, features, model, rules


@pytest.mark.parametrize("analyse", [rules.with_facts, features.with_counts])
def test_the_files_of_one_partition_are_dealt_evenly_to_all_cores(spark, analyse):
    n = 400
    text = F.concat(F.lit("import socket\nx = "), F.col("id").cast("string"))
    one = spark.range(0, n, 1, 1).select(F.col("id").cast("string").alias("file_id"), F.lit("a.py").alias("file_path"), text.alias("content"))
    rows = analyse(one).select("file_id", F.size("facts").alias("n"), F.spark_partition_id().alias("part")).collect()
    assert sorted(int(r.file_id) for r in rows) == list(range(n)) and all(r.n for r in rows)
    cores, dealt = spark.sparkContext.defaultParallelism, [r.part for r in rows]
    assert len(set(dealt)) >= cores
    assert max(map(dealt.count, set(dealt))) <= 2 * n / cores

@pytest.mark.parametrize("name", ["findings", "archive_counts", "exclude_codes", "include_codes", "min_confidence", "topk_rules", "missing_files"])
def test_the_query_deals_its_files_before_the_analysis(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    analyses = plan.count("MapInArrow")
    tasks = [int(n) for n in re.findall(r"MapInArrow[^\n]*\n(?:[^\n]*Project[^\n]*\n)*[^\n]*Exchange RoundRobinPartitioning\((\d+)\)", plan)]
    assert analyses and len(tasks) == analyses and min(tasks) >= dealing.TASKS * spark.sparkContext.defaultParallelism


def test_maps_come_to_python_a_few_at_a_time(spark):
    class Counting:
        def raw_of_records(self, records):
            if len(records) > 256:
                raise ValueError(f"{len(records)} maps at a time")
            return np.zeros(len(records))

    one = spark.range(0, 2_000, 1, 1).select("id", F.create_map(F.lit("a"), F.lit(1.0)).alias("features"))
    rows = model.with_score(one, Counting()).collect()
    assert sorted(r.id for r in rows) == list(range(2_000)) and {r.score for r in rows} == {0.5}


def test_slices_are_all_rows_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], names=["n"]) for a, b in ((0, 0), (0, 700), (700, 701))]
    got = list(dealing.slices(iter(batches)))
    assert max(b.num_rows for b in got) <= 256
    assert [n for b in got for n in b.column(0).to_pylist()] == list(range(701))
