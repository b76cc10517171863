"""What near-duplicates leave on disk: few edges made thousands of tasks and tables of hundreds of files, and no table of a step that was over went."""

import os
import re

from pyspark.sql import functions as F

from plainword.llm import components, shingle_join
from plainword.llm.common import shared_dir


def tables(spark):
    at = shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(at) if re.search(r"-[0-9a-f]{32}$", x)} if os.path.isdir(at) else set()


def test_few_edges_are_one_task_and_one_table(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10] + [(7, 3), (5, 5)], "u long, v long").repartition(4)
    before = tables(spark)
    got = components.components(edges)
    assert len(tables(spark) - before) == 1
    assert len(got.inputFiles()) == 1
    monkeypatch.setattr(components, "FEW", 0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(components.components(edges)) and got.count() == 36


def test_keep_one_leaves_what_it_reads(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[i % 3 :] + [str(i // 3)])) for i in range(12)] + [(20, "alone"), (21, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    before = tables(spark)
    got = shingle_join.keep_one(df)
    left = {x.rpartition("-")[0] for x in tables(spark) - before}
    assert left <= {"shingle-prints", "shingle-heads", "shingle-counts"}
    assert got.agg(F.min("doc_id")).first()[0] == 0
