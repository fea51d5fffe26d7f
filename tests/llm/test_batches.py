"""Texts go to Python workers in batches of bounded bytes."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineloom.llm import jaccard_join
from lineloom.llm.common import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(docs) -> list[int]:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    return [r["n"] for r in docs.mapInArrow(run, "n long").collect()]


@pytest.fixture
def unset(spark):
    had = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)
    if had is not None:
        spark.conf.set(KEY, had)


def test_set_join_bounds_its_batches(spark, unset):
    docs = spark.range(2000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", (F.col("id") / 2).cast("long"), F.repeat(F.lit("word and "), 700)).alias("text"))
    assert jaccard_join.one_of_each(docs).count() == jaccard_join.jaccard_components(docs, degrees=False).select("component_id").distinct().count()
    assert max(sizes(docs)) < 2 * BATCH_BYTES


def test_a_bound_of_the_session_holds(spark, unset):
    spark.conf.set(KEY, str(1 << 20))
    jaccard_join.one_of_each(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert spark.conf.get(KEY) == str(1 << 20)
