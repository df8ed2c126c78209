"""What the pipeline's quality stage holds in a Python worker at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratagraph.llm import quality
from stratagraph.llm.common import find_package


def test_statistics_of_a_large_batch_take_bounded_memory():
    words = "river stone Cloud meadow lantern harbour COPPER willow 17 signal!".split()
    rng = np.random.default_rng(5)
    texts = [" ".join(words[k] for k in rng.integers(0, 10, n)) for n in rng.integers(0, 600, 2000)]
    column = pa.array([*texts, None, ""])
    assert column.nbytes > 3_500_000
    tracemalloc.start()
    got = quality.column_statistics(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    assert np.array_equal(got, np.concatenate([quality.column_statistics(column.slice(k, 100)) for k in range(0, len(column), 100)]))


def test_kept_documents_go_to_workers_in_small_batches(spark, monkeypatch):
    find_package(spark)

    def score(model, text="text"):
        @F.arrow_udf("double")
        def small(texts: pa.Array) -> pa.Array:
            return pa.array([float(len(texts) <= 1000)] * len(texts))

        return small(text)

    monkeypatch.setattr(quality, "fit", lambda docs, labels: quality.Trees(0.0, np.zeros((1, 1), int), np.zeros((1, 1)), np.zeros((1, 2))))
    monkeypatch.setattr(quality, "score_column", score)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns
    assert kept.count() == 6000
