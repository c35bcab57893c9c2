"""Word vectors trained on all tokens (UDF-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_vectors(words: DataFrame, line: str = "script_id", word: str = "word", order: str = "word_seq", size: int = 32, min_count: int = 2, seed: int = 1) -> DataFrame:
    """word, vector of a skip-gram model of lines; words seen less than min_count times have none."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    text = words.filter(F.col(word).isNotNull() & F.col(line).isNotNull()).groupBy(line).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.lower(word).alias("w")))), lambda r: r["w"]).alias("text"))
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, inputCol="text", outputCol="v", numPartitions=max(1, words.sparkSession.sparkContext.defaultParallelism // 2)).fit(text)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
