"""Text embeddings: a pluggable model in batches, and a model-free form inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384

# A model factory runs once per worker and returns a function from a list of texts to a 2-d array.
ModelFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def model_embedding(factory: ModelFactory, dimensions: int = DIMENSIONS) -> Callable[[Column], Column]:
    """Column function for unit-length embeddings of the given model; empty text gives zeros."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            filled = texts.fillna("")
            vectors = np.zeros((len(filled), dimensions), np.float32)
            has_text = (filled != "").to_numpy()
            if has_text.any():
                raw = np.asarray(model(filled[has_text].tolist()), np.float32)
                norms = np.linalg.norm(raw, axis=1, keepdims=True)
                vectors[has_text] = np.divide(raw, norms, out=raw.copy(), where=norms > 0)
            yield pd.Series(list(vectors))

    return embed


def hashed_embedding(
    rows: DataFrame, text: str = "text", output: str = "embedding", dimensions: int = DIMENSIONS
) -> DataFrame:
    """Unit-length hashed word counts: needs no model and no Python; empty text gives zeros."""
    words = RegexTokenizer(
        inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True, minTokenLength=1
    )
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    filled = rows.withColumn("_text", F.coalesce(text, F.lit("")))
    vectors = unit.transform(counts.transform(words.transform(filled)))
    return vectors.withColumn(output, vector_to_array("_unit", "float32")).drop("_text", "_words", "_counts", "_unit")
