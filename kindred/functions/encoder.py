"""Embedding texts with an encoder that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the states (n, t, d) where the mask (n, t) is 1; zero where it never is."""
    m = mask[:, :, None].astype(states.dtype)
    return (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def embed(rows: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 10) -> DataFrame:
    """(key, embedding) of every row with a text; ``make`` builds the encoder once per task.

    The encoder always gets ``batch`` texts, the last one repeated to fill up, so that a row's vector does not depend
    on how many came with it. A vector that is not finite, or a result of another length, fails the task.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = part["t"].tolist()
                out = np.asarray(encode(texts + texts[-1:] * (batch - len(texts))), dtype=np.float32)
                if len(out) != batch or not np.isfinite(out).all():
                    raise ValueError("the encoder's result is not finite or of another length")
                yield pd.DataFrame({"k": part["k"], "embedding": list(out[: len(part)])})

    src = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)
