"""Extension point: a user text encoder as an Arrow-batched pandas UDF.

The reference embeds ticket text with a pretrained sentence encoder before
k-means. No such model ships here; a user who has one passes a loader, and
the encoder runs inside Spark tasks: an iterator ``pandas_udf`` loads the model
once per task and encodes Arrow batches of ``batch_size`` texts. The output
column (``array<float>``) is the ``embedding`` that
``clusters.fit`` takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def encoder_udf(load: Callable[[], Callable[[list], np.ndarray]], batch_size: int = 64):
    """``load()`` returns ``encode(list_of_texts) -> 2-d array``."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            texts = texts.fillna("").tolist()
            rows = []
            for i in range(0, len(texts), batch_size):
                rows.extend(np.asarray(model(texts[i:i + batch_size]), dtype=np.float32))
            yield pd.Series([r.tolist() for r in rows], dtype=object)

    return encode
