"""Batches of texts for an encoder: of like length, within a budget of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Fixed: most tokens and most sequences of a batch.
MOST_TOKENS, MOST_SEQUENCES = 512, 256


def packed(df: DataFrame, key: str, length: str, most_tokens: int = MOST_TOKENS, most_sequences: int = MOST_SEQUENCES) -> DataFrame:
    """(key, length, task, batch): rows of a task in order of length, cut where the padded batch would be too large.

    A batch costs its longest sequence times its sequences; a sequence that is
    longer than the budget is a batch of its own.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, batch, n = TaskContext.get().partitionId(), -1, 0
        for pdf in frames:
            numbers = []
            for tokens in pdf[length]:
                if batch < 0 or n + 1 > most_sequences or tokens * (n + 1) > most_tokens:  # ascending: the newest is the longest
                    batch, n = batch + 1, 0
                n += 1
                numbers.append(batch)
            yield pd.DataFrame({"key": pdf[key], "length": pdf[length], "task": task, "batch": numbers})

    rows = df.select(key, length).sortWithinPartitions(length, key)
    return rows.mapInPandas(pack, "key bigint, length bigint, task int, batch bigint")
