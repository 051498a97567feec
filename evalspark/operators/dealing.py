"""Rows dealt to tasks by what they cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import evalspark

# functions of this package travel to the workers whole, so it need not be installed there
cloudpickle.register_pickle_by_value(evalspark)

# costs within a factor of 2 ** (1 / STEPS) are alike
STEPS = 4


def _dealer(partitions: int):
    """Deals the rows of each cost class out in turn; classes begin at different tasks."""

    @F.pandas_udf("int")
    def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        turns: dict[int, int] = {}
        for costs, tasks in batches:
            classes = np.floor(np.log2(costs.fillna(0).clip(lower=0).to_numpy(dtype=float) + 1) * STEPS).astype(int)
            targets = np.zeros(len(classes), dtype=np.int32)
            for kind in np.unique(classes).tolist():
                rows = np.flatnonzero(classes == kind)
                start = turns.get(kind, kind * 7 + int(tasks.iloc[0]) * 13)
                targets[rows] = (start + np.arange(len(rows))) % partitions
                turns[kind] = (start + len(rows)) % partitions
            yield pd.Series(targets)

    return deal


def deal_by_cost(df: DataFrame, cost: Column, partitions: int) -> DataFrame:
    """The rows in ``partitions`` tasks of about equal cost, the costliest first in each.

    Every task gets the same number of rows of each cost class from each task before, give or take one. Only the cost
    crosses to Python. Null and negative costs count as 0.
    """
    dealt = _dealer(partitions).asNondeterministic()(cost.cast("double"), F.spark_partition_id())
    costed = df.withColumn("_cost", cost.cast("double")).withColumn("_task", dealt)
    spread = costed.repartitionById(partitions, F.col("_task"))
    return spread.sortWithinPartitions(F.col("_cost").desc_nulls_last()).drop("_cost", "_task")
