"""Models that tasks hold, sent by value: executors need no installed package."""
from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def shared(spark: SparkSession, model) -> Callable:
    """A broadcast of the model, classes included; the result gives it back in a task, unpickled once per worker."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def load():
        if not hasattr(sent, "_model"):
            sent._model = pickle.loads(sent.value)
        return sent._model

    return load
