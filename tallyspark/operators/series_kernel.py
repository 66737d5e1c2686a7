"""Stored boosters carried forward in Arrow batches.

Runs inside Spark tasks, several accounts at a time.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from tallyspark.operators import booster_kernel as kernel

# Ship the kernels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL_COLUMNS = ["account_id", "last", "n_rows", "history", "start", "rate", "feature", "threshold", "value"]
#: Models carried forward at once; a batch of stored models may hold thousands, each some 24 KB.
MODELS_AT_ONCE = 64


def _doubles(values) -> pa.Array:
    """What is not a number becomes NULL."""
    return pa.array(np.asarray(values, dtype=float), from_pandas=True)


def carried(batch: pa.RecordBatch, horizon: int, lags: int):
    """The forecasts of a batch of models, some models at a time."""
    for at in range(0, batch.num_rows, MODELS_AT_ONCE):
        part = batch.slice(at, MODELS_AT_ONCE)
        sizes = list(zip(*(_sizes(part.column(c)) for c in ("feature", "value", "history"))))
        begins = [i for i, size in enumerate(sizes) if i == 0 or size != sizes[i - 1]]
        for a, b in zip(begins, [*begins[1:], part.num_rows]):
            yield _carried(part.slice(a, b - a), horizon, lags)


def _sizes(column: pa.Array) -> list[tuple]:
    """Length and first element's length of every row's list."""
    lengths = pc.list_value_length(column).to_pylist()
    if not pa.types.is_list(column.type.value_type):
        return [(n,) for n in lengths]
    return list(zip(lengths, pc.list_value_length(pc.list_element(column, 0)).to_pylist()))


def _carried(models: pa.RecordBatch, horizon: int, lags: int) -> pa.RecordBatch:
    """The forecasts of models that are all of one size."""
    n = models.num_rows

    def stacked(name):
        flat = models.column(name).flatten()
        trees = len(flat) // n
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, trees, -1)

    feature, threshold, value = (stacked(c) for c in ("feature", "threshold", "value"))
    start, rate = (models.column(c).to_numpy(zero_copy_only=False) for c in ("start", "rate"))
    last = models.column("last").to_numpy(zero_copy_only=False).astype("datetime64[D]")
    flows = models.column("history").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    for step in range(1, horizon + 1):
        day = last + np.timedelta64(step, "D")
        recent = np.ascontiguousarray(flows[:, -lags:])
        # Day 0 of the epoch is a Thursday.
        calendar = [(day.astype(np.int64) + 3) % 7, (day - day.astype("datetime64[M]")).astype(np.int64) + 1]
        x = np.column_stack([recent[:, ::-1], *calendar, recent.mean(axis=1)])
        flows = np.column_stack([flows, kernel.predict_each(start, rate, feature, threshold, value, x)])
    row = np.repeat(np.arange(n), horizon)
    return pa.RecordBatch.from_arrays(
        [models.column("account_id").take(pa.array(row)), models.column("last").take(pa.array(row)),
         pa.array(np.tile(np.arange(1, horizon + 1, dtype=np.int32), n)),
         _doubles(flows[:, flows.shape[1] - horizon:].ravel())],
        names=["account_id", "last", "step", "predicted_net_flow"])
