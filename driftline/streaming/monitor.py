"""Drift of a stream against a baseline: every micro-batch is compared as a dataset of its own.

An extension: drift itself is defined over bounded datasets. The baseline's side is read again for each batch, so give a
table or a sample of it, not a long computation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from driftline.operators.drift import breaches, drift_frame
from driftline.operators.rows import scratch


def watch(stream: DataFrame, baseline: DataFrame, threshold: float, found: Callable[[int, list[str]], None]) -> DataStreamWriter:
    """A writer to start: `found` gets each batch's number and the columns over the threshold, if there are any."""

    def compare(batch: DataFrame, number: int) -> None:
        with scratch():
            over = sorted(r["column"] for r in breaches(drift_frame(baseline, batch), threshold).select("column").collect())
        if over:
            found(number, over)

    return stream.writeStream.foreachBatch(compare)
