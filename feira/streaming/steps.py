"""A run of named steps, one after the other, with a row of status for each."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

STATUS = "ordem int, passo string, estado string, segundos double, erro string"


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[SparkSession], object]]], limit_seconds: float = 3600.0) -> DataFrame:
    """Runs every step; one that fails or takes too long does not stop those behind it.

    ``estado`` is ``ok``, ``erro`` or ``tempo_esgotado``. The Spark jobs of a step that takes too long are cancelled.
    """
    rows = []
    for order, (name, step) in enumerate(steps, 1):
        group, failed = f"{name}-{uuid.uuid4().hex}", []

        def work(step=step, group=group, failed=failed) -> None:
            spark.sparkContext.setJobGroup(group, group, True)
            try:
                step(spark)
            except Exception as e:  # a step's failure is its status
                failed.append(f"{type(e).__name__}: {e}"[:500])

        began = time.monotonic()
        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        thread.join(limit_seconds)
        late = thread.is_alive()
        if late:
            spark.sparkContext.cancelJobGroup(group)
            thread.join(10)
        state = "tempo_esgotado" if late else "erro" if failed else "ok"
        rows.append((order, name, state, time.monotonic() - began, None if late or not failed else failed[0]))
    return spark.createDataFrame(rows, STATUS)
