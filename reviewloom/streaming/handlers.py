"""User code on a stream: per micro-batch, or stateful per tenant."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .epochs import run_epochs, start_log


def handle_batches(stream, handler, schema, path, checkpoint, **options):
    """Run ``handler(rows) -> DataFrame`` on every micro-batch into an epoch log.

    The handler gets a DataFrame, so it may use any operator, or ``mapInPandas``
    where it needs Python per record batch.
    """
    start_log(stream.sparkSession, path, schema)
    return run_epochs(stream, lambda rows, epoch: handler(rows), path, checkpoint, **options)


def stateful_handlers(stream, handler, initial, output, state, lanes=8, lane_key="batch_id"):
    """One stateful handler per tenant and lane.

    ``handler(state, rows) -> (state, output row)`` gets the last state tuple and a
    pandas frame of new rows; ``initial`` is the first state. ``output`` and
    ``state`` are DDL schemas. A tenant's rows are spread over ``lanes`` by
    ``lane_key``, because one tenant may hold a large part of the stream: combine
    the lanes of a tenant in a following aggregation. Rows come in no fixed order,
    and one call may see only a part of a lane's rows.
    """
    output = f"client_id bigint, lane bigint, {output}"
    names = T.StructType.fromDDL(output).fieldNames()

    def step(key, frames, group_state):
        current = group_state.get if group_state.exists else initial
        row = None
        for frame in frames:
            current, row = handler(current, frame)
        group_state.update(current)
        if row is not None:
            yield pd.DataFrame([(*key, *row)], columns=names)

    laned = stream.withColumn("lane", F.pmod(F.xxhash64(lane_key), F.lit(lanes)))
    return laned.groupBy("client_id", "lane").applyInPandasWithState(
        step,
        outputStructType=output,
        stateStructType=state,
        outputMode="update",
        timeoutConf="NoTimeout",
    )
