"""User handlers with named state per tenant and lane, on ``transformWithState``.

A handler is an object with ``rows(key, frames, state)``, which gets all frames of a
(client_id, lane) in a micro-batch and gives tuples of the output columns, and with
``expired(key, at, state)`` if it sets timers. ``state`` has the named states of the
handler (value, list or map), and ``timer(milliseconds)`` and ``now()``.

A tenant is spread over lanes, as one tenant may hold a large part of a stream: as many
as its measured load asks for, or the same number for all. What the lanes hold is put
together by ``merged``. A purge mark of a tenant clears all its lanes (see ``purges``).
"""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .epochs import latest
from .purges import MARK

ROWS_PER_LANE = 1_000_000
OUTPUT_ROWS = 10_000


def measured_lanes(rows, per_lane=ROWS_PER_LANE, known=None, most=None):
    """(client_id, lanes) for the rows of each tenant so far, one lane for each ``per_lane`` of them.

    ``known`` are the lanes of an earlier run: lanes are added and never taken away, as
    they hold state. A tenant has no more than ``most``, if that is given.
    """
    asked = F.ceil(F.count("*") / F.lit(per_lane))
    lanes = rows.groupBy("client_id").agg(
        (asked if most is None else F.least(F.lit(most), asked)).cast("int").alias("lanes"))
    both = lanes if known is None else lanes.unionByName(known.select("client_id", "lanes"))
    return both.groupBy("client_id").agg(F.max("lanes").alias("lanes"))


class Tenant(StatefulProcessor):
    """Runs a handler, and clears what it holds at a purge mark."""

    def __init__(self, handler, values, lists, maps, columns, keep, timers):
        self.handler, self.values, self.lists, self.maps = handler, values, lists, maps
        self.columns, self.keep, self.timers = columns, keep, timers

    def init(self, handle):
        self.handle = handle
        self.states = {name: handle.getValueState(name, kind) for name, kind in self.values.items()}
        self.states |= {name: handle.getListState(name, kind) for name, kind in self.lists.items()}
        self.states |= {name: handle.getMapState(name, *kinds) for name, kinds in self.maps.items()}
        self.gone = handle.getValueState("gone", "gone boolean")
        vars(self).update(self.states)

    def timer(self, at):
        self.handle.registerTimer(at)

    def now(self):
        return self.times.getCurrentProcessingTimeInMs()

    def _frame(self, key, mark, rows):
        return pd.DataFrame([(*key, mark, *row) for row in rows], columns=self.columns).astype(object)

    def handleInputRows(self, key, rows, timerValues):
        self.times = timerValues
        if self.gone.exists():
            for _ in rows:
                pass
            return
        marked = ended = False

        def frames():
            nonlocal marked, ended
            for frame in rows:
                marked = marked or bool(frame[MARK].any())
                if not marked:
                    yield frame[self.keep]
            ended = True

        out = []
        for row in self.handler.rows(key, frames(), self) or ():
            out.append(row)
            # no mark can come any more that would take back what is given
            if ended and not marked and len(out) >= OUTPUT_ROWS:
                yield self._frame(key, False, out)
                out = []
        for frame in rows:
            marked = marked or bool(frame[MARK].any())
        if marked:
            for state in self.states.values():
                state.clear()
            for at in list(self.handle.listTimers()) if self.timers else ():
                self.handle.deleteTimer(at)
            self.gone.update((True,))
            yield self._frame(key, True, [(None,) * (len(self.columns) - 3)])
        elif out:
            yield self._frame(key, False, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times = timerValues
        out = list(self.handler.expired(key, expiredTimerInfo.getExpiryTimeInMs(), self) or ())
        if out:
            yield self._frame(key, False, out)

    def close(self):
        pass


def with_lanes(stream, lanes, lane_key):
    """Give rows the lane of their ``lane_key``, and marks all lanes of their tenant.

    Whole-number keys go round the lanes, others by their hash.
    """
    whole = isinstance(stream.schema[lane_key].dataType, T.IntegralType)
    if isinstance(lanes, int):
        known = stream.withColumn("lanes", F.lit(lanes))
    else:
        known = stream.join(lanes.select("client_id", "lanes"), "client_id", "left").withColumn(
            "lanes", F.coalesce("lanes", F.lit(1)))
    own = F.pmod(F.coalesce(F.col(lane_key), F.lit(0)) if whole else F.xxhash64(lane_key), F.col("lanes"))
    lane = F.when(F.col(MARK), F.sequence(F.lit(0), F.col("lanes") - 1)).otherwise(F.array(own.cast("int")))
    return known.withColumn("lane", F.explode(lane)).drop("lanes")


def tenant_states(stream, handler, output, values=None, lists=None, maps=None, lanes=8, lane_key="batch_id",
                  columns=None, timers=False):
    """Run a handler per tenant and lane; gives client_id, lane, purged and the ``output`` columns (DDL).

    ``values``, ``lists`` (name: DDL) and ``maps`` (name: (key DDL, value DDL)) are the
    named states. Only ``columns``, if given, reach Python. ``lanes`` is a number or a
    frame of ``measured_lanes``. ``stream`` may have purge marks. ``timers`` are for queries
    left running (``every``): with them a query never finds that it has nothing left to do.
    """
    schema = T.StructType.fromDDL(f"client_id bigint, lane int, {MARK} boolean, {output}")
    marked = stream if MARK in stream.columns else stream.withColumn(MARK, F.lit(False))
    laned = with_lanes(marked, lanes, lane_key)
    keep = [name for name in (columns or stream.columns) if name not in (MARK, "client_id")]
    for module in {__name__, type(handler).__module__}:  # so that workers need not have them
        cloudpickle.register_pickle_by_value(sys.modules[module])
    processor = Tenant(handler, values or {}, lists or {}, maps or {}, schema.fieldNames(), keep, timers)
    return laned.select("client_id", "lane", MARK, *keep).groupBy("client_id", "lane").transformWithStateInPandas(
        processor, outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if timers else "None")


def merged(log, *merges, values):
    """One row per tenant from the newest rows of its lanes, by aggregates of these values."""
    lanes = latest(log, ["client_id", "lane"], list(values))
    return lanes.groupBy("client_id").agg(*merges)


def state_rows(spark, checkpoint, name, epoch=None):
    """The rows of a named state as they are in the checkpoint: ``key``, and what the kind of state has."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    if epoch is not None:
        reader = reader.option("batchId", epoch)
    return reader.load()
