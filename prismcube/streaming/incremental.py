"""Keeping rollups current from a stream of events: each micro-batch's state becomes a part of the warehouse's."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismcube.engine import Engine
from prismcube.errors import QueryError, WarehouseError
from prismcube.operators import rollups
from prismcube.operators.compile import event_time, quoted, with_time_dims

#: The window in which a group of a rollup with that dimension lies, and where weeks start (the epoch is a Thursday).
WINDOWS = {"minute": ("1 minute", "0 minutes"), "hour": ("1 hour", "0 minutes"), "day": ("1 day", "0 minutes"), "week": ("7 days", "4 days")}


def keep_current(engine: Engine, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that adds every micro-batch of ``events`` to the engine's warehouse, once.

    A stream is known by the id in its checkpoint, a batch by its number; both go into the manifest in the same swap as
    the batch's state. So a batch that is given again after a restart is left out, and another stream's never is.
    """

    def add(batch: DataFrame, number: int) -> None:
        found = engine.warehouse._read(f"{checkpoint.rstrip('/')}/metadata")
        if found is None:
            raise WarehouseError(f"{checkpoint} doesn't say which stream it is of")
        batch.persist()
        try:
            engine.append(batch, (json.loads(found)["id"], number))
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_state(engine: Engine, events: DataFrame, rollup: str, late: str = "1 hour") -> DataFrame:
    """A rollup as a streaming aggregation: a group comes out once, when the watermark has passed its minute, hour, day or week.

    The week that holds a new year is two groups, as its days are of two years; a week number that a year has at both ends
    comes out as two states, which merge.
    """
    definition = engine.model.rollup(rollup)
    finest = next((d for d in WINDOWS if d in definition.dims), None)
    if finest is None:
        raise QueryError(f"{rollup} has no calendar dimension: its groups are never complete")
    length, start = WINDOWS[finest]
    timed = events.withColumn("_time", event_time(engine.model).cast("timestamp")).withWatermark("_time", late)
    rows = with_time_dims(timed, engine.model)
    return rows.groupBy(F.window("_time", length, length, start), *map(quoted, definition.dims)).agg(*rollups.state(engine.model)).drop("window")
