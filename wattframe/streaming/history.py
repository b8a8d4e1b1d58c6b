"""Feature rows for days as they close, from what each meter remembers.

A meter's last days are kept in the state store. A batch reads and writes the state of
the meters it brings and of no others; a meter that stays silent is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.forecast import step_projections
from ..schema import DAY, FEATURES, HISTORY_ROWS, KWH, METER, TS


def history_stream(closed: DataFrame, rows: int = HISTORY_ROWS, forget_after_days: int = 400) -> DataFrame:
    """``meter_id, day, kwh, buf``: every closed day with up to ``rows`` values before it, oldest first.

    ``closed`` brings each day of a meter once, earlier days not after later ones; the
    days of one batch may come in any order. State cannot follow a streaming aggregate,
    so closed days are a table of their own (``closed_days``). Time is that of the days:
    a meter is forgotten when others are ``forget_after_days`` ahead of its last day, and
    a day that comes so late is dropped.
    """
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches)).sort_values(DAY)
        values = list(state.get[0]) if state.exists else []
        befores = []
        for v in new[KWH].tolist():
            befores.append(values[-rows:])
            values.append(v)
        state.update((values[-rows:],))
        last = int(pd.Timestamp(new[DAY].iloc[-1]).timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({METER: key[0], DAY: new[DAY].tolist(), KWH: new[KWH].tolist(), "buf": befores})

    timed = closed.select(METER, DAY, KWH, F.to_timestamp(DAY).alias(TS)).withWatermark(TS, f"{forget_after_days} days")
    return timed.groupBy(METER).applyInPandasWithState(
        advance,
        f"{METER} STRING, {DAY} DATE, {KWH} DOUBLE, buf ARRAY<DOUBLE>",
        "past ARRAY<DOUBLE>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def feature_stream(closed: DataFrame, forget_after_days: int = 400) -> DataFrame:
    """The 36 features of every closed day that has 30 days before it."""
    out = history_stream(closed, HISTORY_ROWS, forget_after_days).where(F.size("buf") == HISTORY_ROWS)
    # what a forecast step knows of the day after its last one
    out = out.withColumnsRenamed({DAY: "date"}).withColumns({"last_day": F.date_sub("date", 1), "fc": F.array()})
    for projection in step_projections():
        out = out.withColumns(projection)
    return out.select(METER, "date", KWH, *FEATURES)


CLOSED = f"{METER} STRING, {DAY} DATE, {KWH} DOUBLE, readings BIGINT"


def closed_days(spark: SparkSession, path: str) -> DataFrame:
    """The stream of the days that ``daily_stream`` has given out into ``path``."""
    return spark.readStream.schema(CLOSED).parquet(path)
