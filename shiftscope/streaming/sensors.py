"""Sensor monitoring as a stream: six numbers of filter state per machine, kept by buckets of machines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shiftscope.operators.sensors import FAILURE_LEVEL, START_VAR, WARM_UP, WARN_WITHIN, gain_step
from shiftscope.streaming.keyed import HELD, PLACE, ROCKSDB, ROWS, in_order, key_bucket, load_states, save_states

_OUTPUT = "machine_id string, t bigint, value double, level double, slope double, eta double, alert boolean"


class Monitor(StatefulProcessor):
    """Level, slope, covariance and whether an alert was given, per machine of a bucket."""

    def __init__(self, threshold: float, within: int, warm_up: int):
        self.threshold, self.within, self.warm_up = threshold, within, warm_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filters", HELD)
        self.staged = handle.getMapState("staged", PLACE, ROWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machines = load_states(self.state)
        for frame in in_order(rows, "t", self.staged):
            out, alerts = np.empty((len(frame), 3)), np.zeros(len(frame), dtype=bool)
            for i, (machine, t, z) in enumerate(zip(frame["machine_id"].tolist(), frame["t"].tolist(), frame["value"].tolist())):
                known = machines.get(machine)
                if known is None:
                    level, slope, p, alerted = z, 0.0, (START_VAR, 0.0, START_VAR), False
                else:
                    level, slope, p, alerted = known
                    p, k0, k1 = gain_step(p)
                    level += slope
                    miss = z - level
                    level, slope = level + k0 * miss, slope + k1 * miss
                eta = 0.0 if level >= self.threshold else (self.threshold - level) / slope if slope > 0 else np.nan
                if not alerted and eta <= self.within and t > self.warm_up:
                    alerted = alerts[i] = True
                machines[machine] = (level, slope, p, alerted)
                out[i] = level, slope, eta
            yield pd.DataFrame({"machine_id": frame["machine_id"].to_numpy(), "t": frame["t"].to_numpy(), "value": frame["value"].to_numpy(),
                                "level": out[:, 0], "slope": out[:, 1], "eta": out[:, 2], "alert": alerts})
        save_states(self.state, machines)

    def close(self) -> None:
        pass


def monitor_stream(readings: DataFrame, threshold: float = FAILURE_LEVEL, within: int = WARN_WITHIN, warm_up: int = WARM_UP) -> DataFrame:
    """Every reading with level, slope and steps to failure; ``alert`` is true once per machine. State is kept in RocksDB."""
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = readings.selectExpr("cast(machine_id as string) machine_id", "cast(t as bigint) t", "cast(value as double) value")
    return rows.withColumn("bucket", key_bucket("machine_id")).groupBy("bucket").transformWithStateInPandas(Monitor(threshold, within, warm_up), _OUTPUT, "Append", "None")


def alert_stream(readings: DataFrame, threshold: float = FAILURE_LEVEL, within: int = WARN_WITHIN, warm_up: int = WARM_UP) -> DataFrame:
    """The first warning of each machine as it comes: at_step, smoothed level, slope and predicted steps to failure."""
    rows = monitor_stream(readings, threshold, within, warm_up).where("alert")
    return rows.selectExpr("machine_id", "t as at_step", "round(level, 2) as smoothed_level", "round(slope, 4) as slope_per_step", "round(eta, 1) as predicted_steps_to_failure")
