"""Track sensor level and slope with a Kalman filter and warn before a threshold is crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftscope.functions.numbers import ratio
from shiftscope.functions.ordered import positions
from shiftscope.session import cut_lineage

# fixed values: filter noise, start uncertainty, alert rule
PROCESS_VAR, MEASUREMENT_VAR, START_VAR = 1e-5, 0.25, 1000.0
FAILURE_LEVEL, WARN_WITHIN, WARM_UP = 8.0, 48, 10
BLOCK = 128  # readings that are folded one after the other
FAN = 128  # maps of blocks, or of blocks of blocks, that are composed one after the other


def gain_step(p: tuple[float, float, float]) -> tuple[tuple[float, float, float], float, float]:
    """Advance the covariance (p00, p01, p11) by one reading; returns it with the two gains."""
    p00, p01, p11 = p
    a = p00 + 2 * p01 + p11 + 0.25 * PROCESS_VAR
    b = p01 + p11 + 0.5 * PROCESS_VAR
    c = p11 + PROCESS_VAR
    k0, k1 = a / (a + MEASUREMENT_VAR), b / (a + MEASUREMENT_VAR)
    return ((1 - k0) * a, (1 - k0) * b, c - k1 * b), k0, k1


def gains() -> list[tuple[float, float]]:
    """Gains by reading number from the second reading on, until they no longer change (some hundred numbers)."""
    p, out = (START_VAR, 0.0, START_VAR), []
    while len(out) < 20_000:
        p, k0, k1 = gain_step(p)
        out.append((k0, k1))
        if len(out) > 1 and abs(k0 - out[-2][0]) < 1e-16 and abs(k1 - out[-2][1]) < 1e-16:
            break
    return out


def _gain(pos: Column, which: int) -> Column:
    """The gain at reading ``pos`` (from 1). The first reading sets the level and leaves the slope 0."""
    table = F.lit([(1.0, 0.0)[which], *[k[which] for k in gains()]])
    return F.get(table, F.least(pos, F.size(table)).cast("int") - 1)


# the state after a reading of value z with gains k0, k1: level' = (1 - k0) (level + slope) + k0 z, slope' = slope - k1 (level + slope) + k1 z
_MAP = "struct<c0:double,c1:double,a00:double,a01:double,a10:double,a11:double>"


def _read(x0: Column, x1: Column, r: Column, offset: bool = True) -> tuple[Column, Column]:
    """Level and slope after reading ``r``; without ``offset`` the linear part alone."""
    miss = (r["value"] if offset else F.lit(0.0)) - (x0 + x1)
    return x0 + x1 + r["k0"] * miss, x1 + r["k1"] * miss


def _map_of(names: tuple[Column, ...]) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(names, ("c0", "c1", "a00", "a01", "a10", "a11"))])


def _through(m: Column, r: Column) -> Column:
    """The map of all readings so far and then ``r``."""
    (c0, c1), (a00, a10), (a01, a11) = _read(m["c0"], m["c1"], r), _read(m["a00"], m["a10"], r, False), _read(m["a01"], m["a11"], r, False)
    return _map_of((c0, c1, a00, a01, a10, a11))


def _after(f: Column, g: Column) -> Column:
    """The map ``f`` and then the map ``g``; this is associative, so blocks may be composed in blocks."""
    c = [g[f"c{i}"] + g[f"a{i}0"] * f["c0"] + g[f"a{i}1"] * f["c1"] for i in (0, 1)]
    a = [g[f"a{i}0"] * f[f"a0{j}"] + g[f"a{i}1"] * f[f"a1{j}"] for i in (0, 1) for j in (0, 1)]
    return _map_of((*c, *a))


def _same() -> Column:
    return _map_of(tuple(F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 0.0, 1.0)))


def _starts(maps: DataFrame, blocks: int, fan: int) -> DataFrame:
    """(machine_id, block, start): the map of everything before each block, from (machine_id, block, map).

    ``fan`` neighbouring maps are composed to one, until one is left of each machine; on the way down each group knows what came before it.
    """
    groups = maps.groupBy("machine_id", F.floor(F.col("block") / fan).alias("group")).agg(F.sort_array(F.collect_list(F.struct("block", "map"))).alias("maps"))
    if blocks <= fan:
        groups = groups.withColumn("before", _same())
    else:
        whole = groups.select("machine_id", F.col("group").alias("block"), F.aggregate("maps", _same(), lambda f, m: _after(f, m["map"])).alias("map"))
        above = _starts(cut_lineage(whole), -(-blocks // fan), fan)
        groups = groups.join(above.select("machine_id", F.col("block").alias("group"), F.col("start").alias("before")), ["machine_id", "group"])
    done = F.array().cast(f"array<struct<block:bigint,start:{_MAP}>>")
    step = lambda s, m: F.struct(_after(s["f"], m["map"]).alias("f"), F.array_append(s["out"], F.struct(m["block"].alias("block"), s["f"].alias("start"))).alias("out"))
    chained = F.aggregate("maps", F.struct(F.col("before").alias("f"), done.alias("out")), step, lambda s: s["out"])
    return groups.select("machine_id", F.inline(chained))


def kalman_monitor(readings: DataFrame, block: int = BLOCK, fan: int = FAN, position: str | None = None) -> DataFrame:
    """(machine_id, t, value, level, slope) after every reading.

    The gains do not depend on the readings, so a reading changes the state by a fixed affine map. The readings of a machine are cut in blocks
    by position; the maps of blocks are composed in parallel, level by level, and the blocks are folded from their true start. A
    machine may have any number of readings: no task holds more than a block of them, or ``fan`` maps. ``position`` names a column that numbers
    the readings of a machine from 1 without gaps already; without one they are numbered here.
    """
    value = F.col("value").cast("double").alias("value")
    if position:
        rows = readings.select("machine_id", "t", value, F.col(position).cast("bigint").alias("pos"))
    else:
        rows = positions(readings.select("machine_id", "t", value), ["machine_id"], "t")
    pos = F.col("pos")
    reading = F.struct("pos", "t", "value", _gain(pos, 0).alias("k0"), _gain(pos, 1).alias("k1"))
    blocks = rows.groupBy("machine_id", F.floor((pos - 1) / block).alias("block")).agg(F.sort_array(F.collect_list(reading)).alias("rows"))
    blocks = cut_lineage(blocks)
    most = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    if most > 1:
        maps = blocks.select("machine_id", "block", F.aggregate("rows", _same(), _through).alias("map"))
        # the first reading forgets what was before it, so a start is a state: the map's offset
        blocks = blocks.join(_starts(maps, most, fan).select("machine_id", "block", "start.c0", "start.c1"), ["machine_id", "block"])
    else:
        blocks = blocks.withColumns({"c0": F.lit(0.0), "c1": F.lit(0.0)})
    kind = readings.schema["t"].dataType.simpleString()
    done = F.array().cast(f"array<struct<t:{kind},value:double,level:double,slope:double>>")

    def step(s: Column, r: Column) -> Column:
        level, slope = _read(s["level"], s["slope"], r)
        return F.struct(level.alias("level"), slope.alias("slope"), F.array_append(s["out"], F.struct(r["t"].alias("t"), r["value"].alias("value"), level.alias("level"), slope.alias("slope"))).alias("out"))

    states = F.aggregate("rows", F.struct(F.col("c0").alias("level"), F.col("c1").alias("slope"), done.alias("out")), step, lambda s: s["out"])
    return blocks.select("machine_id", F.inline(states))


def failure_eta(level: Column, slope: Column, threshold: float = FAILURE_LEVEL) -> Column:
    """Steps until the threshold: 0 when reached, NULL when not heading there."""
    return F.when(level >= threshold, 0.0).when(slope > 0, ratio(F.lit(threshold) - level, slope))


def failure_alerts(states: DataFrame, threshold: float = FAILURE_LEVEL, within: int = WARN_WITHIN, warm_up: int = WARM_UP) -> DataFrame:
    """The first time each machine is predicted to fail soon."""
    rows = states.withColumn("eta", failure_eta(F.col("level"), F.col("slope"), threshold))
    rows = rows.where((F.col("eta") <= within) & (F.col("t") > warm_up))
    first = rows.groupBy("machine_id").agg(F.min(F.struct("t", "level", "slope", "eta")).alias("a"))
    return first.select(
        "machine_id", F.col("a.t").alias("at_step"), F.round("a.level", 2).alias("smoothed_level"),
        F.round("a.slope", 4).alias("slope_per_step"), F.round("a.eta", 1).alias("predicted_steps_to_failure"),
    )


def alert_quality(readings: DataFrame, alerts: DataFrame, threshold: float = FAILURE_LEVEL) -> DataFrame:
    """Per machine: when it crossed the threshold, when it was announced, the lead, and whether the alarm was false."""
    crossed = readings.groupBy("machine_id").agg(F.min(F.when(F.col("value") >= threshold, F.col("t"))).alias("failed_at"))
    both = crossed.join(alerts.select("machine_id", "at_step"), "machine_id", "left")
    return both.select(
        "machine_id", "failed_at", "at_step", (F.col("failed_at") - F.col("at_step")).alias("warning_lead"),
        (F.col("failed_at").isNull() & F.col("at_step").isNotNull()).alias("false_alarm"),
    )
