"""The eta laws over a stream of controller updates, one keyed state per pool.

Updates arrive in any number of micro-batches; within one they are put in the order of their ticks. A tick that
is not the one after the last is an error, as a controller must neither skip nor repeat an update: an earlier
tick breaks monotonic time, a later one leaves the regular grid. State holds the last tick, eta and, for the
aggregate law, since when the backlog lasts, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators.forecast import SeasonalConfig, TenantConfig
from ..session import ship_package

ETA = StructType([StructField("gpu_model", StringType()), StructField("tick", LongType()), StructField("eta", DoubleType())])
STATE = StructType([StructField("tick", LongType()), StructField("eta", DoubleType()), StructField("since", DoubleType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class TenantLaw:
    """``updates``: tick, eviction_rate, maximum_spot_wait_seconds."""

    def __init__(self, config: TenantConfig = TenantConfig()):
        self.config = config

    def factor(self, row: Row, since: float | None) -> tuple[float, float | None]:
        c, rate = self.config, row["eviction_rate"]
        target = 1.0 - c.guarantee_probability
        if rate is not None and rate >= c.high_eviction_multiple * target:
            return target / rate, None
        waited = row["maximum_spot_wait_seconds"] > c.queue_wait_threshold_seconds
        if rate is not None and rate <= c.low_eviction_multiple * target and waited:
            return 1.5 - rate / target, None
        return 1.0, None


class AggregateLaw:
    """``updates``: tick, now_seconds, eviction_rate, new_runs, spot_backlog_gpus."""

    def __init__(self, config: SeasonalConfig = SeasonalConfig()):
        self.config = config

    def factor(self, row: Row, since: float | None) -> tuple[float, float | None]:
        c, rate, now = self.config, row["eviction_rate"], row["now_seconds"]
        target, rise = 1.0 - c.guarantee_probability, 1.0 + c.eta_increase_step
        backlog = row["spot_backlog_gpus"] > 0
        began = (now if since is None else since) if backlog else None
        if row["new_runs"] and rate is not None:
            if rate >= c.high_eviction_ratio * target and rate > 0:
                return target / rate, began
            return (rise if rate <= c.low_eviction_ratio * target and backlog else 1.0), began
        starving = backlog and now - began >= c.starvation_increase_after_seconds
        return (rise if starving else 1.0), began


class EtaProcessor(StatefulProcessor):
    def __init__(self, law: TenantLaw | AggregateLaw):
        self.law = law

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("controller", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        config = self.law.config
        tick, eta, since = self.state.get() if self.state.exists() else (None, config.initial_eta, None)
        for row in sorted(rows, key=lambda r: r["tick"]):
            if tick is not None and row["tick"] <= tick:
                raise ValueError(f"Update {row['tick']} of pool {key[0]} follows update {tick}: time must be monotonic")
            if tick is not None and row["tick"] != tick + 1:
                raise ValueError(f"Update {row['tick']} of pool {key[0]} follows update {tick}: the grid is irregular")
            factor, since = self.law.factor(row, since)
            tick, eta = row["tick"], max(config.minimum_eta, min(config.maximum_eta, eta * factor))
            yield Row(gpu_model=key[0], tick=tick, eta=eta)
        self.state.update((tick, eta, since))

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB; other streams of the session are not affected once started."""
    spark.conf.set(PROVIDER, ROCKS)


def eta_stream(updates: DataFrame, law: TenantLaw | AggregateLaw) -> DataFrame:
    """gpu_model, tick and eta behind every update of a stream."""
    ship_package(updates.sparkSession)
    use_keyed_state(updates.sparkSession)
    return updates.groupBy("gpu_model").transformWithState(
        statefulProcessor=EtaProcessor(law), outputStructType=ETA, outputMode="Append", timeMode="None"
    )
