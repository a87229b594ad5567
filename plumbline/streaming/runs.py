"""Runs as streams: latest states, early stopping and silence, mean losses by time window, and state files as they come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from plumbline.sources.readers import read_run_state


def latest_states(states: DataFrame) -> DataFrame:
    """The latest state of each run by updated_at; a snapshot that arrives late and is older changes nothing. For update or complete mode."""
    rest = [c for c in states.columns if c not in ("run", "updated_at")]
    return states.groupBy("run").agg(F.max_by(F.struct("updated_at", *rest), F.col("updated_at")).alias("s"), F.count("*").alias("snapshots")).select("run", "s.*", "snapshots")


class _Stopping(StatefulProcessor):
    """Early stopping of one run. Epochs that came before the ones they follow are held in a list state until their turn: a call of the state
    server reads or adds all of a batch, where a map takes one for each epoch."""

    def __init__(self, patience: int, silence: float | None, keep: float) -> None:
        self.patience, self.silence, self.keep = patience, silence, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "best double, at int, last int, seen double, ended boolean, waits boolean")
        self.held = handle.getListState("held", "epoch int, metric double, ts double")

    def _walk(self, ready: list[tuple[int, float, float]], best: float, at: int, last: int, seen: float) -> tuple[tuple, str | None]:
        """The state after the epochs (epoch, metric, time) in order, up to the one that ends the run, and how it ended."""
        for epoch, metric, ts in ready:
            if self.silence is not None and last and ts - seen > self.silence:
                return (best, at, last, seen), "silent"
            last, seen = epoch, ts if last == 0 else max(seen, ts)
            if metric > best:  # false for NaN, which stands for null too
                best, at = metric, epoch
            if last - at >= self.patience:
                return (best, at, last, seen), "stopped"
        return (best, at, last, seen), None

    def _timer(self, at: float) -> None:
        if self.silence is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(at * 1000))

    def _close(self, key: tuple, state: tuple, how: str, until: float) -> Row:
        self.run.update((*state, True, False))
        self.held.clear()
        self._timer(until + self.keep)
        return Row(run=key[0], epoch=state[2], best_metric=state[0], best_epoch=state[1], outcome=how)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        best, at, last, seen, ended, waits = self.run.get() or (-1.0, 0, 0, 0.0, False, False)
        if ended:
            times = [r.at for r in rows if r.at is not None]
            if self.silence is not None and times:
                self._timer(max(times) + self.keep)
            return
        held = {e: (m, t) for e, m, t in self.held.get()} if waits else {}
        wait = dict(held)
        for r in rows:
            if r.epoch is not None and r.epoch > last and r.at is not None:
                one = (float("nan") if r.metric is None else float(r.metric), r.at)
                old = wait.get(r.epoch, one)
                wait[r.epoch] = one if old[0] != old[0] else max(old, one) if one[0] == one[0] else old
        ready = []
        while last + len(ready) + 1 in wait:
            e = last + len(ready) + 1
            ready.append((e, *wait.pop(e)))
        state, how = self._walk(ready, best, at, last, seen)
        if how:
            yield self._close(key, state, how, max([state[3], *(ts for _, _, ts in ready)]))
            return
        self.run.update((*state, False, bool(wait)))
        more = [(e, *v) for e, v in wait.items() if held.get(e) != v]
        if any(e not in wait or wait[e] != v for e, v in held.items()):
            self.held.put([(e, *v) for e, v in wait.items()]) if wait else self.held.clear()
        elif more:
            self.held.appendList(more)
        self._timer(max([state[3], *(ts for _, ts in wait.values())]) + (self.silence or 0))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        best, at, last, seen, ended, waits = self.run.get()
        if ended:
            self.run.clear()
            return
        state, how = self._walk(sorted(tuple(v) for v in self.held.get()) if waits else [], best, at, last, seen)
        yield self._close(key, state, how or "silent", expiredTimerInfo.getExpiryTimeInMs() / 1000)

    def close(self) -> None:
        pass


def run_outcomes(epochs: DataFrame, patience: int, silence: float | None = None, late: str = "1 hour", keep: float = 30 * 86400.0) -> DataFrame:
    """(run, epoch, best_metric, best_epoch, outcome) once for each run that ends: "stopped" at the epoch that uses up patience, as
    operators.runs.early_stop says, or "silent" at its last epoch when it has no new one for ``silence`` seconds of event time.

    epochs: (run, epoch int from 1, metric double), and ts timestamp where silence is given. Epochs may come in any order and any
    micro-batch: one waits in the state until those before it have come; when the run falls silent, those that still wait are taken in
    order, whatever is missing between them. An epoch that was counted before is left out; of one that repeats before that, the largest metric counts.
    A null or NaN metric is never a best; rows without an epoch or time are none. Rows that come ``late`` after later ones are dropped, as by any watermark. An ended run is
    remembered until no row of it has come for ``keep`` seconds of event time, so that none begins it anew; then its state goes. Without silence there are no timers, and the last of each run's states stays. For append mode,
    on the RocksDB state store (see durable_state).
    """
    columns = ["run", F.col("epoch").cast("int").alias("epoch"), F.col("metric").cast("double").alias("metric")]
    if silence is None:
        rows = epochs.select(*columns, F.lit(0.0).alias("at"))
    else:
        rows = epochs.select(*columns, "ts", F.col("ts").cast("timestamp").cast("double").alias("at")).withWatermark("ts", late)
    kind = f"run {epochs.schema['run'].dataType.simpleString()}, epoch int, best_metric double, best_epoch int, outcome string"
    return rows.groupBy("run").transformWithState(_Stopping(patience, silence, keep), kind, "append", "None" if silence is None else "EventTime")


def early_stop_alerts(epochs: DataFrame, patience: int) -> DataFrame:
    """(run, epoch, best_metric, best_epoch) once for each run, when patience is used up: run_outcomes without timers."""
    return run_outcomes(epochs, patience).drop("outcome")


@contextmanager
def durable_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, on disk and in the checkpoint, instead of in the executors' memory."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def window_means(steps: DataFrame, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(run, start, mean_loss, steps) of tumbling windows of ts; rows later than the watermark are dropped. For append mode."""
    w = steps.withWatermark("ts", late).groupBy("run", F.window("ts", length).alias("w")).agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("steps"))
    return w.select("run", F.col("w.start").alias("start"), "mean_loss", "steps")


def keep_states(states: DataFrame, out: str, n: int) -> None:
    """Writes a batch of run states (sources.readers.read_run_state) below its number, so that one that runs again replaces itself:
    those that could be read to ``out``/states, malformed ones (path, modified, malformed) to ``out``/malformed."""
    states.persist()
    try:
        states.where("malformed is null").drop("malformed").write.mode("overwrite").parquet(f"{out}/states/batch={n}")
        states.where("malformed is not null").select("run", "path", "modified", "malformed").write.mode("overwrite").parquet(f"{out}/malformed/batch={n}")
    finally:
        states.unpersist()


def poll_states(spark: SparkSession, glob: str, out: str, n: int) -> None:
    """Poll ``n`` of state files that are replaced in place: those whose time is not before the last one kept by the polls before are read, without
    those of just that time which are kept already. Run by a timer as a stream, it is the sink of poll_stream."""
    new = read_run_state(spark, glob)
    if n:
        before = _kept(spark, out, n)
        last = before.agg(F.max("modified")).first()[0]
        if last is not None:
            same = before.where(F.col("modified") == F.lit(last)).select("path", "modified").distinct()
            new = new.where(F.col("modified") >= F.lit(last)).join(same, ["path", "modified"], "left_anti")
    keep_states(new, out, n)


def _kept(spark: SparkSession, out: str, n: int) -> DataFrame:
    """(path, modified) of the files that batches before ``n`` read."""
    kinds = [spark.read.parquet(f"{out}/{kind}").where(F.col("batch") < n).select("path", "modified") for kind in ("states", "malformed")]
    return kinds[0].union(kinds[1])


def poll_stream(spark: SparkSession, glob: str, out: str, checkpoint: str, every: str = "3 seconds") -> StreamingQuery:
    """poll_states every so often until stopped; a restart goes on with the next poll. Each tick of a rate stream is a micro-batch, whose rows aren't used."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: poll_states(spark, glob, out, n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """The latest state of each run among those kept, by the file's time, then by the batch that read it."""
    rows = spark.read.parquet(f"{out}/states")
    rest = [c for c in rows.columns if c not in ("run", "modified", "batch")]
    return rows.groupBy("run").agg(F.max(F.struct("modified", "batch", *rest)).alias("s")).select("run", "s.*")
