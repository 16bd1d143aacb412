"""Live processing of frames as they arrive, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelens.operators.shared import scratch
from framelens.operators.tracks import closest_first


def watch_source(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder in the order of their arrival; outputs must go elsewhere."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def settled(listing: DataFrame) -> DataFrame:
    """path, size of files whose size and time were equal in two polls in a row; the listing is (path, size, mtime, poll).

    State: the last size and time of each path, and whether it has been passed on. A path that changes starts anew.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, mtime, done = state.get if state.exists else (-1, -1, False)
        rows = pd.concat(list(batches)).sort_values("poll")
        ready = False
        for s, m in rows[["size", "mtime"]].itertuples(index=False, name=None):
            if (s, m) == (size, mtime):
                ready = ready or not done
                done = True
            else:
                size, mtime, done = int(s), int(m), False
        state.update((int(size), int(mtime), bool(done)))
        if ready:
            yield pd.DataFrame({"path": [key[0]], "size": [size]})

    return listing.groupBy("path").applyInPandasWithState(step, "path string, size long", "size long, mtime long, done boolean", "append", GroupStateTimeout.NoTimeout)


def seen_once(frames: DataFrame, name: str = "name", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each name once; with a time column a watermark bounds the state."""
    if time is None:
        return frames.dropDuplicates([name])
    return frames.withWatermark(time, delay).dropDuplicatesWithinWatermark([name])


def with_retries(attempts: DataFrame, most: int = 3) -> DataFrame:
    """name, attempts, status of (name, ok, reason, attempt): done at the first success, failed after ``most`` failures."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, over = state.get if state.exists else (0, False)
        for ok, reason in pd.concat(list(batches)).sort_values("attempt")[["ok", "reason"]].itertuples(index=False, name=None):
            if over:
                break
            n += 1
            if ok or n >= most:
                over = True
                yield pd.DataFrame({"name": [key[0]], "attempts": [n], "status": ["done" if ok else "failed"], "reason": [None if ok else reason]})
        state.update((int(n), bool(over)))

    return attempts.groupBy("name").applyInPandasWithState(step, "name string, attempts long, status string, reason string", "n long, over boolean", "append", GroupStateTimeout.NoTimeout)


def append_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append results by batch: a batch that is run again replaces its own folder, so nothing is doubled."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_analysis(stream: DataFrame, analyse: Callable[[DataFrame, int], None], folder: str, every: int = 3) -> None:
    """Run a bounded stream to its end; ``analyse`` gets the rows of every ``every`` batches that had any, and at the end what is left.

    Rows wait in a table below ``folder``, and a mark tells the last batch that was analysed, so a run that was broken off loses
    nothing. The second argument of ``analyse`` is that batch's number: it may come twice with the same rows after a failure.
    """
    spark, held, marks = stream.sparkSession, f"{folder}/held", f"{folder}/marks"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{held}/batch=-1")
    spark.range(-1, 0).write.mode("append").parquet(marks)

    def flush(least: int) -> None:
        done = spark.read.parquet(marks).agg(F.max("id")).first()[0]
        rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(held).filter(F.col("batch") > done)
        n, last = rows.agg(F.countDistinct("batch"), F.max("batch")).first()
        if n >= least:
            analyse(rows.drop("batch"), last)
            spark.range(last, last + 1).write.mode("append").parquet(marks)

    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{held}/batch={batch_id}")
            flush(every)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    flush(1)


def stream_tracks(obs: DataFrame, factor: float = 1.5, max_gap: int = 1) -> DataFrame:
    """grp, track, id, x, center: the open-track rule of batch linking, as frames arrive in order.

    State of a group: its open tracks (number, last x, centre, width) and the next number; tracks retire at a gap.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, xs, cs, ws, nxt = state.get if state.exists else ([], [], [], [], 0)
        live = list(zip(numbers, xs, cs, ws))
        out = []
        for x, rows in pd.concat(list(batches)).groupby("x", sort=True):
            live = [t for t in live if x - t[1] <= max_gap + 1]
            peaks = list(rows.sort_values(["center", "id"])[["id", "center", "fwhm"]].itertuples(index=False, name=None))
            used_j = {j: i for i, j in closest_first([t[2] for t in live], [t[3] for t in live], [p[1] for p in peaks], [p[2] for p in peaks], factor)}
            for j, (pid, c, w) in enumerate(peaks):
                if j in used_j:
                    i = used_j[j]
                    live[i] = (live[i][0], x, c, w)
                    number = live[i][0]
                else:
                    number, nxt = nxt, nxt + 1
                    live.append((number, x, c, w))
                out.append((int(key[0]), int(number), int(pid), float(x), float(c)))
        state.update(([int(t[0]) for t in live], [float(t[1]) for t in live], [float(t[2]) for t in live], [float(t[3]) for t in live], int(nxt)))
        yield pd.DataFrame(out, columns=["grp", "track", "id", "x", "center"])

    return obs.groupBy("grp").applyInPandasWithState(
        step, "grp long, track long, id long, x double, center double", "numbers array<long>, xs array<double>, cs array<double>, ws array<double>, nxt long", "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a bounded stream to its end into a table in the shared folder."""
    path = scratch(stream.sparkSession)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
