"""Streaming forms: repetition over fragments, admission per client, windowed counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import stripped_words

FEED_OUT = "key long, seq long, line string, match_count int, action string"
FEED_STATE = "rest string, sets array<array<long>>, stopped boolean"
LEAST_CHARS = 20


class Feed:
    """One text that arrives in fragments: a line is judged when its end has come, by the
    word sets in a ring of the last `window` lines (0: all). A fragment gives at most one
    detection; the ended lines behind it wait for the next fragment. After a detection
    with action `stop` nothing is judged any more."""

    def __init__(self, window=20, threshold=3, similarity=0.7, action="escape", rest="", sets=(), stopped=False):
        self.threshold, self.similarity, self.action = threshold, similarity, action
        self.ring = deque(map(frozenset, sets), maxlen=window or None)
        *ended, self.tail = rest.split("\n")
        self.waiting, self.stopped = deque(ended), stopped

    @property
    def rest(self) -> str:
        """What has come and isn't judged."""
        return "\n".join([*self.waiting, self.tail])

    def reset(self) -> None:
        """Forgets the text: the next fragment begins another."""
        self.ring.clear()
        self.waiting.clear()
        self.tail, self.stopped = "", False

    def push(self, fragment: str) -> tuple[str, int] | None:
        if not self.stopped:
            *ended, self.tail = (self.tail + fragment).split("\n")
            self.waiting.extend(ended)
        found = None
        while found is None and self.waiting and not self.stopped:
            found = self._judged(self.waiting.popleft())
        self.stopped |= found is not None and self.action == "stop"
        return found

    def _judged(self, raw: str) -> tuple[str, int] | None:
        line, words = stripped_words(raw)
        if len(line) < LEAST_CHARS or not words:
            return None
        shared = np.array([len(words & past) for past in self.ring], float)
        either = np.array([len(past) for past in self.ring], float) + len(words) - shared
        matches = int(np.count_nonzero(shared / either >= self.similarity))
        self.ring.append(words)
        return (line, matches) if matches >= self.threshold else None


def detect(fragments: DataFrame, action: str = "escape", idle: str | None = None, **options) -> DataFrame:
    """fragments (key, seq, chunk), a stream: a row for each detection. A null chunk resets
    its key. Fragments of a micro-batch are taken by seq; across batches they must come in
    order. With idle (as "5 minutes") the state of a key that gets nothing for so long goes."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rest, sets, stopped = state.get if state.exists else ("", [], False)
        feed, rows = Feed(action=action, rest=rest, sets=sets, stopped=stopped, **options), []
        for part in sorted([x for b in batches for x in zip(b["seq"], b["chunk"], strict=True)], key=lambda x: x[0]):
            if part[1] is None:
                feed.reset()
            elif found := feed.push(part[1]):
                rows.append((key[0], part[0], *found, action))
        state.update((feed.rest, [sorted(s) for s in feed.ring], feed.stopped))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(rows, columns=["key", "seq", "line", "match_count", "action"])

    return fragments.groupBy("key").applyInPandasWithState(step, FEED_OUT, FEED_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def _hits(us: np.ndarray, window_us: int) -> np.ndarray:
    """Of requests in order: how many of them, up to and with each, are less than the window old."""
    if window_us <= 0:
        return np.ones(len(us), np.int64)
    return np.arange(1, len(us) + 1) - np.searchsorted(us, us - window_us, "right")


ADMITTED = "client long, id long, hits long, allowed boolean, revision long"


def admit(requests: DataFrame, window_us: int, most: int, late_us: int | None = None, idle: str | None = None) -> DataFrame:
    """requests (client, id, us), a stream in any order: client, id, hits, allowed, revision.

    Every request is answered in its batch. One that comes late changes the counts of the
    client's later ones, which are answered again with a higher revision: the last answers
    are those of the batch operator, whatever the order (see revised_to_end()). With
    late_us, requests more than that behind the client's newest are left out and state
    holds late_us and a window; else (a bounded table) all of the client's requests. With
    idle the state of a client that sends nothing for so long goes."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held_us, held_ids, revision = state.get if state.exists else ([], [], 0)
        came = pd.concat([b[["us", "id"]] for b in batches])
        us = np.concatenate([np.array(held_us, np.int64), came["us"].to_numpy(np.int64)])
        ids = np.concatenate([np.array(held_ids, np.int64), came["id"].to_numpy(np.int64)])
        before = np.concatenate([_hits(us[: len(held_us)], window_us), np.zeros(len(came), np.int64)])
        if late_us is not None:
            fresh = us >= us.max() - late_us - window_us
            fresh[len(held_us) :] &= us[len(held_us) :] >= us.max() - late_us
            us, ids, before = us[fresh], ids[fresh], before[fresh]
        order = np.lexsort((ids, us))
        us, ids, before = us[order], ids[order], before[order]
        hits = _hits(us, window_us)
        # what lost old requests from state keeps its answer; counts only grow otherwise
        new = hits > before
        state.update((us.tolist(), ids.tolist(), revision + 1))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({"client": key[0], "id": ids[new], "hits": hits[new], "allowed": hits[new] <= most, "revision": revision})

    return requests.groupBy("client").applyInPandasWithState(step, ADMITTED, "us array<long>, ids array<long>, revision long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Counts by event_type in tumbling windows; rows later than the watermark are left out,
    none if late is None (for a bounded table, as all windows stay in state).
    ts without a zone is taken as UTC."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    t = t if late is None else t.withWatermark("ts", late)
    return t.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def fragments_of(texts: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages as fragments, with a line end after each."""
    return texts.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("seq"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("chunk"))


def source(spark, sf_dir: str, name: str, files_a_trigger: int = 4) -> DataFrame:
    """A table's files as a stream, a bounded number of files at a time."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a table in one file


def run_to_end(stream: DataFrame, name: str, wait_s: int = 3600) -> DataFrame:
    """Runs a stream over what is there now, into files in the shared folder, and reads them."""
    base = _base(stream, name)
    _ended(stream.writeStream.outputMode("append").option("path", f"{base}/rows").format("parquet"), base, name, wait_s)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


def revised_to_end(stream: DataFrame, name: str, keys: list[str], wait_s: int = 3600) -> DataFrame:
    """run_to_end() for rows that are answered again: each key's row of the last revision."""
    rows = run_to_end(stream, name, wait_s)
    rest = [c for c in rows.columns if c not in (*keys, "revision")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("last")).select(*keys, "last.*")


def counts_to_end(stream: DataFrame, name: str, wait_s: int = 3600) -> DataFrame:
    """The same for counts n that grow from batch to batch: every group with its last count,
    whatever the order of the rows. Each batch writes the groups that it changed."""
    base = _base(stream, name)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    _ended(stream.writeStream.outputMode("update").foreachBatch(write), base, name, wait_s)
    spark = stream.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):  # no batch
        return spark.createDataFrame([], stream.schema)
    keys = [c for c in stream.columns if c != "n"]
    return spark.read.schema(stream.schema).parquet(f"{base}/rows").groupBy(*keys).agg(F.max("n").alias("n"))


def _base(stream: DataFrame, name: str) -> str:
    import uuid

    from sparkloom.session import shared_folder

    return f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _ended(writer, base: str, name: str, wait_s: int) -> None:
    q = writer.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").start()
    if not q.awaitTermination(wait_s):
        q.stop()
        raise TimeoutError(f"{name} did not come to its end in {wait_s} s")


__all__ = ["Feed", "admit", "counts_to_end", "detect", "fragments_of", "revised_to_end", "run_to_end", "source", "windowed_counts"]
