"""Keyed state of streams: revisions and the greedy two-key deduplication, in a state store whose work follows the batch.

Keys are dealt to buckets; a bucket holds a map state by key.  A micro-batch reads and writes the entries of the keys that it has,
never the others, and a bucket's rows are handled as columns.  The number of buckets is part of the stored state: a
query goes on with the one that it began with.  Both need the RocksDB state store (`stateful`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.history import filter_new
from tidemark.operators.storage import stored

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of a state: tasks at most, and calls a batch.
BUCKETS = 64


def stateful(spark: SparkSession) -> None:
    """Sets the state store that map states need, unless another than Spark's first choice is set."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, PROVIDER)


def _of(types: StructType, *names: str) -> str:
    return ", ".join(f"{new} {types[name].dataType.simpleString()}" for new, name in zip(("a", "b"), names, strict=False))


@contextmanager
def _only_data(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside run no batches without rows: with entries that expire these would go on without an end."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _plain(value):
    """A value for the store: pandas' own scalars and gaps aren't."""
    if pd.isna(value):
        return None
    return value.item() if hasattr(value, "item") and not isinstance(value, pd.Timestamp) else value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


def _frame(rows: Iterator[pd.DataFrame], names: Sequence[str]) -> pd.DataFrame:
    """A call's rows by position: Spark passes computed columns without their names, and the bucket last."""
    frame = pd.concat(list(rows), ignore_index=True).iloc[:, : len(names)]
    return frame.set_axis(list(names), axis=1)


class _Revisions(StatefulProcessor):
    """Of each key the seq and content of its last row."""

    def __init__(self, key: str, seq: str, content: str, types: StructType, ttl: int | None):
        self.names, self.kinds, self.ttl = (key, seq, content), (_of(types, key), _of(types, seq, content)), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", *self.kinds, self.ttl)

    def handleInputRows(self, bucket, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        key, seq, content = self.names
        frame = _frame(rows, self.names).sort_values(seq, kind="stable", ignore_index=True)
        codes, keys = pd.factorize(frame[key], use_na_sentinel=False)
        before = [self.last.getValue((_plain(k),)) for k in keys]
        # Rows that aren't late, key after key, each key's in the order of seq.
        known = np.array([b is not None for b in before])[codes]
        limit = pd.Series([frame[seq].iloc[0] if b is None else b[0] for b in before], dtype=frame[seq].dtype).take(codes).to_numpy()
        at = np.flatnonzero(~known | (frame[seq].to_numpy() > limit))
        at = at[np.argsort(codes[at], kind="stable")]
        if not len(at):
            return
        frame, codes = frame.iloc[at], codes[at]
        first = np.append(True, codes[1:] != codes[:-1])
        last = np.append(first[1:], True)
        values = pd.factorize(pd.concat([frame[content], pd.Series([None if b is None else b[1] for b in before], dtype=object)]))[0]
        own, old = values[: len(at)], values[len(at) :][codes]
        changed = np.where(first, ~known[at] | (own != old), own != np.append(0, own[:-1]))
        for row in frame[last].itertuples(index=False, name=None):
            self.last.updateValue((_plain(row[0]),), (_plain(row[1]), _plain(row[2])))
        yield frame[changed]

    def close(self) -> None:
        pass


class _Taken(StatefulProcessor):
    """The keys of rows taken: marks enter theirs and go on, other rows go on if theirs isn't entered."""

    def __init__(self, key: str, types: StructType, ttl: int | None):
        self.key, self.kind, self.names, self.ttl = key, _of(types, key), types.names, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", self.kind, "at boolean", self.ttl)

    def handleInputRows(self, bucket, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = _frame(rows, self.names)
        marks = frame["_mark"].astype(bool)
        for value in frame.loc[marks, self.key].dropna().unique():
            self.taken.updateValue((_plain(value),), (True,))
        asked = frame.loc[~marks, self.key].dropna().unique()
        held = {value for value in asked if self.taken.containsKey((_plain(value),))}
        yield frame[marks | ~frame[self.key].isin(held)][self.names]

    def close(self) -> None:
        pass


def _kept(stream: DataFrame, dealt: Column, processor: StatefulProcessor, buckets: int) -> DataFrame:
    """stream through a processor, a bucket of hashes a call."""
    mode = "none" if processor.ttl is None else "processingTime"
    grouped = stream.withColumn("_bucket", F.pmod(dealt, F.lit(buckets))).groupBy("_bucket")
    return grouped.transformWithStateInPandas(processor, stream.schema, "Append", mode)


def _milliseconds(max_age_days: int | None) -> int | None:
    """Entries live three times max_age_days."""
    return None if max_age_days is None else int(timedelta(days=3 * max_age_days) / timedelta(milliseconds=1))


def revised(stream: DataFrame, key: str, seq: str, content: str, max_age_days: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, seq, content) of the rows whose content differs from the row before of their key, a streaming DataFrame.

    Within a micro-batch rows count in the order of seq; a row whose seq isn't above the last of its key is late and doesn't count.
    With max_age_days a key that has no row for three times as long is forgotten, and its next row is new.  Null keys are one key, and null
    contents are equal.  A bucket's rows of one batch are in memory at once, as three columns: limit the files a trigger.
    """
    stateful(stream.sparkSession)
    rows = stream.select(key, seq, content)
    return _kept(rows, F.xxhash64(key), _Revisions(key, seq, content, rows.schema, _milliseconds(max_age_days)), buckets)


def _decide(batch: DataFrame, n: int, identity: str, fingerprint: str, seq: str, folder: str) -> None:
    """Writes the batch's rows that filter_new takes, under the batch's number: a batch that is run again gives the same.

    A batch of marks alone writes no file, or it would be the next batch's input, without an end.
    """
    rows = stored(batch.where(~F.col("_mark")).drop("_mark"), "fresh")
    if rows.isEmpty():
        return
    filter_new(rows, rows.limit(0), identity, fingerprint, seq).write.mode("overwrite").parquet(f"{folder}/taken/batch-{n:09d}")


def take_new(
    stream: DataFrame, identity: str, fingerprint: str, seq: str, folder: str, checkpoint: str,
    max_age_days: int | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Runs filter_new over all that stream has, micro-batch by micro-batch, and returns all rows taken so far, those of earlier runs too.

    The order is that of the batches, then of seq.  Every batch goes through two keyed states, of the identities and of the fingerprints
    of rows taken; rows that neither knows meet in filter_new, and what it takes is written below `folder`.  These rows are the
    stream's other input: the next batch enters their keys in both states before it looks its own up.  So a row that is
    turned down never blocks another, and a batch looks up its own keys and no others.

    A null key matches nothing.  With max_age_days a key is forgotten three times as long after it was taken.  `folder` and `checkpoint` belong
    together and are in the shared storage; a run that ends in the middle of a batch goes on with that batch.
    """
    spark = stream.sparkSession
    stateful(spark)
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/taken/batch-none")
    marks = spark.readStream.schema(stream.schema).parquet(f"{folder}/taken/batch-*")
    both = stream.withColumn("_mark", F.lit(False)).unionByName(marks.withColumn("_mark", F.lit(True)))
    for key in (identity, fingerprint):
        # Rows without a key match nothing, so they are dealt by all that they hold.
        dealt = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*both.columns))
        both = _kept(both, dealt, _Taken(key, both.schema, _milliseconds(max_age_days)), buckets)
    step = partial(_decide, identity=identity, fingerprint=fingerprint, seq=seq, folder=folder)
    with _only_data(spark):
        query = both.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
    try:
        # Not availableNow: that would fix the files of both inputs at the start, and a batch must see what the one before wrote.
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/taken/batch-*")


def run_to(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """All rows that a streaming DataFrame has given to a folder of files, after it has run over what is there now."""
    sink = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    with _only_data(stream.sparkSession):
        query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
