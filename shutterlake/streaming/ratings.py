"""Streams of rating commands and metadata events.

Event time stands for arrival time. The delay of a watermark is a parameter, and what comes
later than it is dropped by Spark; ``LateCounts`` has the counts as a table.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from shutterlake import schemas
from shutterlake.operators.journal import IMAGE, journal_ratings, latest_command, owner_revisions
from shutterlake.operators.ratings import merge_rating_layers
from shutterlake.sources import parts as parts_of
from shutterlake.sources.catalog import read_state, write_state
from shutterlake.sources.parts import place

DEBOUNCE = "400 milliseconds"
#: Commands that one range of sequence numbers holds on average.
RANGE_ROWS = 50_000


def debounce_ratings(commands: DataFrame, gap: str = DEBOUNCE, delay: str | None = None) -> DataFrame:
    """owner, due, seq, rating: the last command before each pause of ``gap`` (every command
    starts the wait anew). Works on tables, and on streams with a watermark ``delay``."""
    # A cast would take a stream's watermark away.
    timed = commands if dict(commands.dtypes)["ts"] == "timestamp" else commands.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if delay else timed
    last = timed.groupBy("owner", F.session_window("ts", gap).alias("w")).agg(F.max_by(F.struct("seq", "rating"), "seq").alias("c"))
    return last.select("owner", F.col("w.end").alias("due"), "c.seq", "c.rating")


def commands_in_time(commands: DataFrame, delay: str) -> DataFrame:
    """A stream's commands without those that come later than ``delay`` behind the newest, and
    without repeated numbers (``seq``). This step drops late rows one by one, so that their
    count is exact; nothing is late for what follows, ``debounce_ratings`` without a delay."""
    timed = commands if dict(commands.dtypes)["ts"] == "timestamp" else commands.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["seq"])


class LateCounts(StreamingQueryListener):
    """Counts what streams leave out: rows behind the watermark, and observed late commands.
    Register it with ``spark.streams.addListener``; ``table`` has a row for each batch of a
    query: query, batch, watermark, dropped, late."""

    SCHEMA = "query string, batch bigint, watermark string, dropped bigint, late bigint"

    def __init__(self):
        self.rows: list[tuple] = []

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        late = p.observedMetrics.get("late")
        self.rows.append((str(p.id), p.batchId, p.eventTime.get("watermark"), dropped, late["late"] if late else 0))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)


def debounce_with_flush(commands: DataFrame, gap_ms: int = 400) -> DataFrame:
    """The same over a table where rows of kind ``flush`` make everything pending of their
    library due at once: library, owner, seq, rating, due.

    A library's flushes are counted in ranges of ``seq`` first, so no task sees all of a
    library's commands."""
    n, low, high = commands.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * RANGE_ROWS // max(n, 1))
    ranged = commands.withColumn("_r", F.floor((F.col("seq") - F.lit(low or 0)) / width)).withColumn("_one", (F.col("kind") == "flush").cast("bigint"))
    sums = ranged.groupBy("library", "_r").agg(F.sum("_one").alias("_n"))
    before = sums.select("library", "_r", (F.sum("_n").over(Window.partitionBy("library").orderBy("_r")) - F.col("_n")).alias("_before"))
    inside = F.sum("_one").over(Window.partitionBy("library", "_r").orderBy("seq"))
    counted = ranged.withColumn("_in", inside).join(before, ["library", "_r"]).withColumn("_f", F.col("_before") + F.col("_in")).drop("_r", "_one", "_in", "_before")
    marks = counted.filter("kind = 'flush'").select("library", (F.col("_f") - 1).alias("_f"), F.col("ts").alias("_flush"))
    ratings = counted.filter("kind = 'rate'")
    order = Window.partitionBy("library", "owner").orderBy("seq")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    pause = ms("ts") - F.lag(ms("ts")).over(order) > gap_ms
    fresh = F.coalesce(pause | (F.col("_f") != F.lag("_f").over(order)), F.lit(True))
    session = ratings.withColumn("_new", fresh.cast("int")).withColumn("_s", F.sum("_new").over(order))
    last = session.groupBy("library", "owner", "_s").agg(F.max_by(F.struct("seq", "rating", "ts", "_f"), "seq").alias("c")).select("library", "owner", "c.*")
    due = F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.lit(gap_ms / 1000).cast("decimal(18,6)"))
    return last.join(marks, ["library", "_f"], "left").select("library", "owner", "seq", "rating", F.least(due, F.col("_flush").cast("timestamp")).alias("due"))


def settle(pending: dict[str, tuple[int, int, int]], rows: list[tuple], gap_ms: int) -> tuple[list[tuple], int]:
    """(owner, seq, rating, due) of what falls due while rows (ts_ms, seq, owner, rating; owner
    None: a flush) arrive, and the steps taken. ``pending`` (owner: seq, rating, due) is changed
    in place. Due times wait in a heap, in which an owner's older entries are passed over, so
    each row and each pending owner costs one entry."""
    waits = [(due, owner) for owner, (_, _, due) in pending.items()]
    heapq.heapify(waits)
    out, steps = [], len(waits)

    def emit(until: int | None, at: int | None = None) -> None:
        nonlocal steps
        while waits and (until is None or waits[0][0] <= until):
            due, owner = heapq.heappop(waits)
            steps += 1
            if owner in pending and pending[owner][2] == due:
                seq, rating, _ = pending.pop(owner)
                out.append((owner, seq, rating, due if at is None else min(due, at)))

    for ts, seq, owner, rating in rows:
        steps += 1
        emit(ts - 1)  # waits that ended before
        if owner is None:
            emit(None, ts)
        else:
            pending[owner] = (seq, rating, ts + gap_ms)
            heapq.heappush(waits, (ts + gap_ms, owner))
    return out, steps


class FlushDebouncer(StatefulProcessor):
    """Pending ratings of one part of a library's owners. They are read and written once for
    each call, and one timer waits for the earliest of them."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "owner string, seq bigint, rating int, due bigint")

    def _advance(self, library: str, rows: list[tuple], until: int | None) -> pd.DataFrame:
        pending = {owner: (seq, rating, due) for owner, seq, rating, due in self.pending.get()} if self.pending.exists() else {}
        out, _ = settle(pending, rows, self.gap_ms)
        if until is not None:
            out += [(owner, *v) for owner, v in pending.items() if v[2] <= until]
            pending = {owner: v for owner, v in pending.items() if v[2] > until}
        self.pending.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if pending:
            self.pending.put([(owner, *v) for owner, v in pending.items()])
            self.handle.registerTimer(min(v[2] for v in pending.values()) + 1)
        return pd.DataFrame([(library, *o) for o in out], columns=["library", "owner", "seq", "rating", "due_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken = [(int(ts), int(seq), None, None) if kind == "flush" else (int(ts), int(seq), owner, int(rating)) for part in rows for ts, seq, owner, rating, kind in zip(part.ts_ms, part.seq, part.owner, part.rating, part.kind)]
        yield self._advance(key[0], sorted(taken, key=lambda r: r[1]), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key[0], [], max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - 1)

    def close(self) -> None:
        pass


def debounce_with_flush_stream(commands: DataFrame, gap_ms: int = 400, delay: str = "1 second", parts: int = 16) -> DataFrame:
    """library, owner, seq, rating, due_ms from a stream of library, owner, seq, kind, rating, ts.

    A library's owners are dealt into ``parts`` by their hash, each with its own state, and a
    flush is copied to every part, so a large library isn't one task."""
    timed = commands.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts"))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = timed.withColumn("part", F.explode(F.when(F.col("kind") == "flush", every).otherwise(F.array(place(F.col("owner"), parts)))))
    return dealt.groupBy("library", "part").transformWithStateInPandas(
        FlushDebouncer(gap_ms), "library string, owner string, seq bigint, rating int, due_ms bigint", "Append", "EventTime"
    )


class LateFilter(StatefulProcessor):
    """The highest sequence number of each owner so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("seq")
        last = self.last.get()[0] if self.last.exists() else -1
        late = ~((every.seq > last) & ~every.seq.duplicated())
        if not late.all():
            self.last.update((int(every.seq.max()),))
        yield every.assign(late=late)[["owner", "seq", "rating", "late"]]

    def close(self) -> None:
        pass


def late_commands_stream(commands: DataFrame) -> DataFrame:
    """Commands (owner, seq, rating) that none of an equal or higher number preceded. The others
    are counted in the observed metric ``late``."""
    told = commands.groupBy("owner").transformWithStateInPandas(LateFilter(), "owner string, seq bigint, rating int, late boolean", "Append", "None")
    return told.observe("late", F.count_if("late").alias("late")).filter("NOT late").drop("late")


def first_metadata_fill(events: DataFrame, persisted: DataFrame, explicit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata, ratings): the last metadata event of each photo (folder, idx, seq, rating
    and more), and ratings in which metadata only fills what is missing."""
    rest = [c for c in events.columns if c not in ("folder", "idx")]
    meta = events.groupBy("folder", "idx").agg(F.max_by(F.struct(*rest), "seq").alias("m")).select("folder", "idx", "m.*")
    # Ratings are filled by the first event that has one; later ones find a value.
    own = events.filter("rating > 0").groupBy("folder", "idx").agg(F.min_by("rating", "seq").alias("rating"))
    return meta, merge_rating_layers(persisted, own, explicit)


class FirstFill(StatefulProcessor):
    """Of one photo: the number of its newest metadata, and whether a rating was filled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.photo = handle.getValueState("photo", "seq bigint, filled boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, filled = self.photo.get() if self.photo.exists() else (None, False)
        newest, first = None, None
        for part in rows:
            last = part.loc[[part.seq.idxmax()]]
            newest = last if newest is None or last.seq.iloc[0] > newest.seq.iloc[0] else newest
            rated = part[part.rating > 0]
            if len(rated) and not filled:
                own = rated.loc[[rated.seq.idxmin()]]
                first = own if first is None or own.seq.iloc[0] < first.seq.iloc[0] else first
        if first is not None:
            yield first.assign(change="fill", rating=first.rating.clip(upper=5))
        if seq is None or newest.seq.iloc[0] > seq:
            seq = int(newest.seq.iloc[0])
            yield newest.assign(change="metadata")
        self.photo.update((seq, bool(filled or first is not None)))

    def close(self) -> None:
        pass


def metadata_changes_stream(events: DataFrame) -> DataFrame:
    """From a stream of events (folder, idx, seq, rating and more; seq: order of arrival) those
    that change something: ``change`` is metadata for an event newer than all before, and fill
    for the first one with a rating, once for each photo however long ago that was."""
    schema = T.StructType([*events.schema.fields, T.StructField("change", T.StringType())])
    return events.groupBy("folder", "idx").transformWithStateInPandas(FirstFill(), schema, "Append", "None")


def first_metadata_fill_stream(events: DataFrame, ratings: Callable[[], DataFrame], root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keeps ``first_metadata_fill`` of a stream in tables below ``root``. ``ratings`` gives the
    persisted and explicit ratings (folder, idx, rating) of now: each micro-batch joins its
    fills with them, and those that find a rating are not installed, now or later."""

    def step(batch: DataFrame, n: int) -> None:
        batch.persist()
        known = ratings().filter("rating IS NOT NULL").select("folder", "idx")
        fills = batch.filter("change = 'fill'").join(known, ["folder", "idx"], "left_anti").select("folder", "idx", "seq", "rating")
        # A batch that runs again writes its folders again.
        fills.write.mode("overwrite").parquet(f"{root}/fills/batch={n}")
        batch.filter("change = 'metadata'").drop("change").write.mode("overwrite").parquet(f"{root}/metadata/batch={n}")
        batch.unpersist()

    writer = metadata_changes_stream(events).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def filled_metadata(spark: SparkSession, root: str, persisted: DataFrame, explicit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata, ratings) as ``first_metadata_fill`` gives them, from the stream's tables."""
    meta = spark.read.option("basePath", f"{root}/metadata").parquet(f"{root}/metadata").drop("batch")
    rest = [c for c in meta.columns if c not in ("folder", "idx")]
    newest = meta.groupBy("folder", "idx").agg(F.max_by(F.struct(*rest), "seq").alias("m")).select("folder", "idx", "m.*")
    return newest, merge_rating_layers(persisted, spark.read.parquet(f"{root}/fills").select("folder", "idx", "rating"), explicit)


def metadata_failures(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, failed) events."""
    return events.filter("event_type <> 'failed'"), events.filter("event_type = 'failed'")


def start_parts(images: DataFrame, root: str, parts: int) -> None:
    """The state before the first batch, in ``parts`` parts by owner: images, where each path
    lies, and no owner revisions. Nothing is done if it is there."""
    spark = images.sparkSession
    if parts_of.batches(spark, root):
        return
    own = images.select(*IMAGE, parts_of.place(F.coalesce("sidecar_owner", "path"), parts).alias("part"))
    entries = parts_of.write_parts(own, root, -1, "images")
    paths = own.select("path", F.col("part").alias("lies"), parts_of.place(F.col("path"), parts).alias("part"))
    parts_of.put_manifest(spark, root, -1, entries | parts_of.write_parts(paths, root, -1, "paths"), 0)


def journal_batch(batch: DataFrame, root: str, n: int, parts: int) -> None:
    """Journals batch n of commands on the state of batch n - 1. Only the parts of its owners
    are read and written, those that hold its paths' rows now, and the parts that tell where
    these lie. A batch that has its manifest is done."""
    spark = batch.sparkSession
    done = parts_of.batches(spark, root)
    if n in done:
        return
    before, counter = parts_of.read_manifest(spark, root, max(b for b in done if b < n))
    read = lambda table, schema, which: parts_of.read_parts(spark, root, before, table, schema, which)
    batch = batch.persist()
    numbers = lambda df: {r[0] for r in df.distinct().collect()}  # noqa: E731, of parts
    own = numbers(batch.select(parts_of.place(F.col("owner"), parts)))
    by_path = numbers(batch.select(parts_of.place(F.col("path"), parts)))
    lie = read("paths", "path string, lies int", by_path)
    touched = own | numbers(lie.join(batch, "path", "left_semi").select("lies"))
    images = journal_ratings(read("images", schemas.IMAGES, touched), batch)
    new = latest_command(batch).select("path", parts_of.place(F.col("owner"), parts).alias("lies"))
    paths = lie.join(new, "path", "left_anti").unionByName(new)
    ledger = owner_revisions(batch.withColumn("_key", F.coalesce("path", F.lit(""))), read("owners", schemas.OWNER_REVISIONS, own), counter, tie="_key")
    tables = {
        "images": images.withColumn("part", parts_of.place(F.coalesce("sidecar_owner", "path"), parts)),
        "paths": paths.withColumn("part", parts_of.place(F.col("path"), parts)),
        "owners": ledger.withColumn("part", parts_of.place(F.col("owner"), parts)),
    }
    after = {k: f for k, f in before.items() if k[1] not in {"images": touched, "paths": by_path, "owners": own}[k[0]]}
    for table, frame in tables.items():
        after |= parts_of.write_parts(frame, root, n, table)
    parts_of.put_manifest(spark, root, n, after, counter + batch.count())
    batch.unpersist()
    parts_of.expire(spark, root)


def journal_parts_stream(commands: DataFrame, images: DataFrame, root: str, checkpoint: str, parts: int = 1024, interval: str | None = None) -> StreamingQuery:
    """Journals each micro-batch of commands (seq, owner, path, size, mtime_ns, rating) into the
    parts below ``root`` that it touches; ``images`` is the state before the first one."""
    start_parts(images, root, parts)
    writer = commands.writeStream.foreachBatch(lambda batch, n: journal_batch(batch, root, n, parts)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def journal_state(spark: SparkSession, root: str, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, owner revisions) after batch n, by default the last one."""
    entries, _ = parts_of.read_manifest(spark, root, parts_of.batches(spark, root)[-1] if n is None else n)
    return parts_of.read_parts(spark, root, entries, "images", schemas.IMAGES), parts_of.read_parts(spark, root, entries, "owners", schemas.OWNER_REVISIONS)


def journal_stream(commands: DataFrame, images: DataFrame, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Journals each micro-batch into a new snapshot of ``images`` below ``root``: what has
    arrived, and then it ends, or it goes on each ``interval``. The name of the snapshot
    after batch n is stored under ``root/after/n``, so that a batch that runs again starts
    from the same snapshot and gives the same result. Every batch writes the whole state: it is
    for small ones, ``journal_parts_stream`` for all others."""
    spark = commands.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        before = images
        if n:
            folder = spark.read.text(f"{root}/after/{n - 1}").first()[0]
            before = read_state(spark, folder, "images")["images"]
        folder = write_state({"images": journal_ratings(before, batch)}, root)
        spark.createDataFrame([(folder,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/after/{n}")

    writer = commands.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
