"""Streams with state by key: page versions, leases and results kept until they expire.

State lies with the stream's checkpoint, so that a stream that stops goes on where it was, on other executors if need be, and a
batch costs what it changes. Every processor works on the events of a key in order; what one key's state holds is bounded as
each class says.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB; the caller's own settings stay as they are."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return session


class _Versions(StatefulProcessor):
    """State of a key: the latest hash, its version and the greatest order seen; one row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "hash string, version long, seen long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, version, seen = self.latest.get() if self.latest.exists() else (None, 0, None)
        for order, body in sorted((r.seen, r.hash) for r in rows):
            if seen is not None and order <= seen:
                continue
            seen = order
            if body != held:
                held, version = body, version + 1
                yield Row(key=key[0], hash=held, version=version, seen=order)
        if version:
            self.latest.update((held, version, seen))

    def close(self) -> None:
        pass


def page_versions(pages: DataFrame, key: str, body: str, seen: str) -> DataFrame:
    """key, hash, version, seen of a stream of pages: a row where a page's content is not what it was before.

    `seen` is a whole number that grows with time. What isn't newer than the newest row of its key that was seen in an earlier
    place is late or repeated and adds nothing; of rows with one key and `seen`, that with the least hash counts. Null keys,
    bodies and numbers are left out. Only hashes go through state."""
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.sha2(body, 256).alias("hash"), F.col(seen).cast("long").alias("seen")).filter("key is not null and hash is not null and seen is not null")
    return rows.groupBy("key").transformWithState(_Versions(), f"key {kind}, hash string, version long, seen long", "Append", "None")


class _InOrder(StatefulProcessor):
    """Handles the events of a key in order of time and id. They come once the watermark has passed them, so that those of a later
    batch are later ones; what one key's state holds is read once and written once a batch. What they get goes back as one row
    of arrays, as Python's rows are dear."""

    columns: tuple[str, ...]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.handled(sorted(tuple(r[1:]) for r in rows))
        yield Row("key", *self.columns)(key[0], *map(list, zip(*found, strict=True)))

    def handled(self, events: list[tuple]) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Leases(_InOrder):
    """State of a limiter: the leases held, no more than its limit; those that have expired go when the next event comes."""

    columns = ("at", "id", "action", "scope", "answer", "held")

    def __init__(self, most: int, most_of_scope: int | None, ttl: int):
        self.most, self.most_of_scope, self.ttl = most, most_of_scope, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leases = handle.getValueState("leases", "held array<struct<id: string, scope: string, expires: long>>")

    def handled(self, events: list[tuple]) -> Iterator[tuple]:
        held = self.leases.get()
        open_ = {id_: (scope, expires) for id_, scope, expires in held[0]} if held else {}
        before = dict(open_)
        for at, id_, action, scope in events:
            open_ = {k: v for k, v in open_.items() if v[1] > at}
            if action == "give":
                answer = "returned" if open_.pop(id_, None) else "unknown"
            elif id_ in open_:
                answer = "held"
            else:
                room = len(open_) < self.most
                if self.most_of_scope is not None:
                    room = room and sum(s == scope for s, _ in open_.values()) < self.most_of_scope
                answer = "granted" if room else "refused"
                if room:
                    open_[id_] = (scope, at + self.ttl)
            yield at, id_, action, scope, answer, len(open_)
        if not open_ and before:
            self.leases.clear()
        elif open_ != before:
            self.leases.update(([(k, *v) for k, v in open_.items()],))


class _Memo(_InOrder):
    """State of a call's arguments: when the result that is kept was made and when it expires; two numbers."""

    columns = ("at", "id", "hit", "made")

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "at long, expires long")

    def handled(self, events: list[tuple]) -> Iterator[tuple]:
        before = self.kept.get() or (None, None)
        made, expires = before
        for at, id_, *_ in events:
            hit = expires is not None and at < expires
            if not hit:
                made, expires = at, at + self.ttl
            yield at, id_, hit, made
        if made != before[0]:
            self.kept.update((made, expires))


def _events(stream: DataFrame, key: str, at: str, id_: str, late: str, **more: str | None) -> DataFrame:
    """Events as `_InOrder` takes them: those of a key and millisecond together, once the watermark has passed them; those
    without key, time or id are left out.

    The engine's own aggregation holds them back, so that Python sees each event once and keeps no timers."""
    time = F.timestamp_millis(F.unix_millis(F.col(at).cast("timestamp")))
    text = lambda c: F.lit(None).cast("string") if c is None else F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = stream.select(F.col(key).alias("key"), time.alias("time"), F.col(id_).cast("string").alias("id"), *(text(c).alias(name) for name, c in more.items()))
    rows = rows.filter("key is not null and time is not null and id is not null").withWatermark("time", late)
    passed = rows.groupBy("key", "time").agg(F.collect_list(F.struct(*rows.columns[2:])).alias("events"))
    return passed.select("key", F.unix_millis("time").alias("at"), F.inline("events"))


def _answered(events: DataFrame, processor: _InOrder, key: str, kinds: str) -> DataFrame:
    """key and a processor's columns for each event."""
    kind = events.schema["key"].dataType.simpleString()
    out = ", ".join(f"{c} array<{k}>" for c, k in zip(processor.columns, kinds.split(), strict=True))
    found = events.groupBy("key").transformWithState(processor, f"key {kind}, {out}", "Append", "None")
    return found.select(F.col("key").alias(key), F.inline(F.arrays_zip(*processor.columns)))


def leases(stream: DataFrame, limiter: str, at: str, id_: str, action: str, scope: str | None, most: int, ttl_ms: int, late: str, most_of_scope: int | None = None) -> DataFrame:
    """limiter, at, id, action, scope, answer, held: what each event of a limiter gets, in order of time and id.

    action "give" returns a lease, anything else takes one. A lease is granted while fewer than `most` are held, and fewer than
    `most_of_scope` of its scope; it expires `ttl_ms` after it was taken. Answers: granted, refused, held (taken again while it is
    held: neither counted twice nor prolonged), returned, unknown (nothing to return). Events are answered once the watermark has
    passed them; those that come later than that get no answer. A limiter's events are one key's, as a limit is one number."""
    events = _events(stream, limiter, at, id_, late, action=action, scope=scope)
    return _answered(events, _Leases(most, most_of_scope, ttl_ms), "limiter", "long string string string string int")


def memo(stream: DataFrame, arguments: str, at: str, id_: str, ttl_ms: int, late: str) -> DataFrame:
    """arguments, at, id, hit, made: whether each call finds a result that was made less than `ttl_ms` before, and when that was.

    A call that finds none makes one, which later calls find until it expires; finding doesn't prolong it. Late calls get no row."""
    return _answered(_events(stream, arguments, at, id_, late), _Memo(ttl_ms), "arguments", "long string boolean long")
