"""Streams judged in their own order, however rows fall into batches, with state that ends.

Rows of a key wait in a buffer until the watermark says that nothing before them can come.  An event-time timer then
releases them in order, so the result is that of the batch form for every split of the rows into batches in which
none arrives after the watermark.  Keys that have nothing left to say are forgotten by the same timer.
Keys share buckets of state, so that the calls to the state store are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugework.streaming.streams import FINAL_STATES, lifecycle_codes, use_rocksdb

# Buckets of keys (a checkpoint's state depends on them), and rows in one message to the state store.
BUCKETS = 4096
AT_ONCE = 10_000


def milliseconds(interval: str) -> int:
    """``"90 seconds"`` and the like; days, hours, minutes, seconds, milliseconds."""
    amount, unit = interval.split()
    sizes = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    return int(amount) * sizes[unit.rstrip("s")]


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


class _Reordered(StatefulProcessor):
    """Buffers rows per key and hands them on in order.

    ``hold``: milliseconds by which the watermark must have passed a row before it, and all rows of its key that come
    before it in order, are released.  ``forget``: milliseconds after its last row in which a key that may go is
    forgotten; it is removed within an eighth of that time more.  Subclasses name the fields of the key, of a waiting row
    (``ms`` is the event time) and of what is known of a key, its first fields being the place of the last row released.

    Spark's group is a bucket of keys, not a key: each call to the state store takes about as long as judging many rows,
    and a bucket's rows wait in one list with one timer.  What is known is read and written for the keys of a
    batch only.
    """

    KEY: str
    WAITING: str
    KNOWN: str
    PLACE: Sequence[str]

    def __init__(self, hold: int, forget: int) -> None:
        self._hold, self._forget = hold, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", f"{self.KEY}, {self.WAITING}")
        self._known = handle.getMapState("known", self.KEY, self.KNOWN)
        # The bucket's timer, when to look for keys to forget, and the last place released of any key.
        places = ", ".join(f"{name} BIGINT" for name in self.PLACE)
        self._clock = handle.getValueState("clock", f"timer BIGINT, sweep BIGINT, {places}")
        self._fields = [part.split()[0] for part in self.WAITING.split(", ")]
        self._take = None
        self._key_fields = [part.split()[0] for part in self.KEY.split(", ")]

    def place(self, row) -> tuple:
        return tuple(row[f] for f in self.PLACE)

    def judge(self, key, known: tuple | None, row: dict) -> tuple[tuple, list[Row]]:
        """What is known after the next row in order, and what it says."""
        raise NotImplementedError

    def settled(self, key, known: tuple) -> list[Row]:
        """What is said once all rows that were due are judged."""
        return []

    def late(self, key, row) -> Row:
        """What is said of a row whose place is behind one released already."""
        raise NotImplementedError

    def may_go(self, known: tuple) -> bool:
        return True

    def _forgotten(self, known: tuple | None, row) -> bool:
        return known is not None and self.may_go(known) and row["ms"] > known[-1] + self._forget

    def _get_known(self, key: tuple) -> tuple | None:
        known = self._known.getValue(key)
        return None if known is None else tuple(known)

    def _get_clock(self) -> tuple[int | None, int | None, tuple | None]:
        found = self._clock.get()
        if found is None:
            return None, None, None
        timer, sweep, *place = found
        return timer, sweep, None if None in place else tuple(place)

    def _set_clock(self, current: int | None, timer: int | None, sweep: int | None, reached: tuple | None) -> None:
        if timer != current:
            if current is not None:
                self._handle.deleteTimer(current)
            if timer is not None:
                self._handle.registerTimer(timer)
        self._clock.update((timer, sweep, *(reached or [None] * len(self.PLACE))))

    @staticmethod
    def _earlier(one: int | None, other: int | None) -> int | None:
        return min((ms for ms in (one, other) if ms is not None), default=None)

    def _sweep(self, now: int) -> int | None:
        """Removes the keys that are forgotten; when to look again."""
        gone, following = [], None
        for own, known in self._known.iterator():
            if self.may_go(tuple(known)):
                end = known[-1] + self._hold + self._forget
                if end <= now:
                    gone.append(tuple(own))
                else:
                    following = self._earlier(following, end)
        for own in gone:
            self._known.removeKey(own)
        return following and max(following, now + self._forget // 8)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, sweep, reached = self._get_clock()
        looked_up: dict[tuple, tuple | None] = {}
        fresh: list[tuple] = []
        first, at = None, len(self._key_fields) + self._fields.index("ms")
        for row in rows:
            if self._take is None:
                names = row.__fields__
                self._take = itemgetter(*(names.index(f) for f in (*self._key_fields, *self._fields)))
            # Most rows come after all that was released of the bucket, and what is known need not be read.
            if reached is not None and self.place(row) <= reached:
                own = tuple(row[f] for f in self._key_fields)
                if own not in looked_up:
                    looked_up[own] = self._get_known(own)
                known = looked_up[own]
                if known is not None and self.place(row) <= known[: len(self.PLACE)] and not self._forgotten(known, row):
                    yield self.late(own, row)
                    continue
            entry = self._take(tuple(row))
            due = entry[at] + self._hold
            first = due if first is None or due < first else first
            fresh.append(entry)
            if len(fresh) == AT_ONCE:
                self._waiting.appendList(fresh)
                fresh = []
        if fresh:
            self._waiting.appendList(fresh)
        if first is not None and (timer is None or first < timer):
            self._set_clock(timer, first, sweep, reached)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        _, sweep, reached = self._get_clock()  # the timer that fired is gone
        width = len(self._key_fields)
        by_key: dict[tuple, list[dict]] = {}
        held = 0
        for row in self._waiting.get():
            by_key.setdefault(tuple(row[:width]), []).append(dict(zip(self._fields, row[width:])))
            held += 1
        some_known = reached is not None
        rest: list[tuple] = []
        next_due = None
        for own, rows in by_key.items():
            ripe = [self.place(row) for row in rows if row["ms"] + self._hold <= now]
            if ripe:
                last = max(ripe)
                due = sorted((row for row in rows if self.place(row) <= last), key=lambda row: (self.place(row), row["ms"]))
                rows = [row for row in rows if self.place(row) > last]
                before = known = self._get_known(own) if some_known else None
                for row in due:
                    known, said = self.judge(own, None if self._forgotten(known, row) else known, row)
                    yield from said
                yield from self.settled(own, known)
                reached = last if reached is None else max(reached, last)
                end = known[-1] + self._hold + self._forget if self.may_go(known) else None
                if end is None or end > now:
                    self._known.updateValue(own, known)
                    sweep = self._earlier(sweep, end and max(end, now + self._forget // 8))
                elif before is not None:
                    self._known.removeKey(own)
            for row in rows:
                rest.append((*own, *(row[f] for f in self._fields)))
                next_due = self._earlier(next_due, row["ms"] + self._hold)
        if len(rest) < held:
            self._waiting.clear()
            for k in range(0, len(rest), AT_ONCE):
                self._waiting.appendList(rest[k : k + AT_ONCE])
        if sweep is not None and sweep <= now:
            sweep = self._sweep(now)
        timer = self._earlier(next_due, sweep)
        if timer is None and not self._known.exists():
            self._clock.clear()
        else:
            self._set_clock(None, timer, sweep, reached)

    def close(self) -> None:
        pass


class _Lifecycle(_Reordered):
    KEY = "job_id STRING"
    WAITING = (
        "seq BIGINT, ms BIGINT, micros BIGINT, status STRING, error_code STRING, attempt_count BIGINT, max_attempts BIGINT"
    )
    KNOWN = "seq BIGINT, status STRING, micros BIGINT, ms BIGINT"
    PLACE = ("seq",)

    def judge(self, key, known, row):
        _, status, at, last = known or (None, None, None, row["ms"])
        said = [Row(job_id=key[0], seq=row["seq"], status=row["status"], code=code) for code in lifecycle_codes(status, at, row)]
        return (row["seq"], row["status"], row["micros"], max(last, row["ms"])), said

    def settled(self, key, known):
        return [Row(job_id=key[0], seq=known[0], status=known[1], code=None)]

    def late(self, key, row):
        return Row(job_id=key[0], seq=row["seq"], status=row["status"], code="late")

    def may_go(self, known):
        return known[1] in FINAL_STATES


def ordered_lifecycle_stream(transitions: DataFrame, delay: str, forget: str = "1 hour") -> DataFrame:
    """Violations (code set) in the order of ``seq``, and a job's state whenever rows are released (code NULL).

    Equals ``lifecycle_violations`` over the released rows when no row's time lies ``delay`` or more behind the time
    of a row that arrived or was recorded before it: a row is released once the watermark is ``delay`` past its time,
    together with all rows of smaller ``seq``.  Rows that the watermark has passed are dropped by Spark; a row whose
    place was released already is reported with code ``late`` and changes nothing.

    State: rows younger than twice the delay, and one row per job until ``forget`` and an eighth of it after it succeeded,
    failed or was canceled.  A job that speaks again later than that starts anew.
    """
    use_rocksdb(transitions.sparkSession)
    timed = transitions.withWatermark("at", delay).select(
        bucket("job_id"), "job_id", "at", F.col("seq").cast("bigint").alias("seq"), F.unix_micros("at").alias("micros"),
        F.ceil(F.unix_micros("at") / 1000).cast("bigint").alias("ms"), "status", "error_code",
        F.col("attempt_count").cast("bigint").alias("attempt_count"), F.col("max_attempts").cast("bigint").alias("max_attempts"),
    )
    return timed.groupBy("bucket").transformWithState(
        statefulProcessor=_Lifecycle(milliseconds(delay), milliseconds(forget)),
        outputStructType="job_id STRING, seq BIGINT, status STRING, code STRING",
        outputMode="Append",
        timeMode="EventTime",
    )


class _Submissions(_Reordered):
    KEY = "kind STRING, key STRING"
    WAITING = "micros BIGINT, submission_id BIGINT, ms BIGINT, digest STRING"
    KNOWN = "micros BIGINT, submission_id BIGINT, digest STRING, ms BIGINT"
    PLACE = ("micros", "submission_id")

    def judge(self, key, known, row):
        place = (row["micros"], row["submission_id"])
        if known is None:
            return (*place, row["digest"], row["ms"]), [self._row(key, row, "first")]
        said = [] if row["digest"] == known[2] else [self._row(key, row, "conflict")]
        return (*place, known[2], row["ms"]), said

    def late(self, key, row):
        return self._row(key, row, "late")

    def _row(self, key, row, outcome: str) -> Row:
        return Row(submission_id=row["submission_id"], kind=key[0], key=key[1], digest=row["digest"], outcome=outcome)


def submission_outcomes_stream(submissions: DataFrame, delay: str, keep: str) -> DataFrame:
    """First submissions of each (kind, key), and later ones with another digest as ``conflict``; replays vanish.

    The first is the least (time, id), whatever the batches: a submission is judged when the watermark has passed it.
    ``late`` marks rows that share the millisecond of a released one and come before it, which Spark lets in.
    State: submissions younger than the delay, and one row per key until ``keep`` and an eighth of it after its last
    submission.
    """
    use_rocksdb(submissions.sparkSession)
    timed = submissions.withWatermark("at", delay).select(
        bucket("kind", "key"), "kind", "key", "at", F.unix_micros("at").alias("micros"), F.col("submission_id").cast("bigint").alias("submission_id"),
        F.ceil(F.unix_micros("at") / 1000).cast("bigint").alias("ms"), "digest",
    )
    return timed.groupBy("bucket").transformWithState(
        statefulProcessor=_Submissions(0, milliseconds(keep)),
        outputStructType="submission_id BIGINT, kind STRING, key STRING, digest STRING, outcome STRING",
        outputMode="Append",
        timeMode="EventTime",
    )
