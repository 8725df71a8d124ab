"""Positions held as a state machine over a stream of officer events.

Each company keeps the last event of every person in every role, the day on which each of
its seats was filled last, and the forms in which its body was appointed on each day.  A
batch changes those and puts out every position that is held now and wasn't, or was and
isn't any more.  Events may come in any order: what is held in the end is what
``operators.positions.positions_held`` gives for all of them.  Days that the watermark
has passed can't change any more; a timer folds their forms into one day for each form.

A company's state is one value, read and written once a batch: what is held now depends on
all of it, and each step to the state store costs more than the rows of most companies.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from actaflow.functions import catalogue as C
from actaflow.functions.text import person_key
from actaflow.operators.positions import FORMS, body_form, seat

CHANGE = "company_id long, person string, role string, version long, day date, event_id long, holder string, label string, kind string, held boolean"
_EPOCH = datetime.date(1970, 1, 1)
_DAY_MS = 86_400_000
#: State provider that keyed map state and timers need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_STATE = (
    "version long, timer int, last array<struct<person: string, role: string, day: int, event_id: long, opens: boolean, holder: string, label: string, kind: string, seat: string, form: int, held: boolean, told: long>>, "
    "seats array<struct<seat: string, day: int>>, bodies array<struct<day: int, forms: int>>, left array<struct<form: int, day: int>>"
)
_CHANGED = Row(*[x.split()[0] for x in CHANGE.split(", ")])


class _Company:
    """The state of one company as dictionaries.  ``last``: by (person, role), as in _STATE;
    ``timer``: the earliest day that a timer waits for."""

    def __init__(self, value: tuple | None):
        self.version, self.timer, last, seats, bodies, left = value or (0, None, [], [], [], [])
        self.last = {tuple(x[:2]): tuple(x[2:]) for x in last}
        self.seats, self.bodies, self.left = ({x[0]: x[1] for x in pairs} for pairs in (seats, bodies, left))

    def packed(self) -> tuple:
        return (self.version, self.timer, [(*k, *v) for k, v in self.last.items()], list(self.seats.items()), list(self.bodies.items()), list(self.left.items()))


def _latest_without(bodies: dict[int, int], left: dict[int, int]) -> dict[int, int]:
    """(form: day) of the last day on which the body was appointed without the form."""
    out = dict(left)
    for day, forms in bodies.items():
        for f in range(len(FORMS)):
            if not forms >> f & 1:
                out[f] = max(out.get(f, day), day)
    return out


class Seats(StatefulProcessor):
    """One company's positions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.company = handle.getValueState("company", _STATE)

    def _read(self) -> _Company:
        return _Company(self.company.get())

    def _await(self, c: _Company) -> None:
        """A timer for the earliest day that is not folded, unless there is one."""
        first = min(c.bodies, default=None)
        if first is not None and (c.timer is None or first < c.timer):
            self.handle.registerTimer((first + 1) * _DAY_MS)
            c.timer = first

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        c, newest = self._read(), {}
        for e in sorted(rows, key=lambda r: (r.day_no, r.event_id)):
            newest[e.person, e.role] = e
            if e.opens and e.seat != "":
                c.seats[e.seat] = max(c.seats.get(e.seat, e.day_no), e.day_no)
            if e.opens and e.form >= 0:
                c.bodies[e.day_no] = c.bodies.get(e.day_no, 0) | 1 << e.form
        for at, e in newest.items():
            old = c.last.get(at)
            if old is None or (e.day_no, e.event_id) > old[:2]:
                c.last[at] = (e.day_no, e.event_id, e.opens, e.holder, e.label, e.kind, e.seat, e.form, old[8] if old else False, old[9] if old else 0)
        self._await(c)
        changes = self._changes(key[0], c)
        self.company.update(c.packed())
        yield from changes

    def _changes(self, company: int, c: _Company) -> list[Row]:
        left, out = _latest_without(c.bodies, c.left), []
        c.version += 1
        for at, (day, event_id, opens, holder, label, kind, own_seat, form, held, told) in list(c.last.items()):
            now = opens and c.seats.get(own_seat, day) <= day and left.get(form, day) <= day
            # a position that is held by another event than the one told is told as well
            if now != held or now and told != event_id:
                c.last[at] = (day, event_id, opens, holder, label, kind, own_seat, form, now, event_id)
                out.append(_CHANGED(company, *at, c.version, _EPOCH + datetime.timedelta(days=day), event_id, holder, label, kind, now))
        return out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        c, until = self._read(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // _DAY_MS
        past = {day: c.bodies.pop(day) for day in list(c.bodies) if day < until}
        c.left, c.timer = _latest_without(past, c.left), None
        self._await(c)
        self.company.update(c.packed())
        return iter(())

    def close(self) -> None:
        pass


def position_changes(events: DataFrame, late: str = "36500 days") -> DataFrame:
    """CHANGE rows of a stream of events (company_id, day, event_id, holder, role, label, kind).

    Of a (company_id, person, role) the row with the largest version tells whether the
    position is held.  ``late``: events this much older than the newest one are left out, as
    their day's state is folded.  Null holders, roles and labels count as empty texts; an
    event that comes twice changes nothing."""
    form = body_form(F.col("role"))
    numbered = F.lit(-1)
    for i, name in enumerate(FORMS):
        numbered = F.when(form == name, F.lit(i)).otherwise(numbered)
    text = lambda c: F.coalesce(c, F.lit(""))
    e = events.filter("company_id is not null and day is not null and event_id is not null").select(
        F.col("company_id").cast("long").alias("company_id"), F.col("day").cast("timestamp").alias("at"), F.unix_date("day").alias("day_no"), F.col("event_id").cast("long").alias("event_id"),
        text(F.col("holder")).alias("holder"), text(person_key(F.col("holder"))).alias("person"), text(F.col("role")).alias("role"), text(F.col("label")).alias("label"), text(F.col("kind")).alias("kind"),
        F.coalesce(F.col("kind").isin(*C.OPENING_EVENTS), F.lit(False)).alias("opens"), text(seat(F.col("role"), F.col("label"))).alias("seat"), numbered.alias("form"),
    )
    return e.withWatermark("at", late).groupBy("company_id").transformWithState(statefulProcessor=Seats(), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")


def held_now(changes: DataFrame) -> DataFrame:
    """The positions held after all ``changes``: company_id, event_id, day, holder, role, label, kind."""
    rest = ("day", "event_id", "holder", "label", "kind", "held")
    last = changes.groupBy("company_id", "person", "role").agg(F.max_by(F.struct(*rest), "version").alias("p"))
    return last.filter("p.held").select("company_id", "role", *[f"p.{c}" for c in rest if c != "held"])
