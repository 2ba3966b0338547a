"""Day sums kept up to date by batches of readings: late and corrected hours included."""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import DataFrame, functions as F

from airmon.operators import daystate, direction, quality as qc, reconcile as rec
from airmon.sources.published import Published
from airmon.sources.snapshot import settle

KEYS = ("abrv", "datetime", "valid")


class RollingDays:
    """The winning reading of each site-hour and source, and the day sums, published together after every batch.

    ``order`` is the column that decides which reading of an hour wins (the least), as in the de-duplication: a later
    batch may bring an hour that was missing or a reading that wins over the stored one, which is then taken back.
    A batch reads and rewrites its own days only.
    """

    def __init__(self, store: Published, sectors: DataFrame, order: str = "event_id"):
        self.store, self.sectors, self.order = store, sectors, order
        self.hours = f"{order} long, abrv string, datetime timestamp_ntz, ws double, wd double, pm10 double, onlake_wd boolean, valid boolean"

    def add(self, readings: DataFrame) -> list[dtm.date]:
        """Take in quality-controlled readings (``hours`` columns and date); the days they change."""
        columns = [*(c.split()[0] for c in self.hours.split(", ")), "date"]
        batch = settle(qc.first_by(readings.select(*columns), KEYS, [self.order]))
        days = sorted(r.date for r in batch.select("date").distinct().collect())
        if not days:
            return []
        old = self.store.read("hours", self.hours, days)
        both = old.unionByName(batch)
        delta = daystate.changes(self._classified(old), self._classified(both))
        state = daystate.merge_states(self.store.read("days", daystate.STATE, days), delta)
        rows = qc.first_by(both, KEYS, [self.order]).withColumn("table", F.lit("hours"))
        self.store.write(
            rows.unionByName(state.withColumn("table", F.lit("days")), allowMissingColumns=True), {"hours": days, "days": days})
        return days

    def state(self) -> DataFrame:
        return self.store.read("days", daystate.STATE)

    def _classified(self, readings: DataFrame) -> DataFrame:
        return direction.classify_dunes(direction.classify_onlake(rec.reconcile_hours(readings, self.order), self.sectors))
