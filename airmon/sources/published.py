"""Tables kept by day under a manifest: incremental refresh, withdrawn days, one atomic switch.

Files of a write go to folders of their own, ``data/table=.../date=.../commit=...``, which nobody reads until the next
manifest names them.  A manifest lists, for each table and day, the commit that holds it, its rows and a digest of the
source it was made from; manifests are numbered and the one with the highest number is current.  It is published by
renaming a finished file, so readers see all tables of a write or none of them, a failed write changes nothing, and of
two writers that started from the same version one fails.  The rename must not replace files and must be atomic, as on
HDFS and local disks.

A write says which days it covers.  Covered days without rows are withdrawn by the same switch: their entries go.
"""

from __future__ import annotations

import datetime as dtm
import json
import uuid
from collections.abc import Callable, Collection, Iterable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Days = Collection[dtm.date] | tuple[dtm.date, dtm.date]


@dataclass(frozen=True)
class Entry:
    """A table's day: where its rows are (no commit: it has none) and what it was made from."""

    table: str
    day: str
    commit: str | None
    rows: int
    digest: str | None = None


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: days computed anew, days gone from the source, days left as they were."""

    changed: list[dtm.date]
    withdrawn: list[dtm.date]
    kept: int


class Conflict(RuntimeError):
    """Another writer has published since this one read the manifest."""


class Published:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- manifests ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The current version, 0 before the first write."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return 0
        names = (f.getPath().getName() for f in fs.listStatus(p))
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def entries(self, version: int | None = None) -> dict[tuple[str, str], Entry]:
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.path}/manifest/v{version:09d}.json").collect()
        found = (Entry(**json.loads(r.value)) for r in lines)
        return {(e.table, e.day): e for e in found}

    def _publish(self, entries: Iterable[Entry], version: int) -> int:
        fs, temp = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/manifest/v{version:09d}.json")
        out = fs.create(temp, False)
        try:
            for e in sorted(entries, key=lambda e: (e.table, e.day)):
                out.write(bytearray(json.dumps(asdict(e)).encode() + b"\n"))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise Conflict(f"version {version} of {self.path} was published by another writer")
        return version

    # ---- tables ------------------------------------------------------------------------------------

    def state(self, table: str) -> dict[dtm.date, str]:
        """What each day of a table was last written by; as the source state of a table made from it."""
        return {dtm.date.fromisoformat(d): e.commit for (t, d), e in self.entries().items() if t == table and e.commit}

    def read(self, table: str, schema: str, days: Collection[dtm.date] | None = None, version: int | None = None) -> DataFrame:
        """The current rows of a table (``schema`` without its date, which comes last), or of some of its days only."""
        wanted = None if days is None else {str(d) for d in days}
        folders = [
            f"{self.path}/data/table={table}/date={e.day}/commit={e.commit}" for (t, d), e in self.entries(version).items()
            if t == table and e.commit and (wanted is None or d in wanted)]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, date date")
        rows = self.spark.read.schema(f"{schema}, date date, commit string").option("basePath", f"{self.path}/data/table={table}")
        return rows.parquet(*folders).drop("commit")

    def write(self, rows: DataFrame, covers: Days | Mapping[str, Days], digests: Mapping[dtm.date, str] | None = None,
              dealt: bool = False) -> int:
        """Replace the covered days of some tables by ``rows`` (table, date, ...) and return the new version.

        ``covers`` is a set of days or a (first, last) pair, for each table or, where it is not a mapping, for all tables
        that are stored or have rows.  Rows of other days are an error.  Days with a digest keep an entry without rows.
        ``dealt`` rows lie in tasks by day already, so they are written as they are.
        """
        version, old = self.version(), self.entries()
        commit = uuid.uuid4().hex
        rows = rows.withColumn("commit", F.lit(commit))
        (rows if dealt else rows.hint("rebalance", "table", "date")).write.mode("append").partitionBy(
            "table", "date", "commit").parquet(f"{self.path}/data")
        written = self._written(commit)
        tables = set(covers) if isinstance(covers, Mapping) else {t for t, _ in old} | {t for t, _ in written}
        within = {t: _test(covers[t] if isinstance(covers, Mapping) else covers) for t in tables}
        stray = [k for k in written if k[0] not in within or not within[k[0]](dtm.date.fromisoformat(k[1]))]
        if stray:
            raise ValueError(f"rows outside the covered days: {sorted(stray)[:5]}")
        new = {k: e for k, e in old.items() if k[0] not in within or not within[k[0]](dtm.date.fromisoformat(k[1]))}
        named = {str(d): x for d, x in (digests or {}).items()}
        new |= {(t, d): Entry(t, d, None, 0, x) for t in tables for d, x in named.items()}
        new |= {(t, d): Entry(t, d, commit, n, named.get(d)) for (t, d), n in written.items()}
        return self._publish(new.values(), version + 1)

    def _written(self, commit: str) -> dict[tuple[str, str], int]:
        """Rows of each table and day of a commit, from the files' footers."""
        fs, p = self._fs(f"{self.path}/data/table=*/date=*/commit={commit}")
        folders = [f.getPath().toString() for f in fs.globStatus(p) or []]
        if not folders:
            return {}
        rows = self.spark.read.schema("table string, date string, commit string").option("basePath", f"{self.path}/data").parquet(*folders)
        return {(r["table"], r["date"]): r["n"] for r in rows.groupBy("table", "date").agg(F.count("*").alias("n")).collect()}

    def vacuum(self, versions: int = 2) -> int:
        """Delete files that none of the last ``versions`` manifests names, failed writes' too; returns the folders deleted."""
        now = self.version()
        used = {(e.table, e.day, e.commit) for v in range(max(1, now - versions + 1), now + 1) for e in self.entries(v).values()}
        fs, p = self._fs(f"{self.path}/data/table=*/date=*/commit=*")
        gone = 0
        for f in fs.globStatus(p) or []:
            key = tuple(x.split("=", 1)[1] for x in f.getPath().toString().split("/")[-3:])
            if key not in used:
                gone += bool(fs.delete(f.getPath(), True))
        return gone

    # ---- refresh -----------------------------------------------------------------------------------

    def refresh(
        self, table: str, state: Mapping[dtm.date, str], build: Callable[[list[dtm.date]], DataFrame],
    ) -> Refreshed:
        """Bring a table up to date with its source, computing only days whose part of the source has changed.

        ``state`` is the digest of each day's part of the source; ``build`` gives the rows of the days asked for and must
        need no other days' part.  Days gone from the source are withdrawn.
        """
        old = {dtm.date.fromisoformat(d): e.digest for (t, d), e in self.entries().items() if t == table}
        changed = sorted(d for d, x in state.items() if old.get(d) != x)
        withdrawn = sorted(old.keys() - state.keys())
        if changed or withdrawn:
            rows = build(changed).withColumn("table", F.lit(table))
            self.write(rows, {table: {*changed, *withdrawn}}, {d: state[d] for d in changed})
        return Refreshed(changed, withdrawn, len(state) - len(changed))


def _test(days: Days) -> Callable[[dtm.date], bool]:
    if isinstance(days, tuple):
        first, last = days
        return lambda d: first <= d <= last
    days = set(days)
    return lambda d: d in days


def content_state(source: DataFrame, date: str = "date") -> dict[dtm.date, str]:
    """Rows and digest of every day of a source, whatever their order; reads it once, one row per day comes back."""
    one, two = F.xxhash64(*source.columns), F.xxhash64(F.lit(1), *source.columns)
    # a sum as well as an exclusive or: rows that occur twice must not cancel out
    days = source.groupBy(date).agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(two.cast("decimal(38,0)")).alias("s"))
    return {r[date]: f"{r.n}-{r.x}-{r.s}" for r in days.collect()}


def file_state(source: DataFrame, date: str = "date") -> dict[dtm.date, str]:
    """The same for a table of files partitioned by ``date``, from names, sizes and times of the files: no column is read."""
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_name", "file_size", "file_modification_time")]
    files = source.select(date, *meta).groupBy(date, "file_name", "file_size", "file_modification_time").agg(F.count("*").alias("n"))
    one = F.concat_ws(":", "file_name", "file_size", F.unix_micros("file_modification_time"), "n")
    days = files.groupBy(date).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ","), 256).alias("digest"))
    return {r[date]: r.digest for r in days.collect()}
