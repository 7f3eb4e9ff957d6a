"""A store of tables in a shared folder: written aside, switched by one pointer, with a ledger of finished batches.

Each commit writes new files below folders of its own and then puts one small file, the next number of ``log``, in
place by a rename. That file names the folders of every part of every table, and the batches done so far. Readers see
the newest number, so they see a commit whole or not at all; files of a job that died belong to no number.

A table is cut into parts by the values of a few columns. A commit replaces or extends some parts and leaves the files
of all others alone, and a reader names the parts it needs, so neither touches more than that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cutline.session import settings

# shuffles are deleted as their job ends, not when the driver collects its garbage
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@dataclass(frozen=True)
class Snapshot:
    """What one number of the log says: table -> part -> the commits that hold it, ranges of finished batches, notes."""

    number: int = -1
    tables: Mapping[str, Mapping[str, list[str]]] = field(default_factory=dict)
    batches: tuple[tuple[int, int], ...] = ()
    notes: Mapping[str, str] = field(default_factory=dict)

    def done(self, batch: int) -> bool:
        return any(low <= batch <= high for low, high in self.batches)


@dataclass(frozen=True)
class Staged:
    """Files written aside: not part of the store before a commit names them."""

    table: str
    commit: str
    parts: tuple[str, ...]
    schema: StructType


def _with_batch(ranges: Sequence[tuple[int, int]], batch: int) -> tuple[tuple[int, int], ...]:
    out: list[tuple[int, int]] = []
    for low, high in sorted([*ranges, (batch, batch)]):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return tuple(out)


class Store:
    """Tables below ``path``, for one writer at a time and any number of readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # reading --------------------------------------------------------------

    def numbers(self) -> list[int]:
        log = self._at("log")
        if not self._files.exists(log):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The newest state, or that of an earlier commit."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return Snapshot()
            number = numbers[-1]
        stream = self._files.open(self._at(f"log/{number:020d}.json"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(number, said["tables"], tuple(map(tuple, said["batches"])), said["notes"])

    def read(
        self, snapshot: Snapshot, table: str, schema: StructType | str, parts: Iterable[str] | None = None,
        also: Staged | None = None,
    ) -> DataFrame:
        """Rows of some parts of a table, or of all; ``also`` adds files written aside. Other parts are not even listed."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        held = snapshot.tables.get(table, {})
        wanted = list(held if parts is None else dict.fromkeys(parts))
        folders = [(c, p) for p in wanted for c in held.get(p, [])]
        if also is not None:
            folders += [(also.commit, p) for p in (also.parts if parts is None else wanted) if p in also.parts]
        if not folders:
            return self.spark.createDataFrame([], schema).limit(0)  # the optimizer sees that it is empty, and drops its joins
        base = f"{self.path}/{table}"
        paths = [f"{base}/commit={c}/{p}".rstrip("/") for c, p in folders]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def staged(self, staged: Staged) -> DataFrame:
        return self.read(Snapshot(), staged.table, staged.schema, also=staged)

    # writing --------------------------------------------------------------

    def stage(self, rows: DataFrame, table: str, by: Sequence[str] = ()) -> Staged:
        """Write rows aside, cut by the columns of ``by``; a part that holds most of the rows is split over tasks."""
        return self._write(rows.hint("rebalance", *by) if by else rows, table, by)

    def stage_in_place(self, rows: DataFrame, table: str, by: Sequence[str]) -> Staged:
        """As ``stage``, but each task writes its own rows: no shuffle, and a file per task and part."""
        return self._write(rows, table, by)

    def _write(self, rows: DataFrame, table: str, by: Sequence[str]) -> Staged:
        commit = uuid.uuid4().hex
        folder = f"{self.path}/{table}/commit={commit}"
        writer = rows.write.option("compression", "zstd")
        with settings(rows.sparkSession, DROP_SHUFFLES):
            (writer.partitionBy(*by) if by else writer).parquet(folder)
        if by:
            found = self._files.globStatus(self._at(f"{table}/commit={commit}" + "".join(f"/{c}=*" for c in by)))
            names = [s.getPath().toUri().getPath().split(f"/commit={commit}/")[1] for s in found]
        else:
            names = [""]
        return Staged(table, commit, tuple(sorted(names)), rows.schema)

    def discard(self, staged: Staged) -> None:
        """Delete files that were written aside, are read no more and are named by no commit."""
        self._files.delete(self._at(f"{staged.table}/commit={staged.commit}"), True)

    def commit(
        self, before: Snapshot, batch: int | None = None, replace: Sequence[tuple[Staged, Iterable[str]]] = (),
        append: Sequence[Staged] = (), notes: Mapping[str, str] | None = None,
    ) -> Snapshot:
        """Switch to the new state. ``notes`` are a few values to keep with it. ``replace`` names the parts of a table that the staged files now are, all of them;
        parts without staged rows vanish. Fails if someone else committed after ``before``."""
        tables = {t: {p: list(c) for p, c in parts.items()} for t, parts in before.tables.items()}
        for staged, parts in replace:
            held = tables.setdefault(staged.table, {})
            for part in parts:
                held.pop(part, None)
            held |= {p: [staged.commit] for p in staged.parts}
        for staged in append:
            held = tables.setdefault(staged.table, {})
            for part in staged.parts:
                held.setdefault(part, []).append(staged.commit)
        batches = before.batches if batch is None else _with_batch(before.batches, batch)
        after = Snapshot(before.number + 1, tables, batches, {**before.notes, **(notes or {})})
        aside = self._at(f"log/.{uuid.uuid4().hex}.json")
        out = self._files.create(aside, False)
        out.write(json.dumps({"tables": tables, "batches": batches, "notes": after.notes}).encode())
        out.close()
        goal = self._at(f"log/{after.number:020d}.json")
        if self._files.exists(goal) or not self._files.rename(aside, goal):
            self._files.delete(aside, False)
            raise RuntimeError(f"commit {after.number} of {self.path} was made by another writer")
        return after

    def sweep(self, keep: int = 2) -> int:
        """Delete what none of the last ``keep`` commits names; the number of folders deleted.

        Not to be run beside a writer, whose files are not named yet, nor beside readers of older commits.
        """
        numbers = self.numbers()
        for number in numbers[:-keep]:
            self._files.delete(self._at(f"log/{number:020d}.json"), False)
        named = {
            (table, commit)
            for n in numbers[-keep:]
            for table, parts in self.snapshot(n).tables.items()
            for commits in parts.values()
            for commit in commits
        }
        gone = 0
        for status in self._files.globStatus(self._at("*/commit=*")):
            where = status.getPath()
            if (where.getParent().getName(), where.getName().removeprefix("commit=")) not in named:
                gone += bool(self._files.delete(where, True))
        return gone


def bucket(key: str, buckets: int) -> str:
    """SQL text of a part number by hash."""
    return f"CAST(pmod(xxhash64({key}), {buckets}) AS INT)"


def with_status(facts: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Facts with ``status``: the version of a key that is last by ``order`` is PUBLISHED, the others SUPERSEDED."""
    last = f"max(struct({order} AS at, source_version_id)) OVER (PARTITION BY {', '.join(key)})"
    return facts.withColumn("_last", F.expr(last)).withColumn(
        "status", F.expr(f"CASE WHEN struct({order} AS at, source_version_id) = _last THEN 'PUBLISHED' ELSE 'SUPERSEDED' END")
    ).drop("_last")
