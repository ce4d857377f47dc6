"""Tables as a log of batches in a shared folder.

Every table has a folder ``v=<batch>`` per batch that holds only what the batch
changed; a marker ``done/<batch>`` is written last, and readers see batches with a
marker alone. Keyed tables are read as the latest row per key, others as all
rows. Writing a batch again replaces its folders, so a replay changes nothing.

Batches are merged in tiers: after every FANOUT batches, by number, one run folder
takes their place, after FANOUT runs a larger one, and so on, so that the number of
folders that a reader opens grows with the logarithm of the number of batches.
A run serves readers that see all of its batches; the batches' own folders
stay for the others.

For the tables that are read by key, each folder has a manifest: one row
per file with the range of its keys. Files are sorted and have bloom filters, so
a look-up opens the files whose range holds a key, and in them the row groups
whose filter does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesnap.operators.registry import latest_per_key

FANOUT = 8
BATCH = "v"    # the column with the number of a row's batch


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    keys: tuple[str, ...] = ()          # none: every row stands for itself
    look_up: bool = False               # sorted by key, with a manifest and bloom filters
    merge: Callable[[DataFrame], DataFrame] | None = None   # of several batches' rows; default: the latest per key

    def merged(self, rows: DataFrame) -> DataFrame:
        if self.merge:
            return self.merge(rows)
        return latest_per_key(rows, list(self.keys), F.col(BATCH)) if self.keys else rows


@dataclass(frozen=True)
class Unit:
    """A batch, or a run of merged batches ``lo`` to ``hi``."""
    lo: int
    hi: int

    @property
    def folder(self) -> str:
        return f"v={self.lo}" if self.lo == self.hi else f"run={self.lo}-{self.hi}"


def tiers(batch: int, fanout: int = FANOUT) -> list[Unit]:
    """Runs that are due after a batch: those of 8, 64, ... numbers that end with it."""
    found, size = [], fanout
    while (batch + 1) % size == 0:
        found.append(Unit(batch + 1 - size, batch))
        size *= fanout
    return found


@dataclass
class Log:
    """The tables under ``root`` as listed once, when this object is made."""
    spark: SparkSession
    root: str
    tables: dict[str, Table]
    batches: list[int] = field(default_factory=list)
    runs: list[Unit] = field(default_factory=list)

    def __post_init__(self):
        self.batches = sorted(int(n) for n in self._names("done"))
        self.runs = [Unit(*map(int, n.split("-"))) for n in self._names("merged")]

    # ---- files
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _mark(self, name: str) -> None:
        path = self._path(name)
        self._fs(path).create(path, True).close()

    # ---- reading
    def units(self, before: int | None = None) -> list[Unit]:
        """What a reader of the finished batches (before a number) opens: the
        largest runs within them, and single batches where no run is."""
        wanted = [b for b in self.batches if before is None or b < before]
        found, at = [], 0
        while at < len(wanted):
            fits = [r for r in self.runs if r.lo <= wanted[at] and wanted[at] <= r.hi <= wanted[-1] and (not at or r.lo > wanted[at - 1])]
            unit = max(fits, key=lambda r: r.hi, default=Unit(wanted[at], wanted[at]))
            found.append(unit)
            while at < len(wanted) and wanted[at] <= unit.hi:
                at += 1
        return found

    def _schema(self, name: str) -> T.StructType:
        return T.StructType([*self.tables[name].schema.fields, T.StructField(BATCH, T.LongType())])

    def _read(self, name: str, units: list[Unit]) -> DataFrame:
        if not units:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(*[f"{self.root}/{name}/{u.folder}" for u in units])

    def rows(self, name: str, before: int | None = None) -> DataFrame:
        """All rows of the finished batches (before a number)."""
        return self._read(name, self.units(before))

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """The table after those batches, with the rows' batch numbers."""
        return self.tables[name].merged(self.rows(name, before))

    # ---- writing
    def _write(self, name: str, df: DataFrame, unit: Unit) -> None:
        table, to = self.tables[name], f"{self.root}/{name}/{unit.folder}"
        out = df
        if table.look_up:
            out = df.repartitionByRange(*table.keys).sortWithinPartitions(*table.keys)
        writer = out.write.mode("overwrite")
        if table.look_up:
            for key in table.keys:
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(to)
        if table.look_up:
            key = F.struct(*table.keys)
            (self._read(name, [unit]).groupBy(F.col("_metadata.file_name").alias("file"))
             .agg(F.lit(unit.folder).alias("folder"), F.min(key).alias("least"), F.max(key).alias("greatest"), F.count(F.lit(1)).alias("n"))
             .write.mode("overwrite").parquet(f"{self.root}/manifest/{name}/{unit.folder}"))

    def append(self, batch: int, tables: dict[str, DataFrame], merge: bool = True) -> None:
        """Write the batch's rows, then its marker; then the runs that are due."""
        for name, df in tables.items():
            self._write(name, df.withColumn(BATCH, F.lit(batch).cast("long")), Unit(batch, batch))
        self._mark(f"done/{batch}")
        self.batches = sorted({*self.batches, batch})
        for unit in tiers(batch) if merge else []:
            self.merge(unit)

    def merge(self, unit: Unit) -> None:
        """Merge the finished batches of a range of numbers into one run."""
        inside = [b for b in self.batches if unit.lo <= b <= unit.hi]
        if len(inside) < 2 or unit in self.runs:
            return
        parts = Log(self.spark, self.root, self.tables, [], [])
        parts.batches, parts.runs = inside, [r for r in self.runs if r != unit and unit.lo <= r.lo and r.hi <= unit.hi]
        for name, table in self.tables.items():
            self._write(name, table.merged(parts.rows(name)).select(*self._schema(name).fieldNames()), unit)
        self._mark(f"merged/{unit.lo}-{unit.hi}")
        self.runs.append(unit)

    # ---- look-ups
    def files(self, name: str, keys: list[tuple], before: int | None = None) -> list[str]:
        """The files whose range of keys holds one of ``keys``. A key may be
        given by its first fields only. The list and the files met are as long as
        the caller's few keys make them."""
        table, units = self.tables[name], self.units(before)
        if not units or not keys:
            return []
        manifest = self.spark.read.parquet(*[f"{self.root}/manifest/{name}/{u.folder}" for u in units])
        holds = F.lit(False)
        for key in keys:
            fields = table.keys[:len(key)]
            own = F.struct(*[F.lit(v).alias(c) for c, v in zip(fields, key, strict=True)])
            least, greatest = (F.struct(*[F.col(f"{end}.{c}").alias(c) for c in fields]) for end in ("least", "greatest"))
            holds = holds | ((least <= own) & (own <= greatest))
        return sorted(f"{self.root}/{name}/{r['folder']}/{r['file']}" for r in manifest.where(holds).select("folder", "file").collect())

    def look_up(self, name: str, keys: list[tuple], before: int | None = None) -> DataFrame:
        """The table's rows under ``keys``, from the files that may hold them."""
        table, files = self.tables[name], self.files(name, keys, before)
        if not files:
            return self._read(name, [])
        rows = self.spark.read.schema(self._schema(name)).parquet(*files)
        wanted = F.lit(False)
        for key in keys:
            own = F.lit(True)
            for c, v in zip(table.keys, key):
                own = own & (F.col(c) == v)
            wanted = wanted | own
        return table.merged(rows.where(wanted))
