"""Pulse record files as a Spark source: folders are planned, not files, and only those that the query wants are listed.

The tree is site/YYYY/MM/DD/HH/MM/tag_SSuuuuuu.det. Filters on ``site`` and ``minute`` (the folder's time as YYYY-MM-DD HH:MM)
choose the folders that are entered at each level, so a query for an hour of one site lists that hour. A partition has whole
minute folders; a task lists its folders and reads their files one by one, as Arrow batches of bounded size. Spark pushes filters
down where ``spark.sql.python.filterPushdown.enabled`` is set; elsewhere the options ``sites`` (with commas), ``low`` and ``high``
(minutes, closed) choose folders as well, and filters are applied to what was read.

As a stream, each batch admits the newest ``throttle`` minute folders of each site that weren't admitted before, and no folder
younger than ``settle`` seconds, to which files may still be added. Admissions are written to ``ledger`` before Spark logs the
offset, which is their number; a batch that is run again has the same folders, and a restart loses and doubles none.

Defined results: a file that can't be parsed is a row with ``error`` and null fields; a folder whose name is no time isn't part of
the source (``stray`` lists these); an empty tree gives no rows.
"""

from __future__ import annotations

import json
import re
import time
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from fixwave.session import reach_workers
from fixwave.sources.det import parse

SCHEMA = "site string, minute string, tag string, path string, timestamp double, channels int, pulse_at int, pulse_n int, rate double, center double, samples binary, error string"
ARROW = pa.schema([(c, {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in SCHEMA.split(", "))])
LEVELS = (4, 2, 2, 2, 2)  # digits of year, month, day, hour and minute
BATCH = 8 << 20


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _listed(store, folder: str) -> list:
    from pyarrow import fs

    return sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.base_name)


def _minute(parts: list[str]) -> str:
    return f"{parts[0]}-{parts[1]}-{parts[2]} {parts[3]}:{parts[4]}"


class Wanted:
    """Which sites, and which range of minutes, a query can use."""

    def __init__(self, options: dict):
        self.sites = set(options["sites"].split(",")) if options.get("sites") else None
        self.low, self.high = options.get("low") or "", options.get("high") or "\x7f"

    def take(self, f) -> bool:
        """Whether a filter is one of site or minute; if so, it narrows what is wanted."""
        name, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if name == ("site",) and isinstance(f, (EqualTo, EqualNullSafe, In)) and value is not None:
            own = set(value) if isinstance(f, In) else {value}
            self.sites = own if self.sites is None else self.sites & own
            return True
        if name == ("minute",) and isinstance(value, str) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, value)
            return isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual))  # of the others Spark keeps the edge
        return False

    def folders(self, store, root: str, site: str) -> list[str]:
        """The minutes that a site has, in order; a year, month, day or hour out of range isn't entered."""
        found: list[str] = []

        def enter(folder: str, parts: list[str]) -> None:
            if len(parts) == len(LEVELS):
                found.append(_minute(parts))
                return
            for info in _listed(store, folder):
                name = info.base_name
                if len(name) == LEVELS[len(parts)] and name.isdigit():
                    mine = [*parts, name]
                    lowest = _minute([*mine, *["0" * k for k in LEVELS[len(mine) :]]])
                    highest = _minute([*mine, *["9" * k for k in LEVELS[len(mine) :]]])
                    if highest >= self.low and lowest <= self.high:
                        enter(info.path, mine)

        enter(f"{root}/{site}", [])
        return found

    def all(self, store, root: str) -> list[tuple[str, str]]:
        names = [i.base_name for i in _listed(store, root) if i.type.name == "Directory"]
        return [(s, m) for s in names if self.sites is None or s in self.sites for m in self.folders(store, root, s)]


class Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, str]]):
        super().__init__(folders)
        self.folders = folders


def _rows(root_uri: str, folders: list[tuple[str, str]]):
    """Arrow batches of all records in some folders."""
    store, root = _store(root_uri)
    rows, size = [], 0
    for site, minute in folders:
        for info in _listed(store, f"{root}/{site}/{re.sub('[- :]', '/', minute)}"):
            if not info.base_name.endswith(".det"):
                continue
            tag = re.match(r"(.*)_[0-9]*\.det$", info.base_name)
            row = dict.fromkeys(ARROW.names) | {"site": site, "minute": minute, "tag": tag[1] if tag else None, "path": info.path}
            with store.open_input_stream(info.path) as f:
                content = f.read()
            try:
                row |= parse(content)
            except ValueError as e:
                row["error"] = str(e)
            rows.append(row)
            size += len(content)
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.wanted = options["path"], Wanted(options)
        self.per_task = max(1, int(options.get("foldersPerTask") or 16))

    def partitions(self):
        store, root = _store(self.folder)
        found = self.wanted.all(store, root)
        return [Folders(found[k : k + self.per_task]) for k in range(0, len(found), self.per_task)] or [Folders([])]

    def read(self, partition):
        yield from _rows(self.folder, partition.folders)


class DetReader(FolderReader):
    """The same, with filters; Spark refuses a reader of this kind where pushing down is off."""

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                yield f


class DetStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.ledger = options["path"], options["ledger"]
        self.throttle, self.settle = int(options.get("throttle") or 20), float(options.get("settle") or 120)
        self.per_task = max(1, int(options.get("foldersPerTask") or 1))
        self.entries: list[list] = []
        self._read_on()

    def _entry(self, k: int) -> str:
        return f"{_store(self.ledger)[1]}/{k:010d}.json"

    def _read_on(self) -> None:
        store, root = _store(self.ledger)
        for info in _listed(store, root):
            if info.base_name == f"{len(self.entries):010d}.json":
                with store.open_input_stream(info.path) as f:
                    self.entries.append([tuple(x) for x in json.loads(f.read())])

    def initialOffset(self):
        return {"admitted": 0}

    def latestOffset(self):
        store, root = _store(self.folder)
        wanted = Wanted({})
        wanted.high = datetime.fromtimestamp(time.time() - self.settle - 60, UTC).strftime("%Y-%m-%d %H:%M")
        known, by_site = {x for e in self.entries for x in e}, {}
        for site, minute in wanted.all(store, root):
            if (site, minute) not in known:
                by_site.setdefault(site, []).append((site, minute))
        new = [x for found in by_site.values() for x in sorted(found, reverse=True)[: self.throttle]]
        if new:
            to, folder = _store(self.ledger)
            to.create_dir(folder, recursive=True)
            name = self._entry(len(self.entries))
            with to.open_output_stream(f"{name}.part") as f:
                f.write(json.dumps(new).encode())
            to.move(f"{name}.part", name)
            self.entries.append(new)
        return {"admitted": len(self.entries)}

    def partitions(self, start, end):
        self._read_on()
        found = [x for e in self.entries[start["admitted"] : end["admitted"]] for x in e]
        return [Folders(found[k : k + self.per_task]) for k in range(0, len(found), self.per_task)]

    def read(self, partition):
        yield from _rows(self.folder, partition.folders)

    def commit(self, end):
        pass


class DetSource(DataSource):
    """``spark.read.format("det").load(folder)``, and ``spark.readStream.format("det").option("ledger", ...)``.

    The option ``pushdown`` must be ``true`` for filters to be pushed down; ``scan`` takes it from the session.
    """

    @classmethod
    def name(cls):
        return "det"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (DetReader if self.options.get("pushdown") == "true" else FolderReader)(self.options)

    def streamReader(self, schema):
        return DetStreamReader(self.options)


def register(spark: SparkSession) -> None:
    reach_workers(spark)
    spark.dataSource.register(DetSource)


def scan(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All records below a folder."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("det").options(**{"pushdown": pushdown} | options).load(folder)


def stream(spark: SparkSession, folder: str, ledger: str, **options) -> DataFrame:
    """Records as a stream, the newest folders of each site first."""
    register(spark)
    return spark.readStream.format("det").options(ledger=ledger, **options).load(folder)


def stray(spark: SparkSession, folder: str) -> DataFrame:
    """Files that lie in no minute folder of a site, from file metadata alone: (path, length)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where("NOT path RLIKE '/[^/]+/[0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}/[0-9]{2}/[^/]+[.]det$'").select("path", "length")
