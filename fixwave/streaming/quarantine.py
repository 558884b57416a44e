"""Landing of pulse files with quarantine and replay: what can't be used is kept aside with its content and its reason.

``land`` runs a stream of files (path, content) to its end. Each micro-batch is parsed once; records of known sites go to the
table ``records``, everything else to ``quarantine``: files that are no record, whose folder is no minute, or whose site isn't
known. Both tables of a batch are written under its number and seen only once its mark is there (``inserts.commit``), so a batch
that is run again after a failure replaces itself.

A file is known by site, minute and name, in the tree of a site (site/YYYY/MM/DD/HH/MM/name) as in a folder of quarantine
(site_YYYY.MM.DD.HH.MM/name). ``replay`` is the same run over repaired files, with one thing more: files whose record is there
already are left out, whatever run has landed them, and of several repaired files of one key in a batch one is taken. So a
record lands once, however often its file is repaired, touched or replayed. ``still_open`` is what was quarantined and has not
landed since, and ``hand_out`` writes these files for repair.

Defined results: a null content is an empty file (Spark's file streams pass over files of no bytes); an empty stream commits nothing; a file that is quarantined again after a repair
is open once, with its last reason.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.operators.joins import small
from fixwave.session import reach_workers
from fixwave.sources import inserts
from fixwave.sources.det import parse
from fixwave.sources.det_source import _store

KEY = ["site", "minute", "name"]
TREE = r"([^/]+)/([0-9]{4})/([0-9]{2})/([0-9]{2})/([0-9]{2})/([0-9]{2})/([^/]+)$"
HELD = r"([^/]+)_([0-9]{4})\.([0-9]{2})\.([0-9]{2})\.([0-9]{2})\.([0-9]{2})/([^/]+)$"
FIELDS = "timestamp double, channels int, pulse_at int, pulse_n int, rate double, center double, samples binary, error string"
RECORDS = "site string, minute string, name string, path string, " + FIELDS.removesuffix(", error string")
QUARANTINE = "site string, minute string, name string, path string, content binary, error string"


def keyed(files: DataFrame) -> DataFrame:
    """Files (path, content) with the site, minute (YYYY-MM-DD HH:MM) and name that their path tells; else nulls, and the name."""
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract("path", p, k), F.lit("")) for p in (TREE, HELD)])
    minute = F.concat(part(2), F.lit("-"), part(3), F.lit("-"), part(4), F.lit(" "), part(5), F.lit(":"), part(6))
    return files.select(part(1).alias("site"), minute.alias("minute"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.coalesce("content", F.lit(b"")).alias("content"))


def parsed(files: DataFrame) -> DataFrame:
    """Keyed files with the fields of their records, or why they are none."""
    reach_workers(files.sparkSession)
    names = [c.split()[0] for c in FIELDS.split(", ")]
    kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                try:
                    rows.append(parse(content.as_py()))
                except ValueError as e:
                    rows.append({"error": str(e)})
            fields = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fields], names=[*batch.schema.names, *names])

    kinds_of = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{kinds_of}, {FIELDS}")


def _marked(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a run with its batch numbers: those that were marked."""
    marks = spark.read.parquet(f"{folder}/batches").select("batch").distinct()
    return spark.read.parquet(f"{folder}/{name}").join(small(marks), "batch", "left_semi")


def landed(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """A table of all runs' committed batches, with ``run`` and ``batch``, or None before the first one."""
    fs, root = _store(store)
    out = None
    for run in ("landing", "replay"):
        if fs.get_file_info(f"{root}/{run}/batches").type.name == "Directory":
            rows = _marked(spark, f"{store}/{run}", name).withColumn("run", F.lit(run))
            out = rows if out is None else out.unionByName(rows)
    return out


def _land(spark: SparkSession, stream: DataFrame, store: str, run: str, sites: DataFrame, checkpoint: str, once: bool) -> None:
    known = sites.select(F.col("name").alias("site"), F.lit(True).alias("known")).dropDuplicates(["site"])

    def one(batch: DataFrame, number: int) -> None:
        files = keyed(batch)
        before = landed(spark, store, "records") if once else None
        if before is not None:  # a batch that is run again has landed nothing yet
            files = files.join(before.where((F.col("run") != run) | (F.col("batch") < number)).select(*KEY), KEY, "left_anti").select(*files.columns)
        rows = parsed(files).join(small(known), "site", "left")
        why = F.when(F.col("minute").isNull(), F.lit("not in a minute folder of a site")).when(F.col("error").isNotNull(), F.col("error")).when(F.col("known").isNull(), F.lit("unknown site"))
        rows = rows.withColumn("error", why).drop("known").persist()
        good = rows.where("error IS NULL").drop("content", "error")
        bad = rows.where("error IS NOT NULL").select(*[c.split()[0] for c in QUARANTINE.split(", ")])
        inserts.commit({"records": good.dropDuplicates(KEY) if once else good, "quarantine": bad}, f"{store}/{run}", number)
        rows.unpersist()

    query = stream.select("path", "content").writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def land(spark: SparkSession, stream: DataFrame, store: str, sites: DataFrame, checkpoint: str) -> None:
    """Run a stream of new files (path, content) to its end: records and quarantine of the run ``landing``."""
    _land(spark, stream, store, "landing", sites, checkpoint, False)


def replay(spark: SparkSession, stream: DataFrame, store: str, sites: DataFrame, checkpoint: str) -> None:
    """Run a stream of repaired files (path, content) to its end: each record lands once, whatever was replayed before."""
    _land(spark, stream, store, "replay", sites, checkpoint, True)


def still_open(spark: SparkSession, store: str) -> DataFrame:
    """Files in quarantine whose record has not landed: the last content and reason of each."""
    held, done = landed(spark, store, "quarantine"), landed(spark, store, "records")
    if held is None:
        return spark.createDataFrame([], QUARANTINE)
    order = F.struct((F.col("run") == "replay").alias("again"), "batch", "path")
    last = held.groupBy(*KEY).agg(F.max_by(F.struct("path", "content", "error"), order).alias("f")).select(*KEY, "f.*")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
    return last.alias("a").join(done.select(*KEY).alias("b"), same, "left_anti")


def hand_out(files: DataFrame, folder: str) -> int:
    """Write open files of known folders as site_YYYY.MM.DD.HH.MM/name for repair; returns how many.

    A file appears by a rename, under a name that follows from its key, so a repeated task writes the same file again.
    """

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                place = f"{root}/{r['site']}_{r['minute'].translate(str.maketrans('- :', '...'))}"
                store.create_dir(place, recursive=True)
                with store.open_output_stream(f"{place}/.{r['name']}.part") as f:
                    f.write(r["content"])
                store.move(f"{place}/.{r['name']}.part", f"{place}/{r['name']}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    reach_workers(files.sparkSession)
    rows = files.where("site IS NOT NULL AND minute IS NOT NULL").select("site", "minute", "name", "content")
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def files(spark: SparkSession, pattern: str, archive: str | None = None, most: int = 1000) -> DataFrame:
    """A stream of the files that a path pattern names; with ``archive``, files of finished batches are moved there."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.det").option("maxFilesPerTrigger", most)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.load(pattern)

