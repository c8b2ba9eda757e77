"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings the operators are written for.  AQE splits the skewed
#: partitions of many-to-one joins; ``forceOptimizeSkewedJoin`` lets it do so
#: even where that costs one more shuffle afterwards.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: For wide steps over large tables: shuffles into many partitions, which AQE puts together up to a size, and small
#: pieces of files, so that a task's rows do not grow with the input.
FINE_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.files.maxPartitionBytes": "8m",
}


@contextmanager
def fine_partitions(spark: SparkSession):
    """``FINE_SETTINGS`` for what is run inside."""
    before = {name: spark.conf.get(name, None) for name in FINE_SETTINGS}
    for name, value in FINE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Each table's shuffle files go as soon as it is written; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and give the package to the Python workers."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    _ship(spark)
    return spark


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="harmonium-code-")) / "harmonium.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, Path(package.name) / source.relative_to(package))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own.  On a
    cluster a machine-local folder would be lost with its executor, so a
    missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="harmonium-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, ``by``: in folders by that column.

    Cuts the lineage like a reliable checkpoint.  A Parquet table is used in
    its place because it keeps column pruning and size statistics, so later
    joins can still broadcast by measured size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/harmonium/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more; their disk is free for what comes next."""
    for table in tables:
        spark = table.sparkSession
        root = f"{shared_folder(spark)}/harmonium/{spark.sparkContext.applicationId}/"
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_materialised(spark: SparkSession) -> bool:
    """Delete every table this application materialised."""
    root = f"{shared_folder(spark)}/harmonium/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(path, True)
