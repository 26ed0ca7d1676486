"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, a notebook) gets a temporary folder; on a cluster
    the executors would not see such a folder, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """One folder for each application, removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/rasterloom-staging/{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_roots[app])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())

        def remove() -> None:
            try:
                files.delete(path, True)
            except Exception:  # noqa: BLE001  the JVM may be gone by now
                pass

        atexit.register(remove)
    return _roots[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, computed once and safe from lost executors."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    root = _root(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/rasterloom-staging/" in folder and folder.rsplit("/", 2)[1] == root.rsplit("/", 1)[1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Sizes Arrow batches for rows that are whole texts: a thousand rows and about 8 MB at most, unless the
    session has sizes of its own."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    for key, bound in own.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, bound)
