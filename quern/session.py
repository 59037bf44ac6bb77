"""Session helpers: the shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a folder of its own; on a cluster a
    missing setting is an error, as a machine-local folder would lose data with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        folder = tempfile.mkdtemp(prefix="quern-")
        _LOCAL_ROOTS[app] = "file://" + folder
        atexit.register(_remove_local, folder)
    return _LOCAL_ROOTS[app]


def _remove_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; the session's end removes it."""
    path = f"{shared_root(spark)}/quern/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove_path, spark, path)
    return path


def _remove_path(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  (the session may be gone already)
        if path.startswith("file://"):
            _remove_local(path[len("file://"):])


def filesystem(spark: SparkSession, path: str):
    """The JVM file system and path objects of ``path``."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def create_once(spark: SparkSession, path: str, body: str) -> bool:
    """Make a file of ``body`` by one rename; False if it exists already. Readers see all of it or nothing."""
    jvm = spark.sparkContext._jvm
    folder, _, name = path.rpartition("/")
    fs, temp = filesystem(spark, f"{folder}/.{uuid.uuid4().hex}")
    _, final = filesystem(spark, path)
    out = fs.create(temp, True)
    out.write(bytearray(body, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(temp, final, options)
    except Exception as error:
        fs.delete(temp, False)
        if "AlreadyExists" in str(error):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, file = filesystem(spark, path)
    stream = fs.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = filesystem(spark, path)
    fs.delete(jpath, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as the session has cores.

    For operators that spend seconds a megabyte: a few small files would leave cores idle. Larger
    inputs have more partitions than cores and are left as they are, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def local_session(name: str = "quern", cores: str | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
