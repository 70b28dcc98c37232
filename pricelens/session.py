"""Session settings and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether a finished query's shuffle files are deleted at once, not when the driver happens to collect its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "pricelens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here expects; callers may override any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the JIT never compiles methods above 8000 bytes; such projections run faster split up
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session; a cluster that has it installed loses nothing."""
    if spark.conf.get("pricelens.shipped", None) is None:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='pricelens-')}/pricelens", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        spark.conf.set("pricelens.shipped", archive)


def split_large_methods(spark: SparkSession) -> None:
    """The JIT never compiles methods above 8000 bytes, and Spark's own bound lets stages of many text rules run in one; split up they are compiled."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from the session.

    A local session without the setting (tests) gets a temporary folder; a cluster
    must name one, because a machine-local folder is lost with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder before running this job")
    folder = tempfile.mkdtemp(prefix="pricelens-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss. Its shuffle files are deleted."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> bool:
    """Return to the system what the driver's JVM has freed outside its heap (planning, compiling, sending); false where the JVM has no such command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        arguments = gateway.new_array(jvm.java.lang.Object, 4)
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # through the interface, as the server's own class is not open to reflection
        next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke").invoke(server, arguments)
    except Py4JError:
        return False
    return True


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once what was made of them is written too. Nothing may read them afterwards."""
    for table in tables:
        spark = table.sparkSession
        base = work_dir(spark)
        path = spark._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if path(folder).toUri().getPath().startswith(f"{path(base).toUri().getPath()}/"):
                path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)
