"""Session defaults."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("plainword")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if the whole of Spark is this one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("plainword.scratch.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="plainword-")
        spark.conf.set("plainword.scratch.dir", at)
    return at.rstrip("/")


def tidy(spark: SparkSession) -> None:
    """Lets the driver forget finished plans, so that Spark deletes their shuffle files, and gives the memory that it has freed back to the system."""
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Gives native memory that the driver's JVM has freed back to the system; whether it could. Compiling the code of many plans leaves hundreds of MB
    in the C library's arenas, outside the heap, and no garbage collection returns them. ``System.trim_native_heap`` of the JVM does (Linux, from JDK 17.0.9 on)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    args = gateway.new_array(jvm.Object, 4)  # name, operation, its arguments, their types
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(server, args)  # the server's own class is not open to calls
    except Py4JJavaError:
        return False
    return True


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back. What several branches of a plan use is made once, and a lost executor costs a reread only.

    The plan that wrote it is garbage then; once the driver collects that, Spark deletes its shuffle files, which else stand beside those of the next steps."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what ``saved`` wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
