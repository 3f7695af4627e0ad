"""What the workers need, this package, wherever it is installed; and tables that a flow meets more than once."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once a Spark context, whether or not it is installed on their machines."""
    context = spark.sparkContext
    if getattr(context, "_narrative_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="narrative-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, f"{package.name}/{file.relative_to(package)}")
    context.addPyFile(str(target))
    context._narrative_shipped = True


#: Limits of one Arrow batch on its way to Python. They bound a worker's memory whatever the length of the texts.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
}


def bounded_arrow(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes for plans that this session runs from now on.

    Plans read these two settings when they run, after an operator has returned, so they stay set. A smaller bound that
    the session has already is left alone.
    """
    ship_package(spark)
    for key, value in ARROW_CONF.items():
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) < int(value)):
            spark.conf.set(key, value)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder of ``spark.checkpoint.dir``, so that what it costs, a model's replies above all, is
    paid once and survives a lost executor. The folder goes when Spark ends.

    Where no folder is set, as in a local session, it is cached.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df.persist()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Give up a table of :func:`kept` that nothing reads any more."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        df.unpersist()
        return
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
