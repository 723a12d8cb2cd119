"""What a session needs before its workers run this package's functions, and where plans are cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once for each SparkContext, so that workers can
    import it wherever they were started."""
    context = spark.sparkContext
    if getattr(context, "_stripchart_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="stripchart-code-")) / "stripchart_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._stripchart_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the context's
    checkpoint folder. Where neither is set, a local session gets a temporary folder, and on a
    cluster it is an error, as no folder of one machine would do."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stripchart-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept as Parquet in the folder that executors share: later steps read
    the columns they need from there instead of planning and running what made it again. Packed
    files look small, so joins with it merge sorted rows unless they are told otherwise: the driver
    gathers no table for its size on disk or before an explosion."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stripchart/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


#: Rows of a table that are exploded by one task.
SPREAD = 256


def parts_of(df: DataFrame, rows: int = SPREAD) -> int:
    """Partitions of about so many of df's rows, no fewer than the session's cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, *keys: str, rows: int = SPREAD) -> DataFrame:
    """df, a table of short rows, dealt by keys, or in turn, into parts of about so many rows, for
    what each row explodes to or costs: files of short rows are read by one task, which would do all
    of it."""
    return df.repartition(parts_of(df, rows), *keys)
