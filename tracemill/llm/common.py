"""What the operators share: the folder all executors see, and tables written there."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


#: Folders of the tables written so far, by application.
_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor costs no more than a read. release() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that materialize() has written for this application; what still reads them fails. Also done when Python ends before Spark."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    conf = context._jsc.hadoopConfiguration()
    for name in _WRITTEN.pop(context.applicationId, []):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


#: A hash range has about so many bytes of text to itself at most.
RANGE_BYTES = 32_000_000


def fragments(docs: DataFrame) -> int:
    """Into how many ranges a hash space is cut: as many as the session has shuffle partitions, or more for a larger input."""
    size = docs.agg(F.sum(F.octet_length(docs["text"].cast("string")))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string) alone, so that no other column of docs can clash with an operator's own."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
