"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only where that is unset (tests, one machine) is a temporary one made."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, without lineage."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def plus(schema: StructType, added: str) -> StructType:
    """The schema with columns added at its end; an older column of such a name is replaced."""
    new = StructType.fromDDL(added)
    names = {f.name.lower() for f in new}
    return StructType([StructField(f.name, f.dataType, True) for f in schema if f.name.lower() not in names] + list(new))


def extended(batch: pa.RecordBatch, **added) -> pa.RecordBatch:
    """The batch with columns added at its end; an older column of such a name is replaced."""
    names = {k.lower() for k in added}
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in names]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in keep] + list(added.values()), names=[batch.schema.names[i] for i in keep] + list(added)
    )


def free(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def total_chars(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])


def filled_name(batch: pa.RecordBatch, name: str) -> str:
    """The name as the batch spells it; Spark's names don't heed case."""
    return next(n for n in batch.schema.names if n.lower() == name.lower())
