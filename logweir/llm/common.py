"""Helpers that several operators share: columns, working tables, sizes of jobs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Columns of ``documents``, in order.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp()}/{package.name}.zip"
    with zipfile.ZipFile(path, "w") as file:
        for module in sorted(package.rglob("*.py")):
            file.write(module, module.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def working_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent, a folder under the warehouse, which executors
    share too, is set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_working"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows computed once and kept as a table in the shared folder.

    Later reads take single columns of it and outlive lost executors.
    """
    spark = df.sparkSession
    path = f"{working_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, list[int]]:
    """As ``stored``, with the rows (or each of ``counts``) counted in the same job."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    wanted = counts or (F.lit(True),)
    columns = [F.count(F.when(c, 1)).alias(f"n{k}") for k, c in enumerate(wanted)]
    table = stored(df.observe(seen, *columns), name)
    return table, [seen.get[f"n{k}"] for k in range(len(wanted))]


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the rows do not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted

