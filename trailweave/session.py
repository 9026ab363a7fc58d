"""Session defaults.  On a cluster, pass your own session instead."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


_SCRATCH: dict[str, str] = {}


def build_session(app: str = "trailweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.variant.allowDuplicateKeys": "true",  # the last value of a repeated key counts
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    A machine-local scratch folder is made only for a session that runs in one process
    (``local[n]``); a cluster without the setting gets an error, because its executors
    would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _SCRATCH:
        _SCRATCH["folder"] = tempfile.mkdtemp(prefix="trailweave-")
    return _SCRATCH["folder"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (``checkpoint_folder``)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: columns compress well, where a
    checkpoint holds whole rows, and later jobs read only the columns they need."""
    path = f"{checkpoint_folder(df.sparkSession)}/trailweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, most: int = 500_000) -> DataFrame:
    """Broadcast hint for a lookup table that is cheap to count, if it is small enough.

    A larger table keeps the planner's choice: a shuffled join, split by AQE on skew.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A table from a few driver-side rows, kept in the plan (no Python worker reads it).

    Nested structs are given as dictionaries.
    """
    struct = T.StructType.fromDDL(schema)
    records = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(struct)), schema=struct)
