"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tablewash", master: str | None = None, shuffle_partitions: int | None = None,
              **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win where they exist."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is chosen only when the session names none and runs in local mode:
    on a cluster a machine-local folder would not survive the loss of its executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            _require_one_machine(spark)
            folder = tempfile.mkdtemp(prefix="tablewash-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _require_one_machine(spark: SparkSession) -> None:
    """Executors of their own, also those of ``local-cluster``, cannot see each other's files."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for intermediate files, in the shared folder of the session if it names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tablewash-{uuid.uuid4().hex}"
    _require_one_machine(spark)
    return tempfile.mkdtemp(prefix="tablewash-")
