"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Partitions over which ``spread`` deals out small tables; unset: it does not.
SPREAD = "spark.harvestry.spreadPartitions"

# Settings that change results, or that the plans count on at scale.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages vary a thousandfold in size: bound Arrow batches by bytes too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built, and send
    the package to its executors."""
    ship_package(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[8]", app: str = "harvestry", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in {**RUNTIME_CONF, "spark.sql.shuffle.partitions": "8", **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that an iteration survives lost executors.

    The folder comes from ``spark.checkpoint.dir``, see ``shared_folder``.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Without it a session on one machine (tests)
    gets a temporary folder; a cluster, whose executors would not see that
    folder, is refused."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="harvestry-")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name for tables a job writes and reads back, under
    ``shared_folder``."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each context:
    the Python steps name them, and executors may start in another folder."""
    context, package = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_harvestry_shipped", False) or not package.is_dir():
        return  # sent before, or itself run from an archive that was sent
    archive = f"{tempfile.mkdtemp(prefix='harvestry-')}/harvestry.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for module in sorted(package.rglob("*.py")):
            z.write(module, module.relative_to(package.parent))
    context.addPyFile(archive)
    context._harvestry_shipped = True


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows out before a CPU-heavy step, over as many partitions as the
    caller or the session's ``spark.harvestry.spreadPartitions`` says.

    Without either, and in streams, rows stay in the splits of their scan: a
    large table has enough of them. The setting is for tables of few files or
    row groups, which a few tasks would read while other cores are idle.
    """
    n = partitions or int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(n) if n and not df.isStreaming else df
