"""Session factory and the helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def get_session(app: str = "mnemoframe", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and the session is local (tests, a
    laptop) a temporary folder of our own is made and used for the life of the
    application; on a cluster that folder would be the driver's alone.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="mnemoframe-")
    return _OWN_DIR[app]


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage and survives the loss of an executor; a later stage
    that reads the table twice does not compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemoframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Largest estimated size of a side that is sent to every executor by a hint.
HINT_BYTES = 8 << 20


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size in bytes; no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def hinted(df: DataFrame, most: int = HINT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is estimated at ``most`` bytes or less; else as it is, and AQE decides by its real size."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if size_of(df) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clean_up(spark: SparkSession) -> None:
    """Remove what ``materialize`` wrote for this application; results not yet read are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mnemoframe")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
