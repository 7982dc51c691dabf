"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARE = 500_000  # rows of a partition that is dealt by number


def local_session(cores: str = "8", partitions: int = 8, name: str = "roadweave") -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the
    cluster names one, else, with a local master, a folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="roadweave-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet files in the shared folder. They cut the lineage as a checkpoint does, and take less of the disk."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys, to more partitions the more rows it has, so that a task's share doesn't grow with the table. Joins
    and groups by these keys deal it no second time. The rows are counted first, which costs little for a table as it is read."""
    return df.repartition(shares(df.sparkSession, df.count()), *keys)


def shares(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's number, or more if one would get more than SHARE rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARE))


def spread(df: DataFrame) -> DataFrame:
    """df, of which no join makes a broadcast: the size of a file says little of the rows that are unfolded from it, and a
    broadcast passes whole through the driver. The hint holds for what is derived from df up to its next join."""
    return df.hint("merge")


def cut_spread(df: DataFrame) -> DataFrame:
    return spread(cut(df))
