"""Session set-up and the one place where work is cut from its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "millwright") -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "2m")  # small test files still make a task for each core
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.scheduler.mode", "FAIR")  # folds of a cross-validation share the cores
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and saved models.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that names none gets a
    folder of its own: executors on other hosts could not read it back.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    in_use = spark.sparkContext._jsc.sc().getCheckpointDir()
    if in_use.isDefined():
        return configured or in_use.get()
    if configured is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="millwright-checkpoints-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the checkpoint folder, and read it from there ever after.

    Used where a small summary feeds several branches of a plan (so the fact table is scanned once)
    and where a column depends on where a row landed (so a retried task cannot change it).
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def settle_columns(df: DataFrame) -> DataFrame:
    """Like ``settle``, but kept by column: for a table of many rows whose readers want few of its columns.

    Nothing may hang on the partitions it was made in, as it is read back in splits of its files.
    """
    path = f"{own_folder(df.sparkSession, 'results')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, name: str) -> str:
    """Where this session keeps written results of a kind, below the shared folder."""
    return f"{checkpoint_root(spark)}/{name}/{spark.sparkContext.applicationId}"


#: Kinds of results that sessions write below the shared folder.
KINDS = ("ingest", "results", "models", "llm")


def clear(spark: SparkSession) -> None:
    """Remove what this session settled and wrote into the shared folder; for the end of a session.

    Long sessions set ``spark.cleaner.referenceTracking.cleanCheckpoints`` as well, which drops a settled table when
    nothing refers to it any more. Nothing settled can be read after this call.
    """
    folders = [own_folder(spark, kind) for kind in KINDS]
    settled = spark.sparkContext._jsc.sc().getCheckpointDir()
    if settled.isDefined():
        folders.append(settled.get())
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    root = checkpoint_root(spark)
    spark.sparkContext.setCheckpointDir(root)  # a new folder for what comes after
