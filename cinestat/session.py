"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library assumes. AQE re-plans joins from runtime sizes (its
# broadcast switch is size-checked, with sort-merge as the fallback), coalesces
# small shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state on disk, not in the executors' heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, app: str = "cinestat", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (clusters bring their own)."""
    os.environ.setdefault("TZ", "UTC")
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    # a single JVM does all the work: half of the machine, at most 16 GB
    ram = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 30
    conf["spark.driver.memory"] = f"{max(1, min(16, ram // 2))}g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment and is read as is; a
    cluster session without it is an error. Only a local session (tests)
    without it gets a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # executors on other machines could not read a driver-local folder
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        d = tempfile.mkdtemp(prefix="cinestat-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 -- some sessions refuse core settings at run time
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, so that Python workers find it wherever
    the job was started from: an archive in the shared folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    jvm = spark.sparkContext._jvm
    with tempfile.TemporaryDirectory() as folder:
        local = jvm.org.apache.hadoop.fs.Path(shutil.make_archive(f"{folder}/cinestat", "zip", root, "cinestat"))
        shared = jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'package')}/cinestat.zip")
        shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(local, shared)
    spark.sparkContext.addPyFile(shared.toString())


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts the lineage for a multi-pass operator so upstream stages run
    once, and a lost executor re-reads files instead of recomputing them."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def cluster_settings(input_bytes: float, shuffle_fraction: float = 0.3, executor_cores: int = 4,
                     executor_memory_gb: int = 16, target_partition_mb: int = 256,
                     max_partitions: int = 50000) -> dict[str, str]:
    """Settings sized for an input of ``input_bytes`` on a cluster.

    ``shuffle_fraction`` is the share of the input that still crosses a
    shuffle after column pruning and map-side partial aggregation. The
    initial shuffle partition count puts about ``target_partition_mb`` of it
    in each reduce task, capped at ``max_partitions`` (map tasks x reduce
    partitions is the number of shuffle blocks; beyond ~50k reducers the block
    count, not the data, becomes the cost). AQE then coalesces small
    partitions and splits skewed ones; its advisory size stays well below
    what one core's share of executor memory sorts without heavy spilling.
    Broadcast limits are checked twice: against the planner's estimate
    (16 MB) and against AQE's measured stage size (64 MB)."""
    mb = 1024 * 1024
    partitions = int(min(max_partitions, max(200, input_bytes * shuffle_fraction / (target_partition_mb * mb))))
    per_core_mb = executor_memory_gb * 1024 // max(executor_cores, 1)
    advisory = min(target_partition_mb, max(64, per_core_mb // 8))
    return {
        **{k: v for k, v in BASE_CONF.items() if not k.startswith("spark.ui")},
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{advisory}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * advisory}m",
        "spark.sql.files.maxPartitionBytes": f"{min(target_partition_mb, 512)}m",
        # broadcasts: a small limit for the planner's size estimates, a larger
        # one for AQE, which decides from the measured size of a finished
        # shuffle stage; beyond either limit the join stays sort-merge
        "spark.sql.autoBroadcastJoinThreshold": "16m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    }
