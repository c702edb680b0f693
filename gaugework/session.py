"""Session settings and the few helpers that need the session itself."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gaugework")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture doubles the driver round trips of building a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gaugework-")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a fresh folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_folder()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``version=<n>`` tables below a path whose writing ended."""
    folder, system = _folder(spark, path)
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    done = [n for n in names if n.startswith("version=") and system.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n.split("=")[1]) for n in done)


def known_size(df: DataFrame) -> int | None:
    """Catalyst's size bound of the optimized plan in bytes, if it can be read."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:
        return None


def input_size(df: DataFrame) -> int | None:
    """Stored bytes of all tables the plan reads (estimates of joins multiply; these add)."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(
            int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())
        )
    except Exception:
        return None


def spread_small(df: DataFrame) -> DataFrame:
    """Spread rows of a table that fits one read task over all cores.

    Large tables come in many tasks anyway and are returned as they are.
    """
    spark = df.sparkSession
    size = input_size(df)
    one_task = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if size is None or size > one_task:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def spread_tasks(df: DataFrame, task_bytes: int = 32 << 20) -> int:
    """A task per ``task_bytes`` of stored input, and one per core at least."""
    size, cores = input_size(df), df.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-size // task_bytes)) if size is not None else 32 * cores


def spread_heavy(df: DataFrame, task_bytes: int = 2 << 20, by: Sequence[str] = ()) -> DataFrame:
    """Spread narrow rows that cost much work each: evenly, or by hashes of columns that few rows share."""
    return df.repartition(spread_tasks(df, task_bytes), *by)


def join_small(
    big: DataFrame,
    small: DataFrame,
    condition,
    how: str = "inner",
    salt_on: str | None = None,
    salts: int = 32,
) -> DataFrame:
    """Join a table of unknown key skew to a normally small one.

    ``condition`` maps ``(big, small)`` to a join column.  The small side is
    broadcast only when its size estimate is below the session's broadcast
    threshold.  Otherwise the small side is replicated once per salt, so that one
    hot key of the big side is spread over ``salts`` tasks and the result is the
    same.  ``how`` may be ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    spark = big.sparkSession
    limit = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    size = known_size(small)
    if size is not None and 0 <= size <= limit:
        return big.join(F.broadcast(small), condition(big, small), how)
    if salt_on is None:
        return big.join(small, condition(big, small), how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    right = small.withColumn(
        "_salt_r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    joined = left.join(
        right, (left["_salt"] == right["_salt_r"]) & condition(left, right), how
    )
    return joined.drop("_salt", "_salt_r")


def _bytes(text: str) -> int:
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
             "g": 1 << 30, "gb": 1 << 30}
    digits = text.strip().lower()
    number = digits.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(number) * units.get(digits[len(number):] or "b", 1)
