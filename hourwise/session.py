"""Session settings and lineage cuts."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("hourwise")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .getOrCreate())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of `df`: survives the loss of any executor.

    The folder is the one the cluster names in spark.checkpoint.dir. Only a local session, where no cluster names
    one, gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared_root(df.sparkSession))
    return df.checkpoint()


_OWN: dict[str, str] = {}


def _shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a temporary folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="hourwise-checkpoint-")
        shared = _OWN[context.applicationId]
    return shared


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path, not yet there, below the folder that driver and executors share."""
    return f"{_shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Lease:
    """A frame kept for later readers, until it is released."""

    def __init__(self, frame: DataFrame, path: str | None = None):
        self.frame, self.path = frame, path
        _LEASES.setdefault(frame.sparkSession.sparkContext.applicationId, []).append(self)

    @property
    def held(self) -> bool:
        return self in _LEASES.get(self.frame.sparkSession.sparkContext.applicationId, [])

    def release(self) -> None:
        """Gives the memory, or the folder that the frame was written to, back. Releasing twice does nothing."""
        spark = self.frame.sparkSession
        if not self.held:
            return
        _LEASES[spark.sparkContext.applicationId].remove(self)
        if self.path is None:
            self.frame.unpersist()
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_LEASES: dict[str, list[Lease]] = {}


def leased(df: DataFrame) -> Lease:
    """`df` kept (memory, then disk) until released."""
    return Lease(df.persist(StorageLevel.MEMORY_AND_DISK))


def stored(df: DataFrame, name: str) -> Lease:
    """`df` written to the shared folder now and read from there, so that nothing behind it is worked out again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return Lease(df.sparkSession.read.parquet(path), path)


def release_all(spark: SparkSession) -> int:
    """Releases every lease of the application; returns how many there were."""
    mine = list(_LEASES.get(spark.sparkContext.applicationId, []))
    for lease in mine:
        lease.release()
    return len(mine)


@contextmanager
def kept(*frames: DataFrame):
    """Keep frames that several jobs read (memory, then disk) and release them afterwards."""
    held = [f.persist(StorageLevel.MEMORY_AND_DISK) for f in frames]
    try:
        yield held[0] if len(held) == 1 else held
    finally:
        for f in held:
            f.unpersist()
