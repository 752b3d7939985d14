"""Session helpers: sensible defaults for scale, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans shuffles at runtime (partition
# coalescing, skew-join splitting, broadcast conversion from measured sizes).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusforge") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSFORGE_DRIVER_MEMORY", "8g"))
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be configured (a folder every executor can reach).
    Only a local-mode session without one gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for this cluster"
        )
    folder = tempfile.mkdtemp(prefix="corpusforge-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df, name: str = "stage"):
    """Write ``df`` once as a parquet table in the shared checkpoint folder and
    read it back. The plan above it runs exactly once (``Dataset.checkpoint``
    would compute it twice without a cache), later passes read only the
    columns they need, and a lost executor never replays the lineage."""
    spark = df.sparkSession
    try:
        folder = checkpoint_dir(spark).rstrip("/")
    except RuntimeError:
        raise
    except Exception:  # no SparkContext (e.g. Spark Connect): keep it on executors
        from pyspark import StorageLevel

        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        return kept
    path = f"{folder}/corpusforge-{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


_SCOPES: list[list[Scratch]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes, at its end, every table that jobs inside it have left. For a
    caller that has written what it needs of their lazy results."""
    made: list[Scratch] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for scratch in made:
            scratch.drop()


class Scratch:
    """Intermediate tables of one job in the shared checkpoint folder.

    ``cut`` writes a frame as ``cut_lineage`` does; ``drop`` deletes every table
    written so far but those that ``keep`` reads, so a finished job leaves
    only what its lazy result still needs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/corpusforge-{name}-{uuid.uuid4().hex}"
        self._tables: dict[str, object] = {}
        self._made = 0
        if _SCOPES:
            _SCOPES[-1].append(self)

    def new_folder(self, name: str) -> str:
        """A path under this job's folder for a caller that writes files itself."""
        self._made += 1
        path = f"{self.path}/{name}-{self._made}"
        self._tables[path] = None
        return path

    def cut(self, df, name: str = "stage"):
        path = self.new_folder(name)
        df.write.mode("error").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._tables[path] = kept
        return kept

    def drop(self, keep=()) -> None:
        """Delete the tables that are not in ``keep``, at a job's end; then let
        the driver collect garbage, on which Spark frees the job's plans, shuffle
        files and broadcasts (it would wait for its heap to fill, or half an hour)."""
        self._delete([p for p, t in self._tables.items() if not any(t is k or p == k for k in keep)])
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def delete(self, *tables) -> None:
        """Delete these tables."""
        self._delete([p for p, t in self._tables.items() if any(t is k or p == k for k in tables)])

    def _delete(self, paths: list[str]) -> None:
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for path in paths:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            del self._tables[path]


def balanced(df, min_partitions: int | None = None):
    """Spread a scan over at least ``min_partitions`` tasks before CPU-heavy
    narrow work. Large inputs already have many file splits and pass
    through untouched; a small file with one row group would otherwise run
    all its regex and UDF work in a single task."""
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # e.g. a Spark Connect session: leave planning to AQE
        return df
    return df if have >= want else df.repartition(want)


_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Make this package importable by the Python workers (UDFs and
    ``mapInPandas`` functions are pickled by module reference): zip it once
    per application and hand it to ``SparkContext.addPyFile``, Spark's own
    way of distributing Python code to executors."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: use spark.addArtifacts / an installed package
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="corpusforge-pyfiles-"), "corpusforge.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
