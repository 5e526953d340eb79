"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by :func:`cut`, removed when the process ends.
_written: list[tuple[SparkSession, str]] = []
#: Where the frames that :func:`cut` gave lie, by identity.
_places: dict[int, tuple[str, DataFrame]] = {}


def get_session(app: str = "tracemill", cores: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is given."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores or '*'}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle or cores or 8))
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset (a local test) a folder of this machine is taken.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tracemill-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with what lies beside it by :func:`drop_cuts`."""
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(drop_cuts)
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    The plan upstream runs once, its result survives the loss of executors, and
    later readers prune columns. The files go when the process ends, those of
    ``instead_of`` (a cut that nothing else reads) as soon as these are written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if instead_of is not None:
        _remove(spark, _places.pop(id(instead_of))[0])
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = path, out
    return out


def _remove(spark: SparkSession, path: str) -> None:
    _written.remove((spark, path))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_cuts() -> None:
    """Remove what :func:`cut` wrote."""
    _places.clear()
    while _written:
        try:
            _remove(*_written[-1])
        except Exception:  # the JVM may be gone already
            _written.clear()
