"""Reading tables that may not exist yet.

"No table yet" is decided by the file system, never by a failed read: an
unreadable file, a lost connection or a schema clash raises, so no writer can
take a damaged table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def entries(spark: SparkSession, path: str) -> list[str]:
    """Visible names directly below ``path``; none if it does not exist."""
    p, fs = _root(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if not n.startswith(("_", ".")))


def modified(spark: SparkSession, path: str) -> list[int]:
    """Modification times (ms) of the visible files directly below ``path``; none if it does not exist."""
    p, fs = _root(spark, path)
    if not fs.exists(p):
        return []
    return [s.getModificationTime() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))]


def set_time(spark: SparkSession, path: str, at_ms: int) -> None:
    """Set a file's modification time; a store that does not keep it raises."""
    p, fs = _root(spark, path)
    fs.setTimes(p, at_ms, -1)
    if fs.getFileStatus(p).getModificationTime() != at_ms:
        raise RuntimeError(f"{path}: this store does not keep file times, so files cannot be told apart by age")


def move_file(spark: SparkSession, src: str, dst: str) -> None:
    p, fs = _root(spark, src)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dst)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"{src} could not be moved to {dst}")


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small text file, such as a checkpoint's list of one read; none if it does not exist."""
    p, fs = _root(spark, path)
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).splitlines()
    finally:
        stream.close()


def set_ages(spark: SparkSession, path: str) -> None:
    """Give the files directly below ``path`` rising modification times in the order of their names.

    A file stream takes older files first. Times are a second apart, as some stores
    keep whole seconds, and end now; a store that cannot set times raises.
    """
    p, fs = _root(spark, path)
    names = entries(spark, path)
    newest = max((s.getModificationTime() for s in fs.listStatus(p)), default=0) // 1000 * 1000
    at = {n: newest - 1000 * (len(names) - i) for i, n in enumerate(names)}
    for n, t in at.items():
        set_time(spark, f"{path}/{n}", t)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``; 0 if it does not exist."""
    p, fs = _root(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def replace_parts(spark: SparkSession, journal: str, path: str) -> None:
    """Put every partition folder of a finished ``journal`` in the place of its namesake below ``path``, by renames."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    p, fs = _root(spark, journal)
    for n in entries(spark, journal):
        fs.delete(new(path, n), True)
        if not fs.rename(new(p, n), new(path, n)):
            raise OSError(f"{journal}/{n} could not be put in place")


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there are no files; read errors propagate."""
    return spark.read.parquet(path) if entries(spark, path) else None


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed (its success marker is there)."""
    p, fs = _root(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _root(spark, path)
    fs.delete(p, True)


def write_epoch(df: DataFrame, path: str, epoch_id: int, keep: int = 20) -> None:
    """Write a small state as ``path/epoch=N`` and drop all but the newest ``keep`` epochs.

    A replayed epoch overwrites its own folder only, so the state of earlier
    epochs is never at risk.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    for n in epochs(spark, path)[:-keep]:
        remove(spark, f"{path}/epoch={n}")


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Committed epochs below ``path``, rising."""
    found = sorted(int(n[6:]) for n in entries(spark, path) if n.startswith("epoch="))
    return [n for n in found if finished(spark, f"{path}/epoch={n}")]


def read_epoch(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The state of the newest committed epoch (below ``before``), or None."""
    found = [n for n in epochs(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/epoch={found[-1]}") if found else None
