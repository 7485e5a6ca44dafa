"""Sessions, table access and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables kept inside the open scratch() blocks of this thread or task, the innermost last.
_SCRATCH: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marginalia")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than the session has cores, dealt over all of them for costly work on its rows; other scans as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it one that df has no column of, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Only a local master may fall back to a folder under /tmp; a cluster without
    a shared folder is an error rather than a silent use of one machine's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/marginalia-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def keep(df: DataFrame, name: str, hold: bool = False, rows_per_file: int = 0, batch_bytes: int = 0) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there.

    A lost executor costs only the tasks that read the table again. Shuffle
    files of the write are deleted when it ends, so a job of many steps holds
    those of one step at a time. hold: an open scratch() leaves the table.
    rows_per_file: for rows of megabytes, which readers take many of at once.
    batch_bytes: what goes to a Python worker at once, if not the session's own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {CLEAN_SHUFFLES: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if _SCRATCH.get() and not hold:
        _SCRATCH.get()[-1].append(out)
    return out


def in_turn(parts: Iterator[DataFrame], name: str, most: int = 32) -> DataFrame:
    """The rows of all parts, each written before the next is begun, so that shuffles of one at a time are held; `most` tables become one."""
    done: list[DataFrame] = []
    for part in parts:
        done.append(keep(part, name))
        if len(done) == most:
            one = keep(reduce(DataFrame.unionByName, done), name)
            discard(*done)
            done = [one]
    return reduce(DataFrame.unionByName, done)


def discard(*kept: DataFrame) -> None:
    """Deletes tables that keep() wrote and that nothing will read again; other frames are left alone."""
    for df in kept:
        path = getattr(df, "kept_at", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
            df.kept_at = None


@contextmanager
def scratch() -> Iterator[None]:
    """Tables kept inside the block are deleted when it ends, but for held ones: keep the result of the block with hold."""
    token = _SCRATCH.set((*_SCRATCH.get(), []))
    try:
        yield
    finally:
        tables = _SCRATCH.get()[-1]
        _SCRATCH.reset(token)
        discard(*tables)


def tidied(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """A function of many kept tables that leaves only its result, which an open scratch() of the caller deletes."""

    def of(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(*args, **named) -> DataFrame:
            with scratch():
                out = keep(f(*args, **named), name, hold=True)
            if _SCRATCH.get():
                _SCRATCH.get()[-1].append(out)
            return out

        return run

    return of
