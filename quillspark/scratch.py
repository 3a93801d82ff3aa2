"""Tables written to the shared checkpoint folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CREATED: dict[str, str] = {}
SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session may go without: it gets a temporary folder of its
    own. A cluster session without the setting is an error, since a local
    folder is not visible to other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _CREATED:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _CREATED[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _CREATED[app]


class Scratch:
    """Writes intermediate tables of one query below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, name: str = "t", spent: bool = False) -> DataFrame:
        """Writes ``df`` and returns a reader of what was written. With ``spent`` the
        shuffle files of the write are deleted as soon as it is done; Spark would keep
        them until the driver's JVM finds the plan unused, which may never happen."""
        self._n += 1
        path, conf = f"{self.root}/{self._n}-{name}", self.spark.conf
        before = conf.get(SPENT)
        conf.set(SPENT, str(spent or before == "true").lower())
        try:
            df.write.parquet(path)
        finally:
            conf.set(SPENT, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets the driver's JVM find plans that are done, so that Spark deletes
        their shuffle files now and not when memory happens to run short."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *kept: DataFrame) -> None:
        """Deletes kept tables that no plan to come reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in kept:
            for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def build_side(few: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``few`` (narrow rows; a kept table, at best) as the side of a join that is held
    in hash tables: up to ``limit`` rows it is broadcast, so that the other side is not
    shuffled; beyond, both are dealt by key. Either way the other side's wide rows are
    not sorted, and the join gives the same rows."""
    from pyspark.sql import functions as F

    return F.broadcast(few) if few.limit(limit + 1).count() <= limit else few.hint("shuffle_hash")


def restrict(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi", limit: int = 1_000_000) -> DataFrame:
    """Semi or anti join of ``df`` with the key columns ``ids``, held by ``build_side``."""
    return df.join(build_side(ids, limit), key, how)
