"""Small helpers shared by the operators: sessions, scratch folders, names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name starting with ``stem`` that none of ``frames`` uses."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> F.Column:
    """A column by its literal name; dots and spaces in it are no syntax."""
    return F.col("`" + name.replace("`", "``") + "`")


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder the cluster names.

    ``spark.checkpoint.dir`` wins where it is set. Only where it is unset on a
    local master, as in tests, a temporary folder takes its place; on a cluster
    that would be a folder no other machine sees, and ``ValueError`` is raised.
    Checkpoints are deleted once nothing in the session refers to them.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="readroute-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared checkpoint folder, for loops.

    Unlike a checkpointed frame, a table read back carries no constraints of
    the plan that made it, which in a loop grow without end. All tables are
    deleted on leaving; results that have to outlive it are cut() before.
    """

    def __init__(self, spark: SparkSession):
        use_checkpoints(spark)
        self.spark = spark
        self.root = spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/scratch-" + uuid.uuid4().hex
        self.made = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, **what: F.Column) -> tuple[DataFrame, dict]:
        """The table, and aggregates over its rows taken while it is written;
        all are 0 where there are none."""
        watch = Observation()
        table = self.write(df.observe(watch, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in what.items()]))
        got = watch.get
        return table, {k: got.get(k) or 0 for k in ("n", *what)}

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` for columns of any name, dots and blanks included."""
    names = df.columns

    def renamed(batches):
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, schema)
