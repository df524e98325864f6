"""What the operators share: the scratch folder, tables cut from their lineage, batch sizes, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch carries to a Python worker; a batch always holds one row at least.
BATCH_BYTES = 4 << 20
#: Rows in one such batch.
BATCH_ROWS = 2000
#: Edges that one task thins to a spanning forest.
FOREST_EDGES = 200_000

#: Spark's setting by which an execution's shuffle files go when it ends.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where that is unset a local master gets a temporary folder; on a
    cluster, whose executors couldn't see one, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the scratch root; it is removed when the driver's interpreter ends."""
    path = f"{scratch_root(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM may have ended before; the folder then goes with the cluster's own clean-up
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the scratch folder: lineage ends there and a lost executor costs no more than a reread.

    The shuffle files of the write go with it; else they stay until the driver happens to collect its garbage. A write has
    shuffles of its own, so nothing else reads them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing that is still to run reads them."""
    for t in tables:
        spark = t.sparkSession
        for file in t.inputFiles()[:1]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if at.getName().startswith("tessera-"):
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, so that many long texts never meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _without_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task that join what its earlier edges left apart."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for b in batches:
        keep = []
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            i, j = find(u), find(v)
            keep.append(i != j)
            up[max(i, j)] = min(i, j)
        yield b.filter(pa.array(keep, pa.bool_()))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Component of every vertex in ``edges(u, v)`` as ``(id, component)``, component being its smallest vertex.

    Edges are first thinned to a spanning forest in parts of a bounded size. Then it alternates the large-star and small-star
    steps, which halve the depth of every tree, until no edge changes. Each round is written to the scratch folder. Degrees
    are reduced by partial aggregates, and the joins are plain equi-joins that adaptive execution splits where one vertex has
    very many edges. Self-loops and repeated edges change nothing; without edges there are no rows.
    """
    both = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    parts = -(-both.count() // FOREST_EDGES)
    state, before = written(both.repartition(max(1, parts)).mapInArrow(_without_cycles, "u long, v long"), name), None
    discard(both)
    while True:
        # large-star: every larger neighbour of u moves to u's smallest neighbour or u itself
        sides = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, state = state, written(small, name)
        discard(last)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component")).distinct()
        before = now
