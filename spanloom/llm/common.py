"""What the text operators share: scratch tables, ordered partitions, folds, components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a worker turns into Python objects at one time.
SLICE_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder
    takes its place; on a cluster that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        found = tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folder of this driver's tables, for each shared folder.
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of this driver's that its end deletes."""
    shared = shared_dir(spark)
    if shared not in _OWN:
        _OWN[shared] = f"{shared}/spanloom-{uuid.uuid4().hex}"
    jvm, own = spark.sparkContext._jvm, _OWN[shared]
    path = jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    made = f"{own}/{name}-{uuid.uuid4().hex}"
    if _open():
        _open()[-1].append(made)
    return made


#: Settings under which tables are written: few rows go to a worker at one time, as whole texts can
#: be long, and the shuffle files of a table that is there are deleted, as nothing needs them.
WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def write(df: DataFrame, path: str, **options: str) -> None:
    """Writes a table under WRITING; the session's own settings are as before afterwards."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


_LOCAL = threading.local()


def _open() -> list[list[str]]:
    """Of this thread: the paths that are deleted when what is being settled is there, innermost last."""
    if not hasattr(_LOCAL, "open"):
        _LOCAL.open = []
    return _LOCAL.open


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``build`` makes, as a table; all tables written on the way to it are deleted."""
    path, made = scratch(spark, name), []
    _open().append(made)
    try:
        df = build()
        write(df, path)
    finally:
        _open().pop()
        for p in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    write(df, path, **options)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo folds; a null key is of fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def least_by_hash(rows: DataFrame, limit: int, total: int, key: str = "k") -> DataFrame:
    """At most ``limit`` rows, one a key, the least by the hash of their keys; ``total``: about how many rows there are.

    Only rows below a bound that about twice ``limit`` of ``total`` keys pass are looked at, so that
    no task sends more than its part of those, however many tasks there are.
    """
    h = F.xxhash64(key)
    near = rows.where(F.col(key).isNotNull() & (F.pmod(h, F.lit(1 << 30)) <= (1 << 30) * (2.0 * limit + 64) / max(1, total)))
    rest = [c for c in rows.columns if c != key]
    once = near.groupBy(key).agg(F.min(F.struct(*rest)).alias("__x")).select(key, "__x.*") if rest else near.distinct()
    return once.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(limit)


def range_ids(df: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """Adds ``out``: 0 to n - 1, rising with the number ``key``, about as many rows in each.

    The split points are at most n - 1 numbers, so the driver holds nothing that grows with the
    data. Equal keys share an id; null keys take 0.
    """
    from pyspark.ml.feature import Bucketizer

    work = df.withColumn(out, F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    points = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    splits = [float("-inf"), *sorted({float(x) for x in points or ()}), float("inf")]
    if len(splits) == 2:
        return df.withColumn(out, F.lit(0))
    made = Bucketizer(splits=splits, inputCol=out, outputCol=f"{out}__").transform(work)
    return made.withColumn(out, F.col(f"{out}__").cast("int")).drop(f"{out}__")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text is a part of its own."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    yield batch.slice(begin)


def fingerprint_of(df: DataFrame) -> tuple[int, object]:
    """Count and order-free sum over all rows, to see whether two frames hold the same rows."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def looked_up(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The written frame ``many`` joined with ``one`` (one row for each ``key``), hot keys dealt over several tasks.

    A key with more than twice an even partition's rows (and 100) is hot; there are at most as many
    of those as half the partitions, so they are broadcast. Its rows are dealt by a hash of all
    their columns, and its row of ``one`` is sent to each part. No row is dropped, and null keys
    match nothing.
    """
    cap = max(100, 2 * many.count() // shuffle_partitions(many.sparkSession))
    counts = many.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    hot = F.broadcast(written(counts.select("__key", F.ceil(F.col("n") / F.lit(cap)).cast("int").alias("__parts")), "hot-keys"))
    names, more = many.columns, [c for c in one.columns if c != key]
    left = many.join(hot, F.col(key) == F.col("__key"), "left")
    left = left.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in names]), F.col("__parts")).cast("int"), F.lit(0))).drop("__key", "__parts")
    right = one.join(hot, F.col(key) == F.col("__key"), "left")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__key", "__parts")
    return left.join(right, [key, "__part"], how).select(*names, *more)


def salted(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many`` joined with the smaller ``one`` (one row for each ``key``), every key dealt over several tasks.

    For joins whose result is aggregated by the key again, which adaptive execution does not split.
    Rows of ``many`` are dealt by a hash of their columns, and ``one`` is sent to each part.
    """
    parts = min(64, max(8, shuffle_partitions(many.sparkSession) // 8))
    names = many.columns
    left = many.withColumn("__part", F.pmod(F.xxhash64(*[F.col(c) for c in names]), F.lit(parts)))
    right = one.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return left.join(right, [key, "__part"]).select(*names, *[c for c in one.columns if c != key])


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Nodes of undirected ``edges`` (u, v of one integer type) as (node, root), root the least node reachable.

    Alternates large-star and small-star rounds (Kiveris et al., 2014). Every round is two
    aggregations with map-side partials and two equi-joins, in which a hub's edges are dealt over
    several tasks; its edges are written to the shared folder. Nothing but a count and a checksum
    reaches the driver. An edge from a node to itself yields the node as its own root; nulls are
    dropped; an empty input gives an empty result.
    """
    edges = edges.toDF("u", "v").where("u is not null and v is not null")
    own = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    last = fingerprint_of(now)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), name)
        before, last = last, fingerprint_of(now)
        if before == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    return labels.unionByName(own.join(labels, "node", "left_anti").select("node", F.col("node").alias("root")))
