"""What the operators of this subpackage share: reading, the shared folder, folds, samples."""
from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Documents are long; the defaults would hold whole partitions.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: What a Python worker keeps from task to task: loaded tokenizers.
KEPT: dict = {}


def release(keeps: bool = False) -> None:
    """Give a worker's freed memory back to the system, and, unless it keeps them, the tokenizers of an earlier stage.

    Workers live as long as executors and serve one stage after the other, so
    what one stage has freed or kept would add to the memory of the next.
    """
    if not keeps:
        KEPT.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, run, schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow with columns by name: ``run`` gets an iterator of {name: list} and yields {name: values}.

    Arrow keeps null integers exact, where pandas would make them floats. ``keeps``: ``run`` uses KEPT.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def go(batches):
        import pyarrow as pa

        if not keeps:
            release()
        for made in run({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)
        release(keeps)

    return df.mapInArrow(go, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset (a local session, as in tests) a temporary folder
    takes its place; it goes when the driver ends.
    """
    sc = spark.sparkContext
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not (where := getattr(sc, "_folioscan_shared", None)):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="folioscan-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        where = sc._folioscan_shared = f"file://{local}"
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/folioscan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, lost executors cost no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffles of plans that nothing holds any more: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as fold 1, a training fold without labels."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(1))


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 0


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever columns came along."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def sample_labels(labels: DataFrame, column: str, rows: int, folds=(1, 2, 3, 4)) -> DataFrame:
    """At most ``rows`` labelled ids, half of each class, chosen by a hash of the id.

    Rows with a null id or label are left out; an id with several labels counts
    once, with the largest. The result has (doc_id, label, weight), the weight
    making up for the share of its class that was taken, and at most ``rows``
    rows, so that it can be broadcast.
    """
    one = (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & fold().isin(*folds))
    )
    totals = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for k in (0, 1):
        part = one.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        weight = max(1.0, totals.get(k, 0) / max(1, rows // 2))
        parts.append(part.withColumn("weight", F.lit(float(weight))))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("weight").alias("weight"))


def labelled_texts(docs: DataFrame, sample: DataFrame, longest: int = 200_000) -> DataFrame:
    """(doc_id, text, label, weight) of the sampled ids; the sample is bounded, so it is broadcast.

    Texts beyond ``longest`` characters are not trained on, which bounds the sample's bytes too.
    """
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter(F.length(F.coalesce("text", F.lit(""))) <= longest)
