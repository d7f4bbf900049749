"""What several operators share on the Spark side."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.  Where it is unset, one is
    made, but only if driver and executors are one process: a cluster must name its own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexspan-"))
    return sc._jsc.sc().getCheckpointDir().get()


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Makes DataFrame.checkpoint() usable."""
    where = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lexspan-{what}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of a path: one without a scheme is in the cluster's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from one narrow aggregate."""
    return docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


#: A chunk takes this many bytes of text times the cube root of all the text's bytes.
CHUNK_SHARE = 8_400
#: Chunks whose share of what is sent one shard takes.
SHARD_CHUNKS = 4


def layout(size: int, chunk_bytes: int | None = None) -> tuple[int, int]:
    """Chunks and shards for so many bytes of text.

    What all chunks send to all shards comes in as many pieces as there are pairs of
    them.  Both therefore grow in number and in size with the corpus, by one
    formula at any size, so that the pieces stay worth sending: those of a byte of
    text grow with the cube root of the corpus only.  chunk_bytes sets the size."""
    chunks = max(1, -(-size // (chunk_bytes or max(1, round(CHUNK_SHARE * max(size, 1) ** (1 / 3))))))
    return chunks, -(-chunks // SHARD_CHUNKS)


def chunked(docs: DataFrame, n: int, doc_id: str = "doc_id", chunk: str = "_chunk") -> DataFrame:
    """docs hash-partitioned by a chunk number that depends on doc_id alone, so
    that rows that share a doc_id (nulls too) share a chunk.  Several uses of
    the result in one query share one exchange."""
    return docs.withColumn(chunk, F.pmod(F.xxhash64(F.col(doc_id), F.lit(n)), F.lit(n)).cast("int")).repartition(partitions(docs.sparkSession), chunk)


def in_order(t: pa.Table, doc_id: str = "doc_id", text: str = "text") -> pa.Table:
    """Rows by doc_id, then by text, nulls last, whatever order the shuffle gave."""
    return t.sort_by([(doc_id, "ascending"), (text, "ascending")])


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\x0B\\f]+"), lambda w: w != "")
