"""What the operators share: durable cuts of lineage and Arrow plumbing."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: whole texts are long, and batches wait in Python and in the JVM.
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; sets the session's Arrow batches to a size that suits texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master without that setting, as in tests, gets a folder of its own.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: smaller there than a checkpoint, for large rows.

    Four partitions of a shuffle share a file, but there are never fewer files than keep all cores busy.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    files = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    df.coalesce(files).write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of the tables that stash has written in this process.
_written: list[str] = []


def discard(spark: SparkSession) -> int:
    """Delete the tables that operators have written so far, once their results are stored; how many they were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


#: Keys with more than HEAVY rows are spread, the HEAVY_KEYS heaviest of them: any other has less than its share of the rows by HEAVY_KEYS.
HEAVY, HEAVY_KEYS = 4096, 100_000


def spread_join(rows: DataFrame, counts: DataFrame, keys: list[str], salt: list[str], most: int = HEAVY_KEYS) -> DataFrame:
    """rows joined to counts on keys; counts has one row a key and in n how many rows the key has.

    A key with many rows is cut into n / HEAVY parts, to which rows go by a hash of the salt columns and its row of
    counts by copies. Only the heaviest keys, most of them at most, are broadcast. n is dropped.
    """
    parts = F.ceil(F.col("n") / HEAVY).cast("int")
    heavy = counts.where(F.col("n") > HEAVY).select(*keys, parts.alias("_parts")).orderBy(F.desc("_parts"), *keys).limit(most)
    rows = rows.join(F.broadcast(heavy), keys, "left")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return rows.join(counts, [*keys, "_salt"]).drop("_salt")


class Shared:
    """A broadcast value that travels pickled by value, classes of this package included, so workers need no copy of the library."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.held = None

    def __getstate__(self):
        return self.__dict__ | {"held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = (pickle.loads(self.bytes.value),)
        return self.held[0]


def map_rows(
    df: DataFrame, function: Callable[..., Iterable[tuple]], schema: str, *, rows_per_batch: int = 20000
) -> DataFrame:
    """Apply function(*columns as lists) -> rows to every Arrow batch of df."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(function(*[c.to_pylist() for c in batch.columns]))
            for k in range(0, len(rows), rows_per_batch):
                columns = list(zip(*rows[k : k + rows_per_batch], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text falls on the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def share_of(key: Column) -> Column:
    """md5 of key as a number from 0 to 1."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double") / float(16**13)


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The rows with the smallest md5 of key: the same ones in any run or layout.

    Rows far above the expected cut are left out before the sort, so that no task
    gathers more than a few times the bound.
    """
    total = df.count()
    if total > 2 * rows:
        df = df.where(share_of(key) < (2 * rows + 50) / total)
    return df.withColumn("_order", F.md5(key.cast("string"))).orderBy("_order").limit(rows).drop("_order")


def sample_rows(df: DataFrame, id_column: str, rows: int) -> DataFrame:
    """The rows of df whose ids are among the bounded number with the smallest md5; ids alone are sorted."""
    ids = bounded_sample(df.select(F.col(id_column).alias("_id")).where("_id is not null").distinct(), F.col("_id"), rows)
    return df.join(F.broadcast(ids), df[id_column] == F.col("_id"), "left_semi")


Span = tuple[int, int, str]


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def span_rows(base: Iterable[Span], more: Iterable[Span], kinds: list[str]) -> list[dict]:
    """Spans as structs by start, then by the order of kinds."""
    both = [(a, kinds.index(k), b, True) for a, b, k in base] + [(a, kinds.index(k), b, False) for a, b, k in more]
    return [{"kind": kinds[k], "start": a, "end": b, "base": base} for a, k, b, base in sorted(both)]


def outside(spans: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """Those spans that overlap none that is taken."""
    held = sorted((a, b) for a, b, _ in taken)
    out, k, reach = [], 0, -1
    for span in sorted(spans):
        while k < len(held) and held[k][0] < span[1]:
            reach = max(reach, held[k][1])
            k += 1
        if reach <= span[0]:
            out.append(span)
    return out
