"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of characters other than space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and the master is local
    a temporary one. On a cluster no other machine would see that, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder; its lineage ends there, so a lost executor costs a read.

    A checkpoint keeps its plan's estimate of its size, and joins multiply these: after some rounds of an iteration they
    are too large for any number. So it is taken up again as rows of unknown size.
    """
    spark, named = df.sparkSession, shared_dir(df.sparkSession)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    done = df.checkpoint(eager=True)
    rows = done._jdf.queryExecution().toRdd()
    return type(done)(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to a new folder of the shared one and read back, and that folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except Exception:
        remove_dir(path)
        raise
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_dir(path: str) -> None:
    """Removes a folder of the shared one if it is there."""
    store, folder = fs.FileSystem.from_uri(path)
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


#: Fewer keys than this can each have over 1/HOT_KEYS of all rows.
HOT_KEYS = 20_000
#: Bytes of a plain key; and how many keys may be hot however large they are.
KEY_BYTES, FEW_KEYS = 64, 16


def join_counted(rows: DataFrame, told: DataFrame, keys: list[str], least: int = 64, size: Column | None = None) -> DataFrame:
    """rows joined with told, which has one row for each key (none null) and in `n` about how many of rows have it.

    The keys that over 1/HOT_KEYS of all rows (and over `least`) have are fewer than HOT_KEYS whatever the input, so
    these are broadcast and their rows stay where they are; the others are shuffled, none of them a hot one. size tells
    the bytes of a key that may be large: the largest one measured makes HOT_KEYS as many times less as it is larger than
    a plain key, so that what is broadcast has one bound. Both tables are read twice and should be stored.
    """
    large = F.max(F.when(F.col("n") > least, size)) if size is not None else F.lit(None)
    found = told.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), large.cast("long").alias("bytes")).first()
    keys_held = max(FEW_KEYS, HOT_KEYS * KEY_BYTES // max(found.bytes or 0, KEY_BYTES))
    is_hot = F.col("n") > max(found.n // keys_held, least)
    hot, rest = F.broadcast(told.where(is_hot).drop("n")), told.where(~is_hot).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(told.where(is_hot).select(*keys)), keys, "left_anti").join(rest, keys))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with columns that hold the sum of a long over all rows before this one in `order` (0 for the first).

    Rows are dealt out by ranges of the order and stored; only one row for each range is summed up in one task.
    """
    dealt = df.withColumns({f"of_{name}": c.cast("long") for name, c in sums.items()}).repartitionByRange(*order)
    dealt = cut(dealt.withColumn("range_", F.spark_partition_id()))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_").agg(*(F.sum(f"of_{name}").alias(name) for name in sums))
    totals = totals.select("range_", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"upto_{name}") for name in sums))
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = dealt.join(F.broadcast(totals), "range_")  # a row for each range
    made = {name: F.col(f"upto_{name}") + F.coalesce(F.sum(f"of_{name}").over(inside), F.lit(0)) for name in sums}
    return told.withColumns(made).select(*df.columns, *sums)


#: A table of keys measured to be at most so many rows of 32 bytes is broadcast.
MOST_KEYS = 250_000


def given(rows: DataFrame, told: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """rows that told (stored, only columns `keys`) names, or with how="left_anti" those that it does not. Names that
    are measured to be few are broadcast and rows stay where they are; else both are shuffled."""
    return rows.join(F.broadcast(told) if told.count() <= MOST_KEYS else told, keys, how)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8. bytes.split() splits at exactly the six ASCII blanks of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: Bytes of rows that are sent to Python at one time. Spark's own limit of 64 MB is met several times over in a task,
#: on both sides, when rows are long texts.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session was told to send Python no larger batches; a smaller limit of the user's stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def arrow_map(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, arrow: pa.Schema, chunk: int = 512) -> DataFrame:
    """mapInArrow for functions on tuples: rows() gets all the rows of a partition one by one and yields output
    tuples. Only `chunk` rows at a time are turned into Python objects, and output leaves in batches of 4096."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                for i in range(0, b.num_rows, chunk):
                    part = b.slice(i, chunk)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        out: list[tuple] = []
        for r in rows(stream()):
            out.append(r)
            if len(out) == 4096:
                yield to_batch(out, arrow)
                out = []
        if out:
            yield to_batch(out, arrow)

    return small_batches(df).mapInArrow(run, schema)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


#: Rows whose texts are Python objects at one time.
AT_ONCE = 64


def append_columns(df: DataFrame, text: str | list[str], make: Callable[..., list[tuple]], names: list[tuple[str, str, pa.DataType]], keep: Callable[[tuple], bool] | None = None) -> DataFrame:
    """df with columns made from its column `text` (or columns, if a list) by make(list of texts, ...) -> list of tuples,
    all other columns handed through as Arrow buffers; rows for which keep(tuple) is false are left out. The new names must not be in df."""
    schema = StructType(list(df.schema.fields))
    for name, kind, _ in names:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(i, AT_ONCE)
                made = make(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ([text] if isinstance(text, str) else text)))
                cols = [pa.array([r[j] for r in made], t) for j, (_, _, t) in enumerate(names)]
                out = pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(n for n, _, _ in names)])
                yield out.filter(pa.array([keep(r) for r in made], pa.bool_())) if keep else out

    return small_batches(df).mapInArrow(run, schema)
