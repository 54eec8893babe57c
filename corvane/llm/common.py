"""What the operators of this subpackage share: reading, cutting lineage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the five controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: The same characters themselves.
SPACES = " \t\n\x0b\x0c\r"
#: A pattern for one white-space character.
SPACE_CLASS = rf"[{SPACE}]"
#: A pattern for one word.
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, or else one in its warehouse.

    Where the session names no checkpoint folder and has no other machine than this one, as in tests, a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/corvane"
    if context.applicationId not in _OWN_DIRS:
        _OWN_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="corvane-")
    return _OWN_DIRS[context.applicationId]


def written(df: DataFrame, tag: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder: short lineage, and no task is repeated for it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files that ``written`` made for ``df``, which no later plan may read."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/corvane-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that are no longer referred to."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of a bounded number of rows and bytes for the Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def one_space(text: Column) -> Column:
    """A text with each white-space character made a space; of a null text, the empty one."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` worked out once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_batches(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the string column ``text`` of each piece has about ``chars`` bytes at most."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        first, size = 0, 0
        for i, length in enumerate(pc.binary_length(column).to_pylist()):
            size += length or 0
            if size >= chars:
                yield batch.slice(first, i + 1 - first)
                first, size = i + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


def text_hash() -> Column:
    """The hash by which a row's text is known; a null text is the empty one."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keep_named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` with one row left of each (doc_id, th) in ``kept``, th being the text's hash; all columns stay.

    Rows are known by th and a hash of doc_id with th, plain columns by which both the join and the removal of
    repeated rows are dealt, so that whole texts are shuffled once.
    """
    name = lambda i, th: F.xxhash64(i.isNull(), i, th)
    rows = docs.withColumns({"_k_name": name(F.col("doc_id"), text_hash()), "_k_th": text_hash()})
    names = kept.select(name(F.col("doc_id"), F.col("th")).alias("_k_name"), F.col("th").alias("_k_th"))
    return rows.join(names, ["_k_name", "_k_th"], "left_semi").dropDuplicates(["_k_name", "_k_th"]).drop("_k_name", "_k_th")


#: Keys with more than one in so many rows are sent to the rows they belong to; there are fewer of them than this.
HEAVY = 1000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row a key at most, safe with keys of any number of rows.

    ``sizes``: (keys, c), the rows of each key in ``left``.  Keys with more than 1 / HEAVY of all rows, fewer than
    HEAVY by that, are broadcast; the rest is shuffled.  Keys are not null.  ``left`` is read twice.
    """
    total = sizes.agg(F.sum("c").alias("c")).first()["c"] or 0
    heavy = F.broadcast(sizes.where(F.col("c") * HEAVY > total).select(*keys))
    few = right.join(heavy, keys, "left_semi")
    hot = left.join(heavy, keys, "left_semi").join(F.broadcast(few), keys, "left")
    return hot.unionByName(left.join(heavy, keys, "left_anti").join(right, keys, "left"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges``: (a long, b long) in any order, with repeats and loops.  Returns (node, root): every
    node that has an edge to another one, and its component's smallest node.  Each step
    joins edges with per-node minima, which are aggregated before the shuffle.  The edges of a node with very
    many neighbours meet in one partition of that join, which is streamed, not held, and which adaptive execution
    splits where it is large; a step's edges are written to the shared folder, and only counts reach the driver.
    """
    spark = edges.sparkSession
    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new = written(small, "edges")
        same = e.join(new, ["u", "v"], "left_semi").count() == e.count() == new.count()
        drop_written(e)
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
