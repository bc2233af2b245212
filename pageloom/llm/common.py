"""What the corpus operators share: word rules, shared tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes up to which a side counts as small enough to broadcast; beyond, the caller's other way is taken.
BROADCAST_ROWS = 1 << 19
BROADCAST_BYTES = 48 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session that names none (tests) gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pageloom-')}")
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: Folders made in this session and not yet removed, in order.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed by release() or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/pageloom-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: release(spark, 0))
    _made.append(path)
    return path


def mark() -> int:
    """Where the list of folders stands now, for release()."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes the folders made since mark() gave `since`, but for the last `keep` of them."""
    gone = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    if spark.sparkContext._jsc is None:  # the session has ended; the folder's owner cleans up
        return
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _fixed(kind) -> int:
    """Bytes that a value takes in a row, text and binary content aside."""
    return 8 + sum(8 + _fixed(f.dataType) * isinstance(f.dataType, T.StructType) for f in kind.fields) if isinstance(kind, T.StructType) else 8


def _bytes(field) -> Column:
    """About what a value of this field takes in a row; binary content in structs and arrays counts as 16 bytes."""
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType.fields if isinstance(kind.elementType, T.StructType) else [T.StructField("x", kind.elementType)]
        width = 8 * isinstance(kind.elementType, T.StructType) + _fixed(kind.elementType) + 16 * sum(isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in inner)
        return F.lit(24) + F.coalesce(F.size(c), F.lit(0)) * width
    return F.lit(8 + _fixed(kind))


def is_small(df: DataFrame) -> bool:
    """Whether a written table is within both bounds; rows and bytes of all its rows are measured."""
    n, b = df.agg(F.count("*"), F.coalesce(F.sum(sum(map(_bytes, df.schema.fields), F.lit(32)).cast("long")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and b <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Marked for broadcast where is_small() holds; else left to a shuffled join. Give a written table."""
    return F.broadcast(df) if is_small(df) else df.hint("merge")


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def text_digest(c: str | Column = "text") -> Column:
    """128 bits of the SHA-256 of a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(text_or_empty(c), 256), 1, 32))


def word_count(c: str | Column = "text") -> Column:
    """Number of words as a long; null counts as empty."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def give_back() -> None:
    """Returns memory that a Python worker no longer uses to the system: workers live on from stage to stage beside one another."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library, which has no such call
        pass


def per_document(docs: DataFrame, compute, fields: str, chunk_chars: int = 1 << 20, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per row of docs: the carried columns and the fields (DDL) that compute(texts) gives, as one list per field.

    Texts (null: empty) reach compute whole, in lists of about chunk_chars characters or one longer text. Memory is
    bounded by a chunk and an Arrow batch. Other columns of docs are not read.
    """
    out = T.StructType([docs.schema[c] for c in carry] + T.StructType.fromDDL(fields).fields)
    names = [f.name for f in out.fields]
    n_carry = len(carry)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            texts = batch.column(n_carry)
            lengths = [0 if x is None else x for x in pyarrow.compute.utf8_length(texts).to_pylist()] if len(texts) else []
            at = 0
            while at < len(lengths):
                end, chars = at, 0
                while end < len(lengths) and (end == at or chars + lengths[end] <= chunk_chars):
                    chars += lengths[end]
                    end += 1
                got = compute([x or "" for x in texts.slice(at, end - at).to_pylist()])
                cols = [batch.column(i).slice(at, end - at) for i in range(n_carry)]
                cols += [pa.array(v, type=schema.field(n_carry + i).type) for i, v in enumerate(got)]
                yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(cols)], names=names)
                at = end
        give_back()

    return docs.select(*carry, "text").mapInArrow(run, out)


#: A key in more than 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE such.
HOT_SHARE = 256


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """left joined (left outer) to right, which has one row a key and in n the key's number of rows in left.

    Rows with a hot key meet a broadcast of at most HOT_SHARE rows; the others are shuffled, so no task gathers a hot key.
    Give a written right side, and a left side that is cheap to read twice. Null keys find nothing. Column names of left and
    right, but for the key, must differ.
    """
    others = [c for c in right.columns if c != key]
    hot = right.filter(F.col(n) > left.count() / HOT_SHARE).select(key, *others)
    columns = [*left.columns, *others]
    if hot.isEmpty():
        return left.join(right.select(key, *others), key, "left").select(*columns)
    mine = left.join(F.broadcast(hot), key).select(*columns)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.select(key, *others), key, "left").select(*columns)
    return mine.unionByName(rest)


#: Edges that one task contracts at a time, and up to which a single task finishes.
LOCAL_EDGES = 1 << 20


def _contract(batches):
    """Edges (a, b) of one partition as stars around the smallest node of each of its components: at most one edge a node."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def stars(table):
        nodes = pc.unique(pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).cast(table.schema.field(0).type))
        order = pc.array_sort_indices(nodes)
        nodes = nodes.take(order)
        a, b = (pc.index_in(table.column(i), value_set=nodes).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        label = smallest_labels(len(nodes), a, b)
        rows = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table([nodes.take(pa.array(rows)), nodes.take(pa.array(label[rows]))], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(pa.table([batch.column(0), batch.column(1)], names=["a", "b"]))
        n += batch.num_rows
        if n >= LOCAL_EDGES:
            out = stars(pa.concat_tables(held))
            if 2 * out.num_rows > n:  # little gained: pass it on
                yield from out.to_batches(max_chunksize=100_000)
                held, n = [], 0
            else:
                held, n = [out], out.num_rows
    if held:
        yield from stars(pa.concat_tables(held)).to_batches(max_chunksize=100_000)


def smallest_labels(n: int, a, b):
    """Smallest index in each of n indices' component under edges a-b."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node in an edge; root is its smallest node.

    Each round contracts the edges of every partition to stars, then alternates large and small stars; a round is a
    written table, and the edges of a hub are never gathered in a task (join_counted). At most LOCAL_EDGES edges, which
    is checked, are finished by one task.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    made = f"a {kind}, b {kind}"
    edges = write_table(edges.filter("a <> b").select("a", "b").mapInArrow(_contract, made), "edges")
    before = None
    for _ in range(most_rounds):
        if edges.count() <= LOCAL_EDGES:
            edges = write_table(edges.coalesce(1).mapInArrow(_contract, made), "stars")
            break
        since = mark()
        both = write_table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        low = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "low")
        large = join_counted(both, low, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = write_table(large.unionByName(low.filter("a > m").select("a", F.col("m").alias("b"))).distinct(), "large-star")
        low = write_table(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = join_counted(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = write_table(small.filter("a <> b").mapInArrow(_contract, made).distinct(), "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(spark, since, keep=1)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
