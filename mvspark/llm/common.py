"""What the text operators share: reading, checkpoints and batches of whole texts."""

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Words are runs of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that a query's shuffle files go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own; on a cluster that is an error, as the
    executors would write to their own disks."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(name: str) -> Column:
    """A column by its own name, whatever letters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(given: list[StructField], added: dict[str, str]) -> StructType:
    """A table's fields with their types as they are, nested names too, and others by the text of their types; any may be null."""
    return StructType([*[StructField(f.name, f.dataType) for f in given], *[StructField(name, DataType.fromDDL(ddl)) for name, ddl in added.items()]])


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run within go when its run ends, not when the driver happens to collect its garbage. Run a second time, a table
    makes its shuffles anew."""
    given = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if given is None else spark.conf.set(RELEASE, given)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir. Shuffle files that led to it are released."""
    shared_folder(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint()  # a table made here, as the setting is read when a table is made


def id_crc(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; of the empty text for a null id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z in lower case. bytes.lower and bytes.split know ASCII only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pieces(batch: pa.RecordBatch, text: str = "text", chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with about so many bytes of text (one text at least), so that Python objects stay few whatever the batch holds."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > chars:
            yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start), column.slice(start).to_pylist()


def out_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def with_text_columns(docs: DataFrame, text_col: str, added: dict[str, tuple[str, pa.DataType]], make, chars: int = 2_000_000) -> DataFrame:
    """``docs`` with columns that ``make()`` gives for each list of whole texts: make() is called once a task and returns a function from
    texts to a dict of lists. Rows stay where they are, with all their columns; a column of an added name is replaced."""
    kept = docs.drop(*added)
    # Columns are passed by place: Spark looks a table's names up again when it maps it, and reads dots and backticks in them.
    plain = [f"c{i}" for i in range(len(kept.columns))]
    rows = kept.select("*", F.col(text_col).cast("string")).toDF(*plain, "text")
    out = with_fields(rows.schema.fields[:-1], {k: t[0] for k, t in added.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part, texts in pieces(batch, "text", chars):
                schema = pa.schema([*[x for x in part.schema if x.name != "text"], *[pa.field(k, t[1]) for k, t in added.items()]])
                yield out_batch(schema, {c: part.column(c) for c in plain} | f(texts))

    return rows.mapInArrow(run, out).toDF(*kept.columns, *added)


def judged(docs: DataFrame, names: tuple[str, ...], found, keep: Column) -> DataFrame:
    """The rows of ``docs``, with its own columns and no others, for which ``keep`` holds of the columns (names) that ``found`` adds. Columns of docs
    that have such a name, in any case of letters, stand aside meanwhile."""
    aside = {}
    taken = docs
    added = {name.lower() for name in names}
    for c in docs.columns:
        if c.lower() in added:
            aside[c] = fresh(taken, c)
            taken = taken.withColumnRenamed(c, aside[c])
    out = found(taken).filter(keep)
    return out.select(*[named(aside.get(c, c)).alias(c) for c in docs.columns])
