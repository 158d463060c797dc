"""Reading and writing tables, header normalisation, reproducible samples."""

from __future__ import annotations

import unicodedata
import uuid
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dayspan.functions.columns import hash_unit


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet",
               schema: StructType | str | None = None, **options) -> DataFrame:
    """Read one table (or several files of one table) in any Spark format.

    CSV is read with a header and, when given, an explicit schema (no
    inference pass over the data).
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    paths = [path] if isinstance(path, str) else list(path)
    return reader.options(**options).load(paths if len(paths) > 1 else paths[0])


def read_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
               renames: Sequence[Mapping[str, str]] | None = None,
               part_col: str | None = None,
               schemas: Sequence[StructType | str | None] | StructType | str | None = None,
               **options) -> DataFrame:
    """Union parts whose columns may differ (yearly sheets), by column name;
    a column missing from a part is null there. ``renames`` maps each part's
    source headers to common names; ``part_col`` records the part index;
    ``schemas`` is one explicit schema for all parts or one for each, and
    ``options`` go to the reader."""
    frames = []
    for i, p in enumerate(paths):
        schema = schemas[i] if isinstance(schemas, (list, tuple)) else schemas
        df = read_table(spark, p, fmt, schema, **options)
        if renames:
            df = df.select(*[F.col(src).alias(dst) for src, dst in renames[i].items()])
        if part_col:
            df = df.withColumn(part_col, F.lit(i))
        frames.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: formats that are folders of files, which can be written beside the old table and moved in its place
FILE_FORMATS = ("parquet", "orc", "json", "csv", "text", "avro")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None, only_partitions: bool = False, **options) -> None:
    """Write from the executors (never through the driver).

    Overwriting a table of files is staged: the rows are written beside it, and only a finished write
    takes its place, so a job that fails leaves the old table whole, and ``df`` may
    read the very table it replaces. ``only_partitions`` (with ``partition_by``): partitions that occur in ``df`` are
    replaced, all others stay; Spark's commit moves their files once all tasks have finished.
    """
    w = df.write.format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.options(**options)
    if only_partitions:
        if not partition_by or mode != "overwrite":
            raise ValueError("only_partitions overwrites the partitions of partition_by")
        w.option("partitionOverwriteMode", "dynamic").mode("overwrite").save(path)
    elif mode == "overwrite" and fmt in FILE_FORMATS:
        _replace(df.sparkSession, path, lambda to: w.mode("errorifexists").save(to))
    else:
        w.mode(mode).save(path)


def _replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Run ``write`` into a new folder beside ``path`` and move it there; on failure ``path`` is as it was."""
    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old = (jvm.org.apache.hadoop.fs.Path(home.getParent(), f".{home.getName()}-{kind}-{mark}") for kind in ("new", "old"))
    try:
        write(new.toString())
        had = fs.exists(home)
        if had and not fs.rename(home, old):
            raise OSError(f"cannot move {path} aside")
        if not fs.rename(new, home):
            if had:
                fs.rename(old, home)
            raise OSError(f"cannot move the new table to {path}")
        if had:
            fs.delete(old, True)
    finally:
        fs.delete(new, True)


#: fixed values: letters that Unicode decomposition leaves whole, and their plain spelling
PLAIN_LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
                               "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i"})


def normalize_header(name: str) -> str:
    """Strip accents, spell letters plainly, drop '.', lower case, spaces to '_'."""
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", name.translate(PLAIN_LETTERS)) if not unicodedata.combining(ch))
    return plain.replace(".", "").lower().replace(" ", "_")


def normalize_headers(df: DataFrame, dup_suffix: str = "_dup") -> DataFrame:
    """Rename all columns by ``normalize_header``; a name already taken gets
    ``dup_suffix`` appended, and a number from the second time on (metadata
    only, no data pass). Names never clash."""
    plain = [normalize_header(c) for c in df.columns]
    taken: set[str] = set()
    out = []
    for n in plain:
        name, k = n, 1
        while name in taken or (k > 1 and name in plain):
            name = f"{n}{dup_suffix}{k if k > 1 else ''}"
            k += 1
        taken.add(name)
        out.append(name)
    return df.toDF(*out)


def bind_categories(columns: Iterable[str], categories: Iterable[str]) -> dict[str, str]:
    """Bind each column to the dictionary category whose name it contains;
    when several match, the last category wins and a warning names them."""
    cats = list(categories)
    out = {}
    for col in columns:
        hits = [c for c in cats if c in col]
        if hits:
            if len(hits) > 1:
                warnings.warn(f"column {col!r} matches categories {hits}; using {hits[-1]!r}", stacklevel=2)
            out[col] = hits[-1]
    return out


def hash_sample(df: DataFrame, key: Sequence[str] | str, fraction: float, salt: str = "") -> DataFrame:
    """Rows whose md5 coin of the key is below ``fraction``: a reproducible
    Bernoulli sample, the same on every run and after executor loss."""
    key = [key] if isinstance(key, str) else list(key)
    return df.where(hash_unit(key, salt) < F.lit(float(fraction)))


#: files that a task writes side by side in a partitioned stage table (with more values it sorts
#: its rows), and the bytes each may hold in memory
OPEN_FILES_CONF, OPEN_FILES, OPEN_FILE_BYTES = "spark.sql.maxConcurrentOutputFileWriters", 16, 32 << 20


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back: a stage boundary that cuts
    the lineage, survives executor loss and, unlike an RDD checkpoint, is
    columnar and compressed and gives the planner real size statistics.
    ``partition_by``: columns whose later filters prune whole files. A task keeps a file open for each of up to
    ``OPEN_FILES`` values of them, so that it need not sort (and spill) its rows first."""
    from dayspan.session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    before = spark.conf.get(OPEN_FILES_CONF)
    spark.conf.set(OPEN_FILES_CONF, str(OPEN_FILES))
    try:
        df.write.mode("overwrite").option("parquet.block.size", OPEN_FILE_BYTES).partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(OPEN_FILES_CONF, before)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
