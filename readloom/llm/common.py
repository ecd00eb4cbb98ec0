"""What the operators share: shared-folder tables, tokenisation, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that belong to a word of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower-cased.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The ASCII white space that separates tokens, as a Java pattern of what is not white space.
TOKEN_PATTERN = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs, which have one machine, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="readloom-")
        shared_dir.own = base
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends or on ``release``."""
    path = f"{shared_dir(spark)}/readloom-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._readloom_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Removes the table behind a frame of ``saved`` that nothing reads any more."""
    path = df._readloom_path
    _written.remove((df.sparkSession, path))
    _remove(df.sparkSession, path)


@atexit.register
def release() -> None:
    """Removes what ``saved`` and ``new_path`` made in this driver."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; then nothing more can be removed
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and all beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterable[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def out_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain and array types."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Rows:
    """Gathers output rows and hands them out as record batches of bounded bytes."""

    def __init__(self, schema: pa.Schema, max_bytes: int = 16 << 20, max_rows: int = 20_000):
        self.schema, self.max_bytes, self.max_rows = schema, max_bytes, max_rows
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """True when a batch is due."""
        self.rows.append(row)
        self.size += size
        return self.size >= self.max_bytes or len(self.rows) >= self.max_rows

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield self.batch()
