"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space, tab, line feed, vertical tab, form feed, return.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir).

    Where the setting is missing on one machine (tests) a temporary folder is
    made and set, so that later calls in the session find the same one. On a
    cluster that is an error: executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tracework-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and reread it.

    A lost executor then costs only the tasks it ran, as the files stay.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str):
    """The column of exactly this name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def hide(docs: DataFrame, used: list[str], new: list[str]) -> tuple[DataFrame, list[str]]:
    """(docs with every other column under a private name c_0, c_1, ..., the names of those columns).

    A column that bears the name of a new one (in any case) is left out: the new ones win.
    """
    taken = {c.lower() for c in (*used, *new)}
    others = [c for c in docs.columns if c.lower() not in taken]
    return docs.select(*used, *[quoted(c).alias(f"c_{i}") for i, c in enumerate(others)]), others


def show(rows: DataFrame, lead: list, others: list[str], tail: list) -> DataFrame:
    """lead, the hidden columns under their own names, tail."""
    return rows.select(*lead, *[F.col(f"c_{i}").alias(c) for i, c in enumerate(others)], *tail)


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    kind = column.type
    if not (pa.types.is_large_binary(kind) or pa.types.is_large_string(kind)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow large_binary from bytes and offsets, without a loop."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of UTF-8 rows; malformed bytes become U+FFFD."""
    try:
        text = str(data.data if data.flags.c_contiguous else data.tobytes(), "utf-8")
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return np.frombuffer(text.encode("utf-32-le"), np.uint32), first[at]
    except UnicodeDecodeError:
        rows = [str(data[a:b].tobytes(), "utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a chunk holds about most_bytes of the column (one long text may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(at, at[row] + most_bytes, "right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows, row + most_rows)
            yield batch.slice(row, stop - row)
            row = stop


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> batches that no key value crosses."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        other = np.flatnonzero(values != values[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1].column(key)[-1].as_py() != values[0]):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> one batch for every key value."""
    for rows in whole_groups(batches, key):
        values = rows.column(key).to_numpy()
        heads = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(heads, heads[1:]):
            yield rows.slice(a, b - a)


def salted_join(rows: DataFrame, table: DataFrame, key: str, table_key: str, by: str, salts: int = 8) -> DataFrame:
    """rows inner join table (one row a key) where rows may hold a key very often: a key's rows, told apart by ``by``, go to ``salts`` tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    spread = table.withColumn("_t_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, (F.col(key) == F.col(table_key)) & (F.col("_salt") == F.col("_t_salt"))).drop("_salt", "_t_salt")
