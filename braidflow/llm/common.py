"""What the operators share: scratch tables, Arrow batches and byte-level words.

Scratch tables go to the shared folder named by ``spark.checkpoint.dir``; a folder of the
session's own is made only in local mode without that setting, on a cluster it is an error.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources import files
from ..sources.tables import scratch_dir

#: Rows, and about the bytes, that Python code works on at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 23
#: Bytes of text that the vectorised code works on at a time (one longer text is taken alone).
BLOCK_BYTES = 1 << 18


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """This application's scratch folder below ``spark.checkpoint.dir``, deleted at its end."""
    return scratch_dir(spark, "")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    Cuts the lineage: a lost executor costs a rerun of tasks that read the table, never of
    what made it.
    """
    return _table(df, f"{shared_dir(df.sparkSession)}/{getattr(_place, 'folder', '')}{name}-{uuid.uuid4().hex[:12]}")


def _table(df: DataFrame, path: str) -> DataFrame:
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, in a place of its own that ``purge`` leaves alone."""
    return _table(df, f"{scratch_dir(df.sparkSession, '-kept')}/{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[str]:
    """What ``written`` writes within goes to a folder of its own, for ``purge``: other
    operators' tables, made before or in other threads, aren't in it."""
    before = getattr(_place, "folder", "")
    _place.folder = f"stage-{uuid.uuid4().hex[:12]}/"
    try:
        yield f"{shared_dir(spark)}/{_place.folder}"
    finally:
        _place.folder = before


_place = threading.local()


def purge(folder: str) -> None:
    """Delete a folder that ``own_scratch`` gave, when its readers have finished."""
    files.remove(folder)


def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BATCH_BYTES and of BATCH_ROWS at most (a longer row is
    taken alone): what Python makes of one at a time. The session's own bounds (10,000 rows
    and 64 MiB, unless set) say how much comes from Spark at once."""
    for batch in batches:
        size = np.zeros(batch.num_rows + 1, np.int64)
        for column in batch.columns:
            size[1:] += _row_bytes(column)
        size, at = np.cumsum(size), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, size[at] + BATCH_BYTES, "right")) - 1)
            stop = min(stop, at + BATCH_ROWS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
        if not batch.num_rows:
            yield batch


def _row_bytes(column: pa.Array) -> np.ndarray | int:
    kind = column.type
    if pa.types.is_list(kind):
        return np.diff(np.asarray(column.offsets)) * 8
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if not (wide or pa.types.is_string(kind) or pa.types.is_binary(kind)) or not len(column):
        return 8
    return np.diff(np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(column, n: int):
    """crc32 of a column's decimal text, modulo ``n`` (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


# ---------------------------------------------------------------- texts of a batch


def texts(column: pa.Array) -> list[str]:
    """The strings of a batch's column, null as the empty string."""
    return pc.fill_null(column, "").to_pylist()


def utf8_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a batch's strings, null as empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about BLOCK_BYTES: (first row, bytes, offsets from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + BLOCK_BYTES, "right")) - 1)
        stop = min(stop, n)
        yield row, data[off[row] : off[stop]], off[row : stop + 1] - off[row]
        row = stop


# ---------------------------------------------------------------- words as 64-bit hashes

_U = np.uint64
#: Word characters: digits, ASCII letters and every byte of a non-ASCII code point.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:256] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))[LOWER]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("i", inverse)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a block, A-Z as a-z, from prefix sums of a polynomial."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(_U))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts of a block, and each text's first word.

    A word is a maximal run of word bytes, A-Z as a-z; it never spans two texts.
    """
    n = len(data)
    mask = IS_WORD[data]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = mask[:-1]
        before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = mask[1:]
        ends = off[1:] - 1
        after[ends[ends >= 0]] = False
    stops = np.flatnonzero(mask & ~after) + 1
    return span_hashes(data, starts, stops), np.searchsorted(starts, off)


_STEP = [_U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0876A9A47)]


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text, and each text's first run.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    n_words = np.diff(first)
    n_runs = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(n_words.dtype))
    out_first = np.concatenate(([0], np.cumsum(n_runs)))
    start = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], n_runs)
    length = np.repeat(np.minimum(n_words, width), n_runs)
    padded = np.concatenate((words, np.zeros(width, _U)))
    total = length.astype(_U)
    for k in range(width):
        total += np.where(k < length, padded[start + k] * _STEP[k % 8] + _U(k), _U(0))
    return mix(total), out_first
