"""What the corpus operators share: tables, Arrow text access, vectorised words."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: a space and the characters from tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Rows that are handed to Python at once; texts may be long, so few.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of text columns small enough for a worker's memory, and let workers import this package.

    The import path matters where the library runs from a checkout; a cluster that
    has it installed is not affected.
    """
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def schema(df: DataFrame, *names: str, **added: str | T.DataType) -> T.StructType:
    """The types of some columns of ``df`` and, after them, added ones."""
    kinds = {f.name.lower(): f for f in df.schema.fields}
    out = [T.StructField(n, kinds[n.lower()].dataType) for n in names]
    return T.StructType(out + [T.StructField(n, T.DataType.fromDDL(t) if isinstance(t, str) else t) for n, t in added.items()])


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], added: list[tuple[str, T.DataType]], without: int = 0) -> DataFrame:
    """``mapInArrow`` that keeps all columns of ``df`` but the last ``without``, whatever their names, and adds some.

    ``run`` gets batches of all columns and yields the arrays of the kept and the added ones.
    """
    kept = df.schema.fields[: len(df.columns) - without]
    plain = [f"c{i}" for i in range(len(df.columns))]
    names = [*plain[: len(kept)], *[f"a{i}" for i in range(len(added))]]
    kinds = [*[f.dataType for f in kept], *[kind for _, kind in added]]

    def batches(given):
        for arrays in run(given):
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = df.toDF(*plain).mapInArrow(batches, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    return out.toDF(*[f.name for f in kept], *[n for n, _ in added])


def words_of(text: Column) -> Column:
    """The array of runs of non-white-space; null and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", -1)
    return F.array_remove(parts, "")


#: Groups that a join sends to all tasks.
HOT = 1000


def group_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has a row and the number of its rows for each key.

    The largest ``HOT`` groups are broadcast, so what is shuffled has no group of more than a thousandth
    of the rows. ``rows`` and ``groups`` are read twice, so both should be written tables.
    """
    hot = F.broadcast(groups.orderBy(F.desc(size), *keys).limit(HOT))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(groups, keys))


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def byte_table(separators: bytes, lower: bool = False, keep: bytes | None = None) -> np.ndarray:
    """A byte map with 0 for separators; ``keep`` names the only bytes that are not separators."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    if keep is None:
        out[list(separators)] = 0
    else:
        ok = np.zeros(256, bool)
        ok[list(keep)] = True
        out[~ok[out]] = 0
    out[0] = 0 if (keep is not None or 0 in separators) else 255  # a NUL byte is a word byte; 255 never occurs in UTF-8
    return out


#: Words between white space, as they are.
PLAIN = byte_table(b" \t\n\x0b\x0c\r")
#: Lower-cased runs of ASCII letters, digits and all that is not ASCII.
ALNUM = byte_table(b"", lower=True, keep=bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))

_RANDOM = np.random.RandomState(20240229).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"p": np.ones(1, np.uint64)}


def powers(n: int) -> np.ndarray:
    if len(_POWERS["p"]) < n:
        p = np.full(max(n, 4096), _PRIME, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _POWERS["p"] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["p"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tokens(data: np.ndarray, offsets: np.ndarray, how: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, row, first byte and end byte of every word of the rows, in order."""
    mapped = how[data]
    inside = mapped != 0
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - begin
    at = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    chars = mapped[inside]
    place = np.arange(len(chars), dtype=np.int64) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        value = _RANDOM[chars] * powers(int(size.max()))[place]
        hashed = mix(np.add.reduceat(value, at) + size.astype(np.uint64))
    row = np.searchsorted(offsets, begin, "right") - 1
    return hashed, row, begin, end


def windows(hashed: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first-word index of every run of ``n`` words within one row."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
    with np.errstate(over="ignore"):
        value = hashed[start].copy()
        for k in range(1, n):
            value = value * _PRIME + hashed[start + k]
    return mix(value), start


def shingles(hashed: np.ndarray, row: np.ndarray, rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the ``n``-word shingles; a row of 1 to n-1 words has one of all its words."""
    value, start = windows(hashed, row, n)
    out, where = [value], [row[start]]
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            with np.errstate(over="ignore"):
                value = hashed[begin[short]].copy()
                for i in range(1, k):
                    value = value * _PRIME + hashed[begin[short] + i]
            out.append(mix(value + np.uint64(k)))
            where.append(short)
    return np.concatenate(out), np.concatenate(where)
