"""Word shingles as 64-bit hashes, and the exact frequencies of those that many texts share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import _Cache
from tessera.llm.common import cut, release

SHINGLE = 5
#: Shingles that a task counts before it passes them on.
CHUNK = 1_000_000
#: Shingles are counted by their top ``COUNTED_BITS`` bits; those of ``FREQUENT`` texts or more are told to all tasks,
#: the ``MAX_FREQUENT`` most frequent at most (9 bytes each): beyond, the least frequency rises.
COUNTED_BITS, FREQUENT, MAX_FREQUENT = 48, 4, 2_000_000
#: Buckets of shingles for each shuffle partition, and at least; a reducer holds one bucket at a time.
BUCKETS_PER_PARTITION, MIN_BUCKETS = 8, 1024

_ODD = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_word_hash = _Cache(xxhash.xxh3_64_intdigest)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += h[k : k + n] * _ODD[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out.sort()
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out if new.all() else out[new]


def forget() -> None:
    """Ends a task: its worker lives on, beside those of other operators."""
    _word_hash.clear()
    release()


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte, so that sorted values compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def frequencies(docs: DataFrame) -> DataFrame:
    """(token, n): the top bits of each shingle in at least ``FREQUENT`` texts, and the number of these texts.

    Copies of a text count once in a chunk of a task. A task sorts and counts
    its chunk and sends one packed row for each bucket of tokens, so a shingle
    that all texts share costs a chunk one entry, and buckets are even.
    """
    spark = docs.sparkSession
    bits = (max(MIN_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()
    low = COUNTED_BITS - bits
    width = -(-low // 8)

    def count(batches):
        parts, n, sets = [], 0, set()

        def rows():
            values, counts = np.unique(np.concatenate(parts) >> np.uint64(64 - COUNTED_BITS), return_counts=True)
            edges = np.searchsorted(values, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(low)).tolist()
            rest, many = values & np.uint64((1 << low) - 1), counts > 1
            out = [], [], [], []
            for b, (i, j) in enumerate(zip(edges, edges[1:])):
                if i < j:
                    r, m = rest[i:j], many[i:j]
                    for column, value in zip(out, (b, _planes(r[~m], width), _planes(r[m], width), counts[i:j][m].astype("<u4").tobytes())):
                        column.append(value)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["b", "once", "many", "n"])

        for batch in batches:
            for text in texts_of(batch):
                s = shingle_set(text)
                key = set_id(s)
                if len(s) and key not in sets:
                    sets.add(key)
                    parts.append(s)
                    n += len(s)
                if n >= CHUNK:
                    yield rows()
                    parts.clear()
                    sets.clear()
                    n = 0
        if parts:
            yield rows()
        forget()

    def add(batches):
        def total(bucket, values, counts):
            values, counts = np.concatenate(values), np.concatenate(counts)
            order = np.argsort(values, kind="stable")
            values, counts = values[order], counts[order]
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            sums = np.add.reduceat(counts, first)
            some = sums >= FREQUENT
            tokens = values[first][some] | np.uint64(bucket << low)
            return pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(sums[some].astype(np.int64))], ["token", "n"])

        bucket, values, counts = None, [], []
        for batch in batches:
            for b, once, many, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != bucket and bucket is not None:
                    yield total(bucket, values, counts)
                    values, counts = [], []
                bucket = b
                values += [_from_planes(once, width), _from_planes(many, width)]
                counts += [np.ones(len(once) // width, np.uint32), np.frombuffer(n, "<u4")]
        if bucket is not None:
            yield total(bucket, values, counts)

    packed = docs.select("text").mapInArrow(count, "b int, once binary, many binary, n binary")
    return packed.repartition("b").sortWithinPartitions("b").mapInArrow(add, "token long, n long")


class Levels:
    """log2 of the frequency of each frequent shingle, 0 for all others."""

    CELL_BITS = 24

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        """Sorted top bits of the shingles, and their levels."""
        self.tokens, self.levels = tokens, levels
        self.cells = np.zeros(1 << self.CELL_BITS, bool)
        self.cells[tokens >> (COUNTED_BITS - self.CELL_BITS)] = True

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), np.int8)
        maybe = np.flatnonzero(self.cells[shingles >> np.uint64(64 - self.CELL_BITS)])
        if len(maybe):
            wanted = (shingles[maybe] >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.tokens, wanted), len(self.tokens) - 1)
            out[maybe] = np.where(self.tokens[at] == wanted, self.levels[at], 0)
        return out


_LOADED: dict[int, Levels] = {}


def loaded(shared, key: int) -> Levels:
    """The table of a broadcast, built once per worker."""
    if key not in _LOADED:
        _LOADED.clear()
        tokens, levels = shared.value
        _LOADED[key] = Levels(np.frombuffer(tokens, np.int64), np.frombuffer(levels, np.int8))
    return _LOADED[key]


def share_levels(docs: DataFrame):
    """A function that gives tasks the ``Levels`` of ``docs``: at most ``MAX_FREQUENT`` shingles, by whole powers of two."""
    level = F.floor(F.log2("n")).cast("int")
    counted = cut(frequencies(docs).select("token", level.alias("level")))
    least, total = 64, 0
    for r in sorted(counted.groupBy("level").count().collect(), reverse=True):  # at most 64 rows
        total += r["count"]
        if total > MAX_FREQUENT:
            break
        least = r.level
    top = counted.where(F.col("level") >= least).toArrow()  # at most MAX_FREQUENT rows
    tokens, levels = top["token"].to_numpy(), top["level"].to_numpy().astype(np.int8)
    order = np.argsort(tokens)
    shared = docs.sparkSession.sparkContext.broadcast((tokens[order].tobytes(), levels[order].tobytes()))
    key = shared._jbroadcast.id()
    return lambda: loaded(shared, key)
