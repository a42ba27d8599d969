"""Binary token files: ids bit-packed at the least width that holds the vocabulary.

A file holds the ids of consecutive documents::

    header   magic "TPK1", width in bits (u32), ids in a block (u32), 0 (u32)
    blocks   each block's ids packed low bit first, padded to a byte
    footer   document ids (i64 each), first id of each document and the end (u64), offset of each block and the end (u64)
    trailer  offset of the footer, documents, blocks (u64 each), magic

Fixed width and block offsets give any range of ids by reading its blocks and
unpacking them with numpy. Files are written through ``pyarrow.fs``, so they
may be in any store that it opens, by tasks over ranges of ascending document
id; only files that the manifest names count, so a repeated task does no harm.

Defined cases: a null text is empty and has the end id alone; null document
ids come first and read back as null; repeated ids keep all their rows,
by a hash of the text; an empty table gives no file; very long texts span
blocks; other columns of the input are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_alphabet, encoder
from tessera.llm.common import cut, fresh_folder  # noqa: F401

MAGIC, BLOCK = b"TPK1", 8192
NULL_ID = -(2**63)


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids (uint32) in ``width`` bits each, low bit first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class PackedWriter:
    """Writes one file; holds no more than a block of ids and the document table."""

    def __init__(self, stream, width: int):
        self.out, self.width = stream, width
        self.docs, self.starts, self.offsets = [], [0], [16]
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        stream.write(MAGIC + struct.pack("<III", width, BLOCK, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            rest = np.concatenate(self.waiting)
            for i in range(0, len(rest) - BLOCK + 1, BLOCK):
                self._block(rest[i : i + BLOCK])
            self.waiting = [rest[len(rest) // BLOCK * BLOCK :]]
            self.n_waiting = len(self.waiting[0])

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        self.out.write(np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(struct.pack("<QQQ", self.offsets[-1], len(self.docs), len(self.offsets) - 1) + MAGIC)


class PackedReader:
    """Random access to a file: the footer is read once, blocks when asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 28)
        at, n, blocks, magic = struct.unpack("<QQQ4s", source.read(28))
        source.seek(0)
        head = source.read(16)
        if magic != MAGIC or head[:4] != MAGIC:
            raise ValueError("not a packed token file")
        self.width, self.block, _ = struct.unpack("<III", head[4:])
        source.seek(at)
        table = source.read(8 * (2 * n + 1 + blocks + 1))
        self.docs = np.frombuffer(table, "<i8", n)
        self.starts = np.frombuffer(table, "<u8", n + 1, 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(table, "<u8", blocks + 1, 8 * (2 * n + 1)).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids of the half-open range of positions."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        return self._blocks(first, last)[start - first * self.block : end - first * self.block]

    def documents(self, run: int = 64):
        """Ids of each document in turn; the blocks are read once, in order, ``run`` at a time."""
        n, at, block = len(self.offsets) - 1, 0, 0
        held = np.zeros(0, np.uint32)
        for a, b in zip(self.starts.tolist(), self.starts[1:].tolist()):
            if at + len(held) < b:
                parts, have = [held[a - at :]], at + len(held)
                while have < b:
                    last = min(block + run, n) - 1
                    parts.append(self._blocks(block, last))
                    have, block = have + len(parts[-1]), last + 1
                held, at = np.concatenate(parts), a
            yield held[a - at : b - at]

    def _blocks(self, first: int, last: int) -> np.ndarray:
        """All ids of the blocks from first to last."""
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        n = min((last + 1) * self.block, int(self.starts[-1])) - first * self.block
        if self.width * self.block % 8:
            cuts = self.offsets[first : last + 2] - self.offsets[first]
            parts = [unpack(data[a:b], min(self.block, n - i * self.block), self.width) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            out = np.concatenate(parts)
        else:
            out = unpack(data, n, self.width)
        return out


def _byte_classes() -> np.ndarray:
    """0 white space, 1 letter, 2 digit, 3 other ASCII, 4 for bytes whose word must be cut as text."""
    out = np.full(256, 4, np.uint8)
    for c in range(0x21, 0x7F):
        ch = chr(c)
        out[c] = 1 if ch.isalpha() else 2 if ch.isdigit() else 4 if ch in "'<" else 3
    out[[0x20, *range(0x09, 0x0E)]] = 0
    return out


#: Characters that are their own NFC, before and after lower-casing.
_PLAIN = "!-~\u00c0-\u012f\u0131-\u0148\u014a-\u017e"


def _accented() -> np.ndarray:
    """For the lead bytes C3 to C5 and each byte after them: the two bytes of a plain letter's lower case, 0 for others."""
    out = np.zeros((3, 256), np.uint16)
    for ch in map(chr, range(0xC0, 0x180)):
        if ch.isalpha() and re.fullmatch(f"[{_PLAIN}]", ch):
            lead, after = ch.encode()
            out[lead - 0xC3, after] = int.from_bytes(ch.lower().encode(), "big")
    return out


_CLASS, _ACCENTED = _byte_classes(), _accented()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Code points of the bytes' stand-ins in the vocabulary; a space stays one.
_STAND_IN = np.array([ord(c) for c in byte_alphabet()], "<u4")
_STAND_IN[0x20] = 0x20


class LibraryEncoder:
    """Ids of texts by the tokenizers library, each distinct pre-token encoded once.

    A group of texts is cut with numpy: runs of letters (ASCII and Latin ones
    with accents), single digits and runs of other ASCII characters are
    pre-tokens. Words with any other byte, an apostrophe or ``<``
    (contractions, special tokens) stay whole and are cut as text, or go to
    the library as they are. Distinct pieces come from Arrow's dictionary
    encoding; those not in the bounded cache are encoded in one call,
    separated by spaces, and the end-of-word tokens tell their ids apart (if
    they don't, the library encodes each by itself). As such pieces are
    normalised pre-tokens already, that call goes to the library's model without
    the file's normalizer, and only the spaces cut. The cache names the range
    of a piece's ids in one array; when full, it keeps what more than one
    group had since it was last full.
    """

    CACHED, GROUP_BYTES = 600_000, 4_000_000
    PLAIN = re.compile(f"[{_PLAIN}]+")
    #: A range is its first position times 2**BITS, plus its length.
    BITS = 31

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.bare = Tokenizer(self.library.model)  # the same model, held once
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.vocabulary = self.library.get_vocab_size()
        own = encoder(path)
        self.cut = own.pieces.findall if own.end else None
        self.last = np.array([s.endswith(own.end) and bool(own.end) for s in own.strings])
        self.cache: dict[bytes, int] = {}
        self.pool, self.filled = np.empty(1 << 16, np.uint32), 0
        self.again = np.zeros(len(self.pool) + 1, bool)  # by first position: found by a later group

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _pretoken_ids(self, words: bytes) -> np.ndarray:
        """Ids of pre-tokens in normal form, separated by spaces."""
        text = _STAND_IN[np.frombuffer(words, np.uint8)].tobytes().decode("utf-32-le")
        return np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _keep(self, pieces, ids: np.ndarray, ends: np.ndarray) -> None:
        """Caches the ids of pieces, laid end to end."""
        if self.filled + len(ids) > len(self.pool):
            more = max(self.filled, len(ids)) + len(ids)
            self.pool = np.concatenate([self.pool[: self.filled], np.empty(more, np.uint32)])
            self.again = np.concatenate([self.again[: self.filled + 1], np.zeros(more, bool)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        size = np.diff(ends, prepend=0)
        self.cache.update(zip(pieces, ((self.filled + ends - size << self.BITS) + size).tolist()))
        self.filled += len(ids)

    def _keep_each(self, texts: dict[bytes, str]) -> None:
        """Has the library encode each text by itself."""
        each = [self._ids(s) for s in texts.values()]
        if each:
            self._keep(texts, np.concatenate(each), np.cumsum([len(ids) for ids in each], dtype=np.int64))

    def _gather(self, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ranges of the pool end to end, and the bounds of each."""
        size, upto = (ranges & (1 << self.BITS) - 1).astype(np.int32), np.zeros(len(ranges) + 1, np.int32)
        np.cumsum(size, out=upto[1:])
        return self.pool[np.repeat((ranges >> self.BITS).astype(np.int32) - upto[:-1], size) + np.arange(upto[-1], dtype=np.int32)], upto

    def _trim(self) -> None:
        """Forgets the pieces that one group alone had, or all if that is not half of them."""
        ranges = np.fromiter(self.cache.values(), np.int64, len(self.cache))
        often = self.again[ranges >> self.BITS]
        if 2 * np.count_nonzero(often) > len(often):
            often[:] = False
        pieces = list(compress(self.cache, often.tolist()))
        ids, upto = self._gather(ranges[often])
        self.cache, self.filled = {}, 0
        self.again[:] = False
        self._keep(pieces, ids, upto[1:].astype(np.int64))

    def _learn(self, plain: list[bytes], whole: list[bytes]) -> None:
        """Caches new pieces: pre-tokens in normal form, and words to be cut as text."""
        if self.cut is None:
            self._keep_each({piece: piece.decode("utf-8", "replace") for piece in plain + whole})
            return
        unseen, plans, alone = dict.fromkeys(plain), {}, {}
        for piece in whole:
            s = piece.decode("utf-8", "replace")
            if "<|" in s or not self.PLAIN.fullmatch(s):
                alone[piece] = s
                continue
            low = s.lower()
            parts = [low.encode()] if low.isalpha() else [p.encode() for p in self.cut(low)]  # letters alone are one pre-token
            if parts != [piece]:
                plans[piece] = parts
            for p in parts:
                if p not in self.cache:
                    unseen[p] = None
        if unseen:
            ids = self._pretoken_ids(b" ".join(unseen))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(unseen):
                self._keep(unseen, ids, ends)
            else:
                self._keep_each({piece: piece.decode() for piece in unseen})
        self._keep_each(alone)
        if plans:
            ids, upto = self._gather(np.array([self.cache[p] for parts in plans.values() for p in parts], np.int64))
            self._keep(plans, ids, upto[np.cumsum([len(parts) for parts in plans.values()])].astype(np.int64))

    def _group(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        cls, low = _CLASS[buf], _LOWER[buf]
        lead = np.flatnonzero(buf - np.uint8(0xC3) < 3)
        if len(lead):
            letter = _ACCENTED[buf[lead] - np.uint8(0xC3), buf[lead + 1]]
            lead, letter = lead[letter > 0], letter[letter > 0]
            cls[lead] = cls[lead + 1] = 1
            low[lead], low[lead + 1] = letter >> 8, letter & 255
        inside = cls != 0
        cuts = np.empty(len(buf), bool)
        cuts[0] = inside[0]
        np.not_equal(cls[1:], cls[:-1], out=cuts[1:])
        cuts &= inside
        cuts |= cls == 2
        at = np.flatnonzero(cuts).astype(np.int32)
        if not len(at):
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        slow = cls[at] == 4
        whole = None
        if slow.any():
            begins = at == 0
            begins |= cls[at - 1] == 0
            word = np.cumsum(begins, dtype=np.int32)
            flagged = np.zeros(int(word[-1]) + 1, bool)
            flagged[word[slow]] = True
            whole = flagged[word]
            keep = begins | ~whole
            at, whole = at[keep], whole[keep]
            size = np.diff(at, append=np.int32(len(buf)))[whole]
            back = np.repeat(at[whole] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            low[back] = buf[back]  # as they are, for the library to normalise
        low = low[inside]  # without white space, a piece is the same bytes whatever follows it
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[at] - np.int32(1), np.int32(len(low)))
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        _, edges, data = coded.dictionary.buffers()
        edges, data, index = np.frombuffer(edges, np.int32, len(coded.dictionary) + 1).tolist(), data.to_pybytes(), coded.indices.to_numpy()
        pieces = [data[a:b] for a, b in zip(edges, edges[1:])]
        if len(self.cache) > self.CACHED:
            self._trim()
        ranges = np.fromiter(map(self.cache.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(ranges < 0)
        self.again[ranges[ranges >= 0] >> self.BITS] = True
        if len(new):
            as_text = np.zeros(len(pieces), bool)
            if whole is not None:
                as_text[index[whole]] = True
            as_text = as_text[new]
            self._learn([pieces[i] for i in new[~as_text].tolist()], [pieces[i] for i in new[as_text].tolist()])
            ranges[new] = np.fromiter((self.cache[pieces[i]] for i in new.tolist()), np.int64, len(new))
        ids, upto = self._gather(ranges[index])
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        edges = upto[np.searchsorted(at, starts)].tolist()
        yield from (ids[a:b] for a, b in zip(edges, edges[1:]))

    def encode_all(self, texts: list[bytes]):
        """uint32 ids of each UTF-8 text, in groups of ``GROUP_BYTES`` or one text."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > self.GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
        if group:
            yield from self._group(group)


_ENCODERS: dict[str, LibraryEncoder] = {}


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int | None = 2) -> DataFrame:
    """Encode doc_id and text into files of ascending document id under the URI ``folder``; returns the manifest."""

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = LibraryEncoder(path)
        coder = _ENCODERS[path]
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, writer, stream = f"part-{part:06d}-{uuid.uuid4().hex}.tpk", None, None
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode_all(texts)):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{root}/{name}")
                    writer = PackedWriter(stream, bit_width(coder.vocabulary))
                writer.add(doc_id, np.concatenate([ids, tail]))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [len(writer.docs)], "ids": [writer.starts[-1]]}, pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ranged = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")  # a repeated id is split by its texts
    return cut(ranged.select("doc_id", "text").mapInArrow(run, "part long, file string, docs long, ids long"))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start over all files, n_tokens and the CRC-32 of the ids of each document, from the files.

    The manifest has a row per file, whose running sum of ids is small enough
    for the driver at any size.
    """
    files, at = [], 0
    for r in manifest.orderBy("part").select("file", "ids").toLocalIterator():
        files.append((r.file, at))
        at += r.ids

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = PackedReader(source, source.size())
                    sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in reader.documents()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.docs, pa.int64(), mask=reader.docs == NULL_ID),
                            pa.array(base + reader.starts[:-1], pa.int64()),
                            pa.array(np.diff(reader.starts), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    listed = spark.createDataFrame(files, "file string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

