"""BPE encoding with a priority queue over a linked symbol list, and decoding.

A pre-token starts as a doubly linked list of symbols. A heap holds the rank
of every adjacent pair that has a merge; the least rank (leftmost at ties) is
popped, skipped if its symbols have changed since, else merged, and the two
new pairs are pushed: O(n log n) for a pre-token of any length. Decoding
concatenates vocabulary strings with the separator that the file implies.

Texts are cut at ASCII white space, which no pre-token crosses; a bounded
cache maps each piece to its packed ids.

Defined cases: null text counts as empty and has no ids; special tokens in a
text get their ids, as in the library; texts of any length are encoded whole;
of pairs with equal rank the leftmost merges first; repeated rows are encoded
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from array import array

import regex

from tessera.llm.common import cut, release, scratch

#: Pieces kept in a cache of a worker (about 200 bytes each, two caches), and the longest piece kept.
CACHE_PIECES, CACHE_BYTES = 300_000, 64


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return table


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class BytePairEncoder:
    """Encoder and decoder of a ``tokenizers`` file of the word-end BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max(*vocab.values(), *self.specials.values()))
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.strings[i] = s
        self.joiner = " " if spec["decoder"] is None else ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left << 20 | right) -> rank << 20 | merged id; an earlier merge of a pair is replaced by a later one, as in the library
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.pieces = regex.compile(split["pattern"]["Regex"].replace("\\s", space))
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.cache: dict[bytes, bytes] = _Cache(self._pack)
        self.tokens: dict[str, bytes] = _Cache(lambda word: pack_ids(self._merge_word(word)))

    def _merge_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode("utf-8")
        inner = self.inner
        sym = [inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        n = len(sym)
        if n == 1:
            return sym
        merges = self.merges.get
        heap = []
        for i in range(n - 1):
            m = merges(sym[i] << 20 | sym[i + 1])
            if m is not None:
                heap.append((m >> 20, i, m))
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            _, i, m = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or merges(sym[i] << 20 | sym[j]) != m:
                continue  # stale: one of the two symbols has changed or gone
            sym[i], sym[j] = m & 0xFFFFF, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                x = merges(sym[i] << 20 | sym[k])
                if x is not None:
                    heapq.heappush(heap, (x >> 20, i, x))
            h = before[i]
            if h >= 0:
                x = merges(sym[h] << 20 | sym[i])
                if x is not None:
                    heapq.heappush(heap, (x >> 20, h, x))
        return [s for s in sym if s >= 0]

    def _pack(self, piece: bytes) -> bytes:
        """Packed ids of a piece; those of a plain word are the pre-token's own object, so both caches hold it once."""
        text, out = piece.decode("utf-8", "replace"), []
        for k, part in enumerate(self.special_cut.split(text) if self.special_cut else [text]):
            if k % 2:
                out.append(pack_ids([self.specials[part]]))
            elif part.isascii() and part.isalpha():
                out.append(self.tokens[part.lower()])
            elif part:
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # lower case letter by letter: no final sigma
                out += map(self.tokens.__getitem__, self.pieces.findall(low))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_packed(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, text.split()))

    def forget(self) -> None:
        """Ends a task: its worker lives on, beside those of other operators."""
        self.cache.clear()
        self.tokens.clear()
        release()

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text.encode("utf-8"))).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.joiner.join(map(self.strings.__getitem__, ids))


class _Cache(dict):
    """A dict that makes missing values and starts anew when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[key] = value
        return value


_LOADED: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a file, once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = BytePairEncoder(path)
    return _LOADED[path]


def bpe_digests(docs, path: str):
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text, a row for each row of ``docs``."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                packed = coder.encode_packed(text or b"")
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(coder.decode(memoryview(packed).cast("I").tolist()).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession):  # JVM and worker each hold a batch of whole texts
        return cut(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"), keep=True)


def bpe_encode(docs, path: str):
    """``docs`` rows as doc_id, ids and decoded text."""
    import pyarrow as pa

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            ids, texts = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                ids.append(memoryview(coder.encode_packed(text or b"")).cast("I").tolist())
                texts.append(coder.decode(ids[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
        coder.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
