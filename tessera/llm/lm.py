"""Language-model scores from Brown class bigrams.

Exchange clustering assigns words to classes so as to maximise the likelihood
of class bigrams; a text's probability is the product of class transitions and
word emissions. It has two steps. First the driver exchanges units between
classes until none moves: the ``TOP_WORDS`` most frequent words, ``SUFFIXES``
groups of all other words by their last two bytes, and the end of a text, a
table of fixed size. Then a distributed pass counts for each other training
word, however rare, how often each class stands before and behind it, and
moves the word to the class that raises the likelihood most. Only words that
no training text holds keep the class of their suffix group. Class bigrams,
class sizes, word counts and distinct words are then counted over all training
texts.

Texts are cut into words twice, to count them and to write chunks of word
numbers, which later passes read. At most ``FREQUENT`` words are broadcast and
have a number of their own; a chunk lists its other words (a tenth or so of
the tokens) by ``BUCKETS`` of their checksums. A word's occurrences of all
chunks meet in its bucket, which returns its class and count to each chunk;
so ``FREQUENT`` bounds memory and changes no result.

Defined cases: null text counts as empty and has the end alone; a null
document id is held out; without training texts all counts are 0 and the
scores those of the smoothing; repeated rows are scored each; of classes of
equal gain the first is taken; very long texts are scored whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _ROWS_CONF, cut, scratch, tidy

TOP_WORDS, SUFFIXES, CLASSES = 384, 127, 64
UNITS = TOP_WORDS + SUFFIXES + 1
END_UNIT = UNITS - 1
#: No word holds white space, so a line feed can stand for the end of a text.
END = b"\n"
#: Bound of the broadcast word table.
FREQUENT = 200_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000
ALPHA, KAPPA = 0.1, 20.0
#: Tokens of a chunk, unless a single text has more; chunks of an Arrow batch.
CHUNK_TOKENS, CHUNK_ROWS = 1 << 20, 8
#: Parts that words are dealt to, and words whose contexts are held at once.
BUCKETS, BLOCK = 1024, 4096


def held_out() -> Column:
    """Remainder 0 of crc32 of the document id's text by 10; null ids too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))


def words_of(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Words of each text, one text at a time; ``bytes`` lower-cases A-Z and splits at ASCII white space only."""
    return ((t.as_py() or b"").lower().split() for t in batch.column("text").cast(pa.binary()))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and its count c over ``docs``, the end included."""

    def run(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for words in words_of(batch):
                seen.update(words)
                seen[END] += 1
                if len(seen) > COUNTED:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_bound(counts: DataFrame) -> int:
    """Least count such that at most FREQUENT words have it or more, from a histogram of logarithmic buckets."""
    c = F.col("c")
    shift = F.greatest(F.length(F.bin(c)) - 5, F.lit(0))
    low = (F.floor(c / F.pow(F.lit(2), shift)) * F.pow(F.lit(2), shift)).cast("long")
    rows = sorted(((r.low, r.n) for r in counts.groupBy(low.alias("low")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, bound = 0, 1 << 62
    for value, n in rows:
        total += n
        if total > FREQUENT:
            break
        bound = value
    return bound


class WordIndex(dict):
    """Frequent words to their place in the table; any other word to a place behind it, by its suffix group."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.size = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.size + zlib.crc32(word[-2:]) % SUFFIXES


def units_of(words: WordIndex) -> np.ndarray:
    """Unit of each place of a WordIndex, whose first TOP_WORDS words are the most frequent."""
    first = np.arange(min(TOP_WORDS, words.size))
    others = [TOP_WORDS + zlib.crc32(w[-2:]) % SUFFIXES for w in list(words)[TOP_WORDS:]]
    return np.concatenate([first, others, TOP_WORDS + np.arange(SUFFIXES)]).astype(np.int64)


def exchange(bigrams: np.ndarray) -> np.ndarray:
    """Class of each unit: every unit in turn moves to the class that raises the bigram likelihood most.

    ``bigrams[u, v]`` counts v after u. The end keeps a class of its own. Ends where a sweep
    moves nothing: each move raises the likelihood by more than its rounding.
    """

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    n = bigrams.astype(float)
    least = 1e-9 + 1e-13 * float(f(n.sum()))
    order = np.argsort(-n.sum(0), kind="stable")
    order = order[order != END_UNIT]
    cls = np.full(UNITS, CLASSES - 1)
    cls[order] = np.arange(len(order)) % (CLASSES - 1)
    member = np.zeros((UNITS, CLASSES))
    member[np.arange(UNITS), cls] = 1
    g = member.T @ n @ member
    moved = 1
    while moved:
        moved = 0
        for u in order:
            a, self_n = cls[u], n[u, u]
            r, l = n[u] @ member, n[:, u] @ member
            g[a] -= r
            g[:, a] -= l
            g[a, a] += self_n
            member[u, a] = 0
            r[a] -= self_n
            l[a] -= self_n
            rows, cols, fg = g.sum(1) + l, g.sum(0) + r, f(g)  # what the unit follows and precedes counts wherever it goes
            up = f(g + r[None, :]) - fg
            side = f(g + l[:, None]) - fg
            gain = up.sum(1) - up.diagonal() + side.sum(0) - side.diagonal()
            gain += f(g.diagonal() + r + l + self_n) - fg.diagonal()
            gain -= f(rows + r.sum() + self_n) - f(rows) + f(cols + l.sum() + self_n) - f(cols)
            gain[CLASSES - 1] = -np.inf
            b = int(gain.argmax())
            b = a if gain[b] <= gain[a] + least else b
            member[u, b], cls[u] = 1, b
            g[b] += r
            g[:, b] += l
            g[b, b] += self_n
            moved += a != b
    return cls


def context_gains(pairs: np.ndarray) -> np.ndarray:
    """Gain, to first order, for one context of a word: rows are classes behind it, then classes before it; columns the word's class.

    Only the end has the last class. Multiples of 2 ** -16 add up without rounding, so the order of contexts decides no tie.
    """
    p = pairs + 0.5
    behind = np.log(p / p.sum(1, keepdims=True)).T
    before = np.log(p / p.sum(0, keepdims=True))
    out = np.round(np.concatenate([behind, before]) * 65536) / 65536
    out[:, CLASSES - 1] = -np.inf
    return out


class ChunkIndex(WordIndex):
    """Frequent words to their place; the other words of a chunk get places behind those in turn."""

    def __init__(self, words: list[bytes]):
        super().__init__(words)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = self.size + len(self.new)
        self.new.append(word)
        return place

    def take(self) -> list[bytes]:
        """The chunk's other words, which are forgotten."""
        out, self.new = self.new, []
        for w in out:
            del self[w]
        return out


CHUNK = "held array<boolean>, sizes binary, places binary, words binary, groups binary, edges binary"


def encode(docs: DataFrame, index) -> DataFrame:
    """``docs`` in chunks of texts: their ids, held_out and sizes, places of all tokens, and the chunk's other words.

    Those are sorted by bucket (``edges``), with their suffix groups; a place of ``index.size`` + i is the i-th of them.
    """

    def pieces(words, batch):
        """(b, places of each text) of chunks that end before the batch's text b; ``words`` has the chunk's other words meanwhile."""
        found, size, b = [], 0, 0
        for text in words_of(batch):
            if found and size + len(text) > CHUNK_TOKENS:
                yield b, found
                found, size = [], 0
            found.append(np.fromiter(map(words.__getitem__, text), np.int32, len(text)))
            size, b = size + len(text), b + 1
        if found:
            yield b, found

    def run(batches):
        words, row = ChunkIndex(index.value.split()), TaskContext.get().partitionId() << 33
        for batch in batches:
            a = 0
            for b, found in pieces(words, batch):
                size, at = np.array([len(p) for p in found], np.int64), np.concatenate(found)
                new = words.take()
                bucket = np.fromiter(map(zlib.crc32, new), np.int64, len(new)) % BUCKETS
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(len(new), np.int32)
                rank[order] = np.arange(len(new), dtype=np.int32)
                other = at >= words.size
                at[other] = words.size + rank[at[other] - words.size]
                new = [new[i] for i in order.tolist()]
                groups = bytes([zlib.crc32(w[-2:]) % SUFFIXES for w in new])
                edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(k).slice(a, b - a)) for k in ("doc_id", "held_out")]
                data = [size.tobytes(), at.tobytes(), b"\n".join(new), groups, edges.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *lists, *[pa.array([x], pa.binary()) for x in data]], ["chunk", "ids", "held", "sizes", "places", "words", "groups", "edges"])
                row, a = row + 1, b

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.mapInArrow(tidy(run), f"chunk long, ids array<{kind}>, {CHUNK}"))


def numbers(batch: pa.RecordBatch, column: str, i: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_py(), kind)


def token_line(batch: pa.RecordBatch, i: int, trained: bool = True) -> np.ndarray:
    """Places of the tokens of a chunk (of its training texts), -1 for the end, which also goes before the first text."""
    size, places = numbers(batch, "sizes", i, np.int64), numbers(batch, "places", i, np.int32)
    if trained:
        keep = ~np.array(batch.column("held")[i].as_py(), bool)
        places, size = places[np.repeat(keep, size)], size[keep]
    line = np.full(len(places) + len(size) + 1, -1, np.int32)
    line[np.arange(len(places)) + np.repeat(np.arange(1, len(size) + 1), size)] = places
    return line


def unit_bigrams(chunks: DataFrame, unit) -> np.ndarray:
    """Counts [previous unit, unit] over training texts; a text starts after an end. ``unit`` has the unit of each frequent word."""

    def run(batches):
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                u = np.concatenate([unit.value, TOP_WORDS + numbers(batch, "groups", i, np.uint8).astype(np.int64), [END_UNIT]])[token_line(batch, i)]
                total += np.bincount(u[:-1] * UNITS + u[1:], minlength=UNITS * UNITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["k", "n"])

    out = np.zeros(UNITS * UNITS)
    slim = chunks.select("held", "sizes", "places", "groups")
    for r in slim.mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most UNITS * UNITS rows
        out[r.k] = r.n
    return out.reshape(UNITS, UNITS)


def best_classes(keys: np.ndarray, n: int, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and number of contexts of each of ``n`` words, from sorted keys (word * 2 * CLASSES + slot), one a context."""
    best, contexts = np.zeros(n, np.uint8), np.zeros(n, np.int64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        lo, hi = np.searchsorted(keys, [a * 2 * CLASSES, b * 2 * CLASSES])
        dense = np.bincount(keys[lo:hi] - a * 2 * CLASSES, minlength=(b - a) * 2 * CLASSES).reshape(b - a, 2 * CLASSES)
        best[a:b], contexts[a:b] = (dense.astype(float) @ gains).argmax(axis=1), dense.sum(axis=1)
    return best, contexts


def contexts_of(places: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Keys of the class behind and before each token of ``own``, whose words have ``places``; none is the first or last, as those are ends."""
    at = places.astype(np.int64) * (2 * CLASSES)
    return np.concatenate([at + c[own + 1], at + CLASSES + c[own - 1]])


def frequent_classes(chunks: DataFrame, first, gains) -> np.ndarray:
    """Class of each frequent word: of units as given in ``first`` (classes of words, then of suffix groups), of others by their contexts."""
    known = first.value[0]
    n = len(known)
    if n <= TOP_WORDS:
        return known

    depth = -(-n // BUCKETS)
    width = depth * 2 * CLASSES

    def count(batches):
        dealt = (np.arange(n) % BUCKETS * depth + np.arange(n) // BUCKETS).astype(np.int32)  # a bucket's words side by side
        held, size = [], 0

        def rows():
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).astype(np.int32)
            m = np.diff(first, append=np.int32(len(keys)))
            k = keys[first]
            del keys, first
            edges = np.searchsorted(k, np.arange(BUCKETS + 1, dtype=np.int32) * np.int32(width)).tolist()
            some = [b for b in range(BUCKETS) if edges[b] < edges[b + 1]]
            k %= np.int32(width)
            columns = [pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary()) for x in (k, m)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *columns], ["bucket", "k", "m"])

        of_place, of_group = first.value
        for batch in batches:
            for i in range(batch.num_rows):
                line = token_line(batch, i)
                c = np.concatenate([of_place, of_group[numbers(batch, "groups", i, np.uint8)], [CLASSES - 1]])[line]
                own = np.flatnonzero((line >= TOP_WORDS) & (line < n))
                held.append(contexts_of(dealt[line[own]], c, own).astype(np.int32))
                size += len(held[-1])
                if size > 4 * CHUNK_TOKENS:
                    yield rows()
                    size = 0
        if size:
            yield rows()

    def choose(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in enumerate(batch.column("bucket").to_pylist()):
                if b not in total:
                    total[b] = np.zeros((depth, 2 * CLASSES))
                total[b].ravel()[numbers(batch, "k", i, np.int32)] += numbers(batch, "m", i, np.int32)
        for b, dense in total.items():
            w = np.flatnonzero(dense.any(axis=1))
            best = (dense[w] @ gains.value).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(w * BUCKETS + b, pa.int32()), pa.array(best, pa.int32())], ["w", "c"])

    counted = chunks.select("held", "sizes", "places", "groups").mapInArrow(tidy(count), "bucket int, k binary, m binary")
    chosen = counted.repartition("bucket").mapInArrow(tidy(choose), "w int, c int").toArrow()  # at most FREQUENT rows
    out = known.copy()
    out[chosen["w"].to_numpy()] = chosen["c"].to_numpy()
    return out


def other_classes(chunks: DataFrame, first, gains) -> DataFrame:
    """chunk, bucket, and class and training count of each of the chunk's words of that bucket, in their order.

    A row of chunk -1 has the number of distinct training words of each class in its bucket.
    """

    def count(batches):
        of_place, of_group = first.value
        n = len(of_place)
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                edges, line = numbers(batch, "edges", i, np.int32).astype(np.int64), token_line(batch, i)
                c = np.concatenate([of_place, of_group[numbers(batch, "groups", i, np.uint8)], [CLASSES - 1]])[line]
                own = np.flatnonzero(line >= n)
                keys = np.sort(contexts_of(line[own] - n, c, own))
                cuts = np.searchsorted(keys, edges * (2 * CLASSES)).tolist()
                words = batch.column("words")[i].as_py().split(b"\n")
                at = edges.tolist()
                some = [b for b in range(BUCKETS) if at[b] < at[b + 1]]
                names = [b"\n".join(words[at[b] : at[b + 1]]) for b in some]
                found = [(keys[cuts[b] : cuts[b + 1]] - at[b] * 2 * CLASSES).astype(np.int32).tobytes() for b in some]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(names, pa.binary()), pa.array(found, pa.binary())], ["chunk", "bucket", "words", "keys"])

    def choose(batches):
        parts: dict[int, list] = defaultdict(list)
        for batch in batches:
            for chunk, b, names, found in zip(*(batch.column(k).to_pylist() for k in ("chunk", "bucket", "words", "keys"))):
                parts[b].append((chunk, names, found))
        for b in list(parts):
            place: dict[bytes, int] = {}
            mine, keys, own = parts.pop(b), [], []
            for _, names, found in mine:
                own.append(np.array([place.setdefault(w, len(place)) for w in names.split(b"\n")]))
                k = np.frombuffer(found, np.int32).astype(np.int64)
                keys.append(own[-1][k // (2 * CLASSES)] * (2 * CLASSES) + k % (2 * CLASSES))
            best, contexts = best_classes(np.sort(np.concatenate(keys)), len(place), gains.value)
            c = contexts // 2
            distinct = np.bincount(best[c > 0], minlength=CLASSES).astype(np.int64)
            chunk = [-1, *[m[0] for m in mine]]
            classes = [distinct.tobytes(), *[best[o].tobytes() for o in own]]
            counts = [b"", *[c[o].tobytes() for o in own]]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([b] * len(chunk), pa.int32()), pa.array(classes, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "bucket", "classes", "counts"])

    counted = chunks.select("chunk", "held", "sizes", "places", "words", "groups", "edges").mapInArrow(tidy(count), "chunk long, bucket int, words binary, keys binary")
    return cut(counted.repartition("bucket").mapInArrow(tidy(choose), "chunk long, bucket int, classes binary, counts binary"))


def classed(chunks: DataFrame, others: DataFrame, final, of_group, logs) -> DataFrame:
    """Chunks with the class of each token, and per text the sum of its words' log10 counts and the number of known words."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n = len(final.value)
                groups, edges = numbers(batch, "groups", i, np.uint8), numbers(batch, "edges", i, np.int32)
                c, k = of_group[groups], np.zeros(len(groups), np.int64)
                for part in batch.column("parts")[i].as_py() or []:
                    a, b = edges[part["bucket"]], edges[part["bucket"] + 1]
                    k[a:b] = np.frombuffer(part["counts"], np.int64)
                    c[a:b] = np.where(k[a:b] > 0, np.frombuffer(part["classes"], np.uint8), c[a:b])
                line = token_line(batch, i, trained=False)
                out = np.concatenate([final.value, c, [CLASSES - 1]])[line].astype(np.uint8)
                weight = np.concatenate([logs.value, np.log10(k + ALPHA), [0.0]])[line]
                known = np.concatenate([np.ones(n, np.int64), k > 0, [0]])[line]
                starts = text_ends(numbers(batch, "sizes", i, np.int64))[:-1]  # each text goes with the end before it, which adds nothing
                seen, also = np.add.reduceat(weight[:-1], starts), np.add.reduceat(known[:-1], starts)
                data = [batch.column("sizes")[i].as_py(), out.tobytes(), seen.tobytes(), also.tobytes()]
                lists = [batch.column(x).slice(i, 1) for x in ("ids", "held")]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([x], pa.binary()) for x in data]], ["ids", "held", "sizes", "classes", "seen", "known"])

    parts = others.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "classes", "counts")).alias("parts"))  # at most BUCKETS a chunk
    kind = chunks.schema["ids"].dataType.simpleString()
    joined = chunks.drop("words").join(parts, "chunk", "left")
    return cut(joined.mapInArrow(tidy(run), f"ids {kind}, held array<boolean>, sizes binary, classes binary, seen binary, known binary"))


def text_ends(size: np.ndarray) -> np.ndarray:
    """Positions of the end before the first text and of each text's own in a chunk's line."""
    return np.concatenate([[0], np.cumsum(size + 1)])


class ClassModel:
    """Log10 transition and emission terms of the class bigram model."""

    def __init__(self, pairs: np.ndarray, distinct: np.ndarray):
        """``pairs`` of classes and the number of distinct words of each class, over all training texts."""
        single = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
        self.transition = np.log10((pairs + KAPPA * single) / (pairs.sum(1, keepdims=True) + KAPPA))
        #: log10 of each class's emission denominator; an unseen word has the mass ALPHA in its class
        self.emission = np.log10(pairs.sum(0) + ALPHA * (distinct + 1))


def class_pairs(chunks: DataFrame) -> np.ndarray:
    """Counts [previous class, class] over training texts."""

    def run(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                c = numbers(batch, "classes", i, np.uint8).astype(np.int64)
                step = c[:-1] * CLASSES + c[1:]
                keep = ~np.array(batch.column("held")[i].as_py(), bool)
                total += np.bincount(step[np.repeat(keep, numbers(batch, "sizes", i, np.int64) + 1)], minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for r in chunks.select("held", "sizes", "classes").mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # CLASSES * CLASSES rows
        out[r.k] = r.n
    return out.reshape(CLASSES, CLASSES)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of ``docs``."""
    with scratch(docs.sparkSession):
        return _lm_scores(docs)


def _lm_scores(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    counts = cut(word_counts(slim.where(~F.col("held_out"))))
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bound = frequent_bound(counts)
    end = F.lit(bytearray(END))
    c_end = (counts.where(F.col("word") == end).select("c").first() or [0])[0]
    inner = counts.where(F.col("word") != end)
    rows = inner.where(F.col("c") >= bound).collect()  # at most FREQUENT rows
    if len(rows) < TOP_WORDS:  # many words share the bound's count
        rows = inner.orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect()
    top = sorted(((r.c, bytes(r.word)) for r in rows), key=lambda x: (-x[0], x[1]))
    words = [w for _, w in top]
    chunks = encode(slim, share(b"\n".join(words)))
    spark.conf.set(_ROWS_CONF, str(CHUNK_ROWS))  # until ``scratch`` ends; a chunk has many texts
    unit = units_of(WordIndex(words))[: len(words)]
    bigrams = unit_bigrams(chunks, share(unit))
    units = exchange(bigrams)
    member = np.eye(CLASSES)[units]
    gains = context_gains(member.T @ bigrams @ member)
    gains = share(np.where(np.isinf(gains), -1e12, gains))
    of_group = units[TOP_WORDS : TOP_WORDS + SUFFIXES]
    first = share((units[unit], of_group))
    final = frequent_classes(chunks, first, gains)
    others = other_classes(chunks, first, gains)
    distinct = np.bincount(final, minlength=CLASSES)
    distinct[CLASSES - 1] += c_end > 0
    for r in others.where("chunk = -1").select("classes").collect():  # at most BUCKETS rows
        distinct += np.frombuffer(r.classes, np.int64)
    scored = classed(chunks, others, share(final), of_group, share(np.log10(np.array([c for c, _ in top], float) + ALPHA)))
    model = ClassModel(class_pairs(scored), distinct)
    transition, emission = model.transition.ravel(), np.where(np.arange(CLASSES) < CLASSES - 1, model.emission, 0.0)
    log_end = math.log10(c_end + ALPHA)
    per_token = math.log10(n_all + ALPHA * (v_all + 1))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c, size = numbers(batch, "classes", i, np.uint8).astype(np.int64), numbers(batch, "sizes", i, np.int64)
                seen, known = numbers(batch, "seen", i, np.float64), numbers(batch, "known", i, np.int64) + (c_end > 0)
                starts = text_ends(size)[:-1]
                steps = np.add.reduceat(transition[c[:-1] * CLASSES + c[1:]] - emission[c[:-1]], starts)
                n, score = size + 1, seen + steps
                base = seen + log_end - n * per_token
                data = [n, known, np.full(len(n), n_all, np.int64), base, score, np.power(10.0, -score / n)]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), batch.column("held").slice(i, 1).flatten(), *[pa.array(x) for x in data]], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(scored.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"), keep=True)
