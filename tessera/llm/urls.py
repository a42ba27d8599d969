"""URL filtering by a blocked Bloom filter and an exact hash join.

A rule (host, path, verdict) fits its host and all subdomains of it when the
path of the URL starts with the rule's. A listed URL is canonical (``canonical``)
and fits URLs of the same canonical form; a listed host (no path) fits the host
and its subdomains. For every URL the keys that could be in the lists are made:
each suffix of its host of no more labels than any entry has, with each prefix
of its path whose length occurs in the rules, each such suffix of its canonical
host, and its canonical form. Keys that pass the Bloom filter are joined with
the entries by equality, which removes the filter's false positives; the
longest fitting rule decides, else a listed entry.

The filter is blocked: a key sets ``PROBES`` bits inside one block of 256
bits, so a probe touches one cache line. It is built by a grouped ``bit_or``
over the entries. Up to ``MAX_FILTER_BLOCKS`` blocks (32 bytes each) it is
broadcast; more entries are probed by the hash join alone.

Defined cases: a null URL or one without ``://`` has empty host and path and
no entry; empty lists or pages give their results; repeated rows are judged
each; of rules with equal host and path the blocking one wins, of rules of
equal length the one with the longer host; URLs of any length are judged, in
time proportional to their length; columns of ``pages`` that have the names of
the new ones stay, and the new ones get underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, spare

PROBES = 6
BITS_PER_KEY = 16
BLOCK_BITS = 256
#: 8 MB at most are broadcast.
MAX_FILTER_BLOCKS = 262_144
#: Entries are broadcast to the exact join up to so many; beyond, they are shuffled.
MAX_BROADCAST_ENTRIES = 50_000
#: Fitting entries are broadcast to the pages up to so many distinct URLs; beyond, both are shuffled.
MAX_BROADCAST_FITS = 200_000
#: A URL makes a key for each length of path in the rules; beyond so many lengths, for each prefix.
MAX_LENGTHS = 1_000
LIST_SCHEMA = "host string, path string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    low = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host without user, port and trailing dots, and path with its percent codes decoded, ``/`` at least."""
    plain = F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$|\.+$", "")
    plain = F.regexp_replace(plain, r"\.+$", "")

    def decoded(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)

    low = F.translate(decoded(plain), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.when(path == "", F.lit("/")).otherwise(decoded(path))


def _bits(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block index and the 4 x uint64 mask of each 64-bit hash."""
    h = h.astype(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)
    mask = np.zeros((len(h), 4), np.uint64)
    rows = np.arange(len(h))
    low = h & np.uint64(0xFFFFFFFF)
    for k in range(PROBES):
        mixed = (low * np.uint64(2 * k + 0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        bit = (mixed >> np.uint64(24)).astype(np.int64)
        mask[rows, bit >> 6] |= np.uint64(1) << (bit & 63).astype(np.uint64)
    return block, mask


def build_filter(keys: DataFrame, n: int) -> np.ndarray | None:
    """Blocks of the filter over the ``n`` values of ``key``, or None if they are too many to broadcast them."""
    n_blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    if n_blocks > MAX_FILTER_BLOCKS:
        return None

    def masks(batches):
        for pdf in batches:
            block, mask = _bits(pdf["h"].to_numpy(), n_blocks)
            signed = mask.view(np.int64)
            yield pd.DataFrame({"block": block} | {f"w{i}": signed[:, i] for i in range(4)})

    parts = keys.select(F.xxhash64("key").alias("h")).mapInPandas(masks, "block long, w0 long, w1 long, w2 long, w3 long")
    rows = parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]).collect()  # at most MAX_FILTER_BLOCKS
    blocks = np.zeros((n_blocks, 4), np.int64)
    for r in rows:
        blocks[r.block] = (r.w0, r.w1, r.w2, r.w3)
    return blocks.view(np.uint64)


def maybe_listed(blocks: np.ndarray, spark: SparkSession):
    """Pandas UDF: may a key with this hash be in the filter?"""
    shared = spark.sparkContext.broadcast(blocks.tobytes())

    @F.pandas_udf(T.BooleanType())
    def probe(h: pd.Series) -> pd.Series:
        table = np.frombuffer(shared.value, np.uint64).reshape(-1, 4)
        block, mask = _bits(h.to_numpy(), len(table))
        return pd.Series(((table[block] & mask) == mask).all(axis=1))

    return probe


def _suffixes(host: Column, most: int) -> Column:
    """The last 1 to ``most`` labels of a host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, most)))), lambda k: F.concat_ws(".", F.slice(labels, n - k + 1, k)))


def url_verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule and verdict.

    ``rules`` and ``listed`` have the columns of ``LIST_SCHEMA``. The longest
    fitting rule decides and is named in ``rule``; without one, a listed URL
    blocks (or has its entry's verdict), and all others get ``otherwise``.
    Only keys that pass the filter are joined.
    """
    spark = pages.sparkSession
    host_, path_, rule_, verdict_ = (spare(pages, n) for n in ("host", "path", "rule", "verdict"))

    def entries_of(df: DataFrame, ruled: bool) -> DataFrame:
        slim = df.where("host is not null").select(F.col("host").alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.coalesce("verdict", F.lit("block")).alias("_v"))
        return slim.groupBy("_h", "_p").agg(F.max("_v").alias("_v")).withColumn("_ruled", F.lit(ruled))

    tag = F.when(F.col("_ruled"), "r").otherwise("l")
    entries = cut(entries_of(rules, True).unionByName(entries_of(listed, False)).withColumn("key", F.concat_ws("\x00", tag, "_h", "_p")))
    labels = F.max(F.when(F.col("_ruled") | (F.col("_p") == ""), F.size(F.split("_h", r"\."))))
    n, n_labels, longest = entries.agg(F.count("*"), labels, F.max(F.when(F.col("_ruled"), F.length("_p")))).first()
    lengths = sorted(r[0] for r in entries.where("_ruled").select(F.length("_p")).distinct().limit(MAX_LENGTHS + 1).collect())
    host, path = split_url(F.col("url"))
    shaped = pages.withColumns({"_url_host": host, "_url_path": path})
    c_host, c_path = canonical(F.col("_url_host"), F.col("_url_path"))
    whole = shaped.where("_url_host <> ''").select("_url_host", "_url_path").distinct().withColumns({"_c_host": c_host, "_c_path": c_path})
    if len(lengths) > MAX_LENGTHS:
        fitting = F.sequence(F.lit(0), F.least(F.length("_url_path"), F.lit(longest)))
    else:
        fitting = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda n: n <= F.length("_url_path"))
    ruled = F.transform(_suffixes(F.col("_url_host"), n_labels or 1), lambda s: F.transform(fitting, lambda n: F.concat_ws("\x00", F.lit("r"), s, F.substring(F.col("_url_path"), F.lit(1), n))))
    hosts = F.transform(_suffixes(F.col("_c_host"), n_labels or 1), lambda s: F.concat_ws("\x00", F.lit("l"), s, F.lit("")))
    own = F.array(F.concat_ws("\x00", F.lit("l"), "_c_host", "_c_path"))
    probes = whole.select("_url_host", "_url_path", F.explode(F.concat(F.flatten(ruled), hosts, own)).alias("key"))
    blocks = build_filter(entries, n)
    if blocks is not None:
        probes = probes.where(maybe_listed(blocks, spark)(F.xxhash64("key")))
    fits = probes.join(F.broadcast(entries) if n <= MAX_BROADCAST_ENTRIES else entries, "key")
    order = F.struct(F.length(F.concat("_h", "_p")).alias("n"), F.length("_h").alias("m"), "_h", "_p", "_v")
    best = fits.groupBy(F.col("_url_host").alias("_bh"), F.col("_url_path").alias("_bp")).agg(
        F.max(F.when(F.col("_ruled"), order)).alias("_rule"), F.max(F.when(~F.col("_ruled"), order)).alias("_listed")
    )
    best = cut(best)
    best = F.broadcast(best) if best.count() <= MAX_BROADCAST_FITS else best
    out = shaped.join(best, (F.col("_url_host") == F.col("_bh")) & (F.col("_url_path") == F.col("_bp")), "left")
    return out.select(
        *[pages[c] for c in pages.columns],
        F.col("_url_host").alias(host_),
        F.col("_url_path").alias(path_),
        F.concat("_rule._h", "_rule._p").alias(rule_),
        F.coalesce("_rule._v", "_listed._v", F.lit(otherwise)).alias(verdict_),
    )


def listed_by_words(pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """A list of the canonical URLs of all pages on hosts of which a part between dots and hyphens is one of ``words``."""
    host, path = split_url(F.col("url"))
    c_host, c_path = canonical(F.col("h"), F.col("p"))
    some = pages.select(host.alias("h"), path.alias("p")).select(c_host.alias("host"), c_path.alias("path"))
    return some.where(F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in words]))).distinct().withColumn("verdict", F.lit("block"))
