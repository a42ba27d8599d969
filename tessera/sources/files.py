"""Readers and writers: dialect-detecting CSV, JSON, triples, WAV, versioned tables."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def detect_separator(spark: SparkSession, path: str, lines: int = 50) -> str:
    """The separator (tab, pipe, semicolon, comma) that splits the first lines most evenly."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect() if r.value]

    def score(sep: str) -> tuple[int, int]:
        counts = [x.count(sep) for x in head]
        return (int(bool(counts) and min(counts) == max(counts) and min(counts) > 0), min(counts, default=0))

    return max(["\t", "|", ";", ","], key=score)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep or detect_separator(spark, path)).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read.option("samplingRatio", 0.1)).json(path)


def read_triples(spark: SparkSession, path: str, min_weight: float | None = None) -> DataFrame:
    """Tab-separated subject, predicate, object [, weight]; malformed lines are left out."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(p) >= 3)
    weight = F.try_element_at(p, F.lit(4)).cast("double")
    out = rows.select(*[F.trim(F.get(p, F.lit(i))).alias(n) for i, n in enumerate(("subject", "predicate", "object"))], weight.alias("weight"))
    return out if min_weight is None else out.where(F.coalesce("weight", F.lit(1.0)) >= min_weight)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, channel, index, seconds, value in [-1, 1]) of PCM files, a task per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                    raw = w.readframes(w.getnframes())
                if width == 1:
                    v = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
                elif width == 3:
                    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                    v = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
                else:
                    v = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
                v = v.reshape(-1, channels)
                for c in range(channels):
                    yield pd.DataFrame({"path": name, "channel": c, "index": np.arange(len(v)), "seconds": np.arange(len(v)) / rate, "value": v[:, c]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, channel int, index long, seconds double, value double")


class VersionedTable:
    """A system-versioned table: rows with [valid_from, valid_to) microseconds, written as whole new snapshots.

    A write makes a new folder and then moves a pointer row, so readers see
    either the old or the new state.
    """

    FOREVER = 2**63 - 1

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def rows(self) -> DataFrame:
        last = self.spark.read.schema("seq long, folder string").json(f"{self.path}/log").orderBy(F.col("seq").desc()).first()
        return self.spark.read.parquet(f"{self.path}/{last.folder}")

    def _publish(self, df: DataFrame, seq: int) -> None:
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(seq, folder)], "seq long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/log")

    def create(self, df: DataFrame, at: int) -> None:
        self._publish(df.withColumns({"valid_from": F.lit(at).cast("long"), "valid_to": F.lit(self.FOREVER).cast("long")}), at)

    def upsert(self, changes: DataFrame, at: int) -> None:
        """Close the current versions of changed keys at ``at`` and add the new ones."""
        whole = F.struct(*[F.col(c) for c in changes.columns])
        changes = changes.groupBy(F.col(self.key).alias("_key")).agg(F.max(whole).alias("_row")).select("_row.*")  # a key given twice has one current row
        old = self.rows()
        keys = changes.select(F.col(self.key).alias("_k")).distinct()
        joined = old.join(keys, F.col(self.key) == F.col("_k"), "left")
        closed = joined.withColumn("valid_to", F.when(F.col("_k").isNotNull() & (F.col("valid_to") == self.FOREVER), F.lit(at)).otherwise(F.col("valid_to"))).drop("_k")
        fresh = changes.withColumns({"valid_from": F.lit(at).cast("long"), "valid_to": F.lit(self.FOREVER).cast("long")})
        self._publish(closed.unionByName(fresh), at)

    def delete(self, keys: DataFrame, at: int) -> None:
        k = keys.select(F.col(self.key).alias("_k")).distinct()
        joined = self.rows().join(k, F.col(self.key) == F.col("_k"), "left")
        self._publish(joined.withColumn("valid_to", F.when(F.col("_k").isNotNull() & (F.col("valid_to") == self.FOREVER), F.lit(at)).otherwise(F.col("valid_to"))).drop("_k"), at)

    def current(self) -> DataFrame:
        return self.rows().where(F.col("valid_to") == self.FOREVER).drop("valid_from", "valid_to")

    def as_of(self, at: int) -> DataFrame:
        return self.rows().where((F.col("valid_from") <= at) & (F.col("valid_to") > at)).drop("valid_from", "valid_to")
