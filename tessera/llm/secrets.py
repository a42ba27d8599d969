"""Secret scanning over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its content. The
ledger holds which (blob, rule version) pairs were scanned and what was found,
so a run scans only blobs, or rules, that it has not seen, each distinct blob
once, and joins the findings back to all paths that hold the blob.

A blob's content is taken from its least path, chosen by a pre-aggregated
minimum, so a blob with millions of copies costs one content and no hot task.

Defined cases: null content counts as empty; null paths are paths like others;
repeated rows each get the findings; very long contents are scanned whole, in
linear time; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut

BASE_KINDS = ("assign", "access", "hex")
#: So many findings at most (about 80 bytes each) are broadcast to the paths; beyond, both are shuffled by blob.
MAX_BROADCAST_FINDINGS = 100_000
#: Fixed patterns: kind, version, pattern, group to measure, least length.
RULES = {
    "assign": (1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (1, r"[0-9a-f]+", 0, 16),
    "pem": (1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 1),
    "jwt": (1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", 0, 30),
    "forge": (1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "chat": (1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
}
FINDING = "struct<start:bigint,rank:int,kind:string,end:bigint>"
_RANK = {k: i for i, k in enumerate(RULES)}
_HEX = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))
_CUES = {
    "assign": lambda b, low: any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")),
    "access": lambda b, low: b"AKIA" in b,
    "hex": lambda b, low: b"x" * 16 in b.translate(_HEX),
    "pem": lambda b, low: b"-----BEGIN " in b,
    "jwt": lambda b, low: b"eyJ" in b,
    "forge": lambda b, low: b"_" in b and b"gh" in b,
    "chat": lambda b, low: b"xox" in b,
}
_COMPILED: dict[str, re.Pattern] = {}


def rule_versions() -> list[str]:
    return [f"{kind}@{RULES[kind][0]}" for kind in RULES]


def scan(content: bytes, versions: list[str]) -> list[dict]:
    """Findings of the rules in one UTF-8 content, by start and rule; offsets are code points."""
    found, low, text = [], content.lower(), None
    for version in versions:
        kind = version.partition("@")[0]
        if not _CUES[kind](content, low):
            continue
        if kind not in _COMPILED:
            _COMPILED[kind] = re.compile(RULES[kind][1], re.ASCII | (re.IGNORECASE if kind == "assign" else 0))
        text = content.decode("utf-8", "replace") if text is None else text
        _, _, group, least = RULES[kind]
        for m in _COMPILED[kind].finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), _RANK[kind], kind, m.end()))
    return [{"start": a, "rank": r, "kind": k, "end": e} for a, r, k, e in sorted(found)]


class BlobLedger:
    """A Parquet table of scans: blob, the rule versions applied, the findings.

    One row is written per scanned blob, findings and versions together, so a
    run that dies leaves the ledger as it was and is simply repeated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        schema = f"blob binary, versions array<string>, findings array<{FINDING}>"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def update(self, versions: DataFrame, rules: list[str] | None = None) -> None:
        """Scan what ``versions`` (path, content) holds and the ledger has not."""
        wanted = F.array(*[F.lit(r) for r in rules or rule_versions()])
        addressed = address(versions)
        seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))
        firsts = addressed.groupBy("blob").agg(F.min("path").alias("first"))
        todo = firsts.join(seen, "blob", "left").select(
            F.col("blob").alias("b"), "first", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")
        )
        todo = todo.where(F.size("todo") > 0)
        one = addressed.join(todo.hint("shuffle_hash"), (F.col("path").eqNullSafe(F.col("first"))) & (F.col("blob") == F.col("b")))

        def run(batches):
            done = set()  # rows that repeat a path and its content meet in one task
            for batch in batches:
                ids = batch.column("blob").to_pylist()
                batch = batch.filter(pa.array([not (b in done or done.add(b)) for b in ids], pa.bool_()))
                blobs, out = batch.column("blob"), []
                for content, todo_ in zip(batch.column("content").cast(pa.binary()).to_pylist(), batch.column("todo").to_pylist()):
                    out.append(scan(content, todo_))
                fields = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([blobs, batch.column("todo"), pa.array(out, fields)], ["blob", "versions", "findings"])

        scanned = one.select("blob", "content", "todo").mapInArrow(run, f"blob binary, versions array<string>, findings array<{FINDING}>")
        scanned.write.mode("append").parquet(self.path)

    def findings(self, rules: list[str] | None = None) -> DataFrame:
        """blob and its distinct findings under the given rule versions, ordered."""
        kinds = [r.partition("@")[0] for r in rules or rule_versions()]
        rows = self.rows().where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f"))
        rows = rows.where(F.col("f.kind").isin(kinds)).distinct()
        return rows.groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("findings"))


def address(versions: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return versions.select("path", content.alias("content"), F.unhex(F.sha2(content, 256)).alias("blob"))


def find_secrets(versions: DataFrame, ledger: BlobLedger, rules: list[str] | None = None) -> DataFrame:
    """path, blob and findings of every row of ``versions`` (path, content), by way of the ledger."""
    ledger.update(versions, rules)
    found = cut(ledger.findings(rules).withColumnRenamed("blob", "b"))
    if (found.agg(F.sum(F.size("findings"))).first()[0] or 0) <= MAX_BROADCAST_FINDINGS:
        found = F.broadcast(found)  # copies of one blob then stay where they are
    paths = address(versions).select("path", "blob")
    return paths.join(found, F.col("blob") == F.col("b"), "left").select("path", "blob", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias("findings"))


def spans_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
