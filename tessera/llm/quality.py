"""Quality rules with adaptive thresholds (DataFrame functions only).

Each text is measured inside its row. Per language and source a mergeable
quantile sketch is kept of every measure: a histogram over logarithmic integer
buckets (sixteen per power of two, so a quantile is off by a sixteenth at
most). Sketches add up, so a group with few texts falls back on its language's
sum, and that on the sum of all. Fences at quartile plus or minus
``FENCE * max(spread, least spread)`` replace fixed cutoffs and are joined to
the measures. In ordinary texts most have no repeat at all, so quartiles and
spread are 0 and the fence would be a tighter cutoff than the base rule; those
fences are held at ``LEAST_FENCE`` or above.

Defined cases: null text counts as empty and so fails (fewer than ten words);
null language or source is a group of its own; repeated rows are judged each;
an empty table gives an empty result; very long texts are measured whole, in
one row; a value on a fence is kept; ``filter_quality`` keeps all columns, also
those named like measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SEPARATOR, cut, scratch, text_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
#: A group of fewer texts is judged by the merged sketch above it.
MIN_GROUP = 100
FENCE = 3
#: The mean word length of shorter texts is too noisy to judge.
LENGTH_MIN_WORDS = 50
#: measure -> least spread in its own unit; lower fences only for word length.
LEAST_SPREAD = {"symbol": 50, "dup_line": 100, "repeat": 30, "length": 50}
#: Least upper fences (per mille): the base rule's share of repeated words, and half the lines.
LEAST_FENCE = {"repeat": MAX_REPEAT_PERCENT * 10, "dup_line": 500}
#: Thresholds are broadcast up to so many rows; beyond, a plain join is used.
MAX_BROADCAST_ROWS = 20_000
#: Keys (16 bytes) of rejected rows are broadcast up to so many.
MAX_BROADCAST_REJECTED = 500_000


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` plus one struct column ``_m`` with the measures of its text.

    Repeated words are exact: a text whose window hashes are all distinct has
    no repeated window; only the others sort their windows as strings.
    """
    n = F.size("_words")
    hashed = docs.withColumn("_text", text_of()).withColumn("_words", F.filter(F.split("_text", SEPARATOR), lambda w: w != ""))
    hashed = hashed.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = hashed.withColumn("_hashes", F.transform(places, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])))
    hashed = hashed.withColumn("_again", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.slice("_words", i + 1, WINDOW)).alias("w"), i.alias("p")))
    none = F.array().cast("array<struct<w:string,p:int>>")
    ordered = hashed.withColumn("_sorted", F.when(F.col("_again"), F.array_sort(windows)).otherwise(none))
    twice = F.filter(
        "_sorted",
        lambda x, i: (F.get(F.col("_sorted"), i - 1)["w"] == x["w"]) | F.coalesce(F.get(F.col("_sorted"), i + 1)["w"] == x["w"], F.lit(False)),
    )
    ordered = ordered.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    steps = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(WINDOW))))
    values = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SEPARATOR, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        # not deterministic, so the optimiser neither pushes filters below this projection nor repeats it in them
        F.monotonically_increasing_id().alias("guard"),
    )
    return ordered.select(*docs.columns, values.alias("_m"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def ratios(m: Column) -> dict[str, Column]:
    """Measures that have a fence, as whole numbers: per mille, and word length in hundredths."""

    def share(a: str, b: str, unit: int) -> Column:
        return F.floor(m[a] * unit / F.greatest(m[b], F.lit(1))).cast("long")

    return {
        "symbol": share("n_symbols", "n_words", 1000),
        "dup_line": share("n_dup_lines", "n_lines", 1000),
        "repeat": share("n_repeat_words", "n_words", 1000),
        "length": share("word_chars", "n_words", 100),
    }


def bucket(v: Column) -> Column:
    """Logarithmic bucket of a whole number: exact below 32, then sixteen per power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (shift * 16 + F.floor(v / F.pow(F.lit(2), shift))).cast("int")


def bucket_top(b: Column) -> Column:
    """Largest whole number of a bucket."""
    shift = F.greatest(F.floor(b / 16) - 1, F.lit(0))
    return ((b - shift * 16 + 1) * F.pow(F.lit(2), shift) - 1).cast("long")


def sketch(measured: DataFrame) -> DataFrame:
    """Histogram rows (lang, source, name, b, c) of texts that pass the base rules."""
    m = F.col("_m")
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), bucket(v).alias("b")) for k, v in ratios(m).items()])).alias("x")
    rows = measured.where(~base_failed(m)).select("lang", "source", items)
    return rows.groupBy("lang", "source", F.col("x.name").alias("name"), F.col("x.b").alias("b")).agg(F.count("*").alias("c"))


def quartiles(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """n, q1 and q3 for each of ``keys`` and name, from a histogram."""
    per = Window.partitionBy(*keys, "name")
    upto = histogram.withColumn("n", F.sum("c").over(per)).withColumn("cum", F.sum("c").over(per.orderBy("b")))
    top = bucket_top(F.col("b"))
    return upto.groupBy(*keys, "name", "n").agg(
        F.min(F.when(F.col("cum") * 4 >= F.col("n"), top)).alias("q1"),
        F.min(F.when(F.col("cum") * 4 >= F.col("n") * 3, top)).alias("q3"),
    )


def thresholds(histogram: DataFrame) -> DataFrame:
    """One row per (lang, source): columns lo and hi per measure, by the finest level with enough texts.

    No upper fence is below its measure's ``LEAST_FENCE``.
    """
    by_lang = histogram.groupBy("lang", "name", "b").agg(F.sum("c").alias("c"))
    by_all = by_lang.groupBy("name", "b").agg(F.sum("c").alias("c"))
    fine = quartiles(histogram, ["lang", "source"]).alias("f")
    mid = quartiles(by_lang, ["lang"]).alias("l")
    whole = quartiles(by_all, []).alias("g")
    joined = fine.join(mid, F.expr("f.lang <=> l.lang and f.name = l.name")).join(whole, F.expr("f.name = g.name"))

    def pick(q: str) -> Column:
        return F.when(F.col("f.n") >= MIN_GROUP, F.col(f"f.{q}")).when(F.col("l.n") >= MIN_GROUP, F.col(f"l.{q}")).otherwise(F.col(f"g.{q}"))

    least = F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv])
    q = joined.select("f.lang", "f.source", "f.name", pick("q1").alias("q1"), pick("q3").alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), least[F.col("name")]) * FENCE
    q = q.select("lang", "source", "name", (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))
    for name, least_hi in LEAST_FENCE.items():
        q = q.withColumn("hi", F.when(F.col("name") == name, F.greatest("hi", F.lit(least_hi))).otherwise(F.col("hi")))
    cells = [F.max(F.when(F.col("name") == k, F.col(side))).alias(f"{side}_{k}") for k in LEAST_SPREAD for side in ("lo", "hi")]
    return q.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*cells)


def judged(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` with booleans ``_base`` and ``_kept``.

    A group without a fence holds only texts that fail the base rules.
    """
    if fences.count() <= MAX_BROADCAST_ROWS:
        fences = F.broadcast(fences)
    joined = measured.join(fences, F.expr("lang <=> _lang and source <=> _source"), "left")
    m = F.col("_m")
    r = ratios(m)
    odd = (r["symbol"] > F.col("hi_symbol")) | (r["dup_line"] > F.col("hi_dup_line")) | (r["repeat"] > F.col("hi_repeat"))
    odd = odd | ((m["n_words"] >= LENGTH_MIN_WORDS) & ((r["length"] > F.col("hi_length")) | (r["length"] < F.col("lo_length"))))
    base = base_failed(m)
    return joined.select(*measured.columns, base.alias("_base"), (~base & ~F.coalesce(odd, F.lit(False))).alias("_kept"))


def _judged_rows(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but for its text, measures and verdicts; each text is measured once."""
    measured = cut(measure(docs).drop("text"))
    return judged(measured, cut(thresholds(sketch(measured))))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures, base_failed and kept, a row for each row of ``docs``."""
    with scratch(docs.sparkSession):
        out = _judged_rows(docs.select("doc_id", "lang", "source", "text"))
        return cut(out.select("doc_id", "lang", "source", *[f"_m.{x}" for x in MEASURES], F.col("_base").alias("base_failed"), F.col("_kept").alias("kept")), keep=True)


def _row_key(docs: DataFrame) -> list[Column]:
    """128 bits of all that a verdict depends on, and the id."""
    parts = [docs[c] for c in ("doc_id", "lang", "source", "text")]
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(1), *parts[::-1]).alias("_k2")]


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns.

    Equal rows have equal verdicts, so the rejected keys are joined back by a
    hash of the row. Up to ``MAX_BROADCAST_REJECTED`` they are broadcast and no
    text is shuffled; beyond, both sides are.
    """
    with scratch(docs.sparkSession):
        out = _judged_rows(docs.select(*_row_key(docs), "lang", "source", "text"))
        rejected = cut(out.where("not _kept").select("_k1", "_k2").distinct(), keep=True)
    rejected = F.broadcast(rejected) if rejected.count() <= MAX_BROADCAST_REJECTED else rejected
    k1, k2 = _row_key(docs)
    return docs.join(rejected, (k1 == rejected["_k1"]) & (k2 == rejected["_k2"]), "left_anti")
