"""Scalar functions that Spark lacks, as column expressions where possible."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def natural_key(c: Column, width: int = 12) -> Column:
    """Sort key in which runs of digits compare as numbers of up to ``width`` digits."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


def z_order(x: Column, y: Column, bits: int = 16) -> Column:
    """Morton code of two non-negative integers."""

    def spread(v: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", v.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), i * 2)))

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def geohash(lat: Column, lon: Column, length: int = 8) -> Column:
    """Standard base-32 geohash."""
    alphabet = "0123456789bcdefghjkmnpqrstuvwxyz"
    n = length * 5
    x = F.floor((lon + 180) / 360 * (1 << ((n + 1) // 2))).cast("long")
    y = F.floor((lat + 90) / 180 * (1 << (n // 2))).cast("long")
    bits = []
    for i in range(n):
        src, k = (x, (n + 1) // 2 - 1 - i // 2) if i % 2 == 0 else (y, n // 2 - 1 - i // 2)
        bits.append(F.shiftright(src, k).bitwiseAND(1))
    chars = []
    for i in range(0, n, 5):
        v = sum((bits[i + j] * (1 << (4 - j)) for j in range(1, 5)), bits[i] * 16)
        chars.append(F.substring(F.lit(alphabet), v.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def jaro_winkler_of(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken) if t]
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(hits, other)) / 2) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * scale * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_of(p, q) for p, q in zip(x, y)])

    return of(a, b)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of character trigrams; the measure of ``SIMILAR TO``."""

    def grams(c: Column) -> Column:
        p = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))

    x, y = grams(a), grams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def json_pointer(text: Column, pointer: str) -> Column:
    """The value at a JSON pointer (RFC 6901): ``~1`` is a slash and ``~0`` a tilde; a number is an array's index, else a key; null where nothing is there."""
    if pointer == "":
        return text
    if pointer[0] != "/":
        raise ValueError("a JSON pointer starts with /")
    paths = ["$"]
    for part in pointer[1:].split("/"):
        key = part.replace("~1", "/").replace("~0", "~")
        forms = ([f"[{key}]"] if key == "0" or key.isdigit() and key[0] != "0" else []) + [f"['{key}']"]
        paths = [p + f for p in paths for f in forms]
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])
