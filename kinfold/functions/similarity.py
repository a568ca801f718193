"""String similarities: trigram Jaccard in the engine; Indel ratios, token sets and common substrings
in Arrow batches, computed once per distinct pair of strings of a batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from kinfold.functions import canonical
from kinfold.functions.dictionaries import LOCALITY_SYNONYMS


def trigrams(c: Column) -> Column:
    """Distinct character trigrams, blanks included; none for texts under three characters."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard_trigram(a: Column, b: Column) -> Column:
    """Shared over all trigrams; 1 if neither text has any, 0 if one has none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & masks.get(c, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_a or not only_b):
        return 100.0
    base, da, db = " ".join(both), " ".join(only_a), " ".join(only_b)
    ab, ba = f"{base} {da}".strip(), f"{base} {db}".strip()
    best = ratio(ab, ba) if base else ratio(da, db)
    return max(best, ratio(base, ab), ratio(base, ba)) if base else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer one, ends included."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 0.0
    windows = [b[i : i + n] for i in range(len(b) - n + 1)]
    windows += [b[:i] for i in range(1, n)] + [b[-i:] for i in range(1, n)]
    return max(ratio(a, w) for w in windows)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the ratios, weighed by how unequal the lengths are; 0 if a text is empty."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    base = ratio(a, b)
    if lengths < 1.5:
        return max(base, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8.0 else 0.6
    return max(base, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def lcs_ratio(a: str, b: str) -> float:
    """Longest common substring over the longer length; 0 if a text is empty."""
    if not a or not b:
        return 0.0
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else 0
            best = max(best, row[j])
    return best / max(len(a), len(b))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits_a = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits_a.append(x)
                break
    m = len(hits_a)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits_a, (y for y, u in zip(b, used) if u))) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def _pairwise(fn, scale: float = 1.0):
    @pandas_udf(DoubleType())
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple, float | None] = {}
        out = []
        for p in zip(a, b):
            if p not in seen:
                seen[p] = None if not isinstance(p[0], str) or not isinstance(p[1], str) else fn(*p) / scale
            out.append(seen[p])
        return pd.Series(out, dtype="float64")

    return over


weighted_ratio_udf = _pairwise(weighted_ratio, 100.0)
token_set_ratio_udf = _pairwise(token_set_ratio, 100.0)
lcs_ratio_udf = _pairwise(lcs_ratio)
jaro_winkler_udf = _pairwise(jaro_winkler)


@pandas_udf(StringType())
def _nearest_locality(texts: pd.Series) -> pd.Series:
    names = [name for name, _ in LOCALITY_SYNONYMS]

    def best(text: str | None) -> str | None:
        scores = [token_set_ratio(text, n) for n in names] if text else [0.0]
        return names[scores.index(max(scores))] if max(scores) >= 80.0 else None

    return texts.map(best)


def resolve_localities(frame: DataFrame, column: str) -> DataFrame:
    """Adds `<column>_canonical`: by synonym or beginning, else the reference name whose word set is at
    least 80 % alike. The slow step sees each distinct text that the others leave open once."""
    quick = frame.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_c", canonical.locality_canonical(F.col(column)))
    text = F.trim(F.regexp_replace(F.lower(F.col(column)), r"[^a-z0-9\s]", " "))
    near = quick.where("_c IS NULL").withColumn("_c", _nearest_locality(text))
    known = quick.where("_c IS NOT NULL").unionByName(near).withColumnRenamed("_c", f"{column}_canonical")
    return frame.join(known, column, "left")
