"""Text normalisation, tokens and edit alignment."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation; Spark has no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


# Token shapes and placeholders of the scoring rules.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
# Repeats are possessive, which changes no match but keeps the engine's stack flat on words of any length.
WORD = r"[A-Za-z0-9]++(?:['’-][A-Za-z0-9]++)*+"
LANGUAGE_TAG = r"(?U)@[A-Za-z]+\b"
SILENCED = r"(?i)(?<![A-Za-z0-9])xxx(?![A-Za-z0-9])"
ANNOTATION_TOKEN = r"&[A-Za-z]+[0-9]+"
UNKNOWN_TOKEN = r"(?i)(?<![A-Za-z])xxx(?![A-Za-z])"
FILLERS = {
    "english": ["um", "uh", "er", "erm", "hmm", "like", "you know"],
    "chinese": ["呃", "嗯", "啊", "那个", "那個", "就是", "这个", "這個"],
}
REPEATED_WORD = r"(?iU)\b([a-zA-Z']+)\b([\s,.’‘-]{1,3})\1\b"


def mixed_tokens(text: Column) -> Column:
    """One token per Han character or Latin/digit span, lower case; everything else separates."""
    clean = F.regexp_replace(nfkc(text), LANGUAGE_TAG, "")
    clean = F.regexp_replace(clean, SILENCED, "")
    tokens = F.regexp_extract_all(clean, F.lit(f"(?:{WORD})|[{HAN}]"), F.lit(0))
    return F.transform(tokens, F.lower)


def character_key(text: Column) -> Column:
    """Characters only: no annotation tokens, placeholders, pauses, punctuation or spaces; casefolded."""
    clean = F.regexp_replace(nfkc(text), ANNOTATION_TOKEN, "")
    clean = F.regexp_replace(clean, UNKNOWN_TOKEN, "")
    return casefold(F.regexp_replace(clean, r"(?U)[\p{P}\s#]", ""))


def stripped_key(text: Column) -> Column:
    """Lower case without punctuation and white space."""
    return F.lower(F.regexp_replace(text, r"(?U)[\p{P}\s]", ""))


def script_language(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), "Chinese").otherwise("English")


def sanitized_id(value: Column) -> Column:
    clean = F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "-")
    clean = F.regexp_replace(clean, r"^[-.]+|[-.]+$", "")
    return F.when(F.length(clean) > 0, clean).otherwise("benchmark")


def speaker_or_null(speaker: Column) -> Column:
    return F.nullif(speaker, F.lit("N/A"))


def filler_count(text: Column, token: str) -> Column:
    """Whole-word and case-blind for Latin tokens, plain substring for the others."""
    if token.isascii():
        return F.regexp_count(text, F.lit(rf"(?iU)\b{token}\b"))
    removed = F.length(F.replace(text, F.lit(token), F.lit("")))
    return ((F.length(text) - removed) / len(token)).cast("int")


def repetitions(text: Column) -> Column:
    """Immediately repeated Latin words, as the matched spans."""
    return F.regexp_extract_all(text, F.lit(REPEATED_WORD), F.lit(0))


EDIT_COUNTS = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("distance", "deletions", "insertions", "substitutions")
    ]
)


# Below this many cells the plain loop beats the vector set-up.
SMALL_TABLE = 2500


def edit_counts_of(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[int, int, int]:
    """(distance, deletions, insertions) of the cheapest alignment.

    Equal tokens take the diagonal; otherwise the cheapest of deletion, insertion, substitution in that
    order. Memory is linear in the text length.
    """
    n, m = len(reference), len(hypothesis)
    if not n or not m:
        return (n or m, n, m)
    if n * m <= SMALL_TABLE:
        return _edit_rows(reference, hypothesis)
    return _edit_diagonals(reference, hypothesis)


def _edit_rows(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[int, int, int]:
    above = [(j, 0, j) for j in range(len(hypothesis) + 1)]
    for i, token in enumerate(reference, 1):
        left = (i, i, 0)
        row = [left]
        for j, other in enumerate(hypothesis, 1):
            corner = above[j - 1]
            if token == other:
                left = corner
            else:
                up = above[j]
                least = min(up[0], left[0], corner[0])
                if up[0] == least:
                    left = (least + 1, up[1] + 1, up[2])
                elif left[0] == least:
                    left = (least + 1, left[1], left[2] + 1)
                else:
                    left = (least + 1, corner[1], corner[2])
            row.append(left)
        above = row
    return above[-1]


def _edit_diagonals(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[int, int, int]:
    """The same table one anti-diagonal at a time, so long texts run as vector operations."""
    n, m = len(reference), len(hypothesis)
    codes: dict[str, int] = {}
    ref = np.array([codes.setdefault(t, len(codes)) for t in reference])
    hyp = np.array([codes.setdefault(t, len(codes)) for t in hypothesis])[::-1]
    # Cell (i, j) of diagonal i + j is stored at index i; rows are (distance, deletions, insertions).
    older = np.zeros((3, n + 1), dtype=np.int64)
    newer = np.zeros((3, n + 1), dtype=np.int64)
    for diagonal in range(1, n + m + 1):
        current = np.zeros((3, n + 1), dtype=np.int64)
        low, high = max(1, diagonal - m), min(n, diagonal - 1)
        if diagonal <= m:
            current[:, 0] = (diagonal, 0, diagonal)
        if diagonal <= n:
            current[:, diagonal] = (diagonal, diagonal, 0)
        if low <= high:
            up, left, corner = newer[:, low - 1 : high], newer[:, low : high + 1], older[:, low - 1 : high]
            equal = ref[low - 1 : high] == hyp[m - diagonal + low : m - diagonal + high + 1]
            deletes = ~equal & (up[0] <= left[0]) & (up[0] <= corner[0])
            inserts = ~equal & ~deletes & (left[0] <= corner[0])
            cell = np.where(deletes, up, np.where(inserts, left, corner))
            cell[0] += ~equal
            cell[1] += deletes
            cell[2] += inserts
            current[:, low : high + 1] = cell
        older, newer = newer, current
    return tuple(int(v) for v in newer[:, n])


@pandas_udf(EDIT_COUNTS)
def edit_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = []
    for ref, hyp in zip(reference, hypothesis):
        distance, deletions, insertions = edit_counts_of(
            [] if ref is None else list(ref), [] if hyp is None else list(hyp)
        )
        rows.append((distance, deletions, insertions, distance - deletions - insertions))
    return pd.DataFrame(rows, columns=["distance", "deletions", "insertions", "substitutions"])


def error_rate(distance: Column, reference_tokens: Column) -> Column:
    return distance / F.nullif(reference_tokens, F.lit(0))
