"""Spelling variants: words one edit apart, found through a reduced alphabet.

Each letter is hashed to one of a few symbols, so a word becomes a reduced word of its length. Words that differ by one
inserted, deleted or replaced letter have reduced words that are equal or differ by one such edit. So every word
generates the full one-edit neighbourhood of its reduced word: over a few symbols that is short, a few letters' worth of
keys a position instead of an alphabet's. The neighbourhoods are joined with the vocabulary under its reduced words,
and the pairs that meet are verified on the original words.

Keys are 64-bit polynomial hashes, so that an edit's key follows from the hashes of what stands before and after it and
a word costs a fixed amount per letter. A bit table of fixed size over the keys of the vocabulary drops the keys of
neighbourhoods that nothing can meet before they are shuffled. Keys that collide and crowded bits cost time and
never results.

Defined results: a null or empty text has no words; a null doc_id counts as the empty string where ids are hashed;
repeated rows count each; an empty table gives no rows; other columns are ignored. Words may be of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import scratch, settle

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: A word needs so many code points and occurrences; a form so many times the occurrences of its variant.
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10
#: Runs of letters, of which one in PLANTED loses a code point.
LETTERS, PLANTED = "A-Za-zÀ-ÿ", 31
#: Bits of the table of keys, parts it is summed in, and parts added up by one task at a time.
BITS, SLICES, FAN_IN = 1 << 26, 64, 64
#: Keys made at a time.
KEYS_AT_ONCE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SYMBOL = np.random.default_rng(12).integers(1, 1 << 63, SYMBOLS, np.uint64) | np.uint64(1)


def corpus_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words that are long and frequent enough, after planted deletions.

    Only A-Z are lower-cased. The unsigned crc32 of `<doc_id>:<run>` decides whether the run loses a code point.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = found.select("doc", F.translate("run", upper, lower).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % PLANTED == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _powers(base: int, count: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(count, base, np.uint64))))


def _scans(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length, a row each: hashes of what stands before each place and from it on; the base's powers."""
    count, length = symbols.shape
    powers = _powers(_BASE, length + 1)
    none = np.zeros((count, 1), np.uint64)
    weighted = np.cumsum((symbols * powers[:length][::-1])[:, ::-1], axis=1)[:, ::-1]
    after = np.concatenate((weighted, none), axis=1)
    # What stands before a place has the weight of what follows it; the base is odd, so it has an inverse.
    back = _powers(pow(_BASE, -1, 1 << 64), length)[::-1]
    return (after[:, :1] - after) * back, after, powers


def _reduced(words: list[str]) -> np.ndarray:
    """Symbol values of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    return _SYMBOL[points % SYMBOLS]


def own_keys(words: list[str]) -> np.ndarray:
    """Keys of the reduced words themselves; all words have one length."""
    _, after, _ = _scans(_reduced(words))
    return after[:, 0]


def neighbour_keys(words: list[str]) -> np.ndarray:
    """Keys of the one-edit neighbourhoods of the reduced words, a sorted row each; a row may repeat a key."""
    symbols = _reduced(words)
    length = symbols.shape[1]
    before, after, powers = _scans(symbols)
    head, tail = before[:, :length], after[:, 1:]
    rest, longer = powers[:length][::-1], powers[: length + 1][::-1]
    made = [before[:, -1:], head * rest + tail]
    for symbol in _SYMBOL:
        made.append(head * powers[1 : length + 1][::-1] + symbol * rest + tail)
        made.append(before * powers[1 : length + 2][::-1] + symbol * longer + after)
    keys = np.concatenate(made, axis=1)
    keys.sort(axis=1)
    return keys


def _by_length(words: list[str], keys_per_letter: int) -> Iterator[list[int]]:
    """Places of words of one length, few enough for their keys to be made at a time."""
    places: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        places.setdefault(len(word), []).append(k)
    for length, own in sorted(places.items()):
        step = max(1, KEYS_AT_ONCE // (length * keys_per_letter))
        for at in range(0, len(own), step):
            yield own[at : at + step]


def _key_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        keys = np.empty(len(words), np.uint64)
        for own in _by_length(words, 1):
            keys[own] = own_keys([words[k] for k in own])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], [*batch.schema.names, "key"])


def _bit_places(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)


def _table_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(BITS // 8, np.uint8)
    some = False
    for batch in batches:
        keys = batch.column(0).to_numpy().view(np.uint64)
        places = _bit_places(keys)
        np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))
        some |= len(keys) > 0
    if some:
        parts = [zlib.compress(p.tobytes(), 1) for p in table.reshape(SLICES, -1)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * SLICES, pa.int64()), pa.array(range(SLICES), pa.int64()), pa.array(parts, pa.binary())],
            ["task", "slice", "bits"],
        )


def _joined(key, parts):
    total = np.zeros(BITS // 8 // SLICES, np.uint8)
    for part in parts["bits"]:
        total |= np.frombuffer(zlib.decompress(part), np.uint8)
    return pd.DataFrame({"task": [key[1]], "slice": [key[0]], "bits": [zlib.compress(total.tobytes(), 1)]})


def key_table(keyed: DataFrame) -> np.ndarray:
    """The bit table of all keys; its size does not depend on how many there are."""
    schema = "task long, slice long, bits binary"
    parts = keyed.select("key").mapInArrow(_table_worker, schema)
    tasks = parts.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.groupBy("slice", F.floor(F.col("task") / FAN_IN).alias("task")).applyInPandas(_joined, schema)
        if tasks <= 1:
            break
    table = np.zeros((SLICES, BITS // 8 // SLICES), np.uint8)
    # SLICES rows of fixed size.
    for row in parts.collect():
        table[row["slice"]] |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return table.ravel()


def _neighbour_worker(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            for own in _by_length(words, 2 * SYMBOLS + 1):
                keys = neighbour_keys([words[k] for k in own])
                places = _bit_places(keys)
                open_ = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
                open_[:, 1:] &= keys[:, 1:] != keys[:, :-1]
                row, column = np.nonzero(open_)
                at = pa.array(np.array(own)[row])
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in batch.columns), pa.array(keys[row, column].view(np.int64))], [*batch.schema.names, "key"]
                )

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n for every ordered pair of words (word, n) that are one edit apart."""
    schema = "word string, n long, key long"
    keyed = settle(words.select("word", "n").mapInArrow(_key_worker, schema), "spelling-keys")
    table = words.sparkSession.sparkContext.broadcast(key_table(keyed))
    sides = keyed.select("word", "n").mapInArrow(_neighbour_worker(table), schema).select("word", "key")
    other = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    apart = F.abs(F.length("word") - F.length("near"))
    met = sides.join(other, "key").where((F.col("word") != F.col("near")) & (apart <= 1))
    # A word's keys are distinct and the other word has one, so a pair is met once.
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of all words with a form, by pointer jumping.

    A form is TIMES as frequent as its variant, so chains are short and never return.
    """
    roots = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = settle(
            roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of each of words (word, n).

    The form is the most frequent near word, the smaller in code-point order of equals, if it is frequent enough.
    """
    best: Column = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    with scratch(words.sparkSession) as keep:
        words = settle(words, "spelling-words")
        near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        joined = words.join(near, "word", "left")
        enough = -F.col("best.n") >= times * F.col("n")
        formed = settle(
            joined.select(
                "word",
                "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(enough, F.col("best.word")).alias("form"),
                F.when(enough, -F.col("best.n")).alias("form_n"),
            ),
            "spelling-forms",
        )
        roots = _roots(formed.where("form is not null"))
        return keep(settle(formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling-variants"))
