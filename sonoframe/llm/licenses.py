"""License scans: an exact set-similarity join of text blocks with license templates.

For each template a text's words are cut into blocks: a new block every STRIDE words, or every so many words as the
template has if those are more, and each twice as long as that. So a copy of the template lies within one block wherever
it begins. A block holds a template if it has at least `need` of the template's distinct words. The join is exact: words of all templates are ordered by how often
the corpus has them, a template is indexed under the first size - need + 1 of its words in that order (a block that
has none of them can't reach `need`), blocks with fewer than `need` template words are out by length, and a
candidate met at prefix position i is out if the words from i on are too few. What remains is counted.

The corpus is never shuffled: word frequencies are one row per task and word, and the index of the templates, whose
size is checked, goes to the tasks with the code; more templates than that are joined in slices, one pass each.

Phrases are templates all of whose words have to be there; places where they stand consecutively are then counted.

Defined results: null text is empty and has no words; a template with no words holds nowhere; repeated rows are
scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.license_texts import APACHE_2, BSD_3, MIT

STRIDE = 32
#: Words of templates sent to the tasks at once.
INDEX_WORDS = 50_000


@dataclass(frozen=True)
class Template:
    """Words whose share in a block has to reach percent; a phrase's words also have to be consecutive."""

    label: str
    text: str
    percent: int = 80
    phrase: bool = False


# Base phrases and their labels.
PHRASES = (
    Template("mit", "mit license", 100, True),
    Template("apache", "apache license", 100, True),
    Template("gpl", "general public license", 100, True),
)
# Common notices of public licenses.
NOTICES = (
    Template("notice-mit", "released under the mit license", 100),
    Template("notice-apache-2", "licensed under the apache license version 2 0", 100),
    Template("notice-gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("notice-cc-by-nc", "licensed under cc by nc 4 0", 100),
    Template("notice-cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("notice-bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("grant-mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("warranty", "the software is provided as is without warranty of any kind express or implied"),
)
WHOLE = (
    Template("text-mit", MIT),
    Template("text-bsd-3", BSD_3),
    Template("text-apache-2", APACHE_2),
)
TEMPLATES = PHRASES + NOTICES + WHOLE

#: ASCII other than digits and lower-case letters separates words; A-Z is lower-cased.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def _word_counts(words: frozenset[bytes]):
    def run(batches):
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())}
        )

    return run


def word_order(docs: DataFrame, templates: tuple[Template, ...]) -> dict[bytes, int]:
    """Rank of each template word, rarest in the corpus first; documents that hold the word are counted."""
    words = frozenset(w for t in templates for w in words_of(t.text))
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_word_counts(words), "word binary, n long")
    # At most one row per template word.
    total = {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(words, key=lambda w: (total.get(w, 0), w)))}


@dataclass(frozen=True)
class Held:
    """A template as the tasks use it."""

    label: str
    words: frozenset[bytes]
    need: int
    sequence: tuple[bytes, ...]
    phrase: bool

    @property
    def stride(self) -> int:
        return max(STRIDE, len(self.sequence))


def index_of(templates: tuple[Template, ...], order: dict[bytes, int]) -> tuple[list[Held], dict[bytes, list[tuple[int, int]]]]:
    """Templates, and per prefix word (template, position in its ordered words)."""
    held: list[Held] = []
    index: dict[bytes, list[tuple[int, int]]] = {}
    for template in templates:
        sequence = tuple(words_of(template.text))
        ordered = sorted(set(sequence), key=order.__getitem__)
        need = -(-template.percent * len(ordered) // 100)
        for position, word in enumerate(ordered[: len(ordered) - need + 1] if need else ()):
            index.setdefault(word, []).append((len(held), position))
        held.append(Held(template.label, frozenset(ordered), need, sequence, template.phrase))
    return held, index


def _places(words: list[bytes], phrase: tuple[bytes, ...], start: int, stop: int) -> list[int]:
    """Starts in [start, stop) at which the phrase stands."""
    found, at = [], start
    while at < stop:
        try:
            at = words.index(phrase[0], at, stop)
        except ValueError:
            break
        if tuple(words[at : at + len(phrase)]) == phrase:
            found.append(at)
        at += 1
    return found


def matches(words: list[bytes], held: list[Held], index: dict[bytes, list[tuple[int, int]]]) -> dict[int, tuple[float, list[int]]]:
    """Per template found: its best share in a block, and the places if it is a phrase."""
    prefix = index.keys() & set(words)
    if not prefix:
        return {}
    strides = [template.stride for template in held]
    touched: dict[tuple[int, int], dict[int, int]] = {}
    for at, word in enumerate(words):
        if word in prefix:
            for k, position in index[word]:
                # A block is two strides long, so a word lies in at most two of them.
                last = at // strides[k]
                for block in range(max(0, last - 1), last + 1):
                    own = touched.setdefault((strides[k], block), {})
                    own[k] = min(position, own.get(k, position))
    best: dict[int, tuple[float, list[int]]] = {}
    places: dict[int, set[int]] = {}
    for (stride, block), candidates in touched.items():
        start = block * stride
        block_words = set(words[start : start + 2 * stride])
        for k, position in candidates.items():
            template = held[k]
            if len(block_words) < template.need or len(template.words) - position < template.need:
                continue
            common = len(template.words & block_words)
            if common < template.need:
                continue
            share = common / len(template.words)
            if template.phrase:
                stop = min(start + 2 * stride - len(template.sequence) + 1, len(words))
                places.setdefault(k, set()).update(_places(words, template.sequence, start, stop))
                if not places[k]:
                    continue
            best[k] = (max(share, best.get(k, (0.0, []))[0]), [])
    return {k: (share, sorted(places.get(k, ()))) for k, (share, _) in best.items()}


SCHEMA = "doc_id long, n_words long, score double, found array<struct<label:string,phrase:boolean,score:double,places:array<long>>>"


def _scan(held: list[Held], index: dict[bytes, list[tuple[int, int]]]):
    kinds = pa.struct(
        [("label", pa.string()), ("phrase", pa.bool_()), ("score", pa.float64()), ("places", pa.list_(pa.int64()))]
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, scores, found = [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    hits = matches(words, held, index)
                    counts.append(len(words))
                    scores.append(max((s for s, _ in hits.values()), default=0.0))
                    found.append(
                        [
                            {"label": held[k].label, "phrase": held[k].phrase, "score": s, "places": p}
                            for k, (s, p) in sorted(hits.items())
                        ]
                    )
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "n_words": pa.array(counts, pa.int64()),
                        "score": pa.array(scores, pa.float64()),
                        "found": pa.array(found, pa.list_(kinds)),
                    }
                )

    return run


def _slices(templates: tuple[Template, ...]) -> list[tuple[Template, ...]]:
    """Runs of templates with at most INDEX_WORDS words each."""
    out: list[list[Template]] = [[]]
    size = 0
    for template in templates:
        size += len(re.findall(r"\S+", template.text))
        if size > INDEX_WORDS and out[-1]:
            out.append([])
            size = 0
        out[-1].append(template)
    return [tuple(s) for s in out]


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """SCHEMA, one row per document and slice of the templates."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = word_order(docs, templates)
    scans = [rows.mapInArrow(_scan(*index_of(part, order)), SCHEMA) for part in _slices(templates)]
    return reduce(DataFrame.unionByName, scans)
