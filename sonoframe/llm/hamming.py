"""Exact top-k search on 64-bit codes by incremental multi-index hashing.

A code is cut into segments and indexed once per segment. A query probes every segment with all values at Hamming
distance 0, then 1, and so on. After radius r in all m segments every code within m * (r + 1) - 1 has been met, so
a query is done when its kth verified distance is within that. A pair is verified where it is met first: in the
segment and at the radius of its least segment distance, so no pair is produced twice; pairs beyond the query's kth
distance so far are dropped inside the join.

Equal codes are one entry of the index and one query; only the k + 1 least ids of a code can be in an answer (one of
them may be the query itself), so a code that a third of all rows share costs no more than any other. Segments
have at most MOST_BITS bits, so a query has at most 2 ** MOST_BITS probes a segment.

Defined results: rows with a null vector have no code and are left out; a null or missing component is a 0 bit;
a vector of more than 64
components is an error, since a code of its first ones would make the search inexact; ties are taken by least id; fewer than k other rows give fewer neighbours; rows
that share an id count as one if their codes are equal; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import partitions, scratch, settle, small

BITS, MOST_BITS = 64, 16


def sign_codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, code: bit i is set if component i is positive."""
    wide = f"size({vector_column}) > {BITS}"
    bits = f"aggregate(transform({vector_column}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    code = F.expr(f"if({wide}, raise_error('a vector has more than {BITS} components'), {bits})")
    return vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), code.alias("code"))


def segments(rows: int) -> list[tuple[int, int]]:
    """(offset, bits) of each segment; about log2(rows) bits, which balances probes and entries met."""
    wanted = min(MOST_BITS, max(4, math.floor(math.log2(max(rows, 2)))))
    count = -(-BITS // wanted)
    ends = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _part(code: str, segment: tuple[int, int]) -> str:
    return f"(shiftrightunsigned({code}, {segment[0]}) & {(1 << segment[1]) - 1}L)"


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(bits), radius)]


class MultiIndex:
    """The index of one table of (id, code)."""

    def __init__(self, codes: DataFrame, k: int) -> None:
        self.k = k
        self.rows = settle(codes.distinct(), "codes")
        rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
        # The limit on the rank is applied in each task before the shuffle.
        self.ids = settle(self.rows.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r"), "code-ids")
        distinct = settle(self.rows.select("code").distinct(), "codes-distinct")
        self.segments = segments(distinct.count())
        listed = ", ".join(f"struct({j} as segment, {_part('code', s)} as value)" for j, s in enumerate(self.segments))
        index = settle(distinct.select("code", F.expr(f"inline(array({listed}))")), "code-index")
        # Probes outnumber their queries by far, so they are never the side that is held.
        self.index = small(index.hint("shuffle_hash"))

    def _probes(self, active: DataFrame, radius: int) -> DataFrame:
        """query, bound, segment, value: all values at this distance in each segment."""
        active = active.repartition(partitions(active.sparkSession), "query")
        parts = []
        for j, segment in enumerate(self.segments):
            masks = _masks(segment[1], radius)
            if masks:
                flips = f"explode(transform(array({', '.join(f'{m}L' for m in masks)}), m -> {_part('query', segment)} ^ m))"
                parts.append(active.select("query", "bound", F.lit(j).alias("segment"), F.expr(flips).alias("value")))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found

    def _met(self, active: DataFrame, radius: int) -> DataFrame:
        """query, code, distance of pairs met first at this radius and within the query's bound."""
        apart = [f"bit_count({_part('query', s)} ^ {_part('code', s)})" for s in self.segments]
        first = " OR ".join(
            f"(p.segment = {j}" + "".join(f" AND {d} {'>' if i < j else '>='} {radius}" for i, d in enumerate(apart) if i != j) + ")"
            for j in range(len(apart))
        )
        probes, index = self._probes(active, radius).alias("p"), self.index.alias("x")
        return probes.join(
            index,
            F.expr(f"p.segment = x.segment AND p.value = x.value AND bit_count(query ^ code) <= bound AND ({first})"),
        ).select("query", "code", F.expr("bit_count(query ^ code)").alias("distance"))

    def search(self, codes: DataFrame) -> DataFrame:
        """query, id, distance: at least the k + 1 nearest ids of each distinct query code, ties by least id."""
        wanted = self.k + 1
        best_of = Window.partitionBy("query").orderBy("distance", "id")
        queries = settle(codes.select(F.col("code").alias("query")).distinct(), "query-codes")
        active = queries.withColumn("bound", F.lit(BITS))
        best = None
        done: list[DataFrame] = []
        widest = max(bits for _, bits in self.segments)
        for radius in range(widest + 1):
            found = self._met(active, radius).join(self.ids, "code").select("query", "id", "distance")
            if best is not None:
                found = found.unionByName(best)
            ranked = found.withColumn("r", F.row_number().over(best_of)).where(F.col("r") <= wanted)
            ranked = settle(ranked, f"nearest-{radius}")
            reached = ranked.where(F.col("r") == wanted).select("query", F.col("distance").alias("kth"))
            covered = len(self.segments) * (radius + 1) - 1
            state = settle(
                active.join(reached, "query", "left").select(
                    "query",
                    F.coalesce("kth", "bound").alias("bound"),
                    (F.coalesce(F.col("kth") <= covered, F.lit(False)) | F.lit(radius == widest)).alias("over"),
                ),
                f"state-{radius}",
            )
            ranked = ranked.drop("r")
            done.append(ranked.join(state.where("over"), "query", "left_semi"))
            active = state.where("not over").drop("over")
            if active.isEmpty():
                break
            best = ranked.join(active, "query", "left_semi")
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return out


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k nearest other ids of every query (id, code)."""
    with scratch(codes.sparkSession) as keep:
        index = MultiIndex(codes, k)
        found = index.search(queries)
        own = queries.distinct().select(F.col("id").alias("query_id"), F.col("code").alias("query"))
        rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "id"))
        ranked = (
            own.join(found, "query")
            .where(~F.col("query_id").eqNullSafe(F.col("id")))
            .withColumn("rank", rank.cast("long"))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("neighbour_id"), F.col("distance").cast("long").alias("distance"))
        )
        return keep(settle(ranked, "top-k"))
