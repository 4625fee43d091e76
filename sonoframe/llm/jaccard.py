"""N-gram Jaccard join by grouped prefixes, returning the components that the links make.

Shingles of all texts are hashed to 64 bits and ordered by (frequency class, hash). A document's prefix is so many of
its first shingles that two documents whose sets reach the similarity must share one. The steps:

1. Documents with equal sets become one member; copies never meet each other again.
2. Members with equal shared prefixes and sizes become one group. Groups meet on prefix shingles within neighbouring
   size classes.
3. First each member is tried against one pivot, the text that its group shares most prefix shingles with among the
   most typical ones, then against its group's first member. What that links becomes components, so that a large
   group of near copies costs few comparisons a member.
4. Then all remaining pairs of groups in different components are taken, filtered by size and by how many prefix
   shingles they share, expanded to members and verified on their whole sets. Pairs within a component can add
   nothing and are left out; no other pair is.

Defined results: a null text is empty; an empty text has no shingles and links with nothing; rows that share a doc_id
are one document for linking; a row without doc_id is counted but links with nothing and has no component; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import scratch, settle, small
from sonoframe.llm.components import components
from sonoframe.llm.shingles import frequency_classes, kept_words, ordered_keys, shingle_set

SHINGLE, SIMILARITY = 5, (80, 100)
#: Members verified with a pivot in one task.
PER_PIVOT = 100


def _prefix_worker(size: int, classes, share: int, whole: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("prefix", pa.list_(pa.int64()))]
    )

    def run(batches):
        table = classes.value
        with kept_words():
            yield from made(batches, table)

    def made(batches, table):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, same, prefixes = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingle_set(text, size)
                    n = len(found)
                    counts.append(n)
                    same.append(xxhash.xxh3_128_digest(found.tobytes()))
                    # With so few shingles only equal sets are similar enough.
                    if share * (n + 1) > whole * n:
                        prefixes.append([])
                    else:
                        length = n - -(-share * n // whole) + 1
                        prefixes.append(np.sort(np.partition(ordered_keys(found, table), length - 1)[:length]).view(np.int64))
                columns = [part.column(0), counts, same, prefixes]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return run


def _set_worker(size: int):
    """Columns after the text are kept."""

    def run(batches):
        with kept_words():
            yield from made(batches)

    def made(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, size).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(sets, pa.binary())], [*part.schema.names[1:], "set"]
                )

    return run


def _verify_worker(share: int, whole: int):
    """Of one pivot and at most PER_PIVOT others: the pairs that are similar enough."""

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("set")]
        reps, pivots = group.column("rep").to_pylist(), group.column("pivot").to_pylist()
        found = []
        for here in [k for k, (r, p) in enumerate(zip(reps, pivots, strict=True)) if r == p]:
            for k, (rep, pivot) in enumerate(zip(reps, pivots, strict=True)):
                if rep == pivot:
                    continue
                both = np.concatenate((sets[here], sets[k]))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if whole * common >= share * (len(both) - common):
                    found.append((pivot, rep))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


class JaccardJoin:
    """The join of one corpus; see the module's text."""

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> None:
        self.rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.shingle = shingle
        self.share, self.whole = similarity

    # Conditions on pairs, from sizes and prefixes.

    def _sizes_fit(self, n1: Column, n2: Column) -> Column:
        return F.least(n1, n2) * self.whole >= F.greatest(n1, n2) * self.share

    def _enough_common(self, common: Column, x: str, y: str) -> Column:
        """Of the prefix that ends first, only so many shingles may be missing in the other set."""
        need = F.ceil((F.col(f"{x}n") + F.col(f"{y}n")) * self.share / F.lit(float(self.share + self.whole)) - 1e-6)
        first_x = F.col(f"{x}last") <= F.col(f"{y}last")
        own = lambda c: F.when(first_x, F.col(f"{x}{c}")).otherwise(F.col(f"{y}{c}"))
        return own("p") - common <= own("n") - need

    def _may_have_common(self, x: str, y: str) -> Column:
        """The same, for a pair met at one shingle: as if all before and all after it were common that can be."""
        col = lambda side, name: F.col(f"{side}{name}")
        before = F.least(col(x, "i"), col(y, "i"))
        after = F.least(col(x, "s") - col(x, "i"), col(y, "s") - col(y, "i"))
        return self._enough_common(before + after, x, y)

    def sets(self) -> DataFrame:
        """doc_id, n, same, prefix of every row, written once."""
        spark = self.rows.sparkSession
        classes = spark.sparkContext.broadcast(frequency_classes(self.rows, self.shingle))
        worker = _prefix_worker(self.shingle, classes, self.share, self.whole)
        return settle(self.rows.mapInArrow(worker, "doc_id long, n long, same binary, prefix array<long>"), "jaccard-sets")

    def copies(self, sets: DataFrame) -> DataFrame:
        """rep, doc_id, n, same of every set that equals one of a document with a smaller id, written once."""
        known = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).select("doc_id", "n", "same")
        least = known.groupBy("n", "same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("met")).where("met > 1")
        found = known.join(least, ["n", "same"]).where("rep <> doc_id").select("rep", "doc_id", "n", "same").distinct()
        return settle(found, "jaccard-copies")

    def members(self, sets: DataFrame, copies: DataFrame) -> DataFrame:
        """rep, n, p, last, tokens, weight, grp: one row per set that shares a prefix shingle, written once.

        The weight says how often the corpus has these shingles: in a group of near copies most for the text they come from.
        """
        able = sets.where(F.col("doc_id").isNotNull() & (F.size("prefix") > 0))
        # Of an id with several texts those that are nobody's copy stay.
        single = able.join(small(copies.drop("rep")), ["doc_id", "n", "same"], "left_anti").withColumnRenamed("doc_id", "rep")
        postings = settle(single.select("rep", F.explode("prefix").alias("token")), "jaccard-postings")
        shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
        # A prefix is as long as a share of one document.
        kept = settle(
            postings.join(shared, "token")
            .groupBy("rep")
            .agg(F.sort_array(F.collect_set("token")).alias("tokens"), F.sum("met").alias("weight")),
            "jaccard-kept",
        )
        sizes = single.select("rep", "n", F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last"))
        sized = settle(sizes.join(small(kept), "rep").distinct(), "jaccard-sized")
        groups = sized.groupBy("n", "tokens").agg(F.min("rep").alias("grp"))
        return settle(sized.join(groups, ["n", "tokens"]), "jaccard-members")

    def _entries(self, rows: DataFrame, *extra: str) -> DataFrame:
        """Rows per prefix shingle and size class, in the own class and as a visitor in the next."""
        bucket = F.floor(F.log("n") / math.log(self.whole / self.share)).cast("int")
        exploded = rows.select("n", "p", "last", "grp", *extra, bucket.alias("own"), F.size("tokens").alias("s"), F.posexplode("tokens").alias("i", "token"))
        places = F.explode(
            F.array(
                F.struct(F.col("own").alias("bucket"), F.lit(False).alias("visitor")),
                F.struct((F.col("own") + 1).alias("bucket"), F.lit(True).alias("visitor")),
            )
        )
        return exploded.select("*", places.alias("place")).select("*", "place.bucket", "place.visitor").drop("place", "own")

    def pivot_pairs(self, parts: DataFrame) -> DataFrame:
        """At most one pair for each of parts (grp, component, first, weight, n, p, last, tokens): with its likeliest pivot.

        The pivot of a list is its part of greatest weight.
        """
        rank = F.struct((-F.col("weight")).alias("light"), F.xxhash64("first").alias("chance"))
        entries = self._entries(parts.withColumn("rank", rank), "component", "first", "rank")
        lists = (
            entries.groupBy("token", "bucket")
            .agg(
                F.min("component").alias("least"),
                F.max("component").alias("most"),
                F.min(F.struct("visitor", "rank", "first", "component", "n", "p", "last", "s", "i")).alias("pivot"),
            )
            .where("least <> most and not pivot.visitor")
            .select("token", "bucket", *(F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in ("first", "component", "n", "p", "last", "s", "i")))
        )
        tries = (
            entries.join(lists, ["token", "bucket"])
            .where(
                (F.col("component") != F.col("pivot_component"))
                & self._sizes_fit(F.col("n"), F.col("pivot_n"))
                & self._may_have_common("", "pivot_")
            )
            .groupBy("first", "n", "p", "last", "pivot_first", "pivot_n", "pivot_p", "pivot_last")
            .agg(F.countDistinct("token").alias("common"))
            .where(self._enough_common(F.col("common"), "", "pivot_"))
        )
        best = tries.groupBy("first").agg(F.max_by("pivot_first", F.struct("common", "pivot_first")).alias("pivot"))
        return best.select(F.col("pivot").alias("a"), F.col("first").alias("b"))

    def group_pairs(self, labelled: DataFrame) -> DataFrame:
        """All pairs of members in different components that size and prefixes leave possible."""
        entries = settle(self._entries(self._parts(labelled), "component"), "jaccard-entries")
        majors = entries.groupBy("token", "bucket").agg(
            F.min("component").alias("least"), F.max("component").alias("most"), F.min(F.struct("visitor", "n", "component")).alias("m")
        )
        open_lists = majors.where("least <> most").select("token", "bucket", F.col("m.component").alias("major"))
        held = settle(entries.join(open_lists, ["token", "bucket"]), "jaccard-open")
        minor = held.where("component <> major")
        names = ("grp", "component", "n", "p", "last", "visitor", "major", "s", "i")
        left = minor.select("token", "bucket", *(F.col(c).alias(f"x_{c}") for c in names))
        right = held.select("token", "bucket", *(F.col(c).alias(f"y_{c}") for c in names))
        met = left.join(right, ["token", "bucket"]).where(
            (F.col("x_component") != F.col("y_component"))
            & ~(F.col("x_visitor") & F.col("y_visitor"))
            # Two of the smaller components meet from both sides; one of them is enough.
            & ((F.col("y_component") == F.col("y_major")) | (F.col("x_component") < F.col("y_component")))
            & self._sizes_fit(F.col("x_n"), F.col("y_n"))
            & self._may_have_common("x_", "y_")
        )
        # The side that is written first is the smaller component, so that a pair has one form in all lists.
        swap = F.col("x_component") > F.col("y_component")
        sides = [
            F.when(swap, F.col(f"{o}_{c}")).otherwise(F.col(f"{s}_{c}")).alias(f"{s}_{c}")
            for s, o in (("x", "y"), ("y", "x"))
            for c in names[:5]
        ]
        keys = [f"{s}_{c}" for s in "xy" for c in names[:5]]
        counted = (
            met.select("token", *sides)
            .groupBy(*keys)
            .agg(F.countDistinct("token").alias("common"))
            .where(self._enough_common(F.col("common"), "x_", "y_"))
        )
        near = labelled.select("grp", "component", "rep")
        x = near.select(F.col("grp").alias("x_grp"), F.col("component").alias("x_component"), F.col("rep").alias("a"))
        y = near.select(F.col("grp").alias("y_grp"), F.col("component").alias("y_component"), F.col("rep").alias("b"))
        return counted.select("x_grp", "x_component", "y_grp", "y_component").join(x, ["x_grp", "x_component"]).join(
            y, ["y_grp", "y_component"]
        ).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose whole sets reach the similarity, written once.

        Others travel to their pivot in parts of bounded size, each with the pivot's set; so a set is sent once per pair
        and once per part, and texts that are in no pair not at all.
        """
        order = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        parts = settle(pairs.distinct().withColumn("part", F.floor((order - 1) / PER_PIVOT)), "jaccard-parts")
        others = parts.select(F.col("b").alias("rep"), F.col("a").alias("pivot"), "part")
        pivots = parts.select(F.col("a").alias("rep"), F.col("a").alias("pivot"), "part").distinct()
        wanted = settle(others.union(pivots), "jaccard-wanted")
        texts = self.rows.join(small(wanted), self.rows["doc_id"] == wanted["rep"]).select("text", "rep", "pivot", "part")
        sets = texts.mapInArrow(_set_worker(self.shingle), "rep long, pivot long, part long, set binary")
        worker = _verify_worker(self.share, self.whole)
        return settle(sets.groupBy("pivot", "part").applyInArrow(worker, "a long, b long"), "jaccard-links")

    def _label(self, members: DataFrame, links: DataFrame) -> DataFrame:
        found = components(links)
        labelled = members.join(found, members["rep"] == found["node"], "left").drop("node")
        return settle(labelled.withColumn("component", F.coalesce("component", "rep")), "jaccard-labelled")

    @staticmethod
    def _parts(labelled: DataFrame) -> DataFrame:
        """One row per group and component."""
        return labelled.groupBy("grp", "component", "n", "p", "last", "tokens").agg(F.min("rep").alias("first"), F.max("weight").alias("weight"))

    def labelled(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        sets = self.sets()
        copies = self.copies(sets)
        members = self.members(sets, copies)
        heads = members.where("rep = grp").select("*", F.col("rep").alias("component"), F.col("rep").alias("first"))
        # A group's pivot is its members' pivot; groups that meet no other are tried against their own first member.
        pivots = self.pivot_pairs(heads).select(F.col("b").alias("grp"), F.col("a").alias("pivot"))
        tried = members.join(pivots, "grp", "left").select(F.coalesce("pivot", "grp").alias("a"), F.col("rep").alias("b"))
        links = self.verified(tried.where("a <> b"))
        labelled = self._label(members, links)
        # Members that their pivot doesn't link are tried against the first of their group.
        first = labelled.where("rep = grp").select(F.col("rep").alias("a"), "grp", F.col("component").alias("own"))
        within = labelled.join(first, "grp").where("component <> own").select("a", F.col("rep").alias("b"))
        links = links.union(self.verified(within))
        labelled = self._label(members, links)
        links = links.union(self.verified(self.group_pairs(labelled)))
        # Equal sets link as well.
        whole = components(links.union(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
        return sets.join(whole, sets["doc_id"] == whole["node"], "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
        )


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; `similarity` is a fraction."""
    with scratch(docs.sparkSession) as keep:
        return keep(settle(JaccardJoin(docs, shingle, similarity).labelled(), "jaccard-components"))
