"""Secret scans through a trigram index, in DataFrame functions only.

From each rule's expression a Boolean trigram query is derived. The index holds a posting (trigram, doc_id) for each
trigram that some query names; postings of a conjunction are intersected by doc_id, and only documents in the result
are scanned with the rule's expression. Rules whose query says nothing scan every document.

Defined results: null text is empty and has no spans; rows that share a doc_id, or have none, are candidates together and
scanned each; matches of one kind are leftmost and don't overlap, those of different kinds may; an empty table gives
no rows; other columns are kept, and columns named `spans` or starting with `_s_` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import settle, small
from sonoframe.llm.trigrams import ANYTHING, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose `group` has fewer than `least` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        """Groups of varying length are repeated possessively, or the depth of the stack would follow the text."""
        return ("(?i)" if self.any_case else "") + self.pattern

    @property
    def linear(self) -> str:
        """The same for engines that never go back and know no possessive repeats."""
        return self.java.replace(")*+", ")*")


# The patterns of the base kinds, in the order that their spans are listed in.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# A private key reaches from its BEGIN line over header lines and pieces of base64 to the END line, if only separators and
# one short piece lie before it. Without an END line it takes all long pieces and a short one that is alone on its line.
# Nothing but these may lie between, so a BEGIN line that is quoted in prose, or stands before another one, is taken alone.
_GAP = r"[ \t\r\n\\>,\"-]+(?:[rn+]{1,2}[ \t\r\n\\>,\"-]+){0,3}"
_LONG = rf"(?:{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}})"
_KEY_HEADERS = r"(?:[ \t\r\n\\n>,\"-]*(?:Proc-Type|DEK-Info):[^\r\n]*){0,2}"
_KEY_END = rf"(?:{_GAP}[A-Za-z0-9+/]{{1,15}}={{0,2}})?(?:{_GAP})?n?-----END [A-Z ]*PRIVATE KEY-----"
_SHORT_LINE = r"[ \t]*[\r\n][ \t\r\n]*[A-Za-z0-9+/]{1,15}={0,2}[ \t]*(?:\r?\n|$)"
# Published formats of further credentials.
FURTHER = (
    Rule(
        "private_key",
        rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_KEY_HEADERS}(?:{_LONG}{_LONG}*+(?:{_KEY_END}|{_SHORT_LINE}|[ \t\r\n]*$)?|{_KEY_END}))?",
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
)
RULES = BASE + FURTHER
SPANS = "array<struct<start:int,end:int,kind:string>>"
#: Matches per inner step when running lengths are added up.
STEP = 256


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the named trigrams; rows of one doc_id may repeat a posting."""
    low = docs.select("doc_id", F.lower("text").alias("_low"))
    present = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("doc_id", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, _s_mask): bit k is set if the postings leave rule k possible."""
    spark = index.sparkSession
    terms = []
    number = 0
    for k, rule in enumerate(rules):
        for conjunction in trigram_query(rule.pattern):
            grams = sorted(conjunction)
            for j, gram in enumerate(grams):
                terms.append((gram, number, 1 << k, 1 << j, (1 << len(grams)) - 1))
            number += 1
    # As many rows as the rules have trigrams.
    wanted = F.broadcast(spark.createDataFrame(terms, "trigram string, conjunction int, rule long, bit long, full long"))
    met = (
        index.join(wanted, "trigram")
        .groupBy("doc_id", "conjunction", "rule", "full")
        .agg(F.bit_or("bit").alias("bits"))
        .where(F.col("bits") == F.col("full"))
    )
    return met.groupBy("doc_id").agg(F.bit_or("rule").alias("_s_mask"))


def _lengths(rule: Rule, k: int) -> Column:
    """Per match of rule k: characters skipped before it, its own, and those of the group that counts.

    The arrays are zipped first: an array that a lambda picks from by position may be computed anew for each position.
    """
    found = F.col(f"_s_found{k}")
    value = F.col(f"_s_values{k}") if rule.group else found
    zipped = F.arrays_zip(
        F.slice(F.col(f"_s_gaps{k}"), 1, F.size(found)).alias("gap"), found.alias("match"), value.alias("value")
    )
    return F.transform(
        zipped,
        lambda m: F.struct(
            F.length(m["gap"]).alias("skip"), F.length(m["match"]).alias("size"), F.length(m["value"]).alias("value")
        ),
    )


def _spans(rule: Rule, k: int) -> Column:
    """Spans of one rule from the lengths between and of its matches."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    items = F.col(f"_s_items{k}")

    def end_of(spans: Column, base: Column) -> Column:
        return F.coalesce(F.get(spans, F.size(spans) - 1)["end"], base)

    def inner(base: Column):
        def add(spans: Column, item: Column) -> Column:
            start = end_of(spans, base) + item["skip"]
            return F.concat(spans, F.array(F.struct(start.alias("start"), (start + item["size"]).alias("end"))))

        return add

    def outer(blocks: Column, b: Column) -> Column:
        last = F.get(blocks, F.size(blocks) - 1)
        base = F.coalesce(F.get(last, F.size(last) - 1)["end"], F.lit(0))
        return F.concat(blocks, F.array(F.aggregate(F.slice(items, b * STEP + 1, F.lit(STEP)), none, inner(base))))

    all_spans = F.flatten(
        F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")),
            F.array().cast("array<array<struct<start:int,end:int>>>"),
            outer,
        )
    )
    kept = F.filter(F.arrays_zip(all_spans.alias("span"), items.alias("item")), lambda x: x["item"]["value"] >= rule.least)
    listed = F.transform(
        kept, lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), F.lit(rule.kind).alias("kind"))
    )
    return F.when(F.size(items) > 0, listed).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds spans; a row is scanned for rule k if bit k of _s_mask is set."""
    body = F.coalesce(F.col("text"), F.lit(""))
    found, items, spans = {}, {}, {}
    for k, rule in enumerate(rules):
        pattern = F.lit(rule.java)
        wanted = F.col("_s_mask").bitwiseAND(F.lit(1 << k)) != 0
        found[f"_s_found{k}"] = F.when(wanted, F.regexp_extract_all(body, pattern, F.lit(0)))
        some = F.size(f"_s_found{k}") > 0
        items[f"_s_gaps{k}"] = F.when(some, F.split(body, rule.java, -1))
        if rule.group:
            items[f"_s_values{k}"] = F.when(some, F.regexp_extract_all(body, pattern, F.lit(rule.group)))
        spans[f"_s_items{k}"] = F.when(some, _lengths(rule, k)).otherwise(
            F.array().cast("array<struct<skip:int,size:int,value:int>>")
        )
    laid = docs.withColumns(found).withColumns(items).withColumns(spans)
    every = F.flatten(F.array(*(_spans(rule, k) for k, rule in enumerate(rules))))
    scratch = [c for c in laid.columns if c.startswith("_s_")]
    return laid.withColumn("spans", every.cast(SPANS)).drop(*scratch)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with spans: array of (start, end, kind), code points, end exclusive, by rule and start."""
    queries = [trigram_query(r.pattern) for r in rules]
    full = sum(1 << k for k, q in enumerate(queries) if q == ANYTHING)
    grams = sorted({g for q in queries for c in q for g in c})
    docs = docs.drop(*(c for c in docs.columns if c == "spans" or c.startswith("_s_")))
    if not grams:
        return scan(docs.withColumn("_s_mask", F.lit(full).cast("long")), rules)
    picked = settle(candidates(build_index(docs, grams), rules), "secret-candidates").withColumnRenamed("doc_id", "_s_doc")
    masked = docs.join(small(picked), F.col("doc_id").eqNullSafe(F.col("_s_doc")), "left").withColumn(
        "_s_mask", F.coalesce("_s_mask", F.lit(0)).bitwiseOR(F.lit(full))
    )
    return scan(masked, rules)


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replaces what the spans cover, overlapping ones as one, by a mark; spans is dropped."""
    none = F.array().cast("array<int>")

    def last(ends: Column) -> Column:
        return F.get(ends, F.size(ends) - 1)

    def block(blocks: Column, b: Column) -> Column:
        base = F.coalesce(last(F.coalesce(last(blocks), none)), F.lit(0))
        part = F.slice(F.col("_s_sorted"), b * STEP + 1, F.lit(STEP))
        ends = F.aggregate(
            part, none, lambda acc, s: F.concat(acc, F.array(F.greatest(s["end"], F.coalesce(last(acc), base))))
        )
        return F.concat(blocks, F.array(ends))

    # How far the spans up to each one reach; a span that starts before that is no piece of its own.
    count = F.size("_s_sorted")
    blocks = F.sequence(F.lit(0), F.floor((count - 1) / STEP).cast("int"))
    reach = F.when(count > 0, F.flatten(F.aggregate(blocks, F.array().cast("array<array<int>>"), block))).otherwise(none)
    reached = found.withColumn("_s_sorted", F.array_sort("spans")).withColumn("_s_reach", reach)
    before = F.concat(F.array(F.lit(0)), F.slice("_s_reach", F.lit(1), F.greatest(count - 1, F.lit(0))))
    zipped = F.arrays_zip(F.col("_s_sorted").alias("span"), before.alias("before"))

    def piece(x: Column) -> Column:
        start = x["span"]["start"]
        text = F.substring(F.col("text"), x["before"] + 1, start - x["before"])
        return F.when(start >= x["before"], F.concat(text, F.lit(mark))).otherwise("")

    whole = F.array_join(F.transform(zipped, piece), "")
    tail = F.substring(F.col("text"), last(F.col("_s_reach")) + 1, F.length("text"))
    clean = F.when(count == 0, F.col("text")).otherwise(F.concat(whole, tail))
    return reached.withColumn("text", clean).drop("_s_sorted", "_s_reach", "spans")
