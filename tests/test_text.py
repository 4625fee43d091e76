import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sonoframe.functions import text as X


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.out for r in df.select("i", build(F.col("t")).alias("out")).orderBy("i").collect()]


def test_mixed_tokens(spark):
    texts = [
        "我 um it's-ok@m xxx 江", "ＡＢＣ café x1", "𠀀𪛖 rock’n’roll", "axxxb XXX", None, "word@mé @abc!",
    ]
    assert column(spark, texts, X.mixed_tokens) == [
        ["我", "um", "it's-ok", "江"], ["abc", "caf", "x1"], ["𠀀", "𪛖", "rock’n’roll"], ["axxxb"], None,
        ["word", "m"],
    ]


def test_character_key(spark):
    assert column(spark, ["Straße #& &ann1 xxx，你 好！ ﬁ"], X.character_key) == ["strasse你好fi"]


def table(ref, hyp):
    """Full-table recursion: (distance, deletions, insertions) with the fixed preference on ties."""
    rows = [[(j, 0, j) for j in range(len(hyp) + 1)]]
    for i, a in enumerate(ref, 1):
        row = [(i, i, 0)]
        for j, b in enumerate(hyp, 1):
            if a == b:
                row.append(rows[-1][j - 1])
                continue
            d, n, s = rows[-1][j], row[-1], rows[-1][j - 1]
            options = [(d[0] + 1, d[1] + 1, d[2]), (n[0] + 1, n[1], n[2] + 1), (s[0] + 1, s[1], s[2])]
            row.append(min(options, key=lambda o: o[0]))
        rows.append(row)
    return rows[-1][-1]


@pytest.mark.parametrize("pair,want", [(("abcd", "axcde"), (2, 0, 1)), (("ab", "ba"), table("ab", "ba")), (("", "ab"), (2, 0, 2)), (("ab", ""), (2, 2, 0))])
def test_edit_counts_pinned(pair, want):
    assert X.edit_counts_of(list(pair[0]), list(pair[1])) == want


def test_edit_counts_both_forms_match_the_table():
    rng = random.Random(1)
    for _ in range(300):
        ref, hyp = ([rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(2))
        want = table(ref, hyp)
        assert X._edit_rows(ref, hyp) == want and X._edit_diagonals(ref, hyp) == want
    ref, hyp = ([rng.choice("abcdefgh") for _ in range(n)] for n in (150, 170))
    assert X.edit_counts_of(ref, hyp) == table(ref, hyp)


def test_edit_counts_column(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), (None, ["x"]), ([], [])], "r array<string>, h array<string>")
    rows = [r.e for r in df.select(X.edit_counts("r", "h").alias("e")).collect()]
    assert [r.distance for r in rows] == [2, 1, 0]
    assert all(r.distance == r.deletions + r.insertions + r.substitutions for r in rows)


def test_fillers_and_repetitions(spark):
    texts = ["Um, um umbrella éum you know 那个那个", "for for that's that's no, no 好好 The the"]
    assert column(spark, texts, lambda c: X.filler_count(c, "um")) == [2, 0]
    assert column(spark, texts, lambda c: X.filler_count(c, "you know")) == [1, 0]
    assert column(spark, texts, lambda c: X.filler_count(c, "那个")) == [2, 0]
    assert column(spark, texts, X.repetitions)[1] == ["for for", "that's that's", "no, no", "The the"]


def test_small_rules(spark):
    assert column(spark, ["a b/c..", "--", "ok_1.x"], X.sanitized_id) == ["a-b-c", "benchmark", "ok_1.x"]
    assert column(spark, ["N/A", "s1"], X.speaker_or_null) == [None, "s1"]
    assert column(spark, ["abc", "a中"], X.script_language) == ["English", "Chinese"]
    assert column(spark, ["It’s, OK!"], X.stripped_key) == ["itsok"]
    assert unicodedata.normalize("NFKC", "ﬁ") == column(spark, ["ﬁ"], X.nfkc)[0]
