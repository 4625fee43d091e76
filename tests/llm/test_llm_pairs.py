"""Operators on pairs against brute force: Jaccard join, components, Hamming search."""

import random

import pytest
from cases import SCHEMA, WORD, awkward_rows, docs, plain, prose, serve

from sonoframe.llm import ENTRIES
from sonoframe.llm.components import components
from sonoframe.llm.hamming import top_k
from sonoframe.llm.jaccard import jaccard_components


def brute_components(rows, size, share, whole):
    sets, parent = {}, {}
    counted = []
    for i, text in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        found = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
        counted.append((i, len(found)))
        if i is not None:
            sets.setdefault(i, []).append(found)
            parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and whole * len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return [(i, n, None if i is None else root(i)) for i, n in counted]


def mutated(text, edits, rnd):
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


def near_copies(seed=4):
    rnd = random.Random(seed)
    passage = prose(77, 40).replace("\n", " ")
    rows, i = [], 0
    for group in range(6):
        base = prose(1000 + group, rnd.choice([12, 60, 150])).replace("\n", " ")
        for _ in range(12):
            rows.append((i := i + 1, mutated(base, rnd.randint(0, 6), rnd)))
    # Documents made of one common passage and a little of their own, and a chain in which only neighbours are near.
    rows += [((i := i + 1), passage + " " + prose(5000 + k, rnd.randint(1, 12)).replace("\n", " ")) for k in range(30)]
    chain = prose(9, 120).replace("\n", " ")
    for _ in range(15):
        chain = mutated(chain, 1, rnd)
        rows.append((i := i + 1, chain))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,share", [(3, 90), (5, 80), (3, 50)])
def test_components_equal_brute_force(spark, size, share):
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_components(frame, size, (share, 100)).collect()
    assert plain(got) == plain(brute_components(rows, size, share, 100))


def test_repeated_ids_keep_their_links(spark):
    a, b = prose(1, 200), prose(2, 200)
    rows = [(3, a), (8, a), (8, b), (9, b + " word"), (10, b), (11, prose(3, 200)), (11, a), (12, prose(3, 200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = plain(jaccard_components(frame).collect())
    assert got == plain(brute_components(rows, 5, 80, 100))
    assert {r[2] for r in got} == {3}


def test_wide_vectors_are_an_error(spark):
    from sonoframe.llm.hamming import sign_codes

    frame = spark.createDataFrame([(1, [1.0] * 65)], "id long, v array<double>")
    with pytest.raises(Exception, match="more than 64 components"):
        sign_codes(frame, "id", "v").collect()


def test_awkward_documents(spark, tmp_path):
    folder = serve(spark, tmp_path, documents=docs(spark))
    got = ENTRIES["op3_ngram_jaccard_join"].run(spark, folder).collect()
    assert plain(got) == plain(brute_components([(r[0], r[1]) for r in awkward_rows()], 3, 90, 100))


def test_no_documents(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(5, k) for k in range(200, 260)]
    got = dict(components(spark.createDataFrame([*chain, *star, (160, 99)], "a long, b long")).collect())
    assert got == {**{k: 99 for k in range(99, 161)}, 5: 5, **{k: 5 for k in range(200, 260)}}


def test_hamming_search_equals_brute_force(spark):
    rnd = random.Random(8)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    codes = []
    for k in range(400):
        code = rnd.choice(centres)
        for _ in range(rnd.randint(0, 9)):
            code ^= 1 << rnd.randrange(64)
        codes.append((k, code - (1 << 64) if code >> 63 else code))
    codes += [(1000 + k, codes[0][1]) for k in range(40)] + [codes[3]]
    rows = spark.createDataFrame(codes, "id long, code long")
    queries = [c for c in codes if c[0] % 20 == 0]
    got = top_k(rows, spark.createDataFrame(queries, rows.schema), k=7).collect()
    want = []
    for i, code in dict(queries).items():
        near = sorted(((code ^ c) & (1 << 64) - 1).bit_count() << 32 | j for j, c in dict(codes).items() if j != i)[:7]
        want += [(i, r + 1, x & (1 << 32) - 1, x >> 32) for r, x in enumerate(near)]
    assert plain(got) == plain(want)


def test_hamming_query_takes_null_short_and_few_vectors(spark, tmp_path):
    rows = [(0, [1.0, None, -1.0], 1), (20, [1.0], 2), (1, None, 3), (2, [0.0] * 70, 4), (None, [1.0], 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ENTRIES["op2_exact_top_k_search"].run(spark, serve(spark, tmp_path, embeddings=frame)).collect()
    assert {(r["query_id"], r["neighbour_id"], r["distance"]) for r in got if r["neighbour_id"] is not None} == {
        (0, 20, 0), (0, 2, 1), (20, 0, 0), (20, 2, 1)
    }


def test_hamming_query_over_no_vectors(spark, tmp_path):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ENTRIES["op2_exact_top_k_search"].run(spark, serve(spark, tmp_path, embeddings=frame)).collect() == []
