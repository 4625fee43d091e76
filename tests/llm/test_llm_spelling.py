"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import awkward_rows, docs, plain, serve

from sonoframe.llm import ENTRIES
from sonoframe.llm.spelling import neighbour_keys, own_keys, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {k: k + 32 for k in range(65, 91)}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return plain(out)


def family(seed: int, words: int):
    """Words over few letters with many near ones, some frequent, some of two bytes a letter."""
    rnd = random.Random(seed)
    made = set()
    while len(made) < words:
        word = "".join(rnd.choices("abcéiq", k=rnd.randint(7, 9)))
        made.add(word)
        for _ in range(3):
            at = rnd.randrange(len(word))
            made.add(word[:at] + rnd.choice(["", "a", "ïx", word[at] + "y"]) + word[at + 1 :])
    return {w: rnd.choice([2, 3, 5, 30, 400, 5000]) for w in made if len(w) >= 7}


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    words = family(seed, 300)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert plain(got) == brute_variants(words)
    assert any(r["form"] and r["form"] != r["root"] for r in got)


def test_neighbourhoods_meet_every_edit():
    rnd = random.Random(5)
    for length in (7, 8, 12, 40, 3000):
        word = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=length))
        keys = set(neighbour_keys([word, word])[1].tolist())
        assert keys == set(neighbour_keys([word])[0].tolist())
        for _ in range(60):
            at = rnd.randrange(length)
            for edited in (word[:at] + word[at + 1 :], word[:at] + "ÿ" + word[at + 1 :], word[:at] + "z" + word[at:], word + "k"):
                assert int(own_keys([edited])[0]) in keys
        far = word[:2] + "zz" + word[4:-3] + "kkk"
        assert one_edit(word, far) or int(own_keys([far])[0]) not in keys or length < 12
    assert own_keys(["abcdefg"]).dtype == np.uint64


def test_query_on_awkward_rows(spark, tmp_path):
    extra = [(50, "Zürichsee ZÜRICHSEE zürichsee"), (51, "zürichsees, zürichsees×÷ß " * 30), (52, "y" * 60_000 + " " + "y" * 60_000 + "y")]
    extra += [(53, "y" * 60_000), (53, "y" * 60_000), (None, "withoutanid " * 40), (54, "withoutanidd withoutanidd")]
    rows = awkward_rows() + [(i, t, None, None, 0, "x", "y", 1, 2, 3, 4) for i, t in extra]
    folder = serve(spark, tmp_path, documents=docs(spark, rows))
    got = ENTRIES["op12_spelling_variants"].run(spark, folder).collect()
    assert plain(got) == brute_variants(brute_words([(r[0], r[1]) for r in rows]))
    assert max(len(r["word"]) for r in got) >= 60_000


def test_empty_table(spark, tmp_path):
    folder = serve(spark, tmp_path, documents=docs(spark, []))
    assert ENTRIES["op12_spelling_variants"].run(spark, folder).collect() == []
