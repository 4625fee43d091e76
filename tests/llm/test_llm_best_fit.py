"""Best-fit packing against placement one piece at a time."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import awkward_rows, docs, plain, serve
from tokenizers import Tokenizer

from sonoframe.llm import ENTRIES
from sonoframe.llm.best_fit import TightestFit, best_fit_pack, plan_runs

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """What remains in each sequence, sorted."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(left) if r >= length]
        if fits:
            left[min(fits)[1]] -= length
        else:
            left.append(capacity - length)
    return sorted(left)


def test_tree_finds_the_tightest():
    rnd = random.Random(1)
    for capacity in (1, 2, 7, 64, 100):
        tree, held = TightestFit(capacity), Counter()
        for _ in range(300):
            size = rnd.randint(0, capacity)
            change = rnd.choice([1, 2, -1]) if held[size] else 1
            held[size] += change
            tree.add(size, change)
            wanted = rnd.randint(1, capacity)
            assert tree.find(wanted) == min((r for r in held if held[r] and r >= wanted), default=-1)


@pytest.mark.parametrize("capacity", [1, 2, 5, 10, 64, 100])
def test_plan_equals_placing_one_by_one(capacity):
    rnd = random.Random(capacity)
    for _ in range(60):
        counts = Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 150)))
        runs = plan_runs(counts, capacity)
        laid = defaultdict(list)
        for length, many in counts.items():
            own = sorted(r[1:] for r in runs if r[0] == length)
            for rank in range(many):
                at, first, each, offset = [r for r in own if r[0] <= rank][-1]
                laid[first + (rank - at) // each].append((offset + (rank - at) % each * length, length))
        for pieces in laid.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= capacity
        assert sorted(capacity - sum(p[1] for p in each) for each in laid.values()) == one_by_one(counts.elements(), capacity)
        assert sorted(laid) == list(range(len(laid)))


def test_plan_does_not_grow_with_the_corpus():
    sizes = [len(plan_runs({k: int(scale / (k + 5) ** 1.3) + 1 for k in range(1, 2049)}, 2048)) for scale in (1e4, 1e7, 1e10)]
    assert max(sizes) < 20_000


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text, end: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_query_equals_brute_force(spark, tmp_path, library):
    rows = awkward_rows() + [(k, f"short text {k} " * (k % 40), None, None, 0, "x", "y", 1, 2, 3, 4) for k in range(100, 500)]
    folder = serve(spark, tmp_path, documents=docs(spark, rows))
    frame = ENTRIES["op13_best_fit_packing"].run(spark, folder)
    assert dict(frame.dtypes)["piece"] == "int"
    got = frame.collect()
    wanted = []
    for r in rows:
        ids = library(r[1], 0)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            wanted.append((r[0], piece, start, len(part), zlib.crc32(part.tobytes())))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert plain(tuple(g[n] for n in names) for g in got) == plain(wanted)
    sequences = defaultdict(list)
    for g in got:
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
    left = sorted(2048 - sum(p[1] for p in each) for each in sequences.values())
    assert left == one_by_one([w[3] for w in wanted], 2048)


def test_ids_of_a_sequence_are_its_pieces(spark, library):
    frame = best_fit_pack(docs(spark), PATH, end_id=7, capacity=64)
    held = [(r["doc_id"], r["start"], bytes(r["ids"])) for r in frame.collect()]
    whole = [(r[0], library(r[1], 7).tobytes()) for r in awkward_rows()]
    assert sum(len(h[2]) for h in held) == sum(len(w[1]) for w in whole)
    for doc_id, start, ids in held:
        assert any(w[0] == doc_id and w[1][4 * start : 4 * start + len(ids)] == ids for w in whole)


def test_empty_table(spark, tmp_path):
    folder = serve(spark, tmp_path, documents=docs(spark, []))
    assert ENTRIES["op13_best_fit_packing"].run(spark, folder).collect() == []
