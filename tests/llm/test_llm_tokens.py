"""Packing and the token store against the tokenizer library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from cases import awkward_rows, docs, plain, serve
from tokenizers import Tokenizer

from sonoframe.llm import ENTRIES
from sonoframe.llm.arrow_store import LENGTH, Sequences, write_store
from sonoframe.llm.common import shared_folder
from sonoframe.llm.packing import class_sizes, cuts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text, end: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return serve(spark, tmp_path_factory.mktemp("tokens"), documents=docs(spark))


def test_cuts_are_exact_and_use_class_sizes():
    sizes = class_sizes()
    for tokens in [1, 2, 63, 64, 65, 2048, 4095, 4096, 4097, 30_000]:
        made = cuts(tokens, sizes)
        assert sum(made) == tokens
        assert all(m in sizes or m < 64 for m in made)


def test_packed_pieces_hold_each_id_once(spark, folder, library):
    got = ENTRIES["op9_harmonic_packing"].run(spark, folder).collect()
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    whole = defaultdict(list)
    for r in awkward_rows():
        whole[r[0]].append(library(r[1], 2))
    for p in got:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_document[p["doc_id"], p["doc_tokens"]].append(p)
        assert any(
            len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
            for ids in whole[p["doc_id"]]
        )
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(ids) for each in whole.values() for ids in each)
    assert sum(p["length"] for p in got) == total
    assert len(by_sequence) * 4096 - total < 4096 + 0.02 * total
    for (i, tokens), pieces in by_document.items():
        copies = sum(len(ids) == tokens for ids in whole[i])
        starts = sorted((p["start"], p["length"]) for p in pieces)
        assert sum(length for _, length in starts) == copies * tokens


def test_store_reads_back_in_order(spark, folder, library):
    got = ENTRIES["op10_arrow_stream_files"].run(spark, folder).collect()
    rows = sorted(((r[0] is not None, r[0] or 0), library(r[1], 1)) for r in awkward_rows() if False) or [
        (r[0], library(r[1], 1)) for r in awkward_rows()
    ]
    assert plain((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == plain(
        (i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in rows
    )
    at = 0
    ordered = sorted(got, key=lambda r: r["start"])
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)


def test_store_files_give_rows_without_copies(spark, library):
    folder = shared_folder(spark, "store-test")
    write_store(docs(spark), folder, PATH, 49_408, files=1).collect()
    root = folder.removeprefix("file:")
    store = Sequences(pafs.LocalFileSystem(), f"{root}/part-000000.arrow")
    null_first = sorted((r for r in awkward_rows() if r[0] is not None), key=lambda r: r[0])
    first = [library(r[1], 1) for r in awkward_rows() if r[0] is None]
    everything = np.concatenate([library(r[1], 1) for r in null_first])
    skip = sum(map(len, first))
    wanted = everything[: 5 * LENGTH]
    held = np.concatenate([v.astype("<u4") for v in store.ids(skip, len(wanted))])
    # Rows of one doc_id may come in either order; documents 0 to 6 have one row each.
    alone = sum(len(library(r[1], 1)) for r in null_first if r[0] < 7)
    assert held[:alone].tolist() == wanted[:alone].tolist()
    ids, mask = store[0]
    assert len(ids) == len(mask) == LENGTH
    assert all(m.as_py() for m in mask)


def test_empty_tables(spark, tmp_path):
    folder = serve(spark, tmp_path, documents=docs(spark, []))
    for name in ("op9_harmonic_packing", "op10_arrow_stream_files"):
        assert ENTRIES[name].run(spark, folder).collect() == []
