"""Fill-in-the-middle frames against the definition on whole texts."""

import hashlib
import re

import pytest
from cases import awkward_rows, docs, plain, serve, sha

from sonoframe.llm import ENTRIES
from sonoframe.llm.frames import Codec, Draws, Reader, digests, fill_in_middle, output_texts, restore, write_frames

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
MARKED = [(30, "a <P> b"), (31, "x<S>y"), (32, "<M>"), (33, "<P <S <M P> S> M>"), (34, "é<" * 50 + "P"), (35, "<"), (36, "S><P")]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text), out


def rows():
    more = MARKED + [(k, f"text {k} é\n漢 <b> " * (k % 7)) for k in range(100, 160)]
    return awkward_rows() + [(i, t, None, None, 0, "x", "y", 1, 2, 3, 4) for i, t in more]


def test_query_equals_brute_force(spark, tmp_path):
    folder = serve(spark, tmp_path, documents=docs(spark, rows()))
    got = ENTRIES["op11_fill_in_middle"].run(spark, folder).collect()
    wanted = [brute(r[0], r[1])[:7] for r in rows()]
    assert plain(got) == plain(wanted)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("units", [1, 2, 7, 4096])
def test_frames_of_any_size_give_the_same_outputs(spark, units):
    some = [r for r in rows() if len(r[1] or "") < 3000]
    outputs = fill_in_middle(write_frames(docs(spark, some), units))
    texts = plain((r["doc_id"], r["form"], r["text"]) for r in output_texts(outputs).collect())
    assert texts == plain((w[0], w[2], w[7]) for w in (brute(r[0], r[1]) for r in some))
    sums = plain((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in digests(outputs).collect())
    assert sums == plain((w[0], w[5], w[6]) for w in (brute(r[0], r[1]) for r in some))


def test_only_cut_frames_are_written_anew(spark):
    text = " ".join(f"word{k}" for k in range(4000))
    store = write_frames(docs(spark, [(k, text, None, None, 0, "x", "y", 1, 2, 3, 4) for k in range(40)]), 500)
    held = {bytes(f) for r in store.collect() for f in r["frames"]}
    for r in fill_in_middle(store).collect():
        new = [f for f in r["frames"] if bytes(f) not in held]
        assert len(new) == 0 if r["form"] == "plain" else len(new) <= 3 + 4


def test_marks_are_found_across_frames():
    codec = Codec()
    for text, form, wanted in [("<P>ab<S>c<M>d", "psm", "abdc"), ("<S>c<P>a<<M>>d", "spm", "a<>dc"), ("<P><S><M>", "psm", "")]:
        for step in (1, 2, 3, 4, 50):
            frames = [codec.compress(text[k : k + step].encode()) for k in range(0, len(text), step)]
            seen = []
            back = b"".join(restore(Reader(codec, frames), form, seen.append))
            assert b"".join(seen).decode() == text
            assert back.decode() == wanted


def test_rates_are_parameters():
    forms = [Draws("s", 50, 50).of(k, 10, False)[0] for k in range(2000)]
    assert 800 < forms.count("plain") < 1200 and 350 < forms.count("psm") < 650
    assert {Draws(moved_percent=0).of(k, 10, False)[0] for k in range(50)} == {"plain"}


def test_empty_table(spark, tmp_path):
    folder = serve(spark, tmp_path, documents=docs(spark, []))
    assert ENTRIES["op11_fill_in_middle"].run(spark, folder).collect() == []
