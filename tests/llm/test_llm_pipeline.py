"""The pipeline against the operators' own definitions, and every registered query against its SQL."""

import re

import check_oracle
import corpus_pipeline
import pytest
from cases import awkward_rows, docs, plain, prose, serve, sha
from test_llm_pairs import brute_components
from test_llm_texts import brute_quality

from sonoframe.llm import ENTRIES
from sonoframe.llm.secrets import RULES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_query_matches_its_sql(spark, name):
    status, detail = check_oracle.compare(spark, check_oracle.oracle_connection(SF), SF, name)
    assert status == "ok", detail


def stages(spark, folder):
    frame, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = corpus_pipeline.settle(stage(spark, frame, folder), f"test-{name}")
        out.append((before, frame))
    return out


def one_of_each(rows):
    """Equal rows count once; every other text is a document of its own, whatever its id."""
    named = sorted({(i, sha(t or ""), t) for i, t in rows if i is not None}, key=repr)
    found = brute_components([(k, t) for k, (_, _, t) in enumerate(named)], 5, 80, 100)
    groups = {}
    for k, _, component in found:
        groups.setdefault(component, []).append(named[k])
    least = [min(g, key=lambda r: r[:2]) for g in groups.values()]
    return [(i, t) for i, _, t in least] + [(i, t) for i, t in rows if i is None]


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b, c = (prose(k, 200) for k in (1, 2, 3))
    rows = [(3, a), (8, a), (8, b), (9, b + " word"), (10, c), (10, c), (11, a + " word"), (11, c), (-4, b), (None, a)]
    frame = docs(spark, [(i, t, "en", "s", 1, "x", "y", 1, 2, 3, 4) for i, t in rows])
    got = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert plain((r["doc_id"], r["text"]) for r in got) == plain(one_of_each(rows))
    assert plain((r["doc_id"], r["text"]) for r in got) == plain([(3, a), (-4, b), (10, c), (None, a)])


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_stages_equal_brute_force(spark, tmp_path, kind):
    folder = SF if kind == "real" else serve(spark, tmp_path, documents=docs(spark, None if kind == "awkward" else []))
    (start, good), (_, single), (_, clean), (_, packed) = stages(spark, folder)
    for frame in (good, single, clean):
        assert frame.columns == corpus_pipeline.COLUMNS
    # Quality: the base rules take effect, and so does the operator's verdict.
    kept = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert all(not brute_quality(t)[-1] for _, t in kept)
    rejected = len([1 for r in start.collect() if brute_quality(r["text"] or "")[-1]])
    assert rejected <= start.count() - good.count() <= rejected + 0.2 * start.count()
    # Near duplicates: the least id, then digest, of each component, once, and all rows without id.
    assert plain((r["doc_id"], r["text"]) for r in single.collect()) == plain(one_of_each(kept))
    # Secrets: nothing is left to find and other text stays.
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
        if not any(re.search(x.java, texts[r["doc_id"]] or "", re.ASCII) for x in RULES):
            assert r["text"] == texts[r["doc_id"]]
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r["text"])
    assert {p["doc_id"] for p in packed.select("doc_id").collect()} == {r["doc_id"] for r in clean.collect()}


def test_run_gives_the_last_stage(spark, tmp_path):
    folder = serve(spark, tmp_path, documents=docs(spark))
    last = stages(spark, folder)[-1][1]
    pick = lambda f: plain(f.select("doc_id", "start", "length", "doc_tokens").collect())
    whole = lambda f: plain(f.groupBy("doc_id", "doc_tokens").sum("length").collect())
    assert pick(corpus_pipeline.run(spark, folder)) == pick(last) or whole(corpus_pipeline.run(spark, folder)) == whole(last)
    assert len(awkward_rows()) > 20
