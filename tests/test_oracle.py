"""Every registered query against its SQL at the smallest scale, plain and with recordings cut into chunks."""

import pytest

import check_oracle
from sonoframe.operators import scan
from sonoframe.plans import ENTRIES

SF = "/root/testdata/sf0.001"
ORDERED = [
    "speech_regions", "region_pad_then_merge", "speaker_turns", "coverage_ledger", "interval_gaps", "cluster_bounds",
    "nearest_neighbours", "collar_exclusion", "duration_batches", "diarization_error", "repeat_drift", "order_statistics",
    "machine_regions", "sentence_partition", "ordered_transcripts", "region_problems", "selection_counts",
]


@pytest.fixture(scope="module")
def oracle():
    return check_oracle.oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_matches_its_sql(spark, oracle, name):
    status, detail = check_oracle.compare(spark, oracle, SF, name)
    assert status in ("ok", "rows-only"), detail


@pytest.mark.parametrize("name", ORDERED)
def test_chunked_scans_match_the_sql(spark, oracle, name, monkeypatch):
    monkeypatch.setattr(scan, "TARGET_ROWS", 12)
    status, detail = check_oracle.compare(spark, oracle, SF, name)
    assert status == "ok", detail
