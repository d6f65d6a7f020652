"""Registered queries against their SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract
from reelspark.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each kind; the driver compares all.
COMPARED = """kis_search rrf_fusion interval_overlap_join nearest_frame_join speaker_join neighbour_join frame_context_join bounded_scenes event_alignment
ordered_events window_coalescing scene_representatives object_summaries recall_at caption_report snapshot_delta answer_keys context_text map_functions acquire_evidence
evaluation_state early_diversity weight_calibration answer_ranking gap_repair scene_order temporal_phrases bundle_round_trip scan_mapping_csv stream_tumbling session_windows
relation_satisfaction scene_scores acquire_log bundle_search evidence_build enrichment_build uniform_lineage answer_questions json_functions submission_dedup
trace_summary reduce_groups ocr_report""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number)):
        return round(float(v), 6)
    return v


def _rows(df):
    return sorted((tuple(map(_plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", COMPARED)
def test_same_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want) and len(got)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_procedural_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_replay_says_what_the_stream_says(spark):
    q = registry.queries()
    assert _rows(q["session_replay"](spark, SF).toPandas()) == _rows(q["session_stream"](spark, SF).toPandas())


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_gold_below_rank_50_counts(spark, tmp_path):
    rows = [(0, 0, [1.0, 0.0])] + [(i, 1, [1.0, 0.0]) for i in range(1, 71)] + [(71, 0, [0.5, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.cutoff: (r.recall, r.queries, r.failures) for r in registry.queries()["recall_at"](spark, str(tmp_path)).collect()}
    assert got[50] == (0.75, 4, 0) and got[100] == (1.0, 4, 0)  # of the queries 0, 20, 40 and 60 the first has its gold at rank 72
