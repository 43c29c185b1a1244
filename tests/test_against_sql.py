"""Queries against the same question in SQL, over the smallest tables."""

import os

import duckdb
import pytest

from needledrop.plans import ORACLE_SQL, QUERIES
from needledrop.plans.adapters import BASE

SF = "/root/testdata/sf0.001"
#: One or more of each family; the whole set is compared by the driver.
NAMES = (
    "minimum_slice_albums_needing_work", "a1_catalog_scan", "a9_recording_candidates", "b1_upsert", "b3_incremental_diff", "b7_relocate", "b9_apply_patches", "b17_undo_restore", "c1_facet_filter", "c4_facet_counts",
    "c5_distinct_genres", "d3_metadata_tier", "d4_name_tier", "d8_connected_components", "d12_group_pruning", "d13_album_clusters", "e4_tempo_tally", "e6_phase_report", "e9_paired_runs", "f4_core_title", "f10_parse_key",
    "f19_location_and_facts", "g1_replace_contents", "g5_move_block", "k1_collection_export", "k2_round_trip", "m1_purchase_matches", "m4_field_suggestions", "r1_album_items", "r4_folder_tree", "r5_group_summary",
    "a2_file_inventory", "a7_json_snapshot", "a8_purchase_ingest", "a10_page_data", "b16_undo_retention", "b17_undo_pop", "f17_conversion_plan", "f18_collision_free_names", "f20_waveform_blob", "k1_document",
    "m2_collection_origins", "m5_candidate_lookup", "t5_progress_by_stage", "x10_beat_phase", "x12_chroma", "x15_feature_job",
    "r6_playlist_groups", "x2_framed_spectrum", "x8_octave_folding", "x14_waveform", "t2_patch_coalescing", "t3_patch_application",
    "a1_snapshot_scan", "a5_collection_reader", "a5_dropped_rows", "b1_snapshot_upsert", "b5_snapshot_prune", "d5_content_work_list", "d7_content_tier", "d15_lone_groups", "f15_natural_key", "s2_natural_collation", "t1_watch_stream",
    "t1_notice_bursts", "t2_patch_windows", "t6_superseded_runs", "t7_event_log_stream",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect())
    want = sorted(repr(plain(r)) for r in sql.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
