"""Plans: no cross products, pruned scans, pushed filters, partial sums before shuffles."""

import re

import pytest

from weftline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
LAZY = ["asof_section", "nearest_hits", "range_diffs", "cue_sessions", "overlap_trim", "unique_texts", "pack_override", "edit_similarity", "passage_votes", "theil_sen_rate", "merge_fragments", "gap_interpolation", "removed_spans", "fixed_spans", "gram_index", "ctc_collapse", "passage_exact", "passage_dice", "post_process", "cue_build", "book_walk", "retime_on_speech", "reference_alignment"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_products(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark):
    text = plan(QUERIES["asof_section"](spark, SF))
    assert all("value" not in s and "props" not in s for s in re.findall(r"ReadSchema: (\S+)", text))
    assert re.findall(r"ReadSchema: (\S+)", plan(QUERIES["decode_stats"](spark, SF))) == ["struct<l_quantity:double,l_returnflag:string>"]


def test_filters_are_pushed(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan(QUERIES["nearest_hits"](spark, SF))


def test_sums_before_shuffles(spark):
    assert "partial_count" in plan(QUERIES["tumbling_buckets"](spark, SF))
