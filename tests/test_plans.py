"""Plans: pixels are never the side of a join that is sent to all tasks."""

from __future__ import annotations

import pytest

from pixelmill.plans import catalogue


def _below_broadcasts(df) -> list[str]:
    """Nodes of the physical plan that stand below a broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[k + 1 :]:
                if depth(below) <= depth(line):
                    break
                found.append(below.strip(" :+-*"))
    return found


@pytest.mark.parametrize("name", ["a10_content_bounds", "g1_crop", "g2_transform", "g3_auto_trim", "g4_resize_nearest", "g5_resize_bilinear", "g7_remap", "g8_apply_edits"])
def test_pixels_are_not_broadcast(spark, name):
    below = _below_broadcasts(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not [b for b in below if "Generate" in b or "Aggregate" in b]
