"""Agreement of annotations against plain labelling; errors and adjudication."""

import itertools

import pytest

from prismata.operators import annotations

CELL = "image string, row int, col int, annotator string, truth boolean, valid boolean"


def _parts(points):
    left, out = set(points), []
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            r, c = todo.pop()
            for p in itertools.product((r - 1, r, r + 1), (c - 1, c, c + 1)):
                if p in left:
                    left.discard(p)
                    found.add(p)
                    todo.append(p)
        out.append(found)
    return out


def _rows(who, art, valid=None, image="i"):
    out = []
    for r, line in enumerate(art):
        for c, x in enumerate(line):
            out.append((image, r, c, who, x == "#", valid is None or valid[r][c] == "+"))
    return out


A = ["##..#.", "##..#.", "......", "..##.."]
B = ["##..#.", "#...#.", "......", "......"]
VALID = ["++++++", "++++++", "+++++-", "++++++"]


def test_report_equals_plain_labelling(spark):
    rows = _rows("x", A) + _rows("y", B, VALID) + _rows("z", A) + _rows("x", B, image=None) + _rows("y", B, image=None)
    roi = spark.createDataFrame([(i, r, c) for i in ("i", None) for r in range(4) for c in range(6)] + [("lone", 0, 0)], "image string, row int, col int")
    got = {(r.image, r["first"], r.second): r for r in annotations.agreement_report(spark.createDataFrame(rows, CELL), roi).collect()}
    assert set(got) == {("i", "x", "y"), ("i", "x", "z"), ("i", "y", "z"), (None, "x", "y")}
    r = got["i", "x", "y"]
    a, b = ({(i, j) for i, line in enumerate(m) for j, x in enumerate(line) if x == "#"} for m in (A, B))
    assert r.dice == pytest.approx(2 * len(a & b) / (len(a) + len(b))) and r.iou == pytest.approx(len(a & b) / len(a | b))
    assert (r.n_roi_pixels, r.n_pairwise_valid, r.ambiguous_rate_first) == (24, 23, 0) and r.ambiguous_rate_second == pytest.approx(1 / 24) == pytest.approx(1 - r.validity_agreement)
    assert (r.n_components_first, r.n_components_second, r.n_matched) == (len(_parts(a)), len(_parts(b)), 2)
    assert r.unmatched_component_rate == pytest.approx(1 / 5) and r.status == "adjudication_required"
    assert not r.unmatched_rate_passed and not r.dice_passed
    assert got["i", "x", "z"].status == got[None, "x", "y"].status == "accepted" and got["i", "x", "z"].unmatched_component_rate == 0


def test_nothing_valid_together(spark):
    rows = _rows("x", ["#."], ["+-"]) + _rows("y", ["#."], ["-+"])
    roi = spark.createDataFrame([("i", 0, 0), ("i", 0, 1)], "image string, row int, col int")
    r = annotations.agreement_report(spark.createDataFrame(rows, CELL), roi).first()
    assert r.status == "no_joint_pixel" and r.n_pairwise_valid == 0 and r.dice is None
    assert annotations.agreement_report(spark.createDataFrame([], CELL), roi).count() == 0


def test_every_disagreement_needs_a_valid_decision(spark):
    report = spark.createDataFrame([(i, "adjudication_required" if i != "ok" else "accepted") for i in ("ok", "done", "none", "open", "half", "lost")], "image string, status string")
    decisions = [("done", "open", None, None, None, None), ("done", "adjudicated", "p", "d", "j", "r1"), ("open", "proposed", "p", "d", "j", "r1"), ("half", "adjudicated", "p", "d", " ", "r1"), ("lost", "adjudicated", "p", "d", "j", "r9")]
    df = spark.createDataFrame(decisions, "image string, status string, adjudicator string, date string, justification string, reference_id string")
    gaps = annotations.adjudication_gaps(report, df, spark.createDataFrame([("r1",)], "reference_id string"))
    assert {r.image: r.reason for r in gaps.collect()} == {"none": "missing", "open": "not_adjudicated", "half": "incomplete", "lost": "unknown_reference"}


def test_errors_are_named_and_refused(spark):
    masks = spark.createDataFrame([("i", 0, 0, True, True), ("i", 0, 1, True, False), ("i", 9, 9, True, None), ("i", 9, 8, False, None)], "image string, row int, col int, truth boolean, valid boolean")
    area = spark.createDataFrame([("i", 0, 0), ("i", 0, 1)], "image string, row int, col int")
    got = {(r.row, r.col, r.error) for r in annotations.annotation_errors(masks, ["image"], area).collect()}
    assert got == {(0, 1, "invalid_positive"), (9, 9, "outside_area"), (9, 9, "invalid_positive")}
    assert annotations.refuse_errors(masks.where("valid OR NOT truth"), area).count() == 2
    with pytest.raises(Exception, match="positive pixel"):
        annotations.refuse_errors(masks, area).collect()
