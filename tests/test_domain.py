"""Eligibility with its reasons."""

import pytest

from prismata.operators import domain

LIMITS = {"standardized_shift": (1.5, 3.0), "ood": (0.1, 0.3), "rejection": (0.1, 0.4)}


def test_every_status_and_reason(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("fine", 1.0, -1.5, 0.1, 0.0, True), ("fine", 0.2, 0.3, 0.0, 0.1, True), ("warned", -2.0, 0.0, 0.2, 0.0, True), ("shifted", 3.1, 0.0, 0.2, 0.5, True), ("unknown", nan, 0.0, 0.0, 0.0, True), ("endless", 0.0, 0.0, inf, 0.0, True),
        ("short", 0.0, 0.0, 0.0, 0.0, True), ("short", 9.0, 9.0, 9.0, 9.0, False), ("blank", 0.0, None, 0.0, None, True), ("only", 1.0, 1.0, 0.0, 0.0, None), (None, 0.0, 0.0, 0.0, 0.0, True), ("extra", 0.0, 0.0, 0.0, 0.0, True),
    ]
    df = spark.createDataFrame(rows, "track string, q double, h double, ood double, rejection double, ok boolean")
    tracks = spark.createDataFrame([(t,) for t in ("fine", "warned", "shifted", "unknown", "endless", "short", "blank", "only", None, "absent", "fine")], "track string")
    got = {r.track: r for r in domain.eligibility(df, tracks, "track", ["q", "h"], ["ood", "rejection"], LIMITS, "ok").collect()}
    assert {t: (r.status, r.reasons) for t, r in got.items()} == {
        "fine": ("eligible", domain.SATISFIED), None: ("eligible", domain.SATISFIED), "warned": ("eligible_with_warning", "standardized_shift;ood"), "shifted": ("unsupported_domain_shift", "standardized_shift;rejection"),
        "unknown": ("unsupported_domain_shift", "standardized_shift_not_finite"), "endless": ("unsupported_domain_shift", "ood_not_finite"), "short": ("unsupported_domain_shift", domain.SUPPORT), "blank": ("unsupported_domain_shift", "standardized_shift_not_finite;rejection_not_finite"),
        "only": ("unsupported_domain_shift", f"{domain.SUPPORT};standardized_shift_not_finite;ood_not_finite;rejection_not_finite"), "absent": ("unsupported_missing_diagnostics", domain.MISSING),
    }
    assert got["warned"].max_standardized_shift == 2.0 and got["short"].max_ood == 0 and got["unknown"].max_standardized_shift is None and got["fine"].n_diagnostics == 2


def test_limits_must_be_complete(spark):
    df = spark.createDataFrame([], "track string, q double, ood double, ok boolean")
    with pytest.raises(ValueError, match="limits"):
        domain.eligibility(df, df, "track", ["q"], ["ood"], {"ood": (0, 1)}, "ok")
    assert domain.eligibility(df, df, "track", ["q"], ["ood"], {"ood": (0, 1), "standardized_shift": (1, 2)}, "ok").count() == 0
