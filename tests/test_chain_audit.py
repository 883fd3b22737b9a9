"""Audit of chains against NumPy."""

import numpy as np
import pytest

from prismata.operators import chain_audit
from prismata.operators.chain import Chain


def _df(spark, x):
    return spark.createDataFrame([([float(v) for v in r],) for r in x], "spectrum array<double>").repartition(2)


def _msc(x, ref):
    b = ((x - x.mean(1, keepdims=True)) * (ref - ref.mean())).sum(1, keepdims=True) / ((ref - ref.mean()) ** 2).sum()
    return (x - (x.mean(1, keepdims=True) - b * ref.mean())) / b


def test_summary_equals_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((30, 9)) + 0.1, rng.random((20, 9)) + 0.1
    b[4, 2] = -1.0
    chains = {"raw": Chain(("raw",)), "absorbance": Chain(("absorbance",)), "snv": Chain(("snv",)), "msc": Chain(("msc",)), "sg": Chain(("sg_d1",), 5, 2)}
    summary, errors = chain_audit.audit(_df(spark, a), _df(spark, b), chains, saturation=(-50.0, 50.0))
    got = {r.chain: r for r in summary.collect()}
    snv = lambda x: (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    good = np.delete(b, 4, 0)
    want = {"raw": np.vstack([a, b]), "absorbance": -np.log10(np.vstack([a, good])), "snv": snv(np.vstack([a, b])), "msc": _msc(np.vstack([a, b]), a.mean(0))}
    for name, x in want.items():
        r = got[name]
        assert (r.n_fit, r.n_eval, r.n_filtered, r.n_features) == (30, len(x) - 30, 50 - len(x), 9)
        assert r.least == pytest.approx(x.min()) and r.largest == pytest.approx(x.max())
        full = (np.abs(x) >= 50).mean()
        assert r.saturation_rate == pytest.approx(full) and r.repeatability_error <= 1e-9 and r.zero_variance_rate == 0
        assert r.status == ("invalid" if full else "accepted")
    assert got["sg"].steps == "sg_d1" and got["sg"].window == 5 and errors.where("chain <> 'msc'").count() == 0


def test_faults_are_rows_with_a_reason(spark):
    flat = np.ones((4, 5))
    chains = {"msc": Chain(("msc",)), "raw": Chain(("raw",)), "absorbance": Chain(("absorbance",))}
    summary, errors = chain_audit.audit(_df(spark, flat), _df(spark, flat), chains)
    assert {r.chain: r.error for r in errors.collect()} == {"msc": "the MSC reference does not vary", "raw": "no band varies", "absorbance": "no band varies"}
    assert {r.status for r in summary.collect()} == {"invalid"} and summary.first().saturation_rate is None
    _, errors = chain_audit.audit(_df(spark, -flat), _df(spark, flat), {"absorbance": Chain(("absorbance",))})
    assert errors.first().error == "no row that the chain can take"
    ramp = np.arange(20.0).reshape(4, 5)
    _, errors = chain_audit.audit(_df(spark, ramp), _df(spark, ramp), {"raw": Chain(("raw",))}, saturation=(0.0, 100.0))
    assert errors.first().error == "saturated values"
