"""Correlations where one side does not move."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tapeworks.operators import research

START = datetime(2024, 1, 1)


def series(spark, signal, ret):
    rows = [("B", f"e{i:03d}", START + timedelta(minutes=i), s, r) for i, (s, r) in enumerate(zip(signal, ret))]
    return spark.createDataFrame(rows, "instrument string, event_id string, event_time timestamp, obi double, fwd_ret double")


def test_rolling_correlation_of_a_still_stretch_is_unknown(spark):
    rng = np.random.default_rng(3)
    signal, ret = rng.normal(size=30).tolist(), rng.normal(size=30).tolist()
    signal[5:12] = [0.25] * 7
    ret[20] = None
    got = {r["event_id"]: r for r in research.rolling_corr(series(spark, signal, ret), window=4).collect()}
    assert len(got) == 30
    for i in range(30):
        span = [(s, r) for s, r in zip(signal[max(0, i - 3):i + 1], ret[max(0, i - 3):i + 1]) if r is not None]
        found = got[f"e{i:03d}"]
        assert found["n"] == min(i + 1, 4)
        if len(span) < 2 or len({s for s, _ in span}) == 1:
            assert found["corr"] is None
        else:
            assert found["corr"] == pytest.approx(np.corrcoef(np.array(span).T)[0, 1])


def test_information_coefficient_of_one_signal_is_unknown(spark):
    still = research.information_coefficient(series(spark, [0.5] * 6, [0.1, 0.2, -0.1, 0.3, 0.0, 0.4])).collect()
    assert [(r["instrument"], r["n"], r["ic"]) for r in still] == [("B", 6, None)]
    moves = research.information_coefficient(series(spark, [0.1, 0.2, 0.3, 0.4], [1.0, 2.0, 3.0, 5.0])).first()
    assert moves["ic"] == pytest.approx(1.0)
