"""The bootstrap of rows: every row has a weight of its own in every replicate."""

import hashlib

import numpy as np
import pytest

from cohortlens.catalog import load_all
from cohortlens.plans import measures


def test_each_row_is_drawn_by_itself(spark):
    data = [("g", i, int(i % 3 == 0)) for i in range(30)]
    got = measures.bootstrap_ci(spark.createDataFrame(data, "grp string, id int, y int"), "grp", "y", "id", b=16).first()
    means = []
    for r in range(16):
        digits = [hashlib.md5(f"{i}#0#{r // 8}".encode()).hexdigest()[4 * (r % 8):4 * (r % 8) + 4] for _, i, _ in data]
        w = [sum(int(h, 16) >= step for step in measures.POISSON_STEPS) for h in digits]
        means.append(sum(a * y for a, (_, _, y) in zip(w, data)) / sum(w))
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_the_query_draws_rows():
    assert "md5(concat_ws('#', id, '0'" in load_all()[1]["m28_bootstrap_ci"]
