"""Queries without SQL: what must hold of their results whatever the fit."""

import __spark_entry__ as entry


def test_states_cover_every_row_once(spark, folder):
    rows = entry.queries()["kmeans_states"](spark, folder).collect()
    from tapeglass.plans.research import _features

    assert sum(r.n for r in rows) == _features(spark, folder).count()
    assert len({(r.split, r.state) for r in rows}) == len(rows) and {r.state for r in rows} <= set(range(6))


def test_importance_is_measured_on_one_model(spark, folder):
    rows = entry.queries()["permutation_importance"](spark, folder).collect()
    assert len(rows) == 5 and len({r.auc for r in rows}) == 1
    assert all(0 <= r.auc <= 1 and -1 <= r.auc_loss <= 1 for r in rows)


def test_draws_repeat():
    import numpy as np

    from tapeglass.operators.resampling import _blocks

    at = _blocks(100, 5, 400, 11)
    assert at.shape == (400, 100) and (at == _blocks(100, 5, 400, 11)).all() and (_blocks(100, 5, 400, 12) != at).any()
    assert ((np.diff(at.reshape(400, 20, 5), axis=2) % 100) == 1).all()
    assert 0.8 < np.bincount(_blocks(50, 1, 2000, 3).ravel(), minlength=50).min() / 2000 and np.bincount(_blocks(50, 1, 2000, 3).ravel()).max() / 2000 < 1.2
