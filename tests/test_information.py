import numpy as np

from tapeglass.plans.panel import corrected_information, mutual_information, mutual_information_corrected


def test_null_equals_that_of_shuffled_labels():
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 10, 3000), rng.integers(0, 2, 3000)

    def table(y):
        return np.bincount(x * 2 + y, minlength=20).reshape(10, 2)

    def bits(c):
        p = c / c.sum()
        return float((p * np.log2(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())

    raw, null, left = corrected_information(table(y), times=4000)
    shuffled = np.quantile([bits(table(rng.permutation(y))) for _ in range(4000)], 0.95)
    assert abs(raw - bits(table(y))) < 1e-12 and abs(null / shuffled - 1) < 0.05 and left == max(0.0, raw - null)
    assert corrected_information(table((x > 4).astype(int)))[2] > 0.9


def test_corrected_query_goes_with_the_raw_one(spark, folder):
    a, b = mutual_information(spark, folder).first(), mutual_information_corrected(spark, folder).first()
    assert a.n == b.n and abs(a.mutual_information - b.mutual_information) < 1e-6
    assert 0 < b.null_95 and b.corrected == max(0.0, b.mutual_information - b.null_95)
