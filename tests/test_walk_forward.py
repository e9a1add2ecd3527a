import datetime as dt

from tapeglass.plans.research import gbt_walk_forward, walk_forward


def test_folds_expand_by_year_and_keep_the_embargo(spark):
    days = [dt.date(2021, 6, 1) + dt.timedelta(days=k) for k in range(800) if k % 7 < 5]
    folds = walk_forward(spark.createDataFrame([(x,) for x in days], "day date"), 2)
    assert [y for y, _, _ in folds] == [2022, 2023]
    for y, train, test in folds:
        last = max(x for x in days if x.year < y)
        assert sorted(r.day for r in train.collect()) == [x for x in days if x <= last - dt.timedelta(days=2)]
        assert sorted(r.day for r in test.collect()) == [x for x in days if x.year == y]
    assert walk_forward(spark.createDataFrame([(days[0],)], "day date")) == []


def test_one_row_per_model_and_test_year(spark, folder):
    assert sorted((r.model, r.test_year) for r in gbt_walk_forward(spark, folder).collect()) == [("gbt", 2024), ("logistic", 2024)]
