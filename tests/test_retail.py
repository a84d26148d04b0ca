import datetime as dt
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.operators import anomaly, boosting, features, isolation, optimize, rules
from shelfspark.operators.weekly import competitor_week_median, promo_weeks, weekly_sales, weekly_sales_price
from shelfspark.plans import queries
from shelfspark.sources import retail

SALES = "timestamp timestamp, product_id long, qty long, unit_price double"
PRODUCTS = "product_id long, cost_price double, min_margin double, min_price double, current_price double, threshold_min int, threshold_max int, current_stock int"
PRICES = "product_id long, competitor_id long, competitor_price double, collected_at timestamp, status string"
ORDER = ["collected_at", "competitor_price"]


def day(n):
    return dt.datetime(2025, 1, 6) + dt.timedelta(days=n)


def weeks(spark, lengths, gap=None):
    rows = [(day(7 * k + (7 if gap is not None and k >= gap else 0)), p, k + 1, 2.0) for p, n in lengths.items() for k in range(n)]
    return spark.createDataFrame(rows, SALES)


def test_week_boundaries_and_nulls(spark):
    rows = [(dt.datetime(2026, 1, 4, 23, 59), 1, 5, 1.0), (dt.datetime(2026, 1, 5), 1, 7, 3.0), (dt.datetime(2026, 1, 6), 1, None, 5.0), (None, 1, 9, 1.0), (dt.datetime(2026, 1, 5), None, 9, 1.0), (dt.datetime(2026, 1, 5), 2, None, None)]
    got = sorted(map(tuple, weekly_sales_price(spark.createDataFrame(rows, SALES)).collect()))
    assert got == [(1, dt.date(2025, 12, 29), 5, 1.0), (1, dt.date(2026, 1, 5), 7, 4.0), (2, dt.date(2026, 1, 5), 0, None)]


def test_promotions(spark):
    rows = [(1, dt.date(2024, 12, 23), dt.date(2025, 1, 6), "REJECTED"), (1, dt.date(2024, 12, 31), dt.date(2025, 1, 1), "ACTIVE"), (2, dt.date(2025, 5, 9), dt.date(2025, 5, 1), "ACTIVE"), (3, None, dt.date(2025, 5, 1), "ACTIVE")]
    got = promo_weeks(spark.createDataFrame(rows, "product_id long, start_date date, end_date date, status string"))
    assert sorted((r.product_id, r.week) for r in got.collect()) == [(1, dt.date(2024, 12, 23)), (1, dt.date(2024, 12, 30)), (1, dt.date(2025, 1, 6))]
    assert got.filter("week = '2024-12-30'").select(F.weekofyear("week")).first()[0] == 1


@pytest.mark.parametrize("n", [1, 3, 4, 7, 8, 9])
def test_baseline(spark, n):
    r = rules.demand_baseline(weekly_sales(weeks(spark, {1: n}))).first()
    last = np.arange(1, n + 1)[-8:]
    assert (r.history_weeks, r.last_week) == (n, day(7 * (n - 1)).date())
    assert (r.p10, r.p50, r.p90) == pytest.approx((np.percentile(last, 10), last.mean(), np.percentile(last, 90)))


def test_lags_are_positional_and_deviations_differ(spark):
    weekly = weekly_sales(weeks(spark, {1: 6, 2: 4, 3: 3}, gap=2))
    train = sorted(features.training_features(weekly).collect(), key=lambda r: r.week)
    assert [(r.product_id, r.qty, r.lag_1, r.lag_4) for r in train] == [(1, 5, 4.0, 1.0), (1, 6, 5.0, 2.0)]
    assert train[0].roll_std_4 == pytest.approx(np.std([1, 2, 3, 4], ddof=1))
    serve = {r.product_id: r for r in features.serving_features(weekly).collect()}
    assert serve[1].roll_std_4 == pytest.approx(np.std([3, 4, 5, 6]))
    assert (serve[2].lag_1, serve[2].lag_4, serve[2].last_weeks) == (4.0, 1.0, 4)
    assert serve[3].lag_4 is None
    assert serve[3].roll_mean_4 is None


def test_datasets_keep_the_rows(spark):
    sales = weeks(spark, {1: 9, 2: 5})
    prices = spark.createDataFrame([(1, c, 10.0 + c, day(35), "OK") for c in range(4)], PRICES)
    promos = spark.createDataFrame([(1, day(35).date(), day(36).date()), (1, day(36).date(), day(40).date())], "product_id long, start_date date, end_date date")
    data = features.price_dataset(sales, prices, promos)
    assert data.count() == features.lag_features(weekly_sales(sales)).count() == 6
    row = data.filter("product_id = 1 and week = date '2025-02-10'").first()
    assert (row.comp_median, row.promo_flag) == (11.5, 1)
    other = data.filter("product_id = 2").first()
    assert (other.comp_median, other.promo_flag) == (2.0, 0)
    assert features.promo_dataset(sales, prices, promos).filter("discount != 0").count() == 0


def test_competitor_median_counts_all_states(spark):
    prices = spark.createDataFrame([(1, 1, 1.0, day(0), "ERROR"), (1, 2, 2.0, day(1), None), (1, 3, 9.0, day(2), "OK"), (1, 4, None, day(2), "OK")], PRICES)
    assert competitor_week_median(prices).first().comp_median == 2.0


def test_lead_times_and_rules(spark):
    suppliers = spark.createDataFrame([(1, 9, 3, True), (1, 4, 12, True), (1, 1, 2, False), (2, 1, 5, None)], "product_id long, supplier_id long, lead_time_days int, is_preferred boolean")
    products = spark.createDataFrame([(1, 1.0, 0.1, 1.1, 2.0, 5, 50, 20), (2, 1.0, 0.1, 1.1, 2.0, 0, 0, 20)], PRODUCTS)
    got = {r.product_id: r.lead_time_days for r in rules.restock_rules(products, suppliers).collect()}
    assert got == {1: 12, 2: 7}


def test_stock_risk(spark):
    rule = spark.createDataFrame([(1, 10, 50, 5, 7), (2, 0, 0, 1000, 7), (3, 10, 50, 40, 14), (5, 10, 50, 40, 7)], "product_id long, threshold_min int, threshold_max int, current_stock int, lead_time_days int")
    demand = spark.createDataFrame([(1, 3.0, 4.0), (2, 1.0, 1.0), (3, 2.0, 15.0)], "product_id long, p50 double, p90 double")
    got = {r.product_id: r for r in rules.stock_risk(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "product_id long"), demand, rule).collect()}
    assert (got[1].risk, got[1].probability) == ("STOCKOUT", pytest.approx(0.95))
    assert (got[2].risk, got[2].probability) == ("OVERSTOCK", 0.90)
    assert (got[3].risk, got[3].probability) == ("OK", 0.10)
    assert got[3].explanation == "Stock OK: stock=40, seuils=[10,50], besoin lead-time(p90)≈30.0."
    assert (got[4].risk, got[4].probability, got[4].lead_time_days, got[4].demand_weekly_p50) == ("OK", 0.0, 7, 0.0)
    assert got[4].explanation == "Produit introuvable dans restock_rules."
    assert (got[5].risk, got[5].demand_weekly_p90) == ("OK", 0.0)


def test_anomaly_features(spark):
    rows = [(1, 1, 0.0, day(0), "OK"), (1, 1, 10.0, day(1), "OK"), (1, 1, 5.0, day(3), None), (1, 2, None, day(0), "OK"), (1, 2, 10.0, day(1), "ERROR"), (1, 2, 20.0, day(2), "ERROR"), (2, 1, 7.0, day(0), "OK"), (2, 1, 7.0, day(5), "OK")]
    prices = spark.createDataFrame(rows, PRICES)
    products = spark.createDataFrame([(1, 1.0, 0.1, 1.1, 10.0, 5, 50, 20), (2, 1.0, 0.1, 1.1, 0.0, 5, 50, 20)], PRODUCTS)
    train = {(r.product_id, r.competitor_id, r.collected_at): r for r in anomaly.training_dataset(prices, products, ORDER).collect()}
    assert set(train) == {(1, 1, day(1)), (1, 2, day(2)), (2, 1, day(5))}
    assert (train[1, 1, day(1)].delta_pct, train[1, 2, day(2)].delta_pct) == (0.0, 1.0)
    assert train[1, 2, day(2)].status_bad == 1
    assert (train[2, 1, day(5)].log_ratio, train[2, 1, day(5)].gap_hours) == (0.0, 120.0)
    serve = {(r.product_id, r.competitor_id, r.collected_at): r for r in anomaly.serving_rows(prices, products, ORDER).collect()}
    assert len(serve) == 8
    assert serve[1, 2, day(0)].log_ratio is None
    assert serve[1, 1, day(3)].status_bad == 1
    assert serve[1, 1, day(0)].gap_hours == 24.0
    assert serve[2, 1, day(0)].log_ratio == pytest.approx(math.log(1e6))


def test_rule_findings(spark):
    prices = spark.createDataFrame([(1, 1, 9.0, day(0), "OK"), (1, 1, 1.0, day(1), "OK"), (1, 2, 6.0, day(0), "ERROR"), (2, 1, 10.0, day(0), "OK")], PRICES)
    products = spark.createDataFrame([(1, 5.0, 0.1, 5.5, 10.0, 5, 50, 20), (2, 5.0, 0.1, 5.5, 10.0, 5, 50, 20)], PRODUCTS)
    got = sorted(anomaly.rule_findings(prices, products, ORDER).collect(), key=lambda r: r.place)
    assert [(r.product_id, r.type, r.severity) for r in got] == [(1, "SUSPECT_COMPETITOR_PRICE_TOO_LOW", "HIGH"), (1, "COMPETITIVE_SHOCK", "MEDIUM"), (1, "SCRAPING_STATUS_NOT_OK", "LOW")]
    assert got[0].detail == "1 prix concurrents < ~90% du coût."


def context(spark, rows):
    return spark.createDataFrame(rows, "product_id long, cost_price double, min_price double, current_price double, comp_median double, promo_flag int, current_stock int, threshold_max int")


def flat(q):
    return lambda rows: rows.withColumns({c: F.lit(q) for c in ("q10", "q50", "q90")})


def test_price_search(spark):
    rows = context(spark, [(1, 5.0, 6.0, 10.0, 8.0, 0, 1, 1), (2, 5.0, 6.0, 10.0, 30.0, 1, 1, 1)])
    got = {r.product_id: r for r in optimize.optimise_price(rows, flat(0.0)).collect()}
    assert got[1].recommended_price == got[1].interval.low == 8.0  # all profits are equal: the first candidate
    got = {r.product_id: r for r in optimize.optimise_price(rows, flat(2.0)).collect()}
    assert (got[1].recommended_price, got[1].direction, got[1].estimated_margin_impact_week) == (12.0, "INCREASE", 4.0)
    assert got[2].recommended_price == pytest.approx(33.0)
    prices = [r.price for r in optimize.price_candidates(rows.filter("product_id = 2")).filter("candidate >= 0").orderBy("candidate").collect()]
    assert prices == pytest.approx(list(np.linspace(8.0, 33.0, 25)))


def test_promotion_search(spark):
    rows = context(spark, [(1, 5.0, 9.0, 10.0, 8.0, 0, 1, 9), (2, 5.0, 11.0, 10.0, 8.0, 0, 1, 9), (3, 5.0, 7.5, 10.0, 8.0, 0, 99, 9)])
    sells = lambda r: r.withColumns({c: F.col("discount") * 100 + 1 for c in ("q10", "q50", "q90")})
    got = {r.product_id: r for r in optimize.optimise_promo(rows, sells).collect()}
    assert (got[1].should_promote, got[1].recommended_discount) == (True, 0.10)
    assert (got[2].should_promote, got[2].promo_price, got[2].demand_weekly) == (False, 10.0, None)
    assert got[2].explanation.startswith("Promo ML: aucune remise")
    assert got[3].recommended_discount == 0.25
    assert {r.product_id: r.recommended_discount for r in optimize.optimise_promo(rows, flat(3.0)).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_restock_equals_simulation(spark):
    rng = np.random.default_rng(1)
    products, demand, want = [], [], {}
    for i in range(60):
        stock, least, most = int(rng.integers(0, 80)), int(rng.integers(0, 30)), int(rng.integers(1, 120))
        p50 = float(rng.uniform(0, 40))
        p10, p90 = p50 * 0.5, p50 * float(rng.uniform(0.5, 2))
        products.append((i, 1.0, 0.1, 1.1, 2.0, least, most, stock))
        demand.append((i, p10, p50, p90))
        sigma = max(1e-6, (p90 - p10) / 2.56)
        d = np.clip(np.random.default_rng(42).normal(p50, sigma, 5000), 0, None)
        costs = [15 * np.clip(d - stock - q, 0, None).mean() + np.clip(stock + q - d, 0, None).mean() + 2 * max(0.0, stock + q - most) for q in range(max(1, math.ceil(p50 + 3 * sigma + least + 10) + 1))]
        want[i] = round(min(costs), 4)
    got = optimize.optimise_restock(spark.createDataFrame(products, PRODUCTS), spark.createDataFrame(demand, "product_id long, p10 double, p50 double, p90 double")).collect()
    assert {r.product_id: r.estimated_impact.expected_cost for r in got} == pytest.approx(want, rel=1e-9)


def test_boosting_beats_constants():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (1500, 3))
    y = 10 * x[:, 0] + rng.normal(0, 1 + x[:, 1], 1500)
    for alpha in boosting.ALPHAS:
        start, trees = boosting.fit_trees(x, y, alpha, 120)
        rows = [{"tree": -1, "value": [start]}, *[{"tree": t, "feature": f, "threshold": th, "value": v} for t, (f, th, v) in enumerate(trees)]]
        guess = boosting.Ensemble(rows).predict(x)
        loss = lambda g: np.where(y > g, alpha * (y - g), (1 - alpha) * (g - y)).mean()  # noqa: B023, E731
        assert loss(guess) < 0.6 * loss(np.full(len(y), np.quantile(y, alpha)))
        assert abs((y <= guess).mean() - alpha) < 0.06


def test_boosting_over_tables(spark):
    rows = features.training_features(weekly_sales(weeks(spark, {p: 12 for p in range(20)})))
    models = boosting.ensembles(boosting.fit(rows, features.DEMAND_FEATURES, "qty", 30))
    out = boosting.score(rows, features.DEMAND_FEATURES, models, {0.1: "a", 0.5: "b", 0.9: "c"})
    r = out.orderBy(F.desc("qty")).first()
    assert r.c >= 8
    missing = out.drop("a", "b", "c").withColumn("lag_1", F.lit(None).cast("double"))
    assert boosting.score(missing, features.DEMAND_FEATURES, models, {0.5: "b"}).filter("b is not null").count() == 0


def test_forest_isolates_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(0, 1, 2))) for i in range(1000)] + [(1000 + i, 9.0 + i, -9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    model = isolation.forest(isolation.fit(df, ["a", "b"], ["id"], trees=100))
    scored, offset = isolation.decision(isolation.score(df, ["a", "b"], model))
    assert -1 < offset < -0.4
    worst = [r.id for r in scored.orderBy("score").limit(5).collect()]
    assert set(worst) == set(range(1000, 1005))
    assert 0.03 < scored.filter("score < 0").count() / 1005 < 0.07


def test_forest_walks_equal_a_plain_walk():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (9000, 3)).round(1)
    grown = [isolation.grow(x[rng.integers(0, 9000, 256)], t) for t in range(20)]
    model = isolation.Forest([{"tree": t, "feature": f, "threshold": h, "path": p, "sampled": 256} for t, (f, h, p) in enumerate(grown)])
    got, norm = model.score(x), float(isolation.average_path(256))
    for i in range(0, 9000, 500):
        paths = []
        for f, h, p in grown:
            k = 0
            while np.isfinite(h[k]):
                k = 2 * k + 1 + int(x[i, f[k]] >= h[k])
            paths.append(p[k])
        assert got[i] == pytest.approx(-(2.0 ** (-np.mean(paths) / norm)), rel=1e-12)


def test_only_latest_prices_are_scored_to_be_explained(spark, monkeypatch):
    rows, score = [], isolation.score
    monkeypatch.setattr(isolation, "score", lambda df, *more: rows.append(df.count()) or score(df, *more))
    d = "/root/testdata/sf0.001"
    queries.QUERIES["anomaly_detect_ml"](spark, d)
    prices = retail.competitor_prices(spark, d)
    assert rows[-1] == prices.select("product_id", "competitor_id").distinct().count() < prices.count()


@pytest.mark.parametrize("name", ["score_quantile", "anomaly_explain"])
def test_rows_to_score_are_worked_out_once(spark, monkeypatch, name):
    held, score, quantiles = [], isolation.score, queries.exact_quantiles_of
    monkeypatch.setattr(isolation, "score", lambda df, *more: held.append(df.storageLevel.useMemory) or score(df, *more))
    monkeypatch.setattr(queries, "exact_quantiles_of", lambda df, *more, **how: held.append(df.storageLevel.useMemory) or quantiles(df, *more, **how))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    # The cuts, then the scores; last of all come the latest rows, which are few.
    assert held[:2] == [True, True]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_walks_are_as_long_as_the_trees_are_deep():
    cuts = {0: 0.5, 1: 0.2, 5: 0.7}
    threshold = np.array([cuts.get(k, np.inf) for k in range(isolation.NODES)])
    tree = {"tree": 0, "feature": np.zeros(isolation.NODES, dtype=int), "threshold": threshold, "path": np.arange(isolation.NODES, dtype=float), "sampled": 256}
    forest = isolation.Forest([tree])
    assert forest.depth == 3
    leaves = np.array([3, 4, 2 * 5 + 1, 2 * 5 + 2, 6])  # nodes of 0.1, 0.3, 0.6 and 0.8 by cuts at 0, 1, 2 and 5
    forest = isolation.Forest([tree | {"threshold": np.where(np.arange(isolation.NODES) == 2, 0.9, threshold)}])
    assert forest.score(np.array([[0.1], [0.3], [0.6], [0.8], [0.95]])) == pytest.approx(-(2.0 ** (-leaves / isolation.average_path(256))))
    assert isolation.Forest([tree | {"threshold": np.full(isolation.NODES, np.inf)}]).depth == 0


def test_explained_scores(spark):
    stats = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 1.0, 1.0, 5.0, 0.0)], ", ".join(f"{c}_mean double" for c in anomaly.FEATURES) + ", " + ", ".join(f"{c}_std double" for c in anomaly.FEATURES))
    rows = [(1, 1, day(0), -1.0, 0.0, 0.0, 12.0, 0), (1, 1, day(1), -0.01, 0.0, 3.0, 12.0, 0), (1, 2, day(0), -0.2, 0.0, 3.0, 12.0, 1), (2, 1, day(0), 0.4, 0.0, 0.0, 10.0, 0)]
    scored = spark.createDataFrame(rows, "product_id long, competitor_id long, collected_at timestamp, score double, log_ratio double, delta_pct double, gap_hours double, status_bad int")
    rows += [(3, 1, day(0), -9.0, 0.0, 0.0, 10.0, 0), (3, 1, day(1), None, None, 0.0, 10.0, 0)]
    scored = spark.createDataFrame(rows, scored.schema)
    got = {r.product_id: r.anomalies for r in anomaly.explain_scores(scored, stats, spark.createDataFrame([(0.0,)], "threshold double"), ["collected_at"]).collect()}
    assert [a.severity for a in got[1]] == ["MEDIUM", "HIGH"]
    assert "Variation du prix" in got[1][0].detail
    assert "statut non OK" in got[1][1].detail
    assert got[2] == []
    assert got[3] == []  # the latest row has no price: the earlier one doesn't stand in for it


def test_boosting_fits_all_rows(spark):
    rows = spark.range(30_000).selectExpr("id AS product_id", "0 AS week", "id % 10 AS f")
    order = Window.orderBy(F.xxhash64("product_id", "week"))
    # Only rows beyond the first 20,000 by hash have a quantity: a fit to part of them starts at 0.
    rows = rows.withColumn("qty", (F.row_number().over(order) > 20_000).cast("double"))
    model = boosting.fit(rows, ["f"], "qty", 1, alphas=(0.9,))
    assert boosting.ensembles(model)[0.9].start == 1.0


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, i % 50, *map(float, rng.normal(0, 1, 3)), float(rng.exponential(9))) for i in range(n)]


def test_trees_do_not_depend_on_how_rows_are_dealt(spark):
    df = spark.createDataFrame(made(3000), "week long, product_id long, a double, b double, c double, y double")
    fits = [sorted(map(tuple, boosting.fit(df.repartition(parts), ["a", "b", "c"], "y", 12, tasks=tasks).collect())) for parts, tasks in ((5, 1), (2, 3), (7, 8))]
    assert fits[0] == fits[1] == fits[2]
    # As many tasks as cores, of which some have no rows.
    few = df.limit(2)
    assert boosting.fit(few, ["a", "b", "c"], "y", 2, tasks=6).count() == 9
    assert boosting.fit(df.limit(0), ["a", "b", "c"], "y", 2).collect() == []


def test_a_fit_holds_few_bytes_of_a_row():
    rng = np.random.default_rng(4)
    n = 400_000
    held = [boosting.Spool() for _ in range(4)]
    for _ in range(8):
        for spool in held:
            spool.append(rng.gamma(2, 9, n // 8))
    x, y = np.stack([c[:] for c in held[:-1]], axis=1), held[-1][:]
    assert len(held[0]) == n and (held[0][10:20] == x[10:20, 0]).all()
    tracemalloc.start()
    start, trees = boosting.fit_trees(x, y, 0.5, 2)
    assert tracemalloc.get_traced_memory()[1] < 40 * n
    tracemalloc.stop()
    # Columns in files give the same trees.
    [(again, others)] = boosting.grow(held[:-1], held[-1], (0.5,), 2, boosting.Peers())
    assert start == again and all((u == v).all() for a, b in zip(trees, others, strict=True) for u, v in zip(a, b, strict=True))


def test_quantiles_that_are_counted_together_have_trees_of_their_own():
    rng = np.random.default_rng(5)
    x = np.stack((rng.integers(0, 90, 70_000), rng.integers(0, 3, 70_000), rng.gamma(2, 9, 70_000)), axis=1).astype(float)
    y = x[:, 0] + x[:, 1] * rng.gamma(2, 9, 70_000)
    alphas = (0.1, 0.3, 0.5, 0.8, 0.9)
    assert boosting.JOINT < len(alphas) and boosting.CHUNK < len(y)
    together = boosting.grow(list(x.T), y, alphas, 4, boosting.Peers())
    for alpha, (start, trees) in zip(alphas, together, strict=True):
        alone, others = boosting.fit_trees(x, y, alpha, 4)
        assert start == alone and all((u == v).all() for a, b in zip(trees, others, strict=True) for u, v in zip(a, b, strict=True))


def test_quantiles_from_counts():
    rng = np.random.default_rng(3)
    for values in (rng.normal(0, 1, 999), rng.integers(0, 5, 700).astype(float), np.full(10, 4.0), np.append(rng.normal(0, 1, 500), 1e6)):
        group = rng.integers(0, 3, len(values))
        fractions = np.tile([0.1, 0.5, 0.9], (4, 1))
        got = boosting.quantiles(boosting.Peers(), [boosting.Part(values, group, 4, values.min(), values.max())], fractions, exact=True)
        assert np.isnan(got[3]).all()
        for g in range(3):
            want = np.quantile(values[group == g], fractions[0])
            lower, higher = (np.quantile(values[group == g], fractions[0], method=m) for m in ("lower", "higher"))
            step = np.ptp(values) / boosting.RANGES
            assert ((got[g] >= lower - step) & (got[g] <= higher + step)).all(), (got[g], want)
        exact = boosting.quantiles(boosting.Peers(), [boosting.Part(values, 0, 1, values.min(), values.max())], np.array([[0.0, 1.0]]), exact=True)
        assert values.min() <= exact[0, 0] <= values.min() + np.ptp(values) / boosting.RANGES**2
        assert exact[0, 1] == values.max()


def test_a_product_without_rule_gets_the_default_answer(spark):
    known = spark.createDataFrame([(1, 5, 40, 3, 14)], "product_id long, threshold_min int, threshold_max int, current_stock int, lead_time_days int")
    demand = spark.createDataFrame([(1, 2.0, 4.0), (2, 2.0, 4.0)], "product_id long, p50 double, p90 double")
    asked = spark.createDataFrame([(1,), (2,)], "product_id long")
    got = {r.product_id: (r.risk, r.probability, r.current_stock, r.lead_time_days) for r in rules.stock_risk(asked, demand, known).collect()}
    assert got[1][0] == "STOCKOUT" and got[2] == ("OK", 0.0, 0, rules.DEFAULT_LEAD_DAYS)


def test_a_tie_of_the_risk_is_rounded_up(spark, tmp_path):
    d, units = f"file://{tmp_path}", [2, 9, 11, 38, 43, 47, 47, 49]  # the 90 % percentile is 47.6
    items = [(i, 1, 17119, 77, float(q), 10.0 * q, 0.0, "N", "O", dt.datetime(2024, 1, 1) + dt.timedelta(weeks=i)) for i, q in enumerate(units)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(17119, "b", "t", 100.0, 32)], "p_partkey long, p_brand string, p_type string, p_retailprice double, p_size int").write.parquet(f"{d}/part.parquet")
    [got] = queries.QUERIES["stock_risk"](spark, d).collect()
    # 0.5 + (32 - (153 - 47.6 * 19 / 7)) / 32 is 0.75625 exactly.
    assert (got.risk, got.demand_weekly_p90, got.lead_time_days, got.probability) == ("STOCKOUT", 47.6, 19, 0.7563)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_inputs_are_dealt_by_product_once(spark):
    """Weeks of sales by product and week, and all inputs by product; serving has the products besides."""
    days = [(p, d, c) for p in (1, 2, 3) for d in range(0, 70, 5) for c in range(p * (d % 4))]
    prices = spark.createDataFrame([(p, c, None if (p + d + c) % 6 == 0 else float((7 * d + 5 * c) % 23), day(d), "OK") for p, d, c in days], PRICES)
    sales = weeks(spark, {1: 9, 2: 5, 3: 3})
    promos = spark.createDataFrame([(p, day(7 * p).date(), day(40).date()) for p in (1, 1, 2, 4)], "product_id long, start_date date, end_date date")
    data = features.price_dataset(sales, prices, promos)
    products = spark.createDataFrame([(p, 4.0) for p in (1, 2, 3, 4)], "product_id long, current_price double")
    served = features.serving_context(weekly_sales(sales), products, prices, promos)
    assert exchanges(data) == 2
    assert exchanges(served) <= 3
    week = F.date_trunc("week", "collected_at").cast("date").alias("week")
    medians = {(r.product_id, r.week): r.m for r in prices.groupBy("product_id", week).agg(F.median("competitor_price").alias("m")).collect()}
    assert {(r.product_id, r.week): r.comp_median for r in competitor_week_median(prices).collect()} == medians
    flags = {(r.product_id, r.week) for r in promo_weeks(promos).collect()}
    either = lambda x, other: other if x is None else x
    rows = data.collect()
    assert len(rows) == 6
    assert all((r.comp_median, r.promo_flag) == (either(medians.get((r.product_id, r.week)), r.price_week), int((r.product_id, r.week) in flags)) for r in rows)
    rows = {r.product_id: r for r in served.collect()}
    assert {p: r.last_weeks for p, r in rows.items()} == {1: 4, 2: 4, 3: 3, 4: None}
    assert [rows[p].week for p in (1, 2, 3, 4)] == [day(56).date(), day(28).date(), day(14).date(), None]
    assert all((r.comp_median, r.promo_flag) == (either(medians.get((p, r.week)), 4.0), int((p, r.week) in flags)) for p, r in rows.items())
    assert [rows[2][c] for c in features.LAGS] == [5.0, 4.0, 3.0, 2.0]


def test_a_tree_counts_a_part_of_the_rows(monkeypatch):
    rng = np.random.default_rng(6)
    n, width = 40_000, 8
    x = rng.integers(0, 60, (n, width)).astype(float)
    y = x[:, 0] + 9 * (x[:, 1] > 40) + rng.normal(0, 5, n)
    seen, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda values, **k: seen.append(len(values)) or plain(values, **k))
    number = []
    for trees in (1, 6):
        seen.clear()
        boosting.fit_trees(x, y, 0.5, trees)
        number.append(sum(seen))
    # Three levels of all rows would be 24 n for the features alone.
    assert number[1] - number[0] < 5 * 12 * n


def test_scores_by_codes_are_those_of_the_thresholds():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 40, (3000, 4)).astype(float)
    x[:5] = np.array([np.inf, -np.inf, 0.0, 12.0, 1e300])[:, None]
    for values in (rng.integers(0, 40, 280).astype(float), rng.uniform(0, 40, 4000)):
        thresholds = np.resize(values, (len(values) // 7, 7))
        thresholds[::3, 2] = np.inf
        chosen, value = rng.integers(0, 4, thresholds.shape), rng.normal(0, 1, (len(thresholds), 8))
        model = boosting.Ensemble([{"tree": -1, "value": [3.0]}, *[{"tree": t, "feature": chosen[t].tolist(), "threshold": thresholds[t].tolist(), "value": value[t].tolist()} for t in range(len(value))]])
        want = np.full(len(x), 3.0)
        for f, t, v in zip(chosen, thresholds, value, strict=True):
            at = np.zeros(len(x), dtype=int)
            for _ in range(3):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
            want += v[at - 7]
        assert (model.predict(x) == want).all()
        assert model.kind == (np.uint8 if len(values) < 1000 else np.uint32)


def test_promotions_are_chosen_with_one_look_at_the_products(spark):
    """Products 1 and 2 have a feasible discount (2 is overstocked), 3 has none, 4 has one without sales, 5 neither."""
    rows = [(1, 7.0, 9.0, 10.0, 5, 40), (2, 7.0, 8.0, 10.0, 50, 40), (3, 7.0, 11.0, 10.0, 5, 40), (4, 7.0, 9.0, 10.0, 5, 40), (5, 7.0, 11.0, 10.0, 5, 40)]
    context = spark.createDataFrame(rows, "product_id long, cost_price double, min_price double, current_price double, current_stock int, threshold_max int")
    context = context.withColumns({"week": F.when(F.col("product_id") < 4, F.lit("2025-01-06").cast("date")), "last_weeks": F.lit(4), "promo_flag": F.lit(0)})
    sold = F.lit(60.0) - 5 * F.col("promo_price")
    demand = lambda r: r.withColumns({"q10": sold - 1, "q50": sold, "q90": sold + F.col("promo_flag")})
    out = optimize.optimise_promo(context, demand)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    got = {r.product_id: r for r in out.collect()}
    assert [(got[p].recommended_discount, got[p].promo_price, got[p].should_promote) for p in (1, 2, 3)] == [(0.05, 9.5, True), (0.2, 8.0, True), (0.0, 10.0, False)]
    assert (got[1].estimated_margin_week, got[2].estimated_margin_week, got[3].estimated_margin_week) == (31.25, 20.0, 0.0)
    assert (got[1].demand_weekly.p10, got[2].demand_weekly.p90, got[3].demand_weekly) == (11.5, 21.0, None)
    assert got[3].explanation == optimize.PROMO_NONE and got[3].interval.asDict() == {"low": 10.0, "high": 10.0}
    assert [(got[p].error, got[p].promo_price) for p in (4, 5)] == [(optimize.NO_SALES, None)] * 2
