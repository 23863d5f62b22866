import random
import time

import pytest

from evscreen.errors import AgreementError, RecallError
from evscreen.functions.numerics import _quick_tail, _tail, hypergeometric_lower, hypergeometric_upper, two_sided_z
from evscreen.operators import agreement, recall

VOTES = "record_id string, vendor string, rating int"


def votes(spark, table):
    return spark.createDataFrame([(f"u{i}", f"r{j + 1}", v) for i, row in enumerate(table) for j, v in enumerate(row) if v is not None], VOTES)


def test_alpha_of_the_worked_example(spark):
    row = agreement.agreement(votes(spark, [(-1, -1), (0, 0), (1, 1), (-1, 1)])).first()
    assert row["alpha"] == pytest.approx(5 / 12) and row["raw_agreement"] == 0.75 and (row["n_units"], row["n_raters"]) == (4, 2)
    assert agreement.agreement(votes(spark, [(-1, -1), (0, 0), (1, 1)])).first()["alpha"] == pytest.approx(1)


def test_alpha_undefined_and_missing(spark):
    row = agreement.agreement(votes(spark, [(1, 1), (1, 1)])).first()
    assert row["alpha"] is None and row["raw_agreement"] == 1
    row = agreement.agreement(votes(spark, [(-1, -1, -1), (0, 0, None), (1, 1, 1)])).first()
    assert row["alpha"] == pytest.approx(1)
    single = votes(spark, [(1,), (-1,)])
    assert agreement.agreement(single).first()["alpha"] is None
    with pytest.raises(AgreementError):
        agreement.strict_agreement(single)


def test_pairs_without_alpha_are_left_out(spark):
    got = {(r["vendor_a"], r["vendor_b"]) for r in agreement.pairwise_alpha(votes(spark, [(1, 1, -1), (1, 1, 1)])).collect()}
    assert got == {("r1", "r3"), ("r2", "r3")}


def test_fn_correlation(spark):
    truth, a, b = (1, 1, 1, 1, 1, -1, 0), (-1, -1, 1, 1, 1, 1, -1), (-1, 1, -1, 1, 1, -1, 1)
    truths = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(truth)], "record_id string, truth int")
    row = agreement.fn_correlation(votes(spark, list(zip(a, b))), truths).first()
    assert row["correlation"] == pytest.approx(1 / 6) and [row[c] for c in ("n", "both", "only_a", "only_b", "neither")] == [5, 1, 1, 1, 2]
    row = agreement.fn_correlation(votes(spark, [(1, 1)] * 7), truths).first()
    assert row["correlation"] is None and row["neither"] == 5


def test_full_coverage(spark):
    truths = spark.createDataFrame([(f"u{i}", 1) for i in range(3)], "record_id string, truth int")
    got = agreement.fully_covered(votes(spark, [(1, -1), (-1, None), (1, 1)]), truths)
    assert {r["record_id"] for r in got.collect()} == {"u0", "u2"}


@pytest.mark.parametrize("m, n, population, want", [(2, 40, 400, 57), (0, 20, 200, 26), (3, 30, 500, 117), (1, 20, 200, 41), (2, 20, 22, 3), (0, 500, 500, 0), (17, 500, 500, 17)])
def test_hypergeometric_upper(m, n, population, want):
    got = hypergeometric_upper(m, n, population)
    assert got == want
    if n < population and got < population:
        assert _tail(0, m, got, n, population) >= 0.05 > _tail(0, m, got + 1, n, population)


@pytest.mark.parametrize("k, n, population, want", [(5, 50, 500, 22), (5, 40, 400, 22), (2, 20, 22, 2), (0, 50, 500, 0), (17, 500, 500, 17)])
def test_hypergeometric_lower(k, n, population, want):
    assert hypergeometric_lower(k, n, population) == want


def test_numerics_refuse():
    assert two_sided_z(0.95) == pytest.approx(1.9599639845400536)
    for bad in ((3, 2, 10), (0, 0, 10), (0, 11, 10)):
        with pytest.raises(RecallError):
            hypergeometric_upper(*bad)
    with pytest.raises(RecallError):
        two_sided_z(1.0)


def strata(spark, rows, role="exclusion"):
    return spark.createDataFrame([(role, "all", f"s{i}", *r) for i, r in enumerate(rows)], "role string, stratum_kind string, stratum string, n long, m long, population long")


def test_wilson(spark):
    got = {r["n"]: (r["low"], r["high"]) for r in recall.stratum_rates(strata(spark, [(40, 5, 400), (20, 0, 400), (30, 3, 400), (200, 8, 400)])).collect()}
    assert got[40] == pytest.approx((0.054595002509, 0.261121198389)) and got[20][1] == pytest.approx(0.161125158053)
    assert got[30] == pytest.approx((0.034599888747, 0.256210825792)) and got[200][1] == pytest.approx(0.076932068201)


def test_stratified_recall(spark):
    row = recall.stratified(strata(spark, [(20, 0, 200), (30, 3, 500)]), 100).first()
    assert row["point"] == pytest.approx(2 / 3) and row["floor"] == pytest.approx(0.393184129093)
    assert (row["ci_low"], row["ci_high"]) == pytest.approx((0.481467945685, 1.0))
    assert row["estimated_fn_exact_floor"] == 162 and row["exact_floor"] == pytest.approx(0.381679389313)
    assert recall.stratified(strata(spark, [(20, 0, 200)]), 100).first()["floor"] == pytest.approx(0.778016865076)
    assert recall.stratified(strata(spark, [(5, 0, 5)]), 0).first()["point"] == 0.0


def test_audited_positives(spark):
    out, inside = strata(spark, [(20, 0, 200), (30, 3, 500)]), strata(spark, [(50, 5, 500)], "inclusion")
    row = recall.with_audited_positives(out, recall.estimated_positives(inside), inside).first()
    assert row["exact_floor"] == pytest.approx(0.089947089947) and row["floor"] is None and row["ci_low"] is None
    assert row["estimated_fn_exact_floor"] == 172
    with pytest.raises(RecallError):
        recall.stratified(inside, 1)
    with pytest.raises(RecallError):
        recall.estimated_positives(out)
    with pytest.raises(RecallError):
        recall.stratified(out.limit(0), 1)


def test_quick_tails_are_the_exact_ones():
    rng = random.Random(5)
    for _ in range(300):
        population = rng.randrange(2, 400)
        n, k = rng.randrange(1, population + 1), rng.randrange(0, population + 1)
        lo = rng.randrange(0, n + 1)
        for a, b in ((0, lo), (lo, n)):
            assert _quick_tail(a, b, k, n, population) == pytest.approx(_tail(a, b, k, n, population), abs=1e-12)


def test_bounds_of_large_samples():
    """A tenth of ten million records, within a second each; near the normal approximation."""
    m, n, population = 30_000, 1_000_000, 10_000_000
    began = time.perf_counter()
    high, low = hypergeometric_upper(m, n, population), hypergeometric_lower(m, n, population)
    assert time.perf_counter() - began < 2
    half = 1.645 * 10 * (m * (1 - m / n) * (1 - n / population)) ** 0.5
    assert high == pytest.approx(m * 10 + half, rel=1e-3) and low == pytest.approx(m * 10 - half, rel=1e-3)
