import itertools
import math
import statistics

import pytest

from evscreen.errors import VoteError
from evscreen.operators import decide


def decided(spark, vectors, tau, policy="escalate"):
    rows = [(str(i), v.count(-1), v.count(0), v.count(1)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "record_id string, n_neg int, n_zero int, n_pos int")
    return {int(r["record_id"]): r for r in decide.with_decision(df, tau, policy).collect()}


@pytest.mark.parametrize("policy", ["escalate", "include"])
@pytest.mark.parametrize("tau", [0.4, 0.6, 100.0])
def test_every_vector_of_up_to_five(spark, tau, policy):
    vectors = [v for x in range(1, 6) for v in itertools.product((-1, 0, 1), repeat=x)]
    for i, row in decided(spark, vectors, tau, policy).items():
        v = vectors[i]
        spread = statistics.stdev(v) if len(v) > 1 else 0.0
        boundary = -1 in v and 1 in v
        escalate = boundary or spread > tau or (sum(v) == 0 and policy == "escalate")
        label = None if escalate else -1 if sum(v) < 0 else 1
        assert (row["boundary"], row["escalate"], row["auto_label"]) == (boundary, escalate, label)
        assert row["dispersion"] == pytest.approx(spread, abs=1e-12)


def test_threshold_is_strict(spark):
    s = math.sqrt(1 / 3)
    assert not decided(spark, [(0, 1, 1)], s)[0]["escalate"]
    assert decided(spark, [(0, 1, 1)], s - 0.01)[0]["escalate"]


def test_named_rules(spark):
    df = spark.createDataFrame([("a", 1, 0, 0)], "record_id string, n_neg int, n_zero int, n_pos int")
    with pytest.raises(NotImplementedError):
        decide.with_decision(df, 1.0, aggregation="majority")
    with pytest.raises(VoteError):
        decide.with_decision(df, 1.0, aggregation="other")
    with pytest.raises(VoteError):
        decide.with_decision(df, 1.0, zero_policy="other")


REACHED = {1: (0,), 2: (0, 0.7071067811865476), 3: (0, 0.5773502691896257), 4: (0, 0.5, 0.5773502691896257), 5: (0, 0.4472135954999579, 0.5477225575051661), 6: (0, 0.408248290463863, 0.5163977794943222, 0.5477225575051661)}


@pytest.mark.parametrize("x", REACHED)
def test_reachable(spark, x):
    assert decide.reachable(x) == pytest.approx(REACHED[x])
    frame = decide.reachable_frame(spark.createDataFrame([(x,)], "x int"))
    assert sorted(r["dispersion"] for r in frame.collect()) == pytest.approx(list(REACHED[x]))


def test_tau_report():
    r = decide.describe_tau(0.55, 4)
    assert r.effective_breakpoint == 0.5 and r.canonical_interval == pytest.approx((0.5, REACHED[4][2])) and not r.dispersion_inert
    assert decide.describe_tau(1.0, 4).dispersion_inert and decide.describe_tau(0.5, 4).on_reachable_value
    assert decide.describe_tau(1.0, 4).to_dict()["canonical_interval"][1] is None
    for bad in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(VoteError):
            decide.validate_tau(bad, 3)
    assert decide.validate_tau(0.0, 1).x == 1
    with pytest.raises(VoteError):
        decide.reachable(5000)


def test_resolve_tau():
    tie = math.sqrt(4 / 12)
    assert decide.resolve_tau("tie_escalate", 4) < tie < decide.resolve_tau("tie_tolerate", 4)
    for x in range(2, 8):
        low, high = decide.resolve_tau(0.0, x), decide.resolve_tau(1.0, x)
        assert 0 < low < decide.reachable(x)[1] and high > decide.reachable(x)[-1]
    with pytest.raises(VoteError):
        decide.resolve_tau("tie_escalate", 3)
    with pytest.raises(VoteError):
        decide.resolve_tau(1.5, 3)


def test_vote_violations(spark):
    votes = spark.createDataFrame([("a", "v", 2), ("b", "v", None), ("c", "v", 1), ("c", "v", 1), ("d", "v", 0)], "record_id string, vendor string, rating int")
    assert {r["record_id"] for r in decide.vote_violations(votes).collect()} == {"a", "b", "c"}
