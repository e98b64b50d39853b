from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import mixing as M


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.integers(0, 200))
def test_apportionment_equals_dealing_one_by_one(weights, seats):
    given_ = [0] * len(weights)
    for _ in range(seats if any(weights) else 0):
        at = max((w / (2 * k + 1), -n) for n, (w, k) in enumerate(zip(weights, given_, strict=True)) if w > 0)[1]
        given_[-at] += 1
    assert M.sainte_lague([float(w) for w in weights], seats) == given_


def test_mix_reaches_shares_and_keeps_caps(spark):
    docs = [(k, "abc"[k % 3] if k % 50 else "small", 50 + k % 90) for k in range(6000)] + [(9001, None, 5), (9002, "none", 5), (9003, "a", 0), (9003, "a", 0)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, source string, n_tokens long, shard int, copies int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.2, 1), ("small", 0.2, 3), ("gone", 0.1, 2), ("c", None, 1), (None, 0.1, 1)], "source string, target_share double, max_copies int")
    mixed, shares = M.mix(df, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["a"]["actual_share"] - 0.5 / 0.9) < 0.005 and abs(got["small"]["actual_share"] - 0.2 / 0.9) < 0.005 and got["gone"]["tokens_used"] == 0 and got["c"]["tokens_used"] == 0
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9
    most = {r["source"]: r["m"] for r in mixed.groupBy("source").agg({"copies": "max"}).withColumnRenamed("max(copies)", "m").collect()}
    assert most["a"] <= 2 and most["b"] <= 1 and most["small"] == 3
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, M.mix(df, targets)[0].collect()))
    part, said = M.mix(df, targets, total_tokens=20_000)
    assert abs(sum(r["tokens_used"] for r in said.collect()) - 20_000) < 400


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_copies int")
    mixed, shares = M.mix(df, targets)
    assert mixed.count() == 0 and [r["actual_share"] for r in shares.collect()] == [0.0]
