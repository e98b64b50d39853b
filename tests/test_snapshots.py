import random
from datetime import date, datetime

from pyspark.sql import functions as F

from weftline.operators.snapshots import snapshot_changes

SCHEMA = "day date, at timestamp, n long, k string, v string, op string, side int, entry string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "e") for r in rows], SCHEMA)
    return {tuple(r) for r in snapshot_changes(df, "day", {"k": F.lower("k")}, {"v": F.coalesce("v", F.lit("")), "op": F.col("op")}, ["at", "n"]).collect()}


def brute(rows):
    days = sorted({r[0] for r in rows if r[0]})
    best = {}
    for d, at, n, k, v, op in rows:
        key = (d, k and k.lower())
        if d and (key not in best or best[key][0] < (at or datetime(1, 1, 1), n)):
            best[key] = ((at or datetime(1, 1, 1), n), (v or "", op))
    out = set()
    for old, new in zip(days, days[1:], strict=False):
        for k in {k for d, k in best if d in (old, new)}:
            a, b = best.get((old, k)), best.get((new, k))
            if not (a and b):
                out.add((new, k, "removed" if a else "added"))
            elif a[1] != b[1]:
                out.add((new, k, "changed"))
    return out


def test_random_snapshots(spark):
    pick = random.Random(4)
    rows = [(pick.choice([None] + [date(2024, m, 1) for m in range(1, 5)]), pick.choice([None, datetime(2024, 5, pick.randrange(1, 28))]), n, pick.choice("aAbBcdefgh") if n % 20 else None, pick.choice([None, "", "x", "y"]), pick.choice([None, "", "i"])) for n in range(160)]
    assert run(spark, rows) == brute(rows)


def test_one_and_no_snapshot(spark):
    assert run(spark, []) == set()
    assert run(spark, [(date(2024, 1, 1), None, 1, "a", "x", "i")]) == set()
