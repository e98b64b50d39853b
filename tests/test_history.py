import random
from datetime import date, datetime, timedelta

import pytest

from weftline.operators import history as H

SCHEMA = "id long, a string, b boolean, day date, at timestamp, n long, act string, extra int, entity string, state string"


def feed(spark, rows):
    return spark.createDataFrame([(*r, 1, "e", "s") for r in rows], SCHEMA)


def ledger(rows):
    return H.bitemporal_ledger(rows, "id", ["a", "b"], "day", "at", "n", "act = 'D'")


def brute(rows, known_at=None):
    """Versions by id from plain loops."""
    best = {}
    for who, a, b, day, at, n, act in rows:
        key = (at or datetime(1, 1, 1), n)
        if who is None or day is None or known_at and key[0] > known_at:
            continue
        if (who, day) not in best or best[who, day][0] < key:
            best[who, day] = (key, (act == "D", a, b))
    out, last = [], {}
    for (who, day), (_, state) in sorted(best.items()):
        if who in last and last[who][1] == state:
            continue
        if who in last and not last[who][1][0]:
            out.append((who, *last[who][1][1:], last[who][0], day))
        last[who] = (day, state)
    return sorted(out + [(w, *s[1:], d, None) for w, (d, s) in last.items() if not s[0]], key=str)


def found(spark, rows):
    return sorted([tuple(r) for r in H.current_versions(ledger(feed(spark, rows)), "id", ["a", "b"]).collect()], key=str)


def random_rows(seed, n):
    pick = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    out = []
    for k in range(n):
        act = pick.choice("UUUD")
        out.append((pick.choice([1, 1, 1, 2, 3, None]), None if act == "D" else pick.choice(["x", "y", None]), None if act == "D" else pick.choice([True, False]), pick.choice([None] + [date(2024, 1, d) for d in range(1, 9)]), pick.choice([None] + [t0 + timedelta(hours=h) for h in range(20)]), k, act))
    return out + out[: n // 4]


@pytest.mark.parametrize("seed", range(3))
def test_versions_equal_brute_force(spark, seed):
    rows = random_rows(seed, 80)
    assert found(spark, rows) == brute(rows)


def test_ledger_answers_as_known_then(spark):
    rows = random_rows(9, 60)
    made = ledger(feed(spark, rows)).cache()
    for hour in (3, 11, 30):
        at = datetime(2024, 1, 1) + timedelta(hours=hour)
        versions = brute(rows, at)
        for d in range(1, 10):
            day = date(2024, 1, d)
            want = sorted((w, a, b) for w, a, b, x, y in versions if x <= day and (y is None or day < y))
            got = sorted(tuple(r)[:3] for r in H.as_of(made, str(day), str(at)).select("id", "a", "b").collect())
            assert sorted(map(str, got)) == sorted(map(str, want))


def test_no_rows(spark):
    assert found(spark, []) == []
