import itertools
import math
import random

import pytest

from weftline.llm import names as N

GIVEN = ["Budi", "Setiawan", "Katarina", "Yohanes", "Maria", "Robert", "Nurhayati", "Fransiska"]
FAMILY = ["Skormebrukas", "Alkegrekenau", "Tukigrepel", "Riskundenau", "Briresin", "Wontarelo", "Dembugasi", "Prolikandu"]


def typed(pick, given, family):
    forms = [f"{given} {family}", f"{family}, {given}", f"{given[0]}. {family}", f"DR. {given.upper()} {family.upper()}", f"{given}{family}", f"{given}  {family[:4]}{family[5:]}", f"{given} {family[:5]} {family[5:].lower()}", f"{given} {family.replace('u', 'oe', 1)} SH"]
    return pick.choice(forms)


@pytest.fixture(scope="module")
def people(spark):
    pick = random.Random(5)
    pairs = [(g, f) for f in FAMILY for g in pick.sample(GIVEN, 3) if True]
    pairs = [(g, f) for k, (g, f) in enumerate(pairs) if not any(x[0] == g[0] and y == f for x, y in pairs[:k])]
    rows, truth = [], {}
    for k in range(400):
        g, f = pick.choice(pairs)
        rows.append(("customer", k, typed(pick, g, f), "e"))
        truth[k] = (g, f)
    rows += [("customer", 900 + k, n, "e") for k, n in enumerate([None, "", " ", "-", "UNKNOWN", "xxx", "n/a"])]
    return spark.createDataFrame(rows, "kind string, id long, name string, entity string"), truth


def test_variants_are_linked(people):
    df, truth = people
    found = {(r["id_a"], r["id_b"]) for r in N.same_entity_pairs(N.link_names(df)).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b]}
    assert len(found & want) / len(found) > 0.97 and len(found & want) / len(want) > 0.9


def test_organisations(spark):
    base = [f"PT {c} {t}" for c in ("Slagrambi", "Glentogro", "Kritanye", "Nadable") for t in ("Logistik Pangan", "Teknik Mandiri", "Kimia")] * 2
    own = ["P.T. Slagrambi Pangan & Logistics", "slagrambi pgn logistik, PT", "CV Slagrambi Logistik Pangan", "PT", "umum"]
    rows = [("supplier", k, n) for k, n in enumerate(base + own)]
    got = {r["id"]: r["entity"] for r in N.link_names(spark.createDataFrame(rows, "kind string, id long, name string")).collect()}
    assert got[24] == got[25] == got[0] == got[12] and got[26] != got[0] and got[1] != got[0] and 27 not in got and 28 not in got


def test_average_linkage_equals_one_by_one(spark):
    pick = random.Random(7)
    sims = {(a, b): round(pick.random(), 3) for a, b in itertools.combinations(range(14), 2) if pick.random() < 0.5}
    clusters = {k: {k} for k in range(14)}
    mean = lambda x, y: sum(sims.get((min(a, b), max(a, b)), 0) for a in x for b in y) / len(x) / len(y)
    while len(clusters) > 1:
        best, i, j = max((mean(clusters[i], clusters[j]), -i, -j) for i, j in itertools.combinations(sorted(clusters), 2))
        if best < 0.4:
            break
        clusters[-i] |= clusters.pop(-j)
    df = spark.createDataFrame([("k", a, b, s) for (a, b), s in sims.items()], "kind string, a long, b long, sim double")
    got = {r["item"]: r["cluster"] for r in N.average_linkage(df, 0.4).collect()}
    assert {frozenset(c) for c in clusters.values()} == {frozenset(k for k in range(14) if got.get(k, k) == c) for c in {got.get(k, k) for k in range(14)}}


def test_no_rows(spark):
    assert N.link_names(spark.createDataFrame([], "kind string, id long, name string")).count() == 0


def test_edits():
    assert [N.near("abc", x) for x in ("abc", "acb", "ab", "axc", "cba", "xyz", "abcdef")] == [0, 1, 1, 1, 2, 3, 3]


def test_two_edits_are_linked(spark):
    pairs = [("Antiglendimor", "Antigelndimir"), ("Gelonituzet", "Glnituzet"), ("Jeklarevik", "Jeklarefyk"), ("Tukigrepelan", "Utkigrepelna"), ("Skormebrukas", "Skormebrumkasi")]
    assert {N.near(a.lower(), b.lower()) for a, b in pairs} == {2}
    rows = [(2 * k + n, x) for k, (a, b) in enumerate(pairs) for n, x in enumerate((f"Maria {a}", f"{b}, MARIA"))]
    rows += [(100 + k, f"{g} {f}") for k, (g, f) in enumerate(itertools.product(GIVEN, FAMILY[1:2] + FAMILY[3:]))]
    named = spark.createDataFrame([("customer", *r) for r in rows], "kind string, id long, name string")
    found = {(r["id_a"], r["id_b"]) for r in N.same_entity_pairs(N.link_names(named)).collect()}
    assert {(2 * k, 2 * k + 1) for k in range(len(pairs))} <= found


def test_cosine_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST", 7)  # lists are split
    pick = random.Random(4)
    parts = ["sko", "rme", "bru", "kas", "al", "ke", "gre", "nau", "tu", "ki", "pel", "o", "ng"]
    bases = {"al", "ali", "aly", "a", "x1", "x1y"}
    while len(bases) < 300:
        base = "".join(pick.choice(parts) for _ in range(pick.randrange(2, 5)))
        bases |= {base, base[:3] + pick.choice("aeiou") + base[4:], base[:2] + base[3:]}
    bases = sorted(bases)
    count: dict = {}
    for b in bases:
        for g in N._grams(b):
            count[g] = count.get(g, 0) + 1
    weight = {g: math.log(1 + len(bases) / n) for g, n in count.items()}
    want = {(a, b) for a, b in itertools.combinations(bases, 2) if N.cosine(a, b, weight, 0.0) >= N.COSINE and N.near(a, b) <= N.edits(min(len(a), len(b)))}
    rows = [("customer", "k", b) for b in bases] + [("customer", "other", b) for b in bases[:50]]
    got = [(r["base"], r["base2"]) for r in N.similar_bases(spark.createDataFrame(rows, "kind string, key string, base string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("x1", "x1y") in want


def test_prefix_holds_the_first_shared_gram():
    pick = random.Random(6)
    words = ["".join(pick.choice("abcd") for _ in range(pick.randrange(1, 9))) for _ in range(80)]
    weight = {g: pick.random() + 0.1 for w in words for g in N._grams(w)}
    for a, b in itertools.combinations(words, 2):
        if N.cosine(a, b, weight, 0.0) >= N.COSINE:
            assert set(N.prefix(a, weight, 0.0)) & set(N.prefix(b, weight, 0.0))


def test_short_forms_are_learnt(spark):
    pick = random.Random(9)
    rows = []
    for k in range(600):
        family = "".join(pick.choice(["ska", "mer", "lon", "tig", "bru", "dal"]) for _ in range(3)) + str(k % 7)
        given = pick.choice(["William", "Robert", "Maria"])
        rows.append(("customer", 3 * k, f"{given} {family}"))
        rows.append(("customer", 3 * k + 1, f"{given} {family}"))
        if given == "William" and k % 2:
            rows.append(("customer", 3 * k + 2, f"Bill {family}"))
    named = spark.createDataFrame(rows, "kind string, id long, name string")
    assert set(N._lexicons(N._worded(named))["customer"].short) == {"bill"}
    linked = {r["id"]: r["entity"] for r in N.link_names(named).collect()}
    assert all(linked[i] == linked[i - 2] for _, i, n in rows if n.startswith("Bill"))
