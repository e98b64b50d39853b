import random

import numpy as np
import pytest

from weftline.llm import abuse as A

RESTORER = A.Restorer(np.ones((27, 27, 27)), {w: v for v, ws in A.SEEDS.items() if v > 0 for w in ws})


@pytest.mark.parametrize("raw, word", [("n4k3d", "naked"), ("a$$h0le", "asshole"), ("s.t.u.p.i.d", "stupid"), ("d i p s h i t", "dipshit"), ("fuuuuuck", "fuck"), ("fcuk", "fuck"), ("{\\it as}shole", "asshole"), ("fu​ck", "fuck"), ("bаstаrd", "bastard"), ("IMBÉCIL", "imbecil"), ("m*o*r*o*n", "moron"), ("plain", "plain"), ("key2005a", "")])
def test_disguised_words(raw, word):
    assert RESTORER.words(raw) == [word]


def test_viterbi_equals_listing_all_paths():
    pick = random.Random(3)
    own = A.Restorer(np.array([pick.random() for _ in range(27**3)]).reshape(27, 27, 27), {"moron": 1.0})
    for word in ("1t4", "b33#", "aaab", "l1!e"):
        paths = [("", 0, 0.0)]
        while any(at < len(word) for _, at, _ in paths):
            paths = [(t + text, at + size, c + cost) if at < len(word) else (t, at, c) for t, at, c in paths for text, size, cost in (own.lattice(word)[at] if at < len(word) else [("", 0, 0.0)])]
        best = max(paths, key=lambda p: own.likelihood(p[0]) - p[2])[0]
        assert own.decode(word) == best


@pytest.fixture(scope="module")
def corpus(spark):
    pick = random.Random(1)
    calm = ["The {} of the model was measured.", "We thank the {} facility for access.", "Stupid baselines reach {} accuracy.", "Insults such as ``idiot'' occur in {} comments."]
    bad = ["You are a stupid {} and should quit.", "Go to hell with your {}, you m0r0n.", "Send nudes, I get hard when you explain the {}."]
    docs, truth = [], {}
    for k in range(900):
        lines = [pick.choice(calm).format(f"thing{pick.randrange(300)}") for _ in range(8)]
        if truth.setdefault(k, k % 9 == 0):
            lines.insert(pick.randrange(8), pick.choice(bad).format(f"thing{pick.randrange(300)}"))
        docs.append((k, " ".join(lines), "s%d" % (k % 3) if k % 5 else None, 0.0))
    docs += [(1000, None, "s0", 0.0), (1001, "", "s0", 0.0), (1002, "  ", "s0", 0.0)]
    labels = [(k, int(v) if pick.random() > 0.02 else int(not v)) for k, v in truth.items() if k % 2 == 0] + [(2, None), (4, 0), (4, 1), (99_999, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), truth


def test_held_out_documents(corpus):
    docs, labels, truth = corpus
    made = A.score(docs, labels).cache()
    got = {r["doc_id"]: r["flagged"] for r in made.collect()}
    odd = [k for k in truth if k % 2]
    hits = sum(got[k] and truth[k] for k in odd)
    assert hits / sum(truth[k] for k in odd) > 0.9 and hits / max(1, sum(got[k] for k in odd)) > 0.9
    assert not got[1000] and not got[1001] and not got[1002]
    rates = {r["source"]: r for r in A.rates(made).collect()}
    assert sum(r["n_docs"] for r in rates.values()) == 903 and None in rates


def test_without_labels_and_documents(corpus):
    docs, labels, truth = corpus
    got = {r["doc_id"]: r["score"] for r in A.score(docs, labels.limit(0)).collect()}
    assert max(got[k] for k in truth if not truth[k]) < max(got[k] for k in truth if truth[k])
    assert A.score(docs.limit(0), labels).count() == 0


def test_long_texts_are_scored_whole():
    model = A.Model(RESTORER, {"moron": 3.0}, {})
    assert model.score("calm " * 50_000 + "moron") == 3.0 and model.score("a b " * 9 + "x" * 100_000) == 0.0
    assert max(len(s.split()) for s in model.worst("calm words " * 1000, 3)) <= A.LONGEST


@pytest.mark.parametrize("raw, word", [("d1p5h1+", "dipshit"), ("455h0l3", "asshole"), ("b1tch35", "bitches"), ("5h1+", "shit"), ("1d10+", "idiot"), ("whor3", "whore"), ("cun7", "cunt"), ("a$$", "ass"), ("f***", "fuck"), ("stupid1", "stupid"), ("$moron$", "moron")])
def test_last_letter_disguised(raw, word):
    assert RESTORER.words(f"you {raw} there")[1] == word


@pytest.mark.parametrize("raw, word", [("f4660t", "faggot"), ("sch3155e", "scheisse"), ("8457ard", "bastard"), ("smith1998a", ""), ("1998smith", "smith"), ("smith2020", "smith")])
def test_four_digits_in_a_row(raw, word):
    assert RESTORER.words(raw) == [word]


def test_only_years_at_an_edge_are_skipped():
    assert not A.YEAR.match("n1663r") and not A.YEAR.match("a4660b") and A.YEAR.match("key2005a") and len(RESTORER.words("n1663r")[0]) == 6


def test_currency_signs_stand_for_letters():
    assert RESTORER.words("hur€nsohn") == ["hurensohn"] and RESTORER.words("a££e £ 100 € 5")[0] == "alle" and A.fold("5 € – £") == "5 €   £"


@pytest.mark.parametrize("raw, word", [("f" + "u" * 300 + "ck", "fuck"), ("m" + "o" * 80 + "r0n", "moron"), ("s7" + "u" * 500 + "p1d", "stupid"), ("n4k3d" * 20, "naked" * 20)])
def test_long_words_are_decoded(raw, word):
    assert RESTORER.words(raw) == [word]


@pytest.mark.parametrize("raw, word", [("sh1t2024", "shit"), ("f---u---c---k", "fuck"), ("shtihead", "shithead"), ("m o r 0 n", "moron"), ("m*0*r*o*n", "moron"), ("stupdi", "stupid"), ("scientist", "scientist")])
def test_years_long_gaps_and_swaps(raw, word):
    counts = np.ones((27, 27, 27))
    for known in ("shithead hit head shine white sheath heading hidden scientist artist list " * 50).split():
        codes = [0, 0, *[ord(c) - 96 for c in known], 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[a, b, c] += 20
    own = A.Restorer(counts, {w: v for v, ws in A.SEEDS.items() for w in ws})
    assert own.words(raw) == [word]


def test_letters_one_by_one_are_parted():
    assert RESTORER.words("k i l l y o u r s e l f")[0] == "kill" and "".join(RESTORER.words("k i l l y o u r s e l f")) == "killyourself"
    assert RESTORER.words("x 1 3 0") == ["x", "", "", ""]


def test_initials_tell_nothing():
    assert A._features("n smith and i agree") == [("smith", None), ("and", None), ("agree", None), ("smith", "and"), ("and", "i"), ("i", "agree")]


def test_words_count_once_in_a_sentence():
    model = A.Model(RESTORER, {"and": 1.0, "moron": 3.0}, {("and", "also"): 0.5}, -2.0)
    for text, value in (("ann and bob and carl and dora and also eve and also fred", -0.5), ("moron moron and more. and", 2.0), ("ann and bob. and", -1.0)):
        assert model.sentences(text)[2].max() == value
    assert model.plain("ann and bob and carl and dora and also eve and also fred") == -0.5


def test_fit_sees_its_own_worst_sentences(spark, monkeypatch):
    """A sentence that the weights find worst in a document labelled as good is a harmless one of the last fit."""
    pick = random.Random(4)
    thing = lambda: "".join(pick.choice(["ka", "lu", "mi", "ro", "ste", "ban"]) for _ in range(3))
    docs = [(k, " ".join(f"The {thing()} bounds {thing()} and {thing()}." for _ in range(40)) + (" You are a stupid moron." if k % 5 == 0 else "")) for k in range(200)]
    fitted, own = [], A._regression
    monkeypatch.setattr(A, "_regression", lambda bags: (fitted.append(bags), own(bags))[1])
    made = A.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 5 == 0)) for k, _ in docs], "doc_id long, toxic int"))
    first = A.Model(made.restorer, *own(fitted[4]))
    seen = {s for bad, sentences in fitted[-1] for s in sentences if not bad}
    assert all(set(first.worst(text, A.WORST)) <= seen for k, text in docs if k % 5)
