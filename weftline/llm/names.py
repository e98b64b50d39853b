"""Variant spellings of names typed by people, linked to the person or organisation they name.

Method: character n-gram vectors with inverse-document-frequency weights, a distributed sparse
similarity join by cosine with a threshold, and average-linkage clustering of what it links.

  1. A name is taken apart: titles, degrees and legal forms are told from the rest, and the words
     that are frequent in the table itself, such as given names or lines of business, from the rare
     one that tells names apart, the base (a family name or an organisation's own name). Typos and
     abbreviations of frequent words are resolved to them, and so are short forms and translations,
     which are learnt from the table: words that stand beside the same bases as a more frequent word
     far more often than others do. Equal results form a class, the unit of all later steps, so
     copies of a spelling are never paired.
  2. Bases are vectors of n-grams of GRAM characters, weighted by inverse document frequency. All pairs
     with a cosine of COSINE or more are found by a prefix-filtered join: with the grams of a vector
     in order from the rarest, those after which the rest of the vector is shorter than COSINE can't
     be the first that two such vectors share, so only the grams before are indexed. Lists of grams
     longer than LIST are split. The join drops pairs whose lengths or letters differ by more than the
     edits that the check in 3 allows; no list, pair or partner is cut, so there is no top-n.
  3. Pairs of classes with such bases are checked word by word, with initials, short forms, left out
     middle names and different order allowed, which gives their similarity.
  4. Clusters grow by average linkage, as long as the average over all pairs of two clusters is at
     least LINKAGE; pairs that weren't found count as 0. Each round merges all pairs of clusters
     that are each other's nearest, which gives the same clusters as merging the nearest pair of all
     one by one, as averages can't rise by merging.

What is collected: frequent words, no more than a name has words on average / FREQUENT; short forms,
likewise with SHORT; counts of n-grams, which the alphabet bounds.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed

#: Part of all names that a frequent word must be in, and what is added to it at every size.
FREQUENT, ADDED = 0.003, 2
#: Part of all names that a short form must be in, what is added, the part of its bases that must have
#: the full word too, and how much rarer than that it must be.
SHORT, BESIDE, RARER = 0.0001, 0.25, 3
#: Bases without the full word that every short form is credited with, so that few cases prove nothing.
DOUBT = 4
GRAM, COSINE, LINKAGE = 3, 0.25, 0.4
#: Letters of bases that may differ by two edits; shorter ones may differ by one.
TWO_EDITS = 8
#: Rows of a list of the index that one task joins; longer lists are split.
LIST = 20_000

# Words that aren't part of a person's name.
TITLES = set(
    "tn tuan ny nyonya nn nona sdr sdri bpk bp bapak ibu mr mrs ms dr drs dra ir hj haji hajjah prof alm almh sh st se mm mt mba msi "
    "skom ssi spd phd kom hum ph md jr sr".split()
)
# Words of which fillers consist.
FILLERS = set(
    "unknown test testing tes na n a none null nil pelanggan baru cash customer noname no name tidak diketahui ada umum supplier lain "
    "lainnya misc dummy tbd anonymous anonim general kosong belum new client vendor other others tba contoh example sample".split()
)
# Legal forms and the ways to write them.
FORMS = {"pt": "pt", "cv": "cv", "ud": "ud", "koperasi": "koperasi", "kop": "koperasi", "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "gmbh": "gmbh", "tbk": "", "corp": "corp", "corporation": "corp", "llc": "llc"}
FORM_PHRASES = {"perseroan terbatas": "pt", "usaha dagang": "ud", "commanditaire vennootschap": "cv"}
CONNECTORS = {"dan", "and", "und", "the", "of"}


def fold(name: str) -> str:
    """name without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


def words(name: str | None) -> list[str]:
    """The words of a name in lower case; words written together in mixed case are parted."""
    if not name:
        return []
    text = re.sub(r"\bS\s*\.\s*(?=Kom|Pd|Si|Hum|Ag|Sos)", "S", fold(name))
    text = re.sub(r"['’`]", "", re.sub(r"\b(?:[A-Za-z]{1,2}\s?\.\s?){2,}", lambda m: re.sub(r"[.\s]", "", m[0]) + " " if re.fullmatch(r"(?i)p\.?\s?t\.?|c\.?\s?v\.?|u\.?\s?d\.?|m\.?\s?m\.?|s\.?\s?[the]\.?|ph\.?\s?d\.?|m\.?\s?b\.?\s?a\.?", m[0].strip()) else m[0], text))
    text = re.sub(r"(?<=\w)\s?-(?=\w)", "", text)
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[A-Z])(?=[A-Z][a-z]{3})", " ", text)
    return re.findall(r"[a-z0-9]+", text.lower())


def near(a: str, b: str) -> int:
    """The edits between a and b, neighbours changing places being one; 3 if there are more than 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        if min(now) > 2:
            return 3
        before, row = row, now
    return min(row[-1], 3)


def shortened(a: str, b: str) -> bool:
    """Whether a is a short form of b: its beginning, its end, or a longer part."""
    return 3 <= len(a) < len(b) and (b.startswith(a) or b.endswith(a) or (len(a) >= 4 and a in b))


def abbreviates(a: str, b: str) -> bool:
    """Whether a has the first letter of b and others of its letters in order."""
    letters = iter(b)
    return 2 <= len(a) < len(b) and a[0] == b[0] and all(c in letters for c in a)


# Spellings of one sound, each with the one that is kept.
SOUNDS = [("oe", "u"), ("dj", "j"), ("tj", "c"), ("sj", "sy"), ("ph", "f"), ("ck", "k"), ("ch", "k"), ("q", "k"), ("c", "k"), ("x", "ks")]


def sound(base: str) -> str:
    """base with one spelling for each sound: no h after a stop or s, no letter twice in a row."""
    for old, new in SOUNDS:
        base = base.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"(?<=[bdgkpst])h", "", base))


def holes(word: str) -> set[str]:
    """word and all that is left of it without one character."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def edits(size: int) -> int:
    """The edits by which bases may differ whose shorter one has size letters."""
    return 1 + (size >= TWO_EDITS)


class Parts:
    """Takes names apart by the frequent words of their table and the short forms learnt from it."""

    def __init__(self, frequent: dict[str, int], short: dict[str, dict[str, float]] | None = None) -> None:
        self.short = short or {}
        self.counts = {w: n for w, n in frequent.items() if len(w) > 1 and w not in TITLES and w not in FORMS}
        # A frequent word may itself be the misspelling of a far more frequent one
        long: dict[str, list[str]] = {}
        for w in self.counts:
            if len(w) >= 6:
                for h in holes(w):
                    long.setdefault(h, []).append(w)
        wrong = {w for w, n in self.counts.items() if len(w) >= 6 and any(self.counts[x] >= 2 * n and near(w, x) == 1 for h in holes(w) for x in long.get(h, ()))}
        self.frequent = {w: n for w, n in self.counts.items() if w not in wrong}
        self.typo: dict[str, set[str]] = {}
        for w in self.frequent:
            if len(w) >= 3:
                for h in holes(w):
                    self.typo.setdefault(h, set()).add(w)
        self.heard = {sound(w): w for w in sorted(self.frequent, key=lambda w: self.frequent[w]) if len(w) >= 5}
        self.kept: dict[str, tuple[str, bool]] = {}

    def resolve(self, word: str) -> tuple[str, bool]:
        """The frequent word that word stands for, or word itself, and whether it is a usual one."""
        got = self.kept.get(word)
        if got is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            got = self.kept[word] = self._resolve(word)
        return got

    def _resolve(self, word: str) -> tuple[str, bool]:
        if len(word) == 1:
            return word, True
        if word in self.short:
            return word, True
        if sound(word) in self.heard and (word not in self.frequent or self.frequent[self.heard[sound(word)]] > 2 * self.frequent[word]):
            return self.heard[sound(word)], True
        if word in self.frequent:
            return word, True
        if any(shortened(word, w) for w in self.frequent if len(word) >= 3):
            return word, True
        if len(word) >= 2:
            found = {w for h in holes(word) for w in self.typo.get(h, ()) if near(word, w) <= 1}
            if found:
                return (found.pop(), True) if len(found) == 1 else (word, True)
        return word, False

    def full(self, word: str) -> set[str]:
        """The frequent words that a word was learnt to be short for."""
        return set(self.short.get(word, ()))

    def person(self, every: list[str]) -> tuple[list[str], str, str] | None:
        """(given words in order, base, '') of the words of a person's name; None if it names nobody."""
        own = [w for w in every if not w.isdigit()]
        if not own or all(w in FILLERS or set(w) == {"x"} for w in own):
            return None
        kept = [w for w in own if w not in TITLES] or own
        if len(kept) > 2 and "h" in kept:
            kept.remove("h")
        for n in range(len(kept) - 1, 0, -1):  # a frequent name written in pieces
            if self.counts.get(kept[n - 1] + kept[n], 0) > max(self.counts.get(kept[n - 1], 0), self.counts.get(kept[n], 0)):
                kept[n - 1 : n + 1] = [kept[n - 1] + kept[n]]
        done = [self.resolve(w) for w in kept]
        if not any(usual for _, usual in done):  # a given name may be written together with the next
            kept = [x for w in kept for x in self.parted(w)]
            done = [self.resolve(w) for w in kept]
        rare = [n for n, (_, usual) in enumerate(done) if not usual]
        if len(rare) > 1 and len(rare) < len(done):  # a family name written in pieces
            base, taken = "".join(kept[n] for n in rare), set(rare)
        else:
            at = max(rare, key=lambda n: (len(kept[n]), n)) if rare else max(range(len(done)), key=lambda n: (len(done[n][0]), done[n][0]))
            base, taken = kept[at] if rare else done[at][0], {at}
        return sorted({done[n][0] for n in range(len(done)) if n not in taken}), sound(base), ""

    def parted(self, word: str) -> list[str]:
        """word in two where its beginning is a usual word, as long a one as there is."""
        for exact in (True, False):
            for k in range(len(word) - 4, 2 if exact else 3, -1):
                if word[:k] in self.frequent or not exact and self.resolve(word[:k])[1]:
                    return [word[:k], word[k:]]
        return [word]

    def initials(self, given: list[str]) -> list[str]:
        """First letters of the given words and of the full names they may be short for."""
        found = {w[0] for w in given}
        for w in given:
            found |= {f[0] for f in self.full(w)}
            if len(w) > 1 and w not in self.frequent:
                found |= {f[0] for f in self.frequent if shortened(w, f)}
        return sorted(found) or [""]

    def trade(self, word: str) -> tuple[str, bool]:
        """The line of business that a word stands for, or word itself, and whether it is a usual one."""
        learnt = self.short.get(word)
        if learnt:
            best = sorted(learnt.items(), key=lambda x: (-x[1], x[0]))
            if len(best) == 1 or best[0][1] >= 1.5 * best[1][1]:
                return best[0][0], True
            return word, True
        got, usual = self.resolve(word)
        if len(got) > 1 and (not usual or got not in self.frequent):
            known = [w for w in self.frequent if w not in self.short]
            found = [w for w in known if len(w) >= 5 and abbreviates(got, w)] or [w for w in known if min(len(w), len(got)) > TWO_EDITS - 1 and near(got, w) <= 2]
            if found:
                return (found[0], True) if len(found) == 1 else (got, True)
        return got, usual

    def organisation(self, every: list[str]) -> tuple[list[str], str, str] | None:
        """(lines of business in order, base, legal form); None if it names nobody."""
        text = " ".join(every)
        form = ""
        for phrase, short in FORM_PHRASES.items():
            if phrase in text:
                form, text = short, text.replace(phrase, " ")
        own = []
        for w in text.split():
            if w in FORMS:
                form = form or FORMS[w]
            elif w not in CONNECTORS:
                own.append(w)
        if not own or all(w in FILLERS or w.isdigit() or set(w) == {"x"} for w in own):
            return None
        done = [self.trade(w) for w in own]
        rare = [n for n, (_, usual) in enumerate(done) if not usual]
        at = rare[0] if rare else 0
        return sorted({done[n][0] for n in range(len(done)) if n != at and len(done[n][0]) > 1}), sound(own[at]), form


def _grams(base: str) -> set[str]:
    padded = f"^{base}$"
    return {padded[k : k + GRAM] for k in range(len(padded) - GRAM + 1)}


def cosine(a: str, b: str, weight: dict[str, float], usual: float) -> float:
    """The cosine of the weighted n-gram vectors of two bases."""
    x, y = _grams(a), _grams(b)
    square = lambda g: sum(weight.get(t, usual) ** 2 for t in g)
    return square(x & y) / math.sqrt(square(x) * square(y))


def _word_match(a: str, b: str, parts: Parts) -> float:
    """How well two words of a person's name agree."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.85 if a[0] == b[0] or any(a[0] == f[0] for f in parts.full(b)) or any(b[0] == f[0] for f in parts.full(a)) else 0.0
    if b in parts.full(a) or a in parts.full(b) or parts.full(a) & parts.full(b):
        return 0.9
    if a in parts.frequent and b in parts.frequent:
        return 0.0
    if shortened(a, b) or shortened(b, a):
        return 0.9
    if max(len(a), len(b)) >= 3 and near(a, b) <= 1:
        return 0.9
    short, full = sorted((a, b), key=len)
    if short not in parts.frequent and len(short) >= 4:  # a short form with a typo
        sizes = range(len(short) - 1, len(short) + 2)
        if any(near(short, full[:k]) <= 1 or near(short, full[-k:]) <= 1 for k in sizes if k < len(full)) or any(full in f and near(short, n) <= 1 for n, f in parts.short.items()):
            return 0.75
    return 0.0


def _trade_match(a: str, b: str, parts: Parts) -> float:
    """How well two lines of business agree."""
    if a == b:
        return 1.0
    if b in parts.full(a) or a in parts.full(b):
        return 0.95
    if a in parts.frequent and b in parts.frequent:
        return 0.0
    short, full = sorted((a, b), key=len)
    if abbreviates(short, full):
        return 0.95
    return 0.95 if near(a, b) <= (2 if len(short) >= 7 else 1) else 0.0


def similarity(kind: str, a: tuple[list[str], str, str], b: tuple[list[str], str, str], parts: Parts) -> float:
    """How well the words beside the base agree, 0 where two names can't be the same."""
    few, many = sorted((list(a[0]), list(b[0])), key=len)
    if kind == "supplier":
        if len(few) != len(many) or (a[2] and b[2] and a[2] != b[2]):
            return 0.0
    elif not few and many:
        return 0.3
    score, left, match = 1.0, list(many), _trade_match if kind == "supplier" else _word_match
    for w in sorted(few, key=len, reverse=True):
        best = max(left, key=lambda x: match(w, x, parts))
        got = match(w, best, parts)
        if not got:
            return 0.0
        score = min(score, got)
        left.remove(best)
    if kind == "supplier":
        return score * (1.0 if a[2] == b[2] else 0.9)
    return score * (0.85 if left else 1.0)


def _worded(named: DataFrame) -> DataFrame:
    """(kind, id, words) of rows (kind, id, name)."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"kind": frame["kind"], "id": frame["id"], "words": [words(n) for n in frame["name"]]})

    return named.mapInPandas(split, "kind string, id long, words array<string>")


def _lexicons(rows: DataFrame) -> dict[str, Parts]:
    """What each kind of name is taken apart by: its frequent words and short forms of them."""
    counted = checkpointed(rows.select("kind", F.explode(F.array_distinct("words")).alias("word")).groupBy("kind", "word").agg(F.count("*").alias("n")))
    sizes = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    least = lambda share: F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(ADDED + share * n))]), F.col("kind"))
    frequent: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for r in counted.where(F.col("n") >= least(FREQUENT)).collect():
        frequent[r["kind"]][r["word"]] = r["n"]
    # Names of two words, one of which isn't frequent: that one is the base, the other stands beside it
    known = counted.where(F.col("n") >= least(SHORT)).select("kind", "word", "n", (F.col("n") >= least(FREQUENT)).alias("usual"))
    plain = F.array(*[F.lit(w) for w in sorted(TITLES | set(FORMS) | CONNECTORS)])
    two = rows.select("kind", F.filter(F.array_except("words", plain), lambda w: F.length(w) > 1).alias("w")).where("size(w) = 2")
    beside = two.select("kind", F.inline(F.array(F.struct(F.col("w")[0].alias("base"), F.col("w")[1].alias("word")), F.struct(F.col("w")[1].alias("base"), F.col("w")[0].alias("word"))))).distinct()
    bases = counted.where(F.col("n") < least(FREQUENT)).select("kind", F.col("word").alias("base"))
    beside = checkpointed(beside.join(known, ["kind", "word"]).join(bases, ["kind", "base"]))
    own = beside.groupBy("kind", "word").agg(F.count("*").alias("held")).where(F.col("held") >= ADDED + 1)
    full = beside.where("usual").select("kind", "base", F.col("word").alias("full"), F.col("n").alias("many"))
    both = beside.join(full, ["kind", "base"]).where(F.col("many") >= RARER * F.col("n")).groupBy("kind", "word", "full").agg(F.count("*").alias("both"))
    learnt = both.join(own, ["kind", "word"]).withColumn("part", F.col("both") / (F.col("held") + DOUBT)).where(F.col("part") >= BESIDE)
    found: dict[str, dict[str, dict[str, float]]] = {k: {} for k in sizes}
    for r in learnt.select("kind", "word", "full", "part").collect():
        found[r["kind"]].setdefault(r["word"], {})[r["full"]] = r["part"]
    made = {}
    for kind, short in found.items():
        usual = frequent[kind]
        typos = {w for w in short if len(w) > 4 and any(near(w, x) == 1 and n > usual.get(w, 0) for x, n in usual.items())}
        clean = {w: {x: p for x, p in full.items() if x not in short} for w, full in short.items() if w not in typos}
        made[kind] = Parts(usual, {w: full for w, full in clean.items() if full})
    return made


def _classes(rows: DataFrame, lexicons: dict[str, Parts]) -> DataFrame:
    """(kind, id, rest, base, form, keys) of all rows that name somebody.

    Names of one entity share a key: the initial of a given name, or the number of lines of
    business. Keys keep lists short where one base is very frequent.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, own, every in zip(frame["kind"], frame["id"], frame["words"], strict=True):
                parts = lexicons[kind]
                got = (parts.organisation if kind == "supplier" else parts.person)(list(every))
                if got:
                    keys = [str(len(got[0]))] if kind == "supplier" else parts.initials(got[0])
                    out.append((kind, own, got[0], got[1], got[2], keys))
            yield pd.DataFrame(out, columns=["kind", "id", "rest", "base", "form", "keys"])

    return rows.mapInPandas(parse, "kind string, id long, rest array<string>, base string, form string, keys array<string>")


def letters(base: str) -> int:
    """Bits for the letters and digits of base that occur once, and again for those that occur twice.

    An edit changes two bits at most, and one that swaps neighbours none.
    """
    bits = 0
    for c in base:
        at = ord(c) % 31
        bits |= 1 << at + (31 if bits >> at & 1 else 0)
    return bits


def prefix(base: str, weight: dict[str, float], usual: float) -> list[str]:
    """The grams of base, from the rarest, one of which it shares with all bases of a cosine of COSINE or more.

    They are also the first that the two share in this order, so both have it in their prefix.
    """
    ordered = sorted(_grams(base), key=lambda g: (-weight.get(g, usual), g))
    squares = [weight.get(g, usual) ** 2 for g in ordered]
    whole = rest = sum(squares)
    for n, one in enumerate(squares, 1):
        rest -= one
        if rest < COSINE**2 * whole * (1 - 1e-9):
            return ordered[:n]
    return ordered


def similar_bases(keyed: DataFrame) -> DataFrame:
    """(kind, base, base2, angle) of the bases of rows (kind, key, base) that share a key, base < base2.

    Their vectors have a cosine, angle, of COSINE or more, and they differ by no more than edits() allows.
    """
    bases = checkpointed(keyed.select("kind", "base").distinct())
    grams = F.expr(f"transform(sequence(1, greatest(1, length(base) + 2 - {GRAM} + 1)), k -> substring(concat('^', base, '$'), k, {GRAM}))")
    counted = {r["gram"]: r["n"] for r in bases.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # at most 38 ^ GRAM
    total = bases.count()
    weight, usual = {g: math.log(1 + total / n) for g, n in counted.items()}, math.log(1 + total)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for kind, base in frame.itertuples(index=False):
                bits = letters(base)
                rows += [(kind, base, g, -(-counted.get(g, 1) // LIST), len(base), bits) for g in prefix(base, weight, usual)]
            yield pd.DataFrame(rows, columns=["kind", "base", "gram", "splits", "size", "bits"])

    indexed = checkpointed(bases.mapInPandas(index, "kind string, base string, gram string, splits int, size int, bits long").join(keyed.select("kind", "key", "base").distinct(), ["kind", "base"]))
    left = indexed.withColumn("salt", F.pmod(F.xxhash64("base"), F.col("splits")).cast("int"))
    right = indexed.select("kind", "key", "gram", F.col("base").alias("base2"), F.col("size").alias("size2"), F.col("bits").alias("bits2"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"))
    may = 1 + (F.least("size", "size2") >= TWO_EDITS).cast("int")
    within = (F.abs(F.col("size") - F.col("size2")) <= may) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))) <= 2 * may)
    met = left.join(right, ["kind", "key", "gram", "salt"]).where((F.col("base") < F.col("base2")) & within).select("kind", "base", "base2").distinct()

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, a, b in frame.itertuples(index=False):
                angle = cosine(a, b, weight, usual)
                if angle >= COSINE and near(a, b) <= edits(min(len(a), len(b))):
                    out.append((kind, a, b, angle))
            yield pd.DataFrame(out, columns=["kind", "base", "base2", "angle"])

    return met.mapInPandas(check, "kind string, base string, base2 string, angle double")


def _similar(pairs: DataFrame, lexicons: dict[str, Parts]) -> DataFrame:
    """(kind, a, b, sim) of the pairs of classes that agree."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, a, rest, base, form, b, rest2, base2, form2, angle in frame.itertuples(index=False):
                sim = (0.7 + 0.3 * angle) * similarity(kind, (list(rest), base, form), (list(rest2), base2, form2), lexicons[kind])
                if sim >= LINKAGE:
                    out.append((kind, a, b, sim))
            yield pd.DataFrame(out, columns=["kind", "a", "b", "sim"])

    return pairs.mapInPandas(check, "kind string, a long, b long, sim double")


def average_linkage(pairs: DataFrame, threshold: float) -> DataFrame:
    """(kind, item, cluster) by average linkage of pairs (kind, a, b, sim), a < b.

    Pairs that aren't given have similarity 0. Items in no cluster but their own may be missing.
    Rounds of distributed joins; nothing is gathered by cluster or component.
    """
    edges = checkpointed(pairs.select("kind", "a", F.lit(1).cast("long").alias("na"), "b", F.lit(1).cast("long").alias("nb"), F.col("sim").alias("total")))
    member = checkpointed(edges.select("kind", F.explode(F.array("a", "b")).alias("item")).distinct().withColumn("cluster", F.col("item")))
    while True:
        mean = F.round(F.col("total") / (F.col("na") * F.col("nb")), 9)
        close = edges.withColumn("mean", mean).where(F.col("mean") >= threshold)
        rank = F.struct("mean", -F.col("a"), -F.col("b"))
        both = close.select("kind", F.col("a").alias("x"), rank.alias("edge"), "na", "nb").union(close.select("kind", F.col("b"), rank, "na", "nb"))
        best = both.groupBy("kind", "x").agg(F.max("edge").alias("edge"))
        merged = checkpointed(best.groupBy("kind", "edge").agg(F.count("*").alias("n")).where("n = 2").select("kind", (-F.col("edge.col2")).alias("into"), (-F.col("edge.col3")).alias("gone")))
        if not merged.take(1):
            return member
        grown = merged.join(edges.select("kind", F.col("a").alias("into"), F.col("b").alias("gone"), "na", "nb"), ["kind", "into", "gone"]).select("kind", "into", "gone", (F.col("na") + F.col("nb")).alias("size"))
        moves = checkpointed(grown.select("kind", F.col("gone").alias("old"), F.col("into").alias("new"), "size").union(grown.select("kind", "into", "into", "size")))
        side = lambda c: moves.select("kind", F.col("old").alias(c), F.col("new").alias(f"new_{c}"), F.col("size").alias(f"size_{c}"))
        moved = edges.join(side("a"), ["kind", "a"], "left").join(side("b"), ["kind", "b"], "left")
        a, b = F.coalesce("new_a", "a"), F.coalesce("new_b", "b")
        na, nb = F.coalesce("size_a", "na"), F.coalesce("size_b", "nb")
        turned = moved.where(a != b).select(
            "kind", F.least(a, b).alias("a"), F.when(a < b, na).otherwise(nb).alias("na"), F.greatest(a, b).alias("b"), F.when(a < b, nb).otherwise(na).alias("nb"), "total"
        )
        edges = checkpointed(turned.groupBy("kind", "a", "na", "b", "nb").agg(F.sum("total").alias("total")))
        member = checkpointed(member.join(moves.select("kind", F.col("old").alias("cluster"), "new"), ["kind", "cluster"], "left").select("kind", "item", F.coalesce("new", "cluster").alias("cluster")))


def link_names(named: DataFrame) -> DataFrame:
    """(kind, id, entity) of every row of named (kind, id, name) that names somebody.

    kind is 'supplier' for organisations; all other kinds are persons. Only rows of a kind are
    linked. entity is the smallest id of the entity's spellings.

    Cases: null, empty, blank and filler names name nobody and are left out; equal spellings are one
    class, so their number costs nothing; rows with null kind or id are left out; no rows give no
    rows; other columns are ignored; accents, letter case, titles and word order don't matter.
    """
    usable = named.where("kind is not null and id is not null and name is not null").select("kind", F.col("id").cast("long").alias("id"), "name")
    worded = checkpointed(_worded(usable))
    lexicons = _lexicons(worded)
    rows = checkpointed(_classes(worded, lexicons))
    by_class = checkpointed(rows.groupBy("kind", "rest", "base", "form", "keys").agg(F.min("id").alias("cls")))
    keyed = by_class.withColumn("key", F.explode("keys")).drop("keys")
    other = keyed.select("kind", "key", F.col("cls").alias("b"), F.col("rest").alias("rest2"), F.col("base").alias("base2"), F.col("form").alias("form2"))
    met = similar_bases(keyed).union(keyed.select("kind", "base", F.col("base"), F.lit(1.0)).distinct())
    pairs = (
        met.join(keyed, ["kind", "base"]).join(other, ["kind", "key", "base2"])
        .where((F.col("base") < F.col("base2")) | (F.col("cls") < F.col("b")))
        .select("kind", F.col("cls").alias("a"), "rest", "base", "form", "b", "rest2", "base2", "form2", "angle")
        .dropDuplicates(["kind", "a", "b"])
    )
    found = _similar(pairs, lexicons)
    ordered = found.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
    clusters = average_linkage(ordered, LINKAGE)
    mine = rows.join(by_class, ["kind", "rest", "base", "form", "keys"]).select("kind", "id", F.col("cls").alias("item"))
    return mine.join(clusters, ["kind", "item"], "left").select("kind", "id", F.coalesce("cluster", "item").alias("entity"))


def same_entity_pairs(linked: DataFrame) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b, of all rows of one entity."""
    a, b = linked.withColumnRenamed("id", "id_a"), linked.withColumnRenamed("id", "id_b")
    return a.join(b, ["kind", "entity"]).where("id_a < id_b").select("kind", "id_a", "id_b")
