"""A score for abusive, hateful or sexually explicit content of every document.

Method: noisy-channel deobfuscation. Words that look disguised become a lattice of the characters that
they may stand for: digits, signs and masks for letters, signs between letters, repeated letters,
swapped neighbours. A Viterbi search takes the path that a character language model finds most likely,
and the restored text is scored. Letters set apart are parted into words by the same model.

  * The language model mixes the character trigrams of all documents, a table that the alphabet
    bounds, with the words of the seed list, which have SHARE of the probability. The list is text of
    the model and nothing else: its words are found as the model's paths through the lattice.
  * The score of a sentence is the sum of the weights of its words and pairs of neighbouring words, each
    counted once; that of a document is its highest sentence. Weights start from the seed list and are fitted to
    the labelled documents by logistic regression over their sentences. A label holds for a document
    and not for each sentence, so of a document labelled as bad only the sentence counts that the
    weights so far find worst; one whose worst sentence still looks harmless is taken as labelled
    wrongly, and so is one labelled as good with a sentence that looks bad. The classifier is fitted to a bounded sample: LABELLED documents, and of each the WORST
    sentences and, of good ones, OTHERS evenly spaced; then it is fitted again with the WORST by its own
    weights added, as a harmless sentence that many documents have is rare among those first taken.
  * A document is flagged where its worst sentence is bad with a probability of PROBABLE or more by the
    regression, in which a bad sentence counts BAD_WEIGHT times. Scores are log-odds above that.

Whole texts are scored, comments and macros included.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weftline.session import checkpointed

#: The sample the classifier is fitted to: labelled documents, worst sentences of each, and others of
#: good ones. Words count for the first ranking of sentences if LEAST bad documents have them.
LABELLED, WORST, OTHERS, LEAST = 20_000, 3, 5, 2
#: The probability from which a document is flagged.
PROBABLE = 0.2
#: What is added to the seed list's weights where there are no labels, and how weights are fitted: rounds,
#: steps of a round, rate, pull to the seed list.
BIAS, ROUNDS, STEPS, RATE, PULL = -2.5, 3, 150, 0.1, 5e-4
#: Words of a sentence; longer ones are taken as several.
LONGEST = 200
#: What a bad sentence counts against a harmless one.
BAD_WEIGHT = 4.0
#: Values below which a label that calls a document bad is taken as wrong, and from which one that calls it good.
DOUBT, DOUBT_GOOD = -1.0, 2.5
#: Share of the seed list in the language model.
SHARE = 0.2
#: Costs of the channel: a sign at an edge of a word for none of its letters, where another is disguised
#: too, a sign between letters for nothing, neighbours that have changed places.
DROP, DROP_DISGUISED, DROP_INSIDE, SWAP = 1.0, 5.0, 1.0, 3.0

# Words that insult, threaten or demean, or describe sex explicitly, by language.
SEEDS = {
    3.0: (
        "fuck fucks fucked fucking fucker fuckers motherfucker shit shitty bullshit asshole assholes bitch bitches bastard bastards dickhead dipshit dumbass "
        "jackass cunt cunts whore whores slut sluts prick twat wanker faggot faggots retard retards scumbag scum halfwit moron imbecile nitwit "
        "cocksucker blowjob cum tits pussy nudes dick dicks subhuman subhumans "
        "arschloch scheisse scheiss fotze hure hurensohn wichser missgeburt fresse drecksau schlampe vollidiot ficken fick schwuchtel untermenschen abschaum "
        "connard connards connasse salope putain encule enculer batard gueule merde nique ta pute "
        "puta puto mierda cabron gilipollas pendejo hijo maricon zorra chinga joder imbecil verga polla "
        "bangsat bajingan goblok tolol kontol memek ngentot jancok perek pelacur keparat brengsek kampret"
    ).split(),
    1.5: (
        "stupid idiot idiots dumb brainless pathetic worthless loser ugly clown hack ass cock naked nude moaning undress thrust panties underwear horny "
        "vermin filth filthy cockroaches animals primitive inferior parasites exterminate gassed deport kill die dies choke chokes bleach throats skull "
        "dumm dummes dummer hirnloser versager missraten verrecke abstechen halt creve ferme espece vermine exterminer inutil basura callate muere "
        "bodoh anjing babi sampah mati bacot otak dungu"
    ).split(),
}
# What characters in disguised words stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "€": "e", "£": "l"}
MASKS = "#*"
# Letters of other alphabets that look like Latin ones.
LOOK = dict(zip("авекмнорстухіјѕԁһԛԝɡɑαβεηικνορτυχѵ", "abekmhopctyxijsdhqwgaabenikvoptuxv", strict=True))
HIDDEN = dict.fromkeys(map(ord, "​‌‍⁠﻿­᠎"))
_SWAP = str.maketrans(HIDDEN | {ord(a): b for a, b in LOOK.items()} | {ord("ß"): "ss", ord("ø"): "o", ord("ł"): "l", ord("æ"): "ae", ord("œ"): "oe", ord("ı"): "i"})
_ODD = re.compile("[" + "".join(map(chr, _SWAP)) + "]")
_MARKS, _OTHER = re.compile("[̀-ͯ]+"), re.compile("[^\x00-\x7f€£]+")

_FORMAT = r"\\(?:textbf|textit|emph|texttt|textsc|textrm|textsf|underline|mbox)\{([a-z]+)\}"
#: Formatting of a part of a word, which is taken away so that the word is whole again.
GROUP, COMMAND = re.compile(r"\{\\(?:it|bf|em|tt|sl|sc|rm)\s+([a-z]+)\}"), re.compile(_FORMAT)
#: Letters one by one, or with signs for some of them.
SPREAD = re.compile(r"(?<![a-z0-9])[a-z](?:([ .\-_~])\1*[a-z@$*0134578](?![a-z0-9@$*])){2,}")
_APART = re.compile(r"[ .\-_~]+")
#: The longest word that letters one by one are parted into.
PARTED = 24
_SIGN = "0-9@$+|€£#*"
#: Words, with the digits and signs that may stand for letters, and what ends a sentence: its signs,
#: blank lines, arguments, commands that set text apart.
TOKEN = re.compile(rf"[a-z{_SIGN}]+(?:!+[a-z{_SIGN}]+)*|[.!?]+(?=\s)|\n\s*\n|\}}\{{|\}}\s*\n|\n\s*\\[a-z]+|\\(?:footnote|begin|end|item|section|todo)\b")
ENDS = set(".!?\n}\\")
DISGUISED = re.compile(rf"[!{_SIGN}]?[a-z]*(?:[!{_SIGN}]{{1,6}}[a-z]+)*[!{_SIGN}]{{0,6}}")
EDGE = "0123456789@$+|€£#*!"
#: Years at an edge of a word stand for no letters; with a letter after them they are citation keys.
CITED, AT_EDGE = r".*[a-z]{3}(?:1[5-9]|20)\d\d[a-z]$", re.compile(r"^(?:1[5-9]|20)\d\d(?!\d)|(?<!\d)(?:1[5-9]|20)\d\d$")
YEAR = re.compile(rf"(?:1[5-9]|20)\d\d(?!\d)|.*(?<!\d)(?:1[5-9]|20)\d\d$|{CITED}")
RUN = re.compile(r"([a-z])\1\1")
#: One character drawn out, which is taken as three; words with signs of more than DRAWN characters have no more of any.
LONG_RUN, DRAWN = re.compile(r"(.)\1{3,}"), 60


def fold(text: str) -> str:
    """text in lower case, without accents and hidden characters, look-alike letters as Latin ones."""
    low = text.lower()
    if low.isascii():
        return low
    if _ODD.search(low):
        low = low.translate(_SWAP)
    return _OTHER.sub(" ", _MARKS.sub("", unicodedata.normalize("NFKD", low)))


class _Resolved(dict):
    """The words that tokens stand for; new tokens are looked into."""

    def __init__(self, look: Callable[[str], str]) -> None:
        super().__init__()
        self.look = look

    def __missing__(self, token: str) -> str:
        if len(self) >= 300_000:
            self.clear()
        got = self[token] = self.look(token)
        return got


class Restorer:
    """Restores disguised words by Viterbi search under a character trigram model and a word list."""

    def __init__(self, counts: np.ndarray, seeds: dict[str, float]) -> None:
        grams = counts.astype(float) + 0.05
        self.log = np.log(grams / grams.sum(axis=2, keepdims=True)).tolist()
        self.trigram, self.listed = math.log(1 - SHARE), math.log(SHARE / max(1, len(seeds)))
        self.seeds = set(seeds)
        self.trie: dict = {}
        for w in seeds:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = {}
        # Stretches of letters that words of the list have where neighbours change places
        self.twists = {t[max(0, min(k - 1, len(w) - 4)) :][:4] for w in seeds if len(w) >= 4 for k in range(len(w) - 1) if w[k] != w[k + 1] for t in (w[:k] + w[k + 1] + w[k] + w[k + 2 :],)}
        self.known, self.apart = _Resolved(self.resolve), _Resolved(self.parted)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "apart")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.known, self.apart = _Resolved(self.resolve), _Resolved(self.parted)

    def likelihood(self, word: str) -> float:
        """The log probability of a word, by the likelier part of the model."""
        codes = [0, 0, *[ord(c) - 96 for c in word], 0]
        own = self.trigram + sum(self.log[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
        return max(own, self.listed) if word in self.seeds else own

    def lattice(self, word: str) -> list[list[tuple[str, int, float]]]:
        """For each place of word the arcs (characters, places taken, cost) that leave it."""
        arcs: list[list[tuple[str, int, float]]] = []
        for k, c in enumerate(word):
            run = 1
            while k + run < len(word) and word[k + run] == c:
                run += 1
            if c in MASKS:
                out = [(x, 1, 1.0) for x in "abcdefghijklmnopqrstuvwxyz"]
            elif c in LEET:
                out = [(x, 1, 0.5) for x in LEET[c]]
            elif "a" <= c <= "z":
                out = [(c, 1, 0.0)] + ([(c, run, 0.2), (c + c, run, 0.4)] if run > 2 else [])
                if k + 1 < len(word) and "a" <= word[k + 1] <= "z" and word[k + 1] != c:
                    out.append((word[k + 1] + c, 2, SWAP))
            else:
                out = [("", 1, 0.1)]
            if c in "*#+|" and 0 < k < len(word) - 1:
                out.append(("", 1, DROP_INSIDE))
            arcs.append(out)
        # Signs at the end may also stand for nothing, and around a word of letters those at the beginning
        core = word.strip(EDGE)
        last = len(word.rstrip(EDGE))
        for k in range(max(1, last), len(word)):
            arcs[k].append(("", len(word) - k, DROP if core.isalpha() else DROP_DISGUISED))
        first = len(word) - len(word.lstrip(EDGE))
        if core.isalpha() and 0 < first < last < len(word):
            arcs[0].append(("", first, DROP))
        return arcs

    def decode(self, word: str, free: bool = True) -> str:
        """The most likely word behind word; without free only words of the list, '' if none fits."""
        arcs = self.lattice(word)
        ends = []
        if free:
            best: list[dict[tuple[int, int], tuple[float, str]]] = [{} for _ in range(len(word) + 1)]
            best[0][(0, 0)] = (self.trigram, "")
            for k, states in enumerate(best[:-1]):
                for (a, b), (score, made) in states.items():
                    for text, size, cost in arcs[k]:
                        x, y, now = a, b, score - cost
                        for c in text:
                            n = ord(c) - 96
                            now += self.log[x][y][n]
                            x, y = y, n
                        there = best[k + size]
                        if (x, y) not in there or there[(x, y)][0] < now:
                            there[(x, y)] = (now, made + text)
            ends = [(score + self.log[a][b][0], made) for (a, b), (score, made) in best[-1].items()]
        # The same search over the word list: a state is what of its words has been spelt
        spelt: list[dict[str, tuple[float, dict]]] = [{} for _ in range(len(word) + 1)]
        spelt[0][""] = (self.listed, self.trie)
        for k, known in enumerate(spelt[:-1]):
            for made, (score, node) in known.items():
                for text, size, cost in arcs[k]:
                    at = node
                    for c in text:
                        at = at.get(c)
                        if at is None:
                            break
                    if at is not None:
                        there, now = spelt[k + size], made + text
                        if now not in there or there[now][0] < score - cost:
                            there[now] = (score - cost, at)
        ends += [(score, made) for made, (score, node) in spelt[-1].items() if "" in node]
        return max(ends)[1] if ends else ""

    def twisted(self, word: str) -> bool:
        """Whether neighbours may have changed places so that a word of the list is hidden."""
        return any(word[k : k + 4] in self.twists for k in range(len(word) - 3))

    def resolve(self, token: str) -> str:
        """The word that a token stands for: restored, '' if it is none, '.' where a sentence ends."""
        if token[0] in ENDS and not token.lstrip("!").isalnum():
            return "."
        if token.isalpha():
            if RUN.search(token):
                return self.decode(LONG_RUN.sub(r"\1\1\1", token))
            return self.decode(token) if token not in self.seeds and self.twisted(token) else token
        if len(token) > DRAWN:
            token = LONG_RUN.sub(r"\1\1\1", token)
        core = token.strip(EDGE)
        if core and len(token) >= 3 and DISGUISED.fullmatch(token):
            around = token.split(core, 1)
            if core.isalpha() and (around[0] == around[1] or core in self.seeds):
                return self.resolve(core)
            if YEAR.match(token):
                rest = AT_EDGE.sub("", token)
                return self.resolve(rest) if rest and rest != token else ""
            held = sum(c.isalpha() for c in token)
            if held >= 2:
                return self.decode(token)
            if len(token) > 3 or not any(c.isdigit() or c in MASKS for c in token):  # not such as d13 or a**
                return self.decode(token, False) or (core if core.isalpha() else "")
        return core if core.isalpha() else ""

    def parted(self, letters: str) -> str:
        """The likeliest words of letters that stood one by one."""
        if not letters.isalpha():
            return self.decode(letters, False)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(letters)
        for end in range(1, len(letters) + 1):
            best[end] = max((best[k][0] + self.likelihood(letters[k:end]), k) for k in range(max(0, end - PARTED), end))
        out, end = [], len(letters)
        while end:
            out.append(letters[best[end][1] : end])
            end = best[end][1]
        return " ".join(out[::-1])

    def words(self, text: str) -> list[str]:
        """The words of a text as it is scored, with '.' where sentences end and '' for other signs."""
        plain = fold(text).replace("{}", "").replace("\\-", "").replace("\\/", "")
        plain = COMMAND.sub(r"\1", GROUP.sub(r"\1", plain))
        plain = SPREAD.sub(lambda m: self.apart[_APART.sub("", m[0])] or m[0], plain)
        return list(map(self.known.__getitem__, TOKEN.findall(plain)))


class Model:
    """Weights of words and pairs of words, and the sentences they make up."""

    def __init__(self, restorer: Restorer, single: dict[str, float], double: dict[tuple[str, str], float], bias: float = 0.0) -> None:
        self.restorer, self.bias = restorer, bias
        names = sorted({*single, *(w for pair in double for w in pair)})
        self.number = {w: n for n, w in enumerate(names, 1)}
        self.number["."] = -1
        self.size = len(names) + 1
        self.single = np.zeros(self.size)
        for w, v in single.items():
            self.single[self.number[w]] = v
        keys = sorted((self.number[a] * self.size + self.number[b], v) for (a, b), v in double.items())
        self.keys = np.array([k for k, _ in keys] or [-1], np.int64)
        self.double = np.array([v for _, v in keys] or [0.0])
        self.weights = np.concatenate([self.single, self.double])

    def sentences(self, text: str | list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The tokens of the text, restored unless it is given so, where sentences begin, and the scores of these."""
        tokens = self.restorer.words(text) if isinstance(text, str) else text
        if not tokens:
            return tokens, np.zeros(1, np.int64), np.zeros(1)
        numbers = np.array([*map(self.number.get, tokens, repeat(0))], np.int64)
        starts = np.unique(np.concatenate([[0], np.flatnonzero(numbers < 0)]))
        gaps = np.diff(starts, append=len(tokens))
        if gaps.max() > LONGEST:  # text without sentence ends is taken in stretches
            starts = np.concatenate([np.arange(a, a + n, LONGEST) for a, n in zip(starts, gaps, strict=True)])
            gaps = np.diff(starts, append=len(tokens))
        # As in the fit, what a sentence has more than once counts once
        place = np.repeat(np.arange(len(starts)) * len(self.weights), gaps)
        a, b = numbers[:-1], numbers[1:]
        beside = np.flatnonzero((a > 0) & (b > 0) & (place[:-1] == place[1:]))
        pair = a[beside] * self.size + b[beside]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = self.keys[at] == pair
        held = np.sort(np.concatenate([(place + numbers)[numbers > 0], place[beside[known]] + self.size + at[known]]))
        held = held[np.diff(held, prepend=-1) > 0]
        where, feature = np.divmod(held, len(self.weights))
        return tokens, starts, np.bincount(where, self.weights[feature], len(starts)) + self.bias

    def plain(self, sentence: str) -> float:
        """The score of a sentence of restored words between blanks."""
        numbers = [self.number.get(w, 0) for w in sentence.split()]
        total = float(self.single[[*set(numbers)]].sum()) if numbers else 0.0
        for a, b in {*zip(numbers, numbers[1:], strict=False)}:
            if a and b:
                at = int(np.searchsorted(self.keys, a * self.size + b))
                if at < len(self.keys) and self.keys[at] == a * self.size + b:
                    total += float(self.double[at])
        return total + self.bias

    def score(self, text: str) -> float:
        """The score of the highest sentence of a text; 0 for harmless ones."""
        return float(max(0.0, self.sentences(text)[2].max()))

    def worst(self, text: str | list[str], n: int, others: int = 0) -> list[str]:
        """The n highest sentences of a text, as words between blanks, and some evenly spaced others."""
        tokens, starts, scores = self.sentences(text)
        ends = [*starts[1:], len(tokens)]
        order = np.argsort(-scores, kind="stable")
        rest = np.sort(order[n:])
        order = [*order[:n], *rest[:: max(1, len(rest) // others)][:others]] if others else order[:n]
        return [" ".join(t for t in tokens[starts[k] : ends[k]] if len(t) > 1 or t.isalpha()) for k in order]


def _telling(word: str) -> bool:
    """Whether a word may be a feature: initials and symbols of one letter tell nothing."""
    return len(word) > 1 or word in ("i", "a", "u", "y")


def _features(sentence: str) -> list[tuple[str, str | None]]:
    own = sentence.split()
    return list(dict.fromkeys([(w, None) for w in own if len(w) > 1] + [(a, b) for a, b in zip(own, own[1:], strict=False) if _telling(a) and _telling(b)]))


def _unfitted() -> tuple[dict, dict, float]:
    """The weights without labels: those of the seed list."""
    return {w: v for v, ws in SEEDS.items() for w in ws}, {}, BIAS


def _regression(bags: list[tuple[int, list[str]]]) -> tuple[dict, dict, float]:
    """Weights of words, of pairs, and the bias, fitted to (bad, worst sentences) of documents.

    All sentences of good documents count as harmless, the worst one of bad documents as bad. What
    only one document has tells nothing and gets no weight.
    """
    features = {s: _features(s) for _, own in bags for s in own}
    held = Counter(f for _, own in bags for f in {f for s in own for f in features[s]})
    index = {f: n for n, f in enumerate([f for f, n in held.items() if n > 1] + [("", None)])}
    # Sentences with the same features are one row, with the sum of their shares
    places: dict[tuple[int, ...], int] = {}
    numbers = {s: places.setdefault(tuple(index[f] for f in fs if f in index) or (index[("", None)],), len(places)) for s, fs in features.items()}
    which = np.array([numbers[s] for _, own in bags for s in own], np.int64)
    if not len(which):
        return _unfitted()
    flat = list(places)
    sizes = np.array([len(r) for r in flat])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    column = np.concatenate([np.array(r) for r in flat])
    by_column = np.argsort(column, kind="stable")
    row = np.repeat(np.arange(len(flat)), sizes)[by_column]
    used_columns, column_starts = np.unique(column[by_column], return_index=True)
    held_by = [len(own) for _, own in bags]
    bag = np.repeat(np.arange(len(bags)), held_by)
    first = np.concatenate([[0], np.cumsum(held_by)[:-1]])
    bad = np.array([b for b, _ in bags], bool)
    prior = np.zeros(len(index))
    for value, words in SEEDS.items():
        for w in words:
            if (w, None) in index:
                prior[index[(w, None)]] = value
    weight, bias = prior.copy(), -2.0
    value = lambda: np.add.reduceat(weight.take(column), starts) + bias
    moment, square, moment0, square0, step = np.zeros(len(index)), np.zeros(len(index)), 0.0, 0.0, 0
    for turn in range(ROUNDS):
        now = value()[which]
        top = np.array([f + int(np.argmax(now[f : f + n])) for f, n in zip(first, held_by, strict=True)])
        target = np.zeros(len(which))
        target[top[bad]] = 1.0
        used = ~bad[bag]
        used[top] = True
        share = np.where(target > 0, BAD_WEIGHT, 1.0) * used
        share /= share.sum()
        shares, wanted = np.bincount(which, share, len(flat)), np.bincount(which, share * target, len(flat))
        for _ in range(STEPS):
            step += 1
            slip = shares / (1 + np.exp(-np.clip(value(), -30, 30))) - wanted
            grad = PULL * (weight - prior) / len(index) ** 0.5
            grad[used_columns] += np.add.reduceat(slip[row], column_starts)
            moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
            weight -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
            moment0, square0 = 0.9 * moment0 + 0.1 * slip.sum(), 0.99 * square0 + 0.01 * slip.sum() ** 2
            bias -= RATE * (moment0 / (1 - 0.9**step)) / (math.sqrt(square0 / (1 - 0.99**step)) + 1e-6)
    single = {w: v for v, ws in SEEDS.items() for w in ws}
    single |= {a: float(weight[n]) for (a, b), n in index.items() if b is None and a}
    return single, {(a, b): float(weight[n]) for (a, b), n in index.items() if b is not None}, float(bias)


def _trusted(restorer: Restorer, bags: list[list[tuple[int, list[str]]]], kept: list[list[tuple[int, list[str]]]]) -> list[list[tuple[int, list[str]]]]:
    """bags of both halves of the labels without those that are taken as labelled wrongly.

    These are documents labelled as bad that the other half of kept finds harmless, or the other way round.
    """
    made: list[list[tuple[int, list[str]]]] = []
    for h in (0, 1):
        other = Model(restorer, *_regression(kept[1 - h]))
        values = [max(other.plain(s) for s in own) for _, own in bags[h]]
        made.append([bag for v, bag in zip(values, bags[h], strict=True) if (v > DOUBT if bag[0] else v < DOUBT_GOOD)])
    return made if all(any(b for b, _ in own) for own in made) else bags


def trigram_counts(documents: DataFrame, text: str) -> np.ndarray:
    """Counts of the letters a-z in threes, over all texts; 0 stands for all else."""
    table = np.zeros(256, np.int32)
    for k in range(26):
        table[97 + k] = table[65 + k] = k + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for b in batches:
            texts = b.column(0).cast(pa.large_string())
            raw = texts.buffers()[2]
            if raw is None:
                continue
            edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            codes = table[np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]]]
            for k in range(0, len(codes), 4_000_000):
                part = np.concatenate([[0, 0], codes[k : k + 4_000_000]]) if k == 0 else codes[k - 2 : k + 4_000_000]
                total += np.bincount(part[:-2] * 729 + part[1:-1] * 27 + part[2:], minlength=27**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["gram", "n"])

    grams = np.zeros(27**3)
    for r in documents.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        grams[r["gram"]] = r["n"]
    return grams.reshape(27, 27, 27)


def _restored(labelled: DataFrame, restorer: Restorer) -> DataFrame:
    """labelled with the words of restored texts between blanks instead of the texts."""
    shared = labelled.sparkSession.sparkContext.broadcast(restorer)

    def restore(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"words": [" ".join(shared.value.words(t)) for t in frame["text"]], "bad": frame["bad"], "half": frame["half"]})

    return labelled.mapInPandas(restore, "words string, bad long, half int")


def _evidence(labelled: DataFrame) -> DataFrame:
    """(word, bad, good): the documents of each label that have a word."""

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for words, bad in zip(frame["words"], frame["bad"], strict=True):
                out += [(w, bad, 1 - bad) for w in {t for t in words.split(" ") if len(t) > 1}]
            yield pd.DataFrame(out, columns=["word", "bad", "good"])

    return labelled.mapInPandas(features, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _first_weights(counts: list[tuple], bads: float, goods: float) -> dict[str, float]:
    """Log-odds of words, by the documents of each label, on top of the seed list."""
    single = {w: v for v, ws in SEEDS.items() for w in ws}
    prior = bads / (bads + goods) if bads + goods else 0.5
    for word, bad, good in counts:
        odds = math.log((bad + prior) / (bads + 1)) - math.log((good + 1 - prior) / (goods + 1))
        single[word] = single.get(word, 0.0) + max(-2.0, min(3.0, odds)) * min(1.0, (bad + good) / 4)
    return single


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model fitted to labels (doc_id, toxic).

    A document counts by the majority of its labels that aren't null; where they are equally many it
    isn't used. Of more than LABELLED documents those with the lowest hash of their id are used.
    """
    spark = documents.sparkSession
    restorer = Restorer(trigram_counts(documents, "text"), {w: v for v, ws in SEEDS.items() for w in ws})
    votes = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("mean")).where("mean <> 0.5")
    chosen = votes.select("doc_id", (F.col("mean") > 0.5).cast("long").alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half")
    texts = documents.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").select("text", "bad", half)
    known = checkpointed(_restored(texts, restorer).withColumn("place", F.monotonically_increasing_id()))
    sizes = {r["bad"]: float(r["n"]) for r in known.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return Model(restorer, *_unfitted())
    counts = [tuple(r) for r in _evidence(known).where(F.col("bad") >= LEAST).collect()]  # words of the sample

    def worst(model: Model, others: int) -> list[Row]:
        shared = spark.sparkContext.broadcast(model)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                own = [shared.value.worst(t.split(" ") if t else [], WORST, 0 if b else others) for t, b in zip(frame["words"], frame["bad"], strict=True)]
                yield pd.DataFrame({"place": frame["place"], "half": frame["half"], "bad": frame["bad"], "own": own})

        return known.mapInPandas(run, "place long, half int, bad long, own array<string>").collect()  # at most LABELLED rows

    found = worst(Model(restorer, _first_weights(counts, sizes[1], sizes.get(0, 0.0)), {}), OTHERS)
    rows = [[r for r in found if r["half"] == h] for h in (0, 1)]
    bags = [[(r["bad"], list(r["own"]) or [""]) for r in own] for own in rows]
    kept = _trusted(restorer, bags, _trusted(restorer, bags, bags))
    again = {r["place"]: r["own"] for r in worst(Model(restorer, *_regression(kept[0] + kept[1])), 0)}
    bags = [[(bad, list(dict.fromkeys([*own, *again[r["place"]]]))) for r, (bad, own) in zip(rows[h], bags[h], strict=True)] for h in (0, 1)]
    kept = _trusted(restorer, bags, kept)
    single, double, bias = _regression(kept[0] + kept[1])
    return Model(restorer, single, double, bias - math.log(PROBABLE / (1 - PROBABLE)))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged) of every document.

    Cases: null, empty and blank texts score 0; labels that are null, equally divided or of unknown
    documents aren't used, and without labels the seed list alone counts; repeated labels of one
    document are votes; no documents give no rows; other columns are ignored.
    """
    model = fit(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                scores = [shared.value.score(t) if t else 0.0 for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, score double")
    return scored.withColumn("flagged", F.col("score") > 0)


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, flagged_rate); documents without a source form one group."""
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged")).withColumn("flagged_rate", F.col("n_flagged") / F.col("n_docs"))
