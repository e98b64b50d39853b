"""Encoding of texts with a public byte-level BPE vocabulary, exactly as by its merges.

The text is cut into pieces by the vocabulary's pattern; within a piece the ids are found by dynamic
programming over prefixes instead of by merging. For every prefix of a piece there is exactly one
last token of its encoding. An automaton over all tokens gives the tokens that end at a byte; of
them, the last token is the one that is compatible with the last token of the prefix before it, that
is, merging the bytes of both gives just these two. Following the stored last tokens back from the
end of the piece gives the ids, in time proportional to its length.

Pieces recur, so each worker keeps the ids of those that it has seen, up to a fixed number. That
changes the time and not the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabularies lie; the WEFTLINE_TOKENIZERS setting wins.
TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
#: The pattern of the vocabulary that cuts text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters with the property White_Space, which \s means in PATTERN.
SPACE = "\t-\r \x85\xa0  -     　"
#: White space and what follows up to the next. Every piece lies in one such stretch: white space
#: joins the piece after it or none.
STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Stretches that a worker remembers, of up to LONGEST characters.
REMEMBERED, LONGEST = 300_000, 48
#: Characters encoded at once.
AT_ONCE = 1_000_000


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a vocabulary file stands for.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, are written as the
    characters from 256 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class _Known(dict):
    """Numbers of stretches; one that isn't known is learnt."""

    def __init__(self, learn: Callable[[str], int]) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, stretch: str) -> int:
        number = self.learn(stretch)
        if len(stretch) <= LONGEST:
            self[stretch] = number
        return number


class Encoder:
    """Encodes texts with the vocabulary of a tokenizer file (vocabulary and ordered merges)."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        byte = _bytes_of()
        special = {"<|endoftext|>", "<|startoftext|>"}
        ids = {word: n for word, n in model["vocab"].items() if word not in special}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made, halves = ids[left + right], (ids[left], ids[right])
            self.merge[halves] = made
            self.halves[made] = halves
        tokens = ahocorasick.Automaton()
        for word, n in ids.items():
            raw = "".join(chr(byte[c]) for c in word)
            tokens.add_word(raw, (n, len(raw)))
        tokens.make_automaton()
        self.tokens = tokens
        self.pieces = regex.compile(PATTERN)
        # The same cut for stretches of ASCII alone
        self.plain = re.compile(PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII)
        self.seen: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.known = _Known(self._learn)
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("q")

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a, b.

        The last merges within a and b are undone, latest first. Where the tokens that then meet at
        the seam could merge earlier than the merge just undone, merging would have crossed it.
        """
        bar = 1 << 62
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < bar:
                return False
            if a > b:
                if a not in self.halves:
                    return True
                bar, a = a, self.halves[a][1]
            else:
                if b not in self.halves:
                    return True
                bar, b = b + 1, self.halves[b][0]  # equal merges run from the left

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece by dynamic programming over its prefixes."""
        raw = piece.encode("utf-8").decode("latin-1")
        last: list[int] = [-1] * (len(raw) + 1)
        size = [0] * (len(raw) + 1)
        fits = self.fits
        for end, (token, length) in self.tokens.iter(raw):
            end += 1
            if last[end] < 0:
                if length < end:
                    pair = (last[end - length], token)
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) >= REMEMBERED:
                            fits.clear()
                        good = fits[pair] = self.compatible(*pair)
                    if not good:
                        continue
                last[end], size[end] = token, length
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _learn(self, stretch: str) -> int:
        ids, seen = [], self.seen
        for piece in (self.plain if stretch.isascii() else self.pieces).findall(stretch):
            own = seen.get(piece)
            if own is None:
                own = self.encode_piece(piece)
                if len(piece) <= LONGEST:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = own
            ids += own
        at = len(self.starts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return at

    def _stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of all texts, and how many each text has."""
        if len(self.starts) > REMEMBERED:
            self.clear()
        numbers, counts, number = array("q"), [], self.known.__getitem__
        for text in texts:
            before = len(numbers)
            if len(text) <= AT_ONCE:
                numbers.extend(map(number, STRETCH.findall(text)))
            else:
                numbers.extend(number(m[0]) for m in STRETCH.finditer(text))
            counts.append(len(numbers) - before)
        return np.array(numbers, np.int64), np.array(counts, np.int64)

    def sizes_of(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        numbers, counts = self._stretches(texts)
        ends = np.concatenate([[0], np.cumsum(np.array(self.sizes, np.int64)[numbers])]) if len(numbers) else np.zeros(1, np.int64)
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ends[edges[1:]] - ends[edges[:-1]]

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text as a list array of int32."""
        numbers, counts = self._stretches(texts)
        sizes = np.array(self.sizes, np.int64)[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edges = ends[np.concatenate([[0], np.cumsum(counts)])]
        flat = np.array(self.flat, np.int32)
        shift = np.array(self.starts, np.int64)[numbers] - ends[:-1]
        ids = flat[np.arange(ends[-1]) + np.repeat(shift, sizes)]
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once in each worker."""
    return Encoder(Path(path).read_text(encoding="utf-8"))


#: Encoders of this process by the digest of their vocabulary.
_SHIPPED: dict[str, Encoder] = {}


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about AT_ONCE characters each."""
    begin, held = 0, 0
    for n, text in enumerate(texts):
        held += len(text or "")
        if held >= AT_ONCE:
            yield begin, n + 1
            begin, held = n + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _over(spark: SparkSession, path: str, count_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes batches; the driver reads the vocabulary, a file of fixed size, and sends it to the workers."""
    content = Path(path).read_text(encoding="utf-8")
    digest, shared = hashlib.sha256(content.encode()).hexdigest(), spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _SHIPPED.get(digest) or _SHIPPED.setdefault(digest, Encoder(shared.value))
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            kept = b.select(range(b.num_columns - 1))
            for begin, end in _slices(texts):
                part = [t or "" for t in texts[begin:end]]
                made = pa.array(own.sizes_of(part)) if count_only else own.encode(part)
                rows = kept.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*rows.columns, made], names=[*rows.schema.names, "ids"])

    return run


def encode(documents: DataFrame, keys: list[str], text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keys and ids (array of int), one row for each row of documents.

    Special tokens aren't used: their strings in a text are ordinary text. Null and empty texts give
    an empty list; blank texts have the ids of their white space. Texts of any length are encoded
    whole. No rows give no rows; other columns of documents are ignored.
    """
    kept = documents.select(*keys, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_over(documents.sparkSession, f"{folder}/{vocabulary}.json", False), f"{fields}, ids array<int>")


def token_counts(documents: DataFrame, keys: list[str], text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keys and n_tokens, the length of the list that encode() would give."""
    kept = documents.select(*keys, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_over(documents.sparkSession, f"{folder}/{vocabulary}.json", True), f"{fields}, ids long").withColumnRenamed("ids", "n_tokens")
