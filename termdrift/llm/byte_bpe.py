"""Byte-level BPE encoding and decoding (operator 2).

Bytes map to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds all tokens in a piece in
one pass. From the longest token at each place the encoder walks on, takes a shorter one where two neighbours would
not stand side by side after the merges, and steps back where none fits; a place once found wrong is never tried
again, so the time is linear. Whether two tokens may be neighbours is worked out once per pair.

Null text is the empty text, and an empty text has no tokens. Rows are independent: repeated rows and empty tables need
no care, and every row comes back. The encoding is unique, so there are no ties. Extra columns stay; those named
token_ids or decoded are replaced.
"""

from __future__ import annotations

import base64
import re
from array import array

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termdrift.llm.recent import Recent

NONE = -1


class MergeRules:
    """A rank file's vocabulary, with the two parts that each token was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.left, self.right = list(range(size)), list(range(size))
        self.shorter = [NONE] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        for rank in range(size):
            token = self.tokens[rank]
            for cut in range(len(token) - 1, 0, -1):
                if (head := ranks.get(token[:cut], NONE)) != NONE:
                    if self.shorter[rank] == NONE:
                        self.shorter[rank] = head
                    tail = ranks.get(token[cut:], NONE)
                    if head < rank and NONE < tail < rank and self._stand(head, tail):
                        self.left[rank], self.right[rank] = head, tail
                        self.merged[head, tail] = rank
                        break

    def _stand(self, a: int, b: int) -> bool:
        """Whether the merges leave a next to b: no merge across their border comes before those that made them.

        Both are taken apart from the border outwards, latest merge first; a pair across the border that would have
        merged before the part just undone speaks against it.
        """
        bound = len(self.tokens)
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:
                if self.right[a] != a:
                    bound, a = a, self.right[a]
                elif self.left[b] != b:
                    bound, b = b + 1, self.left[b]
                else:
                    return True
            elif self.left[b] != b:
                bound, b = b + 1, self.left[b]
            elif self.right[a] != a:
                bound, a = a, self.right[a]
            else:
                return True

    def neighbours(self, a: int, b: int) -> bool:
        if len(self.fits) > 400_000:
            self.fits.clear()
        fit = self.fits[a << 32 | b] = self._stand(a, b)
        return fit


def splitter(pattern: str):
    """findall of a pattern. Texts of characters that Python's own engine sorts into the same classes go through it,
    in half the time; all others through the regex library."""
    import regex

    full = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in plain:
        return full
    kinds = ((r"\s", r"\s"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"))
    alike = [c for c in map(chr, range(0x250)) if all(bool(regex.match(x, c)) == bool(re.match(y, c)) for x, y in kinds)]
    other, fast = re.compile("[^" + "".join(map(re.escape, alike)) + "]").search, re.compile(plain).findall
    return lambda text: full(text) if other(text) else fast(text)


class Encoder:
    def __init__(self, rules: MergeRules, pattern: str):
        import ahocorasick

        self.rules = rules
        self.split = splitter(pattern)
        self.automaton = ahocorasick.Automaton()
        for rank, token in enumerate(rules.tokens):
            if token:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = list(map(len, rules.tokens))
        self.memo = Recent(lambda piece: array("i", self.piece(piece.encode())).tobytes(), 500_000)

    def piece(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        rules, lengths = self.rules, self.lengths
        if (whole := rules.ranks.get(data)) is not None:
            return [whole]
        size = len(data)
        longest = [NONE] * size
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank  # ends ascend, so the longest is written last
        shorter, fits, neighbours = rules.shorter, rules.fits, rules.neighbours
        wrong: set[int] = set()  # places that no right encoding passes
        out: list[int] = []
        at, token, last = 0, longest[0], NONE
        while True:
            end = at + lengths[token]
            if last == NONE:
                fit = True
            elif (fit := fits.get(last << 32 | token)) is None:
                fit = neighbours(last, token)
            if fit and end not in wrong:
                out.append(token)
                if end == size:
                    return out
                at, last, token = end, token, longest[end]
            elif shorter[token] != NONE:
                token = shorter[token]
            else:
                wrong.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else NONE

    def ids(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))


def read_ranks(spark: SparkSession, path: str) -> Broadcast:
    """A rank file's lines, for the executors. Its size is the vocabulary's, whatever the corpus."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return spark.sparkContext.broadcast(ranks)


_ENCODERS: dict = {}


def _encoder(key: str, ranks: Broadcast, pattern: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    if (key, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key, pattern] = Encoder(MergeRules(ranks.value), pattern)
    return _ENCODERS[key, pattern]


def encode(text: Column, ranks: Broadcast, path: str, pattern: str) -> Column:
    """array<int>: the ids of a text; no null."""

    @F.arrow_udf("array<int>")
    def ids(texts):
        import numpy as np
        import pyarrow as pa

        encoder = _encoder(path, ranks, pattern)
        packed = [encoder.ids(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return ids(text)


_TOKENS: dict = {}


def _tokens(key: str, ranks: Broadcast) -> dict[int, bytes]:
    """id -> token, one per Python worker."""
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = {rank: token for token, rank in ranks.value.items()}
    return _TOKENS[key]


def decode(ids: Column, ranks: Broadcast, path: str) -> Column:
    """binary: the bytes that ids stand for; null or no ids are no bytes, and an unknown id is an error."""

    @F.arrow_udf("binary")
    def data(lists):
        import pyarrow as pa

        table = _tokens(path, ranks).__getitem__
        flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
        at, out = 0, []
        for n in lists.value_lengths().fill_null(0).to_pylist():
            out.append(b"".join(map(table, flat[at : at + n])))
            at += n
        return pa.array(out, pa.binary())

    return data(ids)


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents with token_ids array<int> and decoded binary, its round trip."""
    ranks = read_ranks(documents.sparkSession, path)
    encoded = documents.withColumn("token_ids", encode(F.col("text"), ranks, path, pattern))
    return encoded.withColumn("decoded", decode(F.col("token_ids"), ranks, path))
