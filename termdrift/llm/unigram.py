"""Token counts by a unigram model over a trie of pre-tokens (operator 5).

The pieces are those of a public model file. That model is one of merges: its scores are ranks, no log-probabilities,
so count_corpus estimates the probabilities from the corpus (fit_scores). Spark counts the distinct pre-tokens of all
documents, and rounds of expectation and maximisation over them, from equal probabilities, give each piece its
expected share of all tokens; half a token is added to each piece, so that none is lost.

A text gets one blank in front, as in the model, unless it is empty; blanks stand as the mark U+2581. A pre-token is
a run of other characters with the blank before it, or what is left of a run of white space: nothing is thrown away.
Its segmentation is the one with the highest sum of scores; of equal sums the one with fewer tokens, so the count is
well defined. Characters that no piece covers cost one token per UTF-8 byte, so a newline is one token as in the
model. The counts are those of this unigram model, and need not be those of the model's merges.

Pre-tokens form a trie. A node has the best score and count of its prefix, worked out once from its ancestors, and a
word's last node has its count. The new pre-tokens of a batch are taken in sorted order, which walks their trie depth
first: words that share a beginning share the nodes of it, and only the path to the word at hand is held. The counts of
recent words are kept from batch to batch in a worker, up to a bound.

Null and empty texts count 0. Repeated rows count as often as they come, in the estimate too. Extra columns stay; one
named n_tokens is replaced. On an empty table every piece is as likely as any other, and no row comes back.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from itertools import chain
from os.path import commonprefix

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termdrift.llm.recent import Recent
from termdrift.scratch import written

MARK = "▁"
#: The pre-tokens of a text that has a blank in front; laid end to end they are that text.
PRE_TOKENS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
#: Below the lowest score by this much, as the public library scores an unknown character.
UNKNOWN = 10.0


def read_pieces(spark: SparkSession, path: str) -> Broadcast:
    """(piece, score) of all normal pieces of a model file; as many as the vocabulary has, whatever the corpus."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return spark.sparkContext.broadcast({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)})


class PrefixCounts:
    """Pre-token -> token count, by a trie whose nodes are shared between pre-tokens."""

    def __init__(self, pieces: dict[str, float], limit: int = 1_000_000):
        self.endings: dict[str, dict] = {}  # trie of reversed pieces; under "" the score
        for piece, score in pieces.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.floor = min(pieces.values(), default=0.0) - UNKNOWN  # below any piece, so only where no piece fits
        self.memo = Recent(lambda word: self.walk([word])[0], limit)

    def walk(self, words: list[str]) -> list[int]:
        """The counts of sorted words. scores and tokens are those of the nodes on the path to the word at hand."""
        endings, floor, out, before = self.endings, self.floor, [], ""
        scores, tokens = [0.0], [0]
        for word in words:
            text = word.replace(" ", MARK)
            shared = len(commonprefix((before, text)))
            del scores[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared, len(text)):
                start, c = end, text[end]
                node = endings.get(c)
                if node is None or (own := node.get("")) is None:
                    top, most = scores[end] + floor, tokens[end] + len(c.encode())
                else:
                    top, most = scores[end] + own, tokens[end] + 1
                while start and node is not None:
                    start -= 1
                    node = node.get(text[start])
                    if node is not None and (own := node.get("")) is not None:
                        own += scores[start]
                        if own > top or own == top and tokens[start] + 1 < most:
                            top, most = own, tokens[start] + 1
                scores.append(top)
                tokens.append(most)
            out.append(tokens[len(text)])
            before = text
        return out

    def count(self, texts: list[list[str]]) -> list[int]:
        """The counts of texts, given as their pre-tokens."""
        memo = self.memo
        new = sorted(set(chain.from_iterable(texts)).difference(memo))
        memo.learn(new, self.walk(new))
        return [sum(map(memo.__getitem__, t)) for t in texts]


_COUNTERS: dict = {}


def pre_tokens(text: str | None) -> list[str]:
    return PRE_TOKENS(" " + text) if text else []


class Expected:
    """Sums how often each piece is expected in weighted pre-tokens, over all their segmentations.

    Pieces form a trie whose edges (node, character) are sorted numbers, so all places of many words walk it at once."""

    #: Expectations are summed as whole numbers of this fraction, so no order of rows changes a sum.
    UNIT = float(1 << 20)

    def __init__(self, pieces: list[str]):
        nodes, self.piece_of = {}, [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = nodes.setdefault(node << 21 | ord(c), len(self.piece_of))
                if node == len(self.piece_of):
                    self.piece_of.append(-1)
            self.piece_of[node] = k
        self.keys = np.array(sorted(nodes), "i8")
        self.below = np.array([nodes[k] for k in self.keys.tolist()], "i8")
        self.piece_of = np.array(self.piece_of, "i8")
        self.n = len(pieces)

    def _edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """first and last place, piece, and place in the word of every piece in the words; a word of n characters has
        n + 1 places. A character without a piece of its own has the unknown one."""
        sizes = np.fromiter(map(len, words), "i8", len(words))
        codes = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), "u4").astype("i8")
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) + word  # each word before has one place more than it has characters
        code, end = np.full(len(codes) + len(words), -1, "i8"), np.cumsum(sizes + 1) - 1
        code[place] = codes
        base = end - sizes
        of = np.zeros(len(code), "i8")
        of[place] = base[word]
        start, at, node, found = place, place, np.zeros(len(place), "i8"), []
        single = np.zeros(len(code), bool)
        while len(start) and len(self.keys):
            key = node << 21 | code[at]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = (self.keys[k] == key) & (code[at] >= 0)
            start, at, node = start[on], at[on] + 1, self.below[k[on]]
            piece = self.piece_of[node]
            whole = piece >= 0
            found.append((start[whole], at[whole], piece[whole]))
            single[start[whole & (at == start + 1)]] = True
        rest = place[~single[place]]
        found.append((rest, rest + 1, np.full(len(rest), self.n)))
        first, last, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        inner = last - of[first]
        order = np.lexsort((first, last, inner))
        return first[order], last[order], piece[order], inner[order], base, end

    def add(self, words: list[str], times: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The expectation of each piece in UNITs; scores: of all pieces, and of an unknown character at the end."""
        first, last, piece, inner, base, end = self._edges(words)
        forward, weight = np.full(int(end[-1]) + 1, -np.inf), np.zeros(int(end[-1]) + 1)
        forward[base], weight[end] = 0.0, times
        cuts = np.searchsorted(inner, np.arange(1, int(inner[-1]) + 2))
        share = np.empty(len(first))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sums, to = forward[first[a:b]] + scores[piece[a:b]], last[a:b]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(sums, heads)
            each = np.repeat(top, np.diff([*heads, b - a]))
            forward[to[heads]] = top + np.log(np.add.reduceat(np.exp(sums - each), heads))
            share[a:b] = np.exp(sums - forward[to])
        for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            share[a:b] *= weight[last[a:b]]
            np.add.at(weight, first[a:b], share[a:b])
        return np.bincount(piece, np.rint(share * self.UNIT), self.n + 1)[: self.n].astype("i8")


_EXPECTED: dict = {}


def counted_pre_tokens(documents: DataFrame) -> DataFrame:
    """token, n: each distinct pre-token of all documents, and how often it comes."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            held: Counter = Counter()
            for text in batch.column(0).to_pylist():
                held.update(pre_tokens(text))
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["token", "n"])

    return documents.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def fit_scores(documents: DataFrame, pieces: list[str], rounds: int = 4, characters: int = 400_000) -> dict[str, float]:
    """piece -> log-probability, from all documents. characters: how many a step takes at once in a worker."""
    spark = documents.sparkSession
    tokens = written(counted_pre_tokens(documents), "unigram-tokens")
    name, own, scores = uuid.uuid4().hex, spark.sparkContext.broadcast(pieces), np.full(len(pieces), -math.log(max(len(pieces), 1)))
    for _ in range(rounds):
        with_unknown = np.append(scores, scores.min(initial=0.0) - UNKNOWN)

        def expect(batches, given=with_unknown):
            import pyarrow as pa

            if name not in _EXPECTED:  # one per worker, kept from round to round
                _EXPECTED.clear()
                _EXPECTED[name] = Expected(own.value)
            of, total, words, times, held = _EXPECTED[name], 0, [], [], 0
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words.append(word)
                    times.append(n)
                    held += len(word)
                    if held >= characters:
                        total = total + of.add(words, np.array(times, "f8"), given)
                        words, times, held = [], [], 0
            if words:
                total = total + of.add(words, np.array(times, "f8"), given)
            if not isinstance(total, int):
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "units"])

        sums = tokens.mapInArrow(expect, "piece long, units long").groupBy("piece").agg(F.sum("units").alias("units"))
        counts = np.full(len(pieces), 0.5)
        for piece, units in sums.collect():  # as many as the vocabulary has, whatever the corpus
            counts[piece] += units / Expected.UNIT
        scores = np.log(counts) - math.log(counts.sum() or 1.0)
    return dict(zip(pieces, scores.tolist(), strict=True))


def count_corpus(documents: DataFrame, path: str, rounds: int = 4) -> DataFrame:
    """documents with n_tokens long, by the probabilities that the documents themselves give the pieces of a file."""
    spark = documents.sparkSession
    fitted = spark.sparkContext.broadcast(fit_scores(documents, sorted(read_pieces(spark, path).value), rounds))
    name = uuid.uuid4().hex

    @F.arrow_udf("long")
    def count(texts):
        import pyarrow as pa

        if name not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[name] = PrefixCounts(fitted.value)
        return pa.array(_COUNTERS[name].count([pre_tokens(t) for t in texts.to_pylist()]), pa.int64())

    return documents.withColumn("n_tokens", count(F.col("text")))
