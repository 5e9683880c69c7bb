"""Collocations, phrases that are more than their parts, mined from all texts by language (operator 13).

A task takes its texts in shards of bounded size and builds the generalised suffix automaton of a shard's word sequences
down to the depth sought: level by level, the strings that end at each place, each with its suffix link, the string without
its first word, and with the number of its end positions. Strings that end at the same places are one state; all strings
of a state are enumerated with its count. The counts of all shards are then summed.

As many passes share the work as a phrase may have words. The first counts words. A phrase that is frequent has only
frequent parts, so the next count pairs of frequent words, then triples of frequent pairs, by hashes alone, and the last
builds automata of what has only frequent parts. What is frequent is told to the tasks by a bitmap for each length, whose
size follows the number of keys up to `most_bits` (64 MB by default); they, and hashes that collide, let some phrases
through that are not, and never stop one that is. All counts are of whole strings and exact. What a shard gives is counted already, so it is shuffled without being combined once more.

Subsumption goes by suffix links over the summed counts: a phrase counts as part of the two that are longer by one word,
by their suffix link and their prefix. Longer ones need no look, as a phrase between them is at least as frequent.

Null text is empty, null lang is `und`. Rows that repeat, with or without an id, all count, as do repeated words. Ties in
score and count go by phrase in the order of its bytes. A text is never cut: a shard ends between texts, and takes any text
whole. Extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termdrift.llm.bitmap import BITS
from termdrift.llm.near_dedup import ODD, _mixed
from termdrift.scratch import Scratch

#: What ends a piece, and what parts words besides a blank.
ENDS, PARTS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x09"
BREAK = b"\n"
FOLDED = bytes.maketrans(ENDS + PARTS, BREAK * len(ENDS) + b" " * len(PARTS))
COUNTS = "lang string, phrase string, n long"


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in their order, BREAK between pieces; empty ones among them."""
    return BREAK.join(texts).lower().translate(FOLDED).replace(BREAK, b" \n ").split(b" ")


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def longer_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """By end position, the hashes of strings longer by a word, from those of strings and of words."""
    return np.append(np.zeros(1, "u8"), _mixed(before[:-1] * ODD + words[1:]))[: len(words)]


class Bitmap:
    """Tells which hashes may be among the keys."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, len(bits) * 8 - 1

    def __contains__(self, h: int) -> bool:
        h &= self.mask
        return bool(self.bits[h >> 3] >> (h & 7) & 1)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        h = (hashes & np.uint64(self.mask)).astype("i8")
        return (self.bits[h >> 3] >> (h & 7)) & 1 > 0


def bitmap_of(keys: DataFrame, most_bits: int) -> Bitmap:
    """keys: h long. The bitmap has 16 bits a key, within 2^20 and most_bits."""
    bits = min(max(1 << 20, 1 << (16 * keys.count()).bit_length()), most_bits)
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 15).alias("k")).agg(F.bitmap_construct_agg(F.pmod("s", F.lit(BITS))).alias("b")).toLocalIterator()
    out = np.zeros(bits // 8, "u1")
    for row in rows:  # 4 KB each
        out[row["k"] * BITS // 8 :][: BITS // 8] = np.frombuffer(row["b"], "u1")
    return Bitmap(out)


class Vocabulary(dict):
    """Word -> its number in the shard, from 1; 0 for what ends a phrase, and -1 for no word. words and hashes by number."""

    def __init__(self, lang: str, may: Bitmap | None):
        super().__init__({BREAK: 0, b"": -1})
        self.words, self.hashes, self.seed, self.may = [b""], [0], seed_of(lang), may

    def __missing__(self, word: bytes) -> int:
        n, h = 0, xxhash.xxh64_intdigest(word, self.seed) if self.may else 0
        if not self.may or h in self.may:
            n = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self[word] = n
        return n


class SuffixAutomaton:
    """The strings of at most `depth` words in a sequence of numbers, 0 where strings end. at[m][i]: the string of m words
    that ends at i, or 0. Each has count[m], its end positions, link[m], the string without its first word, and place[m], one
    of its end positions. allowed[m]: at which places a string of m words may end, at all by default."""

    def __init__(self, sequence: np.ndarray, depth: int, allowed: dict[int, np.ndarray] | None = None):
        top = int(sequence.max(initial=0)) + 1
        self.at, self.count, self.link, self.place = [None, sequence], [None, np.bincount(sequence, minlength=1)], [None, None], [None, None]
        for m in range(2, depth + 1):
            before, last = self.at[m - 1][:-1], self.at[m - 1][1:]
            ends = np.flatnonzero((before > 0) & (last > 0)) + 1
            if allowed and m in allowed:
                ends = ends[allowed[m][ends]]
            found, first, number, n = np.unique(before[ends - 1].astype("i8") * top + sequence[ends], return_index=True, return_inverse=True, return_counts=True)
            at = np.zeros(len(sequence), "i4")
            at[ends] = number + 1
            place = np.append(0, ends[first]) if len(found) else np.zeros(1, "i8")
            self.at.append(at)
            self.count.append(np.append(0, n))
            self.place.append(place)
            self.link.append(self.at[m - 1][place])

    def states(self, shortest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length the strings that are the longest of their state: an end position of each, how short its state's
        shortest is, from `shortest`, at least 2, on, and its count. A string's state has its suffixes of the same count."""
        depth = len(self.at) - 1
        absorbed, least = {depth: np.zeros(len(self.count[depth]), bool)}, {shortest: np.full(len(self.count[shortest]), shortest)}
        for m in range(shortest + 1, depth + 1):
            same = self.count[m] == self.count[m - 1][self.link[m]]
            same[0] = False
            absorbed[m - 1] = np.zeros(len(self.count[m - 1]), bool)
            absorbed[m - 1][self.link[m][same]] = True
            least[m] = np.where(same, least[m - 1][self.link[m]], m)
        for m in range(shortest, depth + 1):
            own = np.flatnonzero(~absorbed[m])[1:]
            yield m, self.place[m][own], least[m][own], self.count[m][own]

    def strings(self, shortest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """length, an end position and the count of every string of every state."""
        for m, ends, least, n in self.states(shortest):
            for size in range(shortest, m + 1):
                yield size, ends[least <= size], n[least <= size]


class Shard:
    """Texts of a task, and the counts of their words, hashes or phrases. may: the bitmaps of frequent words, pairs and so on."""

    def __init__(self, may: list[Bitmap]):
        self.may, self.size = may, 0
        self.vocabularies: dict[str, Vocabulary] = {}
        self.parts: dict[str, list[np.ndarray]] = {}

    def add(self, lang: str, texts: list[bytes]) -> None:
        if lang not in self.vocabularies:
            self.vocabularies[lang], self.parts[lang] = Vocabulary(lang, self.may[0] if self.may else None), []
        found = words_of(texts)
        numbers = np.fromiter(map(self.vocabularies[lang].__getitem__, found), "i4", len(found))
        self.parts[lang] += [numbers[numbers >= 0], np.zeros(1, "i4")]
        self.size += len(found)

    def words(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        """lang, words and their counts."""
        for lang, parts in self.parts.items():
            own = self.vocabularies[lang].words
            n = np.zeros(len(own), "i8")
            for part in parts:
                n += np.bincount(part, minlength=len(own))
            yield lang, own[1:], n[1:]

    def _levels(self, sequence: np.ndarray, vocabulary: Vocabulary, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 2 on, by end position, the hash of the string and whether it may be frequent."""
        words = np.array(vocabulary.hashes, "u8")[sequence]
        hashes, open_ = words, sequence > 0
        for m in range(2, depth + 1):
            hashes, open_ = longer_hashes(hashes, words), open_ & np.append(False, open_[:-1])
            if m <= len(self.may):
                open_[open_] = self.may[m - 1].among(hashes[open_])
            yield m, hashes, open_

    def hashes(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of strings of m words, all parts of which may be frequent, and how often each comes."""
        found = [np.zeros(0, "u8")]
        for lang, parts in self.parts.items():
            *_, (_, hashes, open_) = self._levels(np.concatenate(parts), self.vocabularies[lang], m)
            found.append(hashes[open_])
        every = np.sort(np.concatenate(found))
        heads = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, "i8")
        return every[heads], np.diff(np.append(heads, len(every)))

    def phrases(self, depth: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        """lang, phrases of 2 to depth words, and their counts."""
        for lang, parts in self.parts.items():
            vocabulary, sequence = self.vocabularies[lang], np.concatenate(parts)
            words = vocabulary.words
            automaton = SuffixAutomaton(sequence, depth, {m: open_ for m, _, open_ in self._levels(sequence, vocabulary, depth)})
            for m, ends, n in automaton.strings(2):
                columns = [[words[i] for i in sequence[ends - m + 1 + k].tolist()] for k in range(m)]
                yield lang, [b" ".join(p) for p in zip(*columns, strict=True)], n


def _shards(batches, shard_words: int, bitmaps) -> Iterator[Shard]:
    """The texts (lang, text) of a task, in shards of about so many words."""
    import pyarrow as pa

    may = [b.value for b in bitmaps]
    shard = Shard(may)
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            shard.add(lang, some)
        if shard.size >= shard_words:
            yield shard
            shard = Shard(may)
    yield shard


def _told(found: Iterator[tuple[str, list[bytes], np.ndarray]], step: int = 20_000) -> Iterator:
    import pyarrow as pa

    for lang, phrases, n in found:
        for k in range(0, len(phrases), step):
            some = pa.array(phrases[k : k + step], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(n[k : k + step].astype("i8"))], ["lang", "phrase", "n"])


def word_counts(texts: DataFrame, shard_words: int) -> DataFrame:
    """COUNTS of each shard's words; under the null word the number of all."""

    def step(batches) -> Iterator:
        import pyarrow as pa

        for shard in _shards(batches, shard_words, []):
            for lang, _, n in shard.words():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([int(n.sum())])], ["lang", "phrase", "n"])
            yield from _told(shard.words())

    return texts.mapInArrow(step, COUNTS)


def frequent_hashes(texts: DataFrame, shard_words: int, least: int, m: int, bitmaps: list) -> DataFrame:
    """h long: the hashes of strings of m words that may be frequent."""

    def step(batches) -> Iterator:
        import pyarrow as pa

        for shard in _shards(batches, shard_words, bitmaps):
            h, n = shard.hashes(m)
            for k in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000].view("i8")), pa.array(n[k : k + 100_000])], ["h", "n"])

    parts = texts.mapInArrow(step, "h long, n long")
    return parts.repartition("h").groupBy("h").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("h")


def long_counts(texts: DataFrame, shard_words: int, longest: int, bitmaps: list) -> DataFrame:
    """COUNTS of each shard's phrases of at least two words, of what parts may be frequent."""

    def step(batches) -> Iterator:
        for shard in _shards(batches, shard_words, bitmaps):
            yield from _told(shard.phrases(longest))

    return texts.mapInArrow(step, COUNTS)


def _summed(parts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f: the counts of all shards, summed, where that is enough; the null phrase stays."""
    summed = parts.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return summed.where((F.col("f") >= least) | F.col("phrase").isNull())


def phrase_counts(documents: DataFrame, scratch: Scratch, least: int, longest: int, most_bits: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f of all frequent words and phrases of up to `longest` words; and lang, n, the number of words."""
    share = lambda keys: documents.sparkSession.sparkContext.broadcast(bitmap_of(keys, most_bits))
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    every = scratch.write(_summed(word_counts(texts, shard_words), least))
    words = every.where("phrase IS NOT NULL")
    bitmaps = [share(words.select(F.xxhash64("lang", "phrase").alias("h")))]
    for m in range(2, longest):
        bitmaps.append(share(scratch.write(frequent_hashes(texts, shard_words, least, m, bitmaps))))
    found = words.union(scratch.write(_summed(long_counts(texts, shard_words, longest, bitmaps), least)))
    return found, every.where("phrase IS NULL").select("lang", F.col("f").alias("n"))


def subsumed(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """lang, phrase of those that lie in a phrase longer by a word that has percent of their count. phrases: lang, phrase, a."""
    words = F.split("phrase", " ")
    n = F.size(words)
    link, prefix = F.array_join(F.slice(words, 2, n - 1), " "), F.array_join(F.slice(words, 1, n - 1), " ")
    inner = phrases.where(n > 2).select("lang", F.explode(F.array_distinct(F.array(link, prefix))).alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c, times: F.col(c).cast("decimal(20,0)") * times
    return phrases.join(most, ["lang", "phrase"]).where(wide("longer", 100) >= wide("a", percent)).select("lang", "phrase")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a) with l, r and score long of their lowest-scoring cut; of equals the first."""
    words, k = F.split("phrase", " "), F.col("k")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(words, F.lit(1), k), " "), "right": F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")})
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    met = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(phrases: DataFrame, top: int, salt: int = 16) -> DataFrame:
    """The first `top` of each language with their rank; ranked in parts first, so that a language is no one task's."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salt))).orderBy(*order)
    first = phrases.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def mine_phrases(documents: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000, most_bits: int = 1 << 29, shard_words: int = 8_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of each language."""
    with Scratch(documents.sparkSession, "phrases") as scratch:
        counts, totals = phrase_counts(documents, scratch, least, longest, most_bits, shard_words)
        phrases = counts.where(F.contains("phrase", F.lit(" "))).withColumnRenamed("f", "a")
        kept = phrases.join(subsumed(phrases, percent), ["lang", "phrase"], "left_anti")
        best = ranked(scored(kept, counts), top).join(totals, "lang")
        return scratch.keep(best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
