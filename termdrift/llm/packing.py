"""Best-fit packing of tokenised documents into sequences (operator 9).

Documents are tokenised by a public word-piece vocabulary, closed with one id, and cut only where longer than a
sequence. The lengths and checksums of the pieces are written, and the pieces are dealt into blocks of about `block`
pieces by their place in that table, so a block is no larger however often an id or a text repeats. In a block the
pieces are placed best fit, longest first. Then a local search works on the bins that are not full: it moves a piece,
swaps one for one, or two for one, whenever the sum of squared fills grows, which empties the least filled bins. What
a bin can take, and for which of its pieces, is kept in an order by size, so an exchange is looked up and not sought
among all pairs of bins. The search ends when the bins are as few as their tokens allow, or when a whole round finds no
exchange.

What is left of all blocks, the bins filled below `closed` of a sequence, is dealt anew into blocks of the same size and
packed again, level by level, until one block is left. So the corpus as a whole, and not each block, has its few underfull
sequences. A bin that not even the shortest of the pieces left over fits into is closed whatever its fill, and the levels
end early when the bins left are as few as their tokens allow or a level empties none. So no task ever holds more than
about `block` pieces.

Null text is empty: a document of the closing id alone. Repeated rows, and rows without id, are packed as often as they
come. Pieces of one length are alike, so of ties any order packs as well; the same table is packed the same way. Extra
columns are ignored, and an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termdrift.scratch import Scratch

#: A word of the letters up to U+00FF, whose case folds alike everywhere, and a sign behind it.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?").fullmatch
PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


class RunIds:
    """Run of non-blank characters -> its ids as little-endian 32-bit bytes. The vocabulary drops blanks and no merge
    crosses them, so a text's ids are those of its runs. New runs of a batch are encoded together, with a mark between
    them; what goes unused while `limit` others come is forgotten."""

    MARK = "~"

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.limit = limit
        (self.mark,) = self._encode(self.MARK)
        self.stop, self.comma = (array("i", self._encode(c)).tobytes() for c in ".,")

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, runs: list[str]) -> None:
        """Adds runs to those known. A plain word with a full stop or a comma is two parts to the vocabulary, and case
        is folded, so that its word is looked up and encoded alone, once."""
        plain = [run for run in runs if PLAIN(run)]
        words = [run.rstrip(".,").lower() for run in plain]
        if len(self.words) > self.limit:
            self.words = {}
        self._encode_into(self.words, list(set(words).difference(self.words)))
        tails = {".": self.stop, ",": self.comma}
        self.known.update(zip(plain, map(self.words.__getitem__, words), strict=True))
        self.known.update((run, self.known[run] + tails[run[-1]]) for run in plain if run[-1] in tails)
        self._encode_into(self.known, [run for run in runs if run not in self.known])

    def _encode_into(self, known: dict[str, bytes], runs: list[str]) -> None:
        together, mark = [r for r in runs if self.MARK not in r], self.mark
        for k in range(0, len(together), 4000):
            some = together[k : k + 4000]
            ids, at = self._encode(f" {self.MARK} ".join(some) + f" {self.MARK}"), 0
            for run in some:
                end = ids.index(mark, at)
                known[run] = array("i", ids[at:end]).tobytes()
                at = end + 1
        for run in runs:
            if self.MARK in run:
                known[run] = array("i", self._encode(run)).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # str.split() also parts at the controls 1C to 1F, which the vocabulary does not drop
        odd = re.compile("[\x1c-\x1f]").search
        split = [t.split() if t and not odd(t) else [t] if t else [] for t in texts]
        runs = set(chain.from_iterable(split))
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        new, older = runs.difference(self.known), self.older
        back = new & older.keys()
        self.known.update((run, older[run]) for run in back)
        self._learn(list(new - back))
        of = self.known.__getitem__
        return [b"".join(map(of, s)) for s in split]


@lru_cache(maxsize=1)
def run_ids(path: str) -> RunIds:
    """One per Python worker, kept from task to task."""
    return RunIds(path)


def cut(text: Column, path: str, capacity: int, closing_id: int) -> Column:
    """The pieces of a document, with place, length and checksum."""

    @F.arrow_udf(PIECES)
    def pieces(texts):
        import pyarrow as pa

        step, closing, out = 4 * capacity, closing_id.to_bytes(4, "little"), []
        for ids in run_ids(path)(texts.to_pylist()):
            ids += closing
            out.append([{"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} for k, at in enumerate(range(0, len(ids), step)) for part in (ids[at : at + step],)])
        one = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        return pa.array(out, pa.list_(one))

    return pieces(text)


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into lengths. Best fit, longest first."""
    bins: list[list[int]] = []
    space: list[tuple[int, int]] = []  # (free, bin), ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect_left(space, (lengths[i], -1))
        if k == len(space):
            bins.append([i])
            free, b = capacity - lengths[i], len(bins) - 1
        else:
            free, b = space.pop(k)
            bins[b].append(i)
            free -= lengths[i]
        if free:
            insort(space, (free, b))
    return bins


class Bins:
    """Bins that are not full, with what each could take: for a piece of t tokens in a bin with f tokens free, up to t + f
    in its place, and for t = 0 up to f besides. order: these (room, t), ascending; at: the bins of each."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.order, self.at, self.free = lengths, capacity, [], {}, {}

    def _offers(self, members: list[int], free: int) -> set[tuple[int, int]]:
        return {(free, 0), *((self.lengths[i] + free, self.lengths[i]) for i in members)} if free else set()

    def put(self, b: int, members: list[int]) -> None:
        self.free[b] = self.capacity - sum(self.lengths[i] for i in members)
        for key in self._offers(members, self.free[b]):
            if key not in self.at:
                insort(self.order, key)
                self.at[key] = {}
            self.at[key][b] = None

    def take(self, b: int, members: list[int]) -> None:
        for key in self._offers(members, self.free.pop(b)):
            del self.at[key][b]
            if not self.at[key]:
                del self.at[key]
                self.order.pop(bisect_left(self.order, key))

    def best(self, size: int) -> tuple[int, int, int] | None:
        """The tightest room for so many tokens that takes less in return: gain, what it gives back, and the bin."""
        for k in range(bisect_left(self.order, (size, -1)), len(self.order)):
            room, back = self.order[k]
            if back < size:
                return size - back, back, next(iter(self.at[room, back]))
        return None


def _exchange(giver: list[int], takers: Bins, pairs: int = 48) -> tuple[list[int], int, int] | None:
    """The exchange that gains most: the giver's pieces, one or two, the length given back, and the bin that takes them.
    Two for one is tried for givers of at most `pairs` lengths; more have pieces small enough to move one by one."""
    one = {takers.lengths[i]: i for i in giver}
    offers = [(n, [i]) for n, i in one.items()]
    if len(one) <= pairs:
        held = sorted(giver, key=takers.lengths.__getitem__)
        two = {takers.lengths[a] + takers.lengths[b]: [a, b] for k, a in enumerate(held) for b in held[k + 1 :]} if len(held) <= pairs else {a + b: [one[a], one[b]] for a in one for b in one if a < b}
        offers += [(n, both) for n, both in two.items() if n <= takers.capacity]
    most, found = 0, None
    for n, ours in offers:
        if n > most and (got := takers.best(n)) and got[0] > most:
            most, found = got[0], (ours, got[1], got[2])
    return found


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search on the bins that are not full, until a round changes nothing. No bin overflows, no piece is lost,
    and the sum of squared fills only grows, so it ends."""
    fill_of = lambda b: sum(lengths[i] for i in b)
    full = [b for b in bins if fill_of(b) == capacity]
    rest = [b for b in bins if fill_of(b) < capacity]
    least = -(-sum(lengths) // capacity)
    while len(full) + len(rest) > least:  # else no bin can be emptied
        rest.sort(key=lambda b: (fill_of(b), b))
        takers, changed = Bins(lengths, capacity), False
        for k, members in enumerate(rest):
            takers.put(k, members)
        for k, giver in enumerate(rest):  # the least filled gives, to those that are as full or fuller
            takers.take(k, giver)
            while giver and (found := _exchange(giver, takers)):
                ours, back, b = found
                taker = rest[b]
                takers.take(b, taker)
                theirs = [next(i for i in taker if lengths[i] == back)] if back else []
                for i in ours:
                    giver.remove(i)
                for i in theirs:
                    taker.remove(i)
                giver += theirs
                taker += ours
                takers.put(b, taker)
                changed = True
        full += [b for b in rest if b and fill_of(b) == capacity]
        rest = [b for b in rest if b and fill_of(b) < capacity]
        if not changed:
            break
    return full + rest


def place(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each length its bin and its offset there."""
    bin_of, offset = [0] * len(lengths), [0] * len(lengths)
    for k, members in enumerate(improve(fill(lengths, capacity), lengths, capacity)):
        at = 0
        for i in members:
            bin_of[i], offset[i] = k, at
            at += lengths[i]
    return bin_of, offset


def _packing(level: int, capacity: int, closed: float):
    """A function that packs a block, and tells how much is free in the sequence of each piece if that is open, else -1."""

    def packed(pdf):
        lengths = pdf["length"].tolist()
        bins, offsets = place(lengths, capacity)
        fills = np.bincount(bins, lengths, minlength=1).astype("i8")[bins]
        pdf["sequence_id"] = (level << 56) + pdf["block"] * (1 << 24) + bins
        pdf["offset"] = offsets
        pdf["free"] = np.where(fills < closed * capacity, capacity - fills, -1)
        return pdf

    return packed


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack_pieces(pieces: DataFrame, capacity: int, scratch: Scratch, block: int = 4096, closed: float = 0.95) -> DataFrame:
    """pieces (PIECE), a written table, with sequence_id and offset. Each level but the first holds only what the one before
    left over; at each the driver learns four numbers."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, block long, free long"
    settled, level, left, n, bins = [], 0, pieces, pieces.count(), None
    while True:
        blocks = max(1, -(-n // block))
        # the places of the rows of a written table are the same whenever it is read
        dealt = left.select(*PIECE, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(blocks)).alias("block"))
        done = scratch.write(dealt.groupBy("block").applyInPandas(_packing(level, capacity, closed if blocks > 1 else 0), kinds))
        shortest = done.where("free >= 0").agg(F.min("length")).first()[0]
        open_ = F.col("free") >= F.lit(capacity if shortest is None else shortest)
        starts = F.col("offset") == 0
        now = done.agg(F.count_if(open_).alias("n"), F.sum(F.when(open_, F.col("length"))).alias("tokens"), F.count_if(open_ & starts).alias("bins"), F.count_if(starts).alias("all")).first()
        if bins is not None and now["all"] >= bins:  # nothing gained; they stay as the level before left them
            settled.append(left)
            break
        if blocks == 1 or not now["n"] or now["bins"] <= -(-now["tokens"] // capacity):
            settled.append(done)
            break
        settled.append(done.where(~open_))
        level, n, bins, left = level + 1, now["n"], now["bins"], scratch.write(done.where(open_))
    return scratch.keep(reduce(DataFrame.union, settled).drop("block", "free"))


def pack_documents(documents: DataFrame, path: str, capacity: int = 4096, closing_id: int = 1, block: int = 4096, closed: float = 0.95) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only lengths and checksums are shuffled."""
    with Scratch(documents.sparkSession, "packing") as scratch:
        pieces = scratch.write(documents.select("doc_id", F.explode(cut(F.col("text"), path, capacity, closing_id)).alias("p")).select("doc_id", "p.*"))
        return pack_pieces(pieces, capacity, scratch, block, closed)
