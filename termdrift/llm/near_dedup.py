"""Near duplicates by an inverted join of MinHash signatures (operator 10).

A document's set is its distinct shingles of words. Documents with the same set form one class, whatever their ids, and
classes, numbered as they are written, stand for their documents from there on. A signature has one MinHash value per coordinate; the pair (coordinate, value) is a key
and every class is posted under its keys. Two classes at the similarity sought agree in most coordinates; those that
agree in at least `matches` are compared on their full sets, so no false link remains. With 48 coordinates and 22
matches a link at exactly 0.8 escapes about once in two million times, a closer one less often.

Prefix: classes that agree in m of K coordinates share one of their K - m + 1 rarest keys, so only those are posted,
rarest first by their count over the whole corpus. What many documents share is thereby hardly ever looked up. Skip
merging: a class first meets one hub, that of its most frequent key, then the hub of each of its keys; a key's hub is
the class under it with the most keys that others have too, which is next to the text that the copies were made from.
This links most of a group in rows that grow with its size. After that only pairs whose classes are still in different
components can change anything.

For those the prefix is taken once more, on the full sets: in the order of how many sets hold a shingle, two sets at
the similarity have their first common shingle where both still have as many to come as they must share. Such places
are few, and the pairs that are left meet there; this filter is exact. A copy that is too far from its group has more
shingles of its own than it may lack, so it meets nobody, however large the group. Sizes that cannot reach the
similarity are skipped too. In a wide group many copies are near to many others, though not to the hubs so far; so at
each such place those outside its main component first meet a few sets of that one, dealt by a hash, then some more,
in rows that grow with the places. All pairs of places whose sets are still in different components come last.

Null and empty texts, and texts of blanks only, have the empty set: they are linked with nothing and kept. Texts
shorter than a shingle are one shingle. Of each component the document with the smallest doc_id stays. A row without
id is kept and belongs to no component. Rows that repeat an id each go by their own text, and two unlike texts of one id
are not linked by it: each has the smallest id of its own component. mark_rows tells one row of each component to stay,
of several with the smallest id that whose text's hash is the least; cluster_documents tells by the id alone. Only the
columns named below come back, whatever others there are. An empty table stays empty. The tables between the steps are
deleted at the end, but for the one that is read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termdrift.llm import bitmap
from termdrift.operators.components import connected_components
from termdrift.scratch import Scratch

#: What parts words, and the letters folded. On UTF-8 bytes, lower() and split() do just this.
WORDS = re.compile("[^\x20\x09-\x0d]+").findall
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: How many sets of a key's main component the others meet, from round to round, before all pairs that are left do.
HUBS = (8, 64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles of a text in UTF-8 as sorted 64-bit hashes."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = max(len(h) - size + 1, 1)
    out = np.full(n, min(len(h), size), "u8")
    for k in range(min(size, len(h))):
        out = _mixed(out * ODD + h[k : k + n])
    return np.unique(out)


def coefficients(coordinates: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, coordinates, "u8") * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, coordinates, "u8")


def signature(shingles: np.ndarray, by: tuple[np.ndarray, np.ndarray], block: int = 4096) -> np.ndarray:
    a, b = by
    least = np.full(len(a), np.iinfo("u8").max, "u8")
    for k in range(0, len(shingles), block):
        some = shingles[k : k + block]
        mixed = some[None, :] * a[:, None] + b[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= ODD
        np.minimum(least, mixed.min(1), out=least)
    return least


def row_of(documents: DataFrame) -> Column:
    """Names a row by its id and its text: struct<doc_id,a,b>."""
    text = documents["text"]
    return F.struct(documents["doc_id"], F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def sketches(documents: DataFrame, size: int, coordinates: int) -> DataFrame:
    """row, n_shingles long, set_key binary, signature array<long>; the last two null for an empty set."""

    @F.arrow_udf("struct<n_shingles:long,set_key:binary,signature:array<long>>")
    def sketch(texts):
        import pyarrow as pa

        by = coefficients(coordinates)
        sets = [shingle_set(t, size) for t in texts.cast("binary").to_pylist()]
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        flat = np.concatenate([signature(s, by) if len(s) else np.zeros(coordinates, "u8") for s in sets]).view("i8")
        signatures = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype="i4") * coordinates), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), signatures], ["n_shingles", "set_key", "signature"])

    return documents.select(row_of(documents).alias("row"), sketch("text").alias("s")).select("row", "s.*")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """id, n, s long, a hash of the set, and shingles array<long>. texts: id, text."""

    @F.arrow_udf("array<long>")
    def shingles(texts):
        import pyarrow as pa

        sets = [shingle_set(t, size) for t in texts.cast("binary").to_pylist()]
        ends = np.cumsum([0] + [len(s) for s in sets]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, "u8")]).view("i8")))

    sets = texts.select("id", shingles("text").alias("shingles"))
    return sets.select("id", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("s"), "shingles")


def _near(n: str, m: str, percent: int):
    """Whether two sizes allow the similarity at all."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """key, id, n, held, common: each class under those of its rarest keys that another class has too. held: by how
    many; common: how many of the class's keys are held by others."""
    keys = classes.select("id", "n", F.posexplode("signature").alias("i", "value")).select("id", "n", F.xxhash64("i", "value").alias("key"))
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    by_class = Window.partitionBy("id", "n")  # a class has one row per coordinate
    ranked = keys.join(held, "key").withColumns({"place": F.row_number().over(by_class.orderBy("held", "key")), "common": F.count(F.lit(1)).over(by_class)})
    # its other keys, held by no one else, come before these
    return ranked.where(F.col("place") + (coordinates - F.col("common")) <= coordinates - matches + 1).select("key", "id", "n", "held", "common")


def agreeing(x: str, y: str):
    """In how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, same: n + same)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs that reach the similarity on their full sets."""
    of = lambda end: sets.select(F.col("id").alias(end), F.col("shingles").alias(f"set_{end}"))
    held = pairs.join(of("a"), "a").join(of("b"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    enough = both * 100 >= (F.size("set_a") + F.size("set_b") - both) * percent
    return held.where(enough).select("a", "b").distinct()


def rare_places(sets: DataFrame, percent: int) -> DataFrame:
    """key long, id, n, rest: each set under its rarest shingles that other sets hold too. rest: how many shingles the
    set has from there on, in the order of how many sets hold them; those that no other holds come first. Two sets of n
    and m shingles have a first common one, and share no more than the lesser rest there; so it is among these places."""
    each = sets.select("id", "n", "s", F.explode("shingles").alias("key"))
    held = each.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = each.join(held, "key").groupBy("id", "n", "s").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("c"))
    left = F.size("c") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    placed = shared.where(left > 0).select("id", "n", F.size("c").alias("size"), F.posexplode(F.slice("c", F.lit(1), left)).alias("i", "c"))
    return placed.select("c.key", "id", "n", (F.col("size") - F.col("i")).alias("rest"))


def divided(placed: DataFrame) -> DataFrame:
    """Of places with the component of their sets, those under keys that several components share, with the main one: the
    one that has most of the key's places."""
    members = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    split = members.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("members", "component"))["component"].alias("main")).where("parts > 1")
    return placed.join(split.select("key", "main"), "key")


def merged(components: DataFrame, found: DataFrame) -> DataFrame:
    """id, component: components once more, with what the links (a, b) found between them join."""
    of = lambda end: components.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    whole = connected_components(found.join(of("a"), "a").join(of("b"), "b"), "of_a", "of_b").toDF("component", "whole")
    return components.join(whole, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))


def links(classes: DataFrame, documents: DataFrame, size: int, coordinates: int, matches: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Confirmed links (a, b) between classes, enough to connect each component; None where no key is shared."""
    chosen = scratch.write(postings(classes, coordinates, matches))
    if chosen.isEmpty():
        return None
    involved = classes.join(chosen.select("id").distinct(), "id", "left_semi").select("id", F.xxhash64("row").alias("key"), "row")
    named = documents.select(row_of(documents).alias("own"), "text")
    maybe, _ = bitmap.split(named, F.xxhash64("own"), involved, "key")  # few texts need to be shuffled
    met = maybe.join(involved.hint("merge"), F.col("own") == F.col("row")).groupBy("own", "id").agg(F.min("text").alias("text"))  # a row that repeats, once
    sets = scratch.write(full_sets(met, size))
    likely = _near("n", "m", percent) & (agreeing("signature", "sign") >= matches)
    own = classes.select(F.col("id").alias("b"), "n", "signature")
    other = classes.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("signature").alias("sign"))

    def meet(pairs: DataFrame) -> DataFrame:
        """pairs (a, b), each tested by size and signature, then on the full sets."""
        return confirmed(pairs.join(own, "b").join(other, "a").where(likely).select("a", "b"), sets, percent)

    def apart(found: DataFrame, table: DataFrame) -> DataFrame:
        placed = connected_components(found).withColumnRenamed("node", "id")
        return table.join(placed, "id", "left").withColumn("component", F.coalesce("component", "id"))

    central = F.struct(F.col("common"), -F.col("id"))
    hubs = chosen.groupBy("key").agg(F.max_by("id", central).alias("a"))
    one = chosen.join(hubs, "key").groupBy(F.col("id").alias("b")).agg(F.max_by("a", F.struct("held", "key")).alias("a")).where("a <> b")
    near = scratch.write(meet(one))

    placed = scratch.write(apart(near, chosen))
    first = placed.groupBy("key").agg(F.max_by(F.struct("id", "component"), central).alias("hub"))
    star = placed.join(first, "key").where("component <> hub.component").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    near = scratch.write(near.union(meet(star)))

    placed = scratch.write(apart(near, chosen).select("key", "id", "n", "component"))
    unsettled = scratch.write(divided(placed).select("id", "component").distinct())  # they share a key with another component
    places = scratch.write(rare_places(sets.join(unsettled.select("id"), "id"), percent))
    enough = F.least("rest_a", "rest") * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    ends = [F.col("id").alias("a"), F.col("n").alias("m"), F.col("rest").alias("rest_a")]
    for most in HUBS:
        posted = scratch.write(divided(places.join(unsettled, "id")))
        mixed = F.xxhash64("id", "key")
        some = posted.where("component = main").groupBy("key", F.pmod(mixed, F.lit(most)).alias("hub")).agg(F.min(F.struct(mixed.alias("h"), "id", "n", "rest")).alias("x"))
        pairs = posted.where("component <> main").select("key", *ends).join(some.select("key", F.col("x.id").alias("b"), "x.n", "x.rest"), "key")
        met = scratch.write(meet(pairs.where(enough & _near("n", "m", percent)).select("a", "b").distinct()))
        near, unsettled = near.union(met), scratch.write(merged(unsettled, met))
    posted = scratch.write(divided(places.join(unsettled, "id")).join(classes.select("id", "n", "signature"), ["id", "n"]))
    left = posted.where("component <> main").select("key", *ends, F.col("component").alias("component_a"), F.col("signature").alias("sign"))
    right = posted.select(F.col("key").alias("key_b"), F.col("id").alias("b"), "n", "rest", "component", "main", "signature")
    new = (F.col("component_a") != F.col("component")) & ((F.col("component") == F.col("main")) | (F.col("a") < F.col("b")))
    rest = left.join(right, (F.col("key") == F.col("key_b")) & new & enough & likely)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return scratch.write(near.union(confirmed(rest, sets, percent)))


def mark_rows(documents: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 48, matches: int = 22) -> DataFrame:
    """row struct<doc_id,a,b>, as row_of names it, n_shingles, component_id, and stays: whether the row is the one of its
    component that stays. One row per document; rows that repeat both id and text stay or go together."""
    known = documents.select("doc_id", "text")
    with Scratch(documents.sparkSession, "near-dedup") as scratch:
        sketched = scratch.write(sketches(known, shingle, coordinates))
        full = sketched.where(F.col("set_key").isNotNull() & F.col("row.doc_id").isNotNull())
        by_set = full.groupBy("set_key").agg(F.min("row").alias("row"))
        classes = by_set.join(full.select("set_key", "row", F.col("n_shingles").alias("n"), "signature"), ["set_key", "row"]).dropDuplicates(["set_key"])
        classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()))
        found = links(classes, known, shingle, coordinates, matches, percent, scratch)
        by_set = classes.select("set_key", "id", F.col("row").alias("first"))
        if found is not None:
            placed = by_set.join(connected_components(found).withColumnRenamed("node", "id"), "id", "left")
            placed = scratch.write(placed.withColumn("component", F.coalesce("component", "id")))
            firsts = placed.groupBy("component").agg(F.min("first").alias("first"))
            by_set = placed.drop("first").join(firsts, "component")
        placed = sketched.join(by_set.select("set_key", "first"), "set_key", "left")
        own = F.col("row.doc_id")
        component = F.when(own.isNotNull(), F.coalesce("first.doc_id", own))
        return scratch.keep(placed.select("row", "n_shingles", component.alias("component_id"), F.when(own.isNull() | F.col("first").isNull(), True).otherwise(F.col("row") == F.col("first")).alias("stays")))


def cluster_documents(documents: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 48, matches: int = 22) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    marked = mark_rows(documents, shingle, percent, coordinates, matches)
    return marked.select("row.doc_id", "n_shingles", "component_id", F.coalesce(F.col("row.doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
