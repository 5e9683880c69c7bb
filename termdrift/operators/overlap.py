"""Near-equal terms by clusters of similarity; one of each cluster stays.

Pairs of sets at a similarity are found by parts of their items, which is exact. By their sizes sets fall into classes, so
wide that sets at the similarity are of the same or of neighbouring ones. For such a pair of classes there is a most by
which two sets at the similarity may differ, and the items are dealt, by their hashes, into half as many parts again. Each
item in which two sets differ makes at most one part differ, so what a set has in each part is a signature of which two
sets at the similarity share all but that most; put in one order, they share SHARED among their first most + SHARED, and
only these are posted. The order is by how rare the items of a part are. A part has several items, so unlike sets seldom
share one signature and hardly ever two, while those that meet by one frequent item grow with the square of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termdrift.functions.scalars import known, relative_change
from termdrift.operators.components import connected_components
from termdrift.schemas import NEW_COUNT, OLD_COUNT
from termdrift.scratch import Scratch, bucketed, shared_folder, written

#: How many counters tell rare items from frequent ones, parts for each that may differ, and the most sets of
#: a block and, but for its last set, items of a block.
COUNTERS, PARTS, BLOCK, ITEMS = 1 << 16, 1.5, 1024, 1 << 20
#: Signatures by which a pair must meet; by the number of parts, sets at the similarity share two at least.
SHARED = 2
ODD = np.uint64(0x9E3779B97F4A7C15)


def item_sets(memberships: DataFrame, key: str = "id", item: str = "item") -> DataFrame:
    """id, items: the distinct known items of each known key."""
    each = memberships.select(F.col(key).alias("id"), F.col(item).alias("i")).where("id IS NOT NULL AND i IS NOT NULL")
    return each.groupBy("id").agg(F.collect_set("i").alias("items"))


def stored_sets(sets: DataFrame) -> DataFrame:
    """Sets (id, items), out of a grouping by id, written bucketed by id, so that no join by id shuffles them again."""
    return bucketed(sets, shared_folder(sets.sparkSession, "sets"), "id", grouped=True)


def sized(sets: DataFrame) -> DataFrame:
    """k, n, items: each set of (id, items) that has an item, with its size."""
    return sets.where("id IS NOT NULL AND size(items) > 0").select(F.col("id").alias("k"), F.size("items").alias("n"), "items")


def ordered_sets(memberships: DataFrame, key: str = "id", item: str = "item") -> DataFrame:
    """The sized sets of memberships."""
    return sized(item_sets(memberships, key, item))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _counter(items: np.ndarray) -> np.ndarray:
    return (items & np.uint64(COUNTERS - 1)).astype("i8")


def rarities(sets: DataFrame) -> np.ndarray:
    """How rare the items of each counter are, in eighths of a binary digit. Items share COUNTERS counters by their hashes, so
    the table is as large whatever the corpus. It sets an order only: any would find the same pairs."""
    slot = F.explode(F.transform("items", lambda x: F.xxhash64(x).bitwiseAND(COUNTERS - 1))).alias("slot")
    counts = np.zeros(COUNTERS)
    for at, n in sets.select(slot).groupBy("slot").count().collect():
        counts[at] = n
    return np.floor(8 * np.log2(max(counts.sum(), 1) / np.maximum(counts, 1)))


def signatures(sizes: np.ndarray, items: np.ndarray, at_least: float, rare: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(set, signature, lower) of what is posted of sets, given by their sizes and the hashes of their items: as the lower
    and as the upper class of a pair of classes."""
    width = -math.log(at_least) + 1e-6  # a little wide, so that rounding parts no pair by two classes
    mixed, of_item, weight = _mixed(items), np.repeat(np.arange(len(sizes)), sizes), rare[_counter(items)]
    own = _mixed(mixed + ODD)
    high, low = (own >> np.uint64(38)).astype("f8"), (own & np.uint64((1 << 26) - 1)).astype("f8")  # sums of halves are exact
    for lower in (True, False):
        pair = np.floor(np.log(sizes) / width) - (not lower)
        most = np.floor((1 - at_least) / (1 + at_least) * (np.exp((pair + 1) * width) + np.exp((pair + 2) * width)) + 1e-6).astype("i8")
        parts = np.ceil(PARTS * (most + 1)).astype("i8")
        base = np.cumsum(parts) - parts
        cell = base[of_item] + ((mixed >> np.uint64(33)).astype("i8") % parts[of_item])
        total = int(parts.sum())
        sums = [np.bincount(cell, x, total).astype("u8") for x in (high, low)]
        of = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(total) - base[of]
        made = _mixed(_mixed(sums[0] * ODD + sums[1]) + place.astype("u8") * ODD + pair[of].astype("i8").astype("u8"))
        order = np.lexsort((made, -np.bincount(cell, weight, total), of))
        first = order[place < most[of] + SHARED]
        yield of[first], made[first], lower


def postings(sets: DataFrame, at_least: float) -> DataFrame:
    """s, k, n, lower: each set under its signatures. sets: k, n, items."""
    rare = sets.sparkSession.sparkContext.broadcast(rarities(sets))

    def post(batches, largest=1 << 19):
        import pyarrow as pa

        for batch in batches:
            lists, sizes, at = batch.column("hashes"), batch.column("n").to_numpy(), 0
            ends = np.cumsum(sizes)
            while at < len(sizes):  # so many sets at once, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + largest, "right")))
                some = lists.slice(at, to - at).flatten().to_numpy(zero_copy_only=False).view("u8")
                for of, made, lower in signatures(sizes[at:to], some, at_least, rare.value):
                    take = pa.array(of + at)
                    whose = [batch.column(c).take(take) for c in ("k", "n")]
                    yield pa.RecordBatch.from_arrays([pa.array(made.view("i8")), *whose, pa.array(np.full(len(of), lower))], ["s", "k", "n", "lower"])
                at = to

    hashed = sets.select("k", "n", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    return hashed.mapInArrow(post, f"s long, k {sets.schema['k'].dataType.simpleString()}, n int, lower boolean")


def shared_postings(sets: DataFrame, at_least: float) -> DataFrame:
    """The postings under signatures that another set has too."""
    held = F.count(F.lit(1)).over(Window.partitionBy("s"))
    return postings(sets, at_least).withColumn("held", held).where("held > 1").drop("held")


def _fits(at_least: float) -> Column:
    return F.least("m", "n") >= F.greatest("m", "n") * at_least - 1e-9


def met_pairs(posted: DataFrame, at_least: float, *more: str) -> DataFrame:
    """a, b, m, n: pairs a < b that share SHARED signatures and whose sizes allow the similarity; more: columns of posted that
    must differ."""
    left = posted.select("s", F.col("k").alias("a"), F.col("n").alias("m"), F.col("lower").alias("lower_a"), *[F.col(c).alias(f"{c}_a") for c in more])
    right = posted.select("s", F.col("k").alias("b"), "n", "lower", *more)
    new = (F.col("a") < F.col("b")) & (F.col("lower") | F.col("lower_a")) & _fits(at_least)
    for c in more:
        new &= F.col(c) != F.col(f"{c}_a")
    return often(left.join(right, "s").where(new))


def often(meetings: DataFrame) -> DataFrame:
    """a, b, m, n: the pairs that meet SHARED times."""
    return meetings.groupBy("a", "b", "m", "n").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= SHARED).drop("times")


def parities(hashes, largest=1 << 19):
    """Bits of each set, each telling whether the set has an odd number of the items that hash to it: as many as the set has
    items, rounded up to a power of two, 256 at least. Two sets differ in at least as many items as these differ in bits."""
    import pyarrow as pa

    sizes, flat, at = hashes.value_lengths().to_numpy(zero_copy_only=False), [], 0
    ends = np.cumsum(sizes)
    widths = 1 << np.maximum(np.ceil(np.log2(np.maximum(sizes, 1))), 8).astype("i8")
    while at < len(sizes):  # so many items at once, one set at least
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + largest, "right")))
        items = hashes.slice(at, to - at).flatten().to_numpy(zero_copy_only=False).view("u8")
        own = np.repeat(widths[at:to], sizes[at:to])
        bit = (_mixed(items) >> np.uint64(32)).astype("i8") & (own - 1)
        first = np.cumsum(widths[at:to]) - widths[at:to]
        odd = np.bincount(np.repeat(first, sizes[at:to]) + bit, minlength=int(widths[at:to].sum())) & 1
        flat.append(np.packbits(odd.astype("u1"), bitorder="little").view("i8"))
        at = to
    starts = np.concatenate([[0], np.cumsum(widths // 64)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(flat) if flat else np.zeros(0, "i8")))


def parity_bits(sets: DataFrame) -> DataFrame:
    """k, bits: parities of each set."""
    return sets.select("k", F.arrow_udf(parities, "array<long>")(F.transform("items", lambda x: F.xxhash64(x))).alias("bits"))


def _folded(bits: str, to: Column) -> Column:
    """The bits that fewer words, a power of two of them, would hold of the same set."""
    more = F.sequence(F.lit(1), (F.size(bits) / to).cast("int") - 1)
    fold = F.aggregate(more, F.slice(bits, 1, to), lambda sum, i: F.zip_with(sum, F.slice(bits, i * to + 1, to), lambda x, y: x.bitwiseXOR(y)))
    return F.when(F.size(bits) > to, fold).otherwise(F.col(bits))


def likely(pairs: DataFrame, bits: DataFrame, at_least: float) -> DataFrame:
    """The pairs that may reach at_least by some bits of each set, so that few whole sets are shuffled for nothing. bits:
    parity_bits of the sets, best written."""
    held = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    words = F.least(F.size("bits_a"), F.size("bits_b"))
    odd = F.zip_with(_folded("bits_a", words), _folded("bits_b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(odd, F.lit(0), lambda n, x: n + x)
    return held.where(apart <= (F.col("m") + F.col("n")) * ((1 - at_least) / (1 + at_least)) + 1e-6).select("a", "b", "m", "n")


def candidate_pairs(sets: DataFrame, at_least: float) -> DataFrame:
    """a, b, m, n: pairs a < b of sets that may reach at_least, above 0. No pair that reaches it is missing."""
    return likely(met_pairs(shared_postings(sets, at_least), at_least), parity_bits(sets), at_least)


def compared_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, m, n, jaccard of candidate pairs."""
    of = lambda end: sets.select(F.col("k").alias(end), F.col("items").alias(f"s{end}"))
    held = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return held.select("a", "b", "m", "n", (F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).alias("jaccard"))


def distinct_sets(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """k, n, items of one set of all that are alike, and (id, twin): for each id the smallest one with the same set. Sets
    are told by their sizes and two hashes, whatever the order of their items."""
    own, start = sized(sets), F.lit(0).cast("long")
    h = F.aggregate("items", start, lambda sum, x: sum.bitwiseXOR(F.xxhash64(x)))
    g = F.aggregate("items", start, lambda sum, x: sum.bitwiseXOR(F.xxhash64(F.lit(1), x)))
    named = scratch.write(own.select("k", "n", h.alias("h"), g.alias("g")))
    first = named.groupBy("h", "g", "n").agg(F.min("k").alias("twin"))
    twins = scratch.keep(named.join(first, ["h", "g", "n"]).select(F.col("k").alias("id"), "twin"))
    return own.join(twins.where("id <> twin").select(F.col("id").alias("k")), "k", "left_anti"), twins


def placed_by(links: DataFrame, table: DataFrame) -> DataFrame:
    """table with the component of its k by links."""
    placed = connected_components(links).withColumnRenamed("node", "k")
    return table.join(placed, "k", "left").withColumn("component", F.coalesce("component", "k"))


def spanning(whole: DataFrame, own: DataFrame, at_least: float, wanted: Column, scratch: Scratch) -> DataFrame:
    """a, b, m, n, jaccard: wanted pairs of the sets in whole, enough to hang together what all would. wanted: what makes a pair
    of at_least one. own: where sets are looked up by k, those of whole at least.

    All sets under a signature first meet one of them, in rows that grow with the postings. Then only pairs that do not yet
    hang together can change anything, and all of those that share SHARED signatures are compared."""
    posted = scratch.write(shared_postings(whole, at_least))
    hub = F.min(F.struct("k", "n")).over(Window.partitionBy("s"))
    star = posted.withColumn("hub", hub).select(F.col("hub.k").alias("a"), F.col("k").alias("b"), F.col("hub.n").alias("m"), "n")
    bits = scratch.write(parity_bits(whole))
    close = likely(often(star.where((F.col("a") < F.col("b")) & _fits(at_least))), bits, at_least)
    near = scratch.write(compared_pairs(close, own).where(wanted))
    placed = scratch.write(placed_by(near, posted))
    split = placed.groupBy("s").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("s")
    apart = scratch.write(placed.join(split, "s", "left_semi"))
    met = scratch.write(met_pairs(apart, at_least, "component"))
    return scratch.write(near.union(compared_pairs(likely(met, bits, at_least), own).where(wanted)))


def in_common(sets, left: np.ndarray, right: np.ndarray, largest: int = 1 << 22) -> np.ndarray:
    """How many items each of the sets at left has in common with each at right. sets: an Arrow list array.

    Which set has which item is a matrix of ones and zeros, so the counts are a product of matrices; of the matrix so many
    cells are made at once, or one column, and sums of so few ones are exact."""
    import pyarrow as pa

    items, of = sets.flatten(), np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy(zero_copy_only=False))
    if pa.types.is_nested(items.type):
        items = pa.array([repr(x) for x in items.to_pylist()])
    code = items.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    shared = np.bincount(code, minlength=1) > 1
    kept = shared[code]  # what only one set has is in common to none
    of, code = of[kept], (np.cumsum(shared) - 1)[code[kept]]
    order = np.argsort(code, kind="stable")
    of, code, width = of[order], code[order], max(1, largest // max(1, len(sets)))
    both = np.zeros((len(left), len(right)))
    for at in range(0, int(shared.sum()), width):
        some = slice(*np.searchsorted(code, (at, at + width)))
        has = np.zeros((len(sets), min(width, int(shared.sum()) - at)), "f4")
        has[of[some], code[some] - at] = 1
        both += has[left] @ has[right].T
    return both


def met_blocks(at_least: float):
    """The pairs (a, b, jaccard) that reach at_least of the sets of two blocks, or of one, as a function of an Arrow table of
    both: x, y, own, place, k, n, items."""

    def meet(table):
        import pyarrow as pa

        table = table.combine_chunks()
        own, place, n = (table[c].to_numpy() for c in ("own", "place", "n"))
        left, right = np.flatnonzero(own == table["x"][0].as_py()), np.flatnonzero(own == table["y"][0].as_py())
        both = in_common(table["items"].combine_chunks(), left, right)
        jaccard = both / (n[left][:, None] + n[right][None, :] - both)
        a, b = np.nonzero((jaccard >= at_least) & (place[left][:, None] < place[right][None, :]))
        k = table["k"].combine_chunks()
        return pa.table([k.take(pa.array(left[a])), k.take(pa.array(right[b])), pa.array(jaccard[a, b])], ["a", "b", "jaccard"])

    return meet


def within(own: DataFrame, links: DataFrame, at_least: float, scratch: Scratch) -> DataFrame:
    """a, b, jaccard of all pairs that reach at_least, given links (a, b, m, n) that hang together whatever reaches it.

    A component is dealt into blocks of at most BLOCK sets and about ITEMS items, and each two blocks meet in a group of
    their own, so a set is shuffled once for each block and not for each pair, and a task holds two blocks at a time."""
    sizes = links.select(F.col("a").alias("k"), F.col("m").alias("n")).union(links.select("b", "n")).distinct()
    placed = connected_components(links).withColumnRenamed("node", "k").join(sizes, "k")
    in_order, room = Window.partitionBy("component").orderBy("k"), F.greatest("n", F.lit(ITEMS // BLOCK)).cast("long")
    block = F.floor((F.sum(room).over(in_order) - room) / ITEMS).cast("int")
    blocks = scratch.write(placed.select("component", "k", "n", F.row_number().over(in_order).alias("place"), block.alias("own")))
    last = blocks.groupBy("component").agg(F.max("own").alias("last"))
    sets = blocks.join(last, "component").join(own.select("k", "items"), "k").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    dealt = sets.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "place", "k", "n", "items")
    key = own.schema["k"].dataType.simpleString()
    return dealt.groupBy("component", "x", "y").applyInArrow(met_blocks(at_least), f"a {key}, b {key}, jaccard double")


def set_links(sets: DataFrame, at_least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, jaccard), a < b, of unlike sets that reach at_least, above 0; and (id, twin): for each id the
    smallest one with the same set, by which alone the pairs name it. sets: id, items, one row an id, best stored_sets."""
    with Scratch(sets.sparkSession, "jaccard") as scratch:
        whole, twins = distinct_sets(sets, scratch)
        links = spanning(whole, sized(sets), at_least, F.col("jaccard") >= at_least, scratch)
        return scratch.keep(within(sized(sets), links, at_least, scratch)), twins


def set_cluster_links(sets: DataFrame, threshold: float = 0.9) -> DataFrame:
    """a, b, jaccard: pairs above the threshold, enough to hang together what all would. sets: id, items, one row an id, best
    stored_sets."""
    with Scratch(sets.sparkSession, "cluster-links") as scratch:
        whole, twins = distinct_sets(sets, scratch)
        return scratch.keep(cluster_links(spanning(whole, sized(sets), threshold, F.col("jaccard") > threshold, scratch), twins))


def jaccard_links(memberships: DataFrame, at_least: float = 0.0, key: str = "id", item: str = "item") -> tuple[DataFrame, DataFrame]:
    """set_links of memberships. Without a bound all pairs that share an item are counted item by item."""
    sets = stored_sets(item_sets(memberships, key, item))
    if at_least > 0:
        return set_links(sets, at_least)
    with Scratch(memberships.sparkSession, "jaccard") as scratch:
        whole, twins = distinct_sets(sets, scratch)
        posted = whole.select("k", "n", F.explode("items").alias("item"))
        left, right = posted.toDF("a", "m", "item"), posted.toDF("b", "n", "item")
        counted = left.join(right, "item").where("a < b").groupBy("a", "b", "m", "n").agg(F.count(F.lit(1)).alias("c"))
        return scratch.keep(counted.select("a", "b", (F.col("c") / (F.col("m") + F.col("n") - F.col("c"))).alias("jaccard"))), twins


def jaccard_pairs(memberships: DataFrame, at_least: float = 0.0, key: str = "id", item: str = "item") -> DataFrame:
    """a, b, jaccard of all pairs a < b that share an item and reach at_least, like sets among them."""
    return expanded(*jaccard_links(memberships, at_least, key, item))


def expanded(pairs: DataFrame, twins: DataFrame) -> DataFrame:
    """a, b, jaccard of all pairs a < b of ids, given those of unlike sets and each id's twin.

    The ids of a twin are dealt into lists of at most BLOCK, and pairs become pairs of lists; pairs of ids, which may be many
    times as many, are made last and not shuffled. The lists of one twin meet in groups of their own."""
    nth = F.row_number().over(Window.partitionBy("twin").orderBy("id"))
    listed = twins.withColumn("part", F.floor((nth - 1) / BLOCK).cast("int")).groupBy("twin", "part").agg(F.collect_list("id").alias("ids"))
    of = lambda end: listed.select(F.col("twin").alias(end), F.col("part").alias(f"{end}_part"), F.col("ids").alias(f"{end}_ids"))
    unlike = pairs.join(of("a"), "a").join(of("b"), "b")
    several = of("b").where("b_part > 0 OR size(b_ids) > 1")
    alike = of("a").join(several, (F.col("a") == F.col("b")) & (F.col("a_part") <= F.col("b_part"))).repartition("a", "a_part", "b_part")
    ids = lambda df, jaccard: df.select(jaccard, "b_ids", F.explode("a_ids").alias("a")).select("jaccard", "a", F.explode("b_ids").alias("b"))
    like = ids(alike, F.lit(1.0).alias("jaccard")).where("a < b")
    return ids(unlike, F.col("jaccard")).union(like).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def cluster_links(pairs: DataFrame, twins: DataFrame) -> DataFrame:
    """a, b, jaccard: pairs, and each id with its twin, which hang together what all pairs would."""
    alike = twins.where("id <> twin").select(F.col("twin").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return pairs.select("a", "b", "jaccard").union(alike)


def clusters(nodes: DataFrame, pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """id, component: the smallest id that the node hangs together with by similarities above the threshold.

    Directions don't matter; unknown similarities and pairs of a node with itself are no links."""
    links = pairs.where((known(F.col("jaccard")) > threshold) & (F.col("a") != F.col("b"))).select("a", "b")
    found = connected_components(links).select(F.col("node").alias("id"), "component")
    return nodes.select("id").distinct().join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def similarity_of(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, jaccard of the given pairs (a, b) from their whole sets (id, items), however small; 0 for an unknown or empty
    set."""
    of = lambda end: sets.select(F.col("id").alias(end), F.col("items").alias(f"s{end}"))
    held = wanted.join(of("a"), "a", "left").join(of("b"), "b", "left")
    common = F.size(F.array_intersect("sa", "sb"))
    return held.select("a", "b", F.coalesce(F.try_divide(common, F.size("sa") + F.size("sb") - common), F.lit(0.0)).alias("jaccard"))


@dataclass
class Overlap:
    filtered: DataFrame  # the dataset's rows of representatives
    removed_terms: DataFrame  # removed_go_id, representative_go_id
    cluster_stats: DataFrame  # cluster_size, count
    removal: DataFrame  # removed_terms with the similarity and both sides' counts and changes


def filter_overlapping_go_terms(
    nodes: DataFrame, pairs: DataFrame, dataset: DataFrame, threshold: float = 0.9, old: str = OLD_COUNT, new: str = NEW_COUNT, memberships: DataFrame | None = None, sets: DataFrame | None = None
) -> Overlap:
    """Of each cluster the term with the largest change in percent stays, up or down; of equals the smallest id.

    nodes: all ids, of which those outside the dataset may still link others. pairs: both directions of a similarity
    that differs by direction; the one from the removed to the kept term is reported, the other if it is missing,
    and 0 if both are. Where pairs leaves out what is less similar, memberships (id, item) or sets (id, items) gives the
    true value: in a chain of links the removed term may be far from the kept one. Dataset rows whose id is no node go. A cluster without a
    row in the dataset, or with no known change, has no representative."""
    placed = written(clusters(nodes, pairs, threshold), "clusters")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))
    stats = sizes.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("count"))
    change = F.abs(relative_change(F.col(old), F.col(new)) * 100)
    rows = dataset.select("go_id", old, new).join(placed.withColumnRenamed("id", "go_id"), "go_id").join(sizes, "component").withColumn("pct_change", known(change))
    usable = rows.where("cluster_size = 1 OR pct_change IS NOT NULL")
    first = Window.partitionBy("component").orderBy(F.desc_nulls_last("pct_change"), "go_id", old, new)
    named = {"go_id": "representative_go_id", old: "kept_genes_2016", new: "kept_genes_2024", "pct_change": "kept_pct_change"}
    kept = usable.withColumn("r", F.row_number().over(first)).where("r = 1").select("component", *[F.col(c).alias(name) for c, name in named.items()])
    gone = rows.where("cluster_size > 1").join(kept, "component").where("go_id <> representative_go_id")
    directed = pairs.select("a", "b", "jaccard", F.lit(0).alias("back")).union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard", F.lit(1).alias("back")))
    cell = directed.groupBy("a", "b").agg(F.min_by("jaccard", "back").alias("jaccard"))
    if memberships is not None:
        sets = item_sets(memberships)
    if sets is not None:
        cell = similarity_of(gone.select(F.col("go_id").alias("a"), F.col("representative_go_id").alias("b")).distinct(), sets)
    detail = gone.join(cell, (F.col("go_id") == F.col("a")) & (F.col("representative_go_id") == F.col("b")), "left").select(
        F.col("go_id").alias("removed_go_id"), "representative_go_id", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard_similarity"),
        F.col(old).alias("removed_genes_2016"), F.col(new).alias("removed_genes_2024"), F.col("pct_change").alias("removed_pct_change"),
        "kept_genes_2016", "kept_genes_2024", "kept_pct_change",
    )
    stay = kept.select(F.col("representative_go_id").alias("go_id"))
    return Overlap(dataset.join(stay, "go_id", "left_semi").select(dataset.columns), detail.select("removed_go_id", "representative_go_id").distinct(), stats, detail)
