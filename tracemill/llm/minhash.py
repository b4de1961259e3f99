"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

1. Every text becomes its set of word shingles (hashed to 64 bits) and a signature: for each of
   ``COORDINATES`` hash functions the smallest hash. Equal sets form a class with one
   representative; only representatives go on.
2. Two sets of Jaccard similarity s agree in each coordinate with probability s. Pairs at the
   limit of 0.75 agree in 48 of 64 on average; ``LEAST_MATCHES`` = 33 lies 4.3 standard deviations
   below, so a pair there is missed with probability 3e-5, and any more similar pair with less.
3. A document is posted under coordinate-value pairs. Pairs with t of k matches must share one of
   the first k - t + 1 of their values in any common order; only these prefixes are posted, rarest
   values first, where a value is rare unless the corpus count says otherwise (the order decides
   how much work there is, never the result).
4. Within a posting list collisions are counted: a member merges its shortest lists, counts whom it
   meets there, and looks these up in its long lists, skipping whom the lists left cannot lift over
   the threshold. A pair is looked at in the list of its first common coordinate only. A long list is dealt to lanes of
   bounded size in members and in shingles; each lane also gets the list's smallest document, so
   that near copies of one another are connected across lanes by comparisons in proportion to the
   members.
5. Documents with a candidate get their texts back, and the candidates of a lane are confirmed on
   full sets; pairs already connected within the lane are skipped, so a lane yields fewer links
   than it has members, and no table of all candidate pairs ever exists.
6. Links become components by propagating the smallest id with pointer jumping.
7. In lists of several lanes only pairs of different components are left: what is outside the
   largest component of a list meets all of the list, block by block; then 5 and 6 once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged, text_or_empty

SHINGLE_WORDS = 5
#: Linked are pairs with 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
COORDINATES, LEAST_MATCHES = 64, 33
PREFIX = COORDINATES - LEAST_MATCHES + 1
#: A value is common from so many representatives on; this many of the most common are told to every task.
COMMON_FROM, COMMON_VALUES = 16, 200_000
#: Members of a posting list that are compared in one lane, and their shingles together (one larger set is a lane's share too).
BLOCK, BLOCK_SHINGLES = 1024, 300_000
#: Entries of lists that are merged at once, and long lists that are looked up at once.
MERGED_AT_ONCE, SKIPPED_AT_ONCE = 1_000_000, 8
#: Signatures whose values are counted at a time.
COUNTED_ROWS = 10_000

_RNG = np.random.default_rng(20240601)
_WORD_FACTORS = _RNG.integers(1, 2**62, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH_FACTORS = _RNG.integers(1, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles; with fewer words the whole sequence is one; without words empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z, splits at the six white-space bytes
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = max(1, len(h) - SHINGLE_WORDS + 1)
    sums = np.full(last, min(len(h), SHINGLE_WORDS), np.uint64)
    for k in range(min(len(h), SHINGLE_WORDS)):
        sums += h[k : k + last] * _WORD_FACTORS[k]
    return np.unique(_mixed(sums))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash under each hash function."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, ((shingles[None, at : at + 4096] * _HASH_FACTORS[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype("<u4")


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, digest, sig) of each row; the digest of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text)
                n.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sigs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n", "digest", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def _keys(sigs: list[bytes]) -> np.ndarray:
    """[rows, coordinates]: coordinate and value in one number."""
    values = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, COORDINATES).astype(np.uint64)
    return (np.arange(COORDINATES, dtype=np.uint64)[None] << np.uint64(32)) | values


def common_values(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common coordinate values, sorted, and how often each was counted.

    A task counts a bounded number of rows at a time and passes on values that it has met twice among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def counted() -> pa.RecordBatch:
            found, n = np.unique(_keys(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= COUNTED_ROWS:
                yield counted()
        yield counted()

    counts = classes.select("sig").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "key").limit(COMMON_VALUES).collect()
    rows.sort(key=lambda r: r.key)
    return np.array([r.key for r in rows], np.uint64), np.array([r.n for r in rows], np.float64)


def _features(classes: DataFrame, common) -> DataFrame:
    """(rep, n, digest, mask, sig, keys): the posted prefix as a bit mask of coordinates and as keys."""
    shared = classes.sparkSession.sparkContext.broadcast(common)  # at most COMMON_VALUES pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch.column(3).to_pylist())
            weight = np.zeros(keys.shape)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                weight = np.where(known[at] == keys, counts[at], 0.0)
            # one order for all: by count, then by a hash of the value
            weight += (_mixed(keys) >> np.uint64(40)).astype(np.float64) / 2**25
            chosen = np.argsort(weight, axis=1, kind="stable")[:, :PREFIX]
            mask = np.bitwise_or.reduce(np.uint64(1) << chosen.astype(np.uint64), axis=1).view(np.int64)
            posted = np.take_along_axis(keys, chosen, axis=1).astype(np.int64)
            offsets = pa.array(np.arange(0, posted.size + 1, PREFIX, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(mask), batch.column(3), pa.ListArray.from_arrays(offsets, pa.array(posted.ravel()))],
                names=["rep", "n", "digest", "mask", "sig", "keys"],
            )

    return classes.select("rep", "n", "digest", "sig").mapInArrow(run, "rep long, n long, digest binary, mask long, sig binary, keys array<long>")


class Lane:
    """Members of a posting list that are compared with one another.

    In a lane of the first kind (side -1) each member meets the later ones. In a lane of the second
    kind members of side 0 meet those of side 1 (the list's largest part) and those later ones of
    side 2 (the rest of the list) that belong to another part.
    """

    def __init__(self, table: pa.Table):
        column = lambda name: table.column(name).to_numpy()
        self.coordinate = int(table.column("key")[0].as_py()) >> 32
        self.side, self.part, self.rep, self.n = column("side"), column("part"), column("rep"), column("n")
        self.mask = column("mask").astype(np.int64).view(np.uint64)
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)

    def _meet(self, i: np.ndarray, j: np.ndarray, similarity: int) -> np.ndarray:
        """Which of the pairs this lane looks at and sizes allow."""
        second = ((self.side[j] == 1) | ((self.side[j] == 2) & (self.rep[j] > self.rep[i]))) & (self.part[j] != self.part[i])
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        return np.where(self.side[i] < 0, j > i, second) & (100 * small >= similarity * large)

    def _postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members sorted by value per coordinate, and where each member's list begins in that order and how long it is."""
        order = np.argsort(self.sig, axis=0, kind="stable")
        value, place = np.take_along_axis(self.sig, order, axis=0), np.arange(len(self.n))[:, None]
        fresh = np.concatenate((np.ones((1, COORDINATES), bool), value[1:] != value[:-1]))
        ends = np.concatenate((fresh[1:], np.ones((1, COORDINATES), bool)))
        start = np.maximum.accumulate(np.where(fresh, place, 0), axis=0)
        stop = np.minimum.accumulate(np.where(ends, place, len(place))[::-1], axis=0)[::-1] + 1
        begin, length = np.empty_like(order), np.empty_like(order)
        np.put_along_axis(begin, order, start, axis=0)
        np.put_along_axis(length, order, stop - start, axis=0)
        return order, begin, length

    def collisions(self, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): pairs with enough equal coordinates whose first common posted one is this lane's, by i, then j.

        A member merges the shortest of its coordinates' lists and counts how often it meets each other
        member; who is in none of these cannot reach the threshold with the rest. The long lists are not
        merged: members met so far are looked up in them, some lists at a time, and skipped as soon as
        the lists left cannot lift them over the threshold.
        """
        m = len(self.n)
        order, begin, length = self._postings()
        by_length = np.argsort(length, axis=1, kind="stable")
        short, long = by_length[:, :PREFIX], by_length[:, PREFIX:]
        merged = np.take_along_axis(length, short, axis=1).sum(axis=1)
        todo = np.flatnonzero(self.side <= 0)
        while len(todo):
            some = max(1, min(int(np.searchsorted(np.cumsum(merged[todo]), MERGED_AT_ONCE)), MERGED_AT_ONCE // m))
            own, todo = todo[:some], todo[some:]
            lists = short[own]
            at, sizes = begin[own[:, None], lists].ravel(), length[own[:, None], lists].ravel()
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            met = order[np.repeat(at, sizes) + inside, np.repeat(lists.ravel(), sizes)]
            seen = np.bincount(np.repeat(np.arange(len(own)), merged[own]) * m + met, minlength=len(own) * m)
            hit = np.flatnonzero(seen)
            i, j, count = own[hit // m], hit % m, seen[hit]
            keep = self._meet(i, j, similarity)
            for first in range(0, long.shape[1], SKIPPED_AT_ONCE):
                i, j, count = i[keep], j[keep], count[keep]
                probed = long[i, first : first + SKIPPED_AT_ONCE]
                count = count + (self.sig[i[:, None], probed] == self.sig[j[:, None], probed]).sum(axis=1)
                keep = count >= LEAST_MATCHES - max(long.shape[1] - first - SKIPPED_AT_ONCE, 0)
            i, j = i[keep], j[keep]
            both = np.packbits(self.sig[i] == self.sig[j], axis=1, bitorder="little").view("<u8").ravel() & self.mask[i] & self.mask[j]
            here = both & (~both + np.uint64(1)) == np.uint64(1 << self.coordinate)
            if here.any():
                yield i[here], j[here]

    def candidates(self, i: int, similarity: int) -> np.ndarray:
        """Members that may be similar to member ``i`` and are looked at in this lane."""
        own = [met[members == i] for members, met in self.collisions(similarity)]
        return np.concatenate(own) if own else np.zeros(0, np.int64)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (key, lane), from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, lane = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (lane[1:] != lane[:-1])) + 1).tolist(), batch.num_rows]
        if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (int(key[0]), int(lane[0])):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


_MEMBER = "key long, lane long, side int, part long, rep long, n long, mask long, sig binary"


def _active_members(lists: DataFrame, similarity: int) -> DataFrame:
    """The members of lanes that have a candidate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lists(batches):
            lane = Lane(table)
            active = np.zeros(len(lane.n), bool)
            for i, j in lane.collisions(similarity):
                active[i] = active[j] = True
            if active.any():
                yield from table.filter(pa.array(active)).to_batches()

    return lists.mapInArrow(run, _MEMBER)


class Groups:
    """Union of members within a posting list."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, i: int, members: np.ndarray) -> np.ndarray:
        """Members that this newly connects to ``i``."""
        new = []
        for j in members.tolist():
            if self.root[i] != self.root[j]:
                self.root[self.root == self.root[j]] = self.root[i]
                new.append(j)
        return np.array(new, np.int64)


def _confirmed(members: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links confirmed on full sets that connect the members of a lane; rows carry their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lists(batches):
            lane, texts = Lane(table), table.column("text")
            sets: dict[int, np.ndarray] = {}

            def shingles(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingle_set(texts[i].as_py())
                return sets[i]

            groups, links = Groups(len(lane.n)), []
            for members, met in lane.collisions(similarity):
                cuts = np.flatnonzero(np.diff(members)) + 1
                for i, at in zip(members[np.concatenate(([0], cuts))].tolist(), np.split(met, cuts)):
                    at = at[groups.root[at] != groups.root[i]]
                    if not len(at):
                        continue
                    own, others = shingles(i), [shingles(j) for j in at.tolist()]
                    sizes, joined = np.array([len(x) for x in others]), np.concatenate(others)
                    place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                    shared = np.add.reduceat((own[place] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
                    near = at[100 * shared >= similarity * (sizes + len(own) - shared)]
                    links += [(int(lane.rep[i]), int(lane.rep[j])) for j in groups.join(i, near)]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _links(members: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """(a, b): the links of lanes (key, lane, side, part, rep, n, mask, sig)."""
    spark, order = members.sparkSession, ("key", "lane", "rep", "side")
    active = _active_members(members.repartition("key", "lane").sortWithinPartitions(*order), similarity)
    full = staged(spark, active, "near-active").join(texts, "rep").select("key", "lane", "side", "part", "rep", "n", "mask", "sig", "text")
    return staged(spark, _confirmed(full.repartition("key", "lane").sortWithinPartitions(*order), similarity), "near-links")


def _lanes(members: Column, shingles: Column, block: int) -> Column:
    return F.greatest(F.ceil(members / block), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("long")


def _first_lanes(posted: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, lane, side, part, rep): each member in one lane of its list, the list's first document in all of them."""
    own = F.pmod(F.xxhash64("rep"), F.col("lanes"))
    members = posted.join(lists, "key").select("key", own.alias("lane"), "rep")
    told = lists.filter("lanes > 1").select("key", "lanes", F.col("first").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"))
    told = told.filter(F.col("lane") != own).select("key", "lane", "rep")
    return members.unionByName(told).select("key", "lane", F.lit(-1).alias("side"), F.lit(0).cast("long").alias("part"), "rep")


def _second_lanes(posted: DataFrame, lists: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(key, lane, side, part, rep): for lists of several lanes, what is outside the list's largest part against all of it."""
    spark = posted.sparkSession
    part = F.coalesce("component", "rep")
    members = posted.join(lists.filter("lanes > 1").select("key", "lanes"), "key").join(found, F.col("rep") == F.col("node"), "left")
    members = staged(spark, members.select("key", "lanes", "rep", "n", part.alias("part")), "near-parts")
    parts = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("members", (-F.col("part")).alias("part"), "shingles"))
    whole = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), largest.alias("l"))
    rest = _lanes(F.col("members") - F.col("l.members"), F.col("shingles") - F.col("l.shingles"), block)
    whole = staged(spark, whole.filter("parts > 1").select("key", (-F.col("l.part")).alias("largest"), rest.alias("rest")), "near-wholes")
    rows = members.join(whole, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = rows.filter("part <> largest").select("*", F.pmod(F.xxhash64("rep"), F.col("rest")).alias("a"), every("lanes").alias("b"), F.lit(0).alias("side"))
    all_ = rows.select("*", every("rest").alias("a"), F.pmod(F.xxhash64("rep"), F.col("lanes")).alias("b"), F.when(F.col("part") == F.col("largest"), 1).otherwise(2).alias("side"))
    return few.unionByName(all_).select("key", (F.col("a") * F.col("lanes") + F.col("b")).alias("lane"), "side", "part", "rep")


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every linked node the smallest node it can reach; links are (a, b), in any direction."""
    spark = links.sparkSession
    both = links.filter("a <> b")
    edges = staged(spark, both.select("a", "b").union(both.select("b", "a")).distinct(), "near-edges")
    labels = staged(spark, edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "near-labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        seen = labels.join(seen, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        seen = staged(spark, seen, "near-seen")
        above = seen.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = seen.join(above, "component", "left").select("node", F.least("component", F.coalesce("top", "component")).alias("component"), "was")
        jumped = staged(spark, jumped, "near-labels")
        if not jumped.filter("component <> was").limit(1).count():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``similarity`` is in hundredths and must be at least 75, for which the match threshold is set.
    ``component_id`` is the smallest id that can be reached over links, the row's own included.

    Defined cases: null, empty and blank texts have no shingles and are linked with nothing. Rows
    with a null id are linked with nothing, have a null component and are not kept. Rows that
    repeat an id are one document: linked with whatever any of them is linked with. Whole texts
    count, however long; equal texts and ties need no rule, as the smallest id names a group. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"similarity is {SIMILARITY} at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    sigs = staged(spark, signatures(docs, id_col, text_col), "near-signatures")
    with_set = sigs.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = staged(spark, with_set.groupBy("digest", "n", "sig").agg(F.min("doc_id").alias("rep")), "near-classes")
    features = staged(spark, _features(classes, common_values(classes)), "near-features")
    posted = features.select("rep", "n", F.explode("keys").alias("key"))
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("rep").alias("first")).filter("members > 1")
    lists = staged(spark, lists.select("key", "first", _lanes(F.col("members"), F.col("shingles"), block).alias("lanes")), "near-lists")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_or_empty(text_col).alias("text"))
    signed = lambda lanes: lanes.join(features.select("rep", "n", "mask", "sig"), "rep").select("key", "lane", "side", "part", "rep", "n", "mask", "sig")
    links = _links(signed(_first_lanes(posted, lists)), texts, similarity)
    found = components(links)
    if lists.filter("lanes > 1").limit(1).count():
        found = components(links.unionByName(_links(signed(_second_lanes(posted, lists, found, block)), texts, similarity)))
    known = features.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left")
    known = staged(spark, known.select("digest", F.coalesce("component", "rep").alias("component_id")), "near-components")
    linked = with_set.join(known, "digest").select("doc_id", "n", "component_id")
    lone = sigs.filter(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(lone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
