"""Operator 1: n-gram Jaccard join with size-banded tiles and bitmap signatures.

A document's set holds 64-bit names of its distinct five-word shingles; two
documents link when 100 * intersection >= 80 * union.  The result is exact.

1. Sets are named; documents with equal sets are one class and are compared once.
2. Tiles.  Any two linked sets share one of their first n - ceil(0.8 n) + 1
   shingles in any common order.  The order puts shingles that many sets share last (by a
   bounded table of counts) and the rest by name.  Sets that share such a shingle meet in its tile;
   tiles are parted into bands of sizes whose ratio stays above 0.8, a band also meets the next one.
3. Stars first.  In every tile a set proposes itself to one set of another
   component, in each round to another one; each set keeps the nearest by bitmaps, which is verified.
   A family of thousands of near copies becomes one component with a few comparisons per member.
4. Then all remaining pairs of a tile that lie in different components are
   compared by bitmaps: parity bits of hashed shingles, folded to a common width.  The bits in which two
   bitmaps differ bound the symmetric difference from below, and so the overlap from above.  Pairs that pass are
   verified by intersecting the sorted arrays.  A tile with many sets is dealt out as pairs of blocks.

Only pairs inside one component are skipped, so no component is missed.

Defined results: NULL or empty text, or no words: set size 0, linked with nothing, its own
component.  Fewer than five words: the whole sequence is one shingle.  Repeated ``doc_id``: one node
with several texts.  NULL ``doc_id``: linked with nothing, component NULL.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe import slices
from tidepanel.llm.common import of_stage, partitions_for, stored
from tidepanel.llm.components import connected
from tidepanel.llm.words import M1, mixed, word_names

SHINGLE = 5
# Threshold as a fraction of integers: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
# Entries of the table of frequent shingles; it only orders, so its bound changes no result.
FREQUENT = 1 << 16
FREQUENT_IN_BATCH = 4
# Bits of the filter that spares sets no tile holds; when it is full it spares none.
FILTER_BITS = 1 << 23
BLOCK = 2048
STAR_ROUNDS = 3
# Tiles of fewer sets are small: all their pairs are few beside their rows.
SMALL = 8
# Characters whose shingles are made at a time.
RUN = 1_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct names of the shingles of whole texts."""
    names, counts = word_names(texts)
    rolled = np.full(max(0, len(names) - SHINGLE + 1), np.uint64(SHINGLE))
    for k in range(SHINGLE if len(rolled) else 0):
        rolled = rolled * _K + names[k : len(names) - SHINGLE + 1 + k]
    rolled = mixed(rolled)
    found, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            found.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            whole = np.full(1, np.uint64(n))
            for k in range(n):
                whole = whole * _K + names[at + k : at + k + 1]
            found.append(mixed(whole))
        else:
            found.append(np.empty(0, np.uint64))
        at += n
    return found


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """Name of a set and a second, independent one as a check; both fit BIGINT."""
    a = mixed(shingles * M1).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))
    b = mixed(shingles + _K).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(a).view(np.int64)[0]), int(b.view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def band_of(n: np.ndarray) -> np.ndarray:
    """Sizes of one band differ by a factor below 1 / 0.8; linked sets lie in the same or in neighbouring bands."""
    return np.floor(np.log(n) / math.log(DEN / NUM) + 1e-9).astype(np.int32)


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bit k: are an odd number of shingles hashed to k?  As many bits as a power of two at or above the size, 256 at least."""
    bits = max(256, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: int, bits: int, wanted: int) -> int:
    """Fold to ``wanted`` bits; parities add up."""
    while bits > wanted:
        bits //= 2
        bitmap = (bitmap ^ (bitmap >> bits)) & ((1 << bits) - 1)
    return bitmap


def sizes_fit(n: int, m: int) -> bool:
    return DEN * n >= NUM * m if n < m else DEN * m >= NUM * n


def difference(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, at their common width; sets differ in as many shingles at least."""
    bits = 8 * min(len(x), len(y))
    return (folded(int.from_bytes(x, "little"), 8 * len(x), bits) ^ folded(int.from_bytes(y, "little"), 8 * len(y), bits)).bit_count()


def may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    """Do the bitmaps allow a link?  Linked sets differ in at most (n + m) * (1 - t) / (1 + t) shingles."""
    return (DEN + NUM) * difference(x, y) <= (DEN - NUM) * (n + m)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted arrays."""
    n, m = len(a), len(b)
    if not n or not m or DEN * min(n, m) < NUM * max(n, m):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return DEN * inter >= NUM * (n + m - inter)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    of_stage("shingles", dict)  # what the worker kept for other stages goes
    for first, run in slices(batch.column(1), RUN):
        yield first, shingle_sets(run)


def _name_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: a document and its set's name; kind 1: a shingle that several sets of a batch share, and how many)."""
    for batch in source:
        for first, sets in _sets(batch):
            names = [set_name(s) for s in sets]
            n = len(sets)
            distinct = {a: s for (a, _), s in zip(names, sets)}
            drawn = {a: parity_bitmap(s).tobytes() for a, s in distinct.items() if len(s)}
            ids = batch.column(0).slice(first, n).to_pylist()
            bitmaps = [drawn.pop(a, None) if i is not None else None for i, (a, _) in zip(ids, names)]
            shared, counts = np.unique(np.concatenate([*distinct.values(), np.empty(0, np.uint64)]), return_counts=True)
            shared, counts = shared[counts >= FREQUENT_IN_BATCH], counts[counts >= FREQUENT_IN_BATCH]
            k = len(shared)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n + [1] * k, pa.int32()),
                 pa.concat_arrays([batch.column(0).slice(first, n), pa.array(shared.view(np.int64))]),
                 pa.array([len(s) for s in sets] + counts.tolist(), pa.int64()),
                 pa.array([a for a, _ in names] + [None] * k, pa.int64()), pa.array([b for _, b in names] + [None] * k, pa.int64()),
                 pa.array(bitmaps + [None] * k, pa.binary())],
                names=["kind", "id", "n", "sid", "check", "bitmap"],
            )


def _prefix_batches(frequent: np.ndarray, rank: np.ndarray):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for _, sets in _sets(batch):
                seen, tokens, sids, sizes = set(), [], [], []
                for s in sets:
                    sid = set_name(s)[0]
                    if not len(s) or sid in seen:
                        continue
                    seen.add(sid)
                    p = prefix_length(len(s))
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        hot = frequent[at] == s
                        if hot[:p].any():
                            last = s[hot][np.argsort(rank[at[hot]], kind="stable")]
                            s = np.concatenate([s[~hot], last])
                            n = len(s)
                        else:
                            n = len(s)
                    else:
                        n = len(s)
                    tokens.append(s[:p])
                    sids.append(sid)
                    sizes.append(n)
                reps = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([*tokens, np.empty(0, np.uint64)]).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), reps)),
                     pa.array(np.repeat(np.array(sizes, np.int32), reps), pa.int32())],
                    names=["token", "sid", "n"],
                )

    return batches


def _shared_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep tokens with two different sets at least, each set once; rows come sorted by token and set.

    One row is carried from batch to batch: the last one, which may have been the only one of its token so far.
    """
    held, emitted = None, False
    for batch in source:
        token, sid, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if held is not None:
            token, sid, n = (np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held, (token, sid, n)))
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        token, sid, n = token[new], sid[new], n[new]
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        # The carried row was written before if its token already had two; the last row is written with the next batch.
        if held is not None and emitted:
            keep[0] = False
        last_kept = bool(same[-1]) if len(same) else emitted and held is not None
        held = (token[-1], sid[-1], n[-1])
        emitted = last_kept
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(sid[keep]), pa.array(n[keep], pa.int32())], names=["token", "sid", "n"])


_SHIFTS = (0, 20, 40)


def _set_batches(words: np.ndarray):
    """(sid, shingles) of the documents that the filter lets through; the others' texts are not parsed."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            raw = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            passed = np.ones(len(raw), bool)
            for shift in _SHIFTS:
                spot = (raw >> np.uint64(shift)) % np.uint64(FILTER_BITS)
                passed &= (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
            for _, sets in _sets(batch.filter(pa.array(passed))):
                mine = {set_name(s)[0]: s for s in sets if len(s)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(mine), pa.int64()), pa.array([s.tobytes() for s in mine.values()], pa.binary())], names=["sid", "shingles"]
                )

    return batches


def _filter_words(needed: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes in ``needed`` (one column, hash): FILTER_BITS / 64 words at most reach the driver."""
    spots = [F.pmod(F.shiftrightunsigned("hash", s) if s else F.expr(f"hash & {FILTER_BITS - 1}"), F.lit(FILTER_BITS)) for s in _SHIFTS]
    spot = needed.select(F.explode(F.array(*spots)).alias("spot"))
    words = spot.groupBy(F.expr("spot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[np.array(words.column("word"), np.int64)] = np.array(words.column("bits"), np.int64).view(np.uint64)
    return out


def _exact_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        a, b = batch.column(2), batch.column(3)
        good = [linked(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by intersection of the sorted arrays."""
    one = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("shingles_a"))
    two = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("shingles_b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "shingles_a", "shingles_b")
    return rows.mapInArrow(_exact_batches, "a bigint, b bigint")


class _Sets:
    """Shingle arrays of the sets that pairs ask for, read from the texts once and kept in the shared folder."""

    def __init__(self, texts: DataFrame, members: DataFrame):
        self.texts, self.known = texts.withColumn("hash", F.xxhash64("doc_id")), None
        self.owners = members.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("owner"))

    def of(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
        if self.known is not None:
            wanted = wanted.join(self.known.select("sid"), "sid", "left_anti")
        wanted = stored(wanted, "wanted")
        if self.known is None or wanted.limit(1).count():
            owners = self.owners.join(wanted, "sid", "left_semi").select(F.xxhash64("owner").alias("hash"))
            read = self.texts.mapInArrow(_set_batches(_filter_words(owners)), "sid bigint, shingles binary")
            read = stored(read.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "sets")
            self.known = read if self.known is None else self.known.union(read)
        return self.known


def _near_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose bitmaps allow a link; the last two columns are the bitmaps and stay behind."""
    for batch in source:
        rows = zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns - 4, batch.num_columns)))
        good = [sizes_fit(n, m) and may_link(n, m, x, y) for n, m, x, y in rows]
        yield batch.filter(pa.array(good, pa.bool_())).select(range(batch.num_columns - 4))


def _with_components(tiles: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return tiles.withColumn("component", F.col("sid"))
    return tiles.join(labels, tiles["sid"] == labels["node"], "left").withColumn("component", F.coalesce("component", "sid")).drop("node")


def _distance_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, other, share of their shingles in which the bitmaps differ) for the pairs that may link."""
    for batch in source:
        found = []
        for sid, other, n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if sizes_fit(n, m) and (DEN + NUM) * (apart := difference(x, y)) <= (DEN - NUM) * (n + m):
                found.append((sid, other, apart / (n + m)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["sid", "other", "share"]
        )


def _star_proposals(tiles: DataFrame, bitmaps: DataFrame, turn: int) -> DataFrame:
    """For each set the nearest of the sets that its tiles propose: in another component, and not parted by bitmaps.

    A tile proposes a set drawn by hash, anew in every turn and tile, and to that set's own component another one.
    """
    group, place = Window.partitionBy("token", "band"), F.struct(F.xxhash64("sid", "token", F.lit(turn)).alias("place"), "sid", "component")
    rows = tiles.withColumn("c1", F.min(place).over(group))
    rows = rows.withColumn("c2", F.min(F.when(F.col("component") != F.col("c1.component"), place)).over(group))
    pick = F.when(F.col("component") != F.col("c1.component"), F.col("c1")).otherwise(F.col("c2"))
    met = rows.withColumn("other", pick["sid"]).where("other is not null").select("sid", "other").distinct()
    one = bitmaps.select("sid", F.col("n").alias("n1"), F.col("bitmap").alias("b1"))
    two = bitmaps.select(F.col("sid").alias("other"), F.col("n").alias("n2"), F.col("bitmap").alias("b2"))
    near = met.join(one, "sid").join(two, "other").select("sid", "other", "n1", "n2", "b1", "b2")
    near = near.mapInArrow(_distance_batches, "sid bigint, other bigint, share double")
    best = near.groupBy("sid").agg(F.min(F.struct("share", "other")).alias("best"))
    return best.select(F.least("sid", "best.other").alias("a"), F.greatest("sid", "best.other").alias("b")).distinct()


def _tile_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one tile in different components that bitmaps cannot part; rows come sorted by tile."""
    key, rows = None, []

    def pairs():
        """Each row meets the rows before it: of the other block, or of its own when the tile is one block."""
        if len(rows) < 2:
            return []
        found, (_, _, bi, bj) = {}, key
        rows.sort(key=lambda r: r[1])
        low = 0
        for i, (sid, n, component, block, guest, bitmap) in enumerate(rows):
            while DEN * rows[low][1] < NUM * n:  # too small for this row and all later ones
                low += 1
            for other, m, c, b, g, bits in rows[low:i]:
                if c != component and not (g and guest) and (b != block or bi == bj):
                    pair = (sid, other) if sid < other else (other, sid)
                    if pair not in found and (bitmap is None or may_link(n, m, bitmap, bits)):
                        found[pair] = None
        return list(found)

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    for batch in source:
        columns = [batch.column(k).to_pylist() for k in range(10)]
        for token, tile, bi, bj, *row in zip(*columns):
            if (token, tile, bi, bj) != key:
                if found := pairs():
                    yield batch_of(found)
                key, rows = (token, tile, bi, bj), []
            rows.append(row)
    if found := pairs():
        yield batch_of(found)


def _remaining_pairs(tiles: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Pairs of different components in one tile or in a tile and the next larger one, by bitmaps."""
    # A band's sets meet each other and, as guests, those of the next band.
    seats = F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(0).alias("guest")), F.struct((F.col("band") - 1).alias("tile"), F.lit(1).alias("guest"))))
    seated = tiles.withColumn("at", seats).select("token", "sid", "n", "component", "at.tile", "at.guest")
    group = ["token", "tile"]
    open_tiles = (
        seated.groupBy(*group)
        .agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("guest").alias("own"))
        .where("low != high and own = 0")
        .select(*group, "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    )
    seated = seated.join(open_tiles, group)
    keys, parts = ["token", "tile", "bi", "bj"], partitions_for(tiles.sparkSession)
    block = F.pmod(F.col("sid"), F.col("blocks")).cast("int")
    meets = F.expr("explode(transform(sequence(0, blocks - 1), j -> struct(least(block, j) as bi, greatest(block, j) as bj)))")
    large = seated.where(F.col("rows") >= SMALL).withColumn("block", block).withColumn("meets", meets).join(bitmaps.select("sid", "bitmap"), "sid")
    large = large.select("token", "tile", "meets.bi", "meets.bj", "sid", "n", "component", "block", "guest", "bitmap")
    large = large.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_tile_batches, "a bigint, b bigint").distinct()
    # Small tiles part with their few pairs first; a pair that meets in many tiles fetches its bitmaps once.
    zero = F.lit(0)
    small = seated.where(F.col("rows") < SMALL).select(
        "token", "tile", zero.alias("bi"), zero.alias("bj"), "sid", "n", "component", zero.alias("block"), "guest", F.lit(None).cast("binary").alias("bitmap")
    )
    small = small.repartition(parts, "token", "tile").sortWithinPartitions("token", "tile").mapInArrow(_tile_batches, "a bigint, b bigint").distinct()
    one = bitmaps.select(F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("bitmap").alias("b1"))
    two = bitmaps.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("bitmap").alias("b2"))
    near = small.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "b1", "b2").mapInArrow(_near_batches, "a bigint, b bigint")
    return large.union(near).distinct()


def ngram_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with n, sid; verified links between set names).

    The links connect every component of the exact join, but not every linked
    pair is among them: pairs that are already connected are not compared.
    """
    spark, texts = docs.sparkSession, _texts(docs)
    named = stored(texts.mapInArrow(_name_batches, "kind int, id bigint, n bigint, sid bigint, check bigint, bitmap binary"), "set-names")
    members = named.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "sid", "check")
    counts = named.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(FREQUENT).toArrow()
    frequent = np.array(counts.column("id"), np.int64).view(np.uint64)
    order = np.argsort(frequent)
    rank = np.array(counts.column("n"), np.int64)[order]
    texts = texts.where("doc_id is not null")
    tokens = texts.mapInArrow(_prefix_batches(frequent[order], rank), "token bigint, sid bigint, n int")
    tokens = tokens.repartition(partitions_for(spark), "token").sortWithinPartitions("token", "sid")
    band = F.floor(F.log(F.col("n")) / math.log(DEN / NUM) + 1e-9).cast("int")
    tiles = stored(tokens.mapInArrow(_shared_batches, "token bigint, sid bigint, n int").withColumn("band", band), "tiles")
    # Bitmaps are an 8th of a byte per shingle; whole sets are read for pairs that bitmaps cannot part.
    drawn = named.where("bitmap is not null").select("sid", "n", "bitmap").join(tiles.select("sid").distinct(), "sid", "left_semi")
    bitmaps = stored(drawn.dropDuplicates(["sid"]), "bitmaps")
    sets, links, labels = _Sets(texts, members), None, None
    groups = tiles.groupBy("token", "band").count().where(F.col("count") >= SMALL).select("token", "band")
    crowded = stored(tiles.join(groups, ["token", "band"]), "crowded")
    for k in range(STAR_ROUNDS + 1):
        # The first turn looks at all tiles, so that pairs of copies with many common tiles are settled at once.
        rows = _with_components(crowded if 0 < k < STAR_ROUNDS else tiles, labels)
        pairs = stored(_star_proposals(rows, bitmaps, k) if k < STAR_ROUNDS else _remaining_pairs(rows, bitmaps), "pairs")
        # Texts are read for the first turn and for the last, complete one; the turns between use the sets at hand.
        fresh = stored(verified(pairs, sets.known if 0 < k < STAR_ROUNDS else sets.of(pairs)), "links")
        links = fresh if links is None else links.union(fresh)
        if k < STAR_ROUNDS:
            labels = stored(connected(links), "labels")
    return members, links


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    members, links = ngram_links(docs)
    # Set classes become documents: each class is named by its smallest id, and an id with several texts joins their classes.
    filled = members.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("sid").agg(F.min("doc_id").alias("head"), F.min("check").alias("low"), F.max("check").alias("high"))
    head = F.when(F.col("low") == F.col("high"), F.col("head")).otherwise(F.raise_error(F.lit("two sets share a name")).cast("bigint"))
    classes = stored(classes.select("sid", head.alias("head")), "classes")
    between = (
        links.join(classes.select(F.col("sid").alias("a"), F.col("head").alias("head_a")), "a")
        .join(classes.select(F.col("sid").alias("b"), F.col("head").alias("head_b")), "b")
        .select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    )
    within = filled.join(classes, "sid").where("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    labels = connected(between.union(within))
    joined = members.join(labels, members["doc_id"] == labels["node"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component, all columns as they are: that of the smallest id, and of rows with one id the first by text.

    Only the ids that go, and those that repeat, are joined; both are few beside the texts.
    """
    labels = stored(ngram_components(docs).select("doc_id", "component_id"), "components")
    gone = stored(labels.where("component_id != doc_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    often = stored(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("often_id")).count().where("count > 1").select("often_id"), "often")
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    single = kept.join(often, kept["doc_id"] == often["often_id"], "left_anti")
    several = kept.join(often, kept["doc_id"] == often["often_id"], "left_semi").select(F.struct(*docs.columns).alias("body"))
    first = Window.partitionBy("body.doc_id").orderBy("body.text")
    several = several.withColumn("place", F.row_number().over(first)).where("place = 1").select(*[F.col(f"body.`{c}`").alias(c) for c in docs.columns])
    return single.unionByName(several)


def op1_ngram_join(spark: SparkSession, root: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"))


OP1_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least_of AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.x = d.doc_id
"""
