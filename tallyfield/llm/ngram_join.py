"""N-gram Jaccard join: count vectors of hashed shingles, indexed as points, bounded by summed minima.

Every text is its set of distinct word shingles.  Shingles are hashed into groups and the group counts
form a point.  If ``|A n B| >= t |A u B|`` then ``A`` and ``B`` differ in at most ``D = a (1 - t) / t``
shingles, ``a`` being the smaller size, so among ``D + 1`` blocks of groups one holds equal counts.
A size class and one block's equal counts name a *cell*: cells route points over the cluster without
forming a pair, and each open cell holds an R-tree of its points (packed nodes with per-coordinate
maxima).  ``sum(min(p, q))`` over the coordinates of two nodes or two points bounds the shared shingles
from above; a second vector, of many more groups and their counts' parities, bounds them again by the
least number of differing shingles.  Pairs that both bounds let through are verified on the exact sets.

Exactness.  Blocks of one shingle name no cell (a frequent shingle would be a cell of its own).  That a
true pair then meets in no cell needs its few differing shingles to fall one by one into every other
block; classes of few blocks use several independent partitions into blocks, ``PARTITIONS`` over the
number of blocks, so that the odds stay below about 1e-9 for a pair just at the threshold, in the range
of the odds that two shingles share a 64-bit hash.  Classes with D <= 2 use the whole set and all sets
less one shingle; a set that may hold another and two shingles more gives all sets less two shingles
besides (351 at most), which is exact.

Large groups.  Of equal sets in one task only the first has keys and a point, however many there are; met
keys of other tasks' copies take their node's number, so equal sets are one node of a cell.  In a cell only one point, the most
central, is joined to the others (a linear star); what proves to be linked is contracted, cells with
more than one component left get a star from a point outside their main component, and so on while
that settles a quarter of what is open.  Only points that are still outside a cell's main component
are then compared, in blocks, with the cell's points, bounds first: clusters that link are gone by
then, and what both bounds let through is close to the threshold.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.common import WordHashes, as_bytes, components, distinct_sorted, mix, remove, rowwise, shared_dir, shingle_hashes, stash

GROUPS = 128  # coordinates of the point used for the bound
NODE = 32  # points in a node of a cell's R-tree
LEFT = 512  # points of one block of a cell's query set
SEEN = 300_000  # digests a task remembers; when it has so many it begins anew
PARTITIONS = 52  # blocks that all partitions of a class have together, at least


@functools.lru_cache
def size_classes() -> tuple[int, ...]:
    """Least size of each class; a class spans a factor of 1.5."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(at[-1] * 3 // 2 + 1)
    return tuple(at)


def class_of(n: int) -> int:
    return int(np.searchsorted(size_classes(), n, "right")) - 1


def cell_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The cells of a set of shingle hashes, for links of at least ``percent`` of the union."""
    n, at, out = len(s), size_classes(), []
    if n == 0:
        return np.zeros(0, np.uint64)
    for c in range(class_of(-(-percent * n // 100)), class_of(n) + 1):
        most = (at[c + 1] - 1) * (100 - percent) // percent
        if most == 0:
            continue
        tag = np.uint64(c << 40)
        if most <= 2:
            whole = mix(s ^ np.uint64(0x5BD1E995))
            total = whole.sum(dtype=np.uint64)
            sums = [[total], total - whole]
            if most == 2 and 100 * (n - 2) >= percent * n and class_of(n - 2) == c:  # all of a smaller set and two more
                i, j = np.triu_indices(n, 1)
                sums.append(total - whole[i] - whole[j])
            out.append(mix(np.concatenate(sums) ^ tag))
            continue
        m = most + 1
        for rep in range(-(-PARTITIONS // m)):
            x = mix(s + np.uint64((rep + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            block = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            block = block[order]
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            filled = np.diff(np.append(starts, n)) >= 2
            # a random linear hash of the block's group counts: equal counts, equal hash
            counts = np.add.reduceat(mix(x ^ np.uint64(0xD6E8FEB86659FD93))[order], starts)
            out.append(mix(counts[filled] ^ mix((block[starts][filled].astype(np.uint64) << np.uint64(8)) + tag + np.uint64(rep + 1))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


SIGNED = "doc_id long, n long, digest binary, keys array<long>, point binary, odd binary"


def point(s: np.ndarray) -> np.ndarray:
    """Group counts; a set too large for one byte a group gets the point that is never pruned."""
    v = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=GROUPS)
    return (v if v.max(initial=0) < 255 else np.full(GROUPS, 255)).astype(np.uint8)


def parities(s: np.ndarray) -> np.ndarray:
    """Parities of the counts of at least four groups a shingle (a power of two), eight to a byte."""
    groups = max(1024, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) & 1
    return np.packbits(odd.astype(np.uint8))


def differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Lower bound of the differing shingles of a set and several; the longer vectors are folded."""
    width = min(one.shape[-1], many.shape[-1])
    one = np.bitwise_xor.reduce(one.reshape(-1, width), axis=0)
    many = np.bitwise_xor.reduce(many.reshape(len(many), -1, width), axis=1)
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


def shared_at_least(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (na + nb) // (100 + percent))


def minima(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Upper bound of shared shingles; points of 255s bound nothing."""
    m = np.minimum(p, q).sum(axis=-1, dtype=np.int64)
    return np.where((p == 255).all(axis=-1) | (q == 255).all(axis=-1), np.int64(1) << 50, m)


def _signatures(k: int, percent: int, batches):
    """Rows of SIGNED; a set that the task has met before has neither keys nor a point."""
    hashes, seen = WordHashes(), set()
    for batch in batches:
        for part in rowwise(batch):
            n, digest, keys, points, odd = [], [], [], [], []
            for text in as_bytes(part.column("text")):
                s = distinct_sorted(shingle_hashes(hashes.of(text.lower().split()), k))
                n.append(len(s))
                digest.append(digest_of(s))
                again = digest[-1] in seen
                if not again:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest[-1])
                keys.append((cell_keys(s, percent) if not again else s[:0]).view(np.int64))
                points.append(None if again else point(s).tobytes())
                odd.append(None if again else parities(s).tobytes())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))), pa.array(points, pa.binary()), pa.array(odd, pa.binary())],
                names=["doc_id", "n", "digest", "keys", "point", "odd"],
            )


def _met(batches):
    """Rows sorted by key and id -> the rows whose key another id has too, once.  Holds one row between batches."""
    held = None  # key, id, whether it is known to be met
    for batch in batches:
        key, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        first = False
        if held:
            key, at, first = np.append(held[0], key), np.append(held[1], at), held[2]
        new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))
        key, at = key[new], at[new]
        same = key[1:] == key[:-1]
        met = np.append(False, same) | np.append(same, False)
        met[0] |= first
        held = (key[-1], at[-1], bool(met[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][met[:-1]]), pa.array(at[:-1][met[:-1]])], names=["key", "id"])
    if held and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["key", "id"])


def _bounded(percent: int, batches):
    for batch in batches:
        for part in rowwise(batch, 4096):
            p, q = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("pa", "pb"))
            na, nb = (part.column(c).to_numpy() for c in ("na", "nb"))
            need = shared_at_least(na, nb, percent)
            keep = minima(p, q) >= need
            odd = [[np.frombuffer(x, np.uint8) for x in part.column(c).to_pylist()] for c in ("oa", "ob")]
            for i in np.flatnonzero(keep):
                keep[i] = na[i] + nb[i] - differing(odd[0][i], odd[1][i][None])[0] >= 2 * need[i]
            yield part.select(["a", "b"]).filter(pa.array(keep))


def _verified(percent: int, batches):
    for batch in batches:
        for part in rowwise(batch):
            keep = []
            for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def digest_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(k: int, batches):
    hashes = WordHashes()
    for batch in batches:
        for part in rowwise(batch):
            sets = [distinct_sorted(shingle_hashes(hashes.of(t.lower().split()), k)) for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])


class Tree:
    """Points packed into nodes by size and leading counts; a node keeps its coordinates' maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, odd: list[bytes]):
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.order, self.points, self.sizes, self.labels = order, points[order], sizes[order], labels[order]
        at = np.arange(0, len(order), NODE)
        self.high, self.least, self.most = np.maximum.reduceat(self.points, at), np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at)
        # parity vectors, by their width
        odd = [odd[i] for i in order]
        self.width = np.array([len(x) for x in odd])
        self.row = np.zeros(len(odd), np.int64)
        self.odd = {}
        for w in set(self.width.tolist()):
            mine = np.flatnonzero(self.width == w)
            self.row[mine] = np.arange(len(mine))
            self.odd[w] = np.frombuffer(b"".join([odd[i] for i in mine]), np.uint8).reshape(-1, w)

    def near(self, p: np.ndarray, n: int, label: int, odd: bytes, percent: int) -> np.ndarray:
        """Places of the points of another component that the bounds cannot rule out."""
        need = shared_at_least(np.maximum(self.least, -(-percent * n // 100)), np.int64(n), percent)
        nodes = (self.most * 100 >= percent * n) & (self.least * percent <= 100 * n) & (minima(self.high, p) >= need)
        at = (np.flatnonzero(nodes)[:, None] * NODE + np.arange(NODE)).ravel()
        at = at[at < len(self.order)]
        at = at[self.labels[at] != label]
        at = at[minima(self.points[at], p) >= shared_at_least(self.sizes[at], np.int64(n), percent)]
        mine, keep = np.frombuffer(odd, np.uint8), np.zeros(len(at), bool)
        for w, rows in self.odd.items():
            these = np.flatnonzero(self.width[at] == w)
            if len(these):
                sizes = self.sizes[at[these]]
                keep[these] = sizes + n - differing(mine, rows[self.row[at[these]]]) >= 2 * shared_at_least(sizes, np.int64(n), percent)
        return self.order[at[keep]]


def _searched(percent: int, batches):
    """Rows sorted by (key, left block): each block of a cell's query set against the cell's tree."""

    def search(rows):
        at, n, label, query, p, odd = (np.concatenate(x) for x in zip(*rows, strict=True))
        if not query.any():
            return
        a, b = [], []
        # one copy of each query: the block's own queries; all other rows are the cell
        tree = Tree(p[~query], n[~query], label[~query], odd[~query].tolist())
        inside = at[~query]
        for i in np.flatnonzero(query):
            found = inside[tree.near(p[i], int(n[i]), label[i], odd[i], percent)]
            a.append(np.minimum(found, at[i]))
            b.append(np.maximum(found, at[i]))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pairs = np.unique(np.stack((a, b), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block, at, n, label, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "id", "n", "label", "query"))
        p = np.frombuffer(b"".join(batch.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS)
        odd = np.fromiter(batch.column("odd").to_pylist(), object, batch.num_rows)
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
            now = (key[lo], block[lo])
            if now != held or sum(len(r[0]) for r in rows) > 1 << 16:
                if rows:
                    yield from search(rows)
                # a very large cell is searched part by part: its queries stay (they sort first)
                rows = [tuple(x[r[3]] for x in r) for r in rows if r[3].any()] if now == held else []
                held = now
            rows.append((at[lo:hi], n[lo:hi], label[lo:hi], query[lo:hi].astype(bool), p[lo:hi], odd[lo:hi]))
    if rows:
        yield from search(rows)


def jaccard_links(docs: DataFrame, k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between different shingle sets and what stands for each document.

    ``docs`` needs doc_id (long) and text.  Returns (base, links, labels): base has doc_id, n (set
    size) and node (a number of the set, null for an empty one); links has pairs a < b of nodes found
    on the way, enough to connect every component; labels gives each linked node the least node of
    its component.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = stash(texts.mapInArrow(functools.partial(_signatures, k, percent), SIGNED).withColumn("at", F.monotonically_increasing_id()))
    nodes = stash(base.where("digest is not null").groupBy("digest").agg(F.min("at").alias("node")))
    keyed = base.where("size(keys) > 0").select(F.explode("keys").alias("key"), F.col("at").alias("id"))
    # copies in other tasks have the same keys: after the keys that one task's rows alone have are gone, they become their node
    copies = base.where("size(keys) > 0").join(nodes, "digest").where("at <> node").select(F.col("at").alias("id"), "node")
    met = _dealt(keyed).join(copies, "id", "left").select("key", F.coalesce("node", "id").alias("id"))
    cells = stash(_dealt(met))
    # only those in a cell are asked for; they are dealt out once, all rounds of bounds read them as they lie
    points, drop = _by_id(base.where("size(keys) > 0").select(F.col("at").alias("id"), "n", "point", "odd"))
    try:
        links, labels = _linked(texts, base, cells, points, k, percent)
    finally:
        drop()
    return base.join(nodes, "digest", "left").select("doc_id", "n", "node"), links, labels


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows (key, id) whose key another id has too, each once."""
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_met, "key long, id long")


def _by_id(rows: DataFrame):
    """``rows`` as a table in buckets by id in the shared folder, and what removes it: joins by id don't shuffle it."""
    spark = rows.sparkSession
    name, n = f"ngram_points_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    rows.repartition(n, "id").write.bucketBy(n, "id").sortBy("id").option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)

    return spark.table(name), drop


def _linked(texts: DataFrame, base: DataFrame, cells: DataFrame, points: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between the nodes of the cells, enough to connect every component, and the linked nodes' labels."""

    # the most central point of each cell: the one that meets most others over all its cells
    sized = cells.join(cells.groupBy("key").agg(F.count("*").alias("k")), "key")
    central = stash(sized.groupBy("id").agg(F.sum("k").alias("met")))

    # stars from the centres, then from points outside each cell's main component; what was a star's
    # centre has met its whole cell and leaves it
    links, labels, rest = None, None, None
    told = cells.withColumn("label", F.col("id"))
    while True:
        hubs = told.where("label <> main") if labels is not None else told
        hubs = hubs.join(central, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("low"), "label")).alias("hub")).select("key", (-F.col("hub.low")).alias("hub"), F.col("hub.label").alias("of"))
        met = told.join(hubs, "key")
        star = met.where("label <> of").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        new = _verify(texts, base, stash(_likely(star, points, percent)), k, percent)
        found = bool(new.limit(1).count())
        links = new if links is None else links.unionByName(new)
        if labels is None or found:
            labels = components(links)
        left = met.where("id <> hub").select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        by = left.groupBy("key", "label").agg(F.count("*").alias("k"))
        main = by.groupBy("key").agg(F.max(F.struct("k", "label")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("all")).where("parts > 1")
        told = stash(left.join(main.select("key", F.col("main.label").alias("main"), (F.col("all") - F.col("main.k")).alias("rest")), "key"))
        before, rest = rest, told.where("label <> main").count()
        if not rest or not found or before is not None and 4 * rest > 3 * before:
            break
    if not rest:
        return links, labels

    # what is left: points outside the main component, in blocks, against their cell
    open_ = told.join(points.hint("merge"), "id").withColumn("blocks", F.ceil(F.col("rest") / LEFT).cast("int"))
    cell = open_.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(False))
    asked = open_.where("label <> main").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("query", F.lit(True))
    cols = ["key", "block", "id", "n", "label", "query", "point", "odd"]
    rows = cell.select(cols).unionByName(asked.select(cols))
    more = rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("query"), "id").mapInArrow(functools.partial(_searched, percent), "a long, b long").distinct()
    second = _verify(texts, base, stash(more), k, percent)
    links = links.unionByName(second)
    if second.limit(1).count():
        labels = components(links)
    return links, labels


def _likely(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs that both bounds let through."""
    pa_, pb_ = (points.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
    return pairs.join(pa_.hint("merge"), "a").join(pb_.hint("merge"), "b").mapInArrow(functools.partial(_bounded, percent), "a long, b long")


def _verify(texts: DataFrame, base: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of nodes whose exact sets are alike enough."""
    if not pairs.limit(1).count():
        return pairs
    asked = pairs.select(F.col("a").alias("at")).union(pairs.select("b")).distinct()
    # a node's text is read again by its doc_id and told apart by its set's digest
    one = stash(base.join(asked, "at", "left_semi").select(F.col("at").alias("id"), "doc_id", "digest"))
    wanted = texts.join(one.select("doc_id").distinct(), "doc_id", "left_semi")
    if one.where("doc_id is null").limit(1).count():
        wanted = wanted.unionByName(texts.where("doc_id is null"))
    # one set a digest, where they are dealt by digest anyway
    made = wanted.mapInArrow(functools.partial(_sets, k), "digest binary, shingles binary").where("digest is not null").dropDuplicates(["digest"])
    sets = stash(made.join(one.select("digest", "id"), "digest").select("id", "shingles"))
    sa, sb = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return stash(pairs.join(sa, "a").join(sb, "b").mapInArrow(functools.partial(_verified, percent), "a long, b long"))


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Lower-cases A-Z only; words are runs of anything but space, tab, LF, VT, FF, CR.  Fewer than
    ``k`` words make one shingle of the whole sequence; no words (null or blank text) make an empty
    set linked with nothing, so such a row is its own component.  Rows that repeat a doc_id are linked
    by their own texts; a null doc_id takes part, and its component is that of its text's links, or
    null.  Only doc_id and text are read, so further columns of any name do no harm.
    """
    base, _, labels = jaccard_links(docs, k, percent)
    named = base.join(labels.withColumnRenamed("id", "node"), "node", "left").select("doc_id", "n", F.coalesce("label", "node").alias("of"))
    least = named.where("of is not null").groupBy("of").agg(F.min("doc_id").alias("least"))
    return named.join(least, "of", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
