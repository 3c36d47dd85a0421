"""Near duplicates (operator 5): SetSketch registers, banded, estimated jointly, verified.

1. Each text's set of word shingles becomes a sketch of registers: truncated
   minima on an exponential scale.  Registers merge by minimum, so a long text
   is sketched in pieces.  Texts with equal sets are one class.
2. Registers are banded; classes that share a band meet in its bucket, a large
   one in blocks.  In a block, pairs are kept whose joint likelihood of the
   registers allows the threshold, and each tree of them is returned as links to
   its smallest member, never all pairs.  Where a large bucket is then not one
   tree, its other trees meet the largest one and each other.
3. Components of those are clusters.  Inside a cluster texts are compared on
   full sets, in blocks that return a forest of the links: first within blocks,
   then between the trees that result, and only where they do not grow together,
   every pair of blocks.
4. Components of the links are the groups of near duplicates.

A pair with the threshold's similarity is missed by all bands with a chance of
about 1e-6, and by the estimate with about 3e-6, unless other links join it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import Forest, Scope, connected_components, cut, groups, join_hot, mix, roots, slices, utf8
from leafwork.session import ship

BANDS, ROWS = 45, 6
REGISTERS = BANDS * ROWS
#: Ratio of neighbouring register values' scales, and the largest register value.
BASE, TOP = 1.1, 255
#: Members of a bucket, and of a cluster, that meet in one task: twice as many at most.
BUCKET_BLOCK, CLUSTER_BLOCK = 1024, 256
#: Shingles of a block's texts together, about; they are held by one task as 8 bytes each.
BLOCK_SHINGLES = 1 << 21
#: Words whose hashes a worker keeps, and the seed of the hash.
MOST_WORDS, SEED = 1 << 18, 20240501
#: Standard errors by which the estimate may fall short.
MARGIN = 4.5

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MIX = [np.uint64(x | 1) for x in _rng.integers(0, 1 << 63, 64, dtype=np.uint64).tolist()]


class WordHashes(dict):
    """64-bit hashes of words' bytes by a strong seeded function, kept for words that come again."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return h


_words = WordHashes()


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles; of all its words if it has fewer.

    Words are hashed by their bytes and shingles by a sum of words with odd factors, so
    two unlike shingles of a pair of sets with m shingles share a hash with a chance of
    m * m / 2**65: 3e-10 for a hundred thousand."""
    out = []
    with np.errstate(over="ignore"):
        for text in texts:
            words = text.lower().split()  # both are of ASCII alone for bytes
            n = len(words)
            w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
            if not n:
                out.append(np.empty(0, np.uint64))
                continue
            if n < k:
                s = np.array([n], np.uint64)
                for i in range(n):
                    s = mix(s * np.uint64(31) + w[i : i + 1])
            else:
                s = sum((w[i : n - k + 1 + i] * _MIX[i] for i in range(1, k)), w[: n - k + 1] * _MIX[0])
                s = np.unique(mix(s))
            out.append(s)
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes: for each register, the least of the set's
    uniform values, as an exponential variate, on a scale of powers of BASE."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            v = _A[:, None] * x[None, i : i + 2048]
            v += _B[:, None]
            np.minimum(least, v.min(axis=1), out=least)
    rate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(-np.log(rate) / np.log(BASE)) + 31, 0, TOP).astype(np.uint8)


def _sketch(k: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = utf8(batch.column(0))
            n, one, two, regs = [], [], [], []
            for a, b in slices(texts):
                for s in shingle_sets(texts[a:b], k):
                    n.append(len(s))
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    one.append((d >> 64) - (1 << 63))
                    two.append((d & (1 << 64) - 1) - (1 << 63))
                    regs.append(registers(s).tobytes() if len(s) else b"")
            new = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], "_nd_n", "_nd_one", "_nd_two", "_nd_regs"])

    return run


def _band_keys(batches):
    """(key, node) for each band of each sketch; a key holds the band's number and its registers as they are."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.int64)
        keys = np.tile(np.arange(BANDS, dtype=np.int64), (len(regs), 1))
        for i in range(ROWS):
            keys = keys * 256 + regs[:, :, i]
        node = np.repeat(np.asarray(batch.column(0)), BANDS)
        for i in range(0, len(node), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)[i : i + (1 << 17)]), pa.array(node[i : i + (1 << 17)])], names=["key", "node"])


def likely(plus: np.ndarray, minus: np.ndarray, same: np.ndarray, n1: np.ndarray, n2: np.ndarray, least: float) -> np.ndarray:
    """Whether the maximum-likelihood similarity of two sketches, given both
    sizes and in how many registers the first is larger, smaller or equal, is
    at least ``least``: whether the log-likelihood still rises there."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    log_b, c = np.log(BASE), (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 1e-9, 1) * c) / log_b

    def slope(x):
        return c / (1 - np.clip(x, 1e-9, 1) * c) / log_b

    up, down = u - v * least, v - u * least
    zero = np.clip(1 - p(up) - p(down), 1e-9, 1)
    rise = -plus * slope(up) * v / p(up) - minus * slope(down) * u / p(down) + same * (slope(up) * v + slope(down) * u) / zero
    return (rise >= 0) & (up > 0) & (down > 0)


def _near(threshold: float):
    """From rows (key, i, j, node, n, regs, tree) in order of key, i, j, node: (u, v)
    that link the trees of each block with a pair that may reach the threshold to
    the first of them.  Members of one tree are not compared."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches):
        import pyarrow as pa

        for gid, node, n, regs, tree in _buckets(batches):
            _, first, own = np.unique(np.stack((gid, tree)), axis=1, return_index=True, return_inverse=True)
            forest = Forest(len(node))
            forest.up = first[own.reshape(-1)]
            was = forest.up.copy()
            size = np.bincount(gid)
            for d in range(1, int(size.max())):
                forest.flatten()
                at = np.flatnonzero((gid[:-d] == gid[d:]) & (forest.up[:-d] != forest.up[d:]))
                at = at[np.minimum(n[at], n[at + d]) >= threshold * np.maximum(n[at], n[at + d])]
                for part in np.array_split(at, max(1, len(at) // 20000)):
                    if len(part):
                        a, b = regs[part], regs[part + d]
                        # a larger register is a smaller minimum
                        ok = part[likely((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), n[part], n[part + d], least)]
                        forest.join_all(ok, ok + d)
            forest.flatten()
            every = np.arange(len(node))
            at = np.flatnonzero((was == every) & (forest.up != every))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(tree[at]), pa.array(tree[forest.up[at]])], names=["u", "v"])

    return run


def _buckets(batches, most: int = 4096):
    """Joins small groups to runs of about ``most`` rows: (group, node, n, registers, tree)."""
    ids, held, count = [], [], 0

    def out():
        import pyarrow as pa

        t = pa.concat_tables(held)
        return np.concatenate(ids), np.asarray(t["node"]), np.asarray(t["n"]).astype(np.float64), np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint8).reshape(-1, REGISTERS), np.asarray(t["tree"])

    for t in groups(batches, 3):
        if t.num_rows < 2:
            continue
        ids.append(np.full(t.num_rows, len(held)))
        held.append(t)
        count += t.num_rows
        if count >= most:
            yield out()
            ids, held, count = [], [], 0
    if held:
        yield out()


def block_of(many: Column, node: str = "node") -> Column:
    """The block of a row of a group that is dealt to so many blocks."""
    return F.when(many <= 1, 0).otherwise(F.pmod(F.xxhash64(node), many)).cast("int")


def blocks(df: DataFrame, many: Column, node: str = "node") -> DataFrame:
    """Deals the rows of each group to pairs of its ``many`` blocks: adds i and j.  A
    row of block b goes to all pairs (i, j) with b in them, so each two rows meet."""
    df = df.withColumn("_m", many.cast("int")).withColumn("_b", block_of(F.col("_m"), node))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_m"), F.lit(1)) - 1)))
    return df.withColumn("i", F.least("_b", "_o")).withColumn("j", F.greatest("_b", "_o")).drop("_b", "_o", "_m")


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices(texts):
                found = shingle_sets(texts[a:b], k)
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array([s.tobytes() for s in found], pa.binary())], names=[*rest.schema.names[1:], "set"])

    return run


def _verify(percent: int):
    """From rows (cluster, i, j, node, set) in order: (u, v) that link the members of
    each tree of the texts whose sets reach the threshold, exactly, to its root."""

    def run(batches):
        import pyarrow as pa

        for t in groups(batches, 3):
            if t.num_rows < 2:
                continue
            node = np.asarray(t["node"])
            sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
            n = np.array([len(s) for s in sets])
            shared = _shared(sets) if len(sets) > 6 else np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets])
            up = roots(100 * shared >= percent * (n[:, None] + n[None, :] - shared))
            at = np.flatnonzero(node != node[up])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[up[at]])], names=["u", "v"])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over runs of the hashes that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = np.cumsum(counts > 1) - 1
    use = counts[column] > 1
    column, owner = dense[column[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], column[a:b] - first] = 1
        out += m @ m.T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: its columns except ``text``, n_shingles,
    component_id (the smallest id linked to it, itself included) and kept.

    Words are split at ASCII white space after A-Z are lower-cased.  Texts are
    linked if their sets of ``shingle``-word shingles have ``percent`` % or more
    of their union in common.

    Null or empty text: an empty set, linked with nothing.  Very long texts have
    one shingle set as any other; blocks hold fewer of them.  Null id: linked with
    nothing, component_id null, kept.  Ties: a share equal to ``percent`` is a link.  Rows that share an id are one document
    that has the links of each of its texts.  Copies are one class, so they
    cost one comparison.  Empty table: empty result.  Clashing columns of docs
    are replaced.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in {text, "n_shingles", "component_id", "kept"} and not c.startswith("_nd_")]
    if doc_id not in keep:
        raise ValueError(f"docs has no column {doc_id}")
    plain = docs.select(F.col(text).cast("string").alias("_nd_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    rows = cut(plain.mapInArrow(_sketch(shingle), f"{fields}, _nd_n long, _nd_one long, _nd_two long, _nd_regs binary"), "sketches")
    same = ["_nd_one", "_nd_two", "_nd_n"]
    own = F.col(doc_id).cast("long")
    known = rows.where(F.col(doc_id).isNotNull() & (F.col("_nd_n") > 0))
    classes = known.groupBy(*same).agg(F.min(own).alias("node"), F.count("*").alias("copies"), F.first("_nd_regs").alias("regs"))
    classes = cut(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    # what is written on the way to the clusters, and then to the groups, goes once they are there
    spark = docs.sparkSession
    with Scope(spark) as scope:
        keys = classes.select("node", "regs").mapInArrow(_band_keys, "key long, node long")
        full = cut(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "full-bands")
        filled = full.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        sized = join_hot(keys, full, ["key"], "size", filled, "node")
        near = _candidates(sized, classes.select("node", F.col("_nd_n").alias("n"), "regs"), percent / 100, full.where(F.col("size") > BUCKET_BLOCK).head(1))
        clusters = scope.keep(cut(connected_components(near), "clusters"))

    # rows that share an id but not a text are one document
    short = classes.select(*same, "node", "copies")
    with Scope(spark) as scope:
        links = _links(plain.select(F.col("_nd_text"), own.alias("node")), clusters, classes.select("node", F.col("_nd_n").alias("n")), shingle, percent)
        repeated = cut(known.groupBy(own.alias("_nd_id")).agg(F.count("*").alias("c")).where("c > 1"), "repeated")
        n = repeated.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        if n:
            twins = join_hot(known.select(own.alias("_nd_id"), *same), repeated, ["_nd_id"], "c", n, "_nd_one").drop("c")
            links = links.union(join_hot(twins, short, same, "copies", total, "_nd_id").select(F.col("_nd_id").alias("u"), F.col("node").alias("v")))
        groups_ = scope.keep(cut(connected_components(links.where("u <> v")), "groups"))

    # what a class has is joined to classes, and then to their rows, of which one class may have many
    short = short.join(groups_, "node", "left").select(*same, F.col("copies").alias("_nd_w"), F.coalesce("component", "node").alias("_nd_c"))
    out = join_hot(known, short, same, "_nd_w", total, own).select(*keep, F.col("_nd_n").alias("n_shingles"), F.col("_nd_c").alias("component_id"))
    rest = rows.where(F.col(doc_id).isNull() | (F.col("_nd_n") == 0)).select(*keep, F.col("_nd_n").alias("n_shingles"), own.alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("component_id") == own, F.lit(True)))


def _candidates(sized: DataFrame, sketches: DataFrame, threshold: float, large) -> DataFrame:
    """Links (u, v) between the nodes of buckets (key, node, size) that may reach the
    threshold, as many as join all that are candidates of each other.

    A bucket of up to BUCKET_BLOCK nodes is compared in one block.  A larger one is
    compared in blocks first; if all its nodes are then in one tree, by links of any
    bucket, it is done.  Else the nodes outside of its largest tree meet each other
    and those of that tree, all of them.  So the work of a bucket grows with its size
    times the number of its nodes outside of that tree, and one block."""

    def near(dealt: DataFrame) -> DataFrame:
        met = dealt.join(sketches, "node").select("key", "i", "j", "node", "n", "regs", "tree")
        return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_near(threshold), "u long, v long")

    own = sized.withColumn("i", block_of(F.ceil(F.col("size") / BUCKET_BLOCK))).withColumn("j", F.col("i"))
    found = near(own.withColumn("tree", F.col("node")))
    if not large:
        return found
    trees = connected_components(found).withColumnRenamed("component", "tree")
    found = trees.select(F.col("node").alias("u"), F.col("tree").alias("v"))
    rows = sized.where(F.col("size") > BUCKET_BLOCK).join(trees, "node", "left").select("key", "node", F.coalesce("tree", "node").alias("tree"))
    rows = cut(rows, "large-buckets")
    sizes = rows.groupBy("key", "tree").agg(F.count("*").alias("c")).groupBy("key")
    split = cut(sizes.agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("tree", "c").alias("main")).where("most < size"), "split-buckets")
    n = split.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not n:
        return found
    return found.union(near(_between(join_hot(rows, split, ["key"], "size", n, "node"))))


def _between(rows: DataFrame, block: int | None = None) -> DataFrame:
    """Deals rows (key, node, tree, size, most, main) to pairs of blocks (i, j), so that
    those outside of the tree ``main`` of their key, which has ``most`` of its ``size``
    rows, meet each other and all of that tree."""
    block = block or BUCKET_BLOCK
    inner, few, many = F.col("tree") == F.col("main"), F.ceil((F.col("size") - F.col("most")) / block), F.ceil(F.col("most") / block)
    rows = rows.withColumn("_b", F.when(inner, few + block_of(many)).otherwise(block_of(few)))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inner, few).otherwise(few + many) - 1)))
    return rows.withColumn("i", F.least("_b", "_o")).withColumn("j", F.greatest("_b", "_o")).drop("_b", "_o")


def _links(texts: DataFrame, clusters: DataFrame, sizes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """A forest (u, v) of the links of each cluster (node, component), exactly.

    A block has about CLUSTER_BLOCK texts, or fewer if they are long.  First the
    texts of each block are compared; clusters of one block are done.  Then one
    text of each tree so far is compared with those of other trees, as they are
    dealt to blocks anew.  Only in clusters that are still not one tree, all
    pairs of blocks are compared; so a tight cluster of any size costs two
    passes, and only a loose one the square of its size."""
    members = cut(clusters.join(sizes, "node"), "members")
    sums = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    sums = cut(sums.select("component", "size", _many("size", "shingles").alias("many")), "cluster-sizes")
    sized = join_hot(members, sums, ["component"], "size", members.count(), "node").select("node", "component", "n", "many")
    # the nodes grow with the data, so this is a merge join at any size and never a
    # broadcast; it is the one time that texts travel
    sets = texts.join(sized.hint("merge"), "node").select("_nd_text", "node", "component", "n", "many")
    sets = cut(sets.mapInArrow(_sets(shingle), "node long, component long, n long, many long, set binary").where("length(set) > 0"), "sets")
    own = lambda df, many: df.withColumn("i", block_of(F.col(many))).withColumn("j", F.col("i"))
    links = _verified(own(sets, "many"), percent)
    if not sums.where("many > 1").head(1):
        return links
    links = cut(links, "links")
    large = cut(sets.where("many > 1").select("node", "component", "n", "many").distinct(), "large")
    sets = sets.where("many > 1").select("node", "set")

    def trees(links: DataFrame) -> DataFrame:
        found = connected_components(links).withColumnRenamed("component", "tree")
        return large.join(found, "node", "left").withColumn("tree", F.coalesce("tree", "node"))

    heads = cut(trees(links).where("tree = node"), "heads")
    few = heads.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    few = cut(few.select("component", "size", _many("size", "shingles").alias("again")), "head-sizes")
    n = few.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not n:
        return links
    heads = join_hot(heads, few, ["component"], "size", n, "node")
    links = cut(links.union(_verified(sets.join(own(heads, "again"), "node"), percent)), "links")
    now = cut(trees(links), "trees")
    loose = now.groupBy("component").agg(F.count("*").alias("size"), F.min("tree").alias("a"), F.max("tree").alias("b")).where("a < b").select("component", "size")
    loose = cut(loose, "loose")
    n = loose.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not n:
        return links
    rest = join_hot(now, loose, ["component"], "size", n, "node").select("node", "component", "many")
    return links.union(_verified(blocks(sets.join(rest, "node"), F.col("many")), percent))


def _many(size: str, shingles: str) -> Column:
    """Blocks for so many texts with so many shingles."""
    return F.greatest(F.ceil(F.col(size) / CLUSTER_BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES))


def _verified(dealt: DataFrame, percent: int) -> DataFrame:
    """The forest of the links within each block (component, i, j) of sets."""
    meet = dealt.select("component", "i", "j", "node", "set")
    return meet.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_verify(percent), "u long, v long")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents, by its four-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")
