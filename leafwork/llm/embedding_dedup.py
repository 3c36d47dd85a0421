"""Embedding near-duplicates (operator 8): random-hyperplane signs in several
tables, exact cosine in double precision, distributed components.

1. Equal vectors are one class, so copies cost one comparison.
2. Each class gets a sketch of SKETCH signs and a bucket in each of several
   tables.  The number of signs of a bucket follows the number of vectors, so
   buckets keep a size of about BUCKET; the number of tables follows from the
   threshold, so that a pair at it is missed by all tables with a chance of MISS
   at any size of the data.  Only sketches travel to the buckets, not vectors.
   There, pairs whose sketches differ in few enough signs for the threshold are
   candidates; a bucket returns a forest of them, never the pairs.  A bucket beyond
   BLOCK vectors is compared in blocks first; only if its vectors are then not in one
   tree, those outside of its largest tree meet each other and that tree.
3. Components of the candidates are clusters.  Each vector of a cluster of two
   or more is fetched once; clusters beyond LEAST_BLOCK vectors are dealt to pairs of
   blocks, of up to BLOCK vectors.  All pairs of a cluster are compared exactly; a block returns how many
   links each vector has and a forest of them.
4. Components of the links are the groups of near duplicates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import Scope, connected_components, cut, groups, join_hot, join_small, roots
from leafwork.llm.near_dedup import _between, block_of, blocks
from leafwork.session import ship

BUCKET, BLOCK, MISS = 256, 1024, 1e-6
#: A cluster has blocks of so many vectors until it has BLOCKS of them, which then grow up to BLOCK.
LEAST_BLOCK, BLOCKS = 128, 8
#: Signs of a sketch, and standard deviations by which two sketches at the threshold may differ more than on average.
SKETCH, MARGIN = 512, 5.2


def layout(n: int, threshold: float) -> tuple[int, int]:
    """(signs a table, tables) for n different vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 2) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def most_differing(threshold: float) -> int:
    """In how many signs two sketches may differ, so that a pair at the threshold is missed with a chance of 1e-7."""
    p = math.acos(threshold) / math.pi
    return math.floor(SKETCH * p + MARGIN * math.sqrt(SKETCH * p * (1 - p)))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([dim, bits, tables]).standard_normal((dim, max(SKETCH, bits * tables)))


def _tables(bits: int, tables: int, sketched: bool | None):
    """(t, bucket, node, sketch) for each table of each class (node, vector), without
    sketch unless ``sketched``; if that is None, (node, sketch) of each class."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(1)
            flat, at = np.asarray(col.flatten()), np.asarray(col.offsets) - col.offsets[0].as_py()
            dims, node = np.diff(at), np.asarray(batch.column(0))
            for dim in np.unique(dims):
                every, planes = np.flatnonzero(dims == dim), _planes(int(dim), bits, tables)
                for rows in np.array_split(every, max(1, len(every) // 1024)):
                    x = flat[at[rows][:, None] + np.arange(dim)].astype(np.float64)
                    signs = x / np.abs(x).max(1, keepdims=True) @ planes > 0
                    times, new = 1 if sketched is None else tables, {}
                    if sketched is not None:
                        keys = (signs[:, : bits * tables].reshape(len(rows), tables, bits) * (1 << np.arange(bits))).sum(2).astype(np.int64)
                        new = {"t": pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), "bucket": pa.array((keys | int(dim) << 32).reshape(-1))}
                    new["node"] = pa.array(np.repeat(node[rows], times))
                    if sketched is not False:
                        packed = np.repeat(np.packbits(signs[:, :SKETCH], axis=1), times, axis=0)
                        sketches = pa.Array.from_buffers(pa.binary(SKETCH // 8), len(packed), [None, pa.py_buffer(packed.tobytes())])
                        new["sketch"] = sketches.cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(list(new.values()), names=list(new))

    return run


def _candidates(most: int):
    """From rows (t, bucket, i, j, node, sketch, tree) in order: (u, v) that link the
    trees of each group that have candidates to the first of them."""

    def run(batches):
        import pyarrow as pa

        for t in groups(batches, 4):
            if t.num_rows < 2:
                continue
            node = np.asarray(t["node"])
            bits = np.unpackbits(np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(node), -1), axis=1)
            x = bits.astype(np.float32) * 2 - 1
            tree = np.asarray(t["tree"])
            up = roots((x @ x.T >= SKETCH - 2 * most) | (tree[:, None] == tree[None, :]))
            pairs = np.unique(np.stack((tree, tree[up])), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return run


def _compare(threshold: float, kind: str):
    """From rows (component, i, j, b, node, copies, vector) in order: for each group
    (node, links, root), where root links the members of a tree of the group."""

    def run(batches):
        import pyarrow as pa

        for t in groups(batches, 3):
            if t.num_rows < 2:
                continue
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            node, copies, b = (np.asarray(t[c]) for c in ("node", "copies", "b"))
            rows = [np.frombuffer(v, kind) for v in t["vector"].to_pylist()]
            links, up = np.zeros(len(node), np.int64), np.arange(len(node))
            linked = np.zeros((len(node), len(node)), bool)
            for dim in {len(v) for v in rows}:  # those of another length have no link
                own = np.array([k for k, v in enumerate(rows) if len(v) == dim])
                x = np.stack([rows[k] for k in own]).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                linked[np.ix_(own, own)] = x @ x.T >= threshold
            linked &= node[:, None] != node[None, :]
            if i != j:  # two members of one block meet where that block meets itself
                linked &= b[:, None] != b[None, :]
            links = (linked * copies[None, :]).sum(1)
            up = roots(linked)
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at].astype(np.int64)), pa.array(node[up[at]])], names=["node", "links", "root"])

    return run


def _vectors(batches):
    """Arrays of numbers as bytes: the last column of each batch."""
    import pyarrow as pa

    for batch in batches:
        col = batch.column(batch.num_columns - 1)
        flat, at = np.asarray(col.flatten()), np.asarray(col.offsets) - col.offsets[0].as_py() if batch.num_rows else np.zeros(1, int)
        found = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=batch.schema.names)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row for each row of vectors: its columns except ``embedding``,
    n_links (other rows with a cosine of ``threshold`` or more), component_id
    (smallest id reachable by links, itself included) and kept.

    Vectors that are null, empty, all zero or hold null or non-finite
    components have no link.  Vectors of different length have none with each
    other.  Null id: no link, component_id null, kept.  Ties: a cosine equal to
    the threshold is a link.  Repeated rows are rows of their own that link with
    each other; rows that share an id but not a vector have the links of each.
    Empty table: empty result.  Clashing columns are replaced."""
    ship(vectors.sparkSession)
    keep = [c for c in vectors.columns if c not in {embedding, "n_links", "component_id", "kept"} and not c.startswith("_ed_")]
    element = vectors.schema[embedding].dataType.elementType.simpleString()
    kind = "float" if element == "float" else "double"
    v = F.col(embedding).cast(f"array<{kind}>")
    valid = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    own = F.col(vec_id).cast("long")
    rows = vectors.select(*keep, F.when(valid & F.col(vec_id).isNotNull(), v).alias("_ed_v"))
    # 128 bits of a vector stand for it where only its class is sought
    same = ["_ed_one", "_ed_two"]
    digest = [F.xxhash64(F.lit(i), "_ed_v").alias(n) for i, n in enumerate(same)]
    classes = rows.where("_ed_v is not null").groupBy("_ed_v").agg(F.min(own).alias("node"), F.count("*").alias("copies"))
    classes = cut(classes.select("node", "copies", *digest, "_ed_v"), "vectors")
    different, total = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bits, tables = layout(different, threshold)

    with Scope(vectors.sparkSession) as scope:
        clusters = scope.keep(cut(connected_components(_near(classes.select("node", "_ed_v"), bits, tables, threshold)), "clusters"))

    sizes = cut(clusters.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    clustered = clusters.count()
    many = F.least(F.ceil(F.col("size") / LEAST_BLOCK), F.greatest(F.lit(BLOCKS), F.ceil(F.col("size") / BLOCK)))
    sized = join_hot(clusters, sizes, ["component"], "size", clustered, "node").withColumn("many", many.cast("long"))
    members = classes.select("node", "copies", "_ed_v").join(sized.select("node", "component", "many"), "node").select("node", "component", "many", "copies", F.col("_ed_v").alias("vector"))
    members = members.mapInArrow(_vectors, "node long, component long, many long, copies long, vector binary")
    pairs = blocks(members.withColumn("b", block_of(F.col("many"))), F.col("many")).select("component", "i", "j", "b", "node", "copies", "vector")
    found = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_compare(threshold, "f4" if kind == "float" else "f8"), "node long, links long, root long")
    found = cut(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # rows that share an id but not a vector are one node of the graph
    known = rows.where("_ed_v is not null").select(*keep, own.alias("_ed_id"), *digest)
    repeated = cut(known.groupBy("_ed_id").agg(F.count("*").alias("c")).where("c > 1"), "repeated")
    n = repeated.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    short = classes.select("node", "copies", *same)
    edges = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if n:
        twins = join_hot(known.select("_ed_id", *same), repeated, ["_ed_id"], "c", n, "_ed_one").drop("c")
        edges = edges.union(join_hot(twins, short, same, "copies", total, "_ed_id").select(F.col("_ed_id").alias("u"), F.col("node").alias("v")))
    components = connected_components(edges.where("u <> v"))

    # what a class has is joined to classes, and then to their rows, of which one class may have many
    short = short.join(links, "node", "left").join(components, "node", "left")
    short = short.select(*same, F.col("copies").alias("_ed_w"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_ed_n"), F.coalesce("component", "node").alias("_ed_c"))
    out = join_hot(known, short, same, "_ed_w", total, "_ed_id").select(*keep, F.col("_ed_n").cast("long").alias("n_links"), F.col("_ed_c").alias("component_id"))
    rest = rows.where("_ed_v is null").select(*keep, F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("component_id") == own, F.lit(True)))


def _near(vectors: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """Links (u, v) between the nodes of vectors (node, vector) that may reach the
    threshold, as many as join all that are candidates of each other.

    The work of a bucket grows with its size times the number of its nodes outside of
    its largest tree, and one block."""
    keys = cut(vectors.mapInArrow(_tables(bits, tables, False), "t int, bucket long, node long"), "buckets")
    spread = vectors.mapInArrow(_tables(bits, tables, True), "t int, bucket long, node long, sketch binary")
    large = cut(keys.groupBy("t", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "large-buckets")

    def near(dealt: DataFrame) -> DataFrame:
        met = dealt.select("t", "bucket", "i", "j", "node", "sketch", "tree").repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j")
        return met.mapInArrow(_candidates(most_differing(threshold)), "u long, v long")

    met = join_small(spread, large, ["t", "bucket"], "left")
    own = met.withColumn("i", block_of(F.ceil(F.coalesce("size", F.lit(1)) / BLOCK))).withColumn("j", F.col("i"))
    found = near(own.withColumn("tree", F.col("node")))
    total = large.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return found
    trees = cut(connected_components(found), "trees").withColumnRenamed("component", "tree")
    found = trees.select(F.col("node").alias("u"), F.col("tree").alias("v"))
    rows = join_hot(keys, large, ["t", "bucket"], "size", total, "node").drop("size")
    rows = cut(rows.join(trees, "node", "left").select("t", "bucket", "node", F.coalesce("tree", "node").alias("tree")), "trees-of-buckets")
    per = rows.groupBy("t", "bucket", "tree").agg(F.count("*").alias("c")).groupBy("t", "bucket")
    split = cut(per.agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("tree", "c").alias("main")).where("most < size"), "split-buckets")
    n = split.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not n:
        return found
    again = join_hot(rows, split, ["t", "bucket"], "size", n, "node")
    sketches = vectors.mapInArrow(_tables(bits, tables, None), "node long, sketch binary")
    return found.union(near(_between(again, BLOCK).join(sketches, "node")))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")
