"""What the operators of this package share: materialised tables, byte-level
tokenisation with numpy, joins with hot keys, streamed groups and connected
components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.session import Scope, clean, cut, drop_table, read_cut, scratch_dir, write_cut  # noqa: F401  operators take them from here

#: The white space that separates words: tab to carriage return, and the space.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- byte tokens
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: white space, 1: word characters (letters, digits, bytes beyond ASCII), 2: other marks.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[48:58] = CLASSES[65:91] = CLASSES[97:123] = 1
CLASSES[128:] = 1
#: Words as white space separates them: every other byte is part of a word.
WORDS = np.where(CLASSES == 0, 0, 1).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def token_hashes(texts: list[bytes], classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one class in each text: (64-bit hash of the run with
    ASCII letters lower-cased, index of its text, class, start byte, end byte).

    The hash is a polynomial modulo 2**64 from prefix sums, then mixed, so the
    cost is a few vector operations a byte whatever the words are."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    cls = classes[buf]
    bounds = np.concatenate(([0], np.flatnonzero(cls[1:] != cls[:-1]) + 1, [len(buf)]))
    kind = cls[bounds[:-1]]
    at = np.flatnonzero(kind)
    start, end = bounds[at], bounds[at + 1]
    up, down = _power_table(len(buf))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(ends, start, "right"), kind[at], start, end


def slices(texts: list[bytes], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Splits a batch into runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((first, i))
            first, size = i, 0
        size += len(t) + 1
    return [*out, (first, len(texts))] if texts else out


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


# ----------------------------------------------------------------- skewed joins
#: Rows of a side that may be broadcast once they are counted.
MOST_SMALL = 200_000
#: A key with more rows than this, and than a ten-thousandth of all rows, is dealt to several tasks.
HOT = 1024


def join_small(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a side of narrow rows that is small as a rule: it is counted,
    and broadcast up to MOST_SMALL rows; beyond that, both sides are shuffled."""
    return rows.join(F.broadcast(side) if side.count() <= MOST_SMALL else side, keys, how)


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int, salt: str | Column, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row for each key and in ``weight`` how
    many rows have it at most; ``total`` is the sum of the weights.

    A hot key's rows are dealt to several tasks by the hash of ``salt``,
    and its row of side is sent to each.  Hot keys have more than
    max(HOT, total / 10000) rows, so there are at most 10000: they are broadcast."""
    most = max(HOT, total // 10_000)
    if total <= most:
        return rows.join(side, keys, how)
    many = F.ceil(F.col(weight) / most).cast("int")
    hot = side.where(F.col(weight) > most).select(*keys, many.alias("_jh_many"))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_jh_salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_jh_many")), F.lit(0)).cast("int")).drop("_jh_many")
    side = side.withColumn("_jh_salt", F.explode(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1)))
    return rows.join(side, [*keys, "_jh_salt"], how).drop("_jh_salt")


# ------------------------------------------------------------ streamed groups
def groups(batches, keys: int):
    """From Arrow batches sorted by their first ``keys`` columns: one table for
    each group.  A group may span batches; only one group is held at a time."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of booleans, the smallest row of its component."""
    up = np.arange(len(linked))
    while True:
        least = np.minimum(up, np.where(linked, up[None, :], len(up)).min(1, initial=len(up)))
        # the root of a component learns what any of its members met
        np.minimum.at(least, up, least.copy())
        while (least[least] != least).any():
            least = least[least]
        if (least == up).all():
            return up
        up = least


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join_all(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins a[i] with b[i]; returns the pairs that joined two trees."""
        made = []
        self.flatten()
        far = self.up[a] != self.up[b]
        for x, y in zip(a[far].tolist(), b[far].tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                made.append((x, y))
        return made

    def flatten(self) -> None:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return
            self.up = up


# ------------------------------------------------------- connected components
def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The components of an undirected graph: (node, component), where the
    component is its smallest node.  edges: columns u and v (long, not null).
    Nodes without an edge to another node do not appear.

    Alternates large-star and small-star steps until every component is a star
    around its smallest node.  Each is one aggregate that Spark combines before its
    shuffle and one equi-join that deals the edges of a hub to several tasks, so neither
    needs all of them in one, and neither makes more rows than there are edges.  The
    edges of each step are written to the shared checkpoint folder, so that its join
    runs once; only counts reach the driver.  Whether all are stars is one aggregate,
    so a graph of stars costs no join."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    path = write_cut(now, "edges")
    like = now
    for _ in range(most_rounds):
        e = read_cut(spark, path, like)
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select("v", F.lit(0)))
        # in stars, a node has one edge to a smaller one, or only edges to larger ones
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
        n, open_ = ends.agg(F.coalesce(F.sum("all"), F.lit(0)), F.count_if((F.col("up") > 0) & (F.col("all") > 1))).first()
        if not open_:
            break
        large = _star(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), True, n)
        both = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        half = write_cut(both, "stars")
        small = _star(read_cut(spark, half, like), False, n).distinct()
        new = write_cut(small, "edges")
        drop_table(spark, path)
        drop_table(spark, half)
        path = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    e = read_cut(spark, path, like)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _star(e: DataFrame, large: bool, total: int) -> DataFrame:
    """For each node u of (u, v), of ``total`` rows at most: m is the smallest of u
    and its neighbours v.  The large star links each larger neighbour to m, the
    small star each smaller one and u itself."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_w")).select("u", F.least("u", "m").alias("m"), "_w")
    met = join_hot(e.where("v > u" if large else "v < u"), least, ["u"], "_w", total, "v")
    rest = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest if large else rest.union(least.where("u <> m").select("u", F.col("m").alias("v")))


# ------------------------------------------------------------------ CRC in SQL
#: The CRC of each byte, as one list t of the relation ``crcs``.
SQL_CRC_TABLE = """byte AS (SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)),
crcs AS (SELECT list(c ORDER BY b) AS t FROM byte)"""


def sql_crc(text: str) -> str:
    """The CRC of a string in SQL, where the relation ``crcs`` holds the table t."""
    nibbles = f"list_transform(range(1, 2 * strlen({text}) + 1, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {nibbles}), lambda c, b: xor(c >> 8, t[xor(c & 255, b)::INT + 1])), 4294967295::UBIGINT)"
