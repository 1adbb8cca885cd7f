"""Exact Jaccard self-join of word shingle sets through signature trees.

1. Documents of equal shingle sets form a class; everything below is about classes.
2. A class lies in the buckets of its prefix: the first n - ceil(0.8 n) + 1 shingles in one
   global order, rare ones first. Two sets of similarity 0.8 share a prefix shingle.
3. Within a bucket, sorted by the share of uncommon shingles, each class is compared with
   the one before and the first. What links is exact, and it joins a group of near copies
   into few components without touching all pairs of the group.
4. Buckets that still hold several components go to signature trees. A leaf is a class with
   its bitmap of shingles, a node has the OR of its bitmaps and its range of sizes. A dual
   traversal drops a pair of nodes if sizes, components or the largest possible overlap
   rule out a link; what is left is verified on the whole sets.

Nothing of the corpus reaches the driver: the order uses a table of ``2**18`` counters over
all shingles of all documents, and sets are looked up through a bitmap of fixed size. Large
buckets are cut into blocks that meet pairwise in separate tasks.

Sets and classes are 64-bit hashes; two classes share one by chance about once in 10**19
pairs. Defined cases: a null, empty or blank text has no shingle and links with nothing; a
text of fewer than five words is one shingle; rows of equal id are one node; rows with a
null id link with nothing and have a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.llm.components import components
from utterlab.llm.membership import member_filter, slot, unpacked
from utterlab.llm.registry import query
from utterlab.llm.shared import written
from utterlab.llm.words import U64, pieces, shingle_sets, words

SHINGLE = 5
_COUNTER_BITS = 18
_HOT = 200_000
_BLOCK = 5_000
_FAN = 8


def needed(size: int) -> int:
    """Smallest overlap of a set of this size with any set it links with (4 / 5)."""
    return -(-4 * size // 5)


def linked(common: int, a: int, b: int) -> bool:
    return 9 * common >= 4 * (a + b)


def _class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in pieces(batch, "text"):
            yield part, shingle_sets(words(part.column("text")), SHINGLE)


def _bitmap(shingles: np.ndarray) -> bytes:
    """Four bits or more per shingle, a power of two of at least 256."""
    width = max(256, 1 << int(4 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[shingles & U64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


# --- passes over the texts ---------------------------------------------------------------


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary()),
            ],
            ["id", "n", "class", "bitmap"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << _COUNTER_BITS, np.int64)
    for _, sets in _sets(batches):
        for s in sets:
            total += np.bincount(
                (s >> U64(64 - _COUNTER_BITS)).astype(np.int64), minlength=1 << _COUNTER_BITS
            ) if len(s) > 20_000 else 0
            if len(s) <= 20_000:
                np.add.at(total, (s >> U64(64 - _COUNTER_BITS)).astype(np.int64), 1)
    width = 1 << (_COUNTER_BITS - 6)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(range(64), pa.int32()),
            pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(64)], pa.binary()),
        ],
        ["block", "counts"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(raw, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        ["block", "counts"],
    )


def _order(texts: DataFrame) -> np.ndarray:
    """Counters over all shingles: a table of fixed size, summed block by block."""
    parts = texts.mapInArrow(_count, "block int, counts binary").repartition(8, "block")
    rows = parts.mapInArrow(_add, "block int, counts binary").collect()
    out = np.zeros(1 << _COUNTER_BITS, np.int64)
    width = 1 << (_COUNTER_BITS - 6)
    for r in rows:
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r.counts, np.int64)
    return out


def _prefixes(counters: np.ndarray):
    excess = np.maximum(0, counters - 2 * int(counters.mean()))
    parts = (1 + excess // _HOT).astype(np.int64)
    rank = np.minimum(counters, 2**31 - 1).astype(np.int64)
    common = counters > counters.mean() + 6 * np.sqrt(counters.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in sets:
                name = _class_of(s) if len(s) else None
                if name is None or name in seen:  # copies within a task end here
                    continue
                seen.add(name)
                if len(seen) > 1_000_000:
                    seen.clear()
                cell = (s >> U64(64 - _COUNTER_BITS)).astype(np.int64)
                take = len(s) - needed(len(s)) + 1
                first = np.argsort(rank[cell], kind="stable")[:take]  # ties by hash
                split = parts[cell[first]]
                salt = np.where(split > 1, abs(name) % split, -1)
                rest = int(1000 * (~common[cell]).mean())
                fixed = (np.full(take, x) for x in (rest, len(s), name))
                for column, value in zip(out, (s[first].view(np.int64), salt, *fixed), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out],
                ["token", "salt", "rest", "n", "class"],
            )

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with several classes, with the class before and the first class.

    Reads (token, salt, rest, n, class) in this order; holds one row back. ``rest`` is the
    share of uncommon shingles, so the first class of a group of near copies is the one
    with the fewest edits, which links with every class that links at all, as a rule.
    """
    held: np.ndarray | None = None
    before: np.ndarray | None = None
    top: np.ndarray | None = None

    def emit(rows: np.ndarray, after: np.ndarray | None) -> pa.RecordBatch:
        nonlocal before, top
        same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        joins = before is not None and bool((rows[0, :2] == before[:2]).all())
        tail = after is not None and bool((rows[-1, :2] == after[:2]).all())
        down, up = np.append(joins, same), np.append(same, tail)
        keep = down | up | (rows[:, 1] >= 0)
        prev = np.concatenate(([before if joins else rows[0]], rows[:-1]))
        # the first row of each bucket; the bucket at hand may have begun earlier
        begin = np.where(down, 0, np.arange(len(rows)))
        first = rows[np.maximum.accumulate(begin)]
        if joins:
            first[: len(rows) if down.all() else int(np.argmin(down))] = top
        before, top = rows[-1], first[-1]

        def near(other: np.ndarray) -> np.ndarray:
            low, high = np.minimum(other[:, 3], rows[:, 3]), np.maximum(other[:, 3], rows[:, 3])
            return down & (5 * low >= 4 * high)

        columns = [pa.array(rows[keep, i]) for i in (0, 4, 3)]
        for other in (prev, first):
            columns.append(pa.array(other[keep, 4], pa.int64(), mask=~near(other)[keep]))
        return pa.RecordBatch.from_arrays(columns, ["token", "class", "n", "prev", "first"])

    for batch in batches:
        new = np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int64)
        rows = new if held is None else np.concatenate([held, new])
        # a class may reach a bucket from several tasks
        fresh = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        rows = rows[fresh]
        if len(rows) > 1:
            yield emit(rows[:-1], rows[-1])
        held = rows[-1:] if len(rows) else held
    if held is not None:
        yield emit(held, None)


# --- verification ------------------------------------------------------------------------


def _verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) pairs of classes that link, by their whole sets."""
    pairs = written(pairs, "candidates")
    names = pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).distinct()
    bits = member_filter(names)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        wanted = unpacked(bits)
        for _, sets in _sets(batches):
            names, raws = [], []
            for s in sets:
                if len(s):
                    name = _class_of(s)
                    if wanted[slot(np.array([name]))[0]] and name not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(name)
                        names.append(name)
                        raws.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(raws, pa.binary())], ["class", "shingles"]
            )

    loaded = texts.mapInArrow(load, "class long, shingles binary")
    sets = written(loaded.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(linked(common, len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, v: sets.select(F.col("class").alias(c), F.col("shingles").alias(v))
    both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")
    return written(both.mapInArrow(check, "a long, b long"), "links")


# --- signature trees ---------------------------------------------------------------------


class Node:
    """Leaves have no children; a node covers sizes low to high."""

    __slots__ = ("bits", "width", "low", "high", "slack", "group", "block", "name", "children")

    def __init__(self, bits, width, low, high, slack, group, block, name=None, children=()):
        self.bits, self.width, self.low, self.high = bits, width, low, high
        self.slack, self.group, self.block = slack, group, block
        self.name, self.children = name, children


def fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def leaf(name: int, n: int, group: int, block: int, raw: bytes) -> Node:
    bits = int.from_bytes(raw, "little")
    return Node(bits, len(raw) * 8, n, n, n - bits.bit_count(), group, block, name)


def tree(leaves: list[Node]) -> Node:
    """Leaves in order of size, ``_FAN`` children to a node."""
    level = sorted(leaves, key=lambda x: (x.low, x.name))
    while len(level) > 1:
        level = [_parent(level[i : i + _FAN]) for i in range(0, len(level), _FAN)]
    return level[0]


def _parent(nodes: list[Node]) -> Node:
    width = min(x.width for x in nodes)
    bits, slack = 0, 0
    for x in nodes:
        small = fold(x.bits, x.width, width)
        bits |= small
        # shingles that a narrower bitmap may hide
        slack = max(slack, x.slack + x.bits.bit_count() - small.bit_count())
    groups, blocks = {x.group for x in nodes}, {x.block for x in nodes}
    return Node(
        bits, width, min(x.low for x in nodes), max(x.high for x in nodes), slack,
        groups.pop() if len(groups) == 1 else None,
        blocks.pop() if len(blocks) == 1 else None,
        None, nodes,
    )


def may_link(a: Node, b: Node) -> bool:
    """False only if no leaf of ``a`` links with a leaf of another group in ``b``."""
    if 5 * a.high < 4 * b.low or 5 * b.high < 4 * a.low:
        return False
    if a.group is not None and a.group == b.group:
        return False
    width = min(a.width, b.width)
    x, y = fold(a.bits, a.width, width), fold(b.bits, b.width, width)
    both = (x & y).bit_count()
    if a.children or b.children:
        # a leaf's shingles beyond its bits are its slack; shared bits bound the rest
        room = both + min(_hidden(a, x), _hidden(b, y))
        return 9 * room >= 4 * (a.low + b.low)
    room = min(a.low - x.bit_count() + both, b.low - y.bit_count() + both)
    return linked(room, a.low, b.low)


def _hidden(node: Node, folded: int) -> int:
    """Most shingles of one leaf that share a bit with others, at the folded width."""
    return node.slack + node.bits.bit_count() - folded.bit_count()


def candidates(root: Node, crossing: bool) -> Iterator[tuple[int, int]]:
    """Leaf pairs that may link; with ``crossing`` only pairs of different blocks."""
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if a is b:
            kids = a.children
            stack.extend((kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids)))
            continue
        if crossing and a.block is not None and a.block == b.block:
            continue
        if not may_link(a, b):
            continue
        if a.children and (not b.children or a.high - a.low >= b.high - b.low):
            stack.extend((k, b) for k in a.children)
        elif b.children:
            stack.extend((a, k) for k in b.children)
        else:
            yield (a.name, b.name) if a.name < b.name else (b.name, a.name)


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of (token, low, high, block, class, n, group, bitmap) rows, sorted."""
    seen: set[int] = set()
    out: list[tuple[int, int]] = []
    key, leaves = None, []

    def close() -> None:
        if len(leaves) > 1:
            for pair in candidates(tree(leaves), key[1] != key[2]):
                name = pair[0] << 64 ^ pair[1]
                if name not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    out.append(pair)

    def drain() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"]
        )
        out.clear()
        return batch

    for batch in batches:
        for r in batch.to_pylist():
            this = (r["token"], r["low"], r["high"])
            if this != key:
                close()
                key, leaves = this, []
            leaves.append(leaf(r["class"], r["n"], r["group"], r["block"], r["bitmap"]))
        yield drain()
    close()
    yield drain()


def _tree_pairs(buckets: DataFrame, groups: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Candidates between components that meet in a bucket."""
    tagged = (
        buckets.join(groups, buckets["class"] == groups["node"], "left")
        .select("token", "class", "n", F.coalesce("component", "class").alias("group"))
    )
    # Shingles of one shared passage fill the same bucket many times: one of them is enough.
    mixed = (
        tagged.groupBy("token")
        .agg(
            F.min("group").alias("g1"),
            F.max("group").alias("g2"),
            F.count(F.lit(1)).alias("c"),
            F.bit_xor(F.xxhash64("class")).alias("m1"),
            F.bit_xor(F.xxhash64("class", F.lit(1))).alias("m2"),
        )
        .where("g1 <> g2")
        .groupBy("c", "m1", "m2")
        .agg(F.min("token").alias("token"), F.min("g1").alias("family"))
        .select("token", "family", F.ceil(F.col("c") / _BLOCK).cast("long").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = (
        tagged.join(mixed, "token")
        .withColumn("block", block)
        .withColumn("other", other)
        .select(
            "token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            "block", "class", "n", "group", "family",
        )
        .join(bitmaps, "class")
        .select("token", "low", "high", "block", "class", "n", "group", "bitmap", "family")
    )
    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Buckets with the same smallest component hold much the same classes: one task sees
    # them all and gives each pair once.
    return (
        rows.repartition(parts, "family", "low", "high")
        .sortWithinPartitions("family", "low", "high", "token")
        .drop("family")
        .mapInArrow(_traverse, "a long, b long")
        .distinct()
    )


# --- the join ----------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, class, component_id) per document, components over document ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = written(
        texts.mapInArrow(_describe, "id long, n long, class long, bitmap binary"), "described"
    )
    classes = written(
        described.where("class IS NOT NULL AND id IS NOT NULL")
        .groupBy("class")
        .agg(F.min("id").alias("first")),
        "classes",
    )
    bitmaps = described.join(
        classes.select("class", F.col("first").alias("id")), ["class", "id"]
    ).select("class", "bitmap")
    prefixes = texts.where("id IS NOT NULL").mapInArrow(
        _prefixes(_order(texts)), "token long, salt long, rest long, n long, class long"
    )
    buckets = written(
        prefixes.repartition(parts, "token", "salt")
        .sortWithinPartitions("token", "salt", "rest", "n", "class")
        .mapInArrow(_neighbours, "token long, class long, n long, prev long, first long"),
        "buckets",
    )
    # pairs that meet in a good part of their prefix; the rest is left to the trees
    met = F.explode(F.array_distinct(F.array("prev", "first"))).alias("other")
    near = (
        buckets.where("prev IS NOT NULL OR first IS NOT NULL")
        .select("class", "n", met)
        .where("other IS NOT NULL AND other <> class")
        .groupBy(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))
        .agg(F.count(F.lit(1)).alias("met"), F.min("n").alias("n"))
        .where("met >= greatest(1, n / 40)")
        .select("a", "b")
    )
    close = _verify(texts, near)
    groups = components(close)
    later = _verify(texts, _tree_pairs(buckets, groups, bitmaps))
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = stars.unionAll(later)
    return _label(described, classes, links, id_col)


def _label(described: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    member = described.where("class IS NOT NULL AND id IS NOT NULL").select("id", "class")
    # an id with several texts joins their classes
    several = (
        member.groupBy("id")
        .agg(F.min("class").alias("a"), F.max("class").alias("z"))
        .where("a <> z")
        .select("id", "a")
    )
    shared = member.join(several, "id").select("a", F.col("class").alias("b"))
    joined = components(links.unionAll(shared))
    named = classes.join(joined, classes["class"] == joined["node"], "left").select(
        "class", F.coalesce("component", "class").alias("group"), "first"
    )
    lowest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    by_class = named.join(lowest, "group").select("class", "component_id")
    # copies of one text: the class side is repeated per salt
    salts = 8
    salted = described.select("id", "n", "class").withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    )
    spread = by_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = salted.join(spread, ["class", "salt"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "class",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )


JACCARD_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS tok FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.tok = y.tok AND x.doc_id < y.doc_id
  GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE r(doc_id, c) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
  ) SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1
)
SELECT n.doc_id, n.n AS n_shingles, r.component_id FROM n JOIN r USING (doc_id)
"""


@query("op2_ngram_jaccard_join", JACCARD_SQL)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are near copies of each other?"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
