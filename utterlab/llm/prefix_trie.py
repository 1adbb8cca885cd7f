"""Conversation prefix trie: what sharing equal beginnings of conversations would save.

Every distinct sequence of the first d turns (role, text) of a conversation is a node of
depth d under a textless root; conversations that begin with it are its members.

A turn becomes a 64-bit id and a word count in the row, so texts never leave the scan. One
shuffle gathers the turns of a conversation, a range shuffle and a sort bring equal beginnings
side by side. Tasks read a shard of that order in chunks of bounded size: a chunk is a matrix of
turn ids, one row per conversation, padded behind its last turn. ``lexsort`` orders it, a column
where a row differs from the one before is a change, changes OR-accumulated over the columns
mark where the nodes of every depth start, and ``reduceat`` aggregates all nodes of a depth.

Every figure of a node adds up over its rows, given how many turns a row shares with the row
before and the row after: a row adds a child at each depth it no longer shares, a leaf if the
next row does not extend it, and the tokens of the turns it shares, which are saved. So nodes on
the first and last path of a chunk, which may reach into its neighbours, are returned as partial
rows and summed by key. Only what lies at a shard's edges is unknown to its task: two rows per
shard are compared afterwards, and corrections for one path each join the sums.

Conversation ids of a node's ends are hashed in the chunk, or, where they run past it, by a
sorted stream over (node, id) in constant memory; a SHA-256 has one state, so one task hashes
the ids of one node.

Defined cases: null role or text is empty; rows of a null conversation id are ignored; rows of
equal turn stand in order of a hash of role and text, null turns first, and a repeated row is a
turn of its own; conversations without turns after the rebuilding belong to the root; an empty
table gives no rows; further columns are ignored. A conversation is one row of two longs a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlab.llm.registry import query
from utterlab.llm.shared import written
from utterlab.llm.words import PRIME, U64, mix

CELLS = 1 << 20
_OUT = 1 << 13
_SALTS = 16
_EMPTY = hashlib.sha256(b"").hexdigest()


# --- conversations -----------------------------------------------------------------------


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv, base, ids, toks): turn ids and word counts of every conversation in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tok"),
    )
    conv = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(
        conv.alias("conv"), (conv - conv % 20).alias("base"), turn.alias("t")
    )
    # dealt by base, so that grouping and the look at the base need no other shuffle
    whole = rows.repartition("base").groupBy("base", "conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select(
        "conv", "base",
        F.transform("t", lambda x: x["id"]).alias("ids"),
        F.transform("t", lambda x: x["tok"]).alias("toks"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, ids, toks) after the first crc32(id) mod 4 turns came from the base conversation."""
    own = sequences(conversations)
    at_base = F.when(
        F.col("conv") == F.col("base"),
        F.struct(F.slice("ids", 1, 3).alias("ids"), F.slice("toks", 1, 3).alias("toks")),
    )
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")
    tagged = own.withColumn("h", h).withColumn(
        "head", F.max(at_base).over(Window.partitionBy("base"))
    )

    def spliced(name: str) -> Column:
        head = F.coalesce(F.slice(F.col("head")[name], F.lit(1), F.col("h")), F.array().cast("array<bigint>"))
        return F.concat(head, F.slice(F.col(name), F.col("h") + 1, F.greatest(F.size(name), F.lit(1))))

    return tagged.select("conv", spliced("ids").alias("ids"), spliced("toks").alias("toks"))


# --- chunks ------------------------------------------------------------------------------

_NODE = (
    "key long, depth long, parent long, conv long, parent_conv long, n_convs long, "
    "n_children long, n_leaves long, saved long, ends string, edge boolean"
)
_SCHEMA = f"kind string, shard int, {_NODE}, first array<long>, first_toks array<long>, last array<long>"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]
_TYPES = {
    "kind": pa.string(), "shard": pa.int32(), "ends": pa.string(), "edge": pa.bool_(),
    "first": pa.list_(pa.int64()), "first_toks": pa.list_(pa.int64()), "last": pa.list_(pa.int64()),
}


def _rows(**columns: object) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())  # type: ignore[arg-type]
    arrays = []
    for name in _NAMES:
        kind = _TYPES.get(name, pa.int64())
        value = columns.get(name)
        arrays.append(pa.nulls(n, kind) if value is None else pa.array(value, kind, from_pandas=False))
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _node_rows(made: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    whole = {k: np.concatenate([m[k] for m in made]) for k in made[0]}
    hidden = whole.pop("hidden")
    whole["parent_conv"] = pa.array(whole["parent_conv"], pa.int64(), mask=hidden)
    whole["ends"] = whole["ends"].tolist()
    return _rows(kind=["node"] * len(hidden), **whole)


def shared_length(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading turns that two sequences have in common."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def prefix_keys(ids: np.ndarray) -> np.ndarray:
    """Keys of the prefixes of 0, 1, ... turns; ``ids`` has one row per conversation."""
    out = np.zeros((ids.shape[0], ids.shape[1] + 1), np.uint64)
    out[:, 0] = mix(np.array([1], np.uint64))[0]
    for d in range(ids.shape[1]):
        out[:, d + 1] = mix((out[:, d] + U64(d + 1)) * PRIME ^ ids[:, d].view(np.uint64))
    return out.view(np.int64)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


class _Chunk:
    """Rows of one chunk as padded matrices, ordered by their turns and ids."""

    def __init__(self, conv: np.ndarray, ids: list[np.ndarray], toks: list[np.ndarray]):
        length = np.array([len(x) for x in ids], np.int64)
        width = int(length.max(initial=0))
        inside = np.arange(width) < length[:, None]
        matrix, words = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
        if width:
            matrix[inside], words[inside] = np.concatenate(ids), np.concatenate(toks)
        # codes keep the order of the ids; zero pads, so a prefix comes before what extends it
        code = np.zeros((len(ids), width), np.int32)
        code[inside] = np.unique(matrix[inside], return_inverse=True)[1] + 1
        order = np.lexsort((conv, *(code[:, d] for d in range(width - 1, -1, -1))))
        self.conv, self.length, self.ids, self.code = conv[order], length[order], matrix[order], code[order]
        self.upto = np.zeros((len(ids), width + 1), np.int64)
        np.cumsum(words[order], axis=1, out=self.upto[:, 1:])
        self.width = width

    def row(self, i: int) -> np.ndarray:
        return self.ids[i, : self.length[i]]

    def nodes(self, before: int, after: int) -> Iterator[pa.RecordBatch]:
        """Nodes of the chunk, whose first row shares ``before`` turns with the row ahead
        (-1: none) and whose last row shares ``after`` with the next one; and the ids of ends
        that may run past the chunk."""
        n, length = len(self.conv), self.length
        change = np.zeros((n, self.width + 1), bool)
        change[1:, 1:] = self.code[1:] != self.code[:-1]
        change[0] = True
        change = np.logical_or.accumulate(change, axis=1)
        same = np.where(change.any(axis=1), change.argmax(axis=1) - 1, length)
        same[0] = before
        same = np.minimum(same, length)
        follow = np.append(same[1:], after)
        leaf = (follow < length).astype(np.int64)
        saved_at = self.upto[np.arange(n), np.maximum(same, 0)]
        keys = prefix_keys(self.ids)
        digest, open_ = self._ends(same, follow)
        if open_.any():
            i = np.flatnonzero(open_)
            yield _rows(kind=["end"] * len(i), key=keys[i, length[i]], depth=length[i], conv=self.conv[i])
        up, made, held = None, [], 0
        for d in range(self.width + 1):
            starts = np.flatnonzero(change[:, d])
            node = length[starts] >= d
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            reach = same >= d
            spent = self.upto[:, d - 1] if d else np.zeros(n, np.int64)
            smallest = np.minimum.reduceat(self.conv, starts)
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            above = group_above[starts] if up is not None else None
            columns = {
                "key": keys[starts, d],
                "depth": np.full(len(starts), d),
                "parent": keys[starts, d - 1] if d else np.zeros(len(starts), np.int64),
                "conv": smallest,
                "parent_conv": smallest if up is None else up[0][above],
                "n_convs": np.diff(np.append(starts, n)),
                "n_children": np.add.reduceat(((same <= d) & (length > d)).astype(np.int64), starts),
                "n_leaves": np.add.reduceat(leaf, starts),
                "saved": np.add.reduceat(np.where(reach, saved_at - spent, 0), starts),
                "edge": edge,
            }
            # the parent's smallest member is known unless the parent is an edge itself
            hidden = np.ones(len(starts), bool) if up is None else up[1][above]
            up, group_above = (smallest, edge), group
            # a node's ends are its first rows; none here may still be some in the next chunk
            ends = np.array([None if e else _EMPTY for e in edge.tolist()], object)
            own = np.flatnonzero(length[starts] == d)
            ends[own] = [digest.get(r) for r in starts[own].tolist()]
            made.append({k: v[node] for k, v in (columns | {"ends": ends, "hidden": hidden}).items()})
            held += int(node.sum())
            if held > _OUT or d == self.width:
                yield _node_rows(made)
                made, held = [], 0

    def _ends(self, same: np.ndarray, follow: np.ndarray) -> tuple[dict[int, str], np.ndarray]:
        """Digest of every run of equal rows by its first row; flags of the rows of runs that
        touch the chunk's edge, which have none."""
        n = len(self.conv)
        equal = np.zeros(n, bool)
        equal[1:] = (self.code[1:] == self.code[:-1]).all(axis=1)
        starts = np.flatnonzero(~equal)
        stops = np.append(starts[1:], n)
        open_ = np.zeros(n, bool)
        open_[: stops[0]] = True
        open_[starts[-1] :] = True
        digest = {
            a: hashlib.sha256(",".join(map(str, self.conv[a:b].tolist())).encode()).hexdigest()
            for a, b in zip(starts[1:-1].tolist(), stops[1:-1].tolist(), strict=True)
        }
        return digest, open_


def _shard_nodes(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()  # type: ignore[union-attr]
        waiting: _Chunk | None = None
        first: tuple | None = None
        before = -1
        for conv, ids, toks in _chunks(batches, cells):
            chunk = _Chunk(conv, ids, toks)
            if waiting is None:
                first = (chunk.row(0).copy(), np.diff(chunk.upto[0, : chunk.length[0] + 1]))
            else:
                meets = shared_length(waiting.row(-1), chunk.row(0))
                yield from waiting.nodes(before, meets)
                before = meets
            waiting = chunk
        if waiting is not None and first is not None:
            yield from waiting.nodes(before, -1)
            yield _rows(
                kind=["edge"], shard=[shard], first=[first[0]], first_toks=[first[1]], last=[waiting.row(-1)]
            )

    return run


def _chunks(
    batches: Iterator[pa.RecordBatch], cells: int
) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Consecutive rows whose padded matrix has at most ``cells`` cells, or one row."""
    conv: list[int] = []
    ids: list[np.ndarray] = []
    toks: list[np.ndarray] = []
    width = 1
    for batch in batches:
        values, at = _flat(batch.column(1))
        words, _ = _flat(batch.column(2))
        for i, c in enumerate(batch.column(0).to_pylist()):
            a, b = at[i], at[i + 1]
            wider = max(width, b - a)
            if conv and wider * (len(conv) + 1) > cells:
                yield np.array(conv, np.int64), ids, toks
                conv, ids, toks, wider = [], [], [], max(1, b - a)
            width = wider
            conv.append(c)
            ids.append(values[a:b])
            toks.append(words[a:b])
    if conv:
        yield np.array(conv, np.int64), ids, toks


# --- recombination -----------------------------------------------------------------------


def _corrections(edges: DataFrame) -> DataFrame:
    """Partial rows that mend what a shard could not know: how many turns its first row shares
    with the last row of the shard before, and whether the shard after extends its last row."""
    order = Window.orderBy("shard")  # one row per shard
    met = edges.select(
        "shard", "first", "first_toks", "last",
        F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first, last = (np.array(r[k], np.int64) for k in ("first", "last"))
                if r["before"] is not None:
                    m = shared_length(first, np.array(r["before"], np.int64))
                    upto = np.cumsum([0, *r["first_toks"]])
                    spent = np.concatenate(([0], upto[:m]))
                    yield _mend(first, m + 1, saved=upto[m] - spent, n_children=_fewer(m))
                if r["after"] is not None:
                    after = np.array(r["after"], np.int64)
                    if shared_length(last, after) == len(last):
                        yield _mend(last, len(last) + 1, n_leaves=np.full(len(last) + 1, -1))

    return met.mapInArrow(run, _NODE)


def _fewer(m: int) -> np.ndarray:
    """The first row was counted as a child above depth ``m``, where it is none."""
    return np.append(np.full(m, -1), 0)


def _mend(ids: np.ndarray, n: int, **figures: np.ndarray) -> pa.RecordBatch:
    keys = prefix_keys(ids[None, :])[0]
    zero = np.zeros(n, np.int64)
    columns = {"key": keys[:n], "depth": np.arange(n), "parent": np.append(zero[:1], keys[: n - 1])}
    columns |= {k: zero for k in ("n_convs", "n_children", "n_leaves", "saved")} | figures
    names = [f.split()[0] for f in _NODE.split(", ")]
    made = _rows(edge=[True] * n, **columns)
    return pa.RecordBatch.from_arrays([made.column(k) for k in names], names)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(key, depth, digest) of the ends in their order, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, hashlib.sha256(), []
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(3)]
            change = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [batch.num_rows]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                node = (int(columns[0][a]), int(columns[1][a]))
                text = ",".join(map(str, columns[2][a:b].tolist()))
                if node == now:
                    state.update(f",{text}".encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(text.encode())
            if len(done) > 10_000:
                yield _digest_rows(done)
                done = []
        if now is not None:
            yield _digest_rows([*done, (*now, state.hexdigest())])

    return (
        ends.repartition("key", "depth")
        .sortWithinPartitions("key", "depth", "conv")
        .mapInArrow(run, "key long, depth long, digest string")
    )


def _digest_rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    keys, depths, digests = zip(*done, strict=True)
    arrays = [pa.array(keys, pa.int64()), pa.array(depths, pa.int64()), pa.array(digests)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "depth", "digest"])


def trie(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """The nodes of (conv, ids, toks): one row per distinct prefix."""
    ordered = rows.select("conv", "ids", "toks").repartitionByRange("ids", "conv")
    ordered = ordered.sortWithinPartitions("ids")
    made = written(ordered.mapInArrow(_shard_nodes(cells), _SCHEMA), "trie-parts")
    names = [f.split()[0] for f in _NODE.split(", ")]
    nodes = made.where("kind = 'node'").select(*names)
    whole = nodes.where("NOT edge")
    partial = nodes.where("edge").unionByName(_corrections(made.where("kind = 'edge'")))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    firsts = [F.max("parent").alias("parent"), F.min("conv").alias("conv"), F.max("ends").alias("ends")]
    digests = _end_digests(made.where("kind = 'end'").select("key", "depth", "conv"))
    summed = partial.groupBy("key", "depth").agg(*firsts, *sums)
    edge = written(
        summed.join(digests, ["key", "depth"], "left")
        .withColumn("ends", F.coalesce("digest", "ends", F.lit(_EMPTY)))
        .drop("digest"),
        "trie-edges",
    )
    both = whole.select(*edge.columns, "parent_conv").unionByName(
        edge.withColumn("parent_conv", F.lit(None).cast("long"))
    )
    known = both.where("parent_conv IS NOT NULL OR depth = 0")
    # children of one node may be a third of all: parents are repeated per salt
    salt = F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int")
    above = edge.select(
        F.col("key").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("above"),
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"),
    )
    found = (
        both.where("parent_conv IS NULL AND depth > 0")
        .withColumn("salt", salt)
        .join(above, ["parent", "depth", "salt"])
        .withColumn("parent_conv", F.col("above"))
    )
    columns = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    return known.select(*columns).unionByName(found.select(*columns))


def prefix_trie(conversations: DataFrame, cells: int = CELLS) -> DataFrame:
    """Nodes of the rebuilt conversations, named by (conv_id, depth)."""
    return trie(rebuilt(conversations), cells).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


TRIE_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS v FROM ids
), h AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc),
o AS (
  SELECT conv_id AS c, to_json([coalesce(role, ''), coalesce(text, '')])::VARCHAR AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tok,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), b AS (
  SELECT h.c, o.i, o.t, o.tok FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.i <= h.h
  UNION ALL SELECT h.c, o.i, o.t, o.tok FROM h JOIN o ON o.c = h.c AND o.i > h.h
), s AS (SELECT c, t, tok, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM b),
n AS (SELECT h.c, count(s.c) AS len FROM h LEFT JOIN s USING (c) GROUP BY 1),
p AS (
  SELECT c, 0::BIGINT AS d, '' AS k, '' AS up, 0::BIGINT AS tok FROM n
  UNION ALL SELECT p.c, p.d + 1, sha256(p.k || s.t), p.k, s.tok FROM p JOIN s ON s.c = p.c AND s.d = p.d + 1
), v AS (
  SELECT d, k, any_value(up) AS up, any_value(tok) AS tok, min(p.c) AS conv, count(*) AS m,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE n.len = p.d), '')) AS ends
  FROM p JOIN n USING (c) GROUP BY 1, 2
), e AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM v WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT v.*, coalesce(e.kids, 0) AS kids FROM v LEFT JOIN e ON e.d = v.d AND e.k = v.k),
a AS (
  SELECT d, k, d AS ad, k AS ak, up, m, tok, kids FROM f
  UNION ALL SELECT a.d, a.k, f.d, f.k, f.up, a.m, a.tok, a.kids FROM a JOIN f ON f.d = a.ad - 1 AND f.k = a.up AND a.ad > 0
), t AS (
  SELECT ad AS d, ak AS k, count(*) FILTER (WHERE kids = 0) AS leaves, sum((m - 1) * tok) AS saved FROM a GROUP BY 1, 2
)
SELECT f.conv AS conv_id, f.d AS depth, q.conv AS parent_conv_id, f.m AS n_convs, f.kids AS n_children,
  t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN t ON t.d = f.d AND t.k = f.k LEFT JOIN f q ON q.d = f.d - 1 AND q.k = f.up AND f.d > 0
"""


@query("op12_prefix_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much do conversations share, prefix by prefix?"""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
