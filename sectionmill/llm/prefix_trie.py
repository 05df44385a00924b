"""Prefix trie of conversations, its subtree totals by time-forward processing.

A conversation is first rebuilt: the head of another one (its donor), then its own turns after as many. A node of the trie is a
sequence of first turns, known by its depth and two running hashes; it belongs to its smallest member.

Totals go from the leaves to the root. Nodes are put in reverse level order (an external sort), and each sends its totals
forward to its parent, which comes later, through a priority queue that spills to disk. This is done within shards first:
a node is light if the turns below it are at most ``shard_turns``, and a shard holds whole subtrees of topmost light nodes. What the
shards' roots send is summed by parent. The heavy nodes that are left, few on each level, are processed in the same way in
stretches of ``LEVELS`` levels: once to find what each stretch's root holds, once across these roots, and once more with
what the roots below bring. So no subtree, hot prefix or long conversation is a single task.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bound_batches, materialise, valid
from .spelling import crc32_sql

DONOR_EVERY, HEADS = 20, 4
#: Turns below a light node, at least; a ten-thousandth of all turns if that is more, which bounds the heavy nodes of a level.
SHARD_TURNS, SHARDS = 100_000, 10_000
LEVELS = 1000
#: Messages that a queue holds in memory.
QUEUE = 500_000
SALT = 16
WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "k1", "k2"]


# --- rebuilt conversations ---------------------------------------------------------------------


def _numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, range, at, i, n, role, digest, words): turns by their place i among the n of their conversation. Texts stay where they are; turns are put
    in order by ranges, so that a conversation may lie on many tasks, and numbered by its sums over ranges."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(valid(F.col(text)), F.lit("")).alias("text"))
    rows = rows.select("conv", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    ordered = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns").withColumn("range", F.shiftright("at", 33))
    spans = ordered.groupBy("conv", "range").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    by = Window.partitionBy("conv").orderBy("range")  # a row for each range that holds the conversation
    spans = spans.withColumn("before", F.sum("m").over(by) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy("conv")))
    spans = materialise(spans, "spans")
    return ordered.join(spans, ["conv", "range"]).select("conv", "range", "at", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "n", "role", "digest", "words")


def _hashes(depth: Column, t: Column | None = None) -> tuple[Column, Column]:
    of = (lambda c: t[c]) if t is not None else F.col
    return F.xxhash64(depth, of("role"), of("digest")), F.xxhash64(of("digest"), F.lit(7), of("role"), depth)


def steps(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A written table with a row for the root and each turn of a rebuilt conversation: (conv, depth, k1, k2, p1, p2, words, below), where p is
    the parent's hashes and below counts the turns from this one on. The last turn's is 1."""
    numbered = materialise(_numbered(turns, conv, turn, role, text), "numbered")
    heads = numbered.where((F.col("i") < HEADS - 1) & (F.col("conv") % DONOR_EVERY == 0)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "role", "digest", "words"))).alias("heads"))
    ranges = numbered.groupBy("conv", "range").agg(F.first("n").alias("n"))
    ranges = ranges.withColumn("h", (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % HEADS).cast("int")).withColumn("donor", F.col("conv") - F.col("conv") % DONOR_EVERY)
    told = ranges.join(heads.withColumnRenamed("conv", "donor"), "donor", "left").withColumn("heads", F.slice(F.coalesce("heads", F.array().cast("array<struct<i:bigint,role:string,digest:string,words:bigint>>")), F.lit(1), F.col("h")))
    zero = lambda: F.lit(0).cast("long")

    def grown(done: Column, t: Column) -> Column:
        last, depth = F.element_at(done, -1), F.size(done)
        a, b = _hashes(depth, t)
        return F.concat(done, F.array(F.struct(last["k1"].bitwiseXOR(a).alias("k1"), last["k2"].bitwiseXOR(b).alias("k2"), last["k1"].alias("p1"), last["k2"].alias("p2"), t["words"].alias("words"))))

    top = F.array(F.struct(zero().alias("k1"), zero().alias("k2"), zero().alias("p1"), zero().alias("p2"), zero().alias("words")))
    told = told.withColumn("path", F.aggregate("heads", top, grown)).withColumn("length", (F.size("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long"))
    told = materialise(told.select("conv", "range", "h", "length", "path"), "conversations")

    own = numbered.join(told, ["conv", "range"]).where("i >= h").withColumn("depth", (F.col("i") - F.col("h") + F.size("path")).cast("long"))
    a, b = _hashes(F.col("depth").cast("int"))
    own = materialise(own.select("conv", "range", "at", "depth", "length", a.alias("x1"), b.alias("x2"), F.element_at("path", -1)["k1"].alias("o1"), F.element_at("path", -1)["k2"].alias("o2"), "words"), "own")
    sums = own.groupBy("conv", "range").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "range", *[F.coalesce(F.bit_xor(f"y{i}").over(earlier), zero()).alias(f"c{i}") for i in (1, 2)])
    running = Window.partitionBy("conv", "range").orderBy("at")
    own = own.join(carried, ["conv", "range"])
    key = lambda i: F.bit_xor(f"x{i}").over(running).bitwiseXOR(F.col(f"c{i}")).bitwiseXOR(F.col(f"o{i}"))
    own = own.withColumn("k1", key(1)).withColumn("k2", key(2)).select("conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words", (F.col("length") - F.col("depth") + 1).alias("below"))
    convs = told.dropDuplicates(["conv"])
    head = convs.select("conv", "length", F.posexplode("path").alias("depth", "s")).select("conv", F.col("depth").cast("long").alias("depth"), "s.k1", "s.k2", "s.p1", "s.p2", "s.words", (F.col("length") - F.col("depth") + 1).alias("below"))
    return materialise(own.union(head), "steps")


# --- time-forward processing -------------------------------------------------------------------


class SpillingQueue:
    """A priority queue of rows of five 64-bit numbers. Beyond ``limit`` rows in memory, all are written as a sorted run; the least of memory and runs comes first."""

    def __init__(self, limit: int = QUEUE, block: int = 4096):
        self.limit, self.block = limit, block
        self.held: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []
        self.spilled = 0

    def push(self, row: tuple[int, ...]) -> None:
        heapq.heappush(self.held, row)
        if len(self.held) >= self.limit:
            self.held.sort()
            self._run(iter(self._written(self.held)))
            self.held = []

    def _written(self, rows: list[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
        file = tempfile.TemporaryFile()  # noqa: SIM115  gone with the process, whatever happens
        file.write(np.array(rows, np.int64).tobytes())
        file.seek(0)

        def read() -> Iterator[tuple[int, ...]]:
            with file:
                while raw := file.read(self.block * 40):
                    yield from map(tuple, np.frombuffer(raw, np.int64).reshape(-1, 5).tolist())

        return read()

    def _run(self, rows: Iterator[tuple[int, ...]]) -> None:
        self.spilled += 1
        heapq.heappush(self.runs, (next(rows), self.spilled, rows))

    def take(self, key: tuple[int, int, int]) -> tuple[int, int, int]:
        """All messages to ``key``: their number and sums."""
        n = leaves = saved = 0
        while True:
            if self.held and self.held[0][:3] == key:
                row = heapq.heappop(self.held)
            elif self.runs and self.runs[0][0][:3] == key:
                row, number, rows = self.runs[0]
                after = next(rows, None)
                if after is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (after, number, rows))
            else:
                return n, leaves, saved
            n, leaves, saved = n + 1, leaves + row[3], saved + row[4]


def _forward(limit: int):
    """Totals of the nodes of a task, in reverse level order. A node with ``top`` sends nothing; (children, leaves, saved) came in from elsewhere."""
    names = ["depth", "k1", "k2", "p1", "p2", "top", "own", "children", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit)
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for depth, k1, k2, p1, p2, top, own, children, leaves, saved in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                n, more, kept = queue.take((-depth, k1, k2))
                children, leaves, saved = children + n, leaves + more, saved + kept + own
                if not children:
                    leaves = 1
                if not top:
                    queue.push((1 - depth, p1, p2, leaves, saved))
                for column, x in zip(out, (children, leaves, saved), strict=True):
                    column.append(x)
            rest = batch.drop_columns(["own", "children", "leaves", "saved"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(x, pa.int64()) for x in out)], names=[*rest.schema.names, "n_children", "n_leaves", "saved_tokens"])

    return run


_IN = "depth long, k1 long, k2 long, p1 long, p2 long, top boolean, conv_id long, parent_conv_id long, n_convs long, s1 long, s2 long, s_depth long"
_OUT = f"{_IN}, n_children long, n_leaves long, saved_tokens long"


def _totals(nodes: DataFrame, arrivals: DataFrame | None, limit: int) -> DataFrame:
    """``nodes`` with totals, shard by shard (s1, s2, s_depth); ``arrivals`` (depth, k1, k2, children, leaves, saved) are what other shards send."""
    zero = F.lit(0).cast("long")
    if arrivals is None:
        nodes = nodes.withColumns({"children": zero, "leaves": zero, "saved": zero})
    else:
        nodes = nodes.join(arrivals, _KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("children", "leaves", "saved")})
    nodes = nodes.select(*[x.split()[0] for x in _IN.split(", ")], "own", "children", "leaves", "saved")
    return nodes.repartition("s1", "s2", "s_depth").sortWithinPartitions(F.col("depth").desc(), "k1", "k2").mapInArrow(_forward(limit), _OUT)


def _sent(roots: DataFrame) -> DataFrame:
    """What shard roots send, summed by their parents."""
    return roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def _at(conv_depth: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, s1, s2, s_depth): the node of each conversation at the depth that is named."""
    return rows.select("conv", "depth", "k1", "k2").join(conv_depth, ["conv", "depth"]).select("conv", F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("depth").alias("s_depth"))


def _with_parents(nodes: DataFrame, heavy: DataFrame) -> DataFrame:
    """Nodes with their parent's conversation, and whether it is heavy. A heavy parent has many children, so its row is there once for each salt."""
    up = lambda df: df.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "conv_id")
    many = up(heavy).withColumnRenamed("conv_id", "heavy_conv").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    light = up(nodes.join(heavy.select(*_KEY), _KEY, "left_anti")).withColumnRenamed("conv_id", "light_conv")
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(SALT)).cast("int"))
    first = salted.join(many, ["depth", "p1", "p2", "salt"], "left").drop("salt")
    second = first.where("heavy_conv is null").join(light, ["depth", "p1", "p2"], "left")
    both = first.where("heavy_conv is not null").withColumn("light_conv", F.lit(None).cast("long")).unionByName(second)
    return both.withColumn("parent_conv_id", F.coalesce("heavy_conv", "light_conv")).withColumn("under_heavy", F.col("heavy_conv").isNotNull()).drop("heavy_conv", "light_conv")


def _heavy_totals(nodes: DataFrame, arrivals: DataFrame, rows: DataFrame, levels: int, limit: int) -> DataFrame:
    """Totals of the heavy nodes: within stretches of levels, across the stretches' roots, and within them again."""
    zero = F.lit(0).cast("long")
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"]
    if deepest < levels:
        return _totals(nodes.withColumns({"s1": zero, "s2": zero, "s_depth": zero, "top": F.col("depth") == 0}), arrivals, limit)
    stretch = (F.floor(F.col("depth") / levels) * levels).cast("long")
    named = nodes.withColumn("s_depth", stretch)
    wanted = named.select(F.col("conv_id").alias("conv"), F.col("s_depth").alias("depth")).distinct()
    tops = materialise(_at(wanted, rows), "tops")
    named = materialise(named.join(tops, (F.col("conv_id") == F.col("conv")) & (named.s_depth == tops.s_depth)).drop(tops.s_depth).drop("conv").withColumn("top", F.col("depth") % levels == 0), "heavy")
    lower = named.where("top and depth > 0")
    # Roots of lower stretches are children before anything is known of their totals.
    there = lower.select("depth", "p1", "p2", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    add = lambda x: materialise(arrivals.unionByName(_sent(x)).groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]), "arrivals")
    once = materialise(_totals(named, add(there), limit), "stretches")
    # The stretches' roots as a tree of their own: each one's parent is the root of the stretch that its parent is in.
    upper = once.select(F.col("depth").alias("d"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    tree = once.where("top").join(upper, (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left")
    tree = tree.select(
        (F.col("depth") / levels).cast("long").alias("depth"), "k1", "k2", F.coalesce("t1", zero).alias("p1"), F.coalesce("t2", zero).alias("p2"), (F.col("depth") == 0).alias("top"), "conv_id", "parent_conv_id", "n_convs",
        zero.alias("s1"), zero.alias("s2"), zero.alias("s_depth"), F.col("saved_tokens").alias("own"), F.col("n_leaves").alias("mine"))
    across = _totals(tree, tree.select(*_KEY, F.lit(1).cast("long").alias("children"), F.col("mine").alias("leaves"), zero.alias("saved")), limit)
    below = materialise(across.select((F.col("depth") * levels).alias("depth"), "k1", "k2", "n_leaves", "saved_tokens"), "roots")
    real = lower.join(below, _KEY).select("depth", "p1", "p2", "n_leaves", "saved_tokens")
    return _totals(named, add(real), limit)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key, comma-joined; rows come sorted, so a key of any number of ids is one running hash."""
    key, hash_ = None, None
    for batch in batches:
        done: list[tuple[int, int, int, str]] = []
        for depth, k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "conv")), strict=True):
            if (depth, k1, k2) != key:
                if key is not None:
                    done.append((*key, hash_.hexdigest()))
                key, hash_ = (depth, k1, k2), hashlib.sha256(str(conv).encode())
            else:
                hash_.update(f",{conv}".encode())
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, hash_.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[*_KEY, "ends_sha256"])


def trie(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *,
    shard_turns: int = SHARD_TURNS, levels: int = LEVELS, queue: int = QUEUE,
) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns are in the order of ``turn`` (null first), ties in that of the role and then of the text's MD5. A null role or text
    is an empty one. Rows without a conversation's id (a whole number) belong to none and are left out; repeated rows are turns of their own. Texts of any length
    are read once and travel as hashes. A table without conversations gives no rows. Other columns aren't read. ``ends_sha256`` is over
    an ordered list, so the ids that end at one node are hashed by one task, as a stream.
    """
    bound_batches(turns.sparkSession)
    rows = steps(turns, conv, turn, role, text)
    most = max(shard_turns, rows.count() // SHARDS)
    nodes = rows.groupBy(*_KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max("words").alias("words"), F.sum("below").alias("below"))
    nodes = materialise(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "nodes")
    heavy = materialise(nodes.where(F.col("below") > most), "heavy")
    nodes = materialise(_with_parents(nodes, heavy), "nodes")
    zero = F.lit(0).cast("long")
    if heavy.isEmpty():
        found = _totals(nodes.withColumns({"s1": zero, "s2": zero, "s_depth": zero, "top": F.col("depth") == 0}), None, queue)
    else:
        salted = heavy.select(*_KEY).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        on_heavy = rows.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALT)).cast("int")).join(salted, [*_KEY, "salt"], "left_semi")
        tops = materialise(_at(on_heavy.groupBy("conv").agg((F.max("depth") + 1).alias("depth")), rows), "tops")
        light = nodes.where(F.col("below") <= most).join(tops.withColumnRenamed("conv", "conv_id"), "conv_id").withColumn("top", F.col("under_heavy"))
        lower = materialise(_totals(light, None, queue), "light")
        arrivals = materialise(_sent(lower.where("top")), "arrivals")
        found = lower.unionByName(_heavy_totals(nodes.where(F.col("below") > most), arrivals, rows, levels, queue))
    ends = rows.where("below = 1").select(*_KEY, "conv").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    return found.join(ends, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


_CRC = crc32_sql("CAST(conv_id AS VARCHAR)")
ORACLE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, {_CRC} % {HEADS} AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(d.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS turns
  FROM h LEFT JOIN c d ON d.conv_id = h.conv_id - h.conv_id % {DONOR_EVERY}),
s AS (SELECT conv_id, turns, depth, md5(CAST(list_slice(turns, 1, depth) AS VARCHAR)) AS node, md5(CAST(list_slice(turns, 1, depth - 1) AS VARCHAR)) AS parent,
  CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(turns[depth].text, '{WORD}')) END AS words
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r)),
n AS (SELECT depth, node, CASE WHEN depth > 0 THEN any_value(parent) END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len(turns)), '')) AS ends_sha256 FROM s GROUP BY depth, node),
k AS (SELECT p.depth, p.node, count(c.node) AS n_children FROM n p LEFT JOIN n c ON c.parent = p.node AND c.depth = p.depth + 1 GROUP BY ALL),
low AS (SELECT DISTINCT a.depth, a.node, b.depth AS d, b.node AS b FROM s a JOIN s b USING (conv_id) WHERE b.depth >= a.depth),
sums AS (SELECT low.depth, low.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved
  FROM low JOIN n ON n.depth = low.d AND n.node = low.b JOIN k ON k.depth = low.d AND k.node = low.b GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, sums.n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN k USING (depth, node) JOIN sums USING (depth, node) LEFT JOIN n p ON p.node = n.parent AND p.depth = n.depth - 1
"""
