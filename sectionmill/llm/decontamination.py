"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words; a window is the set of its shingles of ``SHINGLE`` words.
A window occurs only where all of its shingles do, so one of them is a necessary prefix:
the rarest in the documents, which leaves the fewest places to look at.

1. One pass over the documents keeps the stretches of words whose shingles the benchmark has
   (a sorted array of hashes is broadcast, in blocks of ``MOST`` at most, so its size is bounded however large the benchmark is).
2. Shingles of these stretches are counted over all documents, and each window's rarest one is its prefix.
3. Prefixes are joined with the stretches' shingles; a window that would begin before its stretch or end
   after it is dropped (position and length).
4. What is left is compared word by word over a window of the item's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, kind, materialise, valid

WINDOW, SHINGLE = 10, 5
#: Hashes of shingles that are broadcast at once (8 bytes each).
MOST = 2_000_000
#: Copies of the benchmark's side of a join, so that a passage of very many documents is no single task.
SALT = 16
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that are cut into words together; the next word's end may lie further on.
_CHUNK = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = _U(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:256] = True
_FOUND = "array<struct<at:int,words:array<string>>>"


def words(text: Column) -> Column:
    """A text's words, A-Z in lower case."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- words and shingles of a batch -------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Places and hashes of the words of one UTF-8 text; all bytes beyond ASCII belong to words, so bytes can be cut as they are."""

    def __init__(self, raw: bytes | memoryview):
        self.bytes = _LOWER[np.frombuffer(raw, np.uint8)]
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(self.bytes):
            end = min(at + _CHUNK, len(self.bytes))
            while end < len(self.bytes) and _IS_WORD[self.bytes[end - 1]]:  # on to a word's end
                stop = np.flatnonzero(~_IS_WORD[self.bytes[end : end + _CHUNK]])
                end = end + int(stop[0]) + 1 if len(stop) else min(end + _CHUNK, len(self.bytes))
            a, b, h = self._chunk(self.bytes[at:end])
            starts.append(a + at)
            ends.append(b + at)
            hashes.append(h)
            at = end
        none = np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.hashes = np.concatenate([np.zeros(0, _U), *hashes])

    @staticmethod
    def _chunk(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = np.diff(np.concatenate([[False], _IS_WORD[part], [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            return starts, ends, np.zeros(0, _U)
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(len(part) - 1, _P, _U)]))
        sums = np.concatenate([np.zeros(1, _U), np.add.accumulate((part.astype(_U) + _U(1)) * powers)])
        back = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(int(starts[-1]), _P_INVERSE, _U)]))
        return starts, ends, _mixed((sums[ends] - sums[starts]) * back[starts])

    def __len__(self) -> int:
        return len(self.starts)

    def shingles(self, size: int) -> np.ndarray:
        n = len(self) - size + 1
        h = np.full(max(n, 0), size, _U)
        for i in range(size if n > 0 else 0):
            h = _mixed(h * _P + self.hashes[i : i + n])
        return h

    def stretch(self, a: int, b: int) -> dict:
        return {"at": a, "words": [self.bytes[s:e].tobytes().decode() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]}


def _texts(col: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer() if t.is_valid else b"" for t in col.cast(pa.large_binary()))


def _stretches(text: Words, known: np.ndarray, sizes: list[int]) -> list[dict]:
    """Stretches of words in which each shingle, of one size, is known to the benchmark."""
    covers = []
    for size in sizes:
        h = text.shingles(size)
        place = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else np.zeros(0, np.int64)
        at = np.flatnonzero(known[place] == h) if len(place) else place
        if len(at):
            new = np.flatnonzero(np.diff(at) > 1) + 1
            covers += [text.stretch(int(run[0]), int(run[-1]) + size) for run in np.split(at, new)]
    return covers


def _scanner(told, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(told.value, _U)
        kind_ = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            n, found = [], []
            for raw in _texts(batch.column("text")):
                text = Words(raw)
                n.append(len(text))
                found.append(_stretches(text, known, sizes))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(n, pa.int64()), pa.array(found, kind_)], names=["row", "id", "n_words", "found"])

    return run


def _hasher(sizes: list[int], window: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for raw in _texts(batch.column("text")):
                text = Words(raw)
                hashes.append(text.shingles(min(len(text), size)) if len(text) else text.hashes)
            ends = np.cumsum([0, *map(len, hashes)])
            flat = np.concatenate([np.zeros(0, _U), *hashes])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(hashes)), np.diff(ends))), pa.array(flat.view(np.int64))], names=["row", "hash"])

    return run


# --- the join ----------------------------------------------------------------------------------


def windows(items: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(item, words, window) for each window of each item; an item of fewer words, but not none, is one window."""
    cut = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.coalesce(valid(F.col(text_col)), F.lit(""))).alias("words"))
    each = F.when(F.size("words") == 0, F.array().cast("array<array<string>>")).when(F.size("words") < window, F.array("words")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("words") - window + 1), lambda i: F.slice("words", i, window)))
    return cut.select("item", F.explode(each).alias("words")).withColumn("window", F.array_join("words", " "))


def _shingled(list_: Column, size: Column) -> Column:
    """Each shingle of a list of at least ``size`` words, with its place."""
    return F.transform(F.sequence(F.lit(0), F.size(list_) - size), lambda i: F.struct(i.alias("place"), F.array_join(F.slice(list_, i + 1, size), " ").alias("shingle")))


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _hits(found: DataFrame, distinct: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """(row, hits): the windows that occur in each document, as structs of first word, end and window."""
    stretches = found.where(F.size("found") > 0).select("row", F.posexplode("found").alias("stretch", "f")).select("row", "stretch", F.size("f.words").alias("long"), F.col("f.words").alias("words"))
    every = [stretches.where(F.col("long") >= k).select("row", "stretch", "long", F.explode(_shingled(F.col("words"), F.lit(k))).alias("s")) for k in sizes]
    places = reduce(DataFrame.union, every).select("row", "stretch", "long", "s.place", "s.shingle")
    counts = materialise(places.groupBy("shingle").agg(F.count("*").alias("n")), "rarity")

    parts = distinct.select("window", F.size("words").alias("length"), F.explode(_shingled(F.col("words"), F.least(F.size("words"), F.lit(size)))).alias("s")).select("window", "length", "s.place", "s.shingle")
    rated = parts.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = rated.groupBy("window").agg(F.first("length").alias("length"), F.min(F.struct("n", "shingle", "place")).alias("rarest")).where("rarest.n > 0")
    prefix = materialise(prefix.select("window", "length", F.col("rarest.shingle").alias("shingle"), F.col("rarest.place").alias("offset")), "prefixes")

    met = places.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(_salted(prefix), ["shingle", "salt"])
    met = met.withColumn("from", F.col("place") - F.col("offset")).where("`from` >= 0 and `from` + length <= long")
    candidates = met.groupBy("row").agg(F.collect_set(F.struct("stretch", "from", "length", "window")).alias("candidates"))  # of one document's words
    of = lambda c: F.get(F.col("found"), c["stretch"])
    same = F.filter("candidates", lambda c: F.array_join(F.slice(of(c)["words"], c["from"] + 1, c["length"]), " ") == c["window"])
    placed = F.transform(same, lambda c: F.struct((of(c)["at"] + c["from"]).alias("start"), (of(c)["at"] + c["from"] + c["length"]).alias("end"), c["window"].alias("window")))
    return found.join(candidates, "row").select("row", placed.alias("hits")).where(F.size("hits") > 0)


def _covered(hits: Column) -> Column:
    """Words in any of the hits."""
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda t, h: F.struct(F.greatest(t["end"], h["end"]).alias("end"), (t["n"] + F.greatest(h["end"] - F.greatest(t["end"], h["start"]), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(F.transform(hits, lambda h: F.struct(h["start"], h["end"]))), nothing, step, lambda t: t["n"])


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *,
    window: int = WINDOW, size: int = SHINGLE, most: int = MOST,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of each row of ``docs``.

    ``items`` is the sorted array of the ids, as strings, of the items that have a window in the text. Null and empty texts, on
    either side, have no words. Each row of ``docs`` is a document, whatever its id (null ids and repeated rows too); items of one id are one item, and a null
    item id is the id "". A very long text is scanned whole by the task that holds its row. Empty tables give no rows, or no hits. Other columns
    aren't read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), valid(F.col(text_col)).alias("text"))
    every = materialise(windows(items, item_col, item_text_col, window), "windows")
    distinct = materialise(every.groupBy("window").agg(F.first("words").alias("words")), "windows")
    sizes = sorted(r["k"] for r in distinct.select(F.least(F.size("words"), F.lit(size)).alias("k")).distinct().collect())  # `size` values at most
    hashes = items.select(valid(F.col(item_text_col)).alias("text")).mapInArrow(_hasher(sizes, window, size), "row long, hash long").select("hash").distinct()
    hashes = materialise(hashes, "hashes")
    blocks = -(-hashes.count() // most) or 1
    if blocks == 1:
        told = spark.sparkContext.broadcast(_sorted(hashes))
        found = materialise(numbered.mapInArrow(_scanner(told, sizes), f"row long, id {kind(numbered, 'id')}, n_words long, found {_FOUND}"), "found")
    else:
        found = _in_blocks(materialise(numbered, "numbered"), hashes, blocks, sizes)
    rows = found.select("row", "id", "n_words")
    if not sizes:
        return _report(rows.withColumn("n_hit", F.lit(0).cast("long")).withColumn("items", F.array().cast("array<string>")), id_col)
    hits = materialise(_hits(found, distinct, sizes, size), "hits")
    occurring = hits.select("row", F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
    named = occurring.join(_salted(every.select("window", "item").distinct()), ["window", "salt"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = rows.join(hits.select("row", _covered(F.col("hits")).alias("n_hit")).join(named, "row"), "row", "left")
    return _report(told, id_col)


def _report(told: DataFrame, id_col: str) -> DataFrame:
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return told.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def _sorted(hashes: DataFrame) -> bytes:
    return np.sort(np.array([r["hash"] for r in hashes.toLocalIterator()], np.int64).view(_U)).tobytes()


def _in_blocks(numbered: DataFrame, hashes: DataFrame, blocks: int, sizes: list[int]) -> DataFrame:
    """The pass over the documents for a benchmark of more hashes than are broadcast at once. Each block of hashes marks
    places; a shingle's words come with its place, and places of all blocks make up the stretches."""
    spark, schema = numbered.sparkSession, f"row long, id {kind(numbered, 'id')}, n_words long, found {_FOUND}"
    parts = []
    for b in range(blocks):
        told = spark.sparkContext.broadcast(_sorted(hashes.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b)))
        parts.append(materialise(numbered.mapInArrow(_scanner(told, sizes), schema), "found"))
        told.destroy()
    merged = reduce(DataFrame.union, parts).groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("found")).alias("found"))
    step = lambda done, f: F.when((F.size(done) > 0) & (f["at"] <= _end(F.element_at(done, -1))), _extended(done, f)).otherwise(F.concat(done, F.array(f)))
    joined = F.aggregate(F.array_sort("found"), F.array().cast(_FOUND), step)
    return materialise(merged.withColumn("found", joined), "found")


def _end(f: Column) -> Column:
    return f["at"] + F.size(f["words"])


def _extended(done: Column, f: Column) -> Column:
    """The last stretch with the words of ``f`` that go beyond it."""
    last = F.element_at(done, -1)
    beyond = F.greatest(_end(f) - _end(last), F.lit(0))
    more = F.slice(f["words"], F.size(f["words"]) - beyond + 1, beyond)
    return F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["at"].alias("at"), F.concat(last["words"], more).alias("words"))))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{WORD}') AS w FROM benchmark),
win AS (SELECT item, least(len(w), {WINDOW}) AS l, array_to_string(list_slice(w, i + 1, i + least(len(w), {WINDOW})), ' ') AS win
  FROM (SELECT item, w, unnest(range(greatest(len(w) - {WINDOW} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, l, array_to_string(list_slice(w, i + 1, i + l), ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, g.l, item FROM grams g JOIN win USING (win)),
places AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""
