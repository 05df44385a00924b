"""MinHash near-dedup with dart sketches.

A document is the set of its five-word shingles, each with weight one however often it occurs, so that
sketches estimate the similarity that decides about a pair. Every unit of
weight of every shingle owns a fixed, hash-seeded Poisson process of darts along a rank
axis, at rate one. A sketch looks at all darts whose rank is below ``t / total weight``
(about ``t = k ln k + 2k`` darts whatever the document's length), sends each dart to one
of ``k`` coordinates by its hash, and keeps the earliest dart of each coordinate. Two
sketches agree in a coordinate with a probability equal to their weighted Jaccard
similarity. A sketch with an empty coordinate is made again with twice the darts.

Bands of the sketch are joined, and candidate pairs are verified on the whole texts. A pair is
linked if the Jaccard similarity of its sets of shingles is at least the threshold. Texts with equal words are one class before any sketch is compared.

Before texts are fetched, two exact bounds of the similarity throw out pairs: the ratio of the sets' sizes, and a
bitmap of each set. A bit that one of two bitmaps alone has stands for a shingle that the other set lacks, so the
bound is never too low and no link is lost by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import bound_batches, drop, fresh, kind, materialise, valid

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 6
#: Bits of a text's bitmap.
BITS = 2048
#: Members of a bucket that meet in one cell.
_CELL = 1000
_U = np.uint64
#: Cumulative probabilities of a Poisson variable of mean one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
#: Shingles of the documents that are sketched together.
_PART = 120_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def weighted_shingles(words: np.ndarray, lengths: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of documents whose word hashes are laid end to end.

    A document of fewer than ``size`` words has one shingle, all its words; one without
    words has none.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    n = max(0, len(words) - size + 1)
    rows, hashes = [], []
    with np.errstate(over="ignore"):
        if n:
            h = np.zeros(n, _U)
            for i in range(size):
                h = h * _U(0x100000001B3) + mix(words[i : i + n])
            inside = row[:n] == row[size - 1 :]
            rows.append(row[:n][inside])
            hashes.append(mix(h[inside]))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        short = np.flatnonzero((lengths > 0) & (lengths < size))
        if len(short):
            few = np.zeros(len(short), _U)
            for j, d in enumerate(short):
                for w in mix(words[starts[d] : starts[d + 1]]):
                    few[j] = few[j] * _U(0x100000001B3) + w
            rows.append(short)
            hashes.append(mix(few ^ _U(0x5851F42D4C957F2D)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    r, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]))
    return r[first], h[first], np.diff(np.append(first, len(r)))


def throw(rows: np.ndarray, items: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Dart sketches, one row of ``k`` dart hashes for each row number below ``n_rows``.

    ``weights`` may be any positive numbers: the last slab of an item is as wide as what is
    left of its weight, and a dart counts if its place across the slab lies within.
    Rows without items stay zero.
    """
    out = np.zeros((n_rows, k), _U)
    total = np.bincount(rows, weights=weights, minlength=n_rows)
    todo = total > 0
    aim = k * math.log(k) + 2 * k
    while todo.any():
        mine = todo[rows]
        r, x, w = rows[mine], items[mine], weights[mine].astype(np.float64)
        slabs = np.ceil(w).astype(np.int64)
        at = np.repeat(np.arange(len(r)), slabs)
        slab = np.arange(len(at)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        reach = aim / np.where(total > 0, total, 1)
        cells = np.ceil(reach[r[at]]).astype(np.int64)
        up = np.repeat(np.arange(len(at)), cells)
        cell = np.arange(len(up)) - np.repeat(np.cumsum(cells) - cells, cells)
        at, slab = at[up], slab[up]
        with np.errstate(over="ignore"):
            seed = mix(mix(x[at] + slab.astype(_U) * _U(0xD1342543DE82EF95)) ^ (cell.astype(_U) * _U(0xA0761D6478BD642F)))
        darts = np.searchsorted(_POISSON, unit(seed), side="right")
        hit = np.repeat(np.arange(len(seed)), darts)
        number = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
        with np.errstate(over="ignore"):
            dart = mix(seed[hit] + (number.astype(_U) + _U(1)) * _U(0xE7037ED1A0B428DB))
        rank = cell[hit] + unit(mix(dart ^ _U(0x8EBC6AF09C88C6E3)))
        across = slab[hit] + unit(mix(dart ^ _U(0x589965CC75374CC3)))
        doc = r[at[hit]]
        keep = (rank < reach[doc]) & (across < w[at[hit]])
        doc, rank, dart = doc[keep], rank[keep], dart[keep]
        place = doc * k + (dart % _U(k)).astype(np.int64)
        order = np.lexsort((rank, place))
        place, dart = place[order], dart[order]
        first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
        place, dart = place[first], dart[first]
        filled = np.bincount(place // k, minlength=n_rows)
        done = todo & (filled == k)
        ok = done[place // k]
        out.reshape(-1)[place[ok]] = dart[ok]
        todo &= ~done
        aim *= 2
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(sketch), bands), _U)
    with np.errstate(over="ignore"):
        for i in range(rows):
            h = mix(h * _U(0x100000001B3) + sketch[:, i : bands * rows : rows])
        return mix(h + np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15))


def bitmaps(rows: np.ndarray, items: np.ndarray, n_rows: int) -> np.ndarray:
    """``BITS`` bits of each row's set of items, as 64-bit words."""
    flat = np.zeros(n_rows * BITS, bool)
    flat[rows * BITS + (items >> _U(17) & _U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(flat, bitorder="little").view(_U).reshape(n_rows, BITS // 64)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a list column end to end, and each row's number of them."""
    offsets = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(np.int64).view(_U), np.diff(offsets)


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``_PART`` words; a longer document is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > _PART:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def _sketcher(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lengths = _flat(batch.column("words"))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            found, bits, distinct = [], [], []
            for a, b in _parts(lengths):
                r, x, _ = weighted_shingles(words[ends[a] : ends[b]], lengths[a:b], size)
                found.append(band_hashes(throw(r, x, np.ones(len(r)), b - a, bands * rows), bands, rows))
                bits.append(bitmaps(r, x, b - a))
                distinct.append(np.bincount(r, minlength=b - a).astype(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * width), pa.array(np.concatenate(x).view(np.int64).reshape(-1) if x else np.zeros(0, np.int64))) for x, width in ((found, bands), (bits, BITS // 64))]
            sizes = np.concatenate(distinct) if distinct else np.zeros(0, np.int64)
            kept = ["row", "id", "h", "k1", "k2"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes), *lists], names=[*kept, "distinct", "bands", "bits"])

    return run


def _verifier(threshold: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, na = _flat(batch.column("words_a"))
            wb, nb = _flat(batch.column("words_b"))
            ra, xa, _ = weighted_shingles(wa, na, size)
            rb, xb, _ = weighted_shingles(wb, nb, size)
            n = batch.num_rows
            r, x = np.concatenate([ra, rb]), np.concatenate([xa, xb])
            order = np.lexsort((x, r))
            r, x = r[order], x[order]
            same = np.flatnonzero((r[1:] == r[:-1]) & (x[1:] == x[:-1]))
            shared, both = np.bincount(r[same], minlength=n), np.bincount(r, minlength=n)
            similarity = shared / np.maximum(both - shared, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(similarity), pa.array(similarity >= threshold - 1e-12)],
                names=["a", "b", "similarity", "linked"],
            )

    return run


def normal_words(text: Column) -> Column:
    """A text's letters and digits in lower case, single spaces between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_hashes(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(norm, " "), lambda w: F.xxhash64(w)))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE,
) -> DataFrame:
    """One row per document: (id, class_id, kept).

    ``class_id`` is the least id of the document's class (null if all its ids are null); ``kept`` holds for one
    row of each class, that of the least id. Ids may be of any type, null and repeated: each row is a document, and
    rows of one id with different texts are told apart. Of rows that tie for the least id, the hashes of the words and of the text decide;
    only rows equal in both tie beyond that, and one of them is kept. Texts whose words are equal are one class; texts without
    any word are one class only if the whole texts are equal. A null text makes a document its
    own class. Very long texts are sketched and verified whole. An empty table gives no rows. Columns of ``docs`` other than the two named aren't read.
    """
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "numbered")
    return _classified(numbered, threshold, bands, rows, size).select(F.col("id").alias(id_col), "class_id", "kept")


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`near_duplicates` keeps: one of each class."""
    row = fresh(docs, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _classified(numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), threshold, bands, rows, size)
    kept = materialise(found.where("kept").select(F.col("row").alias(row)), "kept")
    return numbered.join(kept, row, "left_semi").select(docs.columns)


def _classified(numbered: DataFrame, threshold: float, bands: int, rows: int, size: int) -> DataFrame:
    """(row, id, class_id, kept) of a written table (row, id, text) whose rows have numbers of their own."""
    bound_batches(numbered.sparkSession)
    norm = numbered.select("row", "id", "text", normal_words(F.coalesce(valid(F.col("text")), F.lit(""))).alias("norm"))
    same = F.when(F.col("text").isNull(), F.col("row").cast("string")).when(F.col("norm") == "", F.col("text")).otherwise(F.col("norm"))
    sort = F.when(F.col("text").isNull(), 2).when(F.col("norm") == "", 1).otherwise(0)
    keyed = norm.select("row", "id", F.xxhash64("text").alias("h"), F.xxhash64(same, sort).alias("k1"), F.xxhash64(sort, F.lit(7), same).alias("k2"), word_hashes(F.col("norm")).alias("words"))
    sketches = materialise(
        keyed.mapInArrow(_sketcher(bands, rows, size), f"row long, id {kind(numbered, 'id')}, h long, k1 long, k2 long, distinct long, bands array<long>, bits array<long>"),
        "sketches",
    )
    order = [F.col("id").isNull().alias("nameless"), F.col("id"), F.col("h"), F.col("row")]
    firsts = sketches.groupBy("k1", "k2").agg(F.min(F.struct(*order, "distinct", "bands", "bits")).alias("s"))
    firsts = materialise(firsts.select("k1", "k2", "s.*").withColumnRenamed("row", "node"), "firsts")
    found = _classes(numbered, firsts, threshold, size)
    named = firsts.select("nameless", "id", "k1", "k2", "h", "node").join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("class", F.coalesce("component", "node"))
    named = materialise(named.drop("of", "component"), "classes")
    least = materialise(named.groupBy("class").agg(F.min(F.struct("nameless", "id", "k1", "k2", "h", "node")).alias("best")).select("class", F.col("best.id").alias("class_id"), F.col("best.node").alias("best")), "least")
    classes = materialise(named.select("k1", "k2", "class").join(least, "class").select("k1", "k2", "class_id", "best"), "classes")
    return sketches.select("row", "id", "k1", "k2").join(classes, ["k1", "k2"]).select("row", "id", "class_id", (F.col("row") == F.col("best")).alias("kept"))


def _near(x: str, y: str, threshold: float) -> Column:
    """The similarity of two sets can't exceed the ratio of their sizes."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(threshold - 1e-9)


def _bounded(pairs: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave, with ``bound``, the most that their similarity can be."""
    for x in ("a", "b"):
        pairs = pairs.join(firsts.select(F.col("node").alias(x), F.col("distinct").alias("n" + x), F.col("bits").alias("bits" + x)), x)
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, n: t + n)
    both = F.least(F.col("na") - alone("bitsa", "bitsb"), F.col("nb") - alone("bitsb", "bitsa"))
    pairs = pairs.where(_near("na", "nb", threshold)).withColumn("both", both)
    return pairs.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("bound")).where(F.col("bound") >= threshold - 1e-9)


def _classes(numbered: DataFrame, firsts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(node, component) of the texts that a verified link joins to others.

    Every text of a bucket is first compared with the bucket's most central text: the one whose own
    buckets hold the most. In a large group of near copies that is the text they were made from, so
    each member costs a pair or a few. What this leaves apart is compared in full: :func:`_open_pairs` gives
    all pairs of a bucket that are still of different classes. Those that the exact bounds leave are verified, first
    the likeliest of each text, then all others that these haven't joined.
    """
    held = firsts.where("distinct > 0").select("node", "distinct", F.posexplode("bands").alias("band", "hash"))
    crowd = held.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    held = materialise(held.join(crowd, ["band", "hash"]), "members")
    central = materialise(held.groupBy("node").agg(F.sum("n").alias("central")), "central")
    ranked = materialise(held.drop("n").join(central, "node"), "members")
    drop(held)
    # The only shuffle of all texts; from here on those that share no bucket are out of the way.
    texts = materialise(numbered.select(F.col("row").alias("node"), "text").join(central.select("node").hint("merge"), "node", "left_semi"), "texts")
    firsts = materialise(firsts.select("node", "distinct", "bits").join(central.select("node"), "node", "left_semi"), "firsts")
    lead = materialise(ranked.groupBy("band", "hash").agg(F.max(F.struct("central", -F.col("node"), "node", "distinct")).alias("lead")), "leads")
    star = ranked.join(lead, ["band", "hash"]).where((F.col("node") != F.col("lead.node")) & _near("distinct", "lead.distinct", threshold))
    pairs = star.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    checked = materialise(_bounded(pairs, firsts, threshold).select("a", "b"), "pairs")
    known = materialise(components(_verified(texts, checked, threshold, size)), "classes")

    pairs = _open_pairs(ranked.select("band", "hash", "node"), firsts, known, threshold)
    pairs = materialise(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
    each = pairs.select("a", "b", "bound", F.explode(F.array("a", "b")).alias("x"))
    first = materialise(each.groupBy("x").agg(F.max(F.struct("bound", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    known = _merged(known, _verified(texts, first, threshold, size))
    rest = materialise(_apart(pairs.join(first, ["a", "b"], "left_anti"), known).select("a", "b"), "pairs")
    return _merged(known, _verified(texts, rest, threshold, size))


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with further links between texts taken in."""
    between = materialise(_apart(links, known).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct(), "links")
    if between.isEmpty():
        return known
    merged = materialise(components(between), "merged")
    moved = known.join(merged.select(F.col("node").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return materialise(moved.union(merged).distinct(), "classes")


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs of different classes, with these."""
    for x in ("a", "b"):
        pairs = pairs.join(known.select(F.col("node").alias(x), F.col("component").alias("class_" + x)), x, "left").withColumn("class_" + x, F.coalesce("class_" + x, x))
    return pairs.where("class_a <> class_b")


def _open_pairs(buckets: DataFrame, firsts: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(a, b, bound) of all texts that share a bucket, are of different classes, and that the exact bounds leave.

    Those outside the largest class of a bucket meet all its members, in cells of about a thousand by a
    thousand, so that neither one class nor one bucket is a single task. A cell is one row; its pairs are bounded
    where they meet, and only what the bounds leave is given out.
    """
    classed = buckets.join(known.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("class", F.coalesce("component", "node")).drop("of", "component")
    sizes = classed.groupBy("band", "hash", "class").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "hash").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("n")).where("classes > 1")
    cells = lambda n: F.ceil(n / _CELL).cast("int")
    mixed = materialise(mixed.select("band", "hash", F.col("main.class").alias("main"), cells(F.col("n")).alias("across"), cells(F.col("n") - F.col("main.n")).alias("down")), "mixed")
    members = materialise(classed.join(mixed, ["band", "hash"]).join(firsts.select("node", F.col("distinct").alias("size"), "bits"), "node"), "members")
    at = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    cell = ["band", "hash", "row", "column"]
    one = F.struct("node", "class", "size", "bits")
    few = members.where("class <> main").withColumn("row", at(F.col("down"))).withColumn("column", every(F.col("across"))).select(*cell, "main", F.lit(True).alias("few"), one.alias("one"))
    every_one = members.withColumn("column", at(F.col("across"))).withColumn("row", every(F.col("down"))).select(*cell, "main", F.lit(False).alias("few"), one.alias("one"))
    met = few.union(every_one).groupBy(*cell).agg(F.first("main").alias("main"), F.collect_list(F.when(F.col("few"), F.col("one"))).alias("few"), F.collect_list(F.when(~F.col("few"), F.col("one"))).alias("all"))
    found = met.where("size(few) > 0 and size(all) > 0").select("main", "few", "all").mapInArrow(_bounder(threshold), "a long, b long, bound double")
    return found.dropDuplicates(["a", "b"])


def _bounder(threshold: float):
    def columns(side: pa.ListArray) -> tuple[np.ndarray, ...]:
        offsets = side.offsets.to_numpy()
        values = side.values
        take = lambda name: values.field(name).to_numpy(zero_copy_only=False)
        bits = values.field("bits").values.to_numpy(zero_copy_only=False).view(_U).reshape(-1, BITS // 64)
        return offsets, take("node"), take("class"), take("size"), bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            few_at, few, few_class, few_size, few_bits = columns(batch.column("few"))
            all_at, node, group, size, bits = columns(batch.column("all"))
            for c, main in enumerate(batch.column("main").to_pylist()):
                part = slice(all_at[c], all_at[c + 1])
                n, k, s, theirs = node[part], group[part], size[part], bits[part]
                for i in range(few_at[c], few_at[c + 1]):
                    fit = (k != few_class[i]) & ((k == main) | (few[i] < n)) & (np.minimum(s, few_size[i]) >= np.maximum(s, few_size[i]) * (threshold - 1e-9))
                    at = np.flatnonzero(fit)
                    if not len(at):
                        continue
                    other = theirs[at]
                    alone = np.bitwise_count(few_bits[i] & ~other).sum(axis=1, dtype=np.int64)
                    lone = np.bitwise_count(other & ~few_bits[i]).sum(axis=1, dtype=np.int64)
                    both = np.minimum(few_size[i] - alone, s[at] - lone)
                    bound = both / (few_size[i] + s[at] - both)
                    good = bound >= threshold - 1e-9
                    at = at[good]
                    out[0].append(np.minimum(n[at], few[i]))
                    out[1].append(np.maximum(n[at], few[i]))
                    out[2].append(bound[good])
            a, b, bound = (np.concatenate(x) if x else np.zeros(0) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(bound.astype(np.float64))], names=["a", "b", "bound"])

    return run


def _verified(texts: DataFrame, pairs: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their similarity on whole texts.

    The joins that carry texts are merge joins at every size, so that what is shuffled grows with
    the input and never with the choice of a plan.
    """
    words = lambda c: word_hashes(normal_words(F.coalesce(valid(F.col(c)), F.lit(""))))
    joined = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        .select("a", "b", words("text_a").alias("words_a"), words("text_b").alias("words_b"))
    )
    found = joined.mapInArrow(_verifier(threshold, size), "a long, b long, similarity double, linked boolean")
    return materialise(found.where("linked").select("a", "b"), "links")
