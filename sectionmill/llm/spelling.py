"""Spelling variant grouping by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Each word's deletions
and replacements are generated as hashes alone (an edit changes a polynomial hash by a term), and probed against
blocked Bloom filters of the vocabulary, a shard for each length. Only edits that a filter lets through become strings, are shuffled,
and meet the vocabulary in an exact join, which drops the false positives. A word's insertions are
the deletions of its longer neighbours, and a replacement is generated by the word of the lesser letter only: each
pair is found once and counts both ways.

The filters of at most ``MOST`` words are broadcast at once (``BITS`` bits a word). A larger vocabulary is probed in as many rounds as it
has such blocks; all words probe in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, materialise, valid

MIN_LENGTH, MIN_COUNT, RATIO, EVERY = 7, 2, 10, 31
#: Words whose filters are broadcast together: 40 MB.
MOST = 16_000_000
BITS, PROBES = 20, 7
#: Words from this length on share a shard.
_LONGEST = 64
#: 64-bit words of a block of a filter.
_LANES = 8
#: Edits that are probed at once.
_AT_ONCE = 1_000_000
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = _U(pow(int(_P), -1, 1 << 64))
RUN = r"[A-Za-zÀ-ÿ]"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """The vocabulary: (word, n). One run in ``every``, by the checksum of its id and letters, loses a letter first."""
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Shorter runs give no word of min_length; a run that is long enough matches as a whole.
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(valid(F.col(text_col)), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select(run.alias("run"), F.crc32(F.encode(F.concat("id", F.lit(":"), run), "UTF-8")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# --- hashes, filters and edits -----------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = _mixed(np.arange(1, 257, dtype=_U) * _P)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(max(n - 1, 0), base, _U)]))[:n]


def shard(length: int) -> int:
    return min(length, _LONGEST)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, letters) of the words of each length; letters are code points up to U+00FF, a byte each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(len(at), length)


def _blocks(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each hash; ``blocks`` is below 2^32."""
    return ((h >> _U(32)) * _U(blocks)) >> _U(32)


def _bits(h: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The lane and bit of the i-th probe of each hash."""
    nine = (_mixed(h + _U(i // PROBES + 1) * _P) >> _U(9 * (i % PROBES))) & _U(511)
    return nine >> _U(6), _U(1) << (nine & _U(63))


def _filled(sizes: dict[int, int]):
    """Lanes of the filters' blocks that a batch of words sets: (shard, block, lane, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for length, _, letters in _by_length(batch.column("word").to_pylist()):
                h = _mixed((_VALUE[letters] * _powers(_P, length)).sum(axis=1, dtype=_U) + _U(length))
                block = _blocks(h, sizes[shard(length)])
                for i in range(PROBES):
                    lane, bit = _bits(h, i)
                    out[0].append(np.full(len(h), shard(length)))
                    out[1].append(block * _U(_LANES) + lane)
                    out[2].append(bit)
            a, b, c = (np.concatenate(x) if x else np.zeros(0, _U) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int64)), pa.array(c.astype(_U).view(np.int64))], names=["shard", "at", "bits"])

    return run


class Filters:
    """Blocked Bloom filters, one array of 64-bit lanes for each shard."""

    def __init__(self, lanes: dict[int, np.ndarray]):
        self.lanes = lanes

    def passed(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be words of this length. Most drop out at the first probe."""
        lanes = self.lanes.get(shard(length))
        if lanes is None:
            return np.zeros(0, np.int64)
        h = _mixed(h + _U(length))
        at, base = None, _blocks(h, len(lanes) // _LANES) * _U(_LANES)
        for i in range(PROBES):
            lane, bit = _bits(h, i)
            good = np.flatnonzero(lanes[base + lane] & bit)
            at, h, base = good if at is None else at[good], h[good], base[good]
        return at


def edits(letters: np.ndarray, filters: Filters, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row, edited word) of the deletions and replacements that the filters let through, for words of one length."""
    n, length = letters.shape
    rows = max(1, _AT_ONCE // (length * len(alphabet)))
    span = max(1, _AT_ONCE // len(alphabet))
    powers = _powers(_P, length)
    for a in range(0, n, rows):
        part = letters[a : a + rows]
        terms = _VALUE[part] * powers
        total = terms.sum(axis=1, dtype=_U)
        before = np.cumsum(terms, axis=1, dtype=_U) - terms
        # Of equal letters in a row, deleting any gives the same word.
        kept = np.concatenate([np.ones((len(part), 1), bool), part[:, 1:] != part[:, :-1]], axis=1)
        r, i = np.nonzero(kept)
        h = before[r, i] + (total[r] - before[r, i] - terms[r, i]) * _P_INVERSE
        hit = filters.passed(length - 1, h)
        if len(hit):
            yield a + r[hit], [np.delete(part[x], y).tobytes().decode("latin-1") for x, y in zip(r[hit], i[hit], strict=True)]
        for b in range(0, length, span):  # a word longer than that is replaced in stretches
            here = part[:, b : b + span]
            r, i, c = np.nonzero(alphabet > here[:, :, None])
            h = total[r] - terms[r, i + b] + _VALUE[alphabet[c]] * powers[i + b]
            hit = filters.passed(length, h)
            if len(hit):
                yield a + r[hit], [_replaced(part[x], y, alphabet[z]) for x, y, z in zip(r[hit], i[hit] + b, c[hit], strict=True)]


def _replaced(word: np.ndarray, at: int, letter: np.uint8) -> str:
    word = word.copy()
    word[at] = letter
    return word.tobytes().decode("latin-1")


def _prober(told, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters({k: np.frombuffer(v, _U) for k, v in told.value.items()})
        for batch in batches:
            words = batch.column("word").to_pylist()
            for _, at, letters in _by_length(words):
                for row, edited in edits(letters, filters, alphabet):
                    places = pa.array(at[row])
                    yield pa.RecordBatch.from_arrays([pa.array(edited, pa.string()), batch.column("word").take(places), batch.column("n").take(places)], names=["edit", "word", "n"])

    return run


# --- the operator ------------------------------------------------------------------------------


def _told(words: DataFrame) -> dict[int, bytes]:
    """The filters of a block of the vocabulary. What comes to the driver is no more than they are."""
    counts = words.groupBy(F.least(F.length("word"), F.lit(_LONGEST)).alias("shard")).agg(F.count("*").alias("n")).collect()  # a row per shard
    sizes = {r["shard"]: -(-r["n"] * BITS // (64 * _LANES)) for r in counts}
    out = {k: np.zeros(n * _LANES, _U) for k, n in sizes.items()}
    filled = words.select("word").mapInArrow(_filled(sizes), "shard int, at long, bits long").groupBy("shard", "at").agg(F.bit_or("bits").alias("bits"))
    for batch in _batches(filled):
        for s in np.unique(batch["shard"]):
            mine = batch["shard"] == s
            out[int(s)][batch["at"][mine]] = batch["bits"][mine].view(_U)
    return {k: v.tobytes() for k, v in out.items()}


def _batches(df: DataFrame, rows: int = 100_000) -> Iterator[dict[str, np.ndarray]]:
    held = []
    for r in df.toLocalIterator():
        held.append(r)
        if len(held) == rows:
            yield {c: np.array([x[c] for x in held], np.int64) for c in df.columns}
            held = []
    if held:
        yield {c: np.array([x[c] for x in held], np.int64) for c in df.columns}


def near_pairs(words: DataFrame, *, most: int = MOST) -> DataFrame:
    """(word, n, other, other_n): the near words of each word of a written vocabulary (word, n), both ways."""
    spark = words.sparkSession
    alphabet = np.array(sorted(ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.uint8)  # 90 letters at most
    n = words.count()
    found = None
    for b in range(-(-n // most)):
        block = words if n <= most else words.where(F.pmod(F.xxhash64("word"), F.lit(-(-n // most))) == b)
        told = spark.sparkContext.broadcast(_told(block))
        part = materialise(words.repartition("word").mapInArrow(_prober(told, alphabet), "edit string, word string, n long").join(
            block.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit"), "pairs")
        told.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    there = found.select("word", "n", F.col("edit").alias("other"), F.col("edit_n").alias("other_n"))
    return there.union(found.select("edit", "edit_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form) of words that have a form: the last of the forms' forms.

    Each form is at least ``RATIO`` times as frequent as its word, so chains are short (18 steps for any 64-bit count); a round doubles the way gone.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        now = after.select("word", "root")
        if not moved:
            return now


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = EVERY, most: int = MOST,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the documents.

    A null text has no words, an empty one neither; a null id counts as the id "". Repeated rows count each. Of near words of the same
    count the first in code-point order is the form. Very long runs are words like others: their edits are probed in stretches. An
    empty table gives no rows. Other columns aren't read.
    """
    bound_batches(docs.sparkSession)
    words = materialise(counted(docs, id_col, text_col, min_length=min_length, min_count=min_count, every=every), "vocabulary")
    near = near_pairs(words, most=most)
    best = near.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    best = best.select("word", "n_near", *[F.when(form_n >= ratio * F.col("n"), c).alias(name) for c, name in ((F.col("best.form"), "form"), (form_n, "form_n"))])
    best = materialise(best, "best")
    ends = roots(materialise(best.where("form is not null").select("word", "form"), "forms"))
    return (
        words.join(best, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


# --- the same in SQL ---------------------------------------------------------------------------


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 in DuckDB: bytes are taken in, and each is followed by eight steps of one bit (-1)."""
    taken = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: [CAST('0x' || b AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten({taken})), lambda c, x: {step}), 4294967295)"


_LETTERS = "[A-Za-zÀ-ÿ]"
ORACLE = f"""
WITH runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_LETTERS}+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
many AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
h AS (SELECT run, k, {crc32_sql("doc_id || ':' || run")} AS h FROM many),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, h % length(run)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
cut AS (SELECT DISTINCT word, n, i, left(word, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.short = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.short = b.word),
best AS (SELECT word, first(n) AS n, count(*) AS n_near, min({{'less': -other_n, 'form': other}}) AS b FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {RATIO} * v.n THEN b.form END AS form, CASE WHEN -b.less >= {RATIO} * v.n THEN -b.less END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS far FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.far WHERE f.form IS NOT NULL)
  SELECT c.word, c.far AS root FROM c JOIN f ON f.word = c.far WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN chain USING (word)
"""
