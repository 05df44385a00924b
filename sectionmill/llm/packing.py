"""Best-fit packing into token sequences, by minimum bin slack.

Only the number of pieces of each length matters for the plan, so the driver sees a
histogram of at most ``capacity`` counts, whatever the input's size. Bin by bin, the plan
starts from the greatest length left and a bitset dynamic program over the lengths left finds
the fullest combination that fits; the combination is taken as often as its lengths last.
Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import RUN, bound_batches, kind, materialise, run_starts, valid

CAPACITY, END_ID = 1024, 2
#: Characters of the words whose ids a process remembers (about 250 MB): the words of late, and those before. Fewer cost time, and no result.
REMEMBERED = 16_000_000
#: Words that are encoded in one text.
_TOGETHER = 200
_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _by_words(path: str) -> bool:
    """Whether the ids of a text are those of its words end to end.

    So it is for byte-level vocabularies without a normaliser: a pre-token holds a space at its
    start only, or else nothing but white space, and a run of white space leaves its last space to what follows.
    So a space or a line end between two visible characters always parts two pre-tokens.
    """
    with open(path) as f:
        told = json.load(f)
    pre = told.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return plain and not told.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].isascii() or set(t["content"]) & set(" \n") for t in told.get("added_tokens", []))


def _visible(c: str) -> bool:
    return "!" <= c <= "~" or c.isalnum()


#: A word with the space before it, or a line end; and what keeps a text from being cut into these.
_WORDS = re.compile(r" ?[^ \n]+|\n").findall
_OTHER_BLANKS = ("  ", " \n", "\n\n")


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers, by the tokenizers library from the
    vocabulary at ``path``.

    Where that can't change the ids, each word is encoded once a task and remembered; a text with other white
    space than single spaces and line ends between visible characters is encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.by_words = _by_words(path)
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids
        self.late: dict[str, bytes | None] = {}
        self.early: dict[str, bytes | None] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet, many in one line-separated text. A word that starts or ends
        with other white space, or what may be such, has no ids of its own."""
        odd = {w for w in words if w != "\n" and not (_visible(w[w[0] == " "]) and _visible(w[-1]))}
        self.late.update(dict.fromkeys(odd))
        fresh = list(words - odd - {"\n"})
        for i, raw in enumerate(self.whole(["\n".join(fresh[i : i + _TOGETHER]) for i in range(0, len(fresh), _TOGETHER)])):
            some = fresh[i * _TOGETHER : (i + 1) * _TOGETHER]
            ends = (np.flatnonzero(np.frombuffer(raw, "<u4") == self.line_end[0]) * 4).tolist()
            if len(self.line_end) == 1 and len(ends) == len(some) - 1:
                self.late.update(zip(some, map(raw.__getitem__, map(slice, [0, *(e + 4 for e in ends)], [*ends, len(raw)])), strict=True))
            else:
                self.late.update(zip(some, self.whole(some), strict=True))

    def joined(self, text: str, words: list[str] | None) -> bytes:
        if words is not None:
            try:
                return b"".join(map(self.late.__getitem__, words))
            except TypeError:  # one of them has no ids of its own
                pass
        return self.whole([text])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.whole(texts)
        if self.held > self.remembered // 2:  # words that come up again move over, all others are forgotten the next time
            self.early, self.late, self.held = self.late, {}, 0
        cut = [None if t.endswith(" ") or any(x in t for x in _OTHER_BLANKS) else _WORDS(t) for t in texts]
        missing = set().union(*(words for words in cut if words)) - self.late.keys()
        if missing:
            self.held += sum(map(len, missing))
            again = missing & self.early.keys()
            self.late.update(zip(again, map(self.early.__getitem__, again), strict=True))
            self.learn(missing - again)
            self.late["\n"] = np.array(self.line_end, "<u4").tobytes()
        return [self.joined(text, words) for text, words in zip(texts, cut, strict=True)]


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of a vocabulary; one for each process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].remembered = remembered
    return _encoders[path]


def _cutter(path: str, capacity: int, end_id: int, remembered: int = REMEMBERED):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, remembered), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                raw += end
                n = len(raw) // 4
                a, b, k = 0, (n - 1) % capacity + 1, 0
                while a < n:
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    a, b, k = b, b + capacity, k + 1
            ids_ = batch.column("id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32) of every document's ids and end id.

    A document of more than ``capacity`` ids is cut so that all pieces but the first are
    full. ``remembered`` bounds a Python worker's memory of words. A null text counts as empty: one piece, the end id. Broken UTF-8 counts as U+FFFD. A very long text
    is encoded whole, by the task that holds its row.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), valid(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer or default_tokenizer(), capacity, end_id, remembered), f"id {kind(rows, 'id')}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], must: int, capacity: int) -> dict[int, int]:
    """The fullest combination that holds one ``must``: length to number of pieces."""
    room = capacity - must
    reach, layers, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == must), room // length)
        many = 1
        while left > 0:
            take = min(many, left)
            after = (reach | reach << length * take) & full
            if after != reach:
                layers.append((length, take, reach))
                reach = after
            left -= take
            many *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {must: 1}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first_sequence, offset) that place all pieces.

    The piece with rank r in [from_rank, to_rank) goes to sequence first_sequence + r - from_rank.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        chosen = fullest(left, max(left), capacity)
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                rows.append((length, used[length], used[length] + times, sequence, offset))
                used[length] += times
                offset += length
            left[length] -= times * chosen[length]
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Sequences hold at most ``capacity`` ids without gaps. Ids may be of any type. Repeated rows and null ids
    are packed like any others, each row for itself; columns other than the two named aren't read. An empty
    table gives no rows. Pieces of one length are ranked by the place at which they were written, so
    which of them shares a sequence with which may differ from run to run.
    """
    spark = docs.sparkSession
    pieces = cut(docs, id_col, text_col, tokenizer=tokenizer, capacity=capacity, end_id=end_id, remembered=remembered)
    pieces = materialise(pieces.withColumn("at", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame([(k, v // RUN + 1) for k, v in histogram.items()], "length long, runs long")
    places = spark.createDataFrame(plan(histogram, capacity), "length long, from_rank long, to_rank long, first_sequence long, offset long")
    dealt = pieces.join(F.broadcast(runs), "length").withColumn("run", F.pmod(F.xxhash64("at"), F.col("runs"))).drop("runs")
    sizes = dealt.groupBy("length", "run").agg(F.count("*").alias("n"))
    firsts = materialise(run_starts(sizes, ["length"], "n").withColumnRenamed("start", "start_"), "ranks")
    place = F.row_number().over(Window.partitionBy("length", "run").orderBy("at"))
    ranked = dealt.withColumn("place", place).join(firsts, ["length", "run"]).withColumn("rank", F.col("start_") + F.col("place") - 1)
    # The plan has at most a few rows for each length: its size doesn't grow with the input.
    return (
        ranked.join(F.broadcast(places), (ranked.length == places.length) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
        .select(F.col("id").alias(id_col), "piece", "start", ranked.length.alias("length"), "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
    )
