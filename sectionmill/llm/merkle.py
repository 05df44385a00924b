"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame operations only.

A text's paragraphs are its lines, with the line ends that follow. A section ends with a paragraph that is
followed by an empty line, or whose own hash ends it (one paragraph in four): so sections depend on what they
hold and an insertion moves no boundary but its own. Leaves are sentence-like runs of a paragraph, up to
``RUN`` characters up to and with the stops that follow. A paragraph's hash is that of its leaves' hashes, a
section's that of its paragraphs', and the root's that of its sections'.

The fingerprint is the tree: the root's hash, a colon, then sections separated by ``;``, each as its hash and a ``=``,
with paragraphs separated by ``,``, each as its hash and those of its leaves, all of eight hex digits. Roots test
equality; where they differ, the walk goes down into branches alone whose hashes the other tree lacks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import content_key, materialise

RUN, DIGITS = 200, 8
_PARAGRAPH = r"[^\n]*\n+|[^\n]+"
_LEAF = rf"[^.!?\n]{{0,{RUN}}}[.!?\n]+|[^.!?\n]{{1,{RUN}}}"
#: First digits of a paragraph's hash that end a section.
_ENDS = ["0", "1", "2", "3"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _short(hash_: Column) -> Column:
    return F.substring(hash_, 1, DIGITS)


def paragraphs(text: Column) -> Column:
    """The text's paragraphs as structs: hash, line ends that follow it, and its branch of the fingerprint."""

    def of(paragraph: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(paragraph, F.lit(_LEAF), F.lit(0)), lambda x: F.md5(x))
        ends = F.endswith(paragraph, F.lit("\n\n"))
        return _let(leaves, lambda h: _let(F.md5(F.array_join(h, "")), lambda own: F.struct(
            own.alias("hash"), (ends | F.substring(own, 1, 1).isin(*_ENDS)).alias("ends"), F.concat(_short(own), F.array_join(F.transform(h, _short), "")).alias("branch"))))

    return F.transform(F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0)), of)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null text has that of an empty one."""

    def sections(p: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == F.size(p)) | F.get(p, i - 1)["ends"])
        return _let(last, lambda at: F.transform(at, lambda end, j: _let(
            F.slice(p, F.coalesce(F.get(at, j - 1), F.lit(0)) + 1, end - F.coalesce(F.get(at, j - 1), F.lit(0))),
            lambda part: F.struct(F.md5(F.array_join(F.transform(part, lambda x: x["hash"]), "")).alias("hash"), F.array_join(F.transform(part, lambda x: x["branch"]), ",").alias("branches")))))

    def tree(s: Column) -> Column:
        root = F.md5(F.array_join(F.transform(s, lambda x: x["hash"]), ""))
        return F.concat(root, F.lit(":"), F.array_join(F.transform(s, lambda x: F.concat(_short(x["hash"]), F.lit("="), x["branches"])), ";"))

    empty = F.concat(F.md5(F.lit("")), F.lit(":"))
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(_let(paragraphs(text), lambda p: _let(sections(p), tree)))


def _parts(value: Column, joint: str) -> Column:
    return F.filter(F.split(value, joint), lambda x: x != "")


def _tree(print_: Column) -> Column:
    return F.substring_index(print_, ":", -1)


def leaf_digits(print_: Column) -> Column:
    """The leaves' hashes of a fingerprint, in order."""
    found = F.transform(F.regexp_extract_all(_tree(print_), F.lit("[0-9a-f=]+"), F.lit(0)), lambda b: F.substring(F.substring_index(b, "=", -1), DIGITS + 1, 1 << 30))
    return F.regexp_extract_all(F.array_join(found, ""), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """From two fingerprints: 1 if the roots agree, else the share of their leaves in both (0 to 1)."""
    shared = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)).cast("double")
    part = _let(leaf_digits(a), lambda x: _let(leaf_digits(b), lambda y: shared(x, y)))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(part)


def differing(a: Column, b: Column) -> Column:
    """Where the first text differs from the second: its leaves that the walk from the root ends at,
    as places ``section.paragraph.leaf`` from 0.

    The walk passes over a section whose hash the other tree has, then over the paragraphs of the others whose hash the
    other tree has, and looks at the leaves of those that are left. Equal roots give no place.
    """
    head = lambda x: F.substring(x, 1, DIGITS)
    sections = lambda t: _parts(_tree(t), ";")
    in_section = lambda s: F.split(F.substring_index(s, "=", -1), ",")
    known_sections = F.transform(sections(b), head)
    known_paragraphs = F.transform(F.flatten(F.transform(sections(b), in_section)), head)
    places = lambda ks, kp, kl: F.flatten(F.transform(sections(a), lambda s, i: F.when(F.array_contains(ks, head(s)), F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(in_section(s), lambda p, j: F.when(F.array_contains(kp, head(p)), F.array().cast("array<string>")).otherwise(
            F.filter(F.transform(F.regexp_extract_all(F.substring(p, DIGITS + 1, 1 << 30), F.lit(f".{{{DIGITS}}}"), F.lit(0)), lambda leaf, k: F.when(
                ~F.array_contains(kl, leaf), F.concat_ws(".", i.cast("string"), j.cast("string"), k.cast("string")))), lambda x: x.isNotNull())))))))
    walk = _let(known_sections, lambda ks: _let(known_paragraphs, lambda kp: _let(leaf_digits(b), lambda kl: places(ks, kp, kl))))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<string>")).otherwise(walk)


def neighbours(units: DataFrame) -> DataFrame:
    """``units`` (nameless, id, k1, k2, size; one row per key) gives (k1, k2, owner1, owner2, owner_size): the key
    of the row that comes before each one in descending order of ids (null ids last, ties by the hashes), the
    last one before the first. Only these narrow rows are put in order; ranges are sorted apart
    and meet in a table of a row per range."""
    order = [F.col("nameless"), F.col("id").desc(), F.col("k1"), F.col("k2")]
    ordered = materialise(units.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "order")
    ranges = ordered.groupBy(F.shiftright("at", 33).alias("range")).agg(F.max("at").alias("last"))
    one = Window.partitionBy(F.lit(0)).orderBy("range")  # a row per range
    before = F.lag("last").over(one)
    ranges = ranges.select("range", F.coalesce(before, F.max("last").over(Window.partitionBy(F.lit(0)))).alias("previous"))
    first = F.pmod("at", F.lit(1 << 33)) == 0
    owner = ordered.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(ranges), "range")
    owner = owner.select("k1", "k2", F.when(first, F.col("previous")).otherwise(F.col("at") - 1).alias("at"))
    return owner.join(ordered.select("at", F.col("k1").alias("owner1"), F.col("k2").alias("owner2"), F.col("size").alias("owner_size")), "at").drop("at")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, parts: int = 3) -> DataFrame:
    """(id, text, edited, next_fingerprint) for each row.

    ``edited`` replaces the last floor(n / parts) characters by the first as many, or all, of the
    next row in descending order of ids (after the last: the first). A null text counts as empty. Ids may
    be of any type; null ids come last, and rows of one id follow one another by hashes of their texts. Of rows equal in
    id and text, all but one are followed by their like. Each text is shuffled once; of the
    next one only the characters that are used travel on, and its fingerprint.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = content_key(F.col(id_col), text)
    rows = docs.select(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    narrow = rows.groupBy("k1", "k2").agg(F.first("nameless").alias("nameless"), F.min("id").alias("id"), F.first(F.length("text")).alias("size"))
    order = materialise(neighbours(narrow), "neighbours")
    # Both joins need the same columns by the same keys, so the texts are shuffled once for the two.
    texts = rows.select("k1", "k2", "id", "text")
    number = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    head = F.left(F.col("text"), F.floor(F.col("owner_size") / parts).cast("int"))
    sent = texts.join(order.hint("merge"), ["k1", "k2"]).withColumn("number", number).where("number = 1")
    sent = sent.select(F.col("owner1").alias("k1"), F.col("owner2").alias("k2"), head.alias("head"), fingerprint(F.col("text")).alias("next_fingerprint"))
    met = texts.join(sent.hint("merge"), ["k1", "k2"]).withColumn("last", number == 1)
    cut = F.floor(F.length("text") / parts).cast("int")
    tail = F.when(F.col("last"), F.col("head")).otherwise(F.left(F.col("text"), cut))
    return met.select(F.col("id").alias(id_col), "text", F.concat(F.left(F.col("text"), F.length("text") - cut), tail).alias("edited"), F.when(F.col("last"), F.col("next_fingerprint")).alias("next_fingerprint"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, changed) of each row.

    ``changed`` holds the places of the text's leaves that the edited text lacks. Nulls, repeated
    rows, ties and ids are as in :func:`edits`: every row has its own result. An empty table gives no
    rows; a very long text has one fingerprint string, about a tenth as long. Other columns aren't read.
    """
    both = edits(docs, id_col, text_col).withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    a, b = F.col("fingerprint"), F.col("edited_fingerprint")
    return both.select(
        id_col, F.length("text").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint", likeness(a, b).alias("near_edited"),
        F.when(F.col("next_fingerprint").isNull(), 1.0).otherwise(likeness(a, F.col("next_fingerprint"))).alias("near_next"), differing(a, b).alias("changed"),
    )


# --- the same in SQL -------------------------------------------------------------------------

_SQL = {name: pattern.replace(r"\n", "' || chr(10) || '") for name, pattern in (("paragraph", _PARAGRAPH), ("leaf", _LEAF))}


def _paragraphs_sql(t: str) -> str:
    leaves = f"list_transform(regexp_extract_all(p, '{_SQL['leaf']}'), lambda x: md5(x))"
    step = f"list_transform(regexp_extract_all({t}, '{_SQL['paragraph']}'), lambda p: {{'p': p, 'h': {leaves}}})"
    step = f"list_transform({step}, lambda q: {{'p': q.p, 'h': q.h, 'own': md5(array_to_string(q.h, ''))}})"
    ends = ", ".join(f"'{d}'" for d in _ENDS)
    return f"""list_transform({step}, lambda q: {{'own': q.own, 'stop': ends_with(q.p, chr(10) || chr(10)) OR q.own[1] IN ({ends}),
      'branch': q.own[1:{DIGITS}] || coalesce(array_to_string(list_transform(q.h, lambda x: x[1:{DIGITS}]), ''), '')}})"""


def _print_sql(p: str, at: str) -> str:
    parts = f"list_transform(range(1, len({at}) + 1), lambda j: list_slice({p}, coalesce({at}[j - 1], 0) + 1, {at}[j]))"
    sections = f"list_transform({parts}, lambda s: {{'h': md5(array_to_string(list_transform(s, lambda x: x.own), '')), 'b': array_to_string(list_transform(s, lambda x: x.branch), ',')}})"
    return f"""(SELECT md5(coalesce(array_to_string(list_transform(s, lambda x: x.h), ''), '')) || ':' || coalesce(array_to_string(list_transform(s, lambda x: x.h[1:{DIGITS}] || '=' || x.b), ';'), '')
      FROM (SELECT {sections} AS s))"""


def _at_sql(p: str) -> str:
    return f"list_filter(range(1, len({p}) + 1), lambda i: i = len({p}) OR {p}[i].stop)"


def _leaves_sql(f: str) -> str:
    tree = f"string_split({f}, ':')[2]"
    cut = f"list_transform(regexp_extract_all({tree}, '[0-9a-f=]+'), lambda b: string_split(b, '=')[-1][{DIGITS + 1}:])"
    return f"regexp_extract_all(coalesce(array_to_string({cut}, ''), ''), '.{{{DIGITS}}}')"


def _like_sql(a: str, b: str, x: str, y: str) -> str:
    return f"""CASE WHEN string_split({a}, ':')[1] = string_split({b}, ':')[1] THEN 1.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE)
      / greatest(len(list_distinct(list_concat({x}, {y}))), 1) END"""


def _differing_sql(a: str, b: str, leaves: str) -> str:
    sections = lambda f: f"list_filter(string_split(string_split({f}, ':')[2], ';'), lambda x: x <> '')"
    pars = "string_split(string_split(s.v, '=')[2], ',')"
    ks = f"list_transform({sections(b)}, lambda x: x[1:{DIGITS}])"
    kp = f"list_transform(flatten(list_transform({sections(b)}, lambda x: string_split(string_split(x, '=')[2], ','))), lambda x: x[1:{DIGITS}])"
    numbered = lambda xs: f"list_transform({xs}, lambda v, n: {{'v': v, 'n': n - 1}})"
    open_sections = f"list_filter({numbered(sections(a))}, lambda s: NOT list_contains({ks}, s.v[1:{DIGITS}]))"
    open_pars = f"flatten(list_transform({open_sections}, lambda s: list_transform(list_filter({numbered(pars)}, lambda p: NOT list_contains({kp}, p.v[1:{DIGITS}])), lambda p: {{'at': s.n || '.' || p.n, 'v': p.v[{DIGITS + 1}:]}})))"
    cut = f"regexp_extract_all(p.v, '.{{{DIGITS}}}')"
    return f"""CASE WHEN string_split({a}, ':')[1] = string_split({b}, ':')[1] THEN '' ELSE coalesce(array_to_string(flatten(list_transform({open_pars},
      lambda p: list_transform(list_filter({numbered(cut)}, lambda leaf: NOT list_contains({leaves}, leaf.v)), lambda leaf: p.at || '.' || leaf.n))), ','), '') END"""


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM t WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(next, length(text) // 3) AS edited FROM o),
h AS (SELECT doc_id, text, edited, {_paragraphs_sql("text")} AS a, {_paragraphs_sql("edited")} AS b, {_paragraphs_sql("next")} AS c FROM e),
g AS (SELECT *, {_at_sql("a")} AS aa, {_at_sql("b")} AS ab, {_at_sql("c")} AS ac FROM h),
p AS (SELECT doc_id, text, edited, {_print_sql("a", "aa")} AS fa, {_print_sql("b", "ab")} AS fb, {_print_sql("c", "ac")} AS fc FROM g),
l AS (SELECT *, {_leaves_sql("fa")} AS la, {_leaves_sql("fb")} AS lb, {_leaves_sql("fc")} AS lc FROM p)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CAST({_like_sql("fa", "fb", "la", "lb")} AS DOUBLE) AS near_edited, CAST({_like_sql("fa", "fc", "la", "lc")} AS DOUBLE) AS near_next,
  {_differing_sql("fa", "fb", "lb")} AS changed FROM l
"""
