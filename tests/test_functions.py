import re
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sectionmill.functions import nodeid as N
from sectionmill.functions import text as X
from sectionmill.functions import urls as U

IDS = {"AAB": [1], "AABAACAABAAB": [1, 2, 1, 1], "AABAACAACAABAAB": [1, 2, 2, 1, 1], "ABAZZZ": [26, 17575]}


def tidy(text):
    """The rules of postprocess, one after the other, in plain Python."""
    blank = r"[^\S\n]"
    text = re.sub(r"\{FN-(\d+)\}", r"[^\1]", text)
    text = re.sub(rf"{blank}+(\[\^\d+\])", r"\1", text)
    text = re.sub(rf"(\[\^\d+\]){blank}+([,.;:)\]])", r"\1\2", text)
    text = re.sub(rf"{blank}*\n{blank}*", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(rf"{blank}+", " ", text)).strip()



def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_paths_and_back(spark):
    rows = spark.createDataFrame([(k,) for k in IDS], "x string").select("x", N.nodeid_to_path(F.col("x")).alias("p")).withColumn("b", N.path_to_nodeid(F.col("p"))).collect()
    assert {r["x"]: r["p"] for r in rows} == IDS and all(r["x"] == r["b"] for r in rows)


@pytest.mark.parametrize("bad", ["", "AB", "ABCD", "abc", "12A", "A B", None, "AAB\n"])
def test_bad_ids_have_no_path(spark, bad):
    assert one(spark, bad, lambda x: N.nodeid_to_path(x)) is None


def test_wide_ids_number_more_siblings(spark):
    for n in (0, 675, 17575, 17576, 36000, 216000):
        seg = one(spark, n, lambda x: N.int_to_seg(x, wide=True), "long")
        assert seg == chr(65 + n // 676) + chr(65 + n // 26 % 26) + chr(65 + n % 26) and one(spark, "AAB" + seg, lambda x: N.nodeid_to_path(x, wide=True)) == [1, n]
        assert (one(spark, n, N.int_to_seg, "long"), one(spark, seg, N.is_valid)) == ((seg, True) if n < 17576 else (None, False))
    for bad in ("", "AB", "@AA", "Aaa", "1AA", "AAAaB", None):
        assert one(spark, bad, lambda x: N.nodeid_to_path(x, wide=True)) is None


def test_string_order_is_path_order(spark):
    rng = random.Random(5)
    ids = ["".join(chr(65 + rng.randrange(26)) for _ in range(3 * rng.randrange(1, 5))) for _ in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "x string").withColumn("p", N.nodeid_to_path(F.col("x")))
    assert [r["x"] for r in df.orderBy("x").collect()] == sorted(ids, key=lambda i: [(ord(i[j]) - 65) * 676 + (ord(i[j + 1]) - 65) * 26 + ord(i[j + 2]) - 65 for j in range(0, len(i), 3)])


def test_depth_parent_descendant_prefixes(spark):
    r = spark.createDataFrame([("AABAACAAD", "AAB")], "x string, y string").select(
        N.depth(F.col("x")).alias("d"), N.parent(F.col("x")).alias("p"), N.parent(F.col("y")).alias("root"), N.is_descendant(F.col("x"), F.col("y")).alias("in"),
        N.proper_prefixes(F.col("x"), 6).alias("six"), N.proper_prefixes(F.col("y"), 6).alias("none"),
    ).first()
    assert (r["d"], r["p"], r["root"], r["in"], r["six"], r["none"]) == (3, "AABAAC", None, True, ["AABAAC"], [])


@pytest.mark.parametrize(("label", "number", "heading"), [
    ("301. Scope of duty", "301", "Scope of duty"), ("1. X", "1", "X"), ("(1) X", "", "(1) X"), ("[15.001]. Nature", "15.001", "Nature"), ("1.5 foo", "1", "5 foo"),
    ("[7.01] Entry", "", "[7.01] Entry"), ("12A.x", "12A", "x"), (None, "", ""), ("1. a\n", "1", "a"), ("  plain \x1f", "", "plain"),
])
def test_number_and_heading(spark, label, number, heading):
    r = spark.createDataFrame([(label,)], "x string").select(*[c.alias(n) for c, n in zip(X.split_number_heading(F.col("x")), "nh", strict=True)]).first()
    assert (r["n"], r["h"]) == (number, heading)


def test_names_levels_counts(spark):
    title, volume = X.split_title_volume(F.col("x"))
    rows = spark.createDataFrame([("Agency (Volume 1 (2022))",), ("Agency (Part 2)",), (None,)], "x string").select(title, volume).collect()
    assert [tuple(r) for r in rows] == [("Agency", "Volume 1 (2022)"), ("Agency (Part 2)", None), ("", None)]
    assert [one(spark, v, X.extract_to_level) for v in ("1|2|3", "|", None)] == [4, 12, 12]
    assert [one(spark, v, X.has_descendant_counts) for v in ("0|0", "0|2", "x", "", None, "-1")] == [False, True, True, False, False, False]


def test_slug_short_id_jurisdiction_words(spark):
    assert [one(spark, v, X.slug) for v in ("Halls' Laws & Co.", "—", None, "a" * 79 + "--bcd")] == ["halls-laws-co", "untitled", "untitled", "a" * 79]
    assert [one(spark, v, X.short_id) for v in ("urn:contentItem:8T8B-3B32-00000-00", "plain-00000-00", None)] == ["8T8B-3B32", "plain", ""]
    assert [one(spark, v, X.jurisdiction) for v in ("Works of HONG Kong", "Works", None)] == ["Hong Kong", "England & Wales", "England & Wales"]
    assert [one(spark, v, X.word_count) for v in ("a b c\nd", "", " \t", None)] == [4, 0, 0, 0]


TIDY = ["a {FN-1} , b", "x  y  \n  z\n\n\n\nw ", "", "a[^2]  ) b", "{FN-12}"]


@pytest.mark.parametrize("text", TIDY)
def test_column_and_helper_tidy_alike(spark, text):
    assert one(spark, text, X.postprocess) == tidy(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t {}FN-1[^],.)", max_size=40), min_size=1, max_size=20))
def test_tidy_alike_on_random_text(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", X.postprocess(F.col("x")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in rows} == {i: tidy(t) for i, t in enumerate(texts)}


def test_assemble(spark):
    notes = "array<struct<n:string,text:string>>"
    rows = [("7", "7. Own", "b", []), ("7", "70 more", "b", [("1", "n")]), (None, " H ", None, None), ("7.", "", "", [])]
    df = spark.createDataFrame(rows, f"n string, h string, b string, f {notes}").select(X.assemble(F.col("n"), F.col("h"), F.col("b"), F.col("f")).alias("d"))
    assert [r["d"] for r in df.collect()] == ["# 7. Own\n\nb\n", "# 7. 70 more\n\nb\n\n[^1]: n\n", "# H\n", "# 7.\n"]


def test_triage(spark):
    rows = [("u", "t", '<p class="a SS_HK b">'), ("https://x/idp/y", "t", ""), ("u", "Sign in", "x"), ("u", "t", "Access Denied"), (None, None, None), ("u", "t", '<p class="SS_HKX">')]
    df = spark.createDataFrame(rows, "u string, t string, h string").select(X.triage(F.col("u"), F.col("t"), F.col("h")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["ok", "session_expired", "session_expired", "blocked", "not_found", "not_found"]


def test_viewer_urls(spark):
    df = spark.createDataFrame([("5X-1", "AABAAC", "H.15.001 é")], "u string, n string, s string").withColumn("url", U.build_viewer_url(F.col("u"), F.col("n"), F.col("s")))
    r = df.select("url", U.parse_viewer_url(F.col("url")).alias("p")).first()
    assert "pddocfullpath=%2Fshared%2Fdocument%2Fanalytical-materials-uk%2Furn:contentItem:5X-1&" in r["url"] and "H.15.001%20%C3%A9&" in r["url"]
    assert tuple(r["p"]) == ("urn:contentItem:5X-1", "AABAAC", U.FEATURE_ID, U.CONTENT_SET + "urn:contentItem:5X-1", "H.15.001 é")
    assert one(spark, "/other/path", lambda x: U.build_viewer_url_from_path(x, F.lit("AAB"))) is None
    assert one(spark, "/apac/document/?pddocfullpath=%2Fshared%2Fdocument%2Fhk%2Furn:contentItem:A&x=1", lambda x: U.build_viewer_url_from_path(x, F.lit("AAB"))).count("analytical") == 0
    assert one(spark, "https://x/?pdmfid=&pdmfid=7#pdmfid=8", lambda x: U.parse_viewer_url(x)["pdmfid"]) == "7"
    assert one(spark, "no query", lambda x: U.parse_viewer_url(x)["urn"]) is None


def test_contents_urls(spark):
    path = "/shared/tableofcontents/urn:contentItem:A-1"
    assert tuple(one(spark, path, lambda x: U.parse_toc_url(U.build_toc_url(x)))) == (path, U.FEATURE_ID)
    import base64

    assert one(spark, path * 3, U.tocid_b64) == base64.b64encode((path * 3).encode()).decode()
    assert one(spark, "https://x/?pddocfullpath=urn%3AcontentItem%3AA", U.looks_like_section_href) is True
