import itertools
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sectionmill.operators import audit, corpus, manifest, pages, records, sections
from sectionmill.schemas import FOOTNOTES, MANIFEST_EVENTS, TOC_NODES
from sectionmill.sources import tables, toc
from sectionmill.store import ConflictError, Store
from sectionmill.streaming import replay, streams

DOC = "/shared/document/set/urn:contentItem:DOC-1"


def nodes(spark, rows):
    """rows: nodeid, label, urn and more by name."""
    full = [("Pub", r["nodeid"][:3], "Works (Volume 2)", i, r["nodeid"], r.get("label"), r.get("urn"), r.get("url"), r.get("anchor_id"), r.get("has_children", False), None, r.get("max_level")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, TOC_NODES)


BASIC = [
    {"nodeid": "AAB", "label": "Works", "has_children": True}, {"nodeid": "AABAAC", "label": "1. Basics", "has_children": True}, {"nodeid": "AABAACAAB", "label": " old ", "has_children": True},
    {"nodeid": "AABAACAAB", "label": "(1) Terms", "has_children": True}, {"nodeid": "AABAACAABAAC", "label": "2. Second", "urn": "urn:contentItem:B"}, {"nodeid": "AABAACAABAAB", "label": "1. First", "urn": "urn:contentItem:A"},
    {"nodeid": "AABAACAABAAB", "label": "1. First copy", "urn": "urn:contentItem:A"}, {"nodeid": "AABAAD", "label": "5. Branch", "urn": "urn:contentItem:C", "anchor_id": "X.5", "has_children": True}, {"nodeid": "bad", "label": "x", "urn": "urn:contentItem:Z"},
]


def test_sections(spark):
    df = nodes(spark, BASIC)
    found = {r["section_key"]: r for r in sections.build_sections(df).collect()}
    assert set(found) == {"urn:contentItem:A#AABAACAABAAB", "urn:contentItem:B", "urn:contentItem:C"}
    first = found["urn:contentItem:A#AABAACAABAAB"]
    assert (first["number"], first["heading"], first["hierarchy"], first["title"], first["volume"]) == ("1", "First copy", ["1. Basics", "(1) Terms"], "Works", "Volume 2") or first["heading"] == "First"
    assert first["seq"] == 5 and found["urn:contentItem:C"]["body_only"] and found["urn:contentItem:C"]["hierarchy"] == []
    assert [r["nodeid"] for r in sections.rejects(df).collect()] == ["bad"]
    assert [r["nodeid"] for r in sections.stranded(df).collect()] == ["AABAAD"]
    again = {r["section_key"]: r for r in sections.build_sections(df.orderBy(F.rand(3)).repartition(7)).collect()}
    assert again == found
    assert sections.build_sections(df.limit(0)).count() == 0


def test_titles(spark):
    t = spark.createDataFrame([("p", 0, "", " The Work ", ""), ("p", 1, "AAB", "Agency (Volume 1)", "1|2"), ("p", 2, "AAC", "Subagents", ""), ("p", 3, "AABAAB", "x", "")], "publication_id string, seq long, nodeid string, title string, countsbylevel string")
    cat = sections.title_catalog(t)
    assert {(r["nodeid"], r["publication"]) for r in cat.collect()} == {("AAB", "The Work"), ("AAC", "The Work")}
    names = lambda want: {r["name"] for r in sections.select_titles(cat, want).collect()}
    assert names("AGENT") == {"Subagents"} and names("agen") == {"Agency (Volume 1)"} and names("zzz") == set() and len(names(None)) == 2


def test_titles_without_states_have_not_started(spark):
    cat = spark.createDataFrame([("AAB", "Agency (Volume 1)"), ("AAC", "Bailment")], "nodeid string, name string")
    counts = spark.createDataFrame([("Agency", 1, 1, 0, 2)], "title string, done long, failed long, pending long, total long")
    got = {r["nodeid"]: (r["done"], r["failed"], r["status"]) for r in manifest.titles_with_counts(cat, counts).collect()}
    assert got == {"AAB": (1, 1, "has failures"), "AAC": (0, 0, "not started")}


def test_merge_first_delivery_wins(spark):
    df = nodes(spark, [{"nodeid": "AAB", "label": "late"}, {"nodeid": "AAB", "label": "early"}]).withColumn("batch_seq", F.when(F.col("label") == "early", 1).otherwise(2))
    assert [r["label"] for r in sections.merge_batches(df).collect()] == ["early"]


def api(*roots):
    return json.dumps({"tocEntity": {"tocContainer": {"tocNodes": list(roots)}}})


def responses(spark, *bodies):
    return spark.createDataFrame([("Pub", "AAB", "Works", i, b) for i, b in enumerate(bodies)], "publication string, title_nodeid string, title_name string, batch_seq int, body string")


def test_api_json(spark):
    leaf = {"nodeId": "AABAAB", "nodeTitle": "1. Leaf", "docFullPath": DOC, "anchorId": "A.1", "hasChildren": "no"}
    body = api({"nodeId": "AAB", "level": 1, "hasChildren": "yes", "tocDescendantInfo": [{"nodeLevel": 2, "count": 1}, {"nodeLevel": 3}], "nodes": [leaf, {"nodeTitle": "no id", "nodes": [{"nodeId": "AABAAD", "countsByLevel": "0|x"}]}]})
    rows = toc.toc_nodes_from_api_json(responses(spark, body, "not json", None)).orderBy("seq").collect()
    assert [r["nodeid"] for r in rows] == ["AAB", "AABAAB", "AABAAD"]
    top, leaf_row, last = rows
    assert (top["has_children"], top["max_level"], top["level"], top["urn"]) == (True, 3, 1, None)
    assert (leaf_row["has_children"], leaf_row["urn"], leaf_row["level"]) == (False, "urn:contentItem:DOC-1", 2) and leaf_row["url"].endswith("pdscrollreferenceid=A.1&pdisdocsliderrequired=true")
    assert last["has_children"] is True


def test_page_model_and_dom(spark):
    tree = {"a": 1, "tocnodes": [{"id": "ROOT", "props": {"linktemplatetitle": 'Work "}" {'}, "collections": {"nodehierarchy": [{"id": "AAB", "props": {"linktemplatetitle": "T", "haschildren": True}, "collections": {"nodehierarchy": [{"id": "AAC", "props": {"linktemplatetitle": "1. L", "islink": True, "linktemplatehrefvalue": DOC}}]}}]}}]}
    html = "<script>var q=1;</script><script>z(); this.add('page.model', " + json.dumps(tree) + "); more({});</script>"
    dom = f"<p {toc.NODE_ATTR}='AAB'>Top <b>node</b></p><a href='/x?pddocfullpath={DOC.replace('/', '%2F')}&amp;pdtocnodeidentifier=AABAAC'>Leaf</a><a href='/y'>no</a>"
    broken = "<script>this.add('page.model', {oops});</script>" + dom
    rows = toc.toc_nodes_from_pages(responses(spark, html, dom, broken)).orderBy("batch_seq", "seq").collect()
    assert [(r["batch_seq"], r["nodeid"], r["label"], r["urn"]) for r in rows] == [
        (0, "AAB", "T", None), (0, "AABAAC", "1. L", "urn:contentItem:DOC-1"), (1, "AAB", "Top node", None), (1, "AABAAC", "Leaf", "urn:contentItem:DOC-1"), (2, "AAB", "Top node", None), (2, "AABAAC", "Leaf", "urn:contentItem:DOC-1")]
    assert [r["title"] for r in toc.model_catalog(responses(spark, html)).where("nodeid = ''").collect()] == ['Work "}" {']


def chain(depth, wide, make):
    """A tree of that depth: each node but the last has ``wide`` leaves before its one branch."""
    node = make("AAB", [])
    for _ in range(depth - 1):
        node = make("AAA", [make("ABC", []) for _ in range(wide)] + [node])
    return node


def test_deep_trees_keep_their_order(spark):
    names = itertools.count()
    body = api(chain(12, 3, lambda i, below: {"nodeId": f"{i}{next(names):03d}", "nodes": [*below, "junk"], "hasChildren": False}), 5, {"nodeId": 7, "level": "2", "docFullPath": None})

    def walk(below):
        for n in below:
            if isinstance(n, dict):
                yield str(n["nodeId"])
                yield from walk(n.get("nodes", []))

    rows = toc.toc_nodes_from_api_json(responses(spark, body, body)).where("batch_seq = 1").orderBy("seq").collect()
    assert [r["nodeid"] for r in rows] == list(walk(json.loads(body)["tocEntity"]["tocContainer"]["tocNodes"]))
    assert [r["seq"] for r in rows] == list(range(46)) and rows[0]["has_children"] is True and rows[-1]["level"] == 0
    assert "Python" not in toc.toc_nodes_from_api_json(responses(spark, body))._jdf.queryExecution().toString()


def test_models_where_lists_nest(spark):
    page = lambda tree: "<script>this.add('page.model', " + json.dumps(tree) + ");</script>"
    ids = lambda *found: [{"id": i, "collections": {"nodehierarchy": [{"id": "AAC", "props": {"haschildren": 1, "islink": "false", "linktemplatehrefvalue": DOC}}]}} for i in found]
    near = {"x": [{"y": {"tocnodes": ids("AAZ")}}], "z": {"tocnodes": ids("AAB"), "deeper": {"tocnodes": ids("AAY")}}}
    equal = {"a": [1, {"tocnodes": ids("AAD")}, {"tocnodes": ids("AAE")}], "tocnodes": "none"}
    rows = toc.toc_nodes_from_pages(responses(spark, page(near), page(equal), page({"no": {"tocnodes": 3}}), page({"tocnodes": []}))).orderBy("batch_seq", "seq").collect()
    assert [(r["batch_seq"], r["nodeid"], r["has_children"], r["urn"]) for r in rows] == [
        (0, "AAB", False, None), (0, "AABAAC", True, "urn:contentItem:DOC-1"), (1, "AAD", False, None), (1, "AADAAC", True, "urn:contentItem:DOC-1")]
    assert toc.toc_nodes_from_pages(responses(spark).limit(0)).count() == 0


def test_seeds(spark):
    lines = ["# no", "", " https://a ", "T | https://b", "T|https://c|Volume 1| x"]
    rows = tables.seed_columns(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in rows] == [("Untitled", "https://a", None), ("T", "https://b", None), ("T", "https://c", "Volume 1")]


# --- manifest --------------------------------------------------------------------------------


def random_events(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        urn = f"u{rng.randrange(6)}"
        key = urn if rng.random() < 0.5 else f"{urn}#n{rng.randrange(3)}"
        kind = rng.choice(["harvested", "harvested", "done", "failed"])
        h = kind == "harvested"
        out.append((i, float(i), kind, key, urn if h else None, f"n{i}" if h else None, "t" if h else None, None, f"h{i}" if h else None, None, rng.choice([None, "{}"]) if kind == "done" else None, "e" * 1200 if kind == "failed" else None))
    return out


def as_dict(df):
    return {r["section_key"]: r.asDict() for r in df.collect()}


def fold_rows(state, events):
    """Apply ordered events to rows by key, in place."""
    for e in events:
        key, kind = e["section_key"], e["kind"]
        row = state.get(key)
        if kind == manifest.SUPERSEDED:
            if row is not None and row["status"] != "done":
                del state[key]
        elif kind == "harvested":
            bare = e["urn"]
            if key != bare and bare in state and state[bare]["urn"] == bare and state[bare]["status"] != "done":
                del state[bare]
            if row is None:
                state[key] = dict.fromkeys(manifest.COLUMNS) | {"section_key": key, "urn": e["urn"], "status": "pending", "updated_at": e["ts"]} | {c: e[c] for c in manifest.META}
            elif row["status"] != "done":
                row |= {c: e[c] for c in manifest.META}
        elif row is not None and kind == "done":
            row |= {"status": "done", "record": e["record"], "error": None, "updated_at": e["ts"]}
        elif row is not None and kind == "failed":
            row |= {"status": "failed", "error": (e["error"] or "")[:1000], "updated_at": e["ts"]}
    return state


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_sequence_stream_and_upsert(spark, seed):
    raw = random_events(300, seed)
    names = [c.split()[0] for c in MANIFEST_EVENTS.split(", ")]
    want = fold_rows({}, [dict(zip(names, r, strict=True)) | {"urn": r[4] or r[3].split("#")[0]} for r in raw])
    shuffled = raw[:]
    random.Random(seed).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, MANIFEST_EVENTS)
    assert as_dict(manifest.fold(df)) == want
    assert as_dict(replay.replay_manifest(df)) == want
    half = manifest.fold(df.where("seq < 150"))
    assert as_dict(manifest.upsert(half, df.where("seq >= 150"))) == want


def test_rules_of_the_fold(spark):
    def fold(*events):
        rows = [(i, float(i), k, key, urn if k == "harvested" else None, None, "t", None, f"h{i}", None, rec, err) for i, (k, key, urn, rec, err) in enumerate(events)]
        return as_dict(manifest.fold(spark.createDataFrame(rows, MANIFEST_EVENTS)))

    h, d, f = ("harvested", "u", "u", None, None), ("done", "u", None, "{}", None), ("failed", "u", None, None, "x")
    assert fold(h, h)["u"]["heading"] == "h1" and fold(h, h)["u"]["updated_at"] == 0.0
    assert fold(h, d, h)["u"] | {} == fold(h, d)["u"] and fold(d, f) == {}
    r = fold(h, d, f)["u"]
    assert (r["status"], r["record"], r["error"]) == ("failed", "{}", "x")
    assert fold(h, f, h)["u"]["status"] == "failed" and set(fold(h, ("harvested", "u#n", "u", None, None))) == {"u#n"} and set(fold(h, d, ("harvested", "u#n", "u", None, None))) == {"u", "u#n"}
    assert fold() == {}


def test_reports(spark):
    m = spark.createDataFrame([("a", "t", "done", '{"id":"1"}'), ("b", "t", "failed", None), ("c", None, "pending", None), ("d", "", "done", "no json"), ("e", "t", "done", None)], "section_key string, title string, status string, record string")
    assert {r["title"]: (r["done"], r["failed"], r["pending"], r["total"]) for r in manifest.title_counts(m).collect()} == {"t": (2, 1, 0, 3), "Unknown": (1, 0, 1, 2)}
    assert [r["section_key"] for r in tables.done_records(m).collect()] == ["a"] and tables.undecodable_records(m).first()["n"] == 1
    s = spark.createDataFrame([(k,) for k in "abcx"], "section_key string")
    assert sorted(r[0] for r in manifest.select_work(s, m).collect()) == ["b", "c", "x"] and [r[0] for r in manifest.select_work(s, m, only_failed=True).collect()] == ["b"]
    assert tuple(manifest.work_counts(s, m).first()) == (4, 3, 1)
    old = spark.createDataFrame([("u", "n", "t", "1", "h", "s", None, None, 1.0)], "urn string, nodeid string, title string, number string, heading string, source_url string, status string, error string, updated_at double")
    r = manifest.migrate(old).first()
    assert (r["section_key"], r["status"], r["record"]) == ("u", "pending", None)


# --- parser ----------------------------------------------------------------------------------

SHARED = """<html><body><div class="SS_HK"><header class="SS_DocumentHeader"><h1>(1) Kinds</h1></header>
<a id="W.15.001"></a><br /><h2 class="SS_Banner">[15.001] Kinds of kite</h2>
<p class="SS_IndentFirstLine">First kite text <a class="SS_FootnoteReference" id="fnref_W.15.001.F1-R" href="#"></a>.</p>
<footer class="SS_Footnote"><ol><li><span><a class="SS_FootnoteDefinition" id="fndef_W.15.001.F1">1</a></span> <span class="SS_FootnoteBody">A <a href="#">linked</a> note.</span></li>
<li><span class="SS_FootnoteBody">continued</span></li></ol></footer>
<a id="W.15.002"></a><br /><h2 class="SS_Banner">[15.002] Others</h2><p>Second kite text.</p></div></body></html>"""
ANNOTATED = """<div class="SS_contentdocument"><div class="SS_HK"><span><a id="K.S5"></a><br><h2 class="SS_Banner">5. Words</h2><div class="SS_Indent"><span class="SS_LegisCitatorLink"><img src="/c.png">View Citator</span><p>Old words keep their <span class="SS_it">sense</span>.</p>
<div data-id="HideShow_Commentary"><div class="SS_CommentaryContent"><a id="K.S5.C_5-01"></a><span class="SS_Heading"><span class="SS_bf">[5.01] Origin</span></span> <p>Made in spring.</p><a id="K.S5.C_5-02"></a><span class="SS_Heading"><span class="SS_bf">[5.02] Uses</span></span><p>Used in <a class="SS_EmbeddedLink" href="#">summer</a>.</p></div></div></div>
<a id="K.S50"></a><br><h2 class="SS_Banner">50. More</h2><div class="SS_Indent"><ul class="SS_List"><li><span class="SS_ListLabel">(1)</span><span class="SS_ListItemContent">Kites fly.</span></li></ul><dl><dt><a id="K.S50.KITE"></a>kite</dt><dd>a toy</dd><dt><a id="K.S50.LINE"></a>line</dt><dd>a cord</dd></dl><div style="display: none;">hidden</div></div></span></div></div>"""


WORK = "doc string, section_key string, heading string, anchor string, body_only boolean"


@pytest.fixture(scope="module")
def parsed(spark):
    asked = [
        ("s", "W.15.001", "Kinds of kite", False), ("s", "W.15.002", None, False), ("s", "W.9", None, False), ("a", "K.S5", None, True), ("a", "K.S5.C_5-01", None, False), ("a", "K.S5.C_5-02", None, False),
        ("a", "K.S50", None, False), ("a", "K.S50.KITE", None, False), ("a", "K.S50.LINE", None, False), ("t", None, None, False), ("n", None, None, False), ("x", None, None, False), ("b", None, "Own", False),
    ]
    titled = '<h1 class="documentTitle"> The <b>title</b> </h1><div class="SS_HK"><p class="SS_DraftingNote">draft</p><p>x&nbsp;&#8212;&#x2014;&bogus;</p></div>'
    nested = '<div class="SS_HK"><a id="U.1"></a><p>one</p><div><h2>Of two</h2><div><a id="U.2"></a><p>two</p></div></div><ul><li><a id="U.3"></a>three<ul><li>inner</li></ul></li><li><a id="U.4"></a>four</li></ul><p>tail</p></div>'
    docs = spark.createDataFrame([("s", SHARED), ("a", ANNOTATED), ("t", titled), ("n", nested), ("b", "<p>bare</p>")], "doc string, html string")
    work = spark.createDataFrame([(d, f"{d}/{a}", h, a, b) for d, a, h, b in [*asked, ("n", "U.1", None, False), ("n", "U.2", None, False), ("n", "U.3", None, False), ("n", "U.4", None, False)]], WORK)
    return {r["section_key"]: r for r in pages.parse(work, docs).collect()}


def test_slice_and_footnotes(parsed):
    r = parsed["s/W.15.001"]
    assert r["body_markdown"] == "First kite text[^1]." and [tuple(f) for f in r["footnotes"]] == [("1", "A linked note.")] and r["anchor_found"] and r["heading"] == "Kinds of kite"
    assert parsed["s/W.15.002"]["body_markdown"] == "Second kite text." and parsed["s/W.15.002"]["heading"] == "[15.002] Others" and parsed["s/W.15.002"]["footnotes"] == []
    missing = parsed["s/W.9"]
    assert not missing["anchor_found"] and "Second kite" in missing["body_markdown"] and missing["footnotes"][0]["text"].endswith("\n    continued") and missing["heading"] == "(1) Kinds"


def test_annotations_are_units(parsed):
    assert parsed["a/K.S5"]["body_markdown"] == "Old words keep their *sense*."
    assert parsed["a/K.S5.C_5-01"]["body_markdown"] == "### [5.01] Origin\n\nMade in spring." and parsed["a/K.S5.C_5-02"]["body_markdown"] == "### [5.02] Uses\n\nUsed in summer."
    assert parsed["a/K.S50"]["body_markdown"] == "* (1) Kites fly.\n\nkite\n: a toy\n\nline\n: a cord"


def test_a_unit_ends_before_the_element_that_holds_the_next(parsed):
    assert parsed["n/U.1"]["body_markdown"] == "one" and parsed["n/U.2"]["body_markdown"] == "two"
    assert parsed["n/U.3"]["body_markdown"] == "* three\n+ inner" and parsed["n/U.4"]["body_markdown"] == "* four"


def test_definition_keeps_its_body_unless_strict(spark, parsed):
    assert parsed["a/K.S50.KITE"]["body_markdown"] == "kite\n: a toy" and parsed["a/K.S50.LINE"]["body_markdown"] == "line\n: a cord"
    work = spark.createDataFrame([("a", "k", None, "K.S50.KITE", False)], WORK)
    assert pages.parse(work, spark.createDataFrame([("a", ANNOTATED)], "doc string, html string"), strict=True).first()["body_markdown"] == "kite"


def test_titles_errors_and_references(parsed):
    assert parsed["t/None"]["heading"] == "The title" and parsed["t/None"]["body_markdown"] == "> draft\n\nx ——&bogus;"
    assert parsed["x/None"]["error"] == "ParseError: no such document" and parsed["b/None"]["error"] == "ParseError: no content container" and parsed["b/None"]["heading"] == "Own"


MARKDOWN = [
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "* a\n+ b\n* c"), ("<ol start='3'><li>x<li>y</ol>", "3. x\n4. y"), ("<p>a<br>b</p><p>c</p>", "a\nb\n\nc"),
    ("<p>one <b> two </b>three<i></i></p>", "one **two** three"), ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"), ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    ("<h2>T <i>x</i></h2>text", "## T *x*\n\ntext"), ("<img src='s' alt='a'>", "![a](s)"), ("a &amp; b <script>x</script>", "a & b"), ("", ""), ("<![foo[x]]>y<p>z", "y\n\nz"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<table><tr><td>1</td><td>2</td></tr></table>", "| | |\n| --- | --- |\n| 1 | 2 |"), ("<pre>a\n b</pre>", "```\na\nb\n```"), ("<p><b>never closed<p>x", "never closed\n\nx"), ("<p title='a > b'>t</p>", "t"), ("1 < 2", "1 < 2"),
]


IMPLIED = [
    ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", "| | |\n| --- | --- |\n| a | b |\n| c | d |"), ("<table><tr><th>A<th>B<tbody><tr><td>1<td>2</tbody></table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "* a\n+ b\n+ c\n* d"), ("<ol><li>x<p>y<li>z</ol>", "1. x\n\ny\n2. z"), ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"), ("<p>a<ul><li>b</ul></p>c", "a\n\n* b\n\nc"),
    ("<dl><dt>t<dd>u<dt>v<dd>w</dl>", "t\n: u\n\nv\n: w"), ("<p>a</li></td></tr></p>b", "a\n\nb"), ("<ul><li>a<table><tr><td>1<td>2</table><li>b</ul>", "* a\n\n| | |\n| --- | --- |\n| 1 | 2 |\n* b"),
    ("x<!-- never closed <p>y", "x"), ("x<script>never <p>closed", "x"), ("x<p title=\"never closed>y", "x"), ("<p class=a\"b>t</p>", "t"), ("a < b <c", "a < b"), ("<p title=\">\" id='<'>t", "t"), ("x<!doctype y>z<?pi ?>", "xz"),
]


def test_implied_end_tags_and_open_ends(spark):
    rows = [(i, f'<div class="c">{html}</div>') for i, (html, _) in enumerate(IMPLIED)]
    got = {r["page_id"]: r for r in pages.page_texts(spark.createDataFrame(rows, "page_id long, html string"), container_tags=(), containers=("c",)).collect()}
    # What never ends swallows the container's end tag too, so that there is no container; all else is as an HTML parser has it.
    cut = {i for i, (html, _) in enumerate(IMPLIED) if "never" in html or html.endswith("<c")}
    assert {i: r["body_markdown"] for i, r in got.items() if i not in cut} == {i: want for i, (_, want) in enumerate(IMPLIED) if i not in cut}
    assert all(got[i]["error"] == "ParseError: no content container" for i in cut)


def test_tokens_are_numbered_where_they_are_cut(spark):
    """Neither windows nor shuffles number tokens, and a document may lie in any number of batches."""
    rows = [(f"d{i}", f'<div class="SS_HK"><a id="U.{i}"></a>{html}</div>') for i, html in enumerate([html for html, _ in [*IMPLIED, *MARKDOWN]] + [SHARED, ANNOTATED, "", "</p>", None])]
    found = pages._tokens(spark.createDataFrame(rows, "doc string, html string"), pages.MARKUP)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    want, key = sorted(map(repr, found.collect())), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert sorted(map(repr, found.select("*").collect())) == want
    finally:
        spark.conf.set(key, before)


def test_texts_are_read_for_the_kinds_of_short_bodies_that_are_asked(spark):
    """Of words of one, two and more letters and blanks only what is there is looked for; what is found is the same."""
    rows = [(1, i, t) for i, t in enumerate(["a", "an", "ant", "  ", "b", "xx", "an ant  as b c d e", "zebra"])]
    texts = spark.createDataFrame(rows, "g int, h long, text string")
    short = lambda *those: texts.where(F.col("text").isin(*those)).select("g", F.col("h").alias("small"), F.col("text").alias("asked"))
    found = lambda s: sorted(r["small"] for r in audit._short_contained(s, texts, 5).collect())
    assert [found(short(t)) for t in ("a", "an", "ant", "  ", "b", "xx", "zebra")] == [[0], [1], [2], [3], [4], [], []] and found(short("a", "an", "ant", "  ", "xx")) == [0, 1, 2, 3]
    scans = lambda s: audit._short_contained(s, texts, 5)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")
    assert scans(short("none")) == 0 and scans(short("  ")) == 1 and scans(short("ant")) == scans(short("zebra")) == 2 < scans(short("a", "ant"))


def test_links_are_read_where_pages_are_cut(spark):
    """Neither windows nor joins read links: nested ones, of void elements, without end tags; equal pages count once."""
    a = f"<a href='/x?pddocfullpath={DOC.replace('/', '%2F')}&amp;pdtocnodeidentifier=AABAAC'>"
    body = f"<div {toc.NODE_ATTR}='AAB'>Top {a} in</a> rest</div>no<img {toc.NODE_ATTR}='AABAAD'><ul><li {toc.NODE_ATTR}='AABAAE'>x<li>y</ul><div {toc.NODE_ATTR}='gone'>z"
    rows = [("P", "AAB", "T", 1, body), ("P", "AAB", "T", 1, body), ("P", None, "T", None, a), ("P", "AAC", "T", 2, None), ("P", "AAD", "T", 2, "")]
    got = toc.toc_nodes_from_links(spark.createDataFrame(rows, "publication string, title_nodeid string, title_name string, batch_seq long, body string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert sorted((r["title_nodeid"], r["batch_seq"], r["seq"], r["nodeid"], r["label"], r["urn"]) for r in got.collect()) == [
        ("AAB", 1, 0, "AAB", "Top in rest", None), ("AAB", 1, 1, "AABAAC", "in", "urn:contentItem:DOC-1"), ("AAB", 1, 2, "AABAAD", "", None), ("AAB", 1, 3, "AABAAE", "x", None)]


def test_only_what_sections_and_notes_say_leaves_the_task_that_cuts(spark):
    """A document of 1,000 units tells a row for each that is asked for, one for all that miss their anchor, and one for each note; none for a token."""
    units = "".join(f'<a id="U.{i}"></a><h2>h{i}</h2><p>one <b>{i}</b> <i>two</i></p>' for i in range(1000))
    html = f'<div class="SS_HK">{units}<footer class="SS_Footnote"><ol><li><a class="SS_FootnoteDefinition" id="fndef_U.1.F1">1</a> n</ol></footer></div>'
    asks = [json.dumps({"section_key": k, "anchor": a, "body_only": False}) for k, a in [("a", "U.1"), ("b", "U.1"), ("c", "none"), ("d", None)]]
    docs = spark.createDataFrame([("d", html, asks)], "doc string, html string, asks array<string>")
    told = pages._tokens(docs, pages.MARKUP).collect()
    assert sorted(([s["section_key"] for s in r["sections"] or []], r["cut"], r["foot_at"] is None) for r in told if r["foot_at"] is None) == [(["a", "b"], True, True), (["c", "d"], False, True)]
    assert len(told) == 3 and [r["ids"] for r in told if r["foot_at"] is not None] == [["fndef_U.1.F1"]]
    work = spark.createDataFrame([("d", "a", None, "U.1", False), ("d", "c", None, "none", False), ("e", "x", None, "U.1", False), (None, "y", "H", None, False)], WORK)
    got = {r["section_key"]: r for r in pages.parse(work, docs.select("doc", "html")).collect()}
    assert (got["a"]["body_markdown"], got["a"]["anchor_found"]) == ("## h1\n\none **1** *two*", True) and not got["c"]["anchor_found"] and got["c"]["body_markdown"].endswith("one **999** *two*")
    assert [got[k]["error"] for k in "acxy"] == [None, None] + ["ParseError: no such document"] * 2 and got["y"]["heading"] == "H"


def test_an_unclosed_cell_or_item_is_a_depth(spark):
    """A slice ends where the element around it does, though its own elements and those before it have no end tags."""
    html = '<div class="SS_HK"><ul><li><a id="U.1"></a>one<li><a id="U.2"></a>two<ul><li>in</ul><li><a id="U.3"></a>three</ul><p>tail</div>'
    work = spark.createDataFrame([("n", k, None, k, False) for k in ("U.1", "U.2", "U.3")], WORK)
    got = {r["section_key"]: r["body_markdown"] for r in pages.parse(work, spark.createDataFrame([("n", html)], "doc string, html string")).collect()}
    assert got == {"U.1": "* one", "U.2": "* two\n* in", "U.3": "* three"}


def test_the_time_of_a_page_is_linear(spark):
    """Long texts of what could be tried anew at each place; none takes long, and the page before it is whole."""
    import time

    pieces = ["<!-- x > y ", "<script>a", "<p title='x\" ", "<a <a ", "<![ ", " ", "\n ", "<p>", "<li>\n<b> ", "<i>\n</i>"]
    rows = [(i, '<div class="c">t</div>' + p * (400_000 // len(p))) for i, p in enumerate(pieces)]
    began = time.time()
    got = pages.page_texts(spark.createDataFrame(rows, "page_id long, html string"), container_tags=(), containers=("c",)).collect()
    assert [r["body_markdown"] for r in got] == ["t"] * len(rows) and time.time() - began < 150


def test_markdown(spark):
    rows = [(i, f'<div class="c">{html}</div>') for i, (html, _) in enumerate(MARKDOWN)] + [(100, None), (101, "<p>no container</p>"), (0, f'<div class="c">{MARKDOWN[0][0]}</div>'), (None, '<div class="c">of no id</div>')]
    got = pages.page_texts(spark.createDataFrame(rows, "page_id long, html string"), container_tags=(), containers=("c",)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert [by[i]["body_markdown"] for i in range(len(MARKDOWN))] == [want for _, want in MARKDOWN]
    assert by[100]["error"] == "ParseError: no such document" and by[101]["error"] == "ParseError: no content container" and by[None]["body_markdown"] == "of no id"


def test_parse_job_shares_documents(spark):
    url = "https://x/?pdmfid=1&pddocfullpath=%2Fshared%2Fdocument%2Fd"
    secs = spark.createDataFrame([("a", url + "&n=1", None, "W.15.001", False), ("b", url + "&n=2", "Own", "W.15.002", False), ("c", "https://none", None, None, None), ("d", "https://bare", None, None, None)], "section_key string, source_url string, heading string, anchor_id string, body_only boolean")
    docs = spark.createDataFrame([(url + "&other", SHARED), ("https://bare", "<p>x</p>"), ("https://unused", None)], "url string, html string")
    out = pages.parse_sections(secs, docs)
    got = {r["section_key"]: r for r in out.collect()}
    assert got["a"]["body_markdown"] == "First kite text[^1]." and got["b"]["heading"] == "Own"
    assert got["c"]["error"].startswith("ParseError") and got["d"]["error"].startswith("ParseError")
    assert [(r["sections"], r["misses"]) for r in pages.anchor_misses(out, secs).collect()] == [(2, 0)]
    told = pages.found_anchors(secs, docs)
    assert sorted(map(tuple, told.collect())) == sorted((r["section_key"], r["anchor_found"]) for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- corpus ----------------------------------------------------------------------------------


def recs(spark, rows):
    base = "publication string, title string, volume string, section_number string, heading string, hierarchy array<string>, body_markdown string, footnotes " + FOOTNOTES + ", nodeid string, seq long, jurisdiction string, retrieved_at string"
    df = spark.createDataFrame([(*r, i, "Hong Kong", "2026-08-13T00:00:00Z") for i, r in enumerate(rows)], base)
    null = F.lit(None).cast("string")
    return df.withColumns({"breadcrumb": null, "contentitem_urn": null, "pdtocnodeidentifier": F.col("nodeid"), "decoded_path": F.lit(None).cast("array<int>"), "word_count": F.lit(1), "footnote_count": F.lit(0)})


ROWS = [
    ("Works of Hong Kong", "CAP 1", None, "7", "Kinds", ["PART II"], "* (1) Kites.", [], "AABAAB"), ("Works of Hong Kong", "CAP 1", None, "", "Origin", ["PART II", "7. Kinds"], "### [7.01] Origin\n\nMade.", [("1", "A"), ("2", "B"), ("1", "C")], "AABAABAAB"),
    ("Works of Hong Kong", "CAP 1", "Volume 3", "", "Note", ["PART II", "7. Kinds"], "### [7.02] Note\n\nCited.", [], "AABAABAAC"), (None, None, None, None, None, None, None, None, None),
]


def test_markdown_documents(spark, tmp_path):
    assert corpus.compile_markdown(recs(spark, ROWS), f"{tmp_path}/md").first()["files"] == 2
    docs = {(r["pub_slug"], r["title_slug"]): r["value"] for r in spark.read.text(f"{tmp_path}/md", wholetext=True).collect()}
    assert docs[("works-of-hong-kong", "cap-1")] == (
        "# CAP 1 — Volume 3\n\n*Works of Hong Kong · Hong Kong · 3 sections · retrieved 2026-08-13*\n\n## PART II\n\n### 7. Kinds\n\n* (1) Kites.\n\n#### [7.01] Origin\n\nMade.\n\n[^1]: C\n[^2]: B\n\n#### [7.02] Note\n\nCited.\n")
    assert docs[("unknown", "untitled")].endswith("\n\n## (untitled)\n")


def harvest(spark, *keys, kind="harvested", first=0):
    rows = [(first + i, 0.0, kind, k, k.split("#")[0] if kind == "harvested" else None, None, "t", None, "h", None, None, None) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, MANIFEST_EVENTS)


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    keys = lambda: {r["section_key"] for r in manifest.read_snapshot(spark, folder).collect()}
    assert keys() == set()
    assert manifest.write_snapshot(manifest.fold(harvest(spark, "u", "v")), folder) == 1 and keys() == {"u", "v"}
    assert manifest.write_snapshot(manifest.fold(harvest(spark, "w")), folder) == 2 and keys() == {"w"}
    assert len(manifest.upsert_snapshot(harvest(spark, "w#1", "x"), folder)) == 2 and keys() == {"w#1", "x"}
    assert manifest.upsert_snapshot(harvest(spark).limit(0), folder) == [] and keys() == {"w#1", "x"}
    assert manifest.write_snapshot(manifest.fold(harvest(spark).limit(0)), folder) == 4 and keys() == set()


def test_two_writers_of_a_snapshot(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    manifest.write_snapshot(manifest.fold(harvest(spark, "a")), folder)
    one, two = Store(spark, folder), Store(spark, folder)
    base, same = one.version(), two.version()
    stage = lambda store, key: store.stage(manifest.fold(harvest(spark, key)), "manifest", F.lit(7), [7])
    first, second = stage(one, "b"), stage(two, "c")
    # A writer that is lost before its commit leaves nothing that is read.
    assert {r["section_key"] for r in manifest.read_snapshot(spark, folder).collect()} == {"a"}
    one.commit(base, first)
    with pytest.raises(ConflictError):
        two.commit(same, second)
    assert {r["section_key"] for r in manifest.read_snapshot(spark, folder).collect()} == {"a", "b"}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    rows = spark.range(100_000).select(F.concat(F.lit("urn:"), "id").alias("section_key"), F.concat(F.lit("urn:"), "id").alias("urn"), *[F.lit(None).cast("string").alias(c) for c in manifest.META], F.lit("pending").alias("status"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("record"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("updated_at"))
    manifest.write_snapshot(rows, folder)
    before = Store(spark, folder).version().folders
    events = harvest(spark, *(f"urn:{i * 7919}" for i in range(10)), kind="done")
    touched = manifest.upsert_snapshot(events, folder)
    after = Store(spark, folder).version().folders
    assert len(touched) <= 10 and {k for k in before if before[k] != after[k]} == {f"manifest/{b}" for b in touched}
    assert as_dict(manifest.read_snapshot(spark, folder)) == as_dict(manifest.upsert(rows, events))
    assert manifest.upsert_snapshot(events, folder, batch=3) == touched and manifest.upsert_snapshot(events, folder, batch=3) == []


def test_compiled_files(spark, tmp_path):
    out = f"{tmp_path}/out"
    stats = corpus.compile_jsonl(recs(spark, ROWS).repartition(5), out).first()
    assert tuple(stats) == (2, 2, 4)
    lines = [json.loads(r[0]) for r in spark.read.text(f"{out}/titles/pub_slug=works-of-hong-kong/title_slug=cap-1").select("value").collect()]
    assert [x["pdtocnodeidentifier"] for x in lines] == ["AABAAB", "AABAABAAB", "AABAABAAC"] and lines[1]["footnotes"] == {"1": "C", "2": "B"} and "heading" not in lines[0] and lines[0]["breadcrumb"] is None
    assert spark.read.text(f"{out}/corpus").count() == 4
    assert corpus.slug_collisions(recs(spark, [("A b", "T", *ROWS[0][2:]), ("a-B", "T", *ROWS[0][2:])])).first()["n"] == 2
    fail = spark.createDataFrame([("u", None, "1", "ParseError", "m" * 300)], "urn string, title string, number string, error_type string, message string")
    corpus.append_failures(fail, f"{out}/failures")
    assert spark.read.text(f"{out}/failures").first()[0] == "u\t\t1\tParseError: " + "m" * 200


def compiled(spark, tmp_path, *batches):
    """The lines of each title, as body and place in the file, after the batches."""
    src = f"{tmp_path}/src"
    for batch in batches:
        batch.write.mode("append").parquet(src)
        stream = spark.readStream.schema(batch.schema).parquet(src)
        streams.incremental_compile(stream, f"{tmp_path}/all", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    found = {}
    for r in spark.read.text(f"{tmp_path}/out").collect():
        found.setdefault((r["pub_slug"], r["title_slug"]), []).append(json.loads(r["value"])["body_markdown"])
    return found


def test_incremental_compile(spark, tmp_path):
    everything = recs(spark, ROWS[:3] + [("P2", "T2", *ROWS[0][2:])]).coalesce(1)
    found = compiled(spark, tmp_path, everything.where("publication = 'P2' or nodeid = 'AABAABAAC'"), everything.where("nodeid = 'AABAAB' and publication <> 'P2'"))
    # The section of P2 has the key of that of the other work, and a later place: it is the same section, moved.
    assert {k: len(v) for k, v in found.items()} == {("works-of-hong-kong", "cap-1"): 1, ("p2", "t2"): 1}


def section(spark, *rows):
    """Records (title, nodeid, body, seq)."""
    made = recs(spark, [("P", t, None, "", "H", [], body, [], node) for t, node, body, _ in rows]).coalesce(1)
    seqs = F.create_map(*[F.lit(x) for i, r in enumerate(rows) for x in (i, r[3])])
    return made.withColumn("seq", F.element_at(seqs, F.col("seq").cast("int")).cast("long"))


def test_a_section_that_arrives_again_is_one_line(spark, tmp_path):
    found = compiled(
        spark, tmp_path, section(spark, ("A", "AAB", "one", 1), ("A", "AAC", "other", 2), ("A", "AAB", "two", 3), ("B", "AAD", "alone", 4)), section(spark, ("A", "AAB", "three", 9), ("A", "AAC", "late and older", 1)),
        section(spark, ("A", "AAB", "again three", 9), ("C", "AAD", "moved", 5)))
    assert found == {("p", "a"): ["again three", "other"], ("p", "c"): ["moved"]}
    assert not (tmp_path / "out" / "pub_slug=p" / "title_slug=b").exists()


def test_a_batch_writes_bodies_to_the_store_alone(spark, tmp_path, monkeypatch):
    """What is written aside while a batch is compiled is narrow; equal rows that arrive twice are one line."""
    aside, write = [], streams.written
    monkeypatch.setattr(streams, "written", lambda df, name: aside.append(df.columns) or write(df, name))
    rows = [("A", "AAB", "one", 1), ("A", "AAB", "one", 1), ("A", "AAC", "two", 1)]
    assert compiled(spark, tmp_path, section(spark, *rows)) == {("p", "a"): ["one", "two"]}
    assert aside and not any("body_markdown" in columns for columns in aside)


def test_files_of_a_shard_stay_bounded(spark, tmp_path):
    batches = [section(spark, ("A", "AAB", f"body {i}", i), ("A", "AAC", f"other {i}", i)) for i in range(8)]
    assert compiled(spark, tmp_path, *batches) == {("p", "a"): ["body 7", "other 7"]}
    # Two versions of one bucket of titles and of two buckets of sections at most, however many batches there were.
    assert len(list((tmp_path / "all" / "data").glob("*/bucket=*"))) <= 6


def test_titles_in_parts(spark, tmp_path):
    """A large title is several files whose order is that of their names; none holds much more than a part."""
    rows = [("Big", f"AA{chr(65 + i // 26)}{'A'}{chr(65 + i // 26)}{chr(65 + i % 26)}", f"body {i} " + "x" * (i * 37 % 400), i) for i in range(200)] + [("Small", "AAB", "little", 1000), ("Tiny", "AAB", "less", 1001)]
    lines = corpus.json_lines(section(spark, *rows).repartition(5))
    corpus.write_titles(lines, f"{tmp_path}/t", part_bytes=5000)
    files = sorted((tmp_path / "t" / "pub_slug=p" / "title_slug=big").glob("part-*"))
    assert len(files) > 5 and all(f.stat().st_size < 5000 + 1000 for f in files)
    got = [json.loads(x)["body_markdown"] for f in files for x in f.read_text().splitlines()]
    assert got == [r[2] for r in sorted(rows[:200], key=lambda r: (r[1], r[3]))]
    assert len(list((tmp_path / "t" / "pub_slug=p" / "title_slug=small").glob("part-*"))) == 1
    told = {r["title_slug"]: (r["n"], r["b"]) for r in spark.read.parquet(f"{tmp_path}/t/_parts").groupBy("title_slug").agg(F.sum("records").alias("n"), F.sum("bytes").alias("b")).collect()}
    assert told["big"] == (200, sum(f.stat().st_size for f in files)) and told["tiny"][0] == 1


def exchanges(df, column):
    """How often a plan shuffles ``column``."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum(f"{column}#" in details.partition("Arguments:")[0] for details in re.findall(r"\n\(\d+\) Exchange\n(.*?)\n\n", plan, re.S))


def test_bodies_are_shuffled_once_to_meet_their_headings(spark):
    df = recs(spark, ROWS)
    assert exchanges(df.repartition(3, "body_markdown"), "body_markdown") == 1
    assert exchanges(corpus.markdown_blocks(df), "rest") + exchanges(corpus.markdown_blocks(df), "block") == 1


@pytest.mark.parametrize("part_bytes", [300, 1 << 20])
def test_lines_find_their_parts_by_where_these_begin(spark, tmp_path, part_bytes):
    """Titles of one slug, null ids and places, and equal lines, in one part and in many, are in the order of a sort of all lines."""
    rng = random.Random(8)
    rows = [("p", "t", rng.choice(["P", "p!"]), rng.choice(["T", "t?"]), rng.choice([None, "AAB", "AAC", "AAD"]), rng.choice([None, 1, 2]), rng.choice("xyz") * 30) for _ in range(150)]
    rows += [("p", "u", "P", "U", "AAB", 1, "only")]
    corpus.write_titles(spark.createDataFrame(rows, "pub_slug string, title_slug string, pub string, tit string, nodeid string, seq long, value string").repartition(4), f"{tmp_path}/t", part_bytes=part_bytes)
    files = sorted((tmp_path / "t" / "pub_slug=p" / "title_slug=t").glob("part-*"))
    order = lambda r: (r[2], r[3], r[5] is not None, r[4] or "", r[5] or 0)
    place = {}
    for r in rows[:150]:
        place.setdefault(order(r), []).append(r[6])
    got = iter([x for f in files for x in f.read_text().splitlines()])
    assert all(sorted(next(got) for _ in place[k]) == sorted(place[k]) for k in sorted(place)) and next(got, None) is None
    assert (len(files) > 5) == (part_bytes == 300)


def test_headings_across_ranges(spark):
    """Headings of a title over many ranges, and of equal records, against a loop over the whole title."""
    rng = random.Random(6)
    rows = [("P", rng.choice("AAAB"), None, str(i), rng.choice(["H", "K"]), [rng.choice(["I", "II"]), rng.choice(["x", "y"])][: rng.randrange(3)], "b", [], f"AA{chr(65 + rng.randrange(6))}") for i in range(120)]
    df = recs(spark, rows)
    before, want = {}, {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1][1], x[1][8], x[0])):
        path = [*r[5], f"{r[3]}. {r[4]}"]
        want[i] = [f"{'#' * min(d + 2, 6)} {label}" for d, label in enumerate(path) if before.get(r[1], [])[d : d + 1] != [label]]
        before[r[1]] = path
    got = {r["seq"]: r["headings"] for r in corpus.emitted_headings(df.repartition(6)).collect()}
    assert got == want
    twice = corpus.emitted_headings(df.union(df)).collect()
    assert sorted(len(r["headings"]) for r in twice) == sorted([0] * 120 + [len(h) for h in want.values()])


def test_to_record(spark):
    s = spark.createDataFrame([("k", "urn:contentItem:X-00000-00", "AAB", "T", "7", "H", ["P"], "Volume 1", "s", "Works", None, False, [1], "AAB", 0)], "section_key string, urn string, nodeid string, title string, number string, heading string, hierarchy array<string>, volume string, source_url string, publication string, anchor_id string, body_only boolean, decoded_path array<int>, title_nodeid string, seq long")
    p = spark.createDataFrame([("k", "", "two words", [("1", "n")], True, None)], f"section_key string, heading string, body_markdown string, footnotes {FOOTNOTES}, anchor_found boolean, error string")
    r = records.to_records(s, p, "2026-01-01T00:00:00Z").first()
    assert (r["id"], r["heading"], r["breadcrumb"], r["word_count"], r["footnote_count"]) == ("X", "H", "Works › T (Volume 1) › P › 7. H", 2, 1)


# --- audits ----------------------------------------------------------------------------------


def test_containment_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(8)]
    bodies = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    bodies += [" ".join(b.split()[1:-1]) for b in bodies[:40]] + [b[1:-1] for b in bodies[40:60]] + bodies[60:70] + ["", None]
    rows = [("g" if i % 3 else None, i, b) for i, b in enumerate(bodies)]
    got = {r["k"] for r in audit.contained(spark.createDataFrame(rows, "g string, k int, body_markdown string"), group=["g"], key="k").collect()}
    want = {k for g, k, b in rows if b and any(g == g2 and k != k2 and b2 and b in b2 for g2, k2, b2 in rows)}
    assert got == want
    probes = spark.createDataFrame([(i, b) for i, b in enumerate(bodies[:60:3] + ["zzz", "", None])], "p int, t string")
    hits = {r["p"]: r["hits"] for r in audit.probe_hits(spark.createDataFrame(rows, "g string, k int, body_markdown string"), probes, probe_key="p", probe_text="t").collect()}
    assert hits == {r["p"]: sum(bool(r["t"]) and bool(b) and r["t"] in b for b in bodies) for r in probes.collect()}


def test_probes_read_texts_for_the_kinds_asked_alone(spark):
    texts = spark.createDataFrame([(0, 1, "a kite flies high over the hill today"), (0, 2, "kite")], "g int, h long, text string")
    asks = lambda *asked: spark.createDataFrame([(0, i, a) for i, a in enumerate(asked)], "g int, small long, asked string")
    cuts = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate")
    assert cuts(audit._meetings(asks(), texts, 5)) == 0 and cuts(audit._meetings(asks("over the hill"), texts, 5)) <= 2
    assert {r["h"] for r in audit._meetings(asks("over the hill"), texts, 5).collect()} == {1}


def test_runs_of_words_are_cut_where_their_text_is(spark):
    runs = audit._runs(spark.createDataFrame([(0, 1, "a b\tc")], "g int, h long, text string"), "text", 1)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert sorted((r["pos"], r["w"], r["gap"], r["w1"], r["gap1"], r["w2"]) for r in runs.collect()) == [(0, "a", " ", "b", "\t", "c"), (1, "b", "\t", "c", None, None)]


def test_long_contained_bodies_equal_brute_force(spark):
    """Long bodies, their slices and near copies of these, some of which a shingle in sixteen tells apart and others not."""
    rng = random.Random(12)
    full = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(60, 300))) for _ in range(40)]
    cut = [b[rng.randrange(20) : -rng.randrange(1, 200)] for b in full]
    near = [" ".join("x" if i == at else w for i, w in enumerate(b.split())) for b in cut for at in [rng.randrange(len(b.split()))]]
    rows = [(("g", "h")[i % 40 % 2], i, b) for i, b in enumerate(full + cut + near + [n[5:-5] for n in near])]
    got = {r["k"] for r in audit.contained(spark.createDataFrame(rows, "g string, k int, body_markdown string"), group=["g"], key="k").collect()}
    assert got == {k for g, k, b in rows if any(g == g2 and k != k2 and b in b2 for g2, k2, b2 in rows)} and len(got) >= 80


def test_short_bodies_need_no_text(spark):
    """Bodies of blanks, of one and two words, of words cut at either end, and of blanks that differ, by brute force."""
    rng = random.Random(4)
    parts = ["a", "ab", "abc", "abcd", "é", " ", "  ", "\n", "\t", "b c", "", "x"]
    bodies = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(150)} | {" ", "\n\n", "ab ", " ab", "abcd x\nab"})
    rows = [("g" if i % 4 else "h", i, b) for i, b in enumerate(bodies)]
    got = {r["k"] for r in audit.contained(spark.createDataFrame(rows, "g string, k int, body_markdown string"), group=["g"], key="k").collect()}
    assert got == {k for g, k, b in rows if b and any(g == g2 and k != k2 and b in b2 for g2, k2, b2 in rows)}


def test_small_audits(spark):
    df = spark.createDataFrame([("AAA", 1, "a[^1] b[^3] (1)Word", [("1", "x"), ("2", "y")], "g"), ("AAB", 2, "Jump up", None, "g"), ("AAC", 3, None, [("2", "x")], "h")], f"nodeid string, seq long, body_markdown string, footnotes {FOOTNOTES}, g string")
    rows = {r["seq"]: r for r in audit.footnote_check(df).collect()}
    assert (rows[1]["undefined"], rows[1]["unmarked"], rows[1]["in_order"], rows[3]["in_order"], rows[2]["in_order"]) == ("3", "2", True, False, True)
    assert {r["g"]: r["glued"] for r in audit.glued_labels(df, ["g"]).collect()} == {"g": 1, "h": 0}
    assert {r["phrase"]: (r["records"], r["only"]) for r in audit.chrome_leakage(df).collect()}["Jump up"] == (1, 1)


# --- plans -----------------------------------------------------------------------------------


def test_plans_have_no_product_and_no_lone_window(spark, sf_dir):
    from sectionmill.plans import queries

    for name in ("flagship_sections", "set2_manifest_fold", "jn1_hierarchy", "win3_heading_emission"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "SinglePartition" not in plan, name


def test_registered_queries_equal_their_sql(spark, sf_dir):
    """Every query of the library that has SQL, against DuckDB on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from sectionmill.plans import queries

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    assert set(queries.SQL) <= set(queries.QUERIES)
    for name, query in queries.QUERIES.items():
        got = query(spark, sf_dir)
        columns = sorted(got.columns)
        rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
        if name in queries.SQL:
            found = con.execute(queries.SQL[name])
            names = [c[0] for c in found.description]
            want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
            assert columns == sorted(names) and rows == want, name


def test_nations_of_more_customers_than_a_chunk_numbers(spark, sf_dir, tmp_path):
    """Every customer past the 17,575th of a nation is a node of its own, with its orders, as in SQL."""
    duckdb = pytest.importorskip("duckdb")
    from sectionmill.plans import queries

    con = duckdb.connect()
    for name in ("region", "nation"):
        con.execute(f"COPY (SELECT * FROM '{sf_dir}/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
    con.execute(f"COPY (SELECT c.* REPLACE (i AS c_custkey, 3::INTEGER AS c_nationkey) FROM (SELECT * FROM '{sf_dir}/customer.parquet' LIMIT 1) c, range(17600) r(i)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"COPY (SELECT o.* REPLACE (i AS o_orderkey, 17540 + i // 2 AS o_custkey) FROM (SELECT * FROM '{sf_dir}/orders.parquet' LIMIT 1) o, range(120) r(i)) TO '{tmp_path}/orders.parquet'")
    for name in ("region", "nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in ("flagship_sections", "src2_toc_api_json", "col1_nodeid_to_path", "col2_path_to_nodeid"):
        got, found = queries.QUERIES[name](spark, str(tmp_path)), con.execute(queries.SQL[name])
        columns, names = got.columns, [c[0] for c in found.description]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall()), name


CROWDED = (
    "flt1_candidates",
    "jn2_subtree",
    "col20_section_label",
    "jn1_hierarchy",
    "snk4_harvest_summary",
    "jn4_work_counts",
    "jn7_titles_with_counts",
    "col3_depth_parent",
    "src4_toc_dom",
    "col1_nodeid_to_path",
    "col2_path_to_nodeid",
    "flagship_sections",
)


@pytest.fixture(scope="module")
def crowded(sf_dir, tmp_path_factory):
    """A folder and its views in DuckDB: a nation of 17,600 customers, of which the last 60, and debtors among them, have two orders or three."""
    con, folder = pytest.importorskip("duckdb").connect(), tmp_path_factory.mktemp("crowded")
    for name in ("region", "nation"):
        con.execute(f"COPY (SELECT * FROM '{sf_dir}/{name}.parquet') TO '{folder}/{name}.parquet'")
    con.execute(f"COPY (SELECT c.* REPLACE (i AS c_custkey, 3::INTEGER AS c_nationkey, CASE WHEN i % 4 = 0 THEN -1.5 ELSE 1.5 END AS c_acctbal) FROM (SELECT * FROM '{sf_dir}/customer.parquet' LIMIT 1) c, range(17600) r(i)) TO '{folder}/customer.parquet'")
    con.execute(f"COPY (SELECT o.* REPLACE (i AS o_orderkey, 17540 + i % 60 AS o_custkey) FROM (SELECT * FROM '{sf_dir}/orders.parquet' LIMIT 1) o, range(160) r(i)) TO '{folder}/orders.parquet'")
    for name in ("region", "nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", CROWDED)
def test_queries_on_nodes_of_a_crowded_nation_equal_their_sql(spark, crowded, name):
    """No node, section or count is lost past the 17,575th customer of a nation."""
    from sectionmill.plans import queries

    folder, con = crowded
    got, found = queries.QUERIES[name](spark, folder), con.execute(queries.SQL[name])
    columns, names = got.columns, [c[0] for c in found.description]
    assert sorted(columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_page_text_equals_its_sql_where_a_title_ends_within_a_reference(spark, tmp_path):
    from sectionmill.plans import queries

    con = pytest.importorskip("duckdb").connect()
    ends = ["x = &quot", "x &amp", "x &am", "x &quo", "x &", "x &quot;", "x &amp;quot;", "x &amp;amp", "x &ampere y", "&quot &quot;&amp"]
    con.execute("CREATE TABLE pages AS SELECT i AS page_id, '<article><h1>' || x || '</h1><p><b>' || x || '; &amp;c<p>&quot;</article>' AS html FROM (SELECT unnest(range(10)) AS i, unnest(?) AS x)", [ends])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    got = queries.QUERIES["par3_page_text"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['par3_page_text']})").fetchall())
    all_names = {r["page_id"]: r["heading"] for r in pages.page_texts(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()}
    assert all_names[0] == 'x = "' and all_names[9] == '" "&'  # by default a name may lack its semicolon


def test_the_library_stands_without_llm(tmp_path):
    """With the subpackage and the pipeline gone, all other queries are there; a broken import inside isn't hidden."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "sectionmill", tmp_path / "sectionmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    say = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    from sectionmill.plans import queries

    assert say().stdout.split() == [str(len(queries.QUERIES)), "False"]
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_thing\n")
    assert say().returncode and "no_such_thing" in say().stderr
