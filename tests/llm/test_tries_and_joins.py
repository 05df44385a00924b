"""The conversation trie, benchmark decontamination and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sectionmill.llm import decontamination, prefix_trie, spelling

# --- conversation prefix trie ------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth long, k1 string, range string, words string"


def trie_of(rows):
    """The contract's nodes, by conversations held as lists."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(donor, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    out = {}
    for node, ms in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in ms if len(built[c]) == len(node))
        out[(min(ms), len(node))] = (
            min(members[node[:-1]]) if node else None, len(ms), len(children[node]), sum(not children[n] for n in below), sum((len(members[n]) - 1) * words(n) for n in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def random_turns(seed, n=150):
    rng = random.Random(seed)
    starts = [[("system", "be  good")], [("system", "be kind\tplease")], []]
    rows = []
    for c in [rng.randrange(-60, 400) for _ in range(n)]:
        turns = rng.choice(starts) + [(rng.choice(["user", None, "assistant"]), rng.choice(["a b", "", None, "c", "a  b é"])) for _ in range(rng.randrange(0, 5))]
        rows += [(c, i if rng.random() < 0.9 else rng.choice([None, 0]), *t) for i, t in enumerate(turns or [("user", "x")])]
    rows += [(801, i, "user", f"turn {i}") for i in range(60)]  # a long conversation
    rows += [(c, 0, "user", "same") for c in range(1000, 1060)] + [(None, 1, "user", "nobody's")] + rows[:20]
    return rows


def got_trie(df, **kw):
    rows = prefix_trie.trie(df, **kw).collect()
    found = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"shard_turns": 20, "queue": 7}), (3, {"shard_turns": 12, "levels": 4, "queue": 3}), (4, {"shard_turns": 3, "levels": 2})])
def test_trie_equals_brute_force(spark, seed, kw):
    rows = random_turns(seed)
    df = spark.createDataFrame([(*r, 0, "k", "r", "w") for r in rows], TURNS).repartition(5)
    assert got_trie(df, **kw) == trie_of(rows)


def test_trie_of_few(spark):
    assert got_trie(spark.createDataFrame([], TURNS)) == {}
    for rows in ([(7, None, None, None)], [(20, 0, "user", "x" * 300_000), (20, 0, "user", "x" * 300_000)], [(None, 1, "a", "b"), (3, 1, "a", "b")]):
        assert got_trie(spark.createDataFrame([(*r, 0, "k", "r", "w") for r in rows], TURNS)) == trie_of(rows)


def test_spilling_queue():
    rng = random.Random(3)
    queue, held = prefix_trie.SpillingQueue(limit=10, block=3), defaultdict(list)
    for level in range(30, 0, -1):
        for _ in range(rng.randrange(40)):
            key = (-level + 1, rng.randrange(-4, 4), 0)
            row = (rng.randrange(9), rng.randrange(9))
            held[key].append(row)
            queue.push((*key, *row))
        for key in sorted(k for k in held if k[0] == -level + 1):
            want = held.pop(key)
            assert queue.take(key) == (len(want), sum(a for a, _ in want), sum(b for _, b in want))
        assert queue.take((-level + 1, 9, 9)) == (0, 0, 0)
    assert queue.spilled > 5


# --- benchmark decontamination -----------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_of(text, items):
    words, hit, named = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[k : k + size]:
                    hit |= set(range(i, i + size))
                    named.add("" if item is None else str(item))
    return len(words), len(hit), len(named), sorted(named), bool(hit)


DOCS = "doc_id long, text string, row string, id string, found string, n_words string, items string"


@pytest.mark.parametrize("most", [decontamination.MOST, 15])
def test_decontamination_equals_brute_force(spark, most):
    rng = random.Random(most)
    vocabulary = ["Ab", "cé", "x1", "élan", "ZÜ", " q", "w", "\U0001f600"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-", "\n", "\x00"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 4, 5, 9, 10, 11, 25]))) for i in range(25)]
    items += [(3, say(14)), (None, say(12)), (90, None), (91, ""), (92, "!?"), (10, items[4][1]), items[2]]
    docs = []
    for _ in range(60):
        body = rng.choice(items)[1] or ""
        docs.append(" ".join([say(rng.randrange(30)), body.upper() if rng.random() < 0.3 else body, say(rng.randrange(30))]) if rng.random() < 0.6 else say(rng.randrange(80)))
    docs += [None, "", " ... ", items[8][1], docs[0], docs[0], (items[30][1] or "") * 2, "long " * 20_000 + (items[7][1] or "")]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(docs)]
    got = decontamination.contamination(
        spark.createDataFrame([(*r, "r", "i", "f", "n", "x") for r in rows], DOCS).repartition(4), spark.createDataFrame([(*r, "w") for r in items], "item_id long, text string, window string"), most=most).collect()
    assert len(got) == len(rows)
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in got)
    assert found == Counter((i, n, h, m, tuple(named), bad) for i, t in rows for n, h, m, named, bad in [hits_of(t, items)])


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in decontamination.contamination(docs, none).orderBy("doc_id").collect()] == [(2, 0, False), (0, 0, False)]
    assert decontamination.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_words_of_chunks(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["a", "B9", "é", " ", ". ", "\U0001f600", "zz" * 40]) for _ in range(900))
    whole = decontamination.Words(text.encode())
    monkeypatch.setattr(decontamination, "_CHUNK", 16)
    cut = decontamination.Words(text.encode())
    assert cut.stretch(0, len(cut))["words"] == words_of(text) and len(whole) == len(cut)
    assert (whole.starts == cut.starts).all() and (whole.ends == cut.ends).all() and (whole.hashes == cut.hashes).all()
    by = dict(zip(words_of(text), whole.hashes.tolist(), strict=True))
    assert len(set(by.values())) == len(by) and [by[w] for w in words_of(text)] == whole.hashes.tolist()


# --- spelling variants -------------------------------------------------------------------------


def vocabulary_of(docs, every=31, least=7):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(n):
    others = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, xs in others.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None)
    return out


def spelled(rng):
    """Documents of words with slips, whose frequencies differ much."""
    stems = ["".join(rng.choice("abcdeéÿÀ") for _ in range(rng.randrange(6, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaab", "élanélan"]
    runs = []
    for stem in stems:
        runs += [stem] * rng.choice([1, 2, 30, 300])
        for _ in range(6):
            i = rng.randrange(len(stem))
            runs += [rng.choice([stem[:i] + stem[i + 1 :], stem[:i] + rng.choice("abÈz") + stem[i:], stem[:i] + rng.choice("abÈz") + stem[i + 1 :]])] * rng.choice([1, 2, 2, 20])
    rng.shuffle(runs)
    return [(i, rng.choice([" ", ", ", "9", "-"]).join(x.upper() if x.isascii() and rng.random() < 0.1 else x for x in runs[i * 40 : i * 40 + 40])) for i in range(len(runs) // 40 + 1)]


@pytest.mark.parametrize("most", [spelling.MOST, 40])
def test_variants_equal_brute_force(spark, most):
    docs = [*spelled(random.Random(most)), (None, "wordword wordword"), (5, None), (6, ""), (7, ("x" * 3000 + " ") * 2 + ("x" * 2999 + "y ") * 3 + ("x" * 2999 + " ") * 40)]
    docs += [(8, "kettlers " * 2 + "kettlerz " * 30 + "kottlerz " * 400), *docs[:2]]
    df = spark.createDataFrame([(*d, "e", "w", 1, 2) for d in docs], "doc_id long, text string, edit string, word string, n long, shard long").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, most=most).collect()}
    want = variants_of(vocabulary_of(docs))
    assert got == want and any(f for f, *_ in want.values()) and any(f and r != f for f, r, *_ in want.values())


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a few short words"), (2, None)], "doc_id long, text string")).count() == 0


def test_filters_let_all_words_through():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcé") for _ in range(rng.choice([7, 8, 9, 70, 80]))) for _ in range(3000)})
    sizes = {k: -(-n * spelling.BITS // 512) for k, n in Counter(spelling.shard(len(w)) for w in words).items()}
    lanes = {k: np.zeros(n * 8, np.uint64) for k, n in sizes.items()}
    for batch in spelling._filled(sizes)(iter([pa.RecordBatch.from_arrays([pa.array(words)], names=["word"])])):
        for s, at, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lanes[s][at] |= np.array([b], np.int64).view(np.uint64)[0]
    filters = spelling.Filters(lanes)
    known, passed, other = set(words), 0, 0
    for length, _, letters in spelling._by_length(words):
        h = (spelling._VALUE[letters] * spelling._powers(spelling._P, length)).sum(axis=1, dtype=np.uint64)
        assert len(filters.passed(length, h)) == len(letters)
        for row, edited in spelling.edits(letters, filters, np.frombuffer("abcé".encode("latin-1"), np.uint8)):
            for r, e in zip(row, edited, strict=True):
                assert near(letters[r].tobytes().decode("latin-1"), e)
                passed, other = passed + (e in known), other + (e not in known)
    assert passed and other < 0.02 * sum(len(w) * 3 for w in words)


def test_crc32_in_sql():
    duckdb = pytest.importorskip("duckdb")
    texts = ["", "7", "12:élan", "x" * 50]
    got = duckdb.connect().execute(f"SELECT {spelling.crc32_sql('t')} FROM (SELECT unnest(?) AS t)", [texts]).fetchall()
    assert [r[0] for r in got] == [zlib.crc32(t.encode()) for t in texts]
