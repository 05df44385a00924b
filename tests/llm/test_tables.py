import hashlib
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectionmill.llm import langid, media, merkle, mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, tokens string, length string"


def docs(spark, rows):
    """rows: id, text, lang, source; further columns have clashing names."""
    return spark.createDataFrame([(*r, 0, "k", "t", "l") for r in rows], DOCS)


# --- mixing ----------------------------------------------------------------------------------


def fill(children, budget):
    """children: name -> (cap, weight); the plain loop: share by weight, give on what is short."""
    share, left, open_ = dict.fromkeys(children, 0.0), budget, {c for c, (cap, _) in children.items() if cap > 0}
    while open_ and left > 1e-9:
        total = sum(children[c][1] for c in open_)
        full = [c for c in open_ if children[c][0] - share[c] <= left * children[c][1] / total]
        if not full:
            for c in open_:
                share[c] += left * children[c][1] / total
            break
        spent = 0
        for c in full:
            spent += children[c][0] - share[c]
            share[c] = children[c][0]
            open_.discard(c)
        left -= spent
    return share


def test_budgets_equal_the_plain_loop(spark):
    rng = random.Random(8)
    leaves = {(d, l, s): rng.choice([0, 3, 50, 400, 3000]) for d in ("web", "news", "forum") for l in ("en", "fr", "(none)") for s in "abcd" if rng.random() < 0.8}
    for budget, epochs in ((0.3, 1), (0.9, 1), (1.5, 2), (5.0, 2)):
        df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, language string, site string, tokens long")
        got = {(r["domain"], r["language"], r["site"]): r["share"] for r in mixing.leaf_budgets(df, budget, max_epochs=epochs, domain_weights=mixing.DOMAIN_WEIGHTS, language_weights=mixing.LANGUAGE_WEIGHTS, source_weights={"a": 2.0}).collect()}
        cap = Counter()
        for (d, l, s), v in leaves.items():
            for k in ((d,), (d, l), (d, l, s)):
                cap[k] += v * epochs
        want = {}
        for d, share in fill({k: (cap[k], mixing.DOMAIN_WEIGHTS[k[0]]) for k in cap if len(k) == 1}, budget * sum(leaves.values())).items():
            for l, part in fill({k: (cap[k], mixing.LANGUAGE_WEIGHTS.get(k[1], 1.0)) for k in cap if len(k) == 2 and k[0] == d[0]}, share).items():
                want |= fill({k: (cap[k], 2.0 if k[2] == "a" else 1.0) for k in leaves if k[:2] == l}, part)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_prefixes(spark):
    rows = [(i, "w " * (1 + i % 9), "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None) for i in range(400)] + [(500, None, "en", "src1"), (501, "", None, None), (None, "a b", "en", "src0")]
    out = mixing.mix(docs(spark, rows).repartition(6), budget=0.7, max_epochs=2)
    got = out.collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["tokens"] for r in got}[500] == 0
    by = defaultdict(list)
    for r in got:
        by[(r["domain"], r["language"], r["site"])].append(r)
    taken = sum(r["copies"] * r["tokens"] for r in got)
    total = sum(r["tokens"] for r in got)
    assert 0.7 * total <= taken <= 0.7 * total + 9 * len(by)
    for rs in by.values():
        low = min(r["copies"] for r in rs)
        assert {r["copies"] for r in rs} <= {low, low + 1}
    plenty = [(None, "a b", "en", "src0"), (7, "x y z", "en", "src0"), (7, "x y z", "en", "src0"), *rows]
    again = mixing.mixed(docs(spark, plenty), budget=0.7, max_epochs=2)
    counts = Counter((r["doc_id"], r["tokens"], r["language"], r["site"]) for r in mixing.mix(docs(spark, plenty), budget=0.7, max_epochs=2).collect() for _ in range(r["copies"]))
    assert again.columns == docs(spark, rows).columns and Counter((r["doc_id"], len((r["text"] or "").split()), r["lang"] or "(none)", r["source"] or "(none)") for r in again.collect()) == counts
    assert {tuple(r) for r in mixing.mix(docs(spark, rows).repartition(2), budget=0.7, max_epochs=2).collect()} == {tuple(r) for r in got}
    assert mixing.mix(docs(spark, [])).count() == 0


# --- packing ---------------------------------------------------------------------------------


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    bare = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.Encoder(packing.default_tokenizer())
    rng = random.Random(4)
    texts = ["", " ", "<|endoftext|> x", "a<|endoftext|>b <|endoftext|>", "It's  a\n\n test\t\r\n é\u00a0ü\u2028 \x1c\x85 漢字 😀🏽", "a" * 3000, " " * 3000, "\n " * 500, "a\r\nb", "x \ny", "\n", "a\n", "\na b", " a"]
    texts += ["".join(chr(rng.choice([32, 10, rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1FAFF)])) for _ in range(60)) for _ in range(600)]
    texts += ["".join(rng.choice([" ", "\n", "'s", "a", "B", "é", "1", "!", "…", "\t", "\xa0", "<|endoftext|>", "\r"]) for _ in range(12)) for _ in range(4000)]
    texts += [f"a{chr(c)} {chr(c)}b{chr(c)}{chr(c)}'{chr(c)}" for c in [*range(0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800)][::17]]
    want = [e.ids for e in bare.encode_batch(texts, add_special_tokens=False)]
    assert [50256, 2124] in want
    for start in range(0, len(texts), 500):  # the memory of words lasts from batch to batch
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts[start : start + 500])] == want[start : start + 500]
    for _ in range(3):
        encode.held = packing.REMEMBERED
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts[:50])] == want[:50] and encode.held < packing.REMEMBERED and len(encode.late) < 500


def check_packing(rows, got, capacity):
    from tokenizers import Tokenizer

    bare = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, text in rows:
        ids = [*bare.encode(text or "", add_special_tokens=False).ids, 2]
        n = len(ids)
        cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in got) // capacity)


def test_packing_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "of", "Zwölf", "x1"]) for _ in range(rng.randrange(0, 300)))) for i in range(500)]
    rows += [(1000, None), (1001, ""), (None, "null id"), (0, rows[0][1]), (0, "another text"), (1002, "word " * 9000), (1003, "<|endoftext|> x")]
    got = packing.pack(docs(spark, [(i, t, None, None) for i, t in rows]).repartition(5)).collect()
    bins, least = check_packing(rows, got, 1024)
    assert bins <= least + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_fullest_equals_brute_force():
    from itertools import product

    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        must = max(counts)
        chosen = packing.fullest(counts, must, 64)
        assert chosen[must] >= 1 and all(n <= counts[k] for k, n in chosen.items())
        best = max(s for c in product(*(range(n + 1) for n in counts.values())) if dict(zip(counts, c, strict=True))[must] >= 1 and (s := sum(k * n for k, n in zip(counts, c, strict=True))) <= 64)
        assert sum(k * n for k, n in chosen.items()) == best


# --- fingerprints ----------------------------------------------------------------------------


def py_tree(text):
    """Root, and sections as (hash, [(hash, [leaf, ...]), ...])."""
    import re

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sections, held = [], []
    paragraphs = re.findall(merkle._PARAGRAPH, text)
    for n, paragraph in enumerate(paragraphs):
        leaves = [md5(x) for x in re.findall(merkle._LEAF, paragraph)]
        held.append((md5("".join(leaves)), leaves))
        if n + 1 == len(paragraphs) or paragraph.endswith("\n\n") or held[-1][0][0] in merkle._ENDS:
            sections.append((md5("".join(h for h, _ in held)), held))
            held = []
    return md5("".join(h for h, _ in sections)), sections


def py_fingerprint(text):
    root, sections = py_tree(text)
    return root + ":" + ";".join(h[:8] + "=" + ",".join(p[:8] + "".join(x[:8] for x in leaves) for p, leaves in parts) for h, parts in sections)


def py_leaves(text):
    return {x[:8] for _, parts in py_tree(text)[1] for _, leaves in parts for x in leaves}


def py_like(a, b):
    return 1.0 if a == b else len(py_leaves(a) & py_leaves(b)) / max(1, len(py_leaves(a) | py_leaves(b)))


def py_differing(a, b):
    if a == b:
        return []
    other = py_tree(b)[1]
    sections, paragraphs = {h[:8] for h, _ in other}, {p[:8] for _, parts in other for p, _ in parts}
    return [f"{i}.{j}.{k}" for i, (h, parts) in enumerate(py_tree(a)[1]) if h[:8] not in sections for j, (p, leaves) in enumerate(parts) if p[:8] not in paragraphs for k, x in enumerate(leaves) if x[:8] not in py_leaves(b)]


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(i * 3, "".join(rng.choice("ab c.\n!é😀") for _ in range(rng.randrange(0, 900)))) for i in range(120)] + [(-5, None), (1000, "x" * 1000), (1001, "same. text."), (1002, "same. text."), (None, "of null id."), (None, "also of null id.\n\nTwo."), (7000, "a. b.\n\n" * 3000)]
    got = merkle.fingerprints(docs(spark, [(i, t, None, None) for i, t in rows]).repartition(7)).collect()
    order = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    want = Counter()
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        if i is None or order[order.index((i, text)) - len(order) + 1][0] is None:
            continue  # the order of null ids is by hashes
        text, after = text or "", after or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        want[(i, len(text), edited, py_fingerprint(text), py_fingerprint(edited), py_like(text, edited), py_like(text, after), ",".join(py_differing(text, edited)))] += 1
    found = Counter((r["doc_id"], r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"], ",".join(r["changed"])) for r in got)
    assert not want - found and len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 2


def test_fingerprint_edges(spark):
    one = merkle.fingerprints(docs(spark, [(1, "abc def", None, None)])).first()
    assert (one["edited"], one["near_next"]) == ("abc dab", 1.0)
    twice = merkle.fingerprints(docs(spark, [(1, "bbb", None, None), (1, "bbb", None, None), (1, "ccc", None, None), (2, "aaa", None, None)])).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in twice) == {(1, 3): 3, (2, 3): 1} and merkle.fingerprints(docs(spark, [])).count() == 0
    assert len({r["fingerprint"] for r in twice}) == 3 and any(r["near_next"] == 1.0 and r["edited"] == "bbb" for r in twice)
    named = spark.createDataFrame([("b", "x. y."), ("a", "x. z.")], "doc_id string, text string")
    assert {r["doc_id"] for r in merkle.fingerprints(named).collect()} == {"a", "b"}
    a = "\n".join(f"Line {i} of it. And more." for i in range(60))
    b = a.replace("Line 30 of", "Line thirty of")
    found = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.differing(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d")).first()["d"]
    assert found == py_differing(a, b) and len(found) == 1 and found[0].endswith(".0")
    import re

    plan = merkle.fingerprints(docs(spark, [(1, "a", None, None)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


# --- media -----------------------------------------------------------------------------------


def py_payload(raw):
    return raw + b" " * ((-len(raw)) % 192 if raw else 192)


@pytest.mark.parametrize("most", [0, 100])
def test_media_round_trip(spark, tmp_path, most):
    rows = [(1, b"abc"), (2, None), (3, b""), (4, "é".encode() * 96), (5, b"x" * 50_000), (6, b"abc"), (None, b"n"), (1, b"abc"), (7, b"abc" + b" " * 189), (1, b"other"), (8, b"\xff\xfe broken")]
    folder = f"file://{tmp_path}/media"
    table = spark.createDataFrame(rows, "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("x").alias("digest"), F.lit(1).alias("payload"))
    refs = media.store(table.repartition(3), folder, shard_bytes=4096, most_broadcast=most)
    refs = spark.createDataFrame(refs.collect(), refs.schema)
    got = media.features(refs, folder).collect()
    want = Counter()
    for i, raw in rows:
        payload = py_payload(raw or b"")
        want[(i, len(raw or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), True)] += 1
    assert Counter((r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["intact"]) for r in got) == want
    assert len({(r["media_sha256"], r["feature"], r["length"]) for r in got if r["id"] in (6, 7)}) == 1
    heads = {r["id"]: (r["width"], r["height"]) for r in media.headers(refs, folder).collect()}
    assert heads[5] == (192, 261) and heads[2] == (192, 1)
    names = [m.name for p in (tmp_path / "media").glob("*.tar") for m in tarfile.open(p)]
    assert len(names) == len(set(names)) == len({py_payload(raw or b"") for _, raw in rows})  # each payload once in the whole store
    bad = refs.withColumn("digest", F.lit("0" * 64)).where("id = 5")
    assert not media.features(bad, folder).first()["intact"]
    assert media.media_columns(docs(spark, [])).count() == 0


def test_image_is_a_png():
    payload = bytes(range(192)) * 3
    image = media.encode(payload)
    assert media.header(image[: media.HEADER_BYTES]) == (192, 3) and media.decode(image).tobytes() == payload
    with pytest.raises(ValueError):
        media.header(b"x" * 60)
    assert media.open_store("file:///tmp/x")[1] == "/tmp/x"


# --- language --------------------------------------------------------------------------------


def labelled(n=300):
    rng = random.Random(5)
    parts = {"en": ["the", "ing", "tion", "wh", "er "], "fr": ["eau", "qué", "les ", "tre", "oi"], "de": ["sch", "ung", "ein ", "über", "tz"]}
    return [(i, "".join(rng.choice(parts[l]) for _ in range(rng.randrange(5, 60))), l, None) for i, l in enumerate(rng.choice(list(parts)) for _ in range(n))]


def test_language_held_out(spark):
    rows = labelled() + [(1000, None, "en", None), (1001, "123 !!", "fr", None), (1002, "", None, None), (None, "the thing", None, None), (1003, "SCHUNG " * 20_000, None, None)]
    out = {r["doc_id"]: r for r in langid.identify(docs(spark, rows)).withColumn("held", langid.in_fold()).collect()}
    held = [r for r in out.values() if r["held"] and r["lang"] and r["doc_id"] < 1000]
    assert len(held) > 40 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and [out[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1000]["score"] == 0
    assert out[1003]["lang_pred"] == "de" and {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(300)} == {i: out[i]["held"] for i in range(300)}


def test_language_without_labels(spark):
    rows = [(1, "the", None, None), (2, None, None, None)]
    assert {r["lang_pred"] for r in langid.identify(docs(spark, rows)).collect()} == {"und"} and langid.identify(docs(spark, [])).count() == 0


def test_prediction_reads_the_text_alone(spark):
    model = langid.fit(docs(spark, labelled()))
    a = langid.predict(docs(spark, [(1, "the thing", "en", "a"), (2, "the thing", "de", "b")]), model).collect()
    assert a[0]["lang_pred"] == a[1]["lang_pred"] and a[0]["score"] == a[1]["score"] and 0 < (model.weights != 0).mean() < 0.9


def test_ftrl_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(langid, "L1", 0.6)
    rng = random.Random(6)
    rows = [(np.array(sorted(rng.sample(range(12), 4))), np.array([rng.uniform(0.1, 1) for _ in range(4)]), rng.randrange(3)) for _ in range(40)]
    got = langid.ftrl(rows, 3, 12, epochs=2, seed=3)
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, k):
        if abs(z[i][k]) <= langid.L1:
            return 0.0
        return -(z[i][k] - np.sign(z[i][k]) * langid.L1) / ((langid.BETA + n[i][k] ** 0.5) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(3)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            e = [np.exp(sum(v * w[i, k] for i, v in zip(at, x, strict=True))) for k in range(3)]
            for i, v in zip(at, x, strict=True):
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    s = ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / langid.ALPHA
                    z[i][k] += g - s * w[i, k]
                    n[i][k] += g * g
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(12)]) and (got == 0).any()


def test_calibration(spark):
    model = langid.fit(docs(spark, labelled(600)))
    assert 1e-3 < model.temperature < 1e3 and model.calibration_error < 0.1
    clash = docs(spark, labelled(60)).withColumns({"letters": F.lit("own"), "__letters": F.lit("own"), "score": F.lit("x")})
    assert {(r["letters"], r["__letters"]) for r in langid.predict(clash, model).collect()} == {("own", "own")}
    assert langid.calibration_error(np.array([0.9, 0.9, 0.6, 0.6]), np.array([1, 1, 0, 1])) == pytest.approx(0.1)


def test_temperature():
    rng = np.random.default_rng(0)
    true = rng.normal(size=(4000, 3)) * 2
    p = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.best_temperature(true * 5, y) - 5) < 0.6 and langid.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_counts_equal_plain_counts():
    texts = [" ab c ", "  ", " é" * 30 + " "]
    rows = {start + j: row for start, c in langid.ngram_counts(texts) for j, row in enumerate(c)}
    assert [rows[i].sum() for i in range(3)] == [sum(max(0, len(t) - n + 1) for n in range(1, langid.NGRAMS + 1)) for t in texts]
    one = next(iter(langid.ngram_counts([" ab c "])))[1][0]
    assert (one == rows[0]).all()
