"""The pipeline against plain Python, stage by stage, on a table with null ids, repeated ids, repeated rows and ties."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_near_dedup import shingles
from test_tables import check_packing, fill

from sectionmill.llm import langid, line_spread, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(12)
    parts = {"en": ["the", "ing", "tion", "wh", "er", "of"], "fr": ["eau", "qué", "les", "tre", "oi", "du"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n)) + "."
    common = [line("en", 6) for _ in range(3)]
    out = []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        lines = [line(lang, rng.randrange(4, 14)) for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), common[i % 3])
        text = "\n".join(lines)
        out.append((i, text, lang, f"src{i % 14}"))
        if i % 10 == 0:  # a copy, and one with another last word
            out += [(1000 + i, text, lang, f"src{(i + 3) % 14}"), (2000 + i, text + " " + word(lang), lang, f"src{i % 14}")]
    out += [(5, "Quite another text with its own words under a known number.", "en", "src1"), (5, "Quite another text with its own words under a known number.", "en", "src1")]
    out += [(None, line("en", 30), "en", None), (None, line("fr", 30), None, "src2"), (3000, None, "en", "src1"), (3001, "", "en", "src1"), (3002, "12 !!", "fr", "src1"), (3003, common[0], "en", "src13"), (3004, common[0], "en", "src12")]
    return [(*r, len(r[1] or "")) for r in out]


def bag(found):
    return Counter(tuple(r) for r in found)


def plain_lines(table):
    """The rows of line dedup: places of a line are in order of id (none last); all go but the first."""
    places = defaultdict(set)
    sites = defaultdict(set)
    for i, text, lang, site, n in table:
        for at, raw in enumerate((text or "").split("\n") if text is not None else []):
            line = raw.strip(" \t\r")
            if len(line) >= line_spread.MIN_CHARS:
                places[line].add((i is None, i or 0, at, text, site))
                if site is not None:
                    sites[line].add(site)
    wide = {line for line, s in sites.items() if len(s) >= line_spread.MIN_SITES}
    first = {line: min(places[line], key=lambda p: p[:3]) for line in wide}
    out = []
    for i, text, lang, site, n in table:
        lines = text.split("\n") if text is not None else []
        stays = [raw for at, raw in enumerate(lines) if (line := raw.strip(" \t\r")) not in wide or first[line] == (i is None, i or 0, at, text, site)]
        if len(stays) == len(lines):
            out.append((i, text, lang, site, n))
        elif (left := "\n".join(stays)).strip(" \t\r\n"):
            out.append((i, left, lang, site, len(left)))
    return out


def plain_classes(table):
    sets = [shingles(r[1]) for r in table]
    up = list(range(len(table)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(table))]


def plain_mix(table, budget):
    """The rows that the mix takes, within one epoch."""
    digit = lambda s: s[-1] if s and s[-1].isdigit() else ""
    domain = lambda s: {"0": "web", "4": "web", "8": "web", "1": "news", "5": "news", "9": "news", "2": "forum", "6": "forum"}.get(digit(s), "reference")
    leaves = defaultdict(list)
    for r in table:
        leaves[(domain(r[3]), r[2] or mixing.NONE, r[3] or mixing.NONE)].append(r)
    size = lambda r: len((r[1] or "").replace("\t", " ").replace("\n", " ").split(" ")) - (r[1] or "").replace("\n", " ").replace("\t", " ").split(" ").count("")
    cap = Counter()
    for k, group in leaves.items():
        for depth in (1, 2, 3):
            cap[k[:depth]] += sum(map(size, group))
    shares = {}
    for d, share in fill({k: (cap[k], mixing.DOMAIN_WEIGHTS[k[0]]) for k in cap if len(k) == 1}, budget * sum(cap[k] for k in cap if len(k) == 1)).items():
        for g, part in fill({k: (cap[k], mixing.LANGUAGE_WEIGHTS.get(k[1], 1.0)) for k in cap if len(k) == 2 and k[0] == d[0]}, share).items():
            shares |= fill({k: (cap[k], 1.0) for k in cap if len(k) == 3 and k[:2] == g}, part)
    out = []
    for k, group in leaves.items():
        whole = shares[k] >= cap[k] - 1e-9
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        order = sorted(group, key=lambda r: md5(f"{mixing.SEED}-{int(whole)}-{'' if r[0] is None else r[0]}-{md5(r[1] or '')}"))
        before = 0
        for r in order:
            if (whole and cap[k]) or (not whole and before < shares[k] - 1e-6):
                out.append(r)
            before += size(r)
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    import corpus_pipeline

    table = rows()
    frames = [table]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(frames[-1], SCHEMA).repartition(3)
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        frames.append([tuple(r) for r in out.collect()])
    packed = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(frames[-1], SCHEMA), sf_dir).collect()
    return frames, packed


def test_language_keeps_what_the_model_is_sure_of(spark, stages):
    import corpus_pipeline

    told = langid.identify(spark.createDataFrame(stages[0][0], SCHEMA)).collect()
    want = [tuple(r)[:5] for r in told if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE]
    assert bag(stages[0][1]) == bag(want)
    gone = bag(stages[0][0]) - bag(stages[0][1])
    assert {r[0] for r in gone} >= {3000, 3001, 3002} and sum(gone.values()) <= 6


def test_lines(stages):
    frames = stages[0]
    assert bag(frames[2]) == bag(plain_lines(frames[1])) and bag(frames[2]) != bag(frames[1])


def test_one_of_each_class_stays(stages):
    before, after = stages[0][2], stages[0][3]
    classes = plain_classes(before)
    kept = bag(after)
    assert not kept - bag(before) and len(after) == len(set(classes))
    least = {}
    for r, c in zip(before, classes, strict=True):
        least[c] = min(least.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    assert Counter((r[0] is None, r[0] or 0) for r in after) == Counter(least.values())


def test_mix(stages):
    import corpus_pipeline

    assert bag(stages[0][4]) == bag(plain_mix(stages[0][3], corpus_pipeline.BUDGET)) and 0 < len(stages[0][4]) < len(stages[0][3])


def test_packing(stages):
    frames, packed = stages
    bins, least = check_packing([(r[0], r[1]) for r in frames[4]], packed, 1024)
    assert bins <= least + 1


def test_run_is_the_stages(spark, stages, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    piece = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(piece, got.collect())) == Counter(map(piece, stages[1]))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_stage_takes_what_a_table_may_hold(spark, sf_dir):
    """String ids and columns whose names clash with those that the operators use."""
    import corpus_pipeline

    names = ["row", "gone", "letters", "k1", "k2", "h1", "node", "kept", "copies", "key", "tokens", "digest", "__letters", "__gone", "__id", "score", "length"]
    docs = spark.createDataFrame(rows(), SCHEMA).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).withColumns({n: F.lit("own") for n in names})
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == docs.columns
        frame = spark.createDataFrame(out.collect(), docs.schema)
    assert frame.count() > 50 and {r["gone"] for r in frame.collect()} == {"own"}
    assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).where("doc_id like 'd%'").count() > 50
