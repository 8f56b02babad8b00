"""Corpus operators against brute force, and on edge rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import gc
import gzip
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gradeloom.llm import common, decontam, fingerprint, langid, linededup, lm, packing, resemblance, sharding, simhash, toxicity, warc
from gradeloom.llm.common import BLOCKS, batches_in, blocks, sample_bound, tree_sum
from gradeloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, found int, key string"


def frame(spark, texts, ids=None, source=lambda i: f"s{i % 12}"):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", source(k), None if t is None else len(t), "x", 1.0, 2, "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [None, "", "   \n\t ", "one", "One two", "é ß ç", "!!! ???", "same text here now and then", "same text here now and then", "word " * 30000, "a\x00b c\x01d  e \n\n f", "日本 語 の 文"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    from compare import of_spark, of_sql

    assert of_spark(QUERIES[name](spark, sf_dir)) == of_sql(sf_dir, ORACLE_SQL[name])


# language id


def test_langid_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op1_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").toPandas()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert out.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_langid_edges(spark):
    train = frame(spark, ["the cat and the dog"] * 3 + ["der hund und die katze"] * 3).withColumn("lang", F.when(F.col("doc_id") < 3, "en").otherwise("de"))
    model = langid.fit(train, min_count=1)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame(spark, EDGE + ["the dog", "die katze"]), model).collect()}
    assert [out[k][0] for k in (0, 1, 2, 6)] == ["und"] * 4 and out[0][1] == 0
    assert (out[len(EDGE)][0], out[len(EDGE) + 1][0]) == ("en", "de")
    assert all(v[0] in ("en", "de", "und") and 0 <= v[1] <= 1 for v in out.values())
    assert langid.predict(frame(spark, []), model).count() == 0
    none = langid.fit(frame(spark, []))
    assert {r["lang_pred"] for r in langid.predict(frame(spark, ["abc"]), none).collect()} == {"und"}
    nulls = langid.predict(frame(spark, ["the cat", "the cat"], ids=[None, None]), model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in nulls] == [(None, "en")] * 2


def test_bloom_has_no_false_negative():
    codes = np.unique(langid.trigrams(["some words of a text", "und noch welche"])[0])
    slots = np.zeros(1 << 12, np.uint8)
    for at in langid._slots(codes, 1 << 12, 3):
        slots[at] |= 2
    hit = np.bitwise_and.reduce([slots[at] for at in langid._slots(codes, 1 << 12, 3)])
    assert (hit == 2).all()


def test_langid_against_exact_sets(spark, docs):
    """With sets of trigrams in place of the filters: the same languages, and scores that false positives alone can move."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~held))
    counts: dict[str, Counter] = {}
    for r in docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect():
        counts.setdefault(r["lang"], Counter()).update(langid.trigrams([r["text"]])[0].tolist())
    share = {lang: {g: n / c.total() for g, n in c.items() if n >= 2} for lang, c in counts.items()}
    most = Counter()
    for by in share.values():
        for g, v in by.items():
            most[g] = max(most[g], v)
    own = {lang: {g for g, v in by.items() if v >= 0.3 * most[g]} for lang, by in share.items()}
    assert sorted(own) == model.languages
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    same = 0
    for r in docs.collect():
        grams = langid.trigrams([r["text"] or ""])[0].tolist()
        if not grams:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        hits = {lang: sum(g in s for g in grams) / len(grams) for lang, s in own.items()}
        same += got[r["doc_id"]][0] == max(sorted(hits), key=hits.get)
        assert abs(got[r["doc_id"]][1] - max(hits.values())) < 0.03
    assert same >= 0.99 * len(got)


# fingerprints


def _shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def test_fingerprints_against_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    errors = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = _shingles(text), _shingles(edited), _shingles(after)
        errors += [r["near_edited"] - len(a & b) / max(1, len(a | b)), r["near_next"] - len(a & c) / max(1, len(a | c))]
        if len(a) < fingerprint.K:
            assert r["n_shingles"] == len(a)
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.01
    assert [str(h) for h in sorted({_chain(s) for s in _shingles(rows[0][1])})[: fingerprint.K]] == got[rows[0][0]]["fingerprint"].split()


def _chain(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def test_fingerprint_edges_and_merge(spark):
    out = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(frame(spark, EDGE)).collect()}
    assert len(out) == len(EDGE) and out[7]["fingerprint"] == out[8]["fingerprint"] and out[0]["fingerprint"] == ""
    assert out[8]["near_next"] == 1.0 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out.values())
    assert fingerprint.edited_fingerprints(frame(spark, [])).count() == 0
    one = fingerprint.edited_fingerprints(frame(spark, ["a b c d e f"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"a b c d a b").hexdigest() and one["near_next"] == 1.0
    odd = fingerprint.edited_fingerprints(frame(spark, ["x y", "x y", "z", "q"], ids=[5, 5, None, -7])).collect()
    assert sorted(str(r["doc_id"]) for r in odd) == ["-7", "5", "5", "None"]
    sparse = frame(spark, [f"t{i} " * 9 for i in range(40)], ids=[i**7 - 10**9 for i in range(40)])
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_fingerprints(sparse).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in sparse.collect()), reverse=True)
    for i, (key, t) in enumerate(rows):
        m = len(t) // 3
        assert got[key] == hashlib.sha256((t[: len(t) - m] + rows[(i + 1) % 40][1][:m]).encode()).hexdigest()
    parts = spark.createDataFrame([("k", [1, 5, 9]), ("k", [2, 5]), ("e", [])], "g string, s array<long>")
    merged = {r["g"]: r["s"] for r in fingerprint.merge_sketches(parts, ["g"], "s", 3).collect()}
    assert merged == {"k": [1, 2, 5], "e": []}
    c = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4])], "a array<long>, b array<long>").select(fingerprint.containment(F.col("a"), F.col("b"), 128)).first()
    assert c[0] == 1.0


# decontamination


def _contaminated(text, items, n=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, met = find(text), set(), set()
    for item, t in items:
        w = find(t)
        size = min(n, len(w))
        if not size or item is None:
            continue
        runs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in runs:
                hit |= set(range(i, i + size))
                met.add(str(item))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


ITEMS = [(1, "Alpha beta"), (2, "a b c d e f g h i j k l"), (10, "x1 y2"), (None, "word"), (3, None), (4, ""), (5, "日本")]


@pytest.mark.parametrize("block", [500_000, 2])
def test_decontamination_against_brute_force(spark, block):
    texts = [*EDGE, "say alpha BETA, alpha beta! x1-y2", "z a b c d e f g h i j k l z a b", "c d e f g h i j k", "b c d e f g h i j k", "alpha\nbeta x1"]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.scan(frame(spark, texts), bench, block_windows=block, as_col="hits").select("doc_id", "hits.*").collect()
    for r in rows:
        want = _contaminated(texts[r["doc_id"]], ITEMS)
        spans = sum(b - a for a, b in r["spans"])
        assert (r["n_words"], spans, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) == want


def test_decontamination_removes_spans_or_documents(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, [None, "", "clean text", "é alpha beta ü", "alpha beta"])
    gone = decontam.clean(docs, bench)
    assert sorted(r["doc_id"] for r in gone.collect()) == [0, 1, 2] and gone.columns == docs.columns
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontam.clean(docs, bench, remove="spans", n_chars_col="n_chars").collect()}
    assert cut == {0: (None, None), 1: ("", 0), 2: ("clean text", 10), 3: ("é \n ü", 5)}
    empty = decontam.report(docs, bench.limit(0)).collect()
    assert len(empty) == 5 and not any(r["contaminated"] for r in empty)
    assert decontam.report(docs.limit(0), bench).count() == 0


# sharding


def test_shards_round_trip_and_versions(spark, tmp_path):
    table = sharding.ShardTable(spark, str(tmp_path / "t"), target_bytes=1 << 20, base_bytes=1 << 10)
    docs = frame(spark, EDGE)
    for _ in range(5):
        table.append(docs)
    before = table.manifest()
    assert (before.version, len(before.runs)) == (5, 5)
    after = table.compact()
    assert after.version == 6 and len(after.runs) == 1
    assert table.read().exceptAll(table.read(5)).count() == 0 and table.read().count() == 5 * len(EDGE)
    with pytest.raises(sharding.CommitConflict):
        table._commit(sharding.Manifest(6, after.schema, []))
    assert table.manifest().runs == after.runs
    # an append that starts from an old version is committed behind the newest
    stale, real = table.manifest(3), table.manifest
    table.manifest = lambda version=None, calls=[]: (calls.append(1), stale if len(calls) == 1 else real(version))[1]  # noqa: B006
    assert table.append(docs).version == 7 and table.read().count() == 6 * len(EDGE)
    table.manifest = real
    table._commit(sharding.Manifest(8, after.schema, after.runs))
    assert table.vacuum() >= 5 and table.read().count() == 5 * len(EDGE)
    assert sharding.ShardTable(spark, str(tmp_path / "t")).manifest().version == 8
    empty = sharding.ShardTable(spark, str(tmp_path / "e"))
    with pytest.raises(FileNotFoundError):
        empty.read()
    empty.append(docs.limit(0))
    assert empty.read().count() == 0 and empty.compact().version == 1
    assert (sharding.tier_of(10), sharding.tier_of(5 << 20)) == (0, 2)


# near duplicates


def _simhash(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_of_texts():
    texts = [*EDGE, "a b c d e f g", " ".join(map(str, range(70000)))]
    assert simhash.simhash_texts(texts).tolist() == [_simhash(t) for t in texts]
    assert simhash.simhash_texts([]).tolist() == []


def _components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("limit", [4096, 0])
def test_links_and_components_against_brute_force(spark, monkeypatch, limit):
    """limit 0: every key is crowded, and links go by shared neighbours."""
    monkeypatch.setattr(simhash, "KEY_PAIRS", limit)
    rng = random.Random(7)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(10):
            fps.append(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(set(fps), key=lambda v: v - (1 << 64) if v >> 63 else v)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges.collect())
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert [got.get(v, v) for v in signed] == [signed[r] for r in _components(fps)]


def test_near_duplicate_query(spark, docs, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op5_simhash_near_dedup"](spark, sf_dir).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [_simhash(t) for _, t in rows]
    roots = _components(fps)
    assert all(got[k]["fingerprint"] == f"{fp:016x}" and got[k]["component_id"] == rows[root][0] for (k, _), fp, root in zip(rows, fps, roots, strict=True))


def test_near_duplicate_edges(spark):
    docs = frame(spark, EDGE)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == 0 and got[8] == 7
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    again = simhash.keep_first(frame(spark, ["a b c", "a b c", "q r s t"], ids=[3, 3, None]))
    assert sorted(str(r["doc_id"]) for r in again.collect()) == ["3", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    path = spark.createDataFrame([(i + 1, i) for i in range(60)], "a long, b long")
    assert {r["root"] for r in simhash.components(path).collect()} == {0}


# toxicity


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op6_toxicity"](spark, sf).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    pos, neg = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert (pos["predicted"] == 1).mean() > 0.85 and (neg["predicted"] == 0).mean() > 0.97
    assert out["score"].between(0, 1).all() and docs.count() > len(out)


def test_toxicity_edges(spark):
    docs = frame(spark, EDGE)
    model = toxicity.fit(docs, spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, toxic int"))
    assert model.trees is None and model.base == 1.0
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("good fine calm tree leaf root bark wood path hill rain snow wind moon star lake".split()) for _ in range(n))
    texts = [f"{words(10)} {'awful' if i % 3 == 0 else words(2)} {words(10)}" for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(1, None), (2, 5)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, texts), labels, trees=5)
    assert "awful" in model.lexicon
    got = toxicity.score(frame(spark, [*EDGE, texts[0], texts[1]]), model, as_col="s")
    rows = {r["doc_id"]: r["s"] for r in got.collect()}
    assert len(rows) == len(EDGE) + 2 and all(0 <= v <= 1 for v in rows.values()) and rows[len(EDGE)] > 0.5 > rows[len(EDGE) + 1]
    kept = toxicity.reject(frame(spark, [*EDGE, texts[0], texts[1]]), model)
    assert kept.columns == docs.columns and len(EDGE) not in {r["doc_id"] for r in kept.collect()}
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert toxicity.features(None, {}, frozenset()) == [0.0] * len(toxicity.FEATURES)
    assert toxicity._plain("aw.fu1") == "awful" and toxicity._plain("aaawful") == "awful"


def _walk(lines, x):
    """Value of a tree in its printed form."""
    i = 0
    while True:
        line = lines[i].strip()
        if m := re.match(r"Predict: (\S+)", line):
            return float(m[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        depth = len(lines[i]) - len(lines[i].lstrip())
        if x[int(m[1])] <= float(m[2]):
            i += 1
        else:
            i = next(k for k in range(i + 1, len(lines)) if lines[k].strip().startswith("Else") and len(lines[k]) - len(lines[k].lstrip()) == depth) + 1


def test_toxicity_scores_against_a_walk_of_its_trees(spark):
    rng = random.Random(2)
    words = "good fine calm tree leaf root bark wood path hill rain snow wind moon star lake".split()
    texts = [" ".join(rng.choice(words) for _ in range(12)) + (" you awful !!" if i % 3 == 0 else " THE END.") for i in range(300)]
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame([(i, int(i % 3 == 0 or i % 17 == 0)) for i in range(300)], "doc_id long, toxic int"), trees=6)
    strong = frozenset(w for w, v in model.lexicon.items() if v >= 1.0)
    trees = [[line for line in t.toDebugString.split("\n")[1:] if line.strip()] for t in model.trees.trees]
    steps, values = model.steps.boundaries.toArray(), model.steps.predictions.toArray()
    probe = [*EDGE, *texts[:30], "You are aw.ful and AWFUL, awfuuul a w f u l"]
    got = {r["doc_id"]: r["s"] for r in toxicity.score(frame(spark, probe), model, as_col="s").collect()}
    for i, text in enumerate(probe):
        x = toxicity.features(text, model.lexicon, strong)
        margin = sum(w * _walk(t, x) for w, t in zip(model.trees.treeWeights, trees, strict=True))
        p = 1 / (1 + math.exp(-2 * margin))
        assert abs(got[i] - float(np.clip(np.interp(p, steps, values), 0, 1))) < 1e-9


def test_toxicity_features_by_hand():
    lexicon, strong = {"awful": 2.0, "bad": 0.8}, frozenset(["awful"])
    text = "You AWFUL man, aw.fu1 and bad! go"
    x = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon, strong), strict=True))
    assert x["log_words"] == math.log(8) and x["strong_count"] == 1 and x["strong_kinds"] == 1 and x["hidden_count"] == 1
    assert x["weight_top"] == 2.0 and abs(x["weight_rate"] - 2.8 / 7) < 1e-12 and x["near_you_count"] == 2 and abs(x["you_rate"] - 1 / 7) < 1e-12
    assert abs(x["capital_rate"] - 6 / len(text)) < 1e-12 and abs(x["shout_rate"] - 1 / 7) < 1e-12 and abs(x["punctuation_rate"] - 3 / len(text)) < 1e-12
    assert abs(x["exclaim_rate"] - 1 / len(text)) < 1e-12 and abs(x["digit_rate"] - 1 / len(text)) < 1e-12 and x["stretch_rate"] == x["spaced_rate"] == 0
    spaced = dict(zip(toxicity.FEATURES, toxicity.features("a w f u l sooo", lexicon, strong), strict=True))
    assert spaced["spaced_rate"] == 1 / 6 and spaced["stretch_rate"] == 1 / 6


# language model


def _some_units(rng, n=12):
    v, width = lm.VOCABULARY, lm.WIDTH
    vectors = np.vstack([rng.standard_normal((n, width)) * 0.5, np.zeros((1, width))])
    vectors[:n, 0] = 1
    bigram = np.vstack([np.log(rng.dirichlet(np.ones(n), n)), np.zeros((1, n))])
    begins = (np.arange(n) % 2).astype(float)
    return lm.Units(rng.integers(0, n, v), n, rng.integers(0, n, v), n, begins, vectors, bigram, np.zeros(v), np.zeros(v, np.int64), np.zeros((n, 1)), np.zeros((n, n)))


def _some_net(rng, units):
    net = lm.Attention.new(units.count)
    net.weights = {k: rng.standard_normal(w.shape) * 0.3 for k, w in net.weights.items()}
    return net


def test_lm_gradients():
    rng = np.random.default_rng(0)
    units = _some_units(rng)
    net = _some_net(rng, units)
    ids, sizes = rng.integers(0, 1000, 150), np.array([100, 1, 49])
    x, y, at = lm.windows(units, ids, sizes)
    assert sorted(at.tolist()) == np.flatnonzero(y.ravel() >= 0).tolist()  # every subword is scored once
    _, g = lm.gradients(net, units, x, y)
    for k, w in net.weights.items():
        for _ in range(4):
            i = tuple(int(rng.integers(0, s)) for s in w.shape)
            old, e = w[i], 1e-5
            w[i] = old + e
            up = lm.gradients(net, units, x, y)[0]
            w[i] = old - e
            down = lm.gradients(net, units, x, y)[0]
            w[i] = old
            assert abs(g[k][i] - (up - down) / 2 / e) < 1e-6
    # the future of a place does not change its probability, nor does another text
    a, _ = lm.log_probabilities(net, units, ids, sizes)
    changed = ids.copy()
    changed[90:100] = 7
    b, _ = lm.log_probabilities(net, units, changed, sizes)
    assert np.allclose(a[:90], b[:90]) and np.allclose(a[100:], b[100:])


def test_lm_against_a_naive_forward_pass():
    """Place by place: softmax over the places before it in its window, of content and distance, then over the units."""
    rng = np.random.default_rng(1)
    units = _some_units(rng)
    net = _some_net(rng, units)
    ids, sizes = rng.integers(0, 1000, 90), np.array([70, 20])
    got, begin = lm.log_probabilities(net, units, ids, sizes)
    w, at = net.weights, 0
    for n in sizes.tolist():
        text = ids[at : at + n].tolist()
        entered = [int(units.enter[i]) for i in [lm.END, *text[:-1]]]
        for k in range(n):
            first = max(0, k // lm.STRIDE * lm.STRIDE - (lm.CONTEXT - lm.STRIDE))
            q = units.vectors[entered[k]] @ w["score"]
            weight = np.array([math.exp(q @ units.vectors[entered[j]] + w["distance"][k - j]) for j in range(first, k + 1)])
            seen = weight @ units.vectors[entered[first : k + 1]] / weight.sum()
            p = np.exp(seen @ w["head"] + units.bigram[entered[k]])
            p /= p.sum()
            assert abs(got[at + k] - math.log10(p[units.of[text[k]]])) < 1e-5
            assert abs(begin[at + k] - math.log10(p @ units.begins)) < 1e-5
        at += n


def test_lm_query(spark, docs, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op7_lm_scoring"](spark, sf_dir).collect()}
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2}
    c = Counter(w for k, ws in rows if k not in held for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for k, ws in rows:
        r, tokens = got[k], [*ws, None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in held, len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert abs(r["base_score"] - sum(np.log10((c[t] + 1) / (n + v + 1)) for t in tokens)) < 1e-6 * len(tokens)
        assert -20 * len(tokens) < r["score"] < 0


def _learned(rows):
    """Texts and words cut, and the units learned from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    parts = lm.cut_texts(rows.select(F.col("doc_id").cast("string").alias("id"), F.lit(False).alias("held"), F.coalesce("text", F.lit("")).alias("text")), path)
    counts = parts.where("kind = 1").groupBy("data").agg(F.sum("n").alias("n"))
    texts = parts.where("kind = 0").select("id", "data")
    return texts, counts, lm.learn_units(texts, counts, path)


def test_lm_probabilities_sum_to_one(docs):
    texts, _, units = _learned(docs.limit(40))
    assert np.allclose(np.exp(units.bigram[:-1]).sum(axis=1), 1, atol=1e-4)
    for before in (0, 5, units.inputs - 1):
        p = np.exp(units.in_unit(np.full(lm.VOCABULARY, before), np.arange(lm.VOCABULARY)))
        assert np.allclose(np.bincount(units.of, weights=p, minlength=units.count), 1, atol=1e-3)
    begins = lm.starts(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert (units.begins[units.of] == begins).all()  # no unit holds both kinds
    assert np.isfinite(units.vectors).all() and np.sqrt((units.vectors**2).sum(axis=1)).max() < 4.001


def test_lm_cuts_as_the_coder_does(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [t or "" for t in EDGE] + ["x\u00a0y \u2028z \u0085", "Don't  it's\ta"] + [r["text"] or "" for r in docs.limit(50).collect()]
    cutter = lm.Cutter(path)
    for t in texts:
        words = lm.words_of(t)
        ids, sizes = cutter.ids(cutter.numbers(words))
        want = [lm.coder(path).encode_ordinary(" " + w.decode()) for w in words]
        assert ids.tolist() == [i for part in want for i in part] and sizes.tolist() == [len(p) for p in want]
        assert lm.starts(path)[ids].sum() == len(words)


def test_lm_words_in_arrow(docs):
    texts = [t or "" for t in EDGE] + ["a\x0bb\x0cc\x1cd\x1fe\u00a0f\u2028g", " ", "\n\n x", "ÀB İ"] + [r["text"] or "" for r in docs.limit(60).collect()]
    at, words, n = lm.words_in(texts)
    assert [words[i] for i in at] == [w for t in texts for w in lm.words_of(t)] and n.tolist() == [len(lm.words_of(t)) for t in texts]
    assert [len(x) for x in lm.words_in([])] == [0, 0, 0] and [len(x) for x in lm.words_in([""])] == [0, 0, 1]


def test_lm_word_keys_are_exact():
    rng = np.random.default_rng(2)
    words = list({tuple(rng.integers(0, 50257, rng.integers(1, 7)).tolist()) for _ in range(3000)} | {(0,), (0, 0), (0, 0, 0), (0, 0, 0, 0), (50256,)})
    sizes = np.array([len(w) for w in words])
    keys = lm.word_keys(np.array([i for w in words for i in w]), np.cumsum(sizes) - sizes, sizes)
    short = sizes <= 4
    assert (keys[~short] == 0).all() and len(set(keys[short].tolist())) == short.sum() and (keys[short] > 0).all()


def test_lm_beats_its_base_and_its_ablation(spark, monkeypatch):
    """Held-out log10 scores a token: over the word counts alone, once these spell unknown words too, and over the same model with the attention untrained."""
    sf = "/root/testdata/sf0.01"

    def held(out):
        sums = out.where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score"), F.sum("attention_score")).first()
        return [sums[i] / sums[0] for i in (1, 2, 3)]

    _, score, alone = held(QUERIES["op7_lm_scoring"](spark, sf))
    _, base, _ = held(lm.fit_and_score(spark.read.parquet(f"{sf}/documents.parquet"), mix=0.0))
    monkeypatch.setattr(lm, "train", lambda texts, units: lm.Attention.new(units.count))
    _, no_score, no_alone = held(QUERIES["op7_lm_scoring"](spark, sf))
    assert score > base + 0.1 and score > no_score + 0.08 and alone > no_alone + 0.15


def test_lm_scores_word_by_word(spark, monkeypatch, docs):
    """Every word's probability from the subwords' and the counts, frequent words and joined ones alike."""
    seen = {}
    units, train = lm.learn_units, lm.train
    monkeypatch.setattr(lm, "learn_units", lambda *a: seen.setdefault("units", units(*a)))
    monkeypatch.setattr(lm, "train", lambda *a: seen.setdefault("net", train(*a)))
    rows = docs.limit(60).union(frame(spark, EDGE, ids=[-i - 1 for i in range(len(EDGE))]).select(docs.columns))
    got = {r["doc_id"]: r for r in lm.fit_and_score(rows, frequent=40).collect()}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    begins, cutter, texts = lm.starts(path), lm.Cutter(path), [(r["doc_id"], lm.words_of(r["text"])) for r in rows.collect()]
    c = Counter(w for k, ws in texts if not got[k]["held_out"] for w in [*ws, b" "])
    whole = sum(c.values()) + len(c) + 1
    for k, ws in texts:
        tokens = [*ws, b" "]
        ids, sizes = cutter.ids(cutter.numbers(tokens))
        logp, begin = lm.log_probabilities(seen["net"], seen["units"], ids.astype(np.int64), np.array([len(ids)]))
        at, score, alone = 0, 0.0, 0.0
        for w, n in zip(tokens, sizes.tolist(), strict=True):
            one = logp[at : at + n].sum() - begin[at] + (begin[at + n] if at + n < len(ids) else 0)
            assert begins[ids[at]] and not begins[ids[at + 1 : at + n]].any()
            score += math.log10(lm.MIX * 10**one + (1 - lm.MIX) * (c[w] + 1 if c[w] else 10**one) / whole)
            alone += one
            at += n
        assert abs(got[k]["score"] - score) < 1e-4 * len(tokens) and abs(got[k]["attention_score"] - alone) < 1e-4 * len(tokens)


def test_lm_edges(spark):
    out = lm.fit_and_score(frame(spark, EDGE).union(frame(spark, ["null id"], ids=[None]))).collect()
    assert len(out) == len(EDGE) + 1 and {r["doc_id"]: r["n_tokens"] for r in out}[0] == 1
    assert all(np.isfinite(r["score"]) for r in out)
    assert lm.fit_and_score(frame(spark, [])).count() == 0


# line dedup


def test_line_dedup_edges(spark):
    shared = "Shared  line of many sites"
    texts = [f"own {i}\n {shared.upper()} \n\nlast {i}" for i in range(9)] + EDGE + [shared]
    out = {r["doc_id"]: r for r in linededup.clean(frame(spark, texts)).collect()}
    assert len(out) == len(texts)
    assert [out[i]["__removed"] for i in range(9)] == [0] + [1] * 8 and out[3]["__text"] == "own 3\n\nlast 3"
    assert out[len(texts) - 1]["__text"] == "" and out[9]["__text"] is None and out[10]["__text"] == ""
    every = {r["doc_id"]: r["__removed"] for r in linededup.clean(frame(spark, texts), keep_first=False).collect()}
    assert every[0] == 1
    lone = linededup.clean(frame(spark, texts, source=lambda i: None))
    assert lone.where("__removed > 0").isEmpty()
    assert linededup.clean(frame(spark, [])).count() == 0


# WARC


def test_warc_round_trip_edges(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", ""), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 40), (7, "u", big + "x"), (7, "u", big + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        first = max((s for s in same if s is not None), default=None)
        revisit = len(data) >= 1000 and i != first
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def _record(i, body=b"hello"):
    block = warc.HTTP.encode() + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, lambda b: gzip.compress(b)])
def test_salvage_goes_on_behind_damage(pack):
    parts = [pack(_record(i, b"body %d " % i * 50)) for i in range(6)]
    whole = b"".join(parts)
    assert [x[0] for x in warc.salvage(whole)] == ["record"] * 6 and list(warc.salvage(b"")) == []
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = parts[0] + b"garbage" + parts[1] + bytes(hurt) + parts[3] + parts[4][: len(parts[4]) // 2] + parts[5] + b"tail"
    found = list(warc.salvage(data))
    ids = [x[3]["warc-record-id"] for x in found if x[0] == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    covered = sorted((x[1], x[1] + x[2]) for x in found)
    lone = gzip.compress(_record(0) + b"junk" + _record(1) + _record(2)[:-9])
    inside = list(warc.salvage(parts[0] + lone)) if pack is not bytes else None
    if inside:
        assert [x[3]["warc-record-id"] for x in inside if x[0] == "record"] == [f"<urn:page:{i}>" for i in (0, 0, 1)]
        assert [x[1:3] for x in inside[1:]] == [(len(parts[0]), len(lone))] * 4 and [x[0] for x in inside[1:]] == ["record", "gap", "record", "gap"]
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


# packing


def test_cached_tokenizer_equals_the_tokenizer(docs):
    import public_tokenizers as public

    coder = packing.CachedTokenizer(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"))
    odd = ["  a", "a   b", " \n b", "a\n\nb", "a \n  b", "a\tb c", "x\x01y", "don't it's. o.k.", "<|endoftext|> a <|endoftext|>b.", "a  b", "\n", "x,", "1,", "a,1.", "end.  x", "\r\nc d"]
    texts = [t or "" for t in EDGE] + odd + [r["text"] for r in docs.limit(100).collect()]
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == want


def test_packing(spark, docs):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    source = docs.select("doc_id", "text").union(frame(spark, EDGE, ids=[-i - 1 for i in range(len(EDGE))]).select("doc_id", "text"))
    rows = packing.pack(source).collect()
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    used = Counter()
    for key, text in source.collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == 2048 for r in parts[1:])
        for r in parts:
            assert zlib.crc32(np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        used[r["sequence_id"]] += r["length"]
    for spans in places.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
    assert max(used.values()) <= 2048 and len(used) <= sum(used.values()) / 2048 * 1.03 + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 5, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    bins = packing.OpenBins(10, 1)
    assert [bins.put(n)[0] for n in (6, 7, 3)] == [0, 1, 1]


# the pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf_dir)
        assert after.columns == docs.columns and set(after.dtypes) == set(docs.dtypes)
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.count() <= now.count()
        if name == "simhash near-dedup":
            fps = [_simhash(r["text"]) for r in after.collect()]
            assert _components(fps) == list(range(len(fps)))
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert all(_contaminated(r["text"], items)[1] == 0 for r in after.collect())
        now = after
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.collect()}


def _packed_sizes(sizes):
    """Bins of one packer that gets pieces of these sizes, and how many it closed to make room."""
    bins, closed = packing.OpenBins(packing.LENGTH, packing.OPEN_BINS), 0
    for some in packing.rounds([pd.DataFrame({"length": sizes[a : a + 10_000]}) for a in range(0, len(sizes), 10_000)], packing.ROUND):
        for n in some["length"]:
            before = bins.open
            made = bins.made
            bins.put(int(n))
            closed += bins.made > made and before == packing.OPEN_BINS
            assert bins.open <= packing.OPEN_BINS
    return bins.made, closed


@pytest.mark.parametrize("middle", [5.0, 6.4, 7.2])
def test_packing_fill_of_a_full_packer(middle):
    """Bins do close, and the sequences are within 1 % of what no packing can be under."""
    sizes = np.clip(np.random.default_rng(2).lognormal(middle, 1.1, packing.PACKER_ROWS).astype(int), 1, packing.LENGTH - 1)
    made, closed = _packed_sizes(sizes)
    assert closed > 0 or middle < 6
    assert made <= 1.01 * max(-(-int(sizes.sum()) // packing.LENGTH), int((sizes > packing.LENGTH // 2).sum()))


def test_packing_rounds_keep_every_row():
    frames = [pd.DataFrame({"length": np.arange(n), "k": k}) for k, n in enumerate([0, 5, 17, 1, 30])]
    out = list(packing.rounds(iter(frames), 10))
    assert [len(f) for f in out] == [10, 10, 10, 10, 10, 3]
    assert all(f["length"].is_monotonic_decreasing for f in out)
    assert sorted(map(tuple, pd.concat(out).to_numpy().tolist())) == sorted(map(tuple, pd.concat(frames).to_numpy().tolist()))


def test_packing_deals_equal_rows_evenly(spark):
    """Nine of ten rows have no id and no text: the packers still get as many pieces each."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 10 == 0, F.lit("some words here")).alias("text"))
    out = packing.pack(docs, packer_rows=2_500).groupBy((F.col("sequence_id") / (1 << 40)).cast("int").alias("packer")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), F.count_distinct("sequence_id").alias("bins")).collect()
    assert len(out) == 8 and all(abs(r["n"] - 2500) < 50 for r in out)
    assert all(r["bins"] == -(-r["tokens"] // packing.LENGTH) for r in out)


def test_keep_first_goes_by_id_and_text(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(4))
    kept = lambda texts, ids: sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_first(frame(spark, texts, ids=ids)).collect())
    # null ids of unrelated texts stay; one of them has a copy with an id
    assert kept([a, b, c, c], [None, None, None, 7]) == sorted([("None", a), ("None", b), ("7", c)])
    # id 5 stands for two texts; one of them is a copy of id 1's
    assert kept([a, a, b, d, b], [1, 5, 5, 6, 9]) == sorted([("1", a), ("5", b), ("6", d)])


def _resemblance(x, y):
    a, b = _shingles(x), _shingles(y)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("crowd", [32, 2])
def test_near_dedup_stage_catches_resemblance(spark, monkeypatch, crowd):
    """Copies with a run of words changed: those at 0.8 or more go, those below stay, however many bits they differ in."""
    import corpus_pipeline

    monkeypatch.setattr(resemblance, "CROWD", crowd)
    rng = random.Random(9)
    texts = []
    for k in range(40):
        words = [f"w{rng.randrange(90000)}" for _ in range(120)]
        near = list(words)
        n = 5 if k % 2 else 30
        near[40 : 40 + n] = [f"x{rng.randrange(90000)}" for _ in range(n)]
        texts += [" ".join(words), " ".join(near)]
    at = [_resemblance(texts[i], texts[i + 1]) for i in range(0, 80, 2)]
    assert min(at[1::2]) >= 0.8 > max(at[::2])
    assert sum((_simhash(texts[i]) ^ _simhash(texts[i + 1])).bit_count() > 2 for i in range(2, 80, 4)) > 10
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "").collect()}
    assert kept == {i for i in range(80) if i % 4 != 3}


def _heads(seed, n, head, tail, edited):
    """Pairs of texts of one long common head and own tails: within a pair the tails differ in `edited` words."""
    rng = random.Random(seed)
    common = [f"h{rng.randrange(10**6)}" for _ in range(head)]
    texts = []
    for _ in range(n):
        own = [f"t{rng.randrange(10**9)}" for _ in range(tail)]
        near = own[: tail - edited] + [f"u{rng.randrange(10**9)}" for _ in range(edited)]
        texts += [" ".join(common + own), " ".join(common + near)]
    return texts


@pytest.mark.parametrize("tile", [2048, 50])
def test_near_dedup_of_texts_with_a_common_head(spark, monkeypatch, tile):
    """60 pairs at 0.81 of one head, 0.78 across pairs: every band key is crowded, and of each pair one text stays."""
    monkeypatch.setattr(resemblance, "TILE", tile)
    texts = _heads(3, 60, 240, 34, 28)
    at = [_resemblance(texts[i], texts[i + 1]) for i in range(0, 120, 2)]
    over = [_resemblance(texts[i], texts[j]) for i in range(0, 120, 7) for j in range(120) if i // 2 != j // 2]
    assert min(at) >= 0.8 > max(over) > 0.75
    rows = frame(spark, texts).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("node"), "text")
    node = {r["id"]: r["node"] for r in rows.collect()}
    got = {tuple(r) for r in resemblance.pairs(rows, rows.select("id", "node")).collect()}
    assert got == {tuple(sorted((node[i], node[i + 1]))) for i in range(0, 120, 2)}
    kept = {r["doc_id"] for r in simhash.keep_first(frame(spark, texts), least=0.8).collect()}
    assert all(i % 2 == 0 for i in kept) and len(kept) > 55  # a few pairs are within two bits of others


def test_resemblance_links_equal_all_pairs(spark, monkeypatch):
    """Crowds of several families, lengths and texts between them: the components of all pairs at 0.8 or more."""
    monkeypatch.setattr(resemblance, "CROWD", 3)
    monkeypatch.setattr(resemblance, "TILE", 64)
    monkeypatch.setattr(resemblance, "PART", 5)
    rng = random.Random(12)
    texts = _heads(4, 12, 120, 20, 14)
    for _ in range(4):
        words = [f"f{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(14):
            near = list(words)
            k, n = rng.randrange(100), rng.randrange(1, 40)
            near[k : k + n] = [f"g{rng.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(near[: rng.randrange(120, 151)]))
    texts += ["", "   ", "one two", "one two", None]
    rows = frame(spark, texts).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("node"), "text")
    firsts = rows.groupBy("node").agg(F.min("id").alias("id"))
    node = {r["id"]: r["node"] for r in rows.collect()}
    sets = {node[i]: set(resemblance.shingle_set(t).tolist()) for i, t in enumerate(texts)}

    def classes(edges):
        root = {n: n for n in sets}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(n for n in sets if find(n) == r) for r in {find(n) for n in sets}}

    near = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) >= 0.8 * len(x | y)}
    got = {tuple(r) for r in resemblance.pairs(rows, firsts).collect()}
    assert got <= near and classes(got) == classes(near)


def test_lm_unknown_words_share_their_kind(spark):
    """The probabilities of many one-word texts of unknown words, and of the known ones, sum to no more than 1."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2][:400]
    known = "some words of a text that is learned from"
    rows = frame(spark, [known] * 3 + [f"x{i}q" for i in ids] + known.split(), ids=[1, 3, 4, *ids, *range(10_000, 10_000 + 9)])
    out = lm.fit_and_score(rows.where("doc_id < 10000 OR crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2")).where("held_out AND n_tokens = 2").collect()
    assert len(out) > 350 and all(r["n_known"] in (1, 2) for r in out)
    assert sum(10 ** r["score"] for r in out) <= 1 and sum(10 ** r["attention_score"] for r in out) <= 1
    assert sum(10 ** r["base_score"] for r in out) > 1  # the base gives the kind's share to each


def test_lm_does_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_IDS", 2000)  # several blocks
    some = docs.limit(80).union(docs.limit(10))
    one, many = ({(r["doc_id"], r["n_tokens"]): r for r in lm.fit_and_score(some.repartition(n)).collect()} for n in (1, 9))
    assert one.keys() == many.keys()
    for key, r in one.items():
        assert abs(r["score"] - many[key]["score"]) < 1e-6 * r["n_tokens"] and abs(r["attention_score"] - many[key]["attention_score"]) < 1e-6 * r["n_tokens"]


def test_lm_counts_pairs_across_words(spark):
    """Every text alternates two words: what follows each is certain, though both are as frequent."""
    _, _, units = _learned(frame(spark, ["cat dog " * 50] * 4))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    (cat,), (dog,) = (lm.coder(path).encode_ordinary(w) for w in (" cat", " dog"))
    p = np.exp(units.bigram)
    assert p[units.enter[cat], units.of[dog]] > 0.9 and p[units.enter[cat], units.of[cat]] < 0.05


def test_lm_trains_on_every_window(spark, monkeypatch):
    """The rounds' parts are all texts, each in one, and all windows of each are trained on."""
    texts, _, units = _learned(frame(spark, [f"t{i} u{i} v{i} " * (i + 1) for i in range(40)]))
    sizes = np.array([len(r["data"]) // 2 for r in texts.collect()])
    seen = []
    real = lm.tree_sum
    monkeypatch.setattr(lm, "tree_sum", lambda rows, n: seen.append(real(rows, n)) or seen[-1])
    assert any(lm.train(texts, units).weights["head"].ravel())
    assert len(seen) == 2 and sum(x[0][0] for x in seen) == (-(-sizes // lm.STRIDE)).sum()


def test_tree_sum(spark):
    rng = np.random.default_rng(6)
    thin = np.zeros(70_000)
    thin[[3, 40_000, 69_999]] = [1, 2, 3]
    full = rng.integers(0, 9, 40_000).astype(np.float64)

    def give(frames):
        for _ in frames:
            pass
        yield from blocks(0, thin)
        yield from blocks(1, full)

    got = tree_sum(spark.range(0, 6, 1, 6).mapInPandas(give, BLOCKS), [70_000, 40_000], fan=2)
    assert (got[0] == 6 * thin).all() and (got[1] == 6 * full).all()
    none = tree_sum(spark.range(0).mapInPandas(lambda frames: iter(()), BLOCKS), [5])
    assert none[0].tolist() == [0] * 5


# samples, ids and names


def test_bounded_sample_has_rows_at_any_size():
    assert sample_bound(10**11, 20_000) / 2**63 == pytest.approx(2e-7) and sample_bound(10, 20) == 1 << 63
    assert sample_bound(5 * 10**13, 12_000) > 0


@pytest.mark.parametrize("kind", ["hash", "outlier", "string", "ends", "repeated"])
def test_next_rows_of_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 16)
    rng = random.Random(3)
    n = 600
    ids = {
        "hash": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)],
        "outlier": [*range(n - 2), 9 * 10**18, -9 * 10**18],
        "string": [f"doc-{rng.randrange(10**9)}" for _ in range(n)],
        "ends": [-(1 << 63), (1 << 63) - 1, 0, None, *range(5, 5 + n - 4)],
        "repeated": [7] * 300 + list(range(300)),
    }[kind]
    texts = [f"t{i} " * 9 for i in range(n)]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {'string' if kind == 'string' else 'long'}, text string")
    got = sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fingerprint.edited_fingerprints(rows).collect())
    hashes = [r[0] for r in rows.select(F.xxhash64("text")).collect()]
    order = sorted(range(n), key=lambda k: (ids[k] is not None, 0 if ids[k] is None else ids[k], hashes[k]) if kind != "string" else (ids[k], hashes[k]), reverse=True)
    want = []
    for k, j in zip(order, order[1:] + order[:1], strict=True):
        m = len(texts[k]) // 3
        want.append((str(ids[k]), hashlib.sha256((texts[k][: len(texts[k]) - m] + texts[j][:m]).encode()).hexdigest()))
    assert got == sorted(want)


def test_ranges_follow_counts(spark):
    keys = spark.range(50_000).select(F.struct(F.when(F.col("id") < 49_990, F.col("id")).otherwise(F.col("id") * 10**12).alias("id"), F.lit(1).cast("long").alias("tie")).alias("key"))
    bounds, fines = fingerprint._ranges(keys, 1000)
    sizes = [r["count"] for r in keys.withColumn("c", fingerprint._place(F.col("key"), fingerprint._listed(keys, bounds))).groupBy("c").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 50_000 / len(sizes) * 2.5
    assert all(r["fine"] for r in fines.collect())


def test_language_masks_of_many_words(spark):
    """150 languages: three mask words a slot."""
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(1500)]
    own = {f"l{k:03d}": letters[10 * k : 10 * k + 10] for k in range(150)}
    rows = [(i * 150 + k, " ".join("".join(rng.choice(own[lang]) for _ in range(4)) for _ in range(60)), lang) for i in range(2) for k, lang in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, min_count=1)
    assert model.slots.shape[0] == 3 and len(model.languages) == 150
    out = langid.predict(docs, model).join(docs, "doc_id")
    assert out.where("lang_pred = lang").count() >= 295


NAMES = ["__hash", "__id", "__text", "__gone", "__n", "__row", "__found", "__score", "__node", "hash", "features", "margin", "a.b", "TEXTS", "c0", "fp", "__arrival"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with extra columns of every name that an operator uses inside, one with a dot, and names in other case."""
    rows = frame(spark, ["one line of text\nshared line", "one line of text\nshared line", None, "", "alpha beta word", "an other text of five words and more"], ids=[1, 2, 3, 4, 5, None])
    return rows.select("doc_id", "text", "source", "n_chars", *[F.lit(f"v{i}").alias(n) for i, n in enumerate(NAMES)])


def test_extra_columns_of_any_name(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    model = toxicity.ToxicityModel({}, None, None, 0.1)
    rng = random.Random(1)
    texts = [f"good {'awful' if i % 3 == 0 else 'calm'} tree {rng.choice('abcdef')}" * 4 for i in range(200)]
    trained = toxicity.fit(frame(spark, texts), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int"), trees=2)
    outs = {
        "strip": linededup.strip(odd, n_chars_col="n_chars"),
        "keep": simhash.keep_first(odd, least=0.8),
        "reject": toxicity.reject(odd, model),
        "trained": toxicity.reject(odd, trained, threshold=1.1),
        "decontam": decontam.clean(odd, bench),
        "spans": decontam.clean(odd, bench, remove="spans", n_chars_col="n_chars"),
    }
    for name, out in outs.items():
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[4 + i] == f"v{i}" for r in rows for i in range(len(NAMES))), name
    new = linededup.clean(odd)
    assert new.columns == [c for c in odd.columns if c != "__text"] + ["__lines", "__removed", "__text"] and new.count() == 6
    scored = toxicity.score(odd.withColumn("score", F.lit("x")), trained)
    assert scored.columns == [*odd.columns, "score"] and dict(scored.dtypes)["score"] == "double"
    stored = sharding.arrivals_compacted(odd.drop("a.b"), arrivals=2).read()
    assert stored.columns == odd.drop("a.b").columns and {r["__arrival"] for r in stored.collect()} == {"v16"} and stored.count() == 6
    none = sharding.arrivals_compacted(odd.drop("a.b").limit(0)).read()
    assert none.count() == 0


def test_pipeline_stages_on_edge_rows(spark, sf_dir):
    """Null, empty and very long texts, ties, repeated rows, null ids, an extra column; and an empty table."""
    import corpus_pipeline

    kinds = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    text = "plain words of a text that goes on for a while and then ends here"
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate([*EDGE, text, text])] + [(None, text + " again and more", None, None, None), (3, "one", "en", "s0", 3), (3, "one", "en", "s0", 3)]
    docs = spark.createDataFrame(rows, kinds).withColumn("__text", F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES:
        now, none = stage(spark, docs, sf_dir), stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0
        if name != "best-fit packing":
            assert now.columns == docs.columns == none.columns
            assert {r["__text"] for r in now.collect()} == {"kept"}
        else:
            assert now.where("piece = 0").count() == len(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sum(r["text"] == text for r in kept) == 1 and sum(r["text"] == "one" for r in kept) == 1
    assert sum(not (r["text"] or "").strip() for r in kept) == 1


def test_lm_cutter_keeps_no_object_a_word():
    """A word that the cutter has met holds a few dozen bytes in all, in numpy and Arrow together."""
    cutter, n = lm.Cutter(public_tokenizers.path("byte_bpe_50k.tiktoken")), 60_000
    cutter.numbers([b"first", b"words"])
    gc.collect()
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        for k in range(0, n, 20_000):
            cutter.numbers([b"w%dx" % i for i in range(k, k + 20_000)])
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert cutter.numbers([b"w7x", b"first", b"w59999x", b"w7x"]).tolist() == [10, 1, n + 2, 10]
    assert held < 60 * n


def test_arrow_batches_cut_by_rows_and_size():
    """Every text is in one batch, in its place, with the words that it has alone."""
    texts = [*EDGE, "A b", None, "", "c  D " * 40, "x" * 300, "\u00c0B e"] * 3
    whole = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    for rows, size in ((1, 10**9), (4, 10**9), (1000, 50), (1000, 10**9)):
        parts = list(batches_in([whole.slice(0, 5), whole.slice(5), whole.slice(0, 0)], rows, size))
        assert [t for p in parts for t in p["text"].to_pylist()] == texts
        assert all(len(p) <= rows and (len(p) == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= size) for p in parts)
        for p in parts:
            at, words, n = lm.distinct_words(p["text"].fill_null("").cast(pa.large_string()))
            words = words.to_pylist()
            assert [words[i] for i in at] == [w for t in p["text"].to_pylist() for w in lm.words_of(t)]
            assert n.tolist() == [len(lm.words_of(t)) for t in p["text"].to_pylist()]


def test_blocks_come_some_at_a_time(monkeypatch):
    """A task lays out a few blocks of its share at once, not all of them."""
    monkeypatch.setattr(common, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    x = np.zeros(40 * common.BLOCK + 5)
    x[:: common.BLOCK] = np.arange(41)
    frames = list(blocks(0, x))
    assert max(map(len, frames)) <= common.BLOCKS_AT_ONCE
    rows = pd.concat(frames)
    assert rows["block"].tolist() == list(range(1, 41)) and [np.frombuffer(b)[0] for b in rows["x"]] == list(range(1, 41))
    assert not list(blocks(0, np.zeros(3 * common.BLOCK)))
