"""URL filter, source divergence and filter interactions against brute force and on edge rows."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import divergence, filteraudit, urlfilter
from gradeloom.llm.queries import QUERIES, URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, part string, mask int, key string, term string"


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", "y", 7, "z", "t") for r in rows], SCHEMA)


# URL filter

URLS = [
    None, "", "no scheme/at/all", "http://", "http://Host.Example.ORG", "http://example.org/", "https://a.b.Example.org/es/x", "http://example.org/en/1", "http://xexample.org/en/1",
    "http://example.org/en/17?q=1#f", "http://example.org/en/2", "ftp://x.com/fr/://y.org/", "http://x.com/de/?a=1&b=2&&c", "http://x.com/de", "http://com/de/1", "http://x.org?/", "http://x.org#/",
    "http://x.net/de/1", "a://b://c.org/", "http://u@Ä.org:80/É", "http://x.org/\nline", "http://" + "long." * 3000 + "com/fr/" + "p/" * 3000, "http://x.org/", "http://x.org/",
]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in URL_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_by_hand(spark):
    pages = spark.createDataFrame([(i, u, "rule?", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, rule string, Verdict double")
    out = urlfilter.judge(pages, URL_RULES).collect()
    assert len(out) == len(URLS) and out[0].__fields__ == ["page_id", "url", "Verdict", "host", "path", "rule", "score", "verdict"]
    for r in out:
        host, path, rule, verdict = by_hand(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r[7] == verdict or rule is None and r[7] in ("allow", "block")
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0


def test_url_query_keeps_rules(spark, sf_dir):
    out = QUERIES["op11_url_filter"](spark, sf_dir).toPandas()
    urls = dict(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect())
    assert len(out) == len(urls)
    for r in out.itertuples():
        host, path, rule, verdict = by_hand(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_lexical_features_by_hand(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, url string")
    for r in rows.select("i", *urlfilter.lexical(F.col("url"))).collect():
        url = URLS[r["i"]] or ""
        host, path, *_ = by_hand(url)
        bare = url.split("#", 1)[0]
        query = bare.split("?", 1)[1] if "?" in bare else ""
        n = Counter(url)
        numbers = re.findall(r"\d+", url)
        want = [
            len(url), len(host), len(path), len(query), sum(p != "" for p in path.split("/")), sum(p != "" for p in host.split(".")), sum(map(len, numbers)) / max(1, len(url)),
            max(map(len, numbers), default=0), url.count("-"), -sum(v / len(url) * math.log2(v / len(url)) for v in n.values()), sum(p != "" for p in query.split("&")), float("#" in url),
        ]
        assert [r[name] for name in urlfilter.LEXICAL] == pytest.approx(want, abs=1e-9), url[:50]


def test_url_model_learns_and_backs_off(spark):
    """Spammy hosts are longer, of more digits and parameters; unseen hosts are told by these, and hosts under a bad suffix by it."""
    rng = random.Random(3)
    good = [f"http://site{rng.randrange(200)}.example.org/{rng.choice(['a', 'news', 'text'])}/{rng.randrange(9)}" for _ in range(1500)]
    bad = [f"http://x{rng.randrange(10**9)}.deals-{rng.randrange(5)}.com/{rng.randrange(10**8)}/{rng.randrange(10**8)}?a={rng.randrange(99)}&b=2&c=3" for _ in range(1500)]
    odd = [f"http://n{k}.bad.net/a/{k % 9}" for k in range(300)]
    rows = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad + odd] + [(None, 1), ("http://unlabelled.org/", None), ("http://site.example.org/", 5)], "url string, label int")
    model = urlfilter.fit(rows, trees=8, depth=3)
    names = {r["suffix"]: r["odds"] for r in model.suffixes.collect()}
    assert names["bad.net"] > 0.3 and names["org"] < -2 and names["com"] > 0.3
    new = [f"http://other{k}.example.org/news/{k}" for k in range(9)] + [f"http://y{k}.deals-77.com/{k}7777777/12345678?a=1&b=2&c=3" for k in range(10, 19)] + [f"http://new{k}.bad.net/a/1" for k in range(9)]
    got = urlfilter.score(spark.createDataFrame([(u,) for u in new], "url string"), model).collect()
    assert [r["score"] >= 0.5 for r in got] == [False] * 9 + [True] * 18


def test_url_model_needs_two_classes(spark):
    rows = spark.createDataFrame([(f"http://x{k}.org/", 1) for k in range(20)], "url string, label int")
    for labelled, base in ((rows, 1.0), (rows.limit(0), 0.0)):
        model = urlfilter.fit(labelled)
        assert model.trees is None and {r["score"] for r in urlfilter.score(rows, model).collect()} == {base}


# source divergence


def words_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def audit_by_hand(rows, least, top):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        words = words_of(text)
        n[group].update(words)
        df[group[0]].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, v in df[lang].items() if v >= least]
        total = {g: sum(n[g][t] for t in kept) for g in groups if g[0] == lang}
        share = lambda count, all_of: 1 + 10**9 * (count + 5) // (all_of + 5 * len(kept))  # noqa: B023, E731
        p = {g: {t: share(n[g][t], total[g]) for t in kept} for g in total}
        pairs = sorted(((-sum(abs(p[lang, source][t] - p[g][t]) for t in kept), g[1].encode(), g[1]) for g in total if g[1] != source))
        out += [(lang, source, "pair", name, -v, k + 1) for k, (v, _, name) in enumerate(pairs)]
        q = {t: share(sum(n[g][t] for g in total), sum(total.values())) for t in kept}
        terms = sorted((q[t] - p[lang, source][t], t.encode(), t) for t in kept if n[lang, source][t] and p[lang, source][t] > q[t])[:top]
        out += [(lang, source, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms)]
    return sorted(out)


def some_documents(seed, n, sources=9):
    rng = random.Random(seed)
    vocabulary = ["a", "ab", "abc", "abcdefgh", "abcdefghi", "abcdefghij" * 3, "abcdefghij" * 3 + "x", "École", "école", "日本", "日本語の文章です", "Zz", "zz", "word", "worda"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary[: rng.randrange(2, len(vocabulary) + 1)]) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", ".", "1", "\x00", "@"]).join(words), rng.choice(["en", "en", "fr", None]), rng.choice([f"s{k}" for k in range(sources)] + [None])))
    return rows + [(n, None, "en", "s0"), (n + 1, "", "xx", "alone"), (n + 2, "1 2 3", "yy", "p"), (n + 3, "Ab" * 50_000 + " " + "word " * 100_000, "en", "s1"), (None, "word", "yy", "q"), (None, "word", "yy", "q")]


def test_divergence_by_hand(spark):
    rows = some_documents(1, 400)
    out = divergence.audit(frame(spark, rows).repartition(5), least_docs=10, top=4)
    assert sorted(tuple(r) for r in out.collect()) == audit_by_hand(rows, 10, 4)
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_divergence_in_cells_and_slices(spark, monkeypatch):
    """Small slices, blocks and tiles, and joins in place of broadcasts, give the same."""
    for name, value in {"SLICE_BYTES": 200, "CELL_WORDS": 3, "TILE": 4, "BROADCAST_ROWS": 0, "RUNS": 2}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = some_documents(2, 300, 13)
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows).repartition(3), least_docs=5, top=50).collect()) == audit_by_hand(rows, 5, 50)


def test_runs_are_words():
    """Of a sliced Arrow column: every distinct word of a group once, with its count and its texts; long common beginnings are told apart."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") * rng.randrange(1, 40) + rng.choice(["", "c", "é"]) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    langs = [rng.choice(["x", "y"]) for _ in texts]
    batch = pa.RecordBatch.from_pydict({"lang": langs, "source": ["s"] * len(texts), "text": texts}).slice(7)
    n, df = Counter(), Counter()
    for text, lang in list(zip(texts, langs, strict=True))[7:]:
        n.update((lang, w) for w in words_of(text))
        df.update({(lang, w) for w in words_of(text)})
    (out,) = divergence.term_runs(batch)
    rows = out.to_pylist()
    assert [(r["lang"], r["term"]) for r in rows] == sorted((r["lang"], r["term"]) for r in rows)
    assert {(r["lang"], r["term"]): r["n"] for r in rows} == n and {(r["lang"], r["term"]): r["docs"] for r in rows} == df


def test_shares_are_exact(spark):
    big = [(10**12 + 7, 3 * 10**13 + 11, 10**9), (0, 1, 1), (10**18, 10**18 + 5, 3), (5, 0, 0)]
    rows = spark.createDataFrame(big, "n long, total long, terms long")
    got = [r[0] for r in rows.select(divergence._share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + (10**9 * (n + 5)) // (t + 5 * v) if v else 0 for n, t, v in big]


# filter interactions


def fails_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        name
        for name, bad in (
            ("A", len(words) < 200),
            ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
            ("D", re.search(r"[#$%&*|]", text)),
        )
        if bad
    )


def audited_by_hand(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = defaultdict(list)
    for i, text, lang, _ in rows:
        parts[lang or ""].append((i, fails_by_hand(text) + ("E" if i is not None and i > first[text or ""] else "")))
    out = []
    for part, docs in parts.items():
        lines, shapley = [], Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [(i, bool(set(order[: step - 1]) & set(x))) for i, x in docs if f in x]
                here = [i for i, before in gone if not before]
                shapley[f] += len(here)
                lines.append((part, "".join(order), step, sum(not set(order[:step]) & set(x) for _, x in docs), len(here), len(gone) - len(here), sum(x == f for _, x in docs), sum(i in good for i in here), sum(i in toxic for i in here)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_filter_audit_by_hand(spark):
    rng = random.Random(9)
    texts = [None, "", "A", "a b " * 150, " ".join(map(str, range(200))), " ".join(map(str, range(199))), " ".join(f"w{k}|" for k in range(300)), "Ab " * 40 + " ".join(f"x{k}" for k in range(250)), "é\u3000ß " * 300, "x" * 3_000_000]
    texts += [" ".join(rng.choice(["a", "B", "c$", "dd", "e\x0be"]) + str(rng.randrange(rng.choice([5, 500]))) for _ in range(rng.randrange(150, 260))) for _ in range(40)]
    rows = [(i if i % 11 else None, rng.choice(texts), rng.choice(["en", "fr", None]), "s") for i in range(300)]
    rows += rows[:5] + [(1000 + i, "hot", "de", "s") for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, 2])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    marks = filteraudit.masks(frame(spark, rows).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["part", "filter_order", "step", *filteraudit.OUTCOMES, "shapley"]
    got = sorted(tuple(r[c] for c in names) for r in filteraudit.audit(marks).collect())
    assert got == audited_by_hand(rows, labels)
    assert filteraudit.audit(marks.limit(0)).count() == 0


def test_frequent_text_is_broadcast_like_the_rest(spark, monkeypatch):
    rows = [(i, "same" if i % 3 else f"t{i % 60}", "en", "s") for i in range(300)] + [(None, "same", "en", "s")]
    docs = frame(spark, rows)
    keyed = docs.select(F.col("doc_id").alias("id"), *filteraudit.text_key(F.col("text")))
    want = {i: text in [t for j, t, *_ in rows if j is not None and i is not None and j < i] for i, text, *_ in rows}
    for hot in (1, 1000):
        monkeypatch.setattr(filteraudit, "HOT", hot)
        assert {r["id"]: r["later"] for r in filteraudit.copies(keyed).collect()} == want


def test_packed_fields_do_not_run_over():
    f, big = 3, (1 << 63) - 1
    for mask in range(4 << f):
        counts = filteraudit.unpacked(big * filteraudit.packed(f)[mask], f)
        assert set(np.unique(counts)) <= {0, big}
        for k, order in enumerate(filteraudit.orders(f)):
            fails = [bool(mask >> int(x) & 1) for x in order]
            at = fails.index(True) if any(fails) else f
            assert [bool(x) for x in counts[filteraudit.OUTCOMES.index("removed"), k]] == [s == at for s in range(f)]
            assert [bool(x) for x in counts[filteraudit.OUTCOMES.index("kept"), k]] == [s < at for s in range(f)]


def test_general_filters_and_shapley_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["p", "q"]), rng.randrange(32)) for _ in range(2000)]
    out = filteraudit.audit(spark.createDataFrame(rows, "part string, mask int").repartition(7), "xyz").toPandas()
    assert len(out) == 2 * 6 * 3
    for part, lines in out.groupby("part"):
        shares = lines.assign(filter=[o[s - 1] for o, s in zip(lines["filter_order"], lines["step"], strict=True)]).groupby("filter")["shapley"].first()
        assert Fraction(int(shares.sum()), 6) == sum(p == part and m & 7 > 0 for p, m in rows)
