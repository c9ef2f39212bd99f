"""Divergence audit, periodic runs, substring dedup and perplexity against brute force; columns of any names."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

pytest.importorskip("chronoweave.llm")
from pyspark.sql import functions as F  # noqa: E402

from chronoweave.llm import _sketch, decontamination, divergence, line_dedup, minhash, periodic_runs, quality, substring_dedup  # noqa: E402

RND = random.Random(23)
VOCABULARY = ["".join(RND.choice("abcdeéß") for _ in range(RND.randrange(1, 6))) for _ in range(120)]
#: Names that operators use inside.
CLASH = {"id": 1, "text_hash": 2, "rest": "x", "row": 3, "k1": 4, "windows": "y", "first": 5, "gone": 6, "n_words": 7, "kept_sha256": "z", "cut": 8, "term": "t", "n": 9, "docs": 10, "__nll": 11, "__bytes": 12, "nll": 13, "keep": "k", "_keep": "l", "__d": 14, "__t": 15, "__lines": 16, "__kept": 17, "__gone": 18, "a.b": 19}


def _text(n, words=VOCABULARY):
    return " ".join(RND.choice(words) for _ in range(n))


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# ---------------------------------------------------------------- divergence


def _audit(rows, min_docs, top=50):
    of = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    df = collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        of[lang][source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, sources in of.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        p = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731,B023
        whole = p(sum(sources.values(), collections.Counter()))
        own = {s: p(c) for s, c in sources.items()}
        for s, c in sources.items():
            ranked = {"pair": [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s], "term": [(own[s][t] - whole[t], t) for t in kept if c[t] and own[s][t] > whole[t]]}
            for part, found in ranked.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top}
    return out


def test_divergence_equals_brute_force(spark):
    rows = []
    for i in range(160):
        lang, source = RND.choice(["en", "de", None]), RND.choice(["a", "b", "c", None])
        rows.append((lang, source, _text(RND.randrange(0, 60), VOCABULARY[: 40 + 20 * (i % 3)] + ["Upper", "UPPER", "x1y", "_z"])))
    rows += [("en", "quiet", None), ("en", "quiet", ""), ("xx", "lone", "one two"), ("yy", "p", None), ("yy", "q", ""), ("en", "long", _text(40_000))] + [("de", "same", "ab cd ab")] * 3
    docs = spark.createDataFrame([(*r, *CLASH.values()) for r in rows], ["lang", "source", "text", *CLASH]).repartition(5)
    for min_docs in (1, 5):
        got = [tuple(r) for r in divergence.audit(docs, min_docs=min_docs, top=7).collect()]
        assert len(got) == len(set(got)) and set(got) == _audit(rows, min_docs, 7)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    rng = range(3000)
    import numpy as np

    keys = np.array([hash(("k", i)) % (1 << 63) for i in rng], np.uint64)
    counts = {i: RND.randrange(1, 9) for i in rng}
    parts = spark.sparkContext.parallelize(range(4), 4)

    def run(batches):
        touched = _sketch.Touched(5)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = np.array([i for i in rng for _ in range(counts[i]) if i % 4 == k], np.int64)
                yield from touched.add(_sketch.cells_of(keys[own], 1 << 16))
        yield from touched.rest()

    touched = spark.createDataFrame(parts.map(lambda k: (k,)), "k long").mapInArrow(run, _sketch.TOUCHED)
    (bitmap,) = _sketch.merge(touched, 1 << 16, [5])
    hit = _sketch.found(bitmap, keys, 1 << 16)
    assert all(hit[i] for i in rng if counts[i] >= 5) and sum(hit[i] for i in rng if counts[i] < 5) < 30


# ---------------------------------------------------------------- runs


def _runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            end = i + q
            if i > start and end - start >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(start, end - p)) for p in range(1, q)):
                out.append((start, end - start, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _made_periodic(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def test_runs_equal_brute_force(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (5, "a a a a a"), (6, "a b a b a b a b a"), (None, "x y x y x y x y"), (6, "a b a b a b a b a"), (7, "no\x1crun\x00here")]
    for i in range(300):
        base = [RND.choice("abc") for _ in range(RND.randrange(1, 7))]
        w = [RND.choice("abcd") for _ in range(RND.randrange(0, 8))] + base * RND.randrange(1, 9) + base[: RND.randrange(0, 4)] + [RND.choice("ab") for _ in range(RND.randrange(0, 30))]
        rows.append((100 + i, "  ".join(w)))
    rows += [(1000 + i, _text(RND.randrange(1, 120))) for i in range(100)]
    docs = spark.createDataFrame([(*r, *CLASH.values()) for r in rows], ["doc_id", "text", *CLASH]).repartition(3)
    for periodic in (False, True):
        got = collections.Counter(tuple(r) for r in periodic_runs.report(docs, periodic).collect())
        want = collections.Counter()
        for doc_id, text in rows:
            w = _made_periodic(doc_id, _words(text)) if periodic else _words(text)
            found = _runs(w)
            dropped = {x for s, m, q in found for x in range(s + q, s + m)}
            best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
            want[doc_id, len(found), *((None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])), _sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), _sha(" ".join(x for i, x in enumerate(w) if i not in dropped))] += 1
        assert got == want
    assert periodic_runs.report(docs.limit(0)).count() == 0
    (r,) = periodic_runs.find(docs.where("doc_id = 4")).collect()
    assert ([tuple(x) for x in r.runs], r.n_words, r.collapsed) == ([(0, 6, 1)], 6, "a")


def test_runs_of_a_long_text(spark):
    base = [f"w{i}" for i in range(7000)]
    text = " ".join(base[:500] + base * 4 + ["end"] * 9)
    (r,) = periodic_runs.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(500, 28_000, 7000), (28_500, 9, 1)]


# ---------------------------------------------------------------- substrings


def _substrings(rows, window):
    first: dict = {}
    key = lambda d: -(1 << 63) if d is None else d
    split = [(d, _words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, key(d)), key(d))
    out = collections.Counter()
    for d, w in split:
        gone = {x for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < key(d) for x in range(i, i + window)}
        out[d, len(w), len(gone), _sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    return out


@pytest.mark.parametrize("window", [4, 7, 50])
def test_substrings_equal_brute_force(spark, window):
    passages = [_text(RND.randrange(window, 3 * window)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, _text(window - 1)), (None, passages[0]), (5, passages[0]), (5, passages[0]), (5, passages[1]), (6, passages[1] + "\n " + passages[1])]
    rows += [(10 + i, " ".join([_text(RND.randrange(0, 30)), RND.choice(passages), _text(RND.randrange(0, 30))])) for i in range(60)]
    rows += [(200 + i, passages[2]) for i in range(40)] + [(300, " ".join(passages[3].split())), (301, _text(20_000)), (302, passages[4].upper()), (303, _text(200, ["a", "b"])), (304, _text(200, ["a", "b"]))]
    docs = spark.createDataFrame([(*r, *CLASH.values()) for r in rows], ["doc_id", "text", *CLASH]).repartition(5)
    got = collections.Counter(tuple(r) for r in substring_dedup.report(docs, window).collect())
    assert got == _substrings(rows, window)
    assert substring_dedup.report(docs.limit(0), window).count() == 0
    kept = substring_dedup.remove_repeats(docs.withColumn("n_chars", F.length("text")), window)
    assert kept.columns == [*docs.columns, "n_chars"]
    for r in kept.collect():
        assert all(r[c] == v for c, v in CLASH.items()) and r.n_chars == (None if r.text is None else len(r.text))
    texts = collections.Counter((r.doc_id, _sha(" ".join(_words(r.text)))) for r in kept.collect())
    assert texts == collections.Counter((d, sha) for (d, _, _, sha), n in got.items() for _ in range(n))


def test_hot_passage(spark):
    passage = _text(60)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{passage} "), F.col("id").cast("string")).alias("text"))
    gone = {(r.n_removed, r.doc_id == 0) for r in substring_dedup.report(docs).collect()}
    assert gone == {(0, True), (60, False)}


# ---------------------------------------------------------------- columns of any names, perplexity


def test_columns_of_any_names_stay(spark):
    lines = "\n".join(_text(12) for _ in range(6))
    rows = [(i, t, "en", "s") for i, t in enumerate([lines, lines + "\nmore", None, "", "short"])]
    docs = spark.createDataFrame([(*r, *CLASH.values()) for r in rows], ["doc_id", "text", "lang", "source", *CLASH])
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string")
    for out in (line_dedup.remove_later_copies(docs), quality.keep_good(docs, labels), minhash.drop_near_duplicates(docs), decontamination.remove_contaminated(docs, items)):
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in out.collect():
            assert all(r[c] == v for c, v in CLASH.items())
    kept = {r.doc_id: r.text for r in line_dedup.remove_later_copies(docs).collect()}
    assert kept == {0: lines, 1: "more", 2: None, 3: "", 4: "short"}


def _log_probability(counts, order, at):
    """Interpolated modified Kneser-Ney from its definition."""
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])

    def discounts(table):
        n1, n2, n3, n4 = (sum(c == i for c in table.values()) for i in (1, 2, 3, 4))
        many = sum(c >= 4 for c in table.values())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        return [max(0.1, i - (i + 1) * y * b / a) if a and b else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, many))] if (n4 or True) else None

    def p(g, n):
        if n == 0:
            return 1 / 256
        table = tables[n]
        own = {x: c for x, c in table.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:], n - 1)
        d = discounts(table)
        cut = {x: d[min(c, 3) - 1] for x, c in own.items()}
        total = sum(own.values())
        return (own.get(g, 0) - cut.get(g, 0)) / total + sum(cut.values()) / total * p(g[1:], n - 1)

    return math.log(p(at, order))


def test_perplexity_equals_its_definition(spark):
    order = 3
    texts = [_text(25, ["abba", "baab", "é"]) for _ in range(6)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(90, "abba zz baab", "en"), (91, texts[0], "en"), (92, None, "en"), (93, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    counts = collections.Counter()
    grams = lambda t: [bytes(order - 1 - k) + b for k, b in ((min(i, order - 1), t[max(0, i - order + 1) : i + 1]) for i in range(len(t)))]
    for t in texts:
        counts.update(grams(t.encode()))
    names = quality.judged(docs)
    got = {r.doc_id: r for r in quality.judge(docs, labels, order).collect()}
    for doc_id, t, _ in rows:
        r = got[doc_id]
        if not t:
            assert r[names[0]] is None and r[names[3]]
            continue
        logs = [_log_probability(counts, order, g) for g in grams(t.encode())]
        assert r[names[1]] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
        assert r[names[3]] == (r[names[0]] <= r[names[2]] * (1 + 1e-12))
    assert got[0][names[1]] == got[91][names[1]]
