"""Every operator on small tables with nulls, blanks, repeats, ties and clashing names, against brute force."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("chronoweave.llm")
from chronoweave.llm import ann, chat, decontamination, line_dedup, minhash, pii, piece_codec, quality, token_files, warc  # noqa: E402
from chronoweave.llm._common import Workspace  # noqa: E402
from chronoweave.llm.queries import tokenizer_path  # noqa: E402

RND = random.Random(7)
WORDS = ["".join(RND.choice("abcdeé") for _ in range(RND.randrange(2, 7))) for _ in range(300)]
#: Columns that the operators use names like inside.
CLASH = "h long, label string, text_hash long, pos int, spans string, __n long"


def _text(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y", 4) for i, t in rows], f"doc_id long, text string, {CLASH}")


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_minhash_equals_brute_force(spark):
    base = _text(120).split()
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "one two"), (5, "ONE\ttwo"), (6, "one"), (None, "one two"), (4, "one two"), (70, _text(40))]
    for i in range(30):
        w = list(base)
        for _ in range(RND.randrange(0, 8)):
            w[RND.randrange(len(w))] = RND.choice(WORDS)
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, _text(RND.randrange(5, 60))) for i in range(20)] + [(300, " ".join(base)), (301, _text(30_000))]
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        sets[d, t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations([k for k in sets if k[0] is not None], 2):
        common = len(sets[a, s] & sets[b, t])
        if common and 100 * common >= 75 * (len(sets[a, s]) + len(sets[b, t]) - common) and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = minhash.near_duplicates(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (find(r.doc_id) if r.doc_id is not None else None) and r.kept == (r.component_id in (r.doc_id, None))
    assert {(r.doc_id, r.n_shingles) for r in got} == {(d, len(s)) for (d, _), s in sets.items()}
    assert minhash.near_duplicates(_docs(spark, rows).limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(_docs(spark, rows))
    assert kept.columns[:2] == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {d for d, _ in rows if d is None or find(d) == d}


def test_chat_round_trip(spark):
    parts = ["<|", "|>", "\\", "[INST]", "</s>", "a", "é", "\n", "<|end|>\n", "[[INST]", "$1", "😀"]
    rows = [(i // 3, i % 3, RND.choice(["user", "assistant", "<|>", None]), "".join(RND.choice(parts) for _ in range(RND.randrange(9)))) for i in range(90)]
    rows += [(None, None, None, None), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (500, 1, "assistant", "b"), (500, 1, "assistant", "a"), (500, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, seq long, piece int")
    got = {r.conv_id: r for r in chat.format_and_read(df).collect()}
    keyed = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, turns in itertools.groupby(keyed, key=lambda r: r[0]):
        turns = list(turns)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ws = Workspace(spark, "test")
    pieces, examples = chat.render(df, ws)
    # every example as read back is context and target as written out
    written = collections.defaultdict(list)
    for r in chat.expand(pieces, examples).collect():
        written[r.conv_id].append((r.example, hashlib.sha256(f"{r.context}\0{r.target}".encode()).hexdigest()))
    for conv, r in got.items():
        assert r.n_examples == len(written[conv]) and r.examples_sha256 == hashlib.sha256("".join(h for _, h in sorted(written[conv])).encode()).hexdigest()
    long = spark.createDataFrame([(1, 0, "user", "<|x " * 50_000), (1, 1, "assistant", "\\" * 100_000)], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_and_read(long).collect()
    assert (r.loss_chars, r.n_examples) == (100_000, 1)
    for r in chat.expand(pieces, examples).where("conv_id = 500").collect():
        assert r.target in ("a", "b") and r.context.count("<|end|>") == r.example - 1
    assert chat.format_and_read(df.limit(0)).count() == 0


def _runs(docs, least):
    """Brute force: maximal earlier repeats of at least so many words."""
    seqs = [(d, t, [] if t is None else t.split("\n")) for d, t in docs]
    count = lambda lines: sum(len(re.findall(r"[^ \t\r\f]+", x)) for x in lines)
    gone = collections.defaultdict(set)
    starts = [(k, i) for k, (_, _, x) in enumerate(seqs) for i in range(len(x))]
    for (a, i), (b, j) in itertools.product(starts, starts):
        if (a, i) < (b, j):
            x, y, n = seqs[a][2], seqs[b][2], 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            if n and count(y[j : j + n]) >= least:
                gone[b] |= set(range(j, j + n))
    return [(d, len(x), len(gone[k]), None if t is None else "\n".join(v for n, v in enumerate(x) if n not in gone[k])) for k, (d, t, x) in enumerate(seqs)]


def test_line_dedup_equals_brute_force(spark):
    pool = [_text(RND.randrange(0, 9)) for _ in range(12)]
    docs = [(i, "\n".join(RND.choice(pool) for _ in range(RND.randrange(1, 12)))) for i in range(25)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1]), (104, "x y z w v u\n" * 9), (105, "\n".join(pool * 3))]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.report(_docs(spark, docs), 10).collect())
    assert got == _runs(docs, 10)
    again = _docs(spark, [(None, "a b c d e f\n1"), (1, "a b c d e f\n2"), (1, "a b c d e f\n2")])
    assert sorted(r.text for r in line_dedup.report(again, 5).collect()) == ["2", "2", "a b c d e f\n1"]
    assert line_dedup.report(_docs(spark, docs).limit(0)).count() == 0
    left = line_dedup.remove_later_copies(_docs(spark, docs), 10)
    assert 103 not in {r.doc_id for r in left.collect()} and {100, 101} <= {r.doc_id for r in left.collect()} and left.columns == _docs(spark, docs).columns


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_path("piece_bpe_32k.model")
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.Model(path)
    texts = [None, "", " ", "a  b", "x\n\ny", "é😀中", "supercalifragilistic" * 40, "\x00", "the the.The,the", "thequick" * 4000]
    texts += ["".join(RND.choice(["a", "the", " ", "\n", "ß", "...", "ing", "12", "\t"]) for _ in range(60)) for _ in range(100)]
    texts += ["\n", "a ", " a", "\na", "a \n b", ("supercalifragilistic" * 3 + " x ") * 2000]
    got = {r.doc_id: r for r in piece_codec.encode_documents(_docs(spark, list(enumerate(texts))), path).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == lib.encode(t or "") and got[i].round_trip and got[i].n_tokens == len(got[i].ids)
    assert "".join(model.search("thequickbrownfox" * 50)) == "thequickbrownfox" * 50
    # the search is the only path: it commits while it goes, and its window stays a few pieces wide
    long = piece_codec.Model(path)
    ids, bounds = long.encode_column(pa.array(["thequick" * 4000, "a  b", None]))
    assert ids[bounds[0] : bounds[1]].tolist() == lib.encode("thequick" * 4000) and bounds[3] == bounds[2]
    assert long.commits > 500 and long.widest <= 6 * long.longest
    assert piece_codec.encode_documents(_docs(spark, []), path).count() == 0


def test_tied_priorities_merge_from_the_left():
    for _ in range(60):
        words = {"".join(RND.choice("ab") for _ in range(RND.randrange(1, 5))) for _ in range(9)} | {"a", "b"}
        model = piece_codec.Model(pieces=[("<unk>", 0.0, 2)] + [(w, float(-RND.randrange(3)), 1) for w in words], bpe=True, dummy_prefix=False)
        text = "".join(RND.choice("ab") for _ in range(60))
        assert list(model.search(text)) == model.merge(text)


def test_unigram_search_is_optimal():
    for _ in range(60):
        pieces = {"".join(RND.choice("abc") for _ in range(RND.randrange(1, 5))) for _ in range(8)}
        model = piece_codec.Model(pieces=[("<unk>", 0.0, 2)] + [(p, -RND.random() * 5, 1) for p in pieces], dummy_prefix=False)
        text = "".join(RND.choice("abc") for _ in range(80))
        best = [0.0] + [-math.inf] * len(text)
        for e in range(1, len(text) + 1):
            for k in range(1, min(model.longest, e) + 1):
                s = model.score.get(text[e - k : e], model.lowest if k == 1 else None)
                if s is not None:
                    best[e] = max(best[e], best[e - k] + s)
        got = list(model.search(text))
        assert "".join(got) == text and math.isclose(sum(model.score.get(p, model.lowest) for p in got), best[-1])


def test_decontamination_equals_brute_force(spark, monkeypatch):
    bench = [(1, _text(30)), (2, "Alpha beta"), (3, None), (4, "!!"), (None, _text(12)), (5, _text(10)), (10, "alpha"), (2, "Alpha beta")]
    piece = bench[0][1].split()
    docs = [(1, None), (2, ""), (3, _text(50) + ", " + " ".join(piece[3:20]) + " " + _text(9)), (4, "x alpha-BETA y"), (5, " ".join(piece[:9])), (6, bench[5][1] * 2), (6, bench[5][1] * 2), (None, bench[5][1]), (7, _text(20_000))]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                windows[tuple(w[k : k + 10])].add(i)
    expected = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    items |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        expected.append((d, len(w), len(hit), len(items), digest, bool(hit)))
    b = spark.createDataFrame([(*x, "z") for x in bench], "item_id long, text string, spans string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for limit in (decontamination.BLOCK_BYTES, 40):  # one block, and several
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", limit)
        got = [tuple(r)[:6] for r in decontamination.report(_docs(spark, docs), b).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)
        left = decontamination.remove_contaminated(_docs(spark, docs), b)
        assert sorted(r.doc_id for r in left.collect()) == sorted(e[0] for e in expected if not e[5])
    assert decontamination.report(_docs(spark, []), b).count() == 0
    assert not decontamination.report(_docs(spark, docs), b.limit(0)).where("contaminated").count()


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for words in ([1] * 50, rng.integers(0, 3, 200).tolist(), [], [0], rng.integers(0, 40, 300).tolist()):
        a = np.array(words, np.int32)
        until = lambda i: tuple(itertools.takewhile(bool, words[i:]))
        sa = decontamination.suffix_array(a).tolist()
        assert sorted(sa) == [i for i, w in enumerate(words) if w]
        assert all(until(x) <= until(y) for x, y in zip(sa, sa[1:], strict=False))


def test_forest_finds_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None]), (5400, [1.0]), (None, x[0].tolist()), (6000, x[5].tolist()), (6001, x[5].tolist())]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double")
    got = collections.defaultdict(list)
    for r in ann.search(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(3000), 6000, 6001])
    every = np.concatenate([x, x[[5, 5]]])
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((every - every[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        true = ids[np.lexsort((ids, d))[:10]].tolist()
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and all(math.isclose(d[ids == v][0], s) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(true))
    assert hits / (10 * len(got)) >= 0.9
    few = ann.search(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2] and ann.search(df.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return True


def test_pii_keeps_all_base_spans(spark):
    atoms = ["a.b@c.de", "x@y", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (800) 555-1234", "+12", " ", "é", "😀", "@", ".", "-", "12", "word", "\n", "007.1.2.03.4"]
    texts = [None, "", "1" * 400, "1 " * 3000, "a" * 50_000 + "@b.c"] + ["".join(RND.choice(atoms) for _ in range(RND.randrange(12))) for _ in range(300)]
    got = {r.doc_id: r for r in pii.report(_docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end(), n) for k, n in enumerate(BASE) for m in re.finditer(BASE[n], t or "") if _passes(n, m.group()))
        own = [f"{n}:{s}:{e}" for s, _, e, n in spans]
        assert got[i].base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest(), t
        assert [got[i][f"n_{n}"] for n in BASE] == [sum(x[3] == n for x in spans) for n in BASE] and set(own) <= set(got[i].spans.split(",")) | {""}
    shown = spark.createDataFrame([(1, "mail anna at mail dot com or a@b.co", 2, "t", "s", "m"), (2, None, 3, "t", "s", "m"), (2, None, 3, "t", "s", "m")], "doc_id long, text string, e int, __text string, __spans string, __more string")
    red = pii.redact(shown)
    assert red.columns == shown.columns and red.where("__text = 't' and __spans = 's' and __more = 'm'").count() == 3
    red = {r.doc_id: r.text for r in red.collect()}
    assert "a@b.co" not in red[1] and "[EMAIL]" in red[1] and red[2] is None
    assert pii.report(shown.limit(0)).count() == 0 and pii.report(shown).where("doc_id = 2").count() == 2


def test_pii_of_very_many_matches(spark):
    """Matches are added up in stretches; a text of many takes seconds, and its spans are all there."""
    text = " ".join(f"1.2.3.{i % 250} x{i}@y.de" for i in range(6000))
    (r,) = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_ip, r.n_email) == (6000, 6000) and len(r.spans.split(",")) >= 12_000
    spans = sorted((m.start(), k, m.end(), n) for k, n in enumerate(BASE) for m in re.finditer(BASE[n], text) if _passes(n, m.group()))
    assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in spans).encode()).hexdigest()


def test_pii_context_far_inside_a_text(spark):
    """What is found doesn't depend on how far inside a text it stands."""
    model, said = pii.grow(spark), "é mail me: anna [at] example.com today"
    pads = [0, 2, 4040, 4060, 4070, 4080, 4090, 4094, 4096, 4098, 8180, 8192]
    rows = [(n, "ü " * (n // 2) + said) for n in pads]
    got = {r.doc_id: [(x.s - r.doc_id, x.e - r.doc_id) for x in r["__spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[0] and all(got[n] == got[0] for n in pads)


def test_pii_gates_let_the_wide_pattern_through(spark):
    model = pii.grow(spark)
    texts = ["mail me: anna [at] example.com today", "mail me: anna (at) example.com today", "mail me: anna at example.com today", "ip ab:cd:ef:ab:cd:ef:ab:cd today"]
    shown = spark.createDataFrame([(i, t + end) for i, t in enumerate(texts) for end in ("", " 1 @ dot")], "doc_id long, text string")
    got = [[r.s for r in x["__spans"]] for x in pii.find(shown, model).orderBy("doc_id", "text").collect()]
    assert got[::2] == got[1::2] and got[0] and got[2] and got[4]


def test_pii_trees_separate_held_out(spark):
    score, limits = pii.grow(spark)
    rows = pii.labelled(spark, 3, 800).selectExpr("label", "named_struct('o', o, 'f', f) as c").selectExpr("c.o as o", "label", f"{score} as p").collect()
    good = [r.p > limits[r.o] for r in rows if r.label == 1]
    bad = [r.p > limits[r.o] for r in rows if r.label == 0]
    assert sum(good) / len(good) > 0.6 and sum(bad) / len(bad) < 0.03


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [None, "", "a", "  two  spaces", "tab\tand\r\nmore", "<|endoftext|>", "a <|endoftext|> b", "it's é中😀", "line\none. Two, three", "x" * 3000, " lead", "trail ", "\n", "a\x1cb\xa0c"] + [_text(RND.randrange(60)) for _ in range(60)]
    texts += ["".join(RND.choice(["a", "the", " ", " ", "\n", "ß", "...", "ing", "12", "\t", "<|endoftext|>", "中", "'s", ","]) for _ in range(RND.randrange(30))) for _ in range(300)]
    texts += [" ".join(_text(2000).split() * 20)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, "n"), (5, "same"), (5, "same")]
    got = sorted(token_files.round_trip(_docs(spark, rows), path).collect(), key=lambda r: r.start)
    expected = collections.Counter()
    for d, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert token_files.round_trip(_docs(spark, []), path).count() == 0


def test_huffman_is_optimal_within_its_limit():
    rng = np.random.default_rng(2)
    for n, limit in ((1, 16), (2, 16), (9, 4), (300, 12), (5000, 13)):
        counts = rng.zipf(1.2, n).clip(1, 10**6)
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1 + 1e-9
        code = token_files.Code(lengths)
        ids, sizes = rng.integers(0, n, 3000), np.array([0, 1, 256, 257, 2486])
        payload, bounds, bit = code.encode(ids, sizes)
        begins = np.cumsum(sizes) - sizes
        at = [bounds[d] * 8 + bit[b + k] for d, (b, m) in enumerate(zip(begins, sizes, strict=True)) for k in range(0, m, 256)]
        many = [min(256, m - k) for m in sizes for k in range(0, m, 256)]
        assert (code.decode(payload, np.array(at), np.array(many)) == ids).all()


def test_quality_keeps_clean_text(spark):
    order = collections.defaultdict(list)
    for w in WORDS:
        order[w[0]].append(w)

    def clean(n):
        return " ".join(RND.choice(order[RND.choice("abcd")]) for _ in range(n))

    good = [(i, clean(80)) for i in range(300)]
    junk = [(1000 + i, "".join(RND.choice("XYZ!#$% ") for _ in range(400))) for i in range(20)]
    rows = [(i, "en", t, 1.0) for i, t in good + junk] + [(2000, None, clean(50), 1.0), (2001, "en", None, 1.0), (2002, "xx", "", 1.0), (None, "en", clean(40), 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, p double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)] + [(260, 1, None), (260, 0, 0), (None, 1, 0), (1001, None, 0), (1002, 1, 1)], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.report(docs, labels).collect()}
    assert sum(keep[i] for i, _ in good) >= 0.99 * len(good) and not any(keep[i] for i, _ in junk)
    assert keep[2000] and keep[2001] and keep[2002] and keep[None]
    assert all(r.keep for r in quality.report(docs, labels.limit(0)).collect()) and quality.report(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_rejects_fluent_toxic_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.report(docs, labels).join(labels.where("quality = 1"), "doc_id").groupBy("toxic").agg({"*": "count", "keep": "count_if"}).collect()
    share = {r.toxic: r["count_if(keep)"] / r["count(1)"] for r in kept}
    assert share[1] <= 0.5 and share[0] >= 0.98


def test_kneser_ney_sums_to_one_and_shards_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(_text(60),) for _ in range(20)], "text string")
    model = quality.train(texts, Workspace(spark, "test"), 3)
    (whole,) = quality.shards(model, 3)
    scorer = quality.Scorer(*whole.value)
    for context in (b"ab", b" a", b"zz", b"\xc3\xa9"):
        head = int.from_bytes(context, "big") << 8
        assert math.isclose(np.exp(scorer.logs(np.arange(256) + head).astype(float)).sum(), 1, rel_tol=1e-3)
    monkeypatch.setattr(quality, "SHARD_ROWS", 300)
    parts = quality.shards(model, 3)
    assert len(parts) > 1
    one = [r["nll"] for r in quality.add_scores(texts, [whole], "nll", "size").orderBy("text").collect()]
    many = [r["nll"] for r in quality.add_scores(texts, parts, "nll", "size").orderBy("text").collect()]
    assert np.allclose(one, many, rtol=1e-4)


def test_warc_round_trip(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", "<p>é</p>"), (2, None, None), (3, "a\nb", ""), (4, "u", inner), (5, "u", f"x{inner}y{inner}"), (6, "u", "WARC/1.1\r\n" * 4), (7, "u", "<p>é</p>"), (None, "u", "q"), (8, "u", "é" * 30_000 + inner), (9, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (4, "u", inner)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, value string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = warc.round_trip(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    expected = collections.Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        again = p is not None and p > first[h or ""]
        expected[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert collections.Counter(tuple(r) for r in got) == expected
    assert warc.round_trip(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        docs = out.cache()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert ids.count() == docs.count() and not ids.where("not round_trip").count()


def test_pipeline_keeps_what_it_must(spark):
    """Nulls, blanks, repeats, copies, a benchmark passage and columns with names that operators use."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").first().text
    own = _text(200).split()
    near = [*own[:-1], "zz"]
    shared = "\n".join(_text(10) for _ in range(8))  # 80 words: the later copy goes
    rows = [(-1, None), (-2, ""), (None, _text(20)), (-90, " ".join(own)), (-80, " ".join(own)), (-70, " ".join(near)), (-60, f"{_text(30)} {passage} {_text(30)}"), (-50, f"{_text(40)}\n{shared}"), (-40, f"{_text(40)}\n{shared}\n{_text(12)}"), (-30, shared)]
    rows += [(-20, _text(60))] * 2
    docs = _docs(spark, rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs.withColumnsRenamed({}), sf) if "lang" in docs.columns else stage(spark, docs.selectExpr("*", "'en' as lang"), sf).select(columns)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns and stage(spark, before.selectExpr("*", "'en' as lang").limit(0), sf).count() == 0, name
    kept = sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d or 0))
    # -80 and -70 are copies of -90; -60 holds the passage; nothing is left of -30
    assert kept == [None, -90, -50, -40, -20, -20, -2, -1]
    assert len({r.doc_id: r.text for r in docs.collect()}[-40].split("\n")) == 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == len(kept) and not out.where("not round_trip").count()
