"""Personal data by candidate generators and boosted trees; column expressions only on the main path.

Four base kinds are exact patterns with a check; they always stay. Wider generators propose further spans
of the same kinds (obfuscated e-mail, numbers without a plus, IPv6), which overlap freely. Each candidate
gets format and context features, boosted regression trees score it, and a threshold for its kind, set on
held-out candidates, decides. The trees are grown by Spark ML on a bounded, generated set of labelled
candidates and then run as one SQL expression over arrays in the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Labelled candidates that are generated for training, and as many again for thresholds.
LABELLED = 4000
#: Share of held-out negatives of a kind that must score below its threshold.
BELOW = 0.995

# The base patterns, written without backtracking. A match may begin at the end of the one
# before it (\G) or where no longer match could have begun.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_LONG = {"email": "true", "ip": r"{t} rlike r'[0-9]\.[0-9]'", "card": r"{t} rlike r'[0-9](?:[ -]?[0-9]){{6}}'", "phone": r"{t} rlike r'\+[0-9]'"}

WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?:@| ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9.])[(0-9][0-9 ().-]{6,20}[0-9](?![0-9])",
}
_WIDE_LONG = {
    "email": r"{t} rlike r'@|[\[(]at[\])]| at '",
    "ip": r"({t} rlike r'[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}:' or {t} rlike r'[0-9]\.[0-9]+\.[0-9]')",
    "card": r"{t} rlike r'[0-9]{{4}}[ .-]?[0-9]{{4}}'",
    "phone": r"{t} rlike r'[0-9][ ().-]*[0-9][ ().-]*[0-9][ ().-]*[0-9][ ().-]*[0-9][ ().-]*[0-9]'",
}

_SPANS = "array<struct<s:int,e:int,v:string>>"


#: Matches that are added up at a time: sums run inside such stretches, and stretches are added up, so that no
#: array is copied once for each of its elements.
STRETCH = 128


def _find(text: str, pattern: str, gate: str) -> str:
    """SQL for all matches with code-point offsets: gaps between matches and matches, added up."""
    none = f"cast(array() as {_SPANS})"
    pairs = f"filter(zip_with(regexp_extract_all({text}, r'{pattern}', 0), split({text}, r'{pattern}', -1), (m, g) -> named_struct('m', m, 'g', length(g))), x -> x.m is not null)"
    step = "(a, x) -> named_struct('at', a.at + x.g + length(x.m), 'out', concat(a.out, array(named_struct('s', a.at + x.g, 'e', a.at + x.g + length(x.m), 'v', x.m))))"
    inner = f"aggregate(stretch, named_struct('at', b.at, 'out', {none}), {step})"
    outer = f"(b, stretch) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(b.out, array(r.out))))[0]"
    cut = f"transform(sequence(0, greatest(size(p) - 1, 0) div {STRETCH}), i -> slice(p, int(i) * {STRETCH} + 1, {STRETCH}))"
    # array(...) and [0] give a value a name, so that it is made once
    whole = f"transform(array({pairs}), p -> aggregate({cut}, named_struct('at', 0, 'out', cast(array() as array<{_SPANS}>)), {outer}, b -> flatten(b.out)))[0]"
    return f"if({gate.format(t=text)}, {whole}, {none})"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, r'[^0-9]', '')"


def _luhn(v: str) -> str:
    """Every second digit from the right doubled, nine taken off what exceeds nine, sum divisible by ten."""
    d = f"int(substr({_digits(v)}, -i, 1))"
    worth = f"if(i % 2 = 1, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))"
    return f"aggregate(transform(sequence(1, length({_digits(v)})), i -> {worth}), 0, (a, y) -> a + y) % 10 = 0"


_OCTETS = r"forall(split({v}, r'\.'), p -> p rlike r'^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')"
CHECK = {
    "email": "true",
    "ip": _OCTETS.format(v="x.v"),
    "card": f"length(x.v) <= 37 and length({_digits('x.v')}) between 14 and 19 and {_luhn('x.v')}",
    "phone": f"length({_digits('x.v')}) between 10 and 15",
}


def _base(text: str) -> str:
    parts = []
    for i, kind in enumerate(KINDS):
        parts.append(f"transform(filter({_find(text, BASE[kind], _LONG[kind])}, x -> {CHECK[kind]}), x -> named_struct('s', x.s, 'o', {i}, 'e', x.e))")
    return f"array_sort(concat({', '.join(parts)}))"


# ---------------------------------------------------------------- candidates and features

# Words that speak for a kind when they stand shortly before a candidate, or against all.
CONTEXT = {
    "email": "mail|e-mail|contact|write|reach|address|inbox",
    "ip": "ip|host|server|addr|address|login|from|client|ping",
    "card": "card|visa|master|amex|credit|debit|payment|pan",
    "phone": "phone|tel|call|mobile|cell|fax|dial|whatsapp|sms|contact",
}
AGAINST = "order|invoice|version|isbn|issn|serial|ref|id|no|section|page|part|build|model|doi|date|figure|table|year"

FEATURES = [
    "double(length(c.v))",
    f"double(length({_digits('c.v')}))",
    "double(length(regexp_replace(c.v, r'[0-9A-Za-z]', '')))",
    "double(length(regexp_replace(c.v, r'[^A-Za-z]', '')))",
    "double(size(split(c.v, r'[ .()-]+', -1)))",
    "double(c.v like '%@%')",
    "double(c.v rlike r'(?i)[\\[(](?:at|dot)[\\])]| at | dot ')",
    "double(c.v like '%(%')",
    "double(c.v rlike r'(?i)[^a-z](?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu)$')",
    "double(c.v rlike r'^(?:[0-9]{1,2} ){4}')",
    f"double({_OCTETS.format(v='c.v')} and size(split(c.v, r'[.]')) = 4)",
    f"double(if(length({_digits('c.v')}) between 12 and 19, {_luhn('c.v')}, false))",
    "double(c.v rlike r'^[0-9]{3}[ .-][0-9]{3,4}[ .-][0-9]{4}$|^[(][0-9]{3}[)] ?[0-9]{3}[ .-]?[0-9]{4}$')",
    "double(c.v rlike r'^(?:19|20)[0-9]{2}[-. ]')",
    "double(c.before rlike r'[A-Za-z0-9_/=#$-]$')",
    "double(c.after rlike r'^[A-Za-z0-9_/%=-]')",
    *(f"double(c.before rlike r'(?i)(?:^|[^a-z])(?:{words})[^a-z]*(?:is|at|me|us|number|no)?[^a-z]*$')" for words in CONTEXT.values()),
    f"double(c.before rlike r'(?i)(?:^|[^a-z])(?:{AGAINST})[^a-z]*$')",
    *(f"double(c.o = {i})" for i in range(len(KINDS))),
]


#: Characters in a piece of text: context is taken from a piece and the next, as a place far inside a long text
#: is only found by counting characters from its beginning.
PIECE = 4096


def _with_context(found: str, order: int) -> str:
    """Spans with the 24 characters before and the one after, from pieces q of the text."""
    k, j = f"(greatest(x.s - 24, 0) div {PIECE})", f"(x.e div {PIECE})"
    before = f"substring(concat(get(q, int({k})), coalesce(get(q, int({k} + 1)), '')), int(greatest(x.s - {k} * {PIECE} - 23, 1)), least(24, x.s))"
    after = f"substring(coalesce(get(q, int({j})), ''), int(x.e - {j} * {PIECE} + 1), 1)"
    return f"transform({found}, x -> named_struct('s', x.s, 'o', {order}, 'e', x.e, 'v', x.v, 'before', {before}, 'after', {after}))"


def _candidates(text: str) -> str:
    pieces = f"transform(sequence(0, greatest(length({text}) - 1, 0) div {PIECE}), i -> substring({text}, int(i) * {PIECE} + 1, {PIECE}))"
    every = ", ".join(_with_context(_find(text, WIDE[k], _WIDE_LONG[k]), i) for i, k in enumerate(KINDS))
    return f"transform(array({pieces}), q -> concat({every}))[0]"


def _features(candidates: str) -> str:
    return f"transform({candidates}, c -> named_struct('s', c.s, 'o', c.o, 'e', c.e, 'f', array({', '.join(FEATURES)})))"


# ---------------------------------------------------------------- training


def labelled(spark: SparkSession, seed: int, rows: int = LABELLED) -> DataFrame:
    """(o, f, label): candidates in generated sentences. Half hold a datum of a kind in an unusual form,
    half something that only looks like one."""
    n = lambda k, digits: f"lpad(string(pmod(xxhash64(id, {seed}, {k}), {10**digits})), {digits}, '0')"
    pick = lambda k, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), int(pmod(xxhash64(id, {seed}, {k}), {len(xs)}) + 1))"
    name = f"concat({pick(1, 'anna', 'm.lee', 'jo', 'kim', 'info', 'p.ortiz', 'sam')}, {pick(2, '', '.w', '7', '_x')})"
    host = f"concat({pick(3, 'mail', 'example', 'post', 'corp')}, {pick(4, '', '1', '-x')})"
    at, dot = pick(5, " at ", "[at]", " (at) ", "@"), pick(6, " dot ", "[dot]", " (dot) ")
    email = f"concat({name}, {at}, {host}, {dot}, {pick(7, 'com', 'org', 'net')})"
    phone = f"concat({pick(8, '(', '')}, '', {n(9, 3)}, {pick(8, ') ', '-')}, {n(10, 3)}, {pick(11, '-', '.', ' ')}, {n(12, 4)})"
    ip = f"concat_ws(':', hex(1 + {n(13, 3)}), hex(1 + {n(14, 4)}), hex({n(15, 4)}), hex({n(16, 3)}), hex({n(17, 4)}), hex({n(18, 4)}), hex({n(19, 2)}), hex({n(20, 4)}))"
    quad = f"concat_ws('.', 1 + {n(21, 2)}, {n(22, 1)}, 1 + {n(23, 2)}, {n(24, 1)})"
    stem = f"concat({pick(25, '4', '51', '37')}, {n(26, 14)})"
    head = f"substr({stem}, 1, 15)"
    sep = pick(27, " ", "-", "")
    # the check digit that makes sixteen digits pass, from the sum of the first fifteen
    odd = f"aggregate(transform(sequence(1, 15), i -> if(i % 2 = 1, if(int(substr({head}, i, 1)) > 4, 2 * int(substr({head}, i, 1)) - 9, 2 * int(substr({head}, i, 1))), int(substr({head}, i, 1)))), 0, (a, y) -> a + y)"
    sixteen = f"concat({head}, string(pmod(10 - {odd} % 10, 10)))"
    card = f"concat_ws({sep}, substr({sixteen}, 1, 4), substr({sixteen}, 5, 4), substr({sixteen}, 9, 4), substr({sixteen}, 13, 4))"
    good = f"element_at(array({email}, {ip}, {card}, {phone}), int(kind + 1))"
    bad_email = f"concat({pick(28, 'look', 'meet', 'arrive', 'stay')}, ' at ', {pick(29, 'home', 'dawn', 'noon')}, {pick(30, ' dot ', '.')}, {pick(31, 'the', 'and', 'then')})"
    bad_ip = f"element_at(array(concat_ws('.', {n(32, 1)}, {n(33, 1)}, {n(34, 3)}, 300 + {n(35, 2)}), concat_ws(':', {n(36, 2)}, {n(37, 2)}, {n(38, 2)}, {n(39, 2)})), int(pmod(id div 8, 2) + 1))"
    bad_card = f"concat_ws({sep}, {n(40, 4)}, {n(41, 4)}, {n(42, 4)}, {n(43, 4)})"
    bad_phone = f"element_at(array(concat('20', {n(44, 2)}, '-', {n(45, 2)}, '-', {n(46, 2)}), concat({n(47, 8)}), concat({n(48, 4)}, ' ', {n(49, 5)}), concat('978-', {n(50, 1)}, '-', {n(51, 4)}, '-', {n(52, 4)}, '-', {n(53, 1)}), {n(62, 14)}, concat({n(63, 8)}, {n(64, 8)}), concat_ws(' ', {n(65, 1)}, {n(66, 1)}, {n(67, 1)}, {n(68, 2)}, {n(69, 1)}, {n(70, 1)}, {n(71, 1)}), concat_ws('.', {n(72, 2)}, {n(73, 3)}, {n(74, 3)}, {n(75, 2)})), int(pmod(id div 8, 8) + 1))"
    bad = f"element_at(array({bad_email}, {bad_ip}, {bad_card}, {bad_phone}), int(kind + 1))"
    cue = f"element_at(array({pick(54, 'mail me: ', 'contact ', 'write to ')}, {pick(55, 'from host ', 'ip ', 'server ')}, {pick(56, 'visa ', 'credit card ', 'card no. ')}, {pick(57, 'call ', 'tel. ', 'phone: ')}), int(kind + 1))"
    none = pick(58, "order ", "ref ", "the ", "and ", "version ", "see ", "invoice no ", "of ")
    pre = f"if(label = 1, if(pmod(xxhash64(id, {seed}, 59), 10) < 7, {cue}, {none}), if(pmod(xxhash64(id, {seed}, 60), 10) < 8, {none}, {cue}))"
    frame = spark.range(0, rows, 1, 2).selectExpr("id", "pmod(id, 4) as kind", "pmod(id div 4, 2) as label")
    frame = frame.selectExpr("kind", "label", f"concat('It was so that ', {pre}, if(label = 1, {good}, {bad}), {pick(61, ' today', ', then', '. And')}) as text")
    found = frame.selectExpr("kind", "label", f"explode({_features(_candidates('text'))}) as c")
    return found.where("c.o = kind").selectExpr("c.o as o", "c.f as f", "double(label) as label")


def grow(spark: SparkSession, iterations: int = 20, depth: int = 3) -> tuple[str, dict[int, float]]:
    """The boosted trees as SQL over an array c.f, and the threshold of each kind."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    data = labelled(spark, 1).select(array_to_vector("f").alias("features"), "label").coalesce(2).cache()
    model = GBTClassifier(maxIter=iterations, maxDepth=depth, seed=1).fit(data)
    data.unpersist()

    def node(n) -> str:
        if n.getClass().getSimpleName() == "LeafNode":
            return repr(float(n.prediction()))
        split = n.split()
        return f"if(c.f[{split.featureIndex()}] <= {float(split.threshold())!r}, {node(n.leftChild())}, {node(n.rightChild())})"

    margin = " + ".join(f"{float(w)!r} * {node(t._call_java('rootNode'))}" for t, w in zip(model.trees, model.treeWeights, strict=True))
    score = f"1 / (1 + exp(-2 * ({margin})))"
    held = labelled(spark, 2).selectExpr("label", "named_struct('o', o, 'f', f) as c").selectExpr("c.o as o", "label", f"{score} as p")
    limits = held.where("label = 0").groupBy("o").agg(F.percentile("p", BELOW).alias("q")).collect()  # a row per kind
    return score, {r.o: max(0.5, r.q) for r in limits}


# ---------------------------------------------------------------- the operator


def _near(spans: str) -> str:
    """SQL for spans in order of their starts, in stretches with the bounds that each stretch covers."""
    cut = f"transform(sequence(0, greatest(size(p) - 1, 0) div {STRETCH}), i -> slice(p, int(i) * {STRETCH} + 1, {STRETCH}))"
    bounds = "x -> named_struct('lo', array_min(transform(x, y -> y.s)), 'hi', array_max(transform(x, y -> y.e)), 'x', x)"
    return f"transform(array(array_sort({spans})), p -> transform({cut}, {bounds}))[0]"


def _meets(near: str, test: str = "true") -> str:
    """SQL for whether any span d of such stretches shares a character with c and passes a test."""
    return f"exists({near}, t -> t.lo < c.e and c.s < t.hi and exists(t.x, d -> d.s < c.e and c.s < d.e and ({test})))"


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has."""
    out = []
    for name in names:
        while name.lower() in (c.lower() for c in docs.columns):
            name += "_"
        out.append(name)
    return out


def find(docs: DataFrame, model: tuple[str, dict[int, float]] | None = None, base: str = "__base", spans: str = "__spans") -> DataFrame:
    """docs with two more columns of arrays of (s, o, e), start, kind's number and end, in that order: the base
    spans, and all spans. Columns of docs that have one of these two names are replaced."""
    score, limits = model or grow(docs.sparkSession)
    text, scored, more, near = _fresh(docs, "__text", "__scored", "__more", "__near")
    out = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn(base, F.expr(_base(text)))
    candidates = f"transform({_features(_candidates(text))}, c -> named_struct('s', c.s, 'o', c.o, 'e', c.e, 'p', {score}))"
    out = out.withColumn(scored, F.expr(f"if({text} rlike r'[0-9@]|[\\[(]at[\\])]| at |[A-Fa-f]:[A-Fa-f]{{1,4}}:', {candidates}, cast(array() as array<struct<s:int,o:int,e:int,p:double>>))"))
    enough = " or ".join(f"(c.o = {o} and c.p > {q!r})" for o, q in sorted(limits.items())) or "false"
    out = out.withColumn(near, F.expr(_near(base)))
    out = out.withColumn(more, F.expr(f"filter({scored}, c -> ({enough}) and not {_meets(near)})"))
    # of candidates that overlap, the surest stays; then the earliest, then the longest
    out = out.withColumn(near, F.expr(_near(more)))
    beaten = _meets(near, "d.p > c.p or (d.p = c.p and (d.s < c.s or (d.s = c.s and (d.e > c.e or (d.e = c.e and d.o < c.o)))))")
    added = f"transform(filter({more}, c -> not {beaten}), c -> named_struct('s', c.s, 'o', c.o, 'e', c.e))"
    return out.withColumn(spans, F.expr(f"array_sort(concat({base}, {added}))")).drop(text, scored, more, near)


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(repr(k) for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.o], string(x.s), string(x.e))), ',')"


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text counts as empty; doc_id may be null or repeat, rows stay apart. Whole texts are searched.
    Other columns are not read.
    """
    found = find(docs.select("doc_id", "text"))
    counts = [F.expr(f"bigint(size(filter(__base, x -> x.o = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(_listed("__base")), 256).alias("base_sha256"), F.expr(_listed("__spans")).alias("spans"))


def redact(docs: DataFrame, model: tuple[str, dict[int, float]] | None = None) -> DataFrame:
    """docs with each found span in text replaced by its kind in brackets; overlapping spans are one. Null texts
    stay null; columns of any names stay as they are."""
    base, spans = _fresh(docs, "__base", "__spans")
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    step = f"(a, x) -> if(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out), named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), {names}[x.o])))"
    whole = f"aggregate({spans}, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring(text, a.at + 1)))"
    return find(docs, model, base, spans).withColumn("text", F.when(F.col("text").isNotNull(), F.expr(whole))).select(docs.columns)
