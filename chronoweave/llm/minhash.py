"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

One permutation (sigma) scatters a shingle over a ring of 2^32 places, a second one (pi) is shifted
around that ring by one place for each signature coordinate: coordinate k of a set is
min(pi(sigma(x) + k)). Two permutations thus make all coordinates. Bands of the signature propose
pairs; a pair is a link only if 100 * |A & B| >= 75 * |A | B| on the full sets.

With 32 bands of 4 rows a pair at the threshold itself is missed with probability
(1 - 0.75^4)^32 = 5e-6, one at 0.8 with 5e-8.

Copies with equal sets form one class beforehand, so only distinct sets are banded. In a bucket,
all members are compared with pivots; whoever ends up in one component needs no more comparisons,
and buckets that still hold several components go on with more pivots until every pair of members
was compared or is connected. No bucket is capped and none is expanded into all its pairs at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import NOT_SPACE, Workspace, broadcast_if_small, components, hash_words, mix64, release, scan_words, text_buffer

SHINGLE, BANDS, ROWS = 5, 32, 4
_SALT = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_LENGTH = np.uint64(0x9FB21C651E98DF25)


def _times(k: int) -> np.uint64:
    return np.uint64(int(_LENGTH) * k % (1 << 64))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after another, and the size of each row's set."""
    starts, ends, rows = scan_words(data, bounds, NOT_SPACE)
    words = hash_words(data, starts, ends)
    m = len(words)
    full = np.zeros(max(m - k + 1, 0), np.uint64)
    for t in range(k):
        full += words[t : t + len(full)] * _SALT[t]
    full = mix64(full + _times(k))
    sets, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            s = s[fresh]
        elif b > a:
            s = mix64((words[a:b] * _SALT[: b - a]).sum(dtype=np.uint64, keepdims=True) + _times(b - a))
        else:
            continue
        sizes[i] = len(s)
        sets.append(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def _sigma(x: np.ndarray) -> np.ndarray:
    return (mix64(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _pi(x: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=scratch)
        np.bitwise_xor(x, scratch, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=scratch)
    return np.bitwise_xor(x, scratch, out=x)


def signatures(sets: np.ndarray, sizes: np.ndarray, coordinates: int = BANDS * ROWS, chunk: int = 1 << 15) -> np.ndarray:
    """Circulant MinHash of non-empty sets that stand one after another."""
    out = np.full((len(sizes), coordinates), 0xFFFFFFFF, np.uint32)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + chunk, "right")))
        place = _sigma(sets[begins[i] : ends[j - 1]])
        cut = begins[i:j] - begins[i]
        x, scratch = np.empty_like(place), np.empty_like(place)
        for k in range(coordinates):
            np.add(place, np.uint32(k), out=x)
            out[i:j, k] = np.minimum.reduceat(_pi(x, scratch), cut)
        i = j
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    grouped = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        key = mix64(key + grouped[:, :, r] + _times(r + 1))
    return mix64(key + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("spread", T.ArrayType(T.IntegerType()))])
#: Cells over which a set's shingles are counted; the smaller counts of two sets add up to no less than what they share.
CELLS = 256


def _identity(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over a set's hashes; equal sets have equal sums, and with the size they name the set."""
    n = len(sizes)
    k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        begins = (np.cumsum(sizes) - sizes)[some]
        k1[some] = np.add.reduceat(sets * np.uint64(0x9E3779B97F4A7C15), begins)
        k2[some] = np.add.reduceat(mix64(sets), begins)
    return k1.view(np.int64), k2.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _pieces(batches, most: int = 4 << 20):
    """Rows of a few MB of text at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        done = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_string())), 0)).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def _sign(batches):
    import pyarrow as pa

    release()
    for batch in _pieces(batches):
        sets, sizes = shingle_sets(*text_buffer(batch.column("text")))
        k1, k2 = _identity(sets, sizes)
        some = np.flatnonzero(sizes)
        keys = band_keys(signatures(sets, sizes[some])).reshape(-1)
        width = np.where(sizes > 0, BANDS, 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(k1), pa.array(k2), _lists(keys, width)], names=_SIGNED.names)


def _spell(batches):
    import pyarrow as pa

    release()
    for batch in _pieces(batches):
        sets, sizes = shingle_sets(*text_buffer(batch.column("text")))
        k1, _ = _identity(sets, sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(row * CELLS + (sets % np.uint64(CELLS)).astype(np.int64), minlength=len(sizes) * CELLS)
        spread = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, CELLS).astype(np.int32)), pa.array(counts.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1), _lists(sets, sizes), spread], names=_SETS.names)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null or blank text: an empty set, linked with nothing. Rows that share an id are one node, whose
    links are those of all its texts; repeated rows return as often as they came. A null id is never
    linked: component_id is null and kept is true. An empty table gives an empty result. Other columns
    of docs, whatever their names, are not read.
    """
    return _near_duplicates(docs, Workspace(docs.sparkSession, "minhash"), id_col, text_col)


def _near_duplicates(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = ws.stage(own.mapInArrow(_sign, _SIGNED), "signed")
    ids = signed.where("doc_id is not null and n_shingles > 0")
    classes = ws.stage(ids.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "classes")

    rows = classes.select(F.explode("bands").alias("h"), F.col("rep"), F.col("n_shingles").alias("n"))
    shared = ws.stage(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead")).where("c > 1").select("h", "lead"), "shared")
    active = ws.stage(rows.join(shared.select("h"), "h").select("h", "rep", "n").distinct(), "buckets")

    # ids with several texts join the classes of these texts
    split = ids.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("doc_id")
    edges = ws.stage(ids.join(split, "doc_id").join(classes.select("n_shingles", "k1", "k2", "rep"), ["n_shingles", "k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "same-id")
    edge_tables = [edges]

    members = ws.stage(active.select("rep").distinct(), "members")
    known = broadcast_if_small(members)
    wanted = classes.join(known, "rep", "left_semi").select(F.col("rep").alias("doc_id"), "k1").distinct()
    text_of = own.join(broadcast_if_small(members).withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    spelled = ws.stage(text_of.mapInArrow(_spell, _SETS).join(wanted, ["doc_id", "k1"], "left_semi").select(F.col("doc_id").alias("node"), "shingles", "spread").distinct(), "spelled")
    sets = spelled.select("node", "shingles")

    labels, pivots = None, 1
    while True:
        if labels is None:
            first = active.join(shared, "h").where("rep = lead").select("h", F.col("rep").alias("p"), F.col("n").alias("pn")).distinct()
            pairs = active.join(first, "h").where("rep <> p and 100 * least(n, pn) >= 75 * greatest(n, pn)")
        else:
            order = Window.partitionBy("h").orderBy("rep")
            first = active.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots)
            first = ws.stage(first.select("h", F.col("rep").alias("p"), *_other(), F.col("spread").alias("pspread")), "pivots")
            pairs = active.join(first, "h").where(f"rep <> p and {_MAY_LINK} and {_SPREAD}")
        pairs = ws.stage(pairs.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct(), "pairs")
        both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        compared = ws.stage(both.select("a", "b", common.alias("common"), (F.lit(100) * common >= F.lit(75) * (F.size("sa") + F.size("sb") - common)).alias("linked")), "compared")
        edge_tables.append(compared.where("linked").select("a", "b"))
        joined = edge_tables[0]
        for t in edge_tables[1:]:
            joined = joined.union(t)
        again = labels is not None
        labels = components(ws, joined)
        rest = active.join(first.select("h", F.col("p").alias("rep")), ["h", "rep"], "left_anti").drop("label")
        rest = rest.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        active = _unsettled(ws, ws.stage(rest, "rest"))
        if not again and active.count():
            active = _unsettled(ws, _bounded(ws, active, shared, compared, spelled, edges))
        if not active.count():
            break
        pivots *= 4

    root = classes.join(labels.toDF("rep", "label"), "rep", "left").where("copies > 1 or label is not null")
    root = ws.stage(root.select("n_shingles", "k1", "k2", F.coalesce("label", "rep").alias("root")), "roots")
    several = not edges.isEmpty()
    ws.only(signed, root, *([labels] if several else []))
    # ids with several texts: the id's own label counts for all its rows
    out = signed.join(root, ["n_shingles", "k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    if several:
        # a row with an empty set whose id has another text follows its id
        out = out.join(labels.toDF("doc_id", "own"), "doc_id", "left").withColumn("component_id", F.least("component_id", F.coalesce("own", "component_id"))).drop("own")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _unsettled(ws: Workspace, rows: DataFrame) -> DataFrame:
    """The rows in buckets that hold more than one component."""
    mixed = ws.stage(rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h"), "mixed")
    return ws.stage(rows.join(mixed, "h"), "unsettled")


#: What two sets can have in common at most: what both share with their bucket's lead and what both have
#: beside it, or what others have at all; and whether that is enough for a link of different components.
_COMMON = "least(least(m, pm), least(i, pi) + least(d, pd))"
_MAY_LINK = f"label <> pl and 100 * {_COMMON} >= 75 * (n + pn - {_COMMON})"

_SPREAD = "(spread is null or pspread is null or 175 * aggregate(zip_with(spread, pspread, (x, y) -> least(x, y)), 0, (a, x) -> a + x) >= 75 * (n + pn))"


def _other() -> list:
    return [F.col(c).alias(f"p{c}") for c in ("n", "m", "i", "d")] + [F.col("label").alias("pl")]


def _bounded(ws: Workspace, rows: DataFrame, shared: DataFrame, compared: DataFrame, spelled: DataFrame, same_id: DataFrame) -> DataFrame:
    """The rows that may still have a link, with counts that bound it: m shingles that any other unsettled
    document has, i of them in common with the bucket's lead (known from the first round), d beside it.

    Copies of one text that each differ too much from the next have shingles of their own or different ones
    missing, so counts settle most pairs. They are compared by distinct profile (component and counts), of
    which a bucket has few, not by row.
    """
    several = same_id.select(F.col("a").alias("node")).distinct()  # ids with several sets: counts say nothing
    led = ws.stage(rows.join(shared, "h").withColumns({"a": F.least("rep", "lead"), "b": F.greatest("rep", "lead")}), "led")
    nodes = led.select(F.col("rep").alias("node")).union(led.select("lead")).distinct()
    shingles = spelled.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    own = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    own = ws.stage(own.join(several, "node", "left_anti"), "own-shingles")
    plain = compared.select("a", "b", "common").join(several.toDF("a"), "a", "left_anti").join(several.toDF("b"), "b", "left_anti")
    out = led.join(plain, ["a", "b"], "left").join(own.toDF("rep", "own"), "rep", "left").withColumn("m", F.col("n") - F.coalesce("own", F.lit(0)))
    out = out.select("h", "rep", "n", "label", "m", F.coalesce("common", "m").alias("i"), F.coalesce(F.col("m") - F.col("common"), "m").alias("d"))
    out = ws.stage(out, "bounded")
    profile = ["h", "label", "n", "m", "i", "d"]
    kinds = ws.stage(out.select(*profile).distinct(), "profiles")
    others = kinds.select(F.col("h").alias("ph"), *_other())
    hopeful = ws.stage(kinds.join(others, F.expr(f"h = ph and {_MAY_LINK}"), "left_semi"), "hopeful")
    spread = spelled.select(F.col("node").alias("rep"), "spread").join(several.toDF("rep"), "rep", "left_anti")
    return out.join(hopeful, profile, "left_semi").join(spread, "rep", "left").select("h", "rep", "n", "label", "m", "i", "d", "spread")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each group, the one with the smallest doc_id.

    Rows that repeat a kept document's id stay too. Rows without doc_id or without words all stay.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    gone = ws.stage(_near_duplicates(docs, ws).where("not kept").select("doc_id").distinct(), "gone")
    ws.only(gone)
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
