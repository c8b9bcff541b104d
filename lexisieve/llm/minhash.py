"""Near-duplicate groups: circulant MinHash, banding, and exact Jaccard confirmation.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words between white
space; fewer words are one shingle; no words, no set). Two documents are linked when 100 times
the intersection is at least 75 times the union, on full sets.

1. Signatures. One permutation scatters the shingles over 32 bits; a second, circularly
   shifted by k, gives coordinate k: two permutations serve all 128 coordinates.
2. Copies. Documents with equal sets collapse into their smallest id before anything is
   compared, with map-side partial aggregation.
3. Banding. 32 bands of 4 coordinates: a pair at 0.75 is missed with probability 6e-6. In a
   bucket, signatures are compared in blocks, and a block yields a spanning forest, never its
   pairs. A pair goes on at 70 of 128 agreeing coordinates, over 5 standard deviations below
   what 0.75 gives.
4. Confirmation. Components of the pairs that go on are read again as full sets, blockwise,
   and every pair in a block is decided exactly (one incidence product); again a block
   yields a spanning forest of confirmed links. Their components are the result.

A bucket or component of several blocks is first linked inside each block, every row once; then a
few rows of each part so found meet, which joins the parts of one family; what still falls apart
is compared across: all rows outside its largest part with all rows. So no pair that could join two
parts is left out, and a family of near copies costs its rows and not the square of its blocks.

Shingles are compared by 64-bit hashes of their words. Rows with a null id are returned with
a null component, kept. Rows that repeat an id are judged row by row, and told apart by text_key (a
64-bit hash of the text); rows equal in both share their fate. Null and
empty texts are components of their own. An empty table gives no rows; other columns are
passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Spans, Texts, Workspace, ids_type, mix64, shingle_hashes, slices
from .components import connected_components

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
GO_ON = 70
BLOCK = 2048
SET_BLOCK_ROWS, SET_BLOCK_SHINGLES = 1024, 1 << 20
NUMERATOR, DENOMINATOR = 75, 100


def shingle_sets(texts: Texts, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    folded = LOWER[texts.data]
    starts, ends, ranges = Texts(0, folded, texts.offsets, texts.valid).words()
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    words = Spans(folded).hashes(starts, ends)
    at = ranges.tolist()
    whole = shingle_hashes(words, k) if len(words) >= k else None
    return [
        np.unique(whole[a : b - k + 1]) if b - a >= k else shingle_hashes(words[a:b], k)
        for a, b in zip(at[:-1], at[1:])
    ]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Circulant MinHash: one row of COORDINATES values for each (non-empty) set."""
    base = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    x, y = np.empty_like(base), np.empty_like(base)
    for k in range(COORDINATES):
        np.add(base, np.uint32(k), out=x)  # the circular shift, modulo 2**32
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            if factor:
                np.multiply(x, np.uint32(factor), out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    wide = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    first = (wide[:, :, 0] << np.uint64(32)) | wide[:, :, 1]
    second = (wide[:, :, 2] << np.uint64(32)) | wide[:, :, 3]
    return mix64(mix64(first) * np.uint64(0x9E3779B97F4A7C15) + second + np.arange(BANDS, dtype=np.uint64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column(1)):
            sets = shingle_sets(texts)
            n = len(sets)
            full = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
            hi, lo = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys, sig = np.zeros((0, BANDS), np.uint64), np.zeros((0, COORDINATES), np.uint8)
            if len(full):
                mine = [sets[i] for i in full]
                flat = np.concatenate(mine)
                starts = np.concatenate(([0], np.cumsum([len(s) for s in mine])[:-1]))
                hi[full] = np.add.reduceat(mix64(flat + np.uint64(1)), starts)
                lo[full] = np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                values = signatures(mine)
                keys, sig = band_keys(values), (values & np.uint32(255)).astype(np.uint8)
            has = np.zeros(n, bool)
            has[full] = True
            offsets = np.concatenate(([0], np.cumsum(has))).astype(np.int32)
            binary = iter(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(texts.first, n), batch.column(2).slice(texts.first, n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(hi.view(np.int64), mask=~has), pa.array(lo.view(np.int64), mask=~has),
                    pa.ListArray.from_arrays(pa.array(offsets * BANDS), pa.array(keys.view(np.int64).reshape(-1))),
                    pa.array([next(binary).tobytes() if h else None for h in has.tolist()], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "key_hi", "key_lo", "bands", "sig"],
            )


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, most_rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Complete groups of rows sorted by their first n_keys columns, and the groups' bounds."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(len(table), dtype=bool)
        change[0] = True
        for k in range(n_keys):
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(change), len(table))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most_rows:
            table = pa.Table.from_batches(held).combine_chunks()
            bounds = cut(table)
            if len(bounds) > 2:
                yield table.slice(0, int(bounds[-2])), bounds[:-1]
                rest = table.slice(int(bounds[-2])).combine_chunks()
                held, rows = rest.to_batches(), len(rest)
                most_rows = max(most_rows, rows)
            else:
                held, most_rows = table.to_batches(), 2 * rows
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric relation reaches."""
    m = len(adjacent)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], m).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _agreeing(sig: np.ndarray) -> np.ndarray:
    m = len(sig)
    count = np.zeros((m, m), dtype=np.uint8)
    for k in range(COORDINATES):
        c = np.ascontiguousarray(sig[:, k])
        count += c[:, None] == c[None, :]
    return count >= GO_ON


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, bi, bj, rep, sig (sorted): a spanning forest of each block's likely pairs."""
    for table, bounds in _groups(batches, 3):
        rep = table.column(3)
        sig = np.frombuffer(b"".join(table.column(4).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
        sizes = np.diff(bounds)
        left, right = [], []
        for m in np.unique(sizes[sizes > 1]).tolist():
            at = bounds[:-1][sizes == m]
            if m <= 12:
                for lo in range(0, len(at), 4096):
                    rows = at[lo : lo + 4096, None] + np.arange(m)
                    s = sig[rows]
                    label = np.tile(np.arange(m), (len(rows), 1))
                    near = [[(s[:, i] == s[:, j]).sum(axis=1) >= GO_ON for j in range(m)] for i in range(m)]
                    for _ in range(m):
                        for i in range(m):
                            for j in range(m):
                                if i != j:
                                    label[:, i] = np.where(near[i][j], np.minimum(label[:, i], label[:, j]), label[:, i])
                        if m == 2:
                            break
                    g, i = np.nonzero(label != np.arange(m))
                    left.append(rows[g, i])
                    right.append(rows[g, label[g, i]])
            else:
                for a in at.tolist():
                    label = _roots(_agreeing(sig[a : a + m]))
                    i = np.flatnonzero(label != np.arange(m))
                    left.append(a + i)
                    right.append(a + label[i])
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(i)).combine_chunks(), rep.take(pa.array(j)).combine_chunks()], names=["a", "b"])


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets reach the similarity, exactly."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = np.zeros((m, m), dtype=np.int64)
    if m <= 6:
        for i in range(m):
            for j in range(i):
                if DENOMINATOR * min(size[i], size[j]) >= NUMERATOR * max(size[i], size[j]):
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        owner = np.repeat(np.arange(m), size)
        _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df[column] > 1
        owner, column = owner[shared], column[shared]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        number = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
        step = max(256, min(4096, (1 << 23) // m))
        cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + step + 1, step))
        total = np.zeros((m, m), dtype=np.float32)
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if a < b:
                part = np.zeros((m, step), dtype=np.float32)
                part[owner[a:b], number[a:b] - k * step] = 1
                total += part @ part.T
        both = total.astype(np.int64)
    union = size[:, None] + size[None, :] - both
    return (DENOMINATOR * both >= NUMERATOR * union) & (both > 0)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns comp, bi, bj, rep, text (sorted): a spanning forest of each block's exact links."""
    key, sets, reps = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            label = _roots(_linked(sets))
            i = np.flatnonzero(label != np.arange(len(sets)))
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([reps[x] for x in i.tolist()], kind), pa.array([reps[label[x]] for x in i.tolist()], kind)], names=["a", "b"]
                )

    for batch in batches:
        kind = batch.schema.field(3).type
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        ids = batch.column(3).to_pylist()
        for texts in slices(batch.column(4)):
            for i, s in enumerate(shingle_sets(texts)):
                at = texts.first + i
                if keys[at] != key:
                    yield from done()
                    key, sets, reps = keys[at], [], []
                sets.append(s)
                reps.append(ids[at])
    if key is not None:
        yield from done()


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key."""
    ws = Workspace(spark, "minhash")
    named = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    kind = ids_type(named)
    feats = ws.save(
        named.withColumn("text_key", F.xxhash64("text")).mapInArrow(
            _features, f"doc_id {kind}, text_key long, n_shingles long, key_hi long, key_lo long, bands array<long>, sig binary"
        ),
        "features",
    )
    set_key = ["key_hi", "key_lo", "n_shingles"]
    reps = ws.save(
        feats.where(F.col("key_hi").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(*set_key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "reps",
    )
    banded = reps.select("rep", F.explode("bands").alias("key"))
    shared = ws.save(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb")), "shared")
    met = banded.join(shared, "key").join(reps.select("rep", "sig"), "rep").withColumn("load", F.lit(1.0 / BLOCK))
    forest = _forest(ws, met, shared, ["rep", "sig"], _bucket_links, kind, "likely")
    coarse = ws.save(connected_components(ws, forest, "coarse"), "coarse")
    load = F.greatest(F.lit(1.0 / SET_BLOCK_ROWS), F.col("n_shingles") / F.lit(float(SET_BLOCK_SHINGLES)))
    loaded = coarse.join(reps.select(F.col("rep").alias("node"), load.alias("load")), "node")
    sizes = ws.save(loaded.groupBy(F.col("component").alias("key")).agg(F.ceil(F.sum("load")).cast("int").alias("nb")), "sizes")
    placed = loaded.withColumnsRenamed({"node": "rep", "component": "key"}).join(sizes, "key")
    read = named.withColumnRenamed("doc_id", "rep").join(placed, "rep")
    links = _forest(ws, read, sizes, ["rep", "text"], _confirmed, kind, "links")
    exact = connected_components(ws, links, "exact").withColumnRenamed("node", "rep")
    named_sets = reps.select(*set_key, "rep").join(exact, "rep", "left")
    # written, so that both sides of the join stand right behind their shuffles: adaptive execution
    # then splits the rows of one large group of copies
    named_sets = ws.save(named_sets.select(*set_key, F.coalesce("component", "rep").alias("component")), "named")
    ws.drop("shared", "coarse", "sizes", "reps")
    out = feats.select("doc_id", "text_key", *set_key).join(named_sets, set_key, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_key")


#: Rows of each part that meet those of the other parts of a bucket or component.
HEADS = 4


def _forest(ws: Workspace, rows: DataFrame, sizes: DataFrame, columns: list[str], compare, kind: str, label: str) -> DataFrame:
    """Links (a, b) that join what a comparison of all rows of equal key would join, written.

    rows has key, nb (blocks of the key), load (share of a block) and columns, of which rep names
    a row; sizes has key and nb. compare takes sorted (key, bi, bj, *columns) to links.
    """
    def compared(some: DataFrame, first: Column, second: Column, part: str) -> DataFrame:
        dealt = some.select("key", first.cast("int").alias("bi"), second.cast("int").alias("bj"), *columns)
        laid = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
        return ws.save(laid.mapInArrow(compare, f"a {kind}, b {kind}").distinct(), f"{label}-{part}")

    def block(of: str = "nb", seed: int = 0) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(of).cast("long"))

    links = compared(rows, block(), block(), "alone")
    wide_keys = sizes.where("nb > 1").select("key")
    if wide_keys.isEmpty():
        return links
    wide = rows.join(wide_keys, "key", "left_semi")

    def fallen_apart(step: str) -> DataFrame:
        """The rows' parts, of keys that have several."""
        parts = connected_components(ws, links, f"{label}-{step}").withColumnRenamed("node", "rep")
        held = wide.select("key", "rep", "load").distinct().join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        held = ws.save(held, f"{label}-{step}-held")
        some = held.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("key")
        return ws.save(held.join(some, "key"), f"{label}-{step}-parts")

    def blocks_of(some: DataFrame, name: str) -> DataFrame:
        return some.groupBy("key").agg(F.ceil(F.sum("load")).cast("int").alias(name))

    parts = fallen_apart("first")
    if parts.isEmpty():
        return links
    # row_number is limited in each task before the shuffle, so a large part stays small
    by_part = Window.partitionBy("key", "component").orderBy(F.xxhash64("rep"), "rep")
    heads = parts.withColumn("_r", F.row_number().over(by_part)).where(F.col("_r") <= HEADS).select("key", "rep", "load")
    heads = heads.join(blocks_of(heads, "_n"), "key").drop("load")
    links = links.unionAll(compared(rows.join(heads, ["key", "rep"]), block("_n", 1), block("_n", 1), "heads"))
    parts = fallen_apart("second")
    if parts.isEmpty():
        return links
    counts = parts.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = counts.groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("component"))
    rest = parts.join(largest, ["key", "component"], "left_anti").select("key", "rep", "load")
    sides = blocks_of(parts, "_na").join(blocks_of(rest, "_nr"), "key")
    # blocks of the rest (_nr) meet blocks of all (_na): a row goes to each block of the other side
    of_rest = rest.select("key", "rep").join(sides, "key").select("key", "rep", block("_nr", 2).alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("_j"))
    of_all = parts.select("key", "rep").join(sides, "key").select("key", "rep", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)).alias("_i"), block("_na", 3).alias("_j"))
    dealt = rows.join(of_rest.unionAll(of_all.select("key", "rep", F.col("_i").cast("long").alias("_i"), F.col("_j").cast("int").alias("_j"))).distinct(), ["key", "rep"])
    return links.unionAll(compared(dealt, F.col("_i"), F.col("_j"), "across"))


def near_duplicate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


#: Every pair that shares a shingle, decided exactly; for small tables.
NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (doc_id)
"""
