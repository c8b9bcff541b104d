"""Line deduplication: winnowing over line hashes, positions joined, matches extended, later runs deleted.

The lines that hold a word form a sequence per document (lines are compared without white
space at their ends). In every window of RUN lines the line with the smallest hash (the last
such) is a fingerprint, so any repeated run of RUN or more lines is sure to share one. A
fingerprint stands under the hashes of the windows that hold it, so that two positions meet where
the lines around them agree too. Each position is joined to the first one in the corpus (smaller
id, or the same document further up), by one shuffle and a pass over it, never pair by pair. A
joined position is extended to both sides: windows that go on along the same two places make up
one maximal run (find_runs reports them with their sources). Runs of later positions are deleted,
with empty lines inside; the lines of a run that belong to its own first occurrence, where the two
overlap in one document, stay: of "a a a" the first two lines are left.

A line that is long (LONE_WORDS words) or stands alone in its document is a run by itself, beside
the windows: it is deleted where such a line stands earlier. With run = 1 every line is.

What is deleted is exactly that, nothing is missed (tests hold it to brute force and to SQL). Null
texts stay null; a text may become empty. Rows with a null id neither lose lines nor count as
occurrences. Rows that repeat an id are one document with several texts: positions are compared by
id and place, so none of them is the later one, and they lose the same lines. An empty table gives
no rows; other columns are kept as they are, but one named removed_lines gives way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Spans, Texts, Workspace, ids_type, mix64, prepare, slices
from .firsts import HEAVY, link_to_firsts

RUN, LONE_WORDS = 2, 8
_LONE = np.uint64(0x5851F42D4C957F2D)


def line_hashes(texts: Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: the numbers, hashes and word counts of its lines that hold a word."""
    data, offsets = texts.data, texts.offsets
    if not len(data):
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(texts)
    breaks = np.flatnonzero(data == 0x0A)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    # a line ends at its break; the last line of a text ends with the text
    text_of = np.concatenate([np.arange(len(texts)), owner])
    order = np.lexsort((starts, text_of))
    starts, text_of = starts[order], text_of[order]
    last = np.append(text_of[1:] != text_of[:-1], True)
    ends = np.where(last, offsets[1:][text_of], np.append(starts[1:] - 1, 0))
    first = np.searchsorted(text_of, np.arange(len(texts)))
    number = np.arange(len(starts)) - first[text_of]
    solid = np.flatnonzero(~SPACE[data])
    if not len(solid):
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(texts)
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    worded = b > a
    lo, hi = solid[a[worded]], solid[b[worded] - 1] + 1
    # a line ends at a break, so a word never goes over into the next one
    begins = np.flatnonzero(np.append(True, SPACE[data[:-1]]) & ~SPACE[data])
    words = np.searchsorted(begins, hi) - np.searchsorted(begins, lo, "right") + 1
    hashes, number, text_of = Spans(data).hashes(lo, hi), number[worded], text_of[worded]
    cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
    return [(number[i:j], hashes[i:j], words[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def fingerprints(hashes: np.ndarray, run: int) -> np.ndarray:
    """Places of the window minima (the last of equal ones)."""
    if len(hashes) < run:
        return np.zeros(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], run)
    return np.unique(len(hashes) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1)))


def window_hashes(hashes: np.ndarray, run: int) -> np.ndarray:
    total = np.zeros(len(hashes) - run + 1, dtype=np.uint64)
    for j in range(run):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - run + 1 + j])
    return total


def _positions(run: int, lone_words: int, texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: twice the place of each window that holds a fingerprint, and its hash; odd for lines by themselves."""
    out = []
    for _, hashes, words in line_hashes(texts):
        places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        at = fingerprints(hashes, run)
        if len(at):
            first = at[:, None] - np.arange(run)
            first = np.unique(first[(first >= 0) & (first <= len(hashes) - run)])
            places.append(2 * first)
            keys.append(window_hashes(hashes, run)[first])
        if run > 1:
            lone = np.arange(len(hashes)) if len(hashes) == 1 else np.flatnonzero(words >= lone_words)
            places.append(2 * lone + 1)
            keys.append(mix64(hashes[lone] ^ _LONE))
        out.append((np.concatenate(places), np.concatenate(keys)))
    return out


def _maximal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, source_id, place, source_place, sorted so -> runs: doc_id, source_id, place, source_place, windows.

    A joined position is extended while the next one goes on by one line on both sides; one line
    by itself is not extended.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, source = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        p, q = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        new = np.ones(len(p), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (p[1:] - p[:-1] != 2) | (q[1:] - q[:-1] != 2) | (p[1:] % 2 == 1)
        first = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first)), batch.column(2).take(pa.array(first)),
             batch.column(3).take(pa.array(first)), pa.array(np.diff(first, append=len(p)).astype(np.int32))],
            names=["doc_id", "source_id", "place", "source_place", "windows"],
        )


def find_runs(spark: SparkSession, ws: Workspace, docs: DataFrame, run: int = RUN, lone_words: int = LONE_WORDS) -> DataFrame:
    """Maximal repeated runs of documents(doc_id, text), each with its first occurrence.

    doc_id, source_id, place and source_place (twice the number of a line, counted among lines with
    a word; odd for a line by itself), windows (a run of n windows is n + run - 1 lines). A run that
    spans two Arrow batches is told in two parts.
    """
    prepare(spark)
    kind = ids_type(docs)
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    links = link_to_firsts(ws, known, partial(_positions, run, lone_words), across=False, heavy=HEAVY)
    # windows and single lines apart; a group is the links of one document: bounded by its lines
    laid = links.repartition("doc_id").sortWithinPartitions("doc_id", F.col("place") % 2, "source_id", "place", "source_place")
    return laid.select("doc_id", "source_id", "place", "source_place").mapInArrow(
        _maximal_runs, f"doc_id {kind}, source_id {kind}, place int, source_place int, windows int"
    )


def _dead_lines(number: np.ndarray, runs: list[dict], run: int) -> set[int]:
    """Line numbers (from 0) that the runs of one text delete."""
    dead: set[int] = set()
    for r in runs:
        lines = 1 if r["place"] % 2 else run
        p, q = r["place"] // 2, r["source_place"] // 2
        for k in range(r["windows"]):
            if p + k + lines > len(number):
                break  # found in another row of the id
            low = int(number[p + k])
            if r["own"] and q + lines > p:
                low = max(low, int(number[q + k + lines - 1]) + 1)
            dead.update(range(low, int(number[p + k + lines - 1]) + 1))
    return dead


def dedup_lines(
    spark: SparkSession, docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", lone_words: int = LONE_WORDS
) -> DataFrame:
    """docs with later repeated runs deleted from the text, and removed_lines (numbers, from 0)."""
    ws = Workspace(spark, "lines")
    # all columns travel under names that cannot clash
    kept = [c for c in docs.columns if c.lower() != "removed_lines"]
    names = [f"_c{i}" for i in range(len(kept))]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)],
    )
    runs = find_runs(spark, ws, rows.select("doc_id", F.col("_text").alias("text")), run, lone_words)
    # the runs of one document: bounded by its lines
    found = runs.groupBy("doc_id").agg(
        F.collect_list(F.struct("place", "source_place", "windows", (F.col("doc_id") == F.col("source_id")).alias("own"))).alias("_runs")
    )
    joined = rows.join(found, "doc_id", "left").select("_text", "_runs", *names)
    kinds = ", ".join(["_text string", "removed_lines array<int>", *[f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, kept)]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, text = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            gone: list[list[int]] = [[] for _ in text]
            some = [i for i, r in enumerate(runs) if r and text[i] is not None]
            if some:
                for texts in slices(batch.column(0).take(pa.array(some))):
                    for k, (number, _, _) in enumerate(line_hashes(texts)):
                        i = some[texts.first + k]
                        dead = _dead_lines(number, runs[i], run)
                        if dead:
                            text[i] = "\n".join([x for j, x in enumerate(text[i].split("\n")) if j not in dead])
                            gone[i] = sorted(dead)
            yield pa.RecordBatch.from_arrays(
                [pa.array(text, pa.string()), pa.array(gone, pa.list_(pa.int32())), *batch.columns[2:]], names=["_text", "removed_lines", *names]
            )

    cut = joined.mapInArrow(work, kinds)
    return cut.select(*[F.col("_text" if c == text_col else n).alias(c) for n, c in zip(names, kept)], "removed_lines")


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(spark, docs).select("doc_id", F.array_join("removed_lines", ",").alias("removed_lines"), "text")


#: 8 is LONE_WORDS; a run is two lines.
LINE_DEDUP_SQL = r"""
WITH lines AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS k, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
worded AS (SELECT doc_id, k, regexp_replace(x, '^[ \t\v\f\r]+|[ \t\v\f\r]+$', '', 'g') AS t, count(*) OVER (PARTITION BY doc_id) AS m FROM lines WHERE regexp_matches(x, '[^ \t\v\f\r]')),
windows AS (SELECT doc_id, k AS lo, lead(k) OVER v AS hi, t || chr(10) || lead(t) OVER v AS gram FROM worded WINDOW v AS (PARTITION BY doc_id ORDER BY k)),
ranked AS (SELECT *, row_number() OVER v AS r, first_value(doc_id) OVER v AS source, first_value(hi) OVER v AS source_hi FROM windows WHERE gram IS NOT NULL WINDOW v AS (PARTITION BY gram ORDER BY doc_id, lo)),
lone AS (SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS r FROM worded WHERE m = 1 OR len(regexp_extract_all(t, '[^ \t\v\f\r]+')) >= 8),
dead AS (SELECT doc_id, unnest(range(CASE WHEN source = doc_id THEN greatest(lo, source_hi + 1) ELSE lo END, hi + 1)) AS k FROM ranked WHERE r > 1 UNION SELECT doc_id, k FROM lone WHERE r > 1)
SELECT doc_id, coalesce(string_agg(CASE WHEN d.k IS NOT NULL THEN l.k::VARCHAR END, ',' ORDER BY l.k), '') AS removed_lines,
coalesce(string_agg(CASE WHEN d.k IS NULL THEN l.x END, chr(10) ORDER BY l.k), '') AS text
FROM lines l LEFT JOIN dead d USING (doc_id, k) GROUP BY doc_id
"""
