"""Joins what is found in texts to its first occurrence in the corpus, however common it is.

One shuffle brings equal hashes together in order of document and place, and a pass over them links
each row to the first, without a join and without holding a group. A hash that stands HEAVY times
in one batch of rows is spread: the batch sends its first occurrence alone to the hash's place, and
its other rows meet the answer in a second shuffle and pass, dealt over SALTS tasks a hash, each of
which gets a copy of the answer. So no group lands in one task, nothing is joined in pairs, and each
row gives one link at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, Workspace, ids_type, mix64, slices

#: Rows of a hash in one batch of rows from which on it is spread, and over how many salts.
HEAVY, SALTS = 16, 16


def _marked_rows(find: Callable[[Texts], list[tuple[np.ndarray, np.ndarray]]], heavy_rows: int):
    """Columns doc_id, text -> key, doc_id, place, mark.

    A row under its hash has no mark. Of a hash that is heavy in the batch, the least row goes under
    the hash with the hash as its mark, and all rows go under keys of their own.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            _, order_of = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            rows, places, hashes = [], [], []
            for texts in slices(batch.column(1)):
                for i, (at, h) in enumerate(find(texts)):
                    rows.append(np.full(len(at), texts.first + i))
                    places.append(at)
                    hashes.append(h)
            if not rows:
                continue
            row, place, seed = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
            order = np.argsort(seed, kind="stable")
            row, place, seed = row[order], place[order], seed[order]
            new = np.ones(len(seed), dtype=bool)
            new[1:] = seed[1:] != seed[:-1]
            first = np.flatnonzero(new)
            size = np.diff(first, append=len(seed))
            heavy = np.repeat(size >= heavy_rows, size)
            key, mark = seed, np.zeros(len(seed), dtype=np.uint64)
            if heavy.any():
                part = np.flatnonzero(heavy)
                least = part[np.lexsort((place[part], order_of[row[part]], seed[part]))]
                least = least[np.append(True, seed[least][1:] != seed[least][:-1])]
                mark = np.where(heavy, seed, mark)
                key = np.where(heavy, mix64(seed + np.arange(len(seed), dtype=np.uint64) // np.uint64(heavy_rows) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), seed)
                row, place = np.concatenate([row, row[least]]), np.concatenate([place, place[least]])
                key, mark = np.concatenate([key, seed[least]]), np.concatenate([mark, seed[least]])
                heavy = np.concatenate([heavy, np.ones(len(least), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), ids.take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(mark.view(np.int64), mask=~heavy)],
                names=["key", "doc_id", "place", "mark"],
            )

    return work


_LINKED = ["doc_id", "source_id", "place", "source_place", "mark"]


def _first_occurrences(across: bool):
    """Rows by key, doc_id, place -> links, and what is needed to link the rows of heavy hashes.

    doc_id, source_id, place, source_place, mark: a link has no mark; the first occurrence of a
    heavy hash has no document; other rows of a heavy hash have no source.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, (None, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(1).type
            keys, place = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            marked = ~batch.column(3).is_null().to_numpy(zero_copy_only=False)
            mark = batch.column(3).fill_null(0).to_numpy()
            member = marked & (mark != keys)
            at = np.flatnonzero(~member)
            parts = []
            if len(at):
                k, p, docs = keys[at], place[at], batch.column(1).take(pa.array(at))
                ids = docs.to_numpy(zero_copy_only=False)
                new = np.ones(len(k), dtype=bool)
                new[1:] = k[1:] != k[:-1]
                new[0] = k[0] != key
                begin = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
                source_ids, source_places = ids[np.maximum(begin, 0)], p[np.maximum(begin, 0)]
                carried = begin < 0  # the key of the batch before goes on
                if carried.any():
                    source_ids, source_places = source_ids.copy(), source_places.copy()
                    source_ids[carried], source_places[carried] = first
                summary = marked[at]
                later = ids > source_ids
                if not across:
                    later |= (ids == source_ids) & (p > source_places)
                link = np.flatnonzero(~summary & later)
                sources = pa.array(source_ids, kind)
                parts.append((docs.take(pa.array(link)), sources.take(pa.array(link)), p[link], source_places[link], None))
                told = np.flatnonzero(summary)
                if len(told):
                    parts.append((None, sources.take(pa.array(told)), source_places[told], source_places[told], k[told]))
                key, first = k[-1], (source_ids[-1], source_places[-1])
            if member.any():
                rows = np.flatnonzero(member)
                parts.append((batch.column(1).take(pa.array(rows)), None, place[rows], place[rows], mark[rows]))
            for doc, source, p, q, m in parts:
                if len(p):
                    none = pa.nulls(len(p), kind)
                    yield pa.RecordBatch.from_arrays(
                        [doc if doc is not None else none, source if source is not None else none, pa.array(p), pa.array(q),
                         pa.array(m) if m is not None else pa.nulls(len(p), pa.int64())],
                        names=_LINKED,
                    )

    return work


def _heavy_links(across: bool):
    """Rows of heavy hashes by mark, salt and document, the first occurrence (no document) before the others -> links."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            told = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(told)
            known = batch.column(1).take(pa.array(heads))
            if first is not None:  # the hash of the batch before may go on
                known = pa.concat_arrays([first[0], known])
            which = np.searchsorted(heads, np.arange(len(told)), "right") - (first is None)
            q = np.concatenate([[] if first is None else [first[1]], batch.column(3).to_numpy()[heads]]).astype(np.int32)
            rows = np.flatnonzero(~told)
            if len(rows):
                docs, p = batch.column(0).take(pa.array(rows)), batch.column(2).to_numpy()[rows]
                sources, places = known.take(pa.array(which[rows])), q[which[rows]]
                ids, source_ids = docs.to_numpy(zero_copy_only=False), sources.to_numpy(zero_copy_only=False)
                later = ids > source_ids
                if not across:
                    later |= (ids == source_ids) & (p > places)
                link = np.flatnonzero(later)
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(link)), sources.take(pa.array(link)), pa.array(p[link]), pa.array(places[link])], names=_LINKED[:4]
                )
            first = (known.slice(len(known) - 1), q[-1])

    return work


def link_to_firsts(
    ws: Workspace, known: DataFrame, find: Callable[[Texts], list[tuple[np.ndarray, np.ndarray]]], across: bool, heavy: int = HEAVY
) -> DataFrame:
    """(doc_id, source_id, place, source_place): what find gives of rows(doc_id, text), each with its first occurrence.

    find tells the places and hashes of each text. across: only links between different ids; else
    a row is linked to an earlier place of its own document too. The table written is "linked".
    """
    kind = ids_type(known)
    marked = known.select("doc_id", "text").mapInArrow(_marked_rows(find, heavy), f"key long, doc_id {kind}, place int, mark long")
    linked = ws.save(
        marked.repartition("key").sortWithinPartitions("key", "doc_id", "place")
        .mapInArrow(_first_occurrences(across), f"doc_id {kind}, source_id {kind}, place int, source_place int, mark long"),
        "linked",
    )
    columns = ["doc_id", "source_id", "place", "source_place"]
    salted = linked.where("mark is not null and doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int"))
    # a heavy hash has as many rows at least as salts, so the copies of its first occurrence stay fewer than its rows
    told = linked.where("doc_id is null").dropDuplicates(["mark"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    laid = salted.unionByName(told).repartition("mark", "salt").sortWithinPartitions("mark", "salt", F.col("doc_id").asc_nulls_first())
    heavy = laid.select(*columns).mapInArrow(_heavy_links(across), f"doc_id {kind}, source_id {kind}, place int, source_place int")
    return linked.where("mark is null").select(*columns).unionAll(heavy)
