"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last four segments of a text ends a chunk where its low bits are
zero, so the same passage yields the same chunks in every document. A Python worker encodes
and decodes a chunk once and reuses the result in all documents it reads, over its tasks
(least recently used chunks leave when REUSE_BYTES are held). Every join of two chunks is
then checked. With a tokenizer file that always splits before white space (see bpe.py) the two
segments beside a join are encoded together and must agree with the two sides. With any other
file the two chunks themselves are encoded together and must agree with their ids end to end.
Where a join disagrees its two sides become one chunk, which the library encodes anew as a
whole, and its joins are checked in turn, until all agree (a text of which every join is
refused is encoded whole). Answers of checks are remembered as well.

With other files this is exact where the library's merges depend on adjacent tokens only, as in
BPE without a pre-tokeniser: ids that agree across every join of neighbours agree throughout.

Null and empty texts have no ids: n_tokens 0 and the digests of the empty string. Ids repeat
as they come; columns beside id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Encoder, encoder
from .common import Texts, ids_type, mix64, prepare, slices

CHUNK_SEGMENTS = 64
REUSE_BYTES = 48 << 20
PAIRS_KEPT = 200_000


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkCodec:
    """Ids and decoded bytes of texts, from chunks that are shared."""

    def __init__(self, bpe: Encoder, chunk_segments: int = CHUNK_SEGMENTS, reuse_bytes: int = REUSE_BYTES) -> None:
        self.bpe, self.mask, self.most = bpe, np.uint64(chunk_segments - 1), reuse_bytes // 2
        self.young: dict[bytes, tuple[int, bytes, bytes | None]] = {}
        self.old: dict[bytes, tuple[int, bytes, bytes | None]] = {}
        self.held, self.encoded, self.reused = 0, 0, 0
        self.verdicts: dict[int, bool] = {}
        self.joined: dict[tuple[bytes, bytes], bool] = {}
        self.joined_bytes = 0
        alphabet = byte_alphabet()
        names = {i: t for t, i in bpe.tokenizer.get_vocab(with_added_tokens=True).items()}
        tokens = [names.get(i, "") for i in range(bpe.n_ids)]
        pieces = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens]
        self.piece_at = np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.decimal = [str(i) for i in range(len(pieces))]

    def decoded(self, ids: np.ndarray) -> bytes:
        lengths = self.piece_at[ids.astype(np.int64) + 1] - self.piece_at[ids]
        total = np.concatenate(([0], np.cumsum(lengths)))
        got = self.piece_bytes[np.arange(total[-1]) + np.repeat(self.piece_at[ids] - total[:-1], lengths)].tobytes()
        return got.decode("utf-8", "replace").encode()

    def _result(self, key: bytes, ids: np.ndarray) -> tuple[int, bytes, bytes | None]:
        decimal = self.decimal
        back = self.decoded(ids)
        return len(ids), ",".join([decimal[i] for i in ids.tolist()]).encode(), None if back == key else back

    def _put(self, key: bytes, value: tuple[int, bytes, bytes | None]) -> None:
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += 2 * len(key) + len(value[1]) + 200

    def _get(self, key: bytes) -> tuple[int, bytes, bytes | None] | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self._put(key, got)
        return got

    def _disagreeing(self, texts: Texts, starts: np.ndarray, hashes: np.ndarray, joins: np.ndarray) -> set[int]:
        """Joins (by their right segment) at which the two segments together have other ids."""
        pair = mix64(hashes[joins - 1] * np.uint64(3) + hashes[joins] * np.uint64(0x9E3779B97F4A7C15)).tolist()
        fresh: dict[int, int] = {}
        for p, j in zip(pair, joins.tolist()):
            if p not in self.verdicts and p not in fresh:
                fresh[p] = j
        if fresh:
            j = np.array(list(fresh.values()))
            ends = np.append(starts[1:], len(texts.data))
            bounds = [x.tolist() for x in (starts[j - 1], starts[j], ends[j])]
            data = texts.data.tobytes()
            together = self.bpe.whole([data[a:c].decode() for a, c in zip(bounds[0], bounds[2])])
            left = self._encode_pieces([data[a:b] for a, b in zip(bounds[0], bounds[1])])
            right = self._encode_pieces([data[b:c] for b, c in zip(bounds[1], bounds[2])])
            if len(self.verdicts) + len(fresh) > PAIRS_KEPT:
                self.verdicts = {p: self.verdicts[p] for p in pair if p in self.verdicts}
            for p, ids, x, y in zip(fresh, together, left, right):
                self.verdicts[p] = np.array_equal(ids, np.concatenate([x, y]))
        return {j for p, j in zip(pair, joins.tolist()) if not self.verdicts[p]}

    def _encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in pieces]))).astype(np.int64)
        texts = Texts(0, np.frombuffer(b"".join(pieces), dtype=np.uint8), offsets, np.ones(len(pieces), bool))
        ids, at = self.bpe.encode(texts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _agreed_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks of one text, put together until the ids of any two neighbours agree at their join."""
        out: list[bytes] = []
        for chunk in chunks:
            out.append(chunk)
            while len(out) > 1:
                a, b = out[-2:]
                pair = (a, b)
                if (good := self.joined.get(pair)) is None:
                    x, y, both = self.bpe.whole([a.decode(), b.decode(), (a + b).decode()])
                    good = np.array_equal(both, np.concatenate([x, y]))
                    if self.joined_bytes > self.most:
                        self.joined, self.joined_bytes = {}, 0
                    self.joined[pair] = good
                    self.joined_bytes += len(a) + len(b) + 200
                if good:
                    break
                out[-2:] = [a + b]
        return out

    def run(self, texts: Texts) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text: the number of ids, their decimals joined by commas, the decoded bytes."""
        starts, hashes, ranges = self.bpe.segments(texts)
        n = len(starts)
        cut = np.zeros(n, dtype=bool)
        if n > 4:
            rolling = mix64(hashes[:-4] + hashes[1:-3] * np.uint64(3) + hashes[2:-2] * np.uint64(5) + hashes[3:-1] * np.uint64(7))
            cut[4:] = (rolling & self.mask) == 0
        firsts = ranges[:-1][ranges[:-1] < ranges[1:]]
        cut[firsts] = True
        is_first = np.zeros(n, dtype=bool)
        is_first[firsts] = True
        joins = np.flatnonzero(cut & ~is_first)
        data = texts.data.tobytes()
        merged = np.zeros(n, dtype=bool)  # chunks, by their first segment, that hold a refused join
        if self.bpe.by_segment and len(joins):
            bad = np.array(sorted(self._disagreeing(texts, starts, hashes, joins)), dtype=np.int64)
            cut[bad] = False
            kept = np.flatnonzero(cut)
            merged[kept[np.searchsorted(kept, bad, "right") - 1]] = True
        heads = np.flatnonzero(cut)
        lows = starts[heads]
        highs = np.append(lows[1:], len(data))
        keys = [data[a:b] for a, b in zip(lows.tolist(), highs.tolist())]
        whole = {k for k, m in zip(keys, merged[heads].tolist()) if m}
        at = np.searchsorted(heads, ranges).tolist()
        if not self.bpe.by_segment:
            lists = [self._agreed_chunks(keys[a:b]) for a, b in zip(at[:-1], at[1:])]
            keys = [k for chunks in lists for k in chunks]
            at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(int).tolist()
        got: dict[bytes, tuple[int, bytes, bytes | None]] = {}
        for k in keys:
            if k not in got and (v := self._get(k)) is not None:
                got[k] = v
        new = list(dict.fromkeys(k for k in keys if k not in got))
        self.encoded += len(new)
        self.reused += len(keys) - len(new)
        if new:
            alone = [k for k in new if k in whole]
            rest = [k for k in new if k not in whole]
            ids_of = [*self.bpe.whole([k.decode() for k in alone]), *self._encode_pieces(rest)]
            for k, ids in zip([*alone, *rest], ids_of):
                got[k] = self._result(k, ids)
                self._put(k, got[k])
        for a, b in zip(at[:-1], at[1:]):
            mine = keys[a:b]
            parts = [got[k] for k in mine]
            yield (
                sum(p[0] for p in parts),
                b",".join([p[1] for p in parts if p[0]]),
                b"".join([k if p[2] is None else p[2] for k, p in zip(mine, parts)]),
            )


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    if path not in _codecs or _codecs[path].bpe is not encoder(path):
        _codecs.clear()
        _codecs[path] = ChunkCodec(encoder(path))
    return _codecs[path]


def encode_decode(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    prepare(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(tokenizer_path)
        for batch in batches:
            counts, ids, back = [], [], []
            for texts in slices(batch.column(1)):
                for n, decimals, decoded in mine.run(texts):
                    counts.append(n)
                    ids.append(hashlib.sha256(decimals).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    named = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return named.mapInArrow(work, f"doc_id {ids_type(named)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
