"""Exact byte-level BPE of whole texts from reused pieces (tokenizers library).

The pre-tokeniser of a byte-level BPE always splits where a solid character is followed by
white space, and where a run of ASCII letters, digits or punctuation ends and another kind begins
(not from punctuation to a letter: an apostrophe may belong to what follows). What follows such
a place is tokenised as if it stood alone. The text between two such places is a segment. So the
ids of a text are the ids of its segments end to end, and a segment met before need not be encoded
again. Segments end at the same bytes in every document, whatever precedes them.

Whether a tokenizer file splits in that way is read from the file; with one that does not
(tokens that span blanks, normalisers, added tokens with blanks) every text is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np

from .common import SPACE, Spans, Texts

#: White space outside ASCII, or that libraries class differently: such texts are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_BYTES = np.zeros(256, dtype=bool)
_ODD_BYTES[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Letters, digits and punctuation of ASCII (1, 2, 3), and the changes of kind at which a segment ends.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 3
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KINDS[[*range(0x30, 0x3A)]] = 2
_CHANGES = np.zeros(16, dtype=bool)
_CHANGES[[4 * a + b for a, b in ((1, 2), (1, 3), (2, 1), (2, 3), (3, 2))]] = True
#: Slots of a worker's table of segments (half of them filled at most) and ids held in all:
#: 17 bytes a slot and 4 an id at most, so 34 MB. Beyond that the table is emptied and filled anew.
SLOTS = 1 << 20
IDS_KEPT = 1 << 22
#: Longer segments are encoded each time and not kept.
LONGEST_KEPT = 256
#: Segments looked up together.
BLOCK = 1 << 16


class SegmentTable:
    """Ids of segments by the 64-bit hash and the length of their bytes: open addressing in arrays."""

    def __init__(self, kind: type) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.full = np.zeros(SLOTS, dtype=bool)
        self.key = np.zeros(SLOTS, dtype=np.uint64)
        self.where = np.zeros(SLOTS, dtype=np.int32)
        self.count, self.size = np.zeros(SLOTS, dtype=np.uint16), np.zeros(SLOTS, dtype=np.uint16)
        self.flat, self.held, self.used = np.zeros(1 << 18, self.kind), 0, 0

    def has_room(self, segments: int, ids: int) -> bool:
        return self.held + segments <= SLOTS // 2 and self.used + ids <= IDS_KEPT

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slot of each segment, or -1."""
        at = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.full(len(at), -1, dtype=np.int64)
        left = np.arange(len(at))
        while len(left):
            here = at[left]
            left, here = left[self.full[here]], here[self.full[here]]
            same = (self.key[here] == hashes[left]) & (self.size[here] == sizes[left])
            out[left[same]] = here[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (SLOTS - 1)
        return out

    def put(self, hashes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Segments not held yet, each once; ids end to end."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(min(len(self.flat), 1 << 20), self.kind)])
        self.flat[self.used : self.used + len(ids)] = ids
        begins = self.used + np.cumsum(counts) - counts
        at = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(at))
        while len(left):
            free = left[~self.full[at[left]]]
            self.where[at[free]] = -1 - free  # of several that want one slot, the last gets it
            won = free[self.where[at[free]] == -1 - free]
            slot = at[won]
            self.full[slot] = True
            self.key[slot], self.where[slot] = hashes[won], begins[won]
            self.count[slot], self.size[slot] = counts[won], sizes[won]
            placed = np.zeros(len(at), dtype=bool)
            placed[won] = True
            left = left[~placed[left]]
            at[left] = (at[left] + 1) & (SLOTS - 1)
        self.held += len(hashes)
        self.used += len(ids)


def splits_at_blanks(path: str) -> bool:
    """Whether a tokenizer file is byte-level BPE that always splits before white space after a solid character."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    step = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
    by_rule = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    solid = all(not re.search(r"\s", x["content"]) and not x.get("lstrip") and not x.get("rstrip") for x in added)
    return bool(plain and by_rule and solid)


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each range, end to end."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(begins - before, counts)


class Encoder:
    """Segment ids of one tokenizer file, remembered in one Python worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.by_segment = splits_at_blanks(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_ids = max(vocab.values()) + 1
        self.starts = np.zeros(self.n_ids, dtype=bool)
        for token, i in vocab.items():
            self.starts[i] = token.startswith("Ġ")  # the byte 0x20 in this alphabet
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.n_ids <= 65_536 else np.uint32
        self.table = SegmentTable(self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by the library alone."""
        return [np.array(x.ids, dtype=self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments not met before, end to end, and how many each has.

        Plain words (one blank and a solid run) are encoded as runs of text and told apart by the
        tokens that start with a blank; others, and runs that do not come apart so, one by one.
        """
        lengths = ends - starts
        counts = np.full(len(starts), -1, dtype=np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        second = data[np.minimum(starts + 1, len(data) - 1)]
        plain = np.flatnonzero((lengths > 1) & (data[starts] == 0x20) & ~SPACE[second])
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            run = data[_ranges(starts[part], lengths[part])].tobytes()
            if any(s in run for s in self.special):
                continue
            ids = self.whole([run.decode()])[0]
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(part) and at[0] == 0:
                counts[part] = np.diff(at, append=len(ids))
                pieces.append((part, ids))
        rest = np.flatnonzero(counts < 0)
        if len(rest):
            got = self.whole([data[a:b].tobytes().decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])
            counts[rest] = [len(x) for x in got]
            pieces.append((rest, np.concatenate(got)))
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=self.kind)
        for part, ids in pieces:
            out[_ranges(begins[part], counts[part])] = ids
        return out, counts

    def segments(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment starts, their hashes, and each text's range of segments."""
        data = texts.data
        n = len(data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none.astype(np.uint64), np.zeros(len(texts.offsets), dtype=np.int64)
        space, kinds = SPACE[data], _KINDS[data]
        cut = np.zeros(n, dtype=bool)
        cut[1:] = _CHANGES[4 * kinds[:-1] + kinds[1:]]
        if any(s in data.tobytes() for s in self.special):  # added tokens go over changes of kind
            for i in range(len(texts)):
                if any(s in texts.raw(i) for s in self.special):
                    cut[texts.offsets[i] : texts.offsets[i + 1]] = False
        cut[1:] |= space[1:] & ~space[:-1]
        # no cut inside a text that has odd white space
        if _ODD_BYTES[data].any():
            for i in range(len(texts)):
                lo, hi = texts.offsets[i], texts.offsets[i + 1]
                if _ODD_BYTES[data[lo:hi]].any() and _ODD_SPACE.search(texts.raw(i).decode()):
                    cut[lo:hi] = False
        firsts = texts.offsets[:-1]
        cut[firsts[firsts < n]] = True
        starts = np.flatnonzero(cut)
        hashes = Spans(data).hashes(starts, np.append(starts[1:], n))
        return starts, hashes, np.searchsorted(starts, texts.offsets)

    def encode(self, texts: Texts, segments: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's range of ids (n + 1 offsets)."""
        if not self.by_segment:
            got = self.whole([texts.raw(i).decode() for i in range(len(texts))])
            at = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int64)
            return (np.concatenate(got) if got else np.zeros(0, self.kind)), at
        starts, hashes, ranges = segments or self.segments(texts)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(texts.offsets), dtype=np.int64)
        ends = np.append(starts[1:], len(texts.data))
        parts, counts = [], np.zeros(len(starts) + 1, dtype=np.int64)
        for lo in range(0, len(starts), BLOCK):
            part, counts[lo + 1 : lo + BLOCK + 1] = self._block(texts.data, starts[lo : lo + BLOCK], ends[lo : lo + BLOCK], hashes[lo : lo + BLOCK])
            parts.append(part)
        return np.concatenate(parts), np.cumsum(counts)[ranges]

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some segments end to end, and how many each has."""
        table, sizes = self.table, np.minimum(ends - starts, 65_535)
        slot = table.find(hashes, sizes)
        missing = np.flatnonzero(slot < 0)
        keep = missing[sizes[missing] <= LONGEST_KEPT]
        if len(keep):
            _, first = np.unique(hashes[keep], return_index=True)
            new = keep[first]
            ids, counts = self._fresh(data, starts[new], ends[new])
            if table.has_room(len(new), len(ids)):
                table.put(hashes[new], sizes[new], counts, ids)
                slot[keep] = table.find(hashes[keep], sizes[keep])
            elif table.held:
                table.clear()
                return self._block(data, starts, ends, hashes)
        flat, where, counts = table.flat, table.where[slot].astype(np.int64), table.count[slot].astype(np.int64)
        odd = np.flatnonzero(slot < 0)  # long ones, and blocks of more ids than the table may hold
        if len(odd):
            got = self.whole([data[a:b].tobytes().decode() for a, b in zip(starts[odd].tolist(), ends[odd].tolist())])
            counts[odd] = [len(x) for x in got]
            where[odd] = len(flat) + np.cumsum(counts[odd]) - counts[odd]
            flat = np.concatenate([flat, *got])
        return flat[_ranges(where, counts)], counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file: its memory lasts over the tasks of a worker."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders.clear()  # one file at a time: workers are shared by all queries of a session
        _encoders[path] = Encoder(path)
    return _encoders[path]
