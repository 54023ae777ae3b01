"""Token ids of whole texts, with each distinct piece encoded once per worker.

Both tokenizers here split at white space before any merge, so a text's ids are its pieces' ids in a row. A
piece is a word, with the white space before it where the tokenizer keeps white space. Ids of pieces are kept
in a table of fixed size (a slot per hash; a newer piece takes the slot), so memory stays bounded. The pieces' bytes are
kept with them, and ids are used again only for a piece with the same length and bytes. Texts with white space outside ``[\\x20\\x09-\\x0D]`` are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from .common import Texts, U64, _chunks, chunked_hashes, is_space, words_of

JOINED = 64

_encoders: dict[tuple[str, bool, int], "PieceEncoder"] = {}


def encoder(path: str, keeps_space: bool, slots: int = 1 << 20) -> "PieceEncoder":
    """This worker's encoder for a tokenizer file, with a table of so many pieces."""
    key = (path, keeps_space, slots)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, keeps_space, slots, 5 * slots)
    return _encoders[key]


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Places of Unicode white space beyond ASCII."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    at = at[at < len(data) - 1]
    a, b, c = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    odd |= (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[odd]


class PieceEncoder:
    def __init__(self, path: str, keeps_space: bool, slots: int = 1 << 20, kept_ids: int = 3_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.mask = keeps_space, U64(slots - 1)
        self.widths = self._widths()
        self.keys, self.at, self.size = np.zeros(slots, U64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.ids, self.used, self.kept_ids = np.zeros(1 << 16, np.uint16 if small else np.uint32), 0, kept_ids
        # Of the piece in each slot: its length, and where its bytes begin in ``bytes``, eight to a value.
        self.length, self.bytes_at = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.bytes, self.bytes_used = np.zeros(1 << 16, U64), 0

    def _widths(self) -> np.ndarray | None:
        """The number of a text's bytes that each id stands for, where tokens are bytes of the text; else None.

        So it is where the tokenizer changes no byte, and, for pieces of ASCII and the letters from U+00C0 to U+00FF, where it
        composes characters, makes them lower-case (of as many bytes) and leaves out white space.
        """
        kind = json.loads(self.tokenizer.to_str())
        suffix = kind["model"].get("end_of_word_suffix") or ""
        if self.keeps_space:
            known = not kind["normalizer"] and kind["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        else:
            steps = lambda part, names: [x["type"] for x in (part or {}).get(names, [])]
            known = steps(kind["normalizer"], "normalizers") == ["NFC", "Replace", "Lowercase"] and steps(kind["pre_tokenizer"], "pretokenizers") == ["Split", "ByteLevel"]
            known = known and not kind["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]
        if not known:
            return None
        widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            widths[i] = len(token.removesuffix(suffix))  # a character for each byte; special tokens are ASCII
        return widths

    def _encoded(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has.

        Where ids tell their widths, short pieces are encoded ``JOINED`` at a time: such as begin with white space and end without, or
        with a blank between; no token reaches from one into the next, and the widths tell where each ends.
        """
        texts, sizes = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], np.zeros(len(starts), np.int64)
        if self.widths is None:
            return self._one_by_one(texts)
        bytes_ = np.frombuffer(raw, np.uint8)
        if self.keeps_space:
            fits, between = is_space(bytes_[starts]) & ~is_space(bytes_[ends - 1]), b""
        else:
            other = np.append(0, np.cumsum((bytes_ >= 0xC4) | (bytes_ == 0xC2)))
            fits, between = other[ends] == other[starts], b" "
        joins = fits & (ends - starts < 64)
        some, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        groups = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
        made, sizes_alone = self._one_by_one([between.join([texts[k] for k in g]) for g in groups] + [texts[k] for k in alone])
        cut = int(sizes_alone[: len(groups)].sum())
        ends_of, wanted = np.cumsum(self.widths[made[:cut]]), np.cumsum((ends - starts)[some])
        upto = np.searchsorted(ends_of, wanted, side="left")
        if len(some) and (not cut or ends_of[-1] != wanted[-1] or (ends_of[upto] != wanted).any()):  # bytes that are no UTF-8 were replaced
            return self._one_by_one(texts)
        sizes[some], sizes[alone] = np.diff(np.append(0, upto + 1)), sizes_alone[len(groups) :]
        if len(alone):  # back in the order of the pieces
            order = np.argsort(np.concatenate([np.repeat(some, sizes[some]), np.repeat(alone, sizes[alone])]), kind="stable")
            made = made[order]
        return made, sizes

    def _one_by_one(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes

    def _store(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new, sizes = self._encoded(raw, starts, ends)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(new)
        return at, sizes

    def _keep_bytes(self, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep the chunks, and say where each piece's begin."""
        while self.bytes_used + len(chunks) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.bytes_used : self.bytes_used + len(chunks)] = chunks
        at = self.bytes_used + np.cumsum(sizes) - sizes
        self.bytes_used += len(chunks)
        return at

    def _others(self, length: np.ndarray, kept_length: np.ndarray, chunks: tuple[np.ndarray, np.ndarray, np.ndarray], kept_at: np.ndarray) -> np.ndarray:
        """Which pieces differ in length or bytes from what is kept for them."""
        values, first, number = chunks
        size = np.diff(np.append(first, len(values)))
        other = length != kept_length
        unlike = values != self.bytes[np.minimum(np.repeat(kept_at, size) + number, len(self.bytes) - 1)]
        other[np.repeat(np.arange(len(size)), size)[unlike]] = True
        return other

    def pieces(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, and where each text's pieces start."""
        w = words_of(t)
        starts, ends, doc = w.starts, w.ends, w.doc
        if self.keeps_space:
            starts = np.empty_like(w.starts)
            starts[1:] = w.ends[:-1]
            begin = w.first[:-1][w.counts > 0]
            starts[begin] = t.offsets[:-1][w.counts > 0]
            tail = t.offsets[:-1].copy()
            tail[w.counts > 0] = w.ends[w.first[1:][w.counts > 0] - 1]
            left = np.flatnonzero(tail < t.offsets[1:])
            if len(left):
                starts, ends, doc = np.append(starts, tail[left]), np.append(ends, t.offsets[left + 1]), np.append(doc, left)
                order = np.argsort(starts, kind="stable")
                starts, ends, doc = starts[order], ends[order], doc[order]
        odd = _odd_space(t.data)
        if len(odd):
            whole = np.unique(np.searchsorted(t.offsets, odd, side="right") - 1)
            keep = ~np.isin(doc, whole)
            starts, ends, doc = np.append(starts[keep], t.offsets[whole]), np.append(ends[keep], t.offsets[whole + 1]), np.append(doc[keep], whole)
            order = np.argsort(doc, kind="stable")
            starts, ends, doc = starts[order], ends[order], doc[order]
        return starts, ends, np.searchsorted(doc, np.arange(t.n + 1))

    def encode(self, t: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each text's with ``end_id`` after them, and where each text's ids start."""
        if self.used > self.kept_ids:
            self.keys[:] = 0
            self.used = self.bytes_used = 0
        starts, ends, first = self.pieces(t)
        length = ends - starts
        values, chunk, number = chunks = _chunks(t.data, starts, ends)
        h = chunked_hashes(chunks, length)
        slot = (h & self.mask).astype(np.int64)
        at, size, kept_length, kept_at = (x[slot].astype(np.int64) for x in (self.at, self.size, self.length, self.bytes_at))
        miss, raw = np.flatnonzero(self.keys[slot] != h), None
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one, raw = miss[where], t.data.tobytes()
            new_at, new_size = self._store(raw, starts[one], ends[one])
            n = np.diff(np.append(chunk, len(values)))[one]
            new_bytes = self._keep_bytes(values[np.arange(int(n.sum())) + np.repeat(chunk[one] - np.cumsum(n) + n, n)], n)
            at[miss], size[miss], kept_length[miss], kept_at[miss] = new_at[back], new_size[back], length[one][back], new_bytes[back]
            into = (new & self.mask).astype(np.int64)
            self.keys[into], self.at[into], self.size[into], self.length[into], self.bytes_at[into] = new, new_at, new_size, length[one], new_bytes
            # Two new pieces may want one slot: numpy keeps the last of each of the assignments, so they agree.
        other = np.flatnonzero(self._others(length, kept_length, chunks, kept_at))
        if len(other):  # hashes that clash
            at[other], size[other] = self._store(raw or t.data.tobytes(), starts[other], ends[other])
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids_first = total[first] + np.arange(t.n + 1)
        doc = np.repeat(np.arange(t.n), np.diff(first))
        out = np.full(int(ids_first[-1]), end_id, np.uint32)
        within = np.arange(int(total[-1]))
        out[within + np.repeat(doc, size)] = self.ids[within + np.repeat(at - total[:-1], size)]
        return out, ids_first
