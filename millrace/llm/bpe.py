"""Token ids of whole texts by a public tokenizer file, with a bounded memo of pieces.

A byte-level BPE splits a text by a pattern before it merges, and merges inside of pieces only. So the ids of a text are
those of its pieces in order. The pattern's pieces are found for a batch of texts at once, each distinct one is looked up
once a batch, and each worker keeps the ids of those that it has met. Only new ones go to the tokenizer's model.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[str, "PieceEncoder"] = {}
#: Kinds of characters in the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
#: 0 is no character: the ends of a text, and in the table of kinds what has not been asked.
_LETTER, _NUMBER, _SIGN, _GAP, _SPACE = 1, 2, 3, 4, 5


def _starts_here(before: int, kind: int, after: int) -> bool:
    """Whether a piece starts at a character between two others, but for contractions.

    Of a run of white space that something follows, the last one stands apart; if it is a space, it begins the next piece.
    """
    if kind >= _GAP:
        return before < _GAP or 0 < after < _GAP
    return before != kind and before != _SPACE


_STARTS = np.zeros(256, bool)
for _b, _k, _a in product(range(6), range(1, 6), range(6)):
    _STARTS[_b * 36 + _k * 6 + _a] = _starts_here(_b, _k, _a)


def _byte_letters() -> np.ndarray:
    """The characters that stand for the 256 bytes in a byte-level vocabulary."""
    out = np.arange(256, dtype="<u2")
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    out[hidden] = 256 + np.arange(len(hidden))
    return out


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned integers of `width` bytes; ids(texts) those of all.

    At most about `memo` pieces of 64 bytes on average are held, and the memo starts anew when it is full; the ids don't
    depend on it.
    """

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.memo = Tokenizer.from_file(path), memo
        vocab = self.tok.get_vocab(with_added_tokens=True)
        top = max(vocab.values())
        self.dtype = np.dtype("<u2") if top < 65536 else np.dtype("<u4")
        spec = json.loads(self.tok.to_str())
        pre, self.words = spec.get("pre_tokenizer") or {}, None
        # Other kinds of tokenizers split otherwise: they get their texts whole.
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.added = [x["content"] for x in spec.get("added_tokens", [])]
            self.pre, self.kinds = self.tok.pre_tokenizer, np.zeros(0x110000, np.uint8)
            # The same model without the pattern: it gets pieces, in the letters of its vocabulary.
            self.words = Tokenizer(self.tok.model)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters, self.lengths = _byte_letters(), np.zeros(top + 1, np.int64)
            for token, k in vocab.items():
                self.lengths[k] = len(token)
            self._forget()

    def _forget(self) -> None:
        """rows says which piece a text of one is; its ids are sizes[row] ones of the table from starts[row] on."""
        self.rows: dict[bytes, int] = {}
        self.held = self.used = 0
        self.starts, self.sizes, self.table = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, self.dtype)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, points: np.ndarray) -> None:
        """The kinds of characters as the tokenizer itself has them: its pattern joins those of a kind."""
        for point in points.tolist():
            same = (k for k, x in ((_LETTER, "a"), (_NUMBER, "1"), (_SIGN, "!")) if len(self.pre.pre_tokenize_str(x + chr(point))) == 1)
            self.kinds[point] = _SPACE if point == 32 else next(same, _GAP)

    def _cuts(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pieces start in code points of texts that follow each other; firsts: where each one that isn't empty does."""
        kinds = self.kinds[points]
        if not kinds.all():
            self._ask(np.unique(points[kinds == 0]))
            kinds = self.kinds[points]
        around = kinds * np.uint8(6)
        before, after = kinds[:-1] * np.uint8(36), kinds[1:].copy()
        before[firsts[1:] - 1] = after[firsts[1:] - 1] = 0
        around[1:] += before
        around[:-1] += after
        start = _STARTS[around]
        # 's 't 'm 'd 're 've 'll are pieces where a piece starts with them.
        at = np.flatnonzero(points == 39)
        at = at[start[at]]
        if len(at):
            room = np.append(firsts[1:], len(points))[np.searchsorted(firsts, at, "right") - 1] - at
            one, two = (points[np.minimum(at + k, len(points) - 1)] for k in (1, 2))
            long = (room > 2) & ((np.isin(one, (114, 118)) & (two == 101)) | ((one == 108) & (two == 108)))
            short = (room > 1) & np.isin(one, (100, 109, 115, 116))
            start[at[long | short] + 1] = False
            ends = np.append(at[long] + 3, at[short] + 2)
            start[ends[ends < len(points)]] = True
        return np.flatnonzero(start)

    def _learn(self, pieces: pa.Array, names: list[bytes]) -> np.ndarray:
        """Rows of new pieces. Some go as one text, and lengths in bytes say where each ends."""
        ends, raw = _bytes_of(pieces)
        stops = ends[1:].astype(np.int64)
        spelled = np.insert(self.letters[raw], stops[:-1], 32)
        # Short texts: the library's records of a long one are many times as large as it is.
        marks = np.append(np.arange(0, len(names), 128), len(names))
        bounds = (np.append(0, stops) + np.arange(len(names) + 1))[marks]
        ids = []
        for a in range(0, len(bounds) - 1, 16):
            some = bounds[a : a + 17].tolist()
            for e in self.words.encode_batch_fast([spelled[x : y - 1].tobytes().decode("utf-16-le") for x, y in zip(some, some[1:])], add_special_tokens=False):
                ids.append(np.array(e.ids, self.dtype))
        ids = np.concatenate(ids)
        stops = np.searchsorted(np.cumsum(self.lengths[ids]), stops) + 1
        n, used = len(self.rows), self.used
        self.sizes, self.starts = _room(self.sizes, n + len(names)), _room(self.starts, n + len(names))
        self.table = _room(self.table, used + len(ids))
        self.sizes[n : n + len(names)] = np.diff(stops, prepend=0)
        self.starts[n : n + len(names)] = used + np.append(0, stops[:-1])
        self.table[used : used + len(ids)] = ids
        self.rows.update(zip(names, range(n, n + len(names))))
        self.held, self.used = self.held + len(raw), used + len(ids)
        return np.arange(n, n + len(names))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        if self.words is None:
            odd[:] = True
        else:
            for x in self.added:
                odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._with_whole(texts, odd)
        if len(self.rows) > self.memo or self.held > 64 * self.memo:
            self._forget()
        ends, raw = _bytes_of(texts)
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        firsts = np.unique(ends[:-1][ends[:-1] < ends[1:]])
        if raw.max() < 128:
            cuts = self._cuts(raw, firsts)
        else:
            heads = np.flatnonzero((raw & np.uint8(0xC0)) != 0x80)
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
            cuts = heads[self._cuts(points, np.searchsorted(heads, firsts))]
        offsets = np.append(cuts, len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.rows.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._learn(coded.dictionary.take(pa.array(new)), [names[i] for i in new.tolist()])
        codes = coded.indices.to_numpy()
        sizes = self.sizes[rows][codes]
        stops = np.cumsum(sizes, dtype=np.int64)
        out = self.table[np.repeat(self.starts[rows][codes] - stops + sizes, sizes) + np.arange(stops[-1])]
        return out, np.append(0, stops)[np.searchsorted(cuts, ends[1:])]

    def _with_whole(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ids(); the odd texts go whole to the tokenizer."""
        whole = iter(self._plain(texts.filter(pa.array(odd)).to_pylist()))
        if odd.all():
            parts = list(whole)
        else:
            ids, stops = self.ids(pc.if_else(pa.array(odd), "", texts))
            parts = [next(whole) if x else ids[a:b] for x, a, b in zip(odd.tolist(), [0, *stops.tolist()], stops.tolist())]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        ids, stops = self.ids(pa.array(texts, pa.large_string()))
        raw, stops = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def ended(self, texts: pa.Array, end_id: int, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices with about `size` bytes: the place of the first text, ids as ids() has them with an end id after each text's, ends."""
        for a, b in slices(texts, size):
            ids, stops = self.ids(texts.slice(a, b - a))
            yield a, np.insert(ids, stops, end_id), stops + np.arange(1, b - a + 1)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of an array without nulls begins and the last one ends, and their bytes."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return ends - ends[0], np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw else np.zeros(0, np.uint8)


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """x, or a copy twice as long as asked if it is too short."""
    return x if size <= len(x) else np.append(x, np.zeros(2 * size - len(x), x.dtype))


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Slices of an array of texts with about `size` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = min(len(texts), int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size)) + 1)
        yield start, stop
        start = stop


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Drops the encoders that a worker keeps from task to task, with their memos."""
    _ENCODERS.clear()


def batches(texts: list, size: int = 1 << 20):
    """Slices of a list of texts with about `size` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
