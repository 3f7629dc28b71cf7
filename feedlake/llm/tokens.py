"""Token ids of whole texts, computed inside tasks with the tokenizers library."""

from __future__ import annotations

import os
import secrets

import numpy as np
import pyarrow as pa

from .common import loads, lower_ascii, same_spans, slices, span_hashes, text_buffers

# Kinds of bytes. The vocabulary's splitter never joins letters, single digits and punctuation with each other.
_OTHER, _BLANK, _LETTER, _PUNCTUATION, _DIGIT = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[33:127][_KIND[33:127] == _OTHER] = _PUNCTUATION
_KIND[48:58] = _DIGIT
_KIND[ord("'")] = _OTHER  # may be part of a contraction
_PAIR = np.zeros(65536, bool)  # two bytes of a Latin letter, as a little-endian number
for _c in range(0xC0, 0x250):
    if _c not in (0xD7, 0xF7, 0x130):
        _PAIR[int.from_bytes(chr(_c).encode(), "little")] = True


def parts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(data, starts, ends, row, odd) of spans whose ids, one after another, are the texts' ids.

    White space separates chunks. A chunk of letters, digits and punctuation
    falls into runs of one kind, in lower case; any other chunk is one (odd)
    span, and so is a text that may hold a special token. The vocabularies used here
    drop white space and ignore case before they split a text.
    """
    n = len(data)
    kind = _KIND[data]
    two = (loads(data)[:n] & np.uint64(0xFFFF)).astype(np.int64)
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    lead = lead[_PAIR[two[lead]]]
    kind[lead] = kind[lead + 1] = _LETTER
    special = np.flatnonzero(two == 0x7C3C)  # <|
    special = np.unique(np.searchsorted(bounds, special, side="right") - 1)
    for k in special.tolist():
        kind[bounds[k] : bounds[k + 1]] = _OTHER
    inside = kind != _BLANK
    edge = np.ones(n + 1, bool)  # a chunk or a blank run starts
    edge[1:n] = inside[1:] != inside[:-1]
    edge[bounds] = True
    chunk = np.cumsum(edge[:n])
    odd = np.zeros(int(chunk[-1]) + 1 if n else 1, bool)
    odd[chunk[kind == _OTHER]] = True
    plain = ~odd[chunk]
    cut = edge[:n].copy()
    cut[1:] |= plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    starts = np.flatnonzero(cut & inside)
    stop = np.flatnonzero(np.append(cut, True))
    ends = stop[np.searchsorted(stop, starts, side="right")]
    low = np.where(plain, lower_ascii(data), data)
    return low, starts, ends, np.searchsorted(bounds, starts, side="right") - 1, ~plain[starts]


class TokenTable:
    """Ids of known spans, held as flat arrays of at most ``most_bytes``; it empties itself when it is full."""

    def __init__(self, path: str, most_bytes: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_bytes = Tokenizer.from_file(path), most_bytes
        ends = [i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closes[ends] = True
        self.clear()

    def clear(self) -> None:
        self.seed = secrets.randbits(64)
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.at, self.ids, self.first = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, spans: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the library's ids of all spans, number of each); spans that aren't ``odd`` go many at once, told apart by their closing token."""
        out: list[np.ndarray] = []
        sizes = np.zeros(len(spans), np.int64)
        for a in range(0, len(spans), 256):
            some, alone = spans[a : a + 256], odd[a : a + 256].any()
            if not alone:
                ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
                stop = np.flatnonzero(self.closes[ids]) + 1
                alone = len(stop) != len(some)
                if not alone:
                    out.append(ids)
                    sizes[a : a + 256] = np.diff(stop, prepend=0)
            if alone:
                for k, x in enumerate(self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in some], add_special_tokens=False)):
                    out.append(np.array(x.ids, "<u4"))
                    sizes[a + k] = len(x.ids)
        return np.concatenate(out), sizes

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        order = np.argsort(odd, kind="stable")
        keys, starts, ends, odd = keys[order], starts[order], ends[order], odd[order]
        raw = data.tobytes()
        spans = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids, sizes = self._encode(spans, odd)
        size = len(self.at) - 1
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(spans), np.uint8)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(ends - starts)])
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        keys, entry = np.concatenate([self.keys, keys]), np.concatenate([self.entry, np.arange(size, size + len(spans))])
        order = np.argsort(keys)
        self.keys, self.entry = keys[order], entry[order]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        data, starts, ends, row, odd = parts(data, bounds)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        while True:
            if len(self.data) + 4 * len(self.ids) + 32 * len(self.at) > self.most_bytes:
                self.clear()
            h = span_hashes(data, starts, ends, self.seed)
            keys, one, which = np.unique(h, return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, keys)
            new = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != keys) if len(self.keys) else np.arange(len(keys))
            if len(self.keys):
                new = np.union1d(new, np.flatnonzero(at == len(self.keys)))
            if len(new):
                self._learn(keys[new], data, starts[one[new]], ends[one[new]], odd[one[new]])
                at = np.searchsorted(self.keys, keys)
            entry = self.entry[at][which]
            size = ends - starts
            if (self.at[entry + 1] - self.at[entry] == size).all() and same_spans(data, starts, self.data, self.at[entry], size):
                break
            self.clear()  # two spans have one hash: hash anew
        many = self.first[entry + 1] - self.first[entry]
        stop = np.cumsum(many)
        where = np.arange(int(stop[-1])) + np.repeat(self.first[entry] - (stop - many), many)
        return self.ids[where], np.bincount(row, many, minlength=len(bounds) - 1).astype(np.int64)


_TABLES: dict[str, TokenTable] = {}


def token_table(path: str) -> TokenTable:
    """The table of this worker process, which outlives a task."""
    if path not in _TABLES:
        _TABLES[path] = TokenTable(path)
    return _TABLES[path]


def encoded(batch: pa.RecordBatch, text_col: str, table: TokenTable, end: int, limit: int = 4 << 20):
    """(first row, ids, offsets) for slices of rows: the ids of each row's text and then ``end``; null counts as empty."""
    data, offsets = text_buffers(batch.column(text_col))
    for a, b in slices(offsets, limit):
        ids, n = table.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        stop = np.cumsum(n + 1)
        out = np.empty(int(stop[-1]), "<u4")
        is_end = np.zeros(len(out), bool)
        is_end[stop - 1] = True
        out[is_end], out[~is_end] = end, ids
        yield a, out, np.append(0, stop)
