"""Spans of text that tokenizers encode independently of their surroundings, found for many texts at once."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

# Kinds of characters in the splitter's pattern.
_LETTER, _NUMBER, _OTHER, _SPACE, _SPECIAL, _UNKNOWN = range(6)
_PROBES = ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!"))
#: What follows an apostrophe in an English contraction.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset, code point) of each character of UTF-8 ``data``."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        start, lead = at[wide], code[wide]
        b, c, d = (padded[start + k] & 0x3F for k in (1, 2, 3))
        code[wide] = np.where(
            lead < 0xE0, (lead & 0x1F) << 6 | b, np.where(lead < 0xF0, (lead & 0x0F) << 12 | b << 6 | c, (lead & 0x07) << 18 | b << 12 | c << 6 | d)
        )
    return at, np.minimum(code, 0x10FFFF)


class ByteLevelSplitter:
    """Pre-tokens of a byte-level BPE tokenizer of the tokenizers library.

    The pattern joins letters, numbers or other signs, each with one blank
    before it, keeps runs of white space apart and cuts English contractions
    off. The kind of a character is asked of the library itself when it first
    occurs, so that both go by one version of Unicode.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.loads(self.tokenizer.to_str())
        splitter = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or splitter.get("type") != "ByteLevel" or not splitter["use_regex"] or splitter["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normalizer and prefix is needed")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens must match as they are")
        self.special = [] if special_as_text else [t.content.encode() for t in added]
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)

    def _learn(self, codes: np.ndarray) -> None:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in codes.tolist():
            sign = chr(c) if not 0xD800 <= c < 0xE000 else "�"
            self.kinds[c] = next((kind for kind, before in _PROBES if len(pieces(before + sign)) == 1), _SPACE)

    def _special_spans(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens stand: the leftmost first, of those the longest; none crosses texts."""
        raw, found = data.tobytes(), []
        for token in self.special:
            k = raw.find(token)
            while k >= 0:
                found.append((k, k + len(token)))
                k = raw.find(token, k + 1)
        out, last = [], 0
        for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
            same = np.searchsorted(bounds, a, side="right") == np.searchsorted(bounds, b - 1, side="right")
            if a >= last and same:
                out.append((a, b))
                last = b
        return out

    def split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each pre-token, whether it is an added token); together they cover ``data``, none crosses texts."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        at, code = characters(data)
        unknown = np.flatnonzero(self.kinds[code] == _UNKNOWN)
        if len(unknown):
            self._learn(np.unique(code[unknown]))
        kind, size = self.kinds[code], len(at)
        border = np.zeros(size + 1, bool)
        border[np.searchsorted(at, bounds)] = True
        for a, b in self._special_spans(data, bounds):
            a, b = np.searchsorted(at, (a, b))
            kind[a:b] = _SPECIAL
            border[[a, b]] = True
        border = border[:size]
        run = border.copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        # White space before a run gives its last character away: a blank joins the run, another one stands alone.
        after = np.flatnonzero(run & ~border & (kind != _SPACE))
        after = after[kind[after - 1] == _SPACE]
        start[after - 1] = True
        start[after] = code[after - 1] != 0x20
        # A contraction starts at a pre-token's start; the letters after it start another.
        mark = np.flatnonzero(start & (code == 0x27) & (kind == _OTHER))
        ahead = np.concatenate([np.where(border, 0, code), np.zeros(3, np.int32)])
        for tail in CONTRACTIONS:
            if len(mark):
                hit = np.all([ahead[mark + 1 + k] == ord(c) for k, c in enumerate(tail)], axis=0)
                start[mark[hit] + 1] = False
                end = mark[hit] + 1 + len(tail)
                start[end[end < size]] = True
        first = np.flatnonzero(start)
        return at[first], kind[first] == _SPECIAL


def blank_spans(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the spans that begin with a run of blanks; each text begins with a blank."""
    blank = data == 0x20
    blank[1:] &= data[:-1] != 0x20
    blank[bounds[:-1]] = True
    return np.flatnonzero(blank)


def span_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The spans that ``starts`` cut ``data`` into, without a copy."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class SpanEncoder:
    """Ids of spans; a worker encodes a distinct span once, until it knows ``most_bytes`` and starts anew."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most_bytes: int = 64 << 20):
        self.encode, self.most_bytes, self.known, self.size = encode, most_bytes, {}, 0

    def lists(self, spans: pa.Array) -> pa.ListArray:
        """The ids of each span."""
        coded = spans.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.size > self.most_bytes:
            self.known, self.size = {}, 0
        new = [s for s in distinct if s not in self.known]
        if new:
            for s, ids in zip(new, self.encode(new), strict=True):
                self.known[s] = ids
                self.size += 200 + len(s) + 40 * len(ids)
        return pa.array([self.known[s] for s in distinct], pa.list_(pa.int32())).take(coded.indices)
