"""Token ids of whole texts with a public byte-level BPE, whose file is a parameter.

Texts are cut before the merges by byte classes in numpy, each distinct span is encoded once by
``tokenizers`` and kept in a bounded table, and a text's ids are gathered from that table. Texts with
characters outside ASCII and the Latin-1 letters go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from pulsegrid.llm import textcodes as tc

TOKENIZER = "byte_bpe_50k.json"
END = 2
_SLOTS = 1 << 19
#: Ids kept; beyond it the table starts anew.
_KEPT_IDS = 2_000_000

_SPACE, _LETTER, _DIGIT, _OTHER, _END = range(5)
_class = np.full(256, _OTHER, np.uint8)
_class[[9, 10, 11, 12, 13, 32]] = _SPACE
_class[48:58] = _DIGIT
_class[65:91] = _class[97:123] = _class[128:] = _LETTER


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Ids:
    """Ids of chunks of texts; one per worker process and tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int64)
        self.n = np.zeros(_SLOTS, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _look(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (code >> np.uint64(45)).astype(np.int64)
        return slot, self.key[slot] == code

    def _add(self, code: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(n.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], flat, np.zeros(len(self.ids), np.uint32)))
        else:
            self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.concatenate(([0], np.cumsum(n)[:-1]))
        self.used += len(flat)
        slot = (code >> np.uint64(45)).astype(np.int64)
        self.key[slot], self.at[slot], self.n[slot] = code, at, n
        return at, n

    def encode(self, buf: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a chunk (texts end with one added byte), the end id last."""
        if self.used > _KEPT_IDS:
            self._clear()
        last = np.append(at[1:], len(buf)) - 1
        odd = odd_bytes(buf)
        strange = np.unique(np.searchsorted(at, np.flatnonzero(odd), "right") - 1) if odd.any() else np.zeros(0, np.int64)
        start, end = spans(buf, last)
        code = tc.codes(buf, start, end, tc._VALUES)
        closing = np.searchsorted(start, last)
        place, count = np.zeros(len(start), np.int64), np.ones(len(start), np.int64)
        slot, hit = self._look(code)
        hit[closing] = True
        place[hit], count[hit] = self.at[slot[hit]], self.n[slot[hit]]
        for i in strange:
            hit[closing[i - 1] + 1 if i else 0 : closing[i]] = True
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, first, back = np.unique(code[miss], return_index=True, return_inverse=True)
            raw = buf.tobytes()
            texts = [raw[s:e].decode("utf-8") for s, e in zip(start[miss[first]].tolist(), end[miss[first]].tolist(), strict=True)]
            a, n = self._add(new, texts)
            place[miss], count[miss] = a[back], n[back]
        count[closing] = 1
        place[closing] = 0
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(place - total[:-1], count) + np.arange(total[-1])]
        ids[total[closing]] = END
        cut = np.concatenate(([0], total[closing] + 1))
        out = [ids[cut[i] : cut[i + 1]] for i in range(len(at))]
        for i in strange:
            text = buf[at[i] : last[i]].tobytes().decode("utf-8")
            out[i] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], np.uint32)
        return out


def odd_bytes(buf: np.ndarray) -> np.ndarray:
    """Marks bytes of characters whose class the byte tables don't hold."""
    odd = (buf >= 0xC0) & (buf != 0xC3)
    odd |= (buf >= 0x1C) & (buf <= 0x1F)
    follows = np.zeros(len(buf), bool)
    follows[1:] = buf[:-1] == 0xC3
    return odd | (follows & ((buf == 0x97) | (buf == 0xB7)))


def spans(buf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pieces of text that merges stay within; ``last``: the added byte of each text.

    A run of letters, digits or other characters is a piece, with one blank before it; white space before
    it is a piece of its own, as is its last character if no blank; white space that ends a text is one.
    An apostrophe that begins such a run takes s, t, re, ve, m, ll or d after it.
    """
    cls = _class[buf]
    cls[last] = _END
    begins = np.ones(len(buf) + 1, bool)
    np.not_equal(cls[1:], cls[:-1], out=begins[1:-1])
    begins[last] = True
    runs = np.flatnonzero(begins)
    kind = cls[runs[:-1]]
    white = np.flatnonzero(kind == _SPACE)
    after = runs[white + 1]
    inner = after[cls[np.minimum(after, len(cls) - 1)] != _END]
    blank = buf[inner - 1] == 32
    begins[inner - 1] = True
    begins[inner[blank]] = False
    quote = runs[:-1][(kind == _OTHER) & (buf[runs[:-1]] == 39) & (np.diff(runs) == 1)]
    if len(quote):
        quote = quote[begins[quote]]
        b = [buf[np.minimum(quote + k, len(buf) - 1)] for k in (1, 2)]
        one = np.isin(b[0], np.frombuffer(b"stmd", np.uint8))
        two = ((b[0] == 114) | (b[0] == 118)) & (b[1] == 101) | (b[0] == 108) & (b[1] == 108)
        two &= cls[np.minimum(quote + 2, len(cls) - 1)] == _LETTER
        take = one.astype(np.int64) + 2 * (two & ~one)
        use = (take > 0) & (cls[np.minimum(quote + 1, len(cls) - 1)] == _LETTER)
        q, take = quote[use], take[use]
        begins[q + 1] = False
        begins[q + 1 + take] = True
    at = np.flatnonzero(begins)
    return at[:-1], at[1:]


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]
