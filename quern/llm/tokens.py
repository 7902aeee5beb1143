"""Token ids of whole texts by a public tokenizer whose vocabulary splits at white space."""

from __future__ import annotations

import os

import numpy as np

from quern.llm.common import _BYTE, _LOWER, _power_tables, mix

_loaded: dict[tuple[str, int], "WordTokenizer"] = {}

_SPACE, _LETTER, _DIGIT, _PUNCT, _GLUE = range(5)
_CLASS = np.full(256, _GLUE, np.uint8)
_CLASS[[32, 10]] = _SPACE
_CLASS[33:127] = _PUNCT
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _GLUE


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Encodes texts through a bounded hash table of units and their ids.

    The tokenizer lower-cases, drops white space and takes letters, single digits and runs of other
    characters apart, so the ids of a text are those of such units one after the other. Units end
    only where that is sure from ASCII (and from the Latin letters of U+00C0 to U+00FF): whatever
    stands beside an apostrophe, another script or odd white space stays in one unit, and texts with
    a special token's opening go to the tokenizer whole. A unit is known by a 64-bit fingerprint.
    """

    def __init__(self, path: str, most_units: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_units = most_units
        self.slots = 1 << max(12, (2 * most_units - 1).bit_length())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab_size(), max(vocabulary.values()) + 1), bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int32)
        self.count = self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, "<u4")

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Each unit's number, -1 if it isn't known."""
        mask, out = np.uint64(self.slots - 1), np.full(len(h), -1, np.int32)
        slot, todo = (h & mask).astype(np.int64), np.arange(len(h))
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        n = len(h)
        for name, need in (("first", self.count + n), ("size", self.count + n), ("ids", self.used + len(ids))):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(max(need, len(old) * 3 // 2), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.first[self.count : self.count + n] = self.used + np.cumsum(size) - size
        self.size[self.count : self.count + n] = size
        self.ids[self.used : self.used + len(ids)] = ids
        todo = np.arange(n)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]] = h[todo[put]], self.count + todo[put]
            on = np.ones(len(todo), bool)
            on[put] = False
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        self.count += n
        self.used += len(ids)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and how many each has: many units a call, told apart by tokens that end a word."""
        ids, sizes = [], []
        for a in range(0, len(units), 400):
            group = units[a : a + 400]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(got):
                ids.append(got)
                sizes.append(np.diff(cuts, prepend=0))
            elif len(group) > 8:  # some unit makes several words
                for b in range(0, len(group), max(8, len(group) // 8)):
                    more = self._encode_units(group[b : b + max(8, len(group) // 8)])
                    ids.append(more[0])
                    sizes.append(more[1])
            else:
                alone = [e.ids for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                ids += [np.array(x, "<u4") for x in alone]
                sizes.append(np.array([len(x) for x in alone]))
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _block(self, docs: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
        n = len(data)
        low, kind = _LOWER[data], _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]
        kind[lead] = kind[lead + 1] = _LETTER
        before = np.empty_like(kind)
        before[0], before[1:] = _SPACE, kind[:-1]
        apart = (before != kind) | (kind == _DIGIT)
        start = (kind != _SPACE) & ((before == _SPACE) | apart & (before != _GLUE) & (kind != _GLUE))
        starts = np.flatnonzero(start)
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, start[1:] | (kind[1:] == _SPACE)
        stops = np.flatnonzero(after & (kind != _SPACE)) + 1
        power, inverse = _power_tables(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[low] * power[:n], out=total[1:])
        h = mix((total[stops] - total[starts]) * inverse[starts]) | np.uint64(1)
        unit = self._find(h)
        if (unit < 0).any():
            new, where = np.unique(h[unit < 0], return_index=True)
            where = np.flatnonzero(unit < 0)[where]
            if self.count + len(new) > self.most_units:
                self._reset()
                new, where = np.unique(h, return_index=True)
            text = low.tobytes()
            units = [text[a:b].decode("utf-8", "replace") for a, b in zip(starts[where].tolist(), stops[where].tolist())]
            self._insert(new, *self._encode_units(units))
            unit = self._find(h)
        size = self.size[unit]
        end = np.cumsum(size)
        total_ids = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(self.first[unit] - end + size, size) + np.arange(total_ids)]
        units_before = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in docs]))
        return np.split(ids, np.concatenate([[0], end])[units_before][:-1])

    def encode(self, docs: list[bytes], limit: int = 1 << 20) -> list[np.ndarray]:
        """The ids of each text (UTF-8), as little-endian unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if group:
                out.extend(self._block(group))
            group.clear()
            held = 0

        for d in docs:
            if b"<|" in d:
                flush()
                text = d.decode("utf-8", "replace")
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
                continue
            if held and held + len(d) > limit:
                flush()
            group.append(d)
            held += len(d) + 1
        flush()
        return out


def word_tokenizer(path: str, most_units: int = 2_000_000) -> WordTokenizer:
    """One tokenizer a worker process."""
    key = (path, most_units)
    if key not in _loaded:
        _loaded[key] = WordTokenizer(path, most_units)
    return _loaded[key]
