"""Sentence pieces of whole texts, the bytes of the text that each piece stands for, and texts from ids."""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from quern.llm.common import _BYTE, _power_tables, clean_text, mix, text_bytes, written
from quern.llm.tokens import WordTokenizer

_loaded: dict[tuple[str, int], "PieceTokenizer"] = {}

MARK = "▁".encode()
#: Kinds of pieces in a model file: fixed values of the format.
UNKNOWN, CONTROL, CHOSEN, BYTE = 2, 3, 4, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields (number, value) of a serialized message, in order; nested messages are bytes."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _number(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _bytes_field(number: int, value: bytes) -> bytes:
    out, size = bytearray([number << 3 | 2]), len(value)
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + value


class CharacterMap:
    """A compiled map of byte strings to what replaces them: a double array of prefixes and the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.strings = blob[4 + size :]

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place the length of the longest key that begins there and ends by stop (0: none) and its value.

        All places walk the double array together, a byte a step; most leave it at the first.
        """
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not len(self.units):
            return length, value

        def offset(unit):
            return unit >> 10 << ((unit & 512) >> 6)

        alive, depth = np.arange(len(at)), 0
        node = np.full(len(at), offset(self.units[0]))
        while len(alive):
            inside = at[alive] + depth < stop[alive]
            alive, node = alive[inside], node[inside]
            byte = data[at[alive] + depth].astype(np.int64)
            node = node ^ byte
            known = node < len(self.units)
            unit = self.units[np.where(known, node, 0)]
            known &= unit & (1 << 31 | 255) == byte
            alive, node, unit = alive[known], node[known], unit[known]
            node = node ^ offset(unit)
            depth += 1
            leaf = unit >> 8 & 1 == 1
            length[alive[leaf]] = depth
            value[alive[leaf]] = self.units[node[leaf]] & (1 << 31) - 1
        return length, value

    def replacement(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(0, value)]


class Piece(NamedTuple):
    """A stretch of a text that is encoded at once; first and last tell whether it begins and ends the text."""

    data: bytes
    first: bool = True
    last: bool = True


class Normalised(NamedTuple):
    """Normalised stretches one after the other: bytes, where each comes from in its stretch, and the stretches' bounds.

    A word mark takes one byte, the blank's. ends: where in the source each stretch's last byte ends.
    """

    data: np.ndarray
    source: np.ndarray
    bounds: np.ndarray
    ends: np.ndarray


class Encoded(NamedTuple):
    """The ids of a text, with begin and end, and the bytes begin:end of the text that each stands for."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def invalid_bytes(data: bytes) -> list[int]:
    """Where a byte stands that no well-formed character has, in order."""
    places: list[int] = []

    def note(error):
        places.append(error.start)
        return "�", error.start + 1

    codecs.register_error("quern-note", note)
    data.decode("utf-8", "quern-note")
    return places


class PieceTokenizer(WordTokenizer):
    """Encodes texts as a sentence piece model does, through a bounded hash table of words and their pieces.

    A text is normalised first: from left to right the longest key of the model's character map is
    replaced, blanks become word marks, and each byte of the result keeps its source. No piece goes on
    from a letter to a word mark, so that words (marks and what follows them) have pieces of their own
    each; the model cuts every word once, without normalising it again. Pieces get their bytes of the
    text through the sources. Models with pieces across words take a text as one word.
    """

    def __init__(self, path: str, most_units: int = 2_000_000):
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        fields = list(message_fields(proto))
        rules = dict(message_fields(next((v for k, v in fields if k == 3), b"")))
        trainer = dict(message_fields(next((v for k, v in fields if k == 2), b"")))
        if trainer.get(24) or not rules.get(5, 1):
            raise ValueError("word marks must stand before words and be written out")
        pieces = [dict(message_fields(v)) for k, v in fields if k == 1]
        kinds = self.kinds = np.array([p.get(3, 1) for p in pieces])
        if (kinds == CHOSEN).any():
            raise ValueError("pieces that are kept apart before normalisation aren't known here")
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        plain = b"".join(_bytes_field(k, v) for k, v in fields if k in (1, 2)) + _bytes_field(3, b"\x0a\x08identity\x18\x00\x20\x00\x28\x00")
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=plain)
        self.begin, self.end = self.cutter.bos_id(), self.cutter.eos_id()
        texts = [p[1] for p in pieces]
        self.apart = not any(re.search(b"[^\x20] ", t.replace(MARK, b" ")) for t in texts)
        shown = {UNKNOWN: lambda _: trainer.get(44, b" \xe2\x81\x87 "), CONTROL: lambda _: b"", BYTE: lambda t: bytes([int(t[3:5], 16)])}
        shown = [shown[k](t) if k in shown else t.replace(MARK, b" ") for k, t in zip(kinds.tolist(), texts)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(t) for t in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        #: Pieces whose place in a word doesn't follow from their own length.
        self.odd = (kinds == UNKNOWN) | (kinds == BYTE)
        self.most_units = most_units
        self.slots = 1 << max(12, (2 * most_units - 1).bit_length())
        self._reset()

    def _reset(self) -> None:
        super()._reset()
        self.ids = np.zeros(1 << 16, np.uint64)  # the id, and above it the bytes of the word it takes

    # ------------------------------------------------------------ normalisation

    def normalised(self, group: list[Piece]) -> Normalised:
        sizes = np.array([len(p.data) for p in group], np.int64)
        mark = np.array([self.dummy and p.first and len(p.data) > 0 for p in group], np.int64)
        data = np.frombuffer(b"".join(b" " + p.data if m else p.data for p, m in zip(group, mark.tolist())), np.uint8)
        bounds = raw_bounds = np.concatenate([[0], np.cumsum(sizes + mark)])
        source = np.arange(len(data)) - np.repeat(bounds[:-1] + mark, sizes + mark)
        source[bounds[:-1][mark > 0]] = 0
        edits = self._edits(group, data, bounds, mark)
        if edits:
            taken = np.ones(len(data), np.int64)
            for begin, end, new in edits:
                taken[begin:end] = 0
                taken[begin] = len(new)
            at = np.concatenate([[0], np.cumsum(taken)])
            data, source = np.repeat(data, taken), np.repeat(source, taken)
            for begin, _, new in edits:
                data[at[begin] : at[begin] + len(new)] = np.frombuffer(new, np.uint8)
            # marks of the pieces' beginnings stay apart from blanks of the text
            bounds = at[bounds]
        ends = sizes.copy()
        if self.squeeze:  # a mark put first stands after the blanks that are dropped, or before what the map deletes among them
            deleted = np.array(sorted(begin for begin, _, new in edits if not new), np.int64)
            solid = np.flatnonzero(data != 32)
            for i in np.flatnonzero(mark).tolist():
                a, b, base = int(bounds[i]), int(bounds[i + 1]), int(raw_bounds[i]) + 1
                k, gone = np.searchsorted(solid, a), np.searchsorted(deleted, base)
                after = int(source[solid[k]]) if k < len(solid) and solid[k] < b else int(sizes[i])
                source[a] = min(after, int(deleted[gone]) - base if gone < len(deleted) else after)
        inner = np.repeat(np.arange(len(group)), np.diff(bounds))
        if self.squeeze:
            blank = data == 32
            before = np.concatenate([[False], blank[:-1]])
            opening = bounds[:-1][np.diff(bounds) > 0]
            before[opening] = np.array([p.first for p in group])[np.diff(bounds) > 0]
            keep = ~(blank & before)
            dummies = bounds[:-1][(mark > 0)]
            keep[dummies] = True
            data, source, inner = data[keep], source[keep], inner[keep]
        data, source, inner = self._one_byte_marks(data, source, inner)
        bounds = np.searchsorted(inner, np.arange(len(group) + 1))
        if self.squeeze:
            keep = np.ones(len(data), bool)
            for i, p in enumerate(group):
                stop = bounds[i + 1]
                while p.last and stop > bounds[i] and data[stop - 1] == 32:
                    stop -= 1
                    keep[stop] = False
                    ends[i] = source[stop]
            data, source, inner = data[keep], source[keep], inner[keep]
            bounds = np.searchsorted(inner, np.arange(len(group) + 1))
        return Normalised(data, source, bounds, ends)

    def _edits(self, group: list[Piece], data: np.ndarray, bounds: np.ndarray, mark: np.ndarray) -> list[tuple[int, int, bytes]]:
        """What the character map replaces, from left to right without overlap, and malformed bytes."""
        wrong: dict[int, bytes] = {}
        try:
            data.tobytes().decode()
            if any(len(p.data) and p.data[0] & 0xC0 == 0x80 for p in group):
                raise ValueError
        except ValueError:
            for i, p in enumerate(group):
                wrong.update((int(bounds[i] + mark[i]) + x, "�".encode()) for x in invalid_bytes(p.data))
        edits = [(x, x + 1, new) for x, new in wrong.items()]
        if len(self.map.units):
            begins = (data & 0xC0) != 0x80
            begins[bounds[:-1][mark > 0]] = False
            begins[list(wrong)] = False
            at = np.flatnonzero(begins)
            stop = np.repeat(bounds[1:], np.diff(bounds))[at]
            length, value = self.map.longest(data, at, stop)
            done = 0
            for i in np.flatnonzero(length):
                begin = int(at[i])
                if begin >= done:
                    done = begin + int(length[i])
                    edits.append((begin, done, self.map.replacement(int(value[i]))))
            edits.sort()
        return edits

    @staticmethod
    def _one_byte_marks(data: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word marks written out in the text as the one byte that stands for them here."""
        if len(data) < 3:
            return data, *others
        written_out = np.flatnonzero((data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2]))
        if not len(written_out):
            return data, *others
        data, keep = data.copy(), np.ones(len(data), bool)
        data[written_out] = 32
        keep[written_out + 1] = keep[written_out + 2] = False
        return data[keep], *(x[keep] for x in others)

    # ------------------------------------------------------------ pieces

    def _cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with the bytes of its word above it, and how many each word has."""
        texts = [w.replace(b" ", MARK).decode() for w in words]
        cut = self.cutter.encode(texts)
        sizes = np.array([len(x) for x in cut], np.int64)
        ids = np.array([i for x in cut for i in x], np.int64)
        width = self.shown_size[ids]
        of = np.repeat(np.arange(len(words)), sizes)
        first = np.cumsum(sizes) - sizes
        for k in np.unique(of[self.odd[ids]]).tolist():
            spans = self.cutter.encode(texts[k], return_type="proto").pieces
            raw = texts[k].encode()
            width[first[k] : first[k] + sizes[k]] = [x.end - x.begin - 2 * raw.count(MARK, x.begin, x.end) for x in spans]
        return ids.astype(np.uint64) | width.astype(np.uint64) << np.uint64(32), sizes

    def _stretches(self, group: list[Piece]) -> list[Encoded]:
        text = self.normalised(group)
        data, n = text.data, len(text.data)
        opening = text.bounds[:-1][np.diff(text.bounds) > 0]
        start = np.zeros(n, bool)
        if self.apart and n:
            blank = data == 32
            start[1:] = blank[1:] & ~blank[:-1]
        start[opening] = True
        starts = np.flatnonzero(start)
        stops = np.append(starts[1:], n)
        if n == 0:
            none = np.zeros(0, np.int64)
            return [Encoded(none.astype("<u4"), none, none) for _ in group]
        power, inverse = _power_tables(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        h = mix((total[stops] - total[starts]) * inverse[starts]) | np.uint64(1)
        unit = self._find(h)
        if (unit < 0).any():
            new, where = np.unique(h[unit < 0], return_index=True)
            where = np.flatnonzero(unit < 0)[where]
            if self.count + len(new) > self.most_units:
                self._reset()
                new, where = np.unique(h, return_index=True)
            raw = data.tobytes()
            self._insert(new, *self._cut([raw[a:b] for a, b in zip(starts[where].tolist(), stops[where].tolist())]))
            unit = self._find(h)
        size = self.size[unit]
        last = np.cumsum(size)
        both = self.ids[np.repeat(self.first[unit] - last + size, size) + np.arange(int(last[-1]))]
        ids, width = (both & np.uint64(0xFFFFFFFF)).astype("<u4"), (both >> np.uint64(32)).astype(np.int64)
        stop = np.cumsum(width)
        cuts = np.concatenate([[0], last])[np.searchsorted(starts, text.bounds)]
        begins, ends = text.source[np.minimum(stop - width, n - 1)], text.source[np.minimum(stop, n - 1)]
        some = np.flatnonzero(np.diff(cuts) > 0)
        ends[cuts[some + 1] - 1] = text.ends[some]
        return [Encoded(ids[a:b], begins[a:b], ends[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, docs: list[bytes], limit: int = 1 << 20) -> list[Encoded]:
        """Ids and source bytes of each text (UTF-8), with the ids that begin and end it.

        Texts are taken in groups of about limit bytes; a longer one in stretches that end before a
        blank between two ASCII letters, where no key of the map and no piece goes on.
        """
        out: list[Encoded] = []
        group: list[Piece] = []
        whole: list[list[Encoded]] = []
        places: list[tuple[int, int]] = []

        def flush() -> None:
            for (doc, base), x in zip(places, self._stretches(group)):
                whole[doc].append(Encoded(x.ids, x.begins + base, x.ends + base))
            group.clear()
            places.clear()

        held = 0
        for i, d in enumerate(docs):
            whole.append([])
            at = 0
            while True:
                stop = len(d)
                if stop - at > limit:
                    found = re.compile(rb"[a-z] (?=[a-z])").search(d, at + limit)
                    stop = found.start() + 1 if found else stop
                if held and held + stop - at > limit:
                    flush()
                    held = 0
                group.append(Piece(d[at:stop], at == 0, stop == len(d)))
                places.append((i, at))
                held += stop - at + 1
                at = stop
                if at == len(d):
                    break
        flush()
        for d, parts in zip(docs, whole):
            ids = np.concatenate([[self.begin], *(x.ids for x in parts), [self.end]]).astype("<u4")
            begins, ends = (np.concatenate([[0], *(x[k] for x in parts), [len(d)]]).astype("<i8") for k in (1, 2))
            ends[0] = 0
            out.append(Encoded(ids, begins, ends))
        return out

    # ------------------------------------------------------------ back to text

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """The text of each row of ids: pieces one after the other, marks as blanks, without the mark put first."""
        if not texts:
            return []
        ids = np.concatenate(texts).astype(np.int64)
        size = self.shown_size[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        flat = self.shown[np.repeat(self.shown_at[ids] - stop + size, size) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], stop])[np.cumsum([0, *map(len, texts)])].tolist()
        out = []
        for row, a, b in zip(texts, cuts[:-1], cuts[1:]):
            data = flat[a:b]
            if not data.isascii():
                try:
                    data.decode()
                    apart = (self.kinds[row[1:-1]] == CONTROL).any()
                except ValueError:
                    apart = True
                data = self._mended(row) if apart else data
            out.append(data[self._opening(row) :])
        return out

    def _opening(self, row: np.ndarray) -> int:
        """Bytes of blanks that stand for the mark put before a text."""
        dropped = 0
        for i in row if self.dummy or self.squeeze else ():
            if self.kinds[i] == CONTROL:
                continue
            blank = self.kinds[i] not in (BYTE, UNKNOWN) and self.shown[self.shown_at[i]] == 32
            dropped += int(blank)
            if not (blank and self.squeeze and self.shown_size[i] == 1):
                break
        return dropped

    def _mended(self, row: np.ndarray) -> bytes:
        """The bytes of ids, those that make up no characters with their neighbours among single bytes as U+FFFD each."""
        out, run = [], bytearray()
        for i in [*row.tolist(), -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                run.append(self.shown[self.shown_at[i]])
                continue
            wrong, data = set(invalid_bytes(bytes(run))), bytes(run)
            out += ["�".encode() if k in wrong else data[k : k + 1] for k in range(len(data))]
            run.clear()
            if i >= 0:
                out.append(self.shown[self.shown_at[i] : self.shown_at[i] + self.shown_size[i]].tobytes())
        return b"".join(out)


def piece_tokenizer(path: str, most_units: int = 2_000_000) -> PieceTokenizer:
    """One tokenizer a worker process."""
    key = (path, most_units)
    if key not in _loaded:
        _loaded[key] = PieceTokenizer(path, most_units)
    return _loaded[key]


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Columns that can be asked for: type and value of a text's pieces (x) and its tokenizer (t).
COLUMNS = {
    "ids": ("array<int>", lambda t, x: x.ids.astype(np.int32)),
    "begins": ("array<long>", lambda t, x: x.begins),
    "ends": ("array<long>", lambda t, x: x.ends),
    "n_tokens": ("long", lambda t, x: len(x.ids)),
    "ids_sha256": ("string", lambda t, x: _sha256(x.ids.tobytes())),
    "spans_crc32": ("long", lambda t, x: zlib.crc32(x.ends.tobytes(), zlib.crc32(x.begins.tobytes()))),
    "decoded": ("string", lambda t, x: t.decode([x.ids])[0].decode()),
    "decoded_sha256": ("string", lambda t, x: _sha256(t.decode([x.ids])[0])),
}


def encode_pieces(docs: DataFrame, want: tuple[str, ...] = ("ids", "begins", "ends"), model: str | None = None) -> DataFrame:
    """doc_id and the wanted columns (see COLUMNS) of each row: the ids of its text, and the bytes begins[i]:ends[i] each stands for.

    The ids are those of the sentencepiece library for the model, with begin and end ids and without
    sampling; spans are those of its offsets, the begin id's 0:0, the end id's from the text's end to
    its end. A null or empty text has the begin and end ids alone. Repeated rows are texts of their own,
    doc_id may be null and of any type, other columns are left out, an empty table gives an empty one.
    A task holds an Arrow batch, and of a long text a stretch of 1 MB beside the text and its ids.
    """
    path = model or default_model()

    def run(batches):
        import pyarrow as pa

        tokenizer = piece_tokenizer(path)
        for batch in batches:
            rows = tokenizer.encode(text_bytes(batch.column(1)))
            arrays = [batch.column(0)]
            for name in want:
                kind = COLUMNS[name][0]
                values = [COLUMNS[name][1](tokenizer, x) for x in rows]
                arrays.append(pa.array(values, {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[kind]))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *want])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text()).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{name} {COLUMNS[name][0]}" for name in want))


def decode_pieces(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of ids (columns doc_id, ids): what the library's decode gives; null ids give null."""
    path = model or default_model()

    def run(batches):
        import pyarrow as pa

        tokenizer = piece_tokenizer(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = [None if x is None else tokenizer.decode([np.array(x, np.int64)])[0].decode() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text they decode to, and a checksum of the spans."""
    return written(encode_pieces(docs, ("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"), model), "piece_digests", 500)
