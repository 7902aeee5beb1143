"""Sentence pieces against the library: ids, spans, texts, and normalisation by real compiled maps."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quern.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "▁", "▁▁ a", "a▁b", " ▁ ▁", "漢字𐍈\x00x", "\t\n a\n\n b", "é" * 50, "x" * 5000, "<s> </s> <unk> <0x0A>", "a  b   c    ", "⁇ ⁇", "�",
    "ｱﾞ  １ ①", "ﬁ ﬃ ℌ  　x", "é à́ 각", "​‌ x", "ＡＢＣ  İ ß",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(letters, n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("limit", [40, 1 << 20])
def test_ids_spans_and_texts_are_the_librarys(library, limit):
    """limit 40: texts are encoded in stretches."""
    mine = pieces.PieceTokenizer(PATH, most_units=1000)
    texts = [*ODD, *random_texts("ab \n▁é漢𐍈.,'́Ａ1 ", 500), "some words and more of them " * 40]
    for text, x in zip(texts, mine.encode([t.encode() for t in texts], limit)):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert x.ids.tolist() == ids
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(x.begins.tolist(), x.ends.tolist())) == [(0, 0), *spans, (len(text.encode()),) * 2]
        assert mine.decode([x.ids])[0].decode() == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library):
    mine, draw = pieces.PieceTokenizer(PATH), random.Random(2)
    for _ in range(1000):
        ids = [draw.choice([1, 2, 259, 28705, draw.randrange(3, 259), draw.randrange(32000), 0]) for _ in range(draw.randrange(12))]
        assert mine.decode([np.array(ids, np.int64)])[0].decode() == library.decode(ids)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_normalisation_by_compiled_maps(rule, squeeze, dummy):
    """The library's own maps: same text, and the same source of every character."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    rules = dict(pieces.message_fields(next(v for k, v in pieces.message_fields(library.serialized_model_proto()) if k == 3)))
    mine = pieces.PieceTokenizer(PATH, most_units=1000)
    mine.map, mine.dummy, mine.squeeze = pieces.CharacterMap(rules.get(2, b"")), dummy, squeeze
    for text in [*ODD, *random_texts("ｱﾞ１① 　 é̀ﬁ​\t\nB▁ ", 300)]:
        raw = text.encode()
        got, (expected, offsets) = mine.normalised([pieces.Piece(raw)]), library.normalize(text, with_offsets=True)
        assert got.data.tobytes().replace(b" ", pieces.MARK).decode() == expected
        if expected:
            begins = [int(at) for at, byte in zip(got.source, got.data) if byte & 0xC0 != 0x80]
            assert [len(raw[:at].decode("utf-8", "ignore")) for at in [*begins, int(got.ends[0])]] == offsets


def test_groups_of_texts_are_normalised_as_each_alone():
    mine = pieces.PieceTokenizer(PATH, most_units=1000)
    mine.squeeze = True
    texts = [t.encode() for t in ODD]
    together = mine.normalised([pieces.Piece(t) for t in texts])
    for i, t in enumerate(texts):
        alone, cut = mine.normalised([pieces.Piece(t)]), slice(together.bounds[i], together.bounds[i + 1])
        assert together.data[cut].tolist() == alone.data.tolist() and together.source[cut].tolist() == alone.source.tolist()


def test_malformed_bytes():
    mine = pieces.PieceTokenizer(PATH, most_units=1000)
    assert pieces.invalid_bytes(b"a\xffb\xe6\xbc") == [1, 3, 4]
    (x,) = mine.encode([b"a\xffb"])
    assert mine.decode([x.ids])[0].decode() == "a�b"
    assert x.ends.max() == 3


def test_operator_and_query(spark, library):
    """Nulls, repeats, no doc_id, an empty table; arrays of ids and spans, and back."""
    rows = [(1, "Hello  wörld"), (2, None), (2, None), (None, "tie"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS ids", "1 AS n_tokens")
    out = pieces.encode_pieces(docs)
    got = sorted(((r.doc_id, list(r.ids)) for r in out.collect()), key=str)
    assert got == sorted(((i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows), key=str)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode_pieces(out).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in rows), key=str)
    assert pieces.piece_digests(docs.where("doc_id > 9")).count() == 0

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pieces.piece_digests(docs).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
