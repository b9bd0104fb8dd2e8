import hashlib
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer

from textrine.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", "a", "  \n\n  a  b \t", "Hello world's été it'll x'dd '", "a" * 3000, " " * 400, "<|endoftext|>", "x <|endoftext|> y<|endoftext|>",
    "日本語" * 80, "\U0001f600\U00031350՘ 1ՙ", "é" * 300 + "!" * 200, "12 345  6\n7", "\x00\x1c\x85 ",
]


def test_equal_to_the_library(spark):
    library = Tokenizer.from_file(PATH)
    schema = "doc_id long, text string, n_tokens string"  # an extra column with a clashing name
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, schema)
    got = bpe.encode_digests(df, PATH).collect()
    assert len(got) == 2 * len(TEXTS)
    for row in got:
        ids = library.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_later_letters_and_digits():
    """Only characters on which two versions of Unicode disagree, or that are unassigned, can be split otherwise by the library."""
    import regex

    split = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern, lead, listed in (("L", r"\p{L}", "a", bpe.LATER_LETTERS), ("N", r"\p{N}", "1", bpe.LATER_DIGITS)):
        want = [c for c in regex.findall(pattern, every) if unicodedata.category(c)[0] != kind and len(split(lead + c)) > 1]
        assert bpe.characters(listed) == "".join(want)
        assert all(len(split(lead + c)) == 1 for c in regex.findall(pattern, every)[::97] if c not in want)


def test_columns_and_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = bpe.decode_column(bpe.encode_column(df, PATH), PATH).collect()
    assert all((r.text or "") == r.decoded for r in rows)
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0


def test_long_and_short_merges_agree():
    codec = bpe.Codec(bpe.load_spec(PATH))
    for raw in (b"the thing that", b"aaaaabaaaab" * 9, "hétérogène".encode() * 5, bytes(range(256))):
        ids = [codec.byte_id[b] for b in raw]
        assert codec.merge_short(list(ids)) == codec.merge_long(list(ids))


def test_blocks_cut_long_texts(monkeypatch):
    codec = bpe.Codec(bpe.load_spec(PATH))
    text = "some words, cafés 12  and  more\n" * 40
    whole = codec.encode(text)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    assert codec.encode(text) == whole and codec.decode(whole) == text
