"""BPE encoding and decoding with a contiguous rank array.

Per short word the encoder holds two parallel arrays: the symbols between part
boundaries, and for each adjacent pair the rank of its merge. It repeatedly
scans for the smallest rank (leftmost first), deletes that boundary and
refreshes the two neighbouring ranks. Words of more than ``SHORT_WORD``
symbols hold the same state in a linked list with a heap, so that a megabyte
without white space stays n log n.

Results equal those of the public ``tokenizers`` library for byte-level BPE
files without a normaliser: added tokens are cut out first, the rest is split
by the byte-level pattern, and each piece is merged by rank.

Defined results: null and empty texts have no tokens; any text length works
(pieces are encoded in blocks, hashes are updated as they come); repeated rows
and extra columns have no influence; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT_WORD = 96
NEVER = 1 << 60

#: Words whose tokens a worker remembers, and the longest that is remembered.
CACHE_WORDS, CACHE_BYTES = 150_000, 96

#: Pieces that are encoded at once.
BLOCK = 200_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others are numbered
    from U+0100 on, in byte order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return out


#: Code points (hexadecimal) that ``regex`` 2026.9 takes for letters, and for digits, by a later version of
#: Unicode than the tokenizers library has. A test recomputes them with the library.
LATER_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3
16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
LATER_DIGITS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def characters(ranges: str) -> str:
    """The characters of some ranges of code points."""
    ends = [x.partition("-") for x in ranges.split()]
    return "".join(chr(c) for a, _, b in ends for c in range(int(a, 16), int(b or a, 16) + 1))


def piece_pattern(no_letters: str = "", no_digits: str = ""):
    """The byte-level splitting pattern: contractions, letters, digits, other, spaces."""
    import regex

    letter = rf"[\p{{L}}--[{regex.escape(no_letters)}]]" if no_letters else r"\p{L}"
    digit = rf"[\p{{N}}--[{regex.escape(no_digits)}]]" if no_digits else r"\p{N}"
    other = r"[^\s\p{L}\p{N}]"
    if no_letters or no_digits:
        other = rf"[[{regex.escape(no_letters + no_digits)}]||{other}]"
    return regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?{letter}+| ?{digit}+| ?{other}+|\s+(?!\S)|\s+", regex.V1)


class Codec:
    """Encoder and decoder for one byte-level BPE file, given as its parsed JSON."""

    def __init__(self, spec: dict, no_letters: str = "", no_digits: str = ""):
        import regex

        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in alphabet.items()}
        vocab = spec["model"]["vocab"]
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.pieces |= {i: text.encode() for text, i in self.added.items()}
        self.plain, self.exact = piece_pattern(), None
        self.exceptions = frozenset(no_letters + no_digits)
        self.classes = no_letters, no_digits
        self.may_differ = re.compile(rf"[{min(self.exceptions)}-\U0010ffff]") if self.exceptions else None
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words: dict[str, tuple[int, ...]] = {}

    def pattern_for(self, text: str):
        """The plain pattern, or the one with the exceptions if the text has any."""
        if not self.may_differ or not self.may_differ.search(text) or self.exceptions.isdisjoint(text):
            return self.plain
        if self.exact is None:
            self.exact = piece_pattern(*self.classes)
        return self.exact

    def merge_short(self, ids: list[int]) -> list[int]:
        """The contiguous rank array: scan for the least rank, delete, refresh."""
        merge = self.merge.get
        none = (NEVER, -1)
        pairs = [merge(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best[0] == NEVER:
                break
            i = pairs.index(best)
            ids[i] = best[1]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merge((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = merge((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order by a heap over a linked list."""
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        live = [True] * n
        merge = self.merge.get
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merge((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [t for t, ok in zip(ids, live) if ok]

    def word(self, piece: str) -> tuple[int, ...]:
        if found := self.words.get(piece):
            return found
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.byte_id[b] for b in raw]
        out = tuple(self.merge_short(ids) if len(ids) <= SHORT_WORD else self.merge_long(ids))
        if len(raw) <= CACHE_BYTES:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[piece] = out
        return out

    def blocks(self, text: str):
        """Lists of token ids that make up the encoding of a text, in order."""
        parts = self.added_pattern.split(text) if self.added_pattern and any(a in text for a in self.added) else (text,)
        for part in parts:
            if part in self.added:
                yield [self.added[part]]
            elif len(part) < 4 * BLOCK:
                yield list(chain.from_iterable(map(self.word, self.pattern_for(part).findall(part))))
            else:
                found = (m[0] for m in self.pattern_for(part).finditer(part))
                while some := list(islice(found, BLOCK)):
                    yield list(chain.from_iterable(map(self.word, some)))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.blocks(text or "")))

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def broadcast_codec(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast: its size is that of the file (1.6 MB),
    whatever the input's. Only the driver reads the path."""
    spec = load_spec(path)
    small = {"added_tokens": spec["added_tokens"], "model": {k: spec["model"][k] for k in ("vocab", "merges")}}
    return uuid.uuid4().hex, spark.sparkContext.broadcast((small, characters(LATER_LETTERS), characters(LATER_DIGITS)))


_codecs: dict[str, Codec] = {}


def worker_codec(shared) -> Codec:
    """One codec per Python worker, kept between tasks."""
    token, content = shared
    if token not in _codecs:
        _codecs.clear()
        _codecs[token] = Codec(*content.value)
    return _codecs[token]


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with an array of token ids of ``text``; all columns stay."""
    shared = broadcast_codec(df.sparkSession, path)

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        codec = worker_codec(shared)
        return s.map(codec.encode)

    return df.withColumn(out, encode(F.coalesce(F.col(text), F.lit(""))))


def decode_column(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of an array of token ids."""
    shared = broadcast_codec(df.sparkSession, path)

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        codec = worker_codec(shared)
        return s.map(lambda x: None if x is None else codec.decode(map(int, x)))

    return df.withColumn(out, decode(F.col(ids)))


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    One pass without a shuffle. Each block of pieces is encoded, hashed,
    decoded from its ids and hashed again, so that memory is bounded by a
    block (plus the text) and not by the number of tokens.
    """
    import pyarrow as pa

    shared = broadcast_codec(df.sparkSession, path)

    def digest(batches):
        codec = worker_codec(shared)
        name = [str(i) for i in range(max(codec.pieces) + 1)]
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for text in map(lambda t: t.as_py(), batch.column(1)):
                count, of_ids, of_text, tail = 0, hashlib.sha256(), hashlib.sha256(), b""
                for ids in codec.blocks(text or ""):
                    if not ids:
                        continue
                    of_ids.update((("," if count else "") + ",".join(map(name.__getitem__, ids))).encode())
                    count += len(ids)
                    raw = tail + b"".join(map(codec.pieces.__getitem__, ids))
                    cut = whole_characters(raw)
                    of_text.update(raw[:cut].decode("utf-8", "replace").encode())
                    tail = raw[cut:]
                of_text.update(tail.decode("utf-8", "replace").encode())
                n_tokens.append(count)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.words.clear()  # the worker may do other things next

    return df.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(digest, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def whole_characters(raw: bytes) -> int:
    """Length of ``raw`` without a last character that is not complete yet."""
    n = len(raw)
    for back in range(1, min(4, n) + 1):
        b = raw[n - back]
        if b >= 0xC0:
            need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return n - back if need > back else n
        if b < 0x80:
            break
    return n
