"""Files by byte ranges against whole files, and a tree of a file against the kernel's."""

import codecs
import json
import random

import pytest
from pyspark.sql import functions as F

from textrine.operators import large, trees
from textrine.sources import files, text

ENCODINGS = ["UTF-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "cp1250", "gb18030", "shift_jis", "euc_kr", "iso2022_jp", "utf-7"]


def sample(encoding, n, seed):
    r = random.Random(seed)
    letters = "ab z\n\r\U0001f600\U00010437ਊ਀žé日本語가"
    letters = "".join(c for c in letters if encodable(c, encoding))
    return "".join(r.choice(letters) for _ in range(n))


def encodable(c, encoding):
    try:
        return c.encode(encoding).decode(encoding) == c
    except UnicodeError:
        return False


def joined(pieces):
    """Each file's text, its pieces checked to follow each other."""
    out = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_id, r.seq)):
        have = out.get(r.doc_id, "")
        assert r.begin == len(have)
        out[r.doc_id] = have + r.piece
    return out


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_ranges_of_any_size(encoding):
    """Every split of the bytes gives the text, in ranges that do not overlap."""
    import tempfile

    for n in (0, 1, 2, 60):
        t = sample(encoding, n, n)
        with tempfile.NamedTemporaryFile(suffix=".txt") as f:
            f.write(t.encode(encoding))
            f.flush()
            for split in (1, 2, 3, 5, 8, 64, 1000):
                for piece in (1, 7, 1000):
                    reader = files.PieceReader({"path": f.name, "encoding": encoding, "split": str(split), "piece": str(piece)})
                    rows = [r for p in reader.partitions() for r in reader.read(p)]
                    assert "".join(r[3] for r in rows) == t, (encoding, split, piece)
                    assert len({r[:3] for r in rows}) == len(rows) and rows == sorted(rows, key=lambda r: r[1:3])


@pytest.mark.parametrize("encoding, raw", [("utf-8", "aé".encode()[:-1]), ("utf-16-le", b"a\x00b"), ("gb18030", "a\n日".encode("gb18030")[:-1]), ("utf-8", b"a\xffb")])
def test_incomplete_and_malformed_bytes(tmp_path, encoding, raw):
    (tmp_path / "x.txt").write_bytes(raw)
    for split in (1, 2, 1000):
        reader = files.PieceReader({"path": str(tmp_path), "encoding": encoding, "split": str(split)})
        with pytest.raises(UnicodeDecodeError):
            [r for p in reader.partitions() for r in reader.read(p)]


@pytest.mark.parametrize("encoding", ["UTF-8", "utf-16", "gb18030"])
def test_equals_whole_files(spark, tmp_path, encoding):
    for k, n in enumerate((0, 3, 500, 2000)):
        (tmp_path / f"{k}.txt").write_bytes(sample(encoding, n, k).encode(encoding))
    want = {r.doc_id: r.text for r in text.read_texts(spark, str(tmp_path), encoding).collect()}
    for split, size in ((700, 50), (2000, 7), (10**6, 10**6)):
        found = joined(files.file_pieces(spark, str(tmp_path), encoding, size, split))
        assert len(found) == 4 and {k: t for k, t in found.items() if t} == {k: t for k, t in want.items() if t}


def test_kinds():
    kinds = {"byte": "ascii latin-1 cp1250 cp437 koi8-r mac-roman", "line": "sjis gbk gb18030 big5 euc_jp euc_kr johab", "whole": "iso2022_jp iso2022_kr hz utf-7", "utf-16": "utf-16 utf-16-be", "utf-32": "utf-32-le", "utf-8": "utf8 utf-8-sig"}
    for kind, names in kinds.items():
        assert {n: files.kind_of(n) for n in names.split()} == dict.fromkeys(names.split(), kind)
    for n in kinds["line"].split():  # a line feed is never a part of another character
        assert b"\n" not in "".join(map(chr, [*range(11, 0xD800), *range(0xE000, 0x20000)])).encode(n, "ignore")


def test_written_files_reread(spark, tmp_path):
    rows = [(k, sample("gb18030", k * 7, k)) for k in range(50)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for encoding in ("gb18030", "utf-16-be", "UTF-8"):
        path = str(tmp_path / encoding)
        files.write_texts(df, path, encoding, "\x01\n")
        files.write_texts(df.limit(0), path, encoding)
        found = joined(files.file_pieces(spark, path, encoding, 100, 1000))
        texts = sorted(t for x in found.values() for t in x.split("\x01\n")[:-1])
        assert texts == sorted(t for _, t in rows if t is not None)
    with pytest.raises(Exception):
        files.write_texts(df, str(tmp_path / "ascii"), "ascii")
    assert not list((tmp_path / "ascii").rglob("*.txt"))
    with pytest.raises(Exception):
        files.read_pieces(spark, str(tmp_path / "none")).collect()


def test_tree_of_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(sample("gb18030", 900, 5).encode("gb18030"))
    index = large.Index(files.file_pieces(spark, str(tmp_path), "gb18030", 100, 400), span=300, rows=300)
    whole = text.read_texts(spark, str(tmp_path), "gb18030").select("doc_id", "text")
    columns = ["doc_id", "ord", "parent", "child", "parent_depth", "child_depth", "start"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*[F.col(c).cast("long") for c in columns]).collect())
    got = rows(index.edges())
    index.scratch.drop()
    assert got == rows(trees.edges(whole, labels=False)) and got


def test_letters_are_counted_where_pieces_lie(spark):
    """A row for each key and letter of a task, not for each character; letters beyond the basic plane are one."""
    from textrine.sources import text

    df = spark.createDataFrame([("x", "aab\U0001f600" * 500), ("y", "é\n"), ("x", ""), ("y", None)], "encoding string, piece string").coalesce(1)
    got = sorted(map(tuple, text.letter_counts(df).collect()))
    assert got == [("x", "a", 1000), ("x", "b", 500), ("x", "\U0001f600", 500), ("y", "\n", 1), ("y", "é", 1)]


@pytest.mark.parametrize("encoding", ["UTF-8", "utf-16", "gb18030", "utf-7"])
def test_pieces_need_no_copy_of_the_text(spark, tmp_path, monkeypatch, encoding):
    """Each range reads the pieces that begin in it to their end: no other table is written, and no text is shuffled."""
    monkeypatch.setattr("textrine.sources.scratch.LOCAL_FOLDER", f"{tmp_path}/scratch")
    t = sample(encoding, 700, 9)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(t.encode(encoding))
    want = lambda size: [(k * size, t[k * size : (k + 1) * size]) for k in range(-(-len(t) // size))]
    options = {"path": str(tmp_path / "in"), "encoding": encoding}
    for split in (1, 3, 64, 1000):
        reader = files.PieceReader({**options, "split": str(split)})
        counts, starts = 0, []
        for r in (r for p in reader.partitions() for r in reader.read(p)):
            starts.append((r[1], counts))
            counts += len(r[3])
        for size in (1, 7, 100, 10**6):
            reader = files.PieceReader({**options, "split": str(split), "piece": str(size), "starts": json.dumps({f"file:{tmp_path}/in/a.txt": starts})})
            assert [(r[4], r[3]) for p in reader.partitions() for r in reader.read(p)] == want(size)
    pieces = files.file_pieces(spark, str(tmp_path / "in"), encoding, 50, 400)
    assert sorted(map(tuple, pieces.select("seq", "begin", "piece").collect())) == [(k, *x) for k, x in enumerate(want(50))]
    assert "Exchange" not in pieces._jdf.queryExecution().executedPlan().toString()
    assert not (tmp_path / "scratch").exists()


def test_one_slice_in_one_encoding_is_on_disk(spark, tmp_path, monkeypatch):
    """Files go as soon as they are counted, and any number of slices gives the same counts."""
    from textrine import queries

    rows = [(k, sample("gb18030", k * 3, k)) for k in range(40)] + [(None, "ab"), (None, "ab"), (40, None), (41, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("textrine.sources.scratch.LOCAL_FOLDER", f"{tmp_path}/scratch")
    there, write, found = [], files.write_texts, []

    def watched(*args):
        there.append([p for p in (tmp_path / "scratch").rglob("*.txt")])
        write(*args)

    monkeypatch.setattr(files, "write_texts", watched)
    for some in (1, 3):
        monkeypatch.setattr(queries, "SLICE", 1)
        monkeypatch.setattr(queries, "SLICES", some)
        found.append(sorted(map(tuple, queries.QUERIES["encoded_files"](spark, str(tmp_path)).collect())))
    letters = "".join(t + "\n" for _, t in rows if t is not None)
    want = sorted((e, c, letters.count(c), len(letters)) for e in queries.ENCODINGS for c in set(letters))
    assert found == [want, want]
    assert len(there) == 16 and not any(there) and not list((tmp_path / "scratch").rglob("*.txt"))
