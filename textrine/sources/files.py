"""Text files of any size and encoding, read and written by Spark's Python data sources.

``read_pieces`` reads files by byte ranges. A range begins at the first character that
starts in it, which the encoding tells:

- one byte a character, without states: anywhere;
- UTF-8: after continuation bytes; UTF-16 and UTF-32: at a whole unit that is no second half of a pair;
- East Asian charsets of several bytes: after a line feed, which is never part of a longer character there;
- others have states, and a file is one range.

Ranges are decoded as they are read, some bytes at a time; characters are numbered by
prefix sums over the counts of ranges. Pieces of a fixed number of characters are read by
the range that they begin in, beyond its end, so that no text is shuffled or written again;
files are read once for the counts and then for the pieces, and may not change meanwhile.
No task holds a file.

Defined results: as ``text.read_texts``, byte order marks and malformed bytes included (they
are an error), but that an empty file is one empty piece (Spark's reader of whole files leaves it out); files whose name begins with "_" or "." are
left out. Paths are opened by pyarrow, on every executor.
"""

from __future__ import annotations

import codecs
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a range, bytes that are decoded at once, characters of a piece.
SPLIT, READ, PIECE = 64 << 20, 1 << 20, 1 << 20

#: Codecs (Python's names) whose characters of several bytes never hold a line feed.
LINE_CODECS = ["big5", "big5hkscs", "cp932", "cp949", "cp950", "euc_jis_2004", "euc_jisx0213", "euc_jp", "euc_kr", "gb18030", "gb2312", "gbk", "johab", "shift_jis", "shift_jis_2004", "shift_jisx0213"]


def opened(path: str):
    """(filesystem, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def kind_of(encoding: str) -> str:
    """How the characters of an encoding are found: byte, utf-8, utf-16, utf-32, line or whole."""
    name = codecs.lookup(encoding).name
    if name in ("utf-8", "utf-8-sig"):
        return "utf-8"
    if name.startswith(("utf-16", "utf-32")):
        return name[:6]
    if name in LINE_CODECS:
        return "line"
    every = bytes(range(256))
    one = all(len(codecs.decode(x, name, "replace")) == 256 for x in (every, every[::-1])) and len("日本é".encode(name, "replace")) == 3
    return "byte" if one else "whole"


def named(encoding: str, head: bytes) -> tuple[str, int]:
    """The codec of a file with these first bytes, and how many of them are its byte order mark."""
    name = codecs.lookup(encoding).name
    marks = {
        "utf-8-sig": [(codecs.BOM_UTF8, "utf-8")],
        "utf-16": [(codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")],
        "utf-32": [(codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be")],
    }
    for mark, codec in marks.get(name, []):
        if head.startswith(mark):
            return codec, len(mark)
    # without a mark, big-endian as Unicode and the JVM have it
    return {"utf-8-sig": "utf-8", "utf-16": "utf-16-be", "utf-32": "utf-32-be"}.get(name, name), 0


def character_start(f, at: int, size: int, kind: str, codec: str, stop: int) -> int:
    """The first character's place from byte ``at`` on; at least ``stop`` if that is further (looked for no longer)."""
    if at <= 0 or at >= size or kind == "byte":
        return max(0, min(at, size))
    if kind == "line":
        at -= 1
        while at < min(stop, size):
            f.seek(at)
            some = f.read(READ)
            found = some.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(some)
        return min(at, size)
    width = {"utf-8": 1, "utf-16": 2, "utf-32": 4}[kind]
    at += -at % width
    f.seek(at)
    some = f.read(4)
    if kind == "utf-8":
        while some and 0x80 <= some[0] < 0xC0 and at < size:
            at, some = at + 1, some[1:]
    elif kind == "utf-16" and len(some) > 1 and 0xDC <= some[codec.endswith("le")] < 0xE0:
        at += 2
    return min(at, size)


@dataclass
class Ranges(InputPartition):
    """(path, size, first byte, last byte and one more) of some files, together up to a range's bytes."""

    ranges: list


class PieceReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.encoding = options["path"], options.get("encoding", "UTF-8")
        self.split, self.piece = int(options.get("split", SPLIT)), int(options.get("piece", PIECE))
        # of each path the characters before its ranges, but for those without any
        self.starts = {path: dict(starts) for path, starts in json.loads(options["starts"]).items()} if "starts" in options else None

    def partitions(self):
        from pyarrow import fs

        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        root = path.rstrip("/")
        found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
        hidden = lambda p: any(part[:1] in "_." for part in p[len(root) :].split("/") if part)
        scheme = "file:" if isinstance(system, fs.LocalFileSystem) else self.path.partition("://")[0] + "://"
        whole = kind_of(self.encoding) == "whole"
        out, some, total = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if hidden(x.path):
                continue
            step = max(x.size, 1) if whole else self.split
            for a in range(0, max(x.size, 1), step):
                some.append((scheme + x.path, x.size, a, min(a + step, x.size)))
                total += some[-1][3] - a
                if total >= self.split:
                    out, some, total = [*out, Ranges(some)], [], 0
        return [*out, Ranges(some)] if some or not out else out

    def read(self, partition):
        kind = kind_of(self.encoding)
        for path, size, begin, end in partition.ranges:
            system, inside = opened(path)
            with system.open_input_file(inside) as f:
                codec, mark = named(self.encoding, f.read(4))
                if kind == "whole":
                    a, b = 0, size
                else:
                    a = max(mark, character_start(f, begin, size, kind, codec, end))
                    b = max(mark, character_start(f, end, size, kind, codec, size))
                if self.starts is None:
                    at, pieces = 0, self.decoded(f, a, b, codec)
                else:
                    start = self.starts.get(path, {}).get(begin, 0)
                    at, pieces = start + -start % self.piece, self.aligned(f, a, b, size, codec, start)
                for k, piece in enumerate(pieces):
                    yield path, begin, k, piece, at
                    at += len(piece)
                if size <= mark:
                    yield path, begin, 0, "", 0

    def decoded(self, f, a: int, b: int, codec: str):
        """The characters of bytes a to b, ``piece`` at a time."""
        decoder, held = codecs.getincrementaldecoder(codec)("strict"), ""
        f.seek(a)
        while a < b:
            some = f.read(min(READ, b - a))
            a += len(some)
            if not some:
                raise EOFError("a file became shorter")
            held += decoder.decode(some, a >= b)
            while len(held) >= self.piece:
                yield held[: self.piece]
                held = held[self.piece :]
        if held:
            yield held

    def aligned(self, f, a: int, b: int, size: int, codec: str, start: int):
        """The file's pieces of ``piece`` characters that begin in bytes a to b, before which it has ``start`` characters; the last is read to its end."""
        decoder, held, skip, at = codecs.getincrementaldecoder(codec)("strict"), "", -start % self.piece, a
        f.seek(a)
        while at < size and (at < b or held):
            beyond = at >= b
            some = f.read(min(READ, (size if beyond else b) - at))
            at += len(some)
            if not some:
                raise EOFError("a file became shorter")
            held += decoder.decode(some, at >= size)
            done = min(skip, len(held))
            skip -= done
            while len(held) - done >= self.piece:
                yield held[done : done + self.piece]
                done += self.piece
                if beyond:
                    return
            held = held[done:]
        if held:
            yield held


@dataclass
class Written(WriterCommitMessage):
    path: str


class TextWriter(DataSourceWriter):
    """A file for each task, which appears when all are written; tasks that are repeated leave nothing."""

    def __init__(self, options):
        self.path, self.encoding, self.end = options["path"], options.get("encoding", "UTF-8"), options.get("end", "\n")
        self.run = uuid.uuid4().hex[:12]

    def write(self, rows):
        from pyspark import TaskContext

        system, root = opened(self.path)
        temporary = f"{root}/_temporary/{self.run}"
        system.create_dir(temporary, recursive=True)
        name = f"{temporary}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.txt"
        encoder = codecs.getincrementalencoder(self.encoding)()
        with system.open_output_stream(name) as f:
            for row in rows:
                if row[0] is not None:
                    f.write(encoder.encode(row[0] + self.end))
        return Written(name)

    def commit(self, messages):
        system, root = opened(self.path)
        for m in messages:
            if m is not None:
                system.move(m.path, f"{root}/{m.path.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        system, root = opened(self.path)
        if system.get_file_info(f"{root}/_temporary/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_temporary/{self.run}")


class EncodedText(DataSource):
    """``format("encoded_text")``: options path, encoding; split, piece and starts to read, end (of each row) to write."""

    @classmethod
    def name(cls):
        return "encoded_text"

    def schema(self):
        return "path string, range long, part long, piece string, at long"

    def reader(self, schema):
        return PieceReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("files are added only")
        return TextWriter(self.options)


def write_texts(texts: DataFrame, path: str, encoding: str = "UTF-8", end: str = "\n") -> None:
    """The column ``text`` in files under ``path``, one for each partition, each text followed by ``end``; null texts are left out.

    Characters that the encoding lacks are an error, and then no file appears.
    """
    texts.sparkSession.dataSource.register(EncodedText)
    texts.select("text").write.format("encoded_text").mode("append").option("path", path).option("encoding", encoding).option("end", end).save()


def read_pieces(spark: SparkSession, path: str, encoding: str = "UTF-8", split: int = 0, piece: int = 0, starts: dict | None = None) -> DataFrame:
    """path, range, part, piece, at of all files under ``path``; in this order the pieces are the files' texts.

    ``at`` is the characters before a piece in its range. With ``starts`` (of ``range_starts``) it is those in
    its file, and the pieces are the file's from its begin on, each in the range where it begins.
    """
    spark.dataSource.register(EncodedText)
    reader = spark.read.format("encoded_text").option("path", path).option("encoding", encoding)
    if starts is not None:
        reader = reader.option("starts", json.dumps({p: list(x.items()) for p, x in starts.items()}))
    return reader.option("split", split or SPLIT).option("piece", piece or PIECE).load()


def range_starts(pieces: DataFrame) -> dict[str, dict[int, int]]:
    """Of each path the characters before its ranges, but for those without any.

    The driver holds a number for each range, as it does to plan the reading.
    """
    counts = pieces.groupBy("path", "range").agg(F.sum(F.length("piece").cast("long")).alias("n")).where("n > 0")
    out, before, last = {}, 0, None
    for path, begin, n in sorted(map(tuple, counts.collect())):
        before, last = before if path == last else 0, path
        if before:
            out.setdefault(path, {})[begin] = before
        before += n
    return out


def file_pieces(spark: SparkSession, path: str, encoding: str = "UTF-8", size: int = 0, split: int = 0) -> DataFrame:
    """Files as ``large.pieces`` gives texts: doc_id (as of ``read_texts``), seq, begin (from 0), piece of ``size`` characters each but the last.

    ``large.Index`` takes them, so that a file of any size is indexed without a task that holds it.
    """
    size = size or PIECE
    starts = range_starts(read_pieces(spark, path, encoding, split))
    at = read_pieces(spark, path, encoding, split, size, starts)
    return at.select(F.xxhash64("path").alias("doc_id"), F.expr(f"at div {size}").alias("seq"), F.col("at").alias("begin"), "piece")
