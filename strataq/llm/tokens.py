"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, with a bitmap that
says which ids go on; level 1 the second chunk of those, and so on. The place of an id's next chunk is the rank
of its bit, read from a directory that counts the bits before each block. So any token is found by a few look-ups,
with nothing around it decoded.

File: ``DAC1``, segments of up to SEGMENT ids, then the table of contents (segment offsets, documents' ids and
first tokens), its offset and ``DAC1`` again. Numbers are little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

MAGIC = b"DAC1"
SEGMENT, RANK_BITS = 1 << 20, 512
#: Entries of a worker's table of encoded words; it starts anew when full, so a worker's memory is bounded.
CACHE = 500_000
#: Bytes of text encoded at a time; a longer text goes alone.
CHUNK = 4 << 20

# --- codes -------------------------------------------------------------------------------------------------


def encode_segment(ids: np.ndarray) -> bytes:
    """Levels of ``ids`` (uint32): number of ids, number of levels, then of each level its length, chunks,
    bitmap of the chunks that go on and rank directory."""
    levels, rest = [], ids.astype("<u4", copy=False)
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8)
        bits = np.packbits(more, bitorder="little")
        step = RANK_BITS // 8
        ones = np.bitwise_count(np.concatenate([bits, np.zeros(-len(bits) % step, np.uint8)]).reshape(-1, step)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.empty(0, "<u4")
        levels.append(struct.pack("<I", len(rest)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return struct.pack("<IB", len(ids), len(levels)) + b"".join(levels)


class Segment:
    """A segment in memory: ``at(i)`` reads one id by rank, ``ids()`` all of them."""

    def __init__(self, data: bytes):
        self.n, depth = struct.unpack_from("<IB", data)
        at, self.levels = 5, []
        for _ in range(depth):
            (n,) = struct.unpack_from("<I", data, at)
            wide, blocks = -(-n // 8), -(-n // RANK_BITS)
            at += 4
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, wide, at + n)
            ranks = np.frombuffer(data, "<u4", blocks, at + n + wide)
            at += n + wide + 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def at(self, i: int) -> int:
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            part = bits[block * RANK_BITS // 8 : i >> 3]
            before = int(np.bitwise_count(part).sum()) + int(np.bitwise_count(bits[i >> 3] & np.uint8((1 << (i & 7)) - 1)))
            i, shift = int(ranks[block]) + before, shift + 8
        return value

    def ids(self) -> np.ndarray:
        below = np.empty(0, dtype="<u4")
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype("<u4")
            here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= below << 8 if len(below) else below
            below = here
        return below


class Writer:
    """Writes documents' ids to a file; what it holds in memory is one segment and the table of contents."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.n, self.held, self.size = out, out.write(MAGIC), 0, [], 0
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, count: np.ndarray) -> None:
        """The ids of some documents, one after another, and how many each has."""
        for doc_id, at in zip(doc_ids, (self.n + np.cumsum(count) - count).tolist(), strict=True):
            self.docs.append((doc_id or 0, doc_id is None, at))
        self.n += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        while self.size >= SEGMENT:
            self._flush()

    def _flush(self) -> None:
        joined = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        data = encode_segment(joined[:SEGMENT])
        self.offsets.append(self.at)
        self.at += self.out.write(data)
        self.held, self.size = [joined[SEGMENT:]], max(0, len(joined) - SEGMENT)

    def close(self) -> None:
        while self.size:
            self._flush()
        toc = np.array([x for d in self.docs for x in d], dtype="<i8").tobytes()
        self.out.write(struct.pack("<QQQ", len(self.offsets), len(self.docs), self.n))
        self.out.write(np.array([*self.offsets, self.at], dtype="<u8").tobytes() + toc + struct.pack("<Q", self.at) + MAGIC)


class Reader:
    """Reads such a file: any token (``token``), or all documents in order (``documents``)."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        (toc,) = struct.unpack("<Q", self._read(size - 12, 8))
        n_seg, n_docs, self.n = struct.unpack("<QQQ", self._read(toc, 24))
        table = self._read(toc + 24, 8 * (n_seg + 1) + 24 * n_docs)
        self.offsets = np.frombuffer(table, "<u8", n_seg + 1)
        docs = np.frombuffer(table, "<i8", 3 * n_docs, 8 * (n_seg + 1)).reshape(-1, 3)
        self.doc_ids = [None if null else int(d) for d, null, _ in docs]
        self.starts = np.append(docs[:, 2], self.n)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def segment(self, k: int) -> Segment:
        return Segment(self._read(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])))

    def token(self, i: int) -> int:
        return self.segment(i // SEGMENT).at(i % SEGMENT)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start in the file, number of ids, crc32 of the ids as uint32; one segment in memory."""
        k, held = -1, np.empty(0, "<u4")
        for d, doc_id in enumerate(self.doc_ids):
            start, end = int(self.starts[d]), int(self.starts[d + 1])
            crc, at = 0, start
            while at < end:
                if at // SEGMENT != k:
                    k = at // SEGMENT
                    held = self.segment(k).ids()
                stop = min(end, (k + 1) * SEGMENT)
                crc = zlib.crc32(held[at - k * SEGMENT : stop - k * SEGMENT].tobytes(), crc)
                at = stop
            yield doc_id, start, end - start, crc


# --- encoding ----------------------------------------------------------------------------------------------

#: White space other than space, tab and line breaks.
_ODD_SPACE = r"\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = re.compile(f"[{re.sub(r'x{(\w+)}', lambda m: f'u{m[1]:0>4}', _ODD_SPACE)}]")
_RUNS = re.compile(r"(\s+)")
_TAIL = ".,!?|$%&*#;:"
#: Byte-level BPE writes each byte as a character: printable ones as they are, the others from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}


def _gather(table: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of ``table`` that begin where said, one after another."""
    ends = np.cumsum(count)
    return table[np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Byte-level BPE of whole texts, word by word, each different word encoded by the library once.

    The pre-tokenizer never joins what a single space or line break parts: a space leads the word after it, a
    line break stands alone. So the ids of a text are those of its words, each with what stands before it.
    Words are told apart by Arrow and their ids gathered from one table by numpy. Texts with runs of white space
    are cut at the runs, as the pre-tokenizer cuts them. Those with other white space than space, tab and line
    breaks, or with an added token in them, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        before = settings["pre_tokenizer"] or {}
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, np.ndarray] = {}
        self._forget()
        #: Whether texts may be cut into words; other tokenizers get every text whole.
        self.by_word = not settings["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.by_word = self.by_word and len(self._library(["\n"])[0]) == 1
        #: Texts that can't be cut at each space and line break.
        self.special = "|".join([f"[{_ODD_SPACE}\\t\\r]|[ \\n][ \\n]", *map(re.escape, self.added)])

    def _forget(self) -> None:
        """An empty table: a core's row (cores lead with a line break if one stands before them, else they
        follow a space), where its ids begin, how many they are, and all ids."""
        self.rows: dict[str, int] = {}
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.table = np.empty(0, "<u4")

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _of_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces as they are; new ones go to the library together."""
        if len(self.pieces) > CACHE:
            self.pieces = {}
        new = [*dict.fromkeys(p for p in pieces if p not in self.pieces)]
        self.pieces.update(zip(new, self._library(new), strict=True))
        return [self.pieces[p] for p in pieces]

    def _learn(self, cores: list[str]) -> None:
        """Adds cores to the table. Letters, and a space before them, are one pre-token, which goes to the
        library's model at once; the others go to the library together."""
        tokenize, ids, others = self.model.tokenize, [], []
        line = self._of_pieces(["\n"])[0].tolist()
        for core in cores:
            lead = core[:1] == "\n"
            body = core[1:] if lead else core
            if body.isalpha():
                body = body if body.isascii() else body.encode().decode("latin-1").translate(_BYTES)
                found = [t.id for t in tokenize(body if lead else f"\u0120{body}")]
                ids.append(line + found if lead else found)
            else:
                others.append((len(ids), lead, body if lead else f" {body}"))
                ids.append([])
        for (k, lead, _), found in zip(others, self._of_pieces([x[2] for x in others]), strict=True):
            ids[k] = line + found.tolist() if lead else found.tolist()
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.rows.update(zip(cores, range(len(self.rows), len(self.rows) + len(cores)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.table) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(ids), "<u4", int(count.sum()))])

    def _runs(self, text: str) -> list[str]:
        """The pieces of a text with runs of white space: all but a run's last character stand together before a word."""
        pieces, parts, space = [], _RUNS.split(text), ""
        for k, part in enumerate(parts):
            if k % 2 == 0:
                pieces.append(space + part)
                space = ""
            elif k == len(parts) - 2 and not parts[-1]:  # at the end the run stays whole
                pieces.append(part)
            else:
                pieces.append(part[:-1])
                if part[-1] == " ":
                    space = " "
                else:
                    pieces.append(part[-1])
        return pieces

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words and how many each has. Punctuation behind letters is a pre-token of its own,
        so it is cut off: what is left is shared by more words."""
        short = pc.ascii_rtrim(words, characters=_TAIL)
        cut = pc.and_(pc.not_equal(short, words), pc.utf8_is_alpha(pc.utf8_slice_codeunits(short, -1)))
        cores = pc.if_else(cut, short, words).dictionary_encode()
        tails = pc.extract_regex(words.filter(cut), f"(?P<tail>[{_TAIL}]+)$").field("tail").dictionary_encode()
        each = cores.dictionary.to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist
        if len(self.rows) > CACHE:
            self._forget()
        new = [c for c in each if c not in self.rows]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.rows.__getitem__, each), np.int64, len(each))[cores.indices.to_numpy()]
        found = self._of_pieces(tails.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        own, which = cut.to_numpy(zero_copy_only=False), tails.indices.to_numpy()
        begin, count = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        begin[:, 0], count[:, 0] = self.begin[rows], self.count[rows]
        begin[own, 1], count[own, 1] = (len(self.table) + np.cumsum(sizes) - sizes)[which], sizes[which]
        return _gather(np.concatenate([self.table, *found]), begin.ravel(), count.ravel()), count.sum(axis=1)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special ones among them, and how many each has."""
        split = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = split.flatten().dictionary_encode()
        table, count = self._of_words(coded.dictionary)
        begin, at = np.cumsum(count) - count, coded.indices.to_numpy()
        begin, count = begin[at], count[at]
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        begin[first] += 1  # without the line break that was put before the first word
        count[first] -= 1
        return _gather(table, begin, count), np.add.reduceat(count, first)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (uint32), one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        special = np.ones(len(texts), dtype=bool)
        if self.by_word:
            special = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        ids, count = np.empty(0, "<u4"), np.zeros(len(texts), dtype=np.int64)
        if not special.all():
            ids, count[~special] = self._words(texts.filter(pa.array(~special)) if special.any() else texts)
        if not special.any():
            return ids, count
        at, own = np.flatnonzero(special), texts.filter(pa.array(special)).to_pylist()
        found: list[np.ndarray | None] = [None] * len(own)
        whole = []
        for k, text in enumerate(own):
            if not self.by_word or _ODD.search(text) or any(a in text for a in self.added):
                whole.append(k)
            else:
                found[k] = np.concatenate(self._of_pieces(self._runs(text)))
        for k, x in zip(whole, self._library([own[k] for k in whole]), strict=True):
            found[k] = x
        count[at] = [len(x) for x in found]
        out = np.empty(count.sum(), "<u4")
        here = np.repeat(special, count)
        out[~here], out[here] = ids, np.concatenate(found)
        return out, count

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        ids, count = self.encode_batch(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(count)[:-1])] if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so words encoded by one task are known to the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- files -------------------------------------------------------------------------------------------------


#: Hadoop's names of stores, and the names of the same stores here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfss", "abfss": "abfss"}


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store of a shared folder as workers open it, and the path there. hdfs and viewfs go through Hadoop's library."""
    scheme, _, rest = folder.partition(":")
    if scheme == "file" or "://" not in folder:
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme == "file" else folder
    if scheme in SCHEMES:
        return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
    host, _, path = rest.removeprefix("//").partition("/")
    return pafs.HadoopFileSystem(f"{scheme}://{host}" if host else "default"), f"/{path}"


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about CHUNK bytes of text, the second column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")) - at)
        yield batch.slice(at, n)
        at += n


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the ids of all documents to ``folder``, in ascending doc_id order over part-00000.dac, .. ; returns
    (part, n_tokens) of the files. A file is written under another name and then moved, so a task that is run
    again replaces its file and never leaves half of one. Ranges are cut by doc_id and text, so a doc_id of many
    rows (or none) is spread over several files."""
    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        fs, root = filesystem(folder)
        name, temporary = f"{root}/part-{part:05d}.dac", f"{root}/.{uuid.uuid4().hex}"
        stream = None
        for batch in batches:
            if writer is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(temporary)
                writer = Writer(stream)
            for some in pieces_of(batch):
                ids, count = encoder(tokenizer).encode_batch(some.column(1))
                ends = np.cumsum(count + 1) - 1
                out = np.full(len(ids) + len(count), end_id, dtype="<u4")
                own = np.ones(len(out), dtype=bool)
                own[ends] = False
                out[own] = ids
                writer.add(some.column(0).to_pylist(), out, count + 1)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([writer.n], pa.int64())], ["part", "n_tokens"])

    return settle(dealt.mapInArrow(run, "part int, n_tokens long"))


def read_tokens(parts: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; a task for each file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(parts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset")))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for part, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/part-{part:05d}.dac") as file:
                    rows = [(d, offset + s, n, crc) for d, s, n, crc in Reader(file).documents()]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = offsets.repartitionByRange(max(1, offsets.count()), "part")  # a number given, which is not reduced again
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write, read back, and one row for each document from the files.

    Each document ends with ``end_id``, so a null or empty text has one token. doc_id null comes first; rows
    that share a doc_id follow each other by a hash of the text. An empty table writes no file and gives an
    empty result. Other columns are ignored.
    """
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), folder)
