"""Byte-level BPE over Arrow batches, by the tokenizers library.

Ids of either a rank file (tiktoken's format) or a tokenizer file. A rank file
becomes a BPE model of the library: a merge for each way to part a token into
two others, in the order of the ranks, over the byte-to-character table. A
piece that is a token as a whole stays one, as tiktoken has it.

Most of a text is words met before. A text is cut before each space between two
other characters, which no match of the splitting pattern can span; the library's
model encodes each distinct match once, and the ids of matches and cuts are
kept, up to a number of entries. Texts with spaces next to white space are split
by the pattern as a whole.

:class:`ByteBPE` also gives each token's bytes and characters in the text
(:meth:`ByteBPE.offsets`): a character split over tokens belongs to each of
them. Decoding turns ids back into bytes by the reversed byte table, and into
text once all bytes of a character are there.

Edge cases: a null or empty text has no ids; repeated rows get equal rows;
null ids are passed on; extra columns are passed by.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers
from tokenizers import Regex as LibraryRegex

from .common import slices, trimmed

#: Entries of a task's memory of cuts.
MEMORY = 1 << 18
#: Bytes of text whose cuts are told apart at once.
SLICE = 4 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def from_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A tokenizer of the library that merges in the order of ``ranks``."""
    names = byte_characters()
    spelt = {token: "".join(names[b] for b in token) for token in ranks}
    merges = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((rank, ranks[token[:i]], ranks[token[i:]], token[:i], token[i:]))
    merges.sort(key=lambda m: m[:3])
    model = models.BPE(vocab={spelt[t]: r for t, r in ranks.items()}, merges=[(spelt[a], spelt[b]) for *_, a, b in merges], ignore_merges=True)
    out = Tokenizer(model)
    split = pre_tokenizers.Split(LibraryRegex(pattern), behavior="isolated")
    out.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class ByteBPE:
    """Encodes and decodes by one tokenizer of the library."""

    def __init__(self, tokenizer: Tokenizer, pattern: str, memory: int = MEMORY):
        self.tokenizer, self.memory = tokenizer, memory
        tokenizer.encode_special_tokens = True
        self.pieces = regex.compile(pattern)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        names = tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of: list[bytes] = [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        self.names = byte_characters()
        #: The same model on pieces already split, one to a line.
        self.lines = Tokenizer(tokenizer.model)
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int64)
        #: Ids, as little-endian unsigned 32-bit integers, of pieces, and of cuts without their space.
        self.plain = _Memory(self._piece, memory // 16)
        self.after_space: dict[str, bytes] = {}

    def _spelt(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.names[32])
        return "".join([self.names[b] for b in piece.encode()])

    def _piece(self, piece: str) -> bytes:
        """The library's model on one match of the pattern, spelt in its byte characters."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(self._spelt(piece))]).tobytes()

    def _lines(self, cut: str) -> str | None:
        """The pieces of a space and a cut, spelt, one to a line; None where the text must be split as a whole."""
        if cut.isalpha():
            return self._spelt(" " + cut)
        if cut[:-1].isalpha() and cut[-1] in ".,:;!?":
            return self._spelt(" " + cut[:-1]) + "\n" + cut[-1]
        if not cut or cut[0].isspace() or cut[-1].isspace() or len(cut.split()) > 1 + cut.count("\n") or "\r" in cut:
            return None
        return "\n".join([self._spelt(p) for p in self.pieces.findall(" " + cut)])

    def _encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, how many of them each cut has (-1: None), and where they begin."""
        known = self.after_space
        found = [known.get(c) for c in cuts]
        sizes = np.fromiter((-1 if f is None else len(f) // 4 for f in found), np.int64, len(found))
        new = np.flatnonzero(sizes < 0)
        lines = [self._lines(cuts[i]) for i in new.tolist()]
        fresh = np.fromiter((x is not None for x in lines), bool, len(lines))
        lines, new = [x for x in lines if x is not None], new[fresh]
        ids = np.array(self.lines.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids if lines else [], "<u4")
        #: Every spelt character is a byte; ids end where as many bytes have passed.
        lengths = np.fromiter((len(x) - x.count("\n") for x in lines), np.int64, len(lines))
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(lengths)) + 1
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        sizes[new] = ends - starts
        room = self.memory - len(known)
        for i, a, b in zip(new[:room].tolist(), starts[:room].tolist(), ends[:room].tolist(), strict=True):
            if len(cuts[i]) < 64:
                known[cuts[i]] = ids[a:b].tobytes()
        old = np.frombuffer(b"".join([f for f in found if f is not None]), "<u4")
        full = np.maximum(sizes, 0)
        places = np.zeros(len(cuts), np.int64)
        was = np.fromiter((f is not None for f in found), bool, len(found))
        places[was] = np.cumsum(full[was]) - full[was]
        places[new] = len(old) + starts
        return np.concatenate([old, ids]), sizes, places

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has; null has none."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        ends = lists.offsets.to_numpy()
        firsts = ends[:-1] - ends[0]
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        cut_ids, sizes, places = self._encode_cuts(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy().copy()
        #: Texts to split as a whole: some cut, or the space after the first, may meet white space.
        marks = (sizes < 0)[which]
        marks[firsts] = False
        whole = np.logical_or.reduceat(marks, firsts)
        begin, lone = flat.take(pa.array(firsts)).to_pylist(), np.diff(ends) == 1
        start = []
        for i, c in enumerate(begin):
            whole[i] |= not lone[i] and (not c or c[-1].isspace())
            start.append(b"".join([self.plain[p] for p in self.pieces.findall(texts[i].as_py() if whole[i] else c)]))
        own = np.fromiter((len(f) // 4 for f in start), np.int64, len(start))
        which[firsts] = len(sizes) + np.arange(len(start))
        places = np.concatenate([places, len(cut_ids) + np.cumsum(own) - own])
        counts = np.concatenate([np.maximum(sizes, 0), own])[which]
        rest = np.repeat(whole, np.diff(ends))
        rest[firsts] = False
        counts[rest] = 0
        upto = np.cumsum(counts)
        pool = np.concatenate([cut_ids, np.frombuffer(b"".join(start), "<u4")])
        ids = pool[np.repeat(places[which] - (upto - counts), counts) + np.arange(upto[-1])]
        return ids, np.add.reduceat(counts, firsts)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return self.encode_all(pa.array([text]))[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; ids outside the vocabulary raise IndexError."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]], list[tuple[int, int]]]:
        """Ids with their spans [from, to) of bytes and of the characters that these are part of."""
        ids = np.frombuffer(self.encode(text), "<u4").tolist()
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids]).tolist()
        char = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text]).tolist()
        spans = list(zip([0, *ends[:-1]], ends, strict=True)) if ids else []
        return ids, spans, [(char[a], char[b - 1] + 1) for a, b in spans]


class _Memory(dict):
    """Remembers what a function gave, for up to ``most`` arguments."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.most and len(key) < 64:
            self[key] = value
        return value


_READY: dict = {}


def ready(kind: str, data: bytes, pattern: str) -> ByteBPE:
    """The tokenizer of a file's content, built once in a worker."""
    mark = (kind, hashlib.sha256(data).digest(), pattern)
    if mark not in _READY:
        _READY.clear()
        made = from_ranks(read_ranks(data), pattern) if kind == "ranks" else Tokenizer.from_str(data.decode())
        _READY[mark] = ByteBPE(made, pattern)
    return _READY[mark]


def forget() -> None:
    """Give a worker's tokenizer up: some 70 MB that would stay while other stages' tasks use the worker."""
    _READY.clear()
    gc.collect()
    trimmed()


def content(path: str) -> tuple[str, bytes]:
    """What kind of file a path names, and its content (a few MB, read on the driver)."""
    with open(path, "rb") as f:
        return ("ranks" if path.endswith(".tiktoken") else "json"), f.read()


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the ids of every row's whole text as little-endian unsigned 32-bit integers."""
    kind, data = content(path)
    shipped = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(kind, shipped.value, pattern)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                ids, counts = bpe.encode_all(part.column("_text"))
                ends = pa.array(np.concatenate([[0], np.cumsum(4 * counts)]).astype(np.int32))
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, ends.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("_id"), packed], ["_id", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, ids binary").withColumnRenamed("_id", id_col)


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``bytes`` that the ids of every row stand for."""
    kind, data = content(path)
    shipped = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(kind, shipped.value, pattern)
        for batch in batches:
            for part in slices(batch, "_ids"):
                texts = [bpe.decode(t or b"") for t in part.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(texts, pa.binary())], ["_id", "bytes"])

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"_id {id_type}, bytes binary").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of a round trip of every row."""
    kind, data = content(path)
    shipped = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(kind, shipped.value, pattern)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                shas, back = [], []
                flat, n = bpe.encode_all(part.column("_text"))
                for one in np.split(flat, np.cumsum(n)[:-1]):
                    ids = one.tobytes()
                    shas.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
