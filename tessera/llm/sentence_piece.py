"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read here byte by byte (protobuf wire format) and rebuilt as
a tokenizers model: its normaliser (character map, extra spaces, dummy
prefix), the space marker, unigram scores or BPE merges in score order, and
byte fallback. Only normal and user-defined pieces match text: control, unknown
and byte pieces are none, though a text may spell one out; in BPE models
user-defined pieces are matched before any merge. No piece of such a model reaches over a boundary between a
non-marker and a marker unless the vocabulary has a piece that does, which is
checked; a text is therefore encoded unit by unit (a run of markers with what
follows), each distinct unit once, in multithreaded batches.

The rebuilt model is compared with the sentencepiece library on probes, on the
first texts of every task and on every text that spells out a piece that is not
a normal one (`verify`); a difference raises.

Defined results: a null text has null ids and decodes to null; an empty text
has no ids and decodes to the empty text; decoding gives the text back except
where the model's normaliser changed it (for the model at hand only U+2581,
which reads as a space); repeated rows repeat; an empty table gives no rows;
very long texts are encoded whole; other columns are ignored or carried.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map

MARK = "▁"
#: Units whose ids a task keeps, and so the bound of its cache.
CACHE_UNITS = 150_000
#: New units in one call of the tokenizer.
UNIT_BATCH = 4096
#: Texts that each task compares with the sentencepiece library.
VERIFIED = 4
PROBES = ("Hello  world", " a\n b\t", "café 漢字 \U0001f600", "x" * 40, "1234.5%", " " * 21 + "y", "", "▁▁q")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, fixed and length-delimited fields as bytes."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value, at
            shift += 7

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            value, at = data[at : at + width], at + width
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    suffix: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.unigram = v == 1
                    if v not in (1, 2):
                        raise ValueError("only unigram and BPE models are supported")
                elif n == 24:
                    m.suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.collapse = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    if m.suffix or not m.escape:
        raise ValueError("models with whitespace suffixes or unescaped spaces are not supported")
    return m


def _hidden(i: int) -> str:
    """What stands in the vocabulary for piece i, which no text may match."""
    return f"\x00{i}\uffff"


def rebuild(m: Model, byte_pieces: bool = True):
    """The tokenizers model. Only normal and user-defined pieces match text; byte pieces are there for the fallback, unless left out."""
    from tokenizers import Tokenizer, models

    shown = {NORMAL, USER} | ({BYTE} if byte_pieces else set())
    if m.unigram:
        # a user-defined piece scores by its length; of hidden pieces no score is ever used
        most = max((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
        scored = {NORMAL: lambda p, s: s, USER: lambda p, s: len(p.encode()) * most - 0.1}
        vocab = [(p if kind in shown else _hidden(i), scored.get(kind, lambda p, s: 0.0)(p, s)) for i, (p, s, kind) in enumerate(m.pieces)]
        inner = models.Unigram(vocab, m.unk_id, m.byte_fallback and byte_pieces)
    else:
        if any(kind == UNUSED for _, _, kind in m.pieces):
            raise ValueError("BPE models with unused pieces are not supported")
        vocab = {p if kind in shown or i == m.unk_id else _hidden(i): i for i, (p, _, kind) in enumerate(m.pieces)}
        usable = {p: s for p, s, kind in m.pieces if kind == NORMAL}
        merges = []
        for p, s in usable.items():
            for k in range(1, len(p)):
                if p[:k] in usable and p[k:] in usable:
                    merges.append((-s, vocab[p], vocab[p[:k]], vocab[p[k:]], p[:k], p[k:]))
        merges.sort()
        inner = models.BPE(vocab, [(x[4], x[5]) for x in merges], unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback and byte_pieces)
    return Tokenizer(inner)


class _Units(dict):
    """Numbers units as they are first looked up, and remembers the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number


class Codec:
    """Encodes and decodes batches of texts with one model file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # tasks run beside each other, and each thread has a heap of its own
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.path = path
        self.tokenizer = rebuild(self.model)
        pieces = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER)]
        whole = any(MARK in p.lstrip(MARK) for p in pieces)
        line_ends = not any("\n" in p for p in pieces)  # then no piece crosses one
        users = sorted((p for p, _, kind in self.model.pieces if kind == USER), key=lambda p: (-len(p), p))
        self._user = re.compile("(" + "|".join(map(re.escape, users)) + ")") if users else None
        # in BPE a user-defined piece is matched before any merge and takes no part in one
        self._frozen = {} if self.model.unigram else {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == USER}
        # a text that spells a byte piece out needs a vocabulary without them
        self._spelt = re.compile("<0x[0-9A-F]{2}>") if self.model.unigram and self.model.byte_fallback else None
        names = sorted({p for p, _, kind in self.model.pieces if kind != NORMAL and kind != BYTE and p})
        names += ["<0x[0-9A-F]{2}>"] if any(kind == BYTE for _, _, kind in self.model.pieces) else []
        self._name_starts = sorted({x[0] for x in names})
        self._names = re.compile("|".join(x if x.startswith("<0x[") else re.escape(x) for x in names)) if names else None
        self._bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self._units = re.compile("(?s).+" if whole else (f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if line_ends else f"{MARK}*[^{MARK}]+|{MARK}+"))
        self._normal = None
        if self.model.charsmap:
            from tokenizers import normalizers

            self._normal = normalizers.Precompiled(self.model.charsmap)
        shown = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else (" ⁇ " if kind == UNKNOWN else p.replace(MARK, " ")).encode() for p, _, kind in self.model.pieces]
        self._piece_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self._piece_ends = np.zeros(len(shown) + 1, np.int64)
        np.cumsum([len(x) for x in shown], out=self._piece_ends[1:])
        # 0: no marker at its beginning, 1: only a marker, 2: more behind it
        self._marked = [(p[:1] == MARK) + (p[:1] == MARK and len(p) > 1) if kind in (NORMAL, USER) else 0 for p, _, kind in self.model.pieces]
        self._plain = self._normal is None and not self.model.collapse
        self.clear()

    def clear(self) -> None:
        self._seen = _Units()
        self._ids = np.zeros(1 << 16, np.int32)
        self._ends = np.zeros(1 << 14, np.int64)  # unit u has ids _ids[_ends[u]:_ends[u + 1]]

    def normalise(self, text: str) -> str:
        if self._normal is not None:
            # user-defined pieces are left as they are
            parts = self._user.split(text) if self._user else [text]
            text = "".join(part if k % 2 else self._normal.normalize_str(part) for k, part in enumerate(parts))
        if self.model.collapse:  # only spaces collapse, not markers that the text itself holds, but at the end both go
            text = re.sub(" +", " ", text).lstrip(" ").replace(" ", MARK).rstrip(MARK)
        else:
            text = text.replace(" ", MARK)
        return MARK + text if text and self.model.dummy_prefix else text

    def shown(self, text: str) -> str:
        """What decoding an encoded text has to give: the text after the model's normaliser."""
        if self._plain:
            return text.replace(MARK, " ")
        text = self.normalise(text).replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix else text

    def _learn(self) -> None:
        new, self._seen.new = self._seen.new, []
        start = len(self._seen) - len(new)
        # an encoding holds much besides its ids, so only some are held at a time
        encoded: list[list[int]] = []
        for at in range(0, len(new), UNIT_BATCH):
            encoded += [e.ids for e in self.tokenizer.encode_batch_fast(new[at : at + UNIT_BATCH], add_special_tokens=False)]
        for k, unit in enumerate(new):
            if unit in self._frozen:
                encoded[k] = [self._frozen[unit]]
            elif self._spelt and self._spelt.search(unit):
                encoded[k] = self._spelt_out(unit)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))
        used = int(self._ends[start])
        while len(self._ids) < used + len(flat):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while len(self._ends) < start + len(new) + 1:
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        self._ids[used : used + len(flat)] = flat
        self._ends[start + 1 : start + len(new) + 1] = used + np.cumsum(sizes)

    @functools.cached_property
    def _without_bytes(self):
        return rebuild(self.model, byte_pieces=False)

    def _spelt_out(self, unit: str) -> list[int]:
        """Ids of a unit that holds the name of a byte piece as text: unknown stretches fall back to bytes here."""
        encoding = self._without_bytes.encode(unit, add_special_tokens=False)
        ids = []
        for i, (a, z) in zip(encoding.ids, encoding.offsets, strict=True):
            ids += [self._bytes[x] for x in unit[a:z].encode()] if i == self.model.unk_id else [i]
        return ids

    def _split(self, text: str) -> list[str]:
        text = self.normalise(text)
        if not self._frozen:
            return self._units.findall(text)
        return [unit for k, part in enumerate(self._user.split(text)) for unit in ([part] if k % 2 else self._units.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): text i has ids[bounds[i]:bounds[i + 1]]."""
        if len(self._seen) > CACHE_UNITS:
            self.clear()
        units = [self._split(t) for t in texts]
        per_text = np.fromiter(map(len, units), np.int64, len(units))
        at = np.fromiter(map(self._seen.__getitem__, chain.from_iterable(units)), np.int64, int(per_text.sum()))
        if self._seen.new:
            self._learn()
        size = self._ends[at + 1] - self._ends[at]
        unit_ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=unit_ends[1:])
        ids = self._ids[np.arange(unit_ends[-1]) + np.repeat(self._ends[at] - unit_ends[:-1], size)]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(per_text, out=bounds[1:])
        return unit_ends[bounds], ids

    def decode(self, bounds: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each ids[bounds[i]:bounds[i + 1]]."""
        size = self._piece_ends[ids + 1] - self._piece_ends[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        data = self._piece_bytes[np.arange(ends[-1]) + np.repeat(self._piece_ends[ids] - ends[:-1], size)].tobytes()
        cuts = ends[bounds].tolist()
        texts = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if self.model.collapse:  # each piece loses a leading space as long as nothing else came before
            for i, t in enumerate(texts):
                lost = 0
                for piece in ids[bounds[i] : bounds[i + 1]].tolist():
                    lost += self._marked[piece] > 0
                    if self._marked[piece] != 1:
                        break
                texts[i] = t[lost:]
            return texts
        return [t[1:] if t[:1] == b" " else t for t in texts] if self.model.dummy_prefix else texts

    def names_piece(self, text: str) -> bool:
        """Whether the text spells out a piece that is not a normal one."""
        return any(c in text for c in self._name_starts) and self._names.search(text) is not None

    def verify(self, texts) -> None:
        """Raise unless the sentencepiece library gives the same ids and the same decoded texts."""
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=self.path)
        texts = list(texts)
        if not texts:
            return
        bounds, ids = self.encode(texts)
        for i, (text, back) in enumerate(zip(texts, self.decode(bounds, ids), strict=True)):
            got = ids[bounds[i] : bounds[i + 1]].tolist()
            if own.encode(text) != got or own.decode(got) != back.decode("utf-8", "replace"):
                raise ValueError(f"the rebuilt model differs from the sentencepiece library on {text[:200]!r}")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One verified codec per Python worker and model file."""
    if path not in _codecs:
        own = Codec(path)
        own.verify(PROBES)
        _codecs[path] = own
    return _codecs[path]


SLICE = 256


def encode(docs: DataFrame, model_path: str, text_col: str = "text", carry: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The carried columns, ids (array<int>), n_ids, and round_trip: whether decoding the ids gives the normalised text back.

    With decoded, also the decoded text. model_path must be readable on every
    executor (it is part of the environment, like the library).
    """
    carried = carry or []
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *(F.col(f"`{c}`") for c in carried))
    fields = rows.schema.fields[1:]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "ids array<int>, n_ids bigint, round_trip boolean" + (", decoded string" if decoded else "")
    names = [*(f.name for f in fields), "ids", "n_ids", "round_trip", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        checked = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                texts = part.column(0).fill_null("").to_pylist()
                own.verify(texts[: max(VERIFIED - checked, 0)] + [t for t in texts[max(VERIFIED - checked, 0) :] if own.names_piece(t)])
                checked += len(texts)
                bounds, ids = own.encode(texts)
                back = own.decode(bounds, ids)
                same = [x == own.shown(y).encode() for x, y in zip(back, texts, strict=True)]
                offsets = pa.array(np.append(bounds[:-1], bounds[-1]).astype(np.int32), pa.int32(), mask=np.append(null, False))
                columns = [*part.columns[1:], pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(np.diff(bounds)), pa.array(same, pa.bool_())]
                if decoded:
                    columns.append(pa.array([x.decode("utf-8", "replace") for x in back], pa.string(), mask=null))
                yield pa.RecordBatch.from_arrays(columns, names)
        own.clear()

    return arrow_map(rows, run, schema)
