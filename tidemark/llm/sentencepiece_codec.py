"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file is parsed here as a protobuf.  From it are rebuilt: the normaliser
(precompiled character map, extra spaces, dummy prefix, metaspace marker), the model
(unigram scores, or the merges that a BPE model's scores imply), byte fallback, and the
decoder.  Where no piece holds a marker after another character, no merge can cross a
word's start; words are then split off first and each distinct word is encoded once; ids
stay the same.  Every batch is encoded by several threads and decoded again, and the ids of
every whole text are held against the reference implementation's.  The ids that come out are
the tokenizers library's, whatever the comparison says.
"""

from __future__ import annotations

import hashlib
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

from tidemark.llm.common import tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class SpModel:
    """What encoding and decoding need of a SentencePiece model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    def of_type(self, *types: int) -> list[int]:
        return [i for i, (_, _, t) in enumerate(self.pieces) if t in types]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield number, data[at : at + size]
            at += size
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"protobuf wire type {wire}")


def parse_model(data: bytes) -> SpModel:
    """The model in the bytes of a ``.model`` file."""
    model = SpModel()
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
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    return model


def _merges(model: SpModel) -> list[tuple[str, str]]:
    """All pairs whose concatenation is a piece, best score first."""
    usable = {model.pieces[i][0]: model.pieces[i][1] for i in model.of_type(NORMAL, USER_DEFINED, UNUSED)}
    found = [
        (-score, i, piece[:i], piece[i:])
        for piece, score in usable.items()
        for i in range(1, len(piece))
        if piece[:i] in usable and piece[i:] in usable
    ]
    return [(a, b) for _, _, a, b in sorted(found)]


WORD = f"{MARK}+[^{MARK}]*|[^{MARK}]+"


def splits_at_words(model: SpModel) -> bool:
    """Whether no piece goes on across the start of a word."""
    return model.escape_whitespaces and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in model.pieces)


def build_tokenizer(model: SpModel):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    fallback = bool(model.of_type(BYTE))
    unknown = next(iter(model.of_type(UNKNOWN)), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(
            vocab, _merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=fallback
        )
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)

    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    mark = MARK if model.escape_whitespaces else " "
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(mark))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if splits_at_words(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail]
    )
    return tokenizer


class Codec:
    """Encodes and decodes batches; ``reference_ids`` are the reference implementation's."""

    #: Characters of distinct words that are kept with their ids, at most: some 60 MB in a worker.
    MOST_HELD = 3_000_000
    #: Words that go to the library as one pre-split sequence.
    CHUNK = 2_000

    def __init__(self, data: bytes, threads: int = 2, held_chars: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = parse_model(data)
        self.tokenizer = build_tokenizer(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self._words = Tokenizer(self.tokenizer.model)  # the same model, held once
        self._find = re.compile(WORD).findall
        self._identity = not self.model.charsmap and not self.model.remove_extra_whitespaces
        pieces = [p for p, _, _ in self.model.pieces]
        self._splits = splits_at_words(self.model) and self.model.add_dummy_prefix and MARK in pieces
        self._opens = np.array([p.startswith(MARK) for p in pieces])
        raw = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in self.model.pieces]
        self._raw = np.frombuffer(b"".join(raw), np.uint8)
        self._size = np.array([len(r) for r in raw])
        self._at = np.cumsum(self._size) - self._size
        self._known: dict[str, bytes] = {}
        self._held = 0
        if held_chars is not None:
            self.MOST_HELD = held_chars

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids that the tokenizers library gives."""
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        if self._splits:
            return self._by_words(texts)
        return [np.array(x, np.int32) for x in self.encode_whole(texts)]

    def parity(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether the ids of each whole text are the reference's."""
        return [np.array_equal(x, np.array(y, np.int32)) for x, y in zip(ids, self.reference_ids(texts), strict=True)]

    def _cut(self, text: str) -> list[str]:
        """The words of the normalised text, each without the marker that opens it."""
        if self._identity and MARK not in text:
            words = text.split(" ") if text else []
        else:
            words = self._normal(text).split(MARK)[1:]
        # empty words are runs of markers, which may be pieces of their own
        return [w[1:] for w in self._find(self._normal(text))] if "" in words else words

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._cut(t) for t in texts]
        here: dict[str, bytes] = {}  # the words of these texts: small, so looked up fast
        distinct = set(chain.from_iterable(cut))
        new = []
        for word, ids in zip(distinct, map(self._known.get, distinct), strict=True):
            if ids is None:
                new.append(word)
            else:
                here[word] = ids
        learnt = self._learn(new)
        here |= learnt
        self._held += sum(map(len, new))
        if self._held > self.MOST_HELD:
            self._known, self._held = dict(here), sum(map(len, here))
        else:
            self._known |= learnt
        return [np.frombuffer(b"".join(map(here.__getitem__, words)), np.int32) for words in cut]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words.  Where one marker opens a word, one piece of it starts with a marker."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if MARK not in w]
        chunks = [[MARK + w for w in plain[i : i + self.CHUNK]] for i in range(0, len(plain), self.CHUNK)]
        found = self._words.encode_batch_fast(chunks, is_pretokenized=True, add_special_tokens=False) if chunks else []
        for i, e in enumerate(found):
            ids = np.array(e.ids, np.int32)
            flat, cuts = ids.tobytes(), [*(4 * np.flatnonzero(self._opens[ids])).tolist(), 4 * len(ids)]
            own = plain[i * self.CHUNK : (i + 1) * self.CHUNK]
            out |= {w: flat[a:b] for w, a, b in zip(own, cuts[:-1], cuts[1:], strict=True)}
        rest = [w for w in words if MARK in w]
        alone = self._words.encode_batch_fast([MARK + w for w in rest], add_special_tokens=False)
        return out | {w: np.array(e.ids, np.int32).tobytes() for w, e in zip(rest, alone, strict=True)}

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _normal(self, text: str) -> str:
        if not text or not self._identity:
            return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return MARK * self.model.add_dummy_prefix + text.replace(" ", MARK)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def round_trips(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether decoding the ids of each whole text gives its normalised text back.

        The pieces' bytes are put together for all texts at once; only where these are not the
        text's does the library decode them, and that decides.
        """
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        size = self._size[flat]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._at[flat] - (ends - size), size)
        joined = self._raw[place].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        lead = int(self.model.add_dummy_prefix)
        out = []
        for text, own, a, b in zip(texts, ids, cuts[:-1], cuts[1:], strict=True):
            wanted = self.normalised(text)
            skip = lead if joined[a : a + 1] == b" " else 0
            same = joined[a + skip : b] == wanted.encode()
            out.append(same or self.decode([own.tolist()])[0] == wanted)
        return out

    def reference_ids(self, texts: list[str]) -> list[list[int]]:
        return self.reference.encode(texts, num_threads=self.threads)

    def normalised(self, text: str) -> str:
        """What decoding gives back: the normalised text without marker and dummy prefix."""
        if self._identity:
            return text.replace(MARK, " ")
        out = self.reference.normalize(text).replace(MARK, " ")
        return out[1:] if self.model.add_dummy_prefix else out


_CODECS: dict[tuple, Codec] = {}


def _codec(data: bytes, threads: int, held_chars: int | None = None) -> Codec:
    """One codec a Python worker for each model, known by its content."""
    key = (hashlib.sha256(data).digest(), threads, held_chars)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, threads, held_chars)
    return _CODECS[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _batches(column: pa.Array, most_chars: int) -> Iterator[list[str]]:
    """The texts in order, null as empty, in parts of few characters; only one part is held at a time."""
    part, size = [], 0
    for value in column:
        text = value.as_py() or ""
        if part and size + len(text) > most_chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def encode_documents(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    threads: int = 2,
    batch_chars: int = 1 << 20,
    held_chars: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, round_trip, parity.

    ``ids`` are always the tokenizers library's.  ``round_trip``: decoding them gives the
    normalised text back.  ``parity``: they are the reference implementation's ids of the whole
    text; known to differ are only runs of hundreds of markers, where merges of equal score tie.  Null and empty texts have no ids and pass both; texts of any length are encoded
    whole.  Repeated rows come back repeated, null ids stay null, an empty table gives an empty
    result, and other columns are not looked at.  The model travels with the job, so executors
    need not have ``model_path``.  ``batch_chars`` (texts encoded at once) and ``held_chars``
    (characters of words kept with their ids) bound a worker's memory and never the result.
    """
    data = _model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, threads, held_chars)
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1), batch_chars):
                ids = codec.encode_arrays(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.array(codec.round_trips(texts, ids), pa.bool_()),
                        pa.array(codec.parity(texts, ids), pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "round_trip", "parity"],
                )
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id long, ids array<int>, n_tokens long, round_trip boolean, parity boolean"
    )


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", *, threads: int = 2) -> DataFrame:
    """One row per input row: doc_id, text, by the library's decoder.  Null or empty ids give the empty text."""
    data = _model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, threads)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                texts = codec.decode([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )
