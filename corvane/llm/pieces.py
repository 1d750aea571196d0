"""SentencePiece encoding and decoding: shared-prefix Viterbi over sorted distinct marked words.

A text is marked (spaces become U+2581, one is put before it) and cut into marked words, over whose borders no piece
reaches. The distinct words of a batch are sorted, which lays them out as a trie in depth-first order; the forward
table of a word is kept up to the prefix that it shares with the next one, so every trie node is computed once.

The forward state depends on the model's kind:
- unigram: the best score of a prefix and its last piece (Viterbi).
- BPE: the last piece of the prefix's own encoding. The highest sum of scores does not give a BPE model's result, so
  scores are not added up here. A sequence of pieces is the merge result exactly if every piece is the merge result
  of its characters and every two neighbours are that of theirs; so each prefix has exactly one last piece that is
  compatible with the state where it starts. Pairs are decided once by merging and remembered.

Characters outside the vocabulary become byte pieces (or unk, if the model has none). The model's bytes are broadcast
(about 0.5 MB, checked against `MAX_MODEL_MB`); the path is a parameter. Encoding and decoding are narrow.

Of last pieces that give equal sums in a unigram model a single character is taken, else the longest.

Defined results: null and empty texts have no pieces and decode to the empty text; U+2581 in a text decodes to a
space, and unpaired surrogates to U+FFFD, so `round_trip` is false for such texts; repeated rows give repeated results;
other columns pass unchanged, but one that has the name of an added column (n_tokens, ids, round_trip; text in
decode()) is replaced by it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from corvane.llm.arrow import column, in_arrow, map_texts

MARK = "▁"
MAX_MODEL_MB = 64
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: What a worker remembers of pairs of pieces, and of words and their ids, in bytes.
PAIR_BYTES, WORD_BYTES = 40_000_000, 64_000_000


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields; values are ints or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    """What the encoder needs of a model file."""

    kind: int
    prefix: bool
    pieces: dict[str, tuple[int, float]]
    decoded: list[bytes]
    bytes_at: int | None
    unk: int

    @staticmethod
    def load(data: bytes) -> Model:
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        top = [(k, v) for k, v in _fields(data) if k in (2, 3)]
        trainer = dict(f for k, v in top if k == 2 for f in _fields(v))
        normal = dict(f for k, v in top if k == 3 for f in _fields(v))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE) or normal.get(2) or normal.get(4, 1):
            raise ValueError("only unigram and BPE models that leave the text as it is are encoded here")
        pieces, decoded, first = {}, [], None
        for k in range(sp.get_piece_size()):
            name = sp.id_to_piece(k)
            if sp.is_byte(k):
                first = k if first is None else first
                decoded.append(bytes([k - first]))
            elif sp.is_control(k):
                decoded.append(b"")
            elif sp.is_unknown(k):
                decoded.append(" ⁇ ".encode())
            else:
                decoded.append(name.replace(MARK, " ").encode())
                if not sp.is_unused(k):
                    pieces[name] = (k, sp.get_score(k))
        return Model(kind, bool(normal.get(3, 1)), pieces, decoded, first, sp.unk_id())


class PrefixEncoder:
    """Encodes sorted words; everything known about a shared prefix is kept from word to word."""

    def __init__(self, model: Model):
        self.m = model
        self.longest = max(map(len, model.pieces), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.held = 0
        #: Ends of pieces: whole pieces are 2 until merging has shown them sound (1) or not (0); other ends are 0.
        self.ends = {p[k:]: 0 for p in model.pieces for k in range(len(p))} | {p: 1 if len(p) == 1 else 2 for p in model.pieces}
        self.packed = {p: array("i", [k]).tobytes() for p, (k, _) in model.pieces.items()}
        self.lowest = min((s for _, s in model.pieces.values()), default=0.0) - 10.0
        inner = any(MARK in p.lstrip(MARK) for p in model.pieces)
        breaks = "" if inner or any("\n" in p for p in model.pieces) else "\n"
        self.cut: Callable[[str], list[str]] = (lambda t: [t]) if inner else re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|{breaks}" if breaks else "")).findall

    def marked(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut((MARK if self.m.prefix else "") + text.replace(" ", MARK))

    def merge(self, text: str) -> list[str]:
        """Plain merging, best piece first and leftmost among equals; for single pieces and pairs of them."""
        parts, known = list(text), self.m.pieces
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = known.get(parts[i] + parts[i + 1])
                if got and (best is None or got[1] > best):
                    best, at = got[1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _is_sound(self, piece: str) -> bool:
        ok = self.ends[piece] = int(self.merge(piece) == [piece])
        return bool(ok)

    def _fit(self, a: str, b: str) -> bool:
        self.held += 160  # pieces are as long as the model has them, so pairs do not vary much
        if self.held > PAIR_BYTES:
            self.pairs.clear()
            self.held = 160
        ok = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return ok

    def encode_sorted(self, words: list[str]) -> dict[str, array]:
        """ids of every word; `words` must be sorted and distinct."""
        return {w: array("i", ids) for w, ids in self.packed_sorted(words).items()}

    def packed_sorted(self, words: list[str]) -> dict[str, bytes]:
        """The same as bytes, four for each id."""
        out: dict[str, bytes] = {}
        step, forward = (self._extend_bpe, [b""]) if self.m.kind == BPE else (self._extend_unigram, [0.0])
        last: list[str] = [""]  # last piece of the encoding of each prefix
        before = ""
        for w in words:
            shared = 0
            for a, b in zip(before, w, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            del forward[shared + 1 :]
            out[w] = step(w, shared + 1, last, forward)
            before = w
        return out

    def _extend_bpe(self, w: str, first: int, last: list[str], ids: list[bytes]) -> bytes:
        """The forward table from place `first` on, with the ids of each prefix. Only one piece can end at a place, so
        they are tried from the shortest, as long as some piece ends so."""
        ends, known, packed = self.ends.get, self.pairs.get, self.packed.get
        for end in range(first, len(w) + 1):
            start = end - 1
            piece = w[start]
            kind = ends(piece)
            while kind is not None:
                if kind and (kind == 1 or self._is_sound(piece)):
                    if not start:
                        break
                    fit = known((last[start], piece))
                    if fit or (fit is None and self._fit(last[start], piece)):
                        break
                start -= 1
                if start < 0:
                    kind = None
                    break
                piece = w[start:end]
                kind = ends(piece)
            if kind is None:
                start, piece = end - 1, w[end - 1]
            last.append(piece)
            ids.append(ids[start] + (packed(piece) or self._other(piece)))
        return ids[-1]

    def _extend_unigram(self, w: str, first: int, last: list[str], score: list[float]) -> bytes:
        for end in range(first, len(w) + 1):
            self._step_unigram(w, end, last, score)
        back, end = [], len(w)
        while end:
            back.append(last[end])
            end -= len(last[end])
        return b"".join([self.packed.get(piece) or self._other(piece) for piece in reversed(back)])

    def _step_unigram(self, w: str, end: int, last: list[str], score: list[float]) -> None:
        known, best, piece = self.m.pieces, score[end - 1] + self.lowest, w[end - 1]
        single = known.get(piece)
        if single:
            best = score[end - 1] + single[1]
        for start in range(max(0, end - self.longest), end - 1):
            got = known.get(w[start:end])
            if got and score[start] + got[1] > best:
                best, piece = score[start] + got[1], w[start:end]
        last.append(piece)
        score.append(best)

    def _other(self, piece: str) -> bytes:
        """The ids of a piece that the vocabulary lacks."""
        if self.m.bytes_at is None:
            return array("i", [self.m.unk]).tobytes()
        return array("i", [self.m.bytes_at + b for b in piece.encode("utf-8", "replace")]).tobytes()


class Codec:
    """Encodes and decodes batches of texts; words stay known from batch to batch within a bound of bytes: beyond half of
    it they become the old ones, of which those that are met again stay."""

    def __init__(self, model: Model, known: int = WORD_BYTES):
        self.m, self.encoder, self.known = model, PrefixEncoder(model), known
        self.forget()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.encoder.marked(t or "") for t in texts]
        met = set(chain.from_iterable(cut))
        asked = met - self.words.keys()
        back = asked & self.old.keys()
        new = sorted(asked - back)
        size = sum(map(len, new)) * 4 + len(asked) * 260
        if self.held + size > self.known // 2:
            here = met - asked
            kept = {w: self.words[w] for w in here} | {w: self.old[w] for w in back}
            self.old, self.words, self.held = self.words, kept, len(here) * 280
        else:
            self.words.update((w, self.old[w]) for w in back)
        self.held += size
        self.words.update(self.encoder.packed_sorted(new))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.int32) for ws in cut]

    def forget(self) -> None:
        """Lets go of the words, so that an idle worker holds the model and its pairs only."""
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.m.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def _codec(data: bytes) -> Codec:
    """One codec per worker and model: what it learned about pairs serves later tasks."""
    key = hash(data)
    if key not in _codecs:
        _codecs[key] = Codec(Model.load(data))
    return _codecs[key]


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, text_col: str = "text") -> DataFrame:
    """All other columns of docs, then n_tokens, ids and round_trip (decoding the ids gives the text again)."""
    data = Path(model_path).read_bytes()
    if len(data) > MAX_MODEL_MB * 1_000_000:
        raise ValueError(f"{model_path} has more than {MAX_MODEL_MB} MB, which is the bound of what is broadcast")
    Model.load(data)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def setup() -> Callable[[list], dict]:
        codec = _codec(shared.value)

        def work(texts: list) -> dict:
            ids = codec.encode(texts)
            return {"n_tokens": [len(i) for i in ids], "ids": ids, "round_trip": [codec.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]}

        work.close = codec.forget
        return work

    return map_texts(docs, "n_tokens bigint, ids array<int>, round_trip boolean", setup, text=text_col)


def decode(rows: DataFrame, model_path: str = DEFAULT_MODEL, ids_col: str = "ids") -> DataFrame:
    """All other columns of rows, then text. Null ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    kept = [f for f in rows.schema.fields if f.name.lower() not in (ids_col.lower(), "text")]
    out = StructType([*kept, StructField("text", StringType())])
    sent = rows.select(*[column(f.name) for f in kept], column(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, schema = _codec(shared.value), to_arrow_schema(out)
        for b in batches:
            for k in range(0, b.num_rows, 512):  # bounds what is held for very long texts
                part = b.slice(k, 512)
                texts = [codec.decode(i.values.to_numpy(zero_copy_only=False)) if i.is_valid else "" for i in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name).cast(schema.field(f.name).type) for f in kept), pa.array(texts, pa.string())], schema=schema)

    return in_arrow(sent, run, out)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "ids", "round_trip")
