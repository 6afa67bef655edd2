"""SentencePiece encoding and decoding of merge-type models by backtracking.

The library merges characters pair by pair, best score first, leftmost among equals. A sequence of pieces is its result exactly when each two
neighbours are: merging the text of the two alone gives the two back. So a text is read from the left: the longest piece that starts at the
place (all matches come from one pass of an Aho-Corasick automaton), then its next shorter prefixes, until one is compatible with the piece
before it; where none is, the place is marked in a bitfield as failed and the piece before it is shortened. What leads to a place validly is
unique, so a place that failed once fails always, and the work stays linear.

Blanks become U+2581 and one is put in front. No piece has one behind another character, so a text is cut before each run of them, and a bounded
memo keeps what a worker has already encoded. A character that the vocabulary lacks becomes the pieces of its bytes, or the unknown piece.

Edge cases: a null or empty text has the end id alone and decodes to an empty text; control pieces' names in a text are ordinary text, and their ids
decode to nothing; bytes that are no UTF-8 decode to U+FFFD, one each; texts of any length are encoded whole; repeated rows encode alike; an empty
table gives an empty one; other columns of df stay, unless named as the result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import slices, table

BLANK = "▁"
UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Entries of a memo before it becomes the older one, and the longest unit that it takes.
MEMO_ENTRIES = 200_000
MEMO_CHARS = 60
#: Pairs of neighbours whose compatibility is remembered.
PAIR_ENTRIES = 1_000_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Pieces, scores and rules of a model file. Models that are not of the merge type, or that normalize characters, are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind, rules = type(proto.pieces[0]), proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError(f"{path}: only merge-type models without normalization are supported")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.names = [p.piece for p in proto.pieces]
        self.end = self.names.index(proto.trainer_spec.eos_piece or "</s>")
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL}
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.bytes = {b: i for i, b in self.byte_of.items()}
        self.unknown_surface = proto.trainer_spec.unk_surface
        ordinary = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces) or any(c not in ordinary for p in ordinary for c in p):
            raise ValueError(f"{path}: user-defined or unused pieces, or pieces of unlisted characters, are not supported")
        self.ids, self.scores = ordinary, {p: proto.pieces[i].score for p, i in ordinary.items()}
        self.whole = any(BLANK in p.lstrip(BLANK) for p in ordinary)  # pieces cross words: a text is one unit
        self.length = [len(n) if n in ordinary else 0 for n in self.names]
        self.shorter = [-1] * len(self.names)
        self.automaton = ahocorasick.Automaton()
        for piece, i in ordinary.items():
            self.automaton.add_word(piece, i)
            self.shorter[i] = next((ordinary[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in ordinary), -1)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.decimals = [b"%d" % i for i in range(len(self.names))]
        #: What each piece adds to a text in UTF-8, with its blanks.
        self.surface = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else self.unknown_surface.encode() if i == self.unknown else n.replace(BLANK, " ").encode() for i, n in enumerate(self.names)]

    def merged(self, text: str) -> list[str]:
        """The text's pieces by merging: the best score first, leftmost among equals. For the few characters of two neighbours."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: int, piece: int) -> bool:
        """Whether merging gives these two neighbours back; before is -1 at the start of a text."""
        key = (before + 1) << 32 | piece
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIR_ENTRIES:
                self.pairs.clear()
            wanted = [self.names[i] for i in (before, piece) if i >= 0]
            known = self.pairs[key] = self.merged("".join(wanted)) == wanted
        return known

    def encode_unit(self, unit: str) -> list[int]:
        longest = [-1] * len(unit)
        length = self.length
        for end, i in self.automaton.iter(unit):  # ends ascend, so the last match noted for a start is its longest
            longest[end + 1 - length[i]] = i
        if -1 not in longest:
            return self._backtrack(longest, 0, len(unit))
        out: list[int] = []
        at = 0
        while at < len(unit):
            stop = at
            while stop < len(unit) and longest[stop] >= 0:
                stop += 1
            if stop > at:
                out += self._backtrack(longest, at, stop)
            if stop < len(unit):
                raw = unit[stop].encode("utf-8", "surrogatepass")
                out += [self.bytes[b] for b in raw] if self.bytes else [self.unknown]
            at = stop + 1
        return out

    def _backtrack(self, longest: list[int], start: int, stop: int) -> list[int]:
        length, shorter, pairs = self.length, self.shorter, self.pairs
        failed = None  # the bitfield; most texts need none
        out: list[int] = []
        at, piece, before = start, longest[start], -1
        while True:
            end = at + length[piece]
            if failed is None or not failed[end - start >> 3] >> (end - start & 7) & 1:
                key = (before + 1) << 32 | piece
                if pairs[key] if key in pairs else self.compatible(before, piece):
                    out.append(piece)
                    if end == stop:
                        return out
                    at, before, piece = end, piece, longest[end]
                    continue
            piece = shorter[piece]
            while piece < 0:  # nothing fits here: shorten the piece before
                if failed is None:
                    failed = bytearray((stop - start >> 3) + 1)
                failed[at - start >> 3] |= 1 << (at - start & 7)
                gone = out.pop()
                at -= length[gone]
                piece, before = shorter[gone], out[-1] if out else -1

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        marked = self.prefix + text.replace(" ", BLANK)
        return [marked] if self.whole else UNIT.findall(marked)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: blanks back, one taken off the front where the model puts one there."""
        out, raw, first = [], bytearray(), bool(self.prefix)

        def flush() -> None:
            at = 0
            while at < len(raw):
                n = next((n for n in (1, 2, 3, 4) if _is_char(raw[at : at + n])), 0)
                out.append(raw[at : at + n].decode("utf-8") if n else "�")
                at += n or 1
            raw.clear()

        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                first = False
                continue
            flush()
            if i in self.control:
                continue
            name = self.unknown_surface if i == self.unknown else self.names[i]
            if first and name.startswith(BLANK):
                name = name[1:]
            first = False
            out.append(name.replace(BLANK, " "))
        flush()
        return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@functools.lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


class Memo(dict):
    """Units to values; `render` turns a unit's ids into what is kept of them.

    Two generations: when the younger is full, the older is dropped, so what is in use stays. Long units are not kept.
    """

    def __init__(self, model: PieceModel, render):
        super().__init__()
        self.model, self.render, self.older = model, render, {}

    def __missing__(self, unit: str):
        found = self.older.get(unit)
        if found is None:
            found = self.render(self.model.encode_unit(unit))
        if len(unit) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found

    def values(self, text: str | None) -> list:
        return list(map(self.__getitem__, self.model.units(text)))


_encoders: dict = {}


def encoder_for(path: str, render) -> Memo:
    """The worker's memo for this model and rendering; it outlives a task."""
    if (path, render) not in _encoders:
        _encoders.clear()
        _encoders[path, render] = Memo(model_at(path), render)
    return _encoders[path, render]


def with_ids(df: DataFrame, path: str, text: str = "text", out: str = "ids", end: bool = True) -> DataFrame:
    """df with the ids of its text as array<int>, with the end id behind them if `end`."""
    kept = [c for c in df.columns if c != out]
    schema = df.drop(out).schema.add(out, T.ArrayType(T.IntegerType()))
    at = df.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, tuple)
        tail = [encoder.model.end] if end else []
        for batch in slices(batches):
            ids = [[i for unit in encoder.values(t) for i in unit] + tail for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(ids, pa.list_(pa.int32()))], names=[*kept, out])

    return df.mapInArrow(encode, schema)


def with_text(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the decoded text of an array of ids; null ids decode to an empty text."""
    kept = [c for c in df.columns if c != out]
    schema = df.drop(out).schema.add(out, "string")
    at = df.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in slices(batches):
            texts = [model.decode(row or ()) for row in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, out])

    return df.mapInArrow(decode, schema)


class _Digest:
    """Renders the ids of a unit as their number, their decimals, and the UTF-8 that they decode to."""

    def __init__(self, path: str):
        self.path = path
        model = model_at(path)
        self.decimals, self.surface = model.decimals, model.surface

    def __eq__(self, other) -> bool:
        return type(other) is _Digest and other.path == self.path

    def __hash__(self) -> int:
        return hash(self.path)

    def __call__(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), b" ".join([self.decimals[i] for i in ids]), b"".join([self.surface[i] for i in ids])


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens and the SHA-256 of the ids, the end id among them, and of their decoding, from one pass that keeps no ids.

    What a unit's pieces add to the text can be joined: they come from whole characters, so their bytes are UTF-8, and only the first piece's blank goes.
    """
    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, _Digest(path))
        model = encoder.model
        cut = len(model.prefix)
        for batch in slices(batches):
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                sizes, numbers, words = zip(*found) if (found := encoder.values(text)) else ((), (), ())
                counts.append(sum(sizes) + 1)
                ids.append(hashlib.sha256(b" ".join((*numbers, b"%d" % model.end))).hexdigest())
                decoded.append(hashlib.sha256(b"".join(words)[cut:]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def op11_backtracking_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op11: one map over the documents, no shuffle."""
    return digests(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op11_backtracking_pieces": op11_backtracking_pieces}
