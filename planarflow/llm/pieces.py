"""SentencePiece BPE encoding through a prefix table, and decoding.

For each prefix of a text the last piece of that prefix's encoding is unique. The table is filled left to right: the
vocabulary's automaton gives every piece that ends at a position, and the one that is compatible with the last piece of the
prefix before it is stored. Two pieces are compatible if the merges, run on the two of them joined, give just these two
again. The ids are recovered from the end of the table backwards. Each character is visited once, however long the text.

Nulls and empty texts give no pieces, so the end id alone. Very long texts need memory in proportion to their longest run
without a space. Rows are handled one by one: repeated rows give equal rows, an empty table gives an empty table, further
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, tokenizer_path, trim

SPACE = "▁"
#: Chunks that a Python worker remembers, and as many of those before; rare ones are forgotten, results stay the same.
REMEMBERED = 150_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]*")
_ROOT, _UNKNOWN = -2, -1


class PieceCodec:
    """Encoder and decoder for a SentencePiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.end_id = lib.eos_id()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        odd = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.rank = {self.pieces[i]: lib.get_score(i) for i in range(size) if i not in odd}
        self.length = [len(p) for p in self.pieces]
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("the model has pieces that cross a space")
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if i not in odd:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.raw = [b"" if i in odd else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for value, i in self.byte_ids.items():
            self.raw[i] = bytes([value])
        self.text_of = [str(i) for i in range(size)]
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        for probe in ("ﬁ  a b c ", "x́Å\tA\n"):
            if self.encode(probe, end=False) != lib.encode(probe):
                raise ValueError("the model normalises texts; only identity is supported")

    def merged(self, text: str) -> list[str]:
        """The merges on a short string: best score first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: int, piece: int) -> bool:
        """Whether piece can follow before in an encoding; before may be the start or a character without a piece."""
        right = self.pieces[piece]
        if before < 0:
            return self.merged(right) == [right]
        left = self.pieces[before]
        return self.merged(left + right) == [left, right]

    def _chunk(self, s: str) -> tuple[int, ...]:
        """Ids of a chunk that no merge leaves."""
        n, pairs, length = len(s), self._pairs, self.length
        last: list[int | None] = [None] * (n + 1)
        last[0] = _ROOT
        done = 0
        for end, piece in self.automaton.iter(s):
            end += 1
            while done < end - 1:
                done += 1
                if last[done] is None:
                    last[done] = _UNKNOWN
            if last[end] is not None:
                continue
            before = last[end - length[piece]]
            key = (before + 2) << 20 | piece
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) > 4 * REMEMBERED:
                    pairs.clear()
                fits = pairs[key] = self.compatible(before, piece)
            if fits:
                last[end] = piece
        out: list[int] = []
        at = n
        while at:
            piece = last[at]
            if piece is None or piece < 0:
                out.extend(self.byte_ids[b] for b in reversed(s[at - 1].encode()))
                at -= 1
            else:
                out.append(piece)
                at -= length[piece]
        out.reverse()
        return tuple(out)

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        """Ids of a whole text, with the end id."""
        out: list[int] = []
        if text:
            if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
                chunks: Iterable[str] = [c for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if c]
            else:
                chunks = map(SPACE.__add__, text.split(" "))
            known, extend = self._known, out.extend
            for c in chunks:
                ids = known.get(c)
                if ids is None:
                    ids = self._older.get(c)
                    if ids is None:
                        ids = self._chunk(c)
                    if len(c) < 64:
                        if len(known) >= REMEMBERED:
                            self._older, known = known, {}
                            self._known = known
                        known[c] = ids
                extend(ids)
        if end:
            out.append(self.end_id)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: control ids vanish, bytes are joined, the space put before a text is taken off."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model: str | None = None, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text; a narrow pass without a shuffle.

    Returns key, n_tokens, ids_sha256 and decoded_sha256, with keep_ids also ids (array of int) and decoded."""
    path = model or tokenizer_path("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        spell = c.text_of.__getitem__
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                ids = c.encode(value.as_py())
                back = c.decode(ids)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(" ".join(map(spell, ids)).encode()).hexdigest())
                rows[2].append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    rows[3].append(ids)
                    rows[4].append(back)
            columns = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    return docs.select(key, text).mapInArrow(run, schema)
