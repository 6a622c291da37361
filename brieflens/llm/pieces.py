"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

The last token of a prefix's encoding is unique.  For each prefix of a segment
an automaton lists the vocabulary pieces that end there; the one whose pair with
the last token of the prefix before it stays two tokens when merged by rank is
the entry of the table.  The ids are read off backwards.  A character outside
the vocabulary stands alone as its UTF-8 byte tokens and ends what can merge.

No piece holds a space mark after another character (tested when the model is
loaded), so the text before each run of marks is encoded on its own; encodings
of segments are kept in a bounded table.

Cases: a null text is an empty text and encodes to the end id alone; texts of
any length are encoded whole; a text may hold any characters, the mark included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MARK = "▁"
KEPT_SEGMENTS = 600_000  # entries of a worker's table before it starts anew
KEPT_PAIRS = 1_000_000
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def strict_text(data: bytes) -> str:
    """UTF-8 text; each byte that belongs to no character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return re.sub("[\ud800-\udfff]", "\ufffd", data.decode(errors="surrogateescape"))


class Segments(dict):
    """Segment without its mark -> ids, filled on demand; when full, the older half goes."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.codec.encode_segment(MARK + word)
        if len(self) >= KEPT_SEGMENTS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class PieceCodec:
    """One vocabulary; `encode` and `decode` agree with the sentencepiece library on the same file."""

    def __init__(self, model_file: str):
        source = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(source.get_piece_size())
        self.end = source.eos_id()
        self.pieces = [source.id_to_piece(i) for i in ids]
        special = [source.is_control(i) or source.is_unknown(i) for i in ids]
        if any(source.is_unused(i) for i in ids) or source.normalize("a  ﬁ\t") != f"{MARK}a{MARK}{MARK}ﬁ\t":
            raise ValueError("a vocabulary with unused pieces or text normalisation is not read here")
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in ids if source.is_byte(i)}
        plain = [i for i in ids if not special[i] and not source.is_byte(i)]
        self.index = {self.pieces[i]: i for i in plain}
        self.score = [source.get_score(i) for i in ids]
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in plain) or len(self.byte_id) != 256:
            raise ValueError("pieces with an inner space mark, or no byte pieces")
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self.raw = [b"" if special[i] else self.pieces[i].replace(MARK, " ").encode() for i in ids]
        for byte, i in self.byte_id.items():
            self.raw[i] = bytes([byte])
        self.number = [str(i) for i in ids]
        self.raw[source.unk_id()] = " ⁇ ".encode()
        self.length = [len(x) for x in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.alone = [i in self.byte_id.values() or special[i] or self.merged(self.pieces[i]) == [i] for i in ids]
        self.segments = Segments(self)

    def merged(self, text: str) -> list[int | None]:
        """Ids after merging by rank, pair by pair: the definition, for the short strings of the pair test."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.index.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.index.get(x) for x in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Do two neighbouring tokens stay as they are?  Kept in `pairs` under one number."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def encode_segment(self, text: str) -> tuple[int, ...]:
        """Ids of a text that no token leaves."""
        pairs, alone, length = self.pairs, self.alone, self.length
        table: list[int | None] = [None] * (len(text) + 1)  # last token of each prefix; None: a character without a piece
        start = end = 0  # where the run of characters with pieces began; the prefix at work
        for last, i in self.automaton.iter(text):  # by end, the longest piece first
            if last >= end:
                if last > end:
                    start = last
                end = last + 1
            elif table[end] is not None:
                continue
            before = end - length[i]
            if before <= start:
                fits = before == start and alone[i]
            else:
                left = table[before]
                fits = pairs.get(left << 20 | i)
                if fits is None:
                    fits = self.compatible(left, i)
            if fits:
                table[end] = i
        ids: list[int] = []
        end = len(text)
        while end:
            i = table[end]
            if i is None:
                ids.extend(self.byte_id[b] for b in reversed(text[end - 1].encode()))
                end -= 1
            else:
                ids.append(i)
                end -= length[i]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the end id."""
        if not text:
            return [self.end]
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            words = text.split(" ")
        else:
            words, found = [], SEGMENT.findall(MARK + text.replace(" ", MARK))
            words = [x[1:] for x in found]
        ids = list(chain.from_iterable(map(self.segments.__getitem__, words)))
        ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the first one is dropped, bytes that are no UTF-8 become U+FFFD each."""
        parts = list(map(self.raw.__getitem__, ids[:-1] if ids and ids[-1] == self.end else ids))
        if all(parts):
            runs = [b"".join(parts)]
        else:  # a control token ends a run of byte tokens
            runs = [b"".join(run) for _, run in groupby(parts, bool)]
        text = "".join(map(strict_text, runs))
        first = next((i for i in ids if self.raw[i]), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec per worker process and vocabulary file."""
    return PieceCodec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int, end id last)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_file)
        for batch in batches:
            made = pa.array([tool.encode(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_file)
        for batch in batches:
            made = pa.array([tool.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "text"])

    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass, without moving ids or decoded texts out of the worker."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_file)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = tool.encode(text.as_py() or "")
                rows.append((len(ids), sha(" ".join(map(tool.number.__getitem__, ids))), sha(tool.decode(ids))))
            made = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
