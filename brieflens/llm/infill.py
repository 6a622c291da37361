"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of a fixed number of code points
with the cumulative count after each frame.  A range of the text is read by
finding the frames that hold its ends, so a cut costs the decompression of one
frame; whole texts are streamed frame by frame into digests or into the frames
of the output.  A task holds the frames of one text, and one frame unpacked.

The two cuts and the form of a document come from the hash of its id:

    plain   the text (empty, holding a marker, or by lot)
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

Cases: null text counts as empty, and an empty text is plain; a text of any
length is a row of frames; texts with a marker stay plain, so markers in an
output are never ambiguous; a null id hashes as the empty string; repeated rows
give repeated rows; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

FRAME = 1 << 16  # code points in a frame
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)


@dataclass
class Frames:
    """A text as independent frames; ends[k] counts the code points up to the end of frame k."""

    frames: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def unpacked(self, k: int) -> str:
        return zstandard.ZstdDecompressor().decompress(self.frames[k]).decode()

    def pieces(self, start: int, end: int) -> Iterator[str]:
        """The text of code points start to end, frame by frame; frames outside stay packed."""
        k = bisect_right(self.ends, start)
        while start < end:
            low = self.ends[k - 1] if k else 0
            yield self.unpacked(k)[start - low:end - low]
            start = self.ends[k]
            k += 1


def packed(pieces: Iterable[str], size: int = FRAME) -> Frames:
    """Frames of `size` code points (the last may be shorter) of the text that the pieces make together."""
    out, waiting, held = Frames(), [], 0
    squeeze = zstandard.ZstdCompressor(level=LEVEL)

    def close(text: str) -> None:
        out.frames.append(squeeze.compress(text.encode()))
        out.ends.append(len(out) + len(text))

    for piece in pieces:
        at = 0
        while held + len(piece) - at >= size:
            room = size - held
            close("".join([*waiting, piece[at:at + room]]))
            at, waiting, held = at + room, [], 0
        if at < len(piece):
            waiting.append(piece[at:])
            held += len(piece) - at
    if held:
        close("".join(waiting))
    return out


def places(text: Frames, marker: str) -> Iterator[int]:
    """Code point positions of a marker, also where it lies across frames; frame by frame."""
    carry, at = "", 0
    for k in range(len(text.frames)):
        here = carry + text.unpacked(k)
        found = here.find(marker)
        while found >= 0:
            yield at + found
            found = here.find(marker, found + len(marker))
        keep = here[1 - len(marker):] if len(here) >= len(marker) else here
        at += len(here) - len(keep)
        carry = keep


@dataclass(frozen=True)
class Plan:
    """What becomes of a text of n code points."""

    form: str
    first: int | None = None  # end of the prefix
    second: int | None = None  # end of the middle


def planned(doc_id: object, text: Frames, seed: int = 1, kept_pct: int = 90, spm_pct: int = 20) -> Plan:
    """Form and cuts, by the hash of `seed:id`."""
    n = len(text)
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(name[8 * k:8 * k + 8], 16) for k in range(4))
    if not n or h3 % 100 >= kept_pct or any(next(places(text, m), None) is not None for m in MARKERS):
        return Plan("plain")
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Plan("spm" if h4 % 100 < spm_pct else "psm", a, b)


def output(text: Frames, plan: Plan) -> Iterator[str]:
    """The transformed text, piece by piece."""
    n = len(text)
    if plan.form == "plain":
        yield from text.pieces(0, n)
        return
    prefix, suffix = (PREFIX, 0, plan.first), (SUFFIX, plan.second, n)
    for marker, start, end in ([prefix, suffix] if plan.form == "psm" else [suffix, prefix]) + [(MIDDLE, plan.first, plan.second)]:
        yield marker
        yield from text.pieces(start, end)


def original(made: Frames, form: str) -> Iterator[str]:
    """The text that an output was made of, piece by piece, from the output and its form alone."""
    n = len(made)
    if form == "plain":
        yield from made.pieces(0, n)
        return
    at = {m: next(places(made, m)) for m in MARKERS}
    order = sorted(MARKERS, key=at.__getitem__)
    ends = {m: at[after] for m, after in zip(order, order[1:], strict=False)} | {order[-1]: n}
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from made.pieces(at[marker] + len(marker), ends[marker])


def digest(pieces: Iterable[str]) -> str:
    total = hashlib.sha256()
    for piece in pieces:
        total.update(piece.encode())
    return total.hexdigest()


# -- Spark ------------------------------------------------------------------------------------------------------------------
LISTS = (pa.list_(pa.binary()), pa.list_(pa.int64()))


def of_row(batch: pa.RecordBatch, at: int, k: int) -> Frames:
    return Frames(batch.column(at)[k].as_py(), batch.column(at + 1)[k].as_py())


def framed(docs: DataFrame, size: int = FRAME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, frames, ends: the texts in seekable form, to be written or used at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [packed([x.as_py()], size) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.frames for x in texts], LISTS[0]), pa.array([x.ends for x in texts], LISTS[1])],
                names=["doc_id", "frames", "ends"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, frames array<binary>, ends array<long>")


def transformed(frames: DataFrame, size: int = FRAME, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_frames, output_ends, output_sha256 of a `framed` table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                text = of_row(batch, 1, k)
                plan = planned(batch.column(0)[k].as_py(), text, seed)
                made = packed(output(text, plan), size)
                cut = plan.form != "plain"
                rows.append((len(text), plan.form, plan.first, plan.second - plan.first if cut else None, made.frames, made.ends,
                             digest(made.pieces(0, len(made)))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), *LISTS, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_frames", "output_ends", "output_sha256"])

    kind = frames.schema["doc_id"].dataType.simpleString()
    return frames.select("doc_id", "frames", "ends").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_frames array<binary>, "
             "output_ends array<long>, output_sha256 string")


def restored(made: DataFrame) -> DataFrame:
    """The columns of `transformed` but the frames, and restored_sha256: of the text rebuilt from output and form."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again = [digest(original(of_row(batch, len(names), k), batch.column(2)[k].as_py())) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), pa.array(again, pa.string())],
                                             names=[*names, "restored_sha256"])

    kind = made.schema["doc_id"].dataType.simpleString()
    return made.select(*names, "output_frames", "output_ends").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS lot, CAST('0x' || h[25:32] AS BIGINT) % 100 AS way FROM t),
p AS (
  SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR lot >= 90 THEN 'plain'
              WHEN way < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM o
"""
