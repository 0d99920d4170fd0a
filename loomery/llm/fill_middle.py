"""Fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME`` bytes with, for each frame, its code points and the units
(words with the blanks before them) that end before it. A cut after k units is found by the counts; only the frame that holds
it is decompressed. Whole frames between two cuts go to the output as they are, so a text of any length is rearranged,
digested and restored with one decompressed frame in memory.

A unit ends where a blank follows a non-blank and at the end of the text. Blanks are U+0020 and U+0009 to U+000D.

Edge cases: a null text is an empty one (no frames, no units, form ``plain``); a text of blanks is one unit. A null id is hashed as
an empty string. Repeated rows are treated one by one, each row decides for itself; an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Segments in output order, by form: the marker before each and its number (0 prefix, 1 middle, 2 suffix).
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FRAME_TYPE = "struct<data:binary,chars:bigint,units_before:bigint,after_word:boolean>"


def code_points(data: bytes) -> int:
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def unit_ends(data: bytes, after_word: bool) -> np.ndarray:
    """Offsets in ``data`` where a unit ends and the next one begins; ``after_word``: a non-blank stands before ``data``."""
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    before = np.empty_like(blank)
    before[:1], before[1:] = not after_word, blank[:-1]
    return np.flatnonzero(blank & ~before)


def cut_frames(text: bytes, size: int = FRAME) -> tuple[int, list[dict]]:
    """Number of units, and the frames of a UTF-8 text; no frame parts a code point."""
    frames, units, at, after_word = [], 0, 0, False
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        data = text[at:end]
        frames.append({"data": pack(data), "chars": code_points(data), "units_before": units, "after_word": after_word})
        units += len(unit_ends(data, after_word))
        at, after_word = end, not _BLANK[data[-1]]
    return units + bool(text), frames


def _split(frames: list[dict], units: int, k: int) -> tuple[int, int, int]:
    """Where the text is cut after its first ``k`` units: frame, byte in it, code points before. Decompresses one frame at most."""
    if k <= 0 or not frames:
        return 0, 0, 0
    if k >= units:
        return len(frames), 0, sum(f["chars"] for f in frames)
    low = int(np.searchsorted([f["units_before"] for f in frames], k)) - 1  # the last frame with fewer units before it
    f = frames[low]
    data = zstandard.ZstdDecompressor().decompress(f["data"])
    byte = int(unit_ends(data, f["after_word"])[k - 1 - f["units_before"]])
    return low, byte, sum(x["chars"] for x in frames[:low]) + code_points(data[:byte])


def _segment(frames: list[dict], start: tuple[int, int, int], stop: tuple[int, int, int]) -> Iterator[bytes]:
    """Compressed frames of the text between two cuts; only the cut frames are compressed anew."""
    pack, unpack = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
    for i in range(start[0], min(len(frames), stop[0] + 1)):
        low, high = start[1] if i == start[0] else 0, stop[1] if i == stop[0] else None
        if high == 0 or (i == start[0] == stop[0] and low == high):
            continue
        yield frames[i]["data"] if not low and high is None else pack(unpack(frames[i]["data"])[low:high])


def rearrange(frames: list[dict], units: int, first: int, second: int, form: str) -> tuple[list[bytes], int | None, int | None]:
    """The output's frames in order, and the code points of prefix and middle. The prefix ends after ``first`` units, the middle after ``second``."""
    if form == "plain":
        return [f["data"] for f in frames], None, None
    a, b = _split(frames, units, first), _split(frames, units, second)
    bounds, pack = ((0, 0, 0), a, b, (len(frames), 0, 0)), zstandard.ZstdCompressor(level=LEVEL).compress
    out = [x for marker, k in ORDERS[form] for x in (pack(marker), *_segment(frames, bounds[k], bounds[k + 1]))]
    return out, a[2], b[2] - a[2]


def _markers_at(output: list[bytes], form: str) -> tuple[list[int], list[int]]:
    """Byte offsets of the form's markers in the output, wherever frames part them, and the offset at which each frame begins."""
    unpack, found, starts, tail, base = zstandard.ZstdDecompressor().decompress, [], [0], b"", 0
    for frame in output:
        data, at = tail + (new := unpack(frame)), 0
        starts.append(starts[-1] + len(new))
        while len(found) < len(ORDERS[form]):
            marker = ORDERS[form][len(found)][0]
            if (i := data.find(marker, at)) < 0:
                break
            found.append(base + i)
            at = i + len(marker)
        kept = max(at, len(data) - len(PREFIX) + 1)
        tail, base = data[kept:], base + kept
    return found, starts


def restore(output: list[bytes], form: str) -> Iterator[bytes]:
    """The text's bytes in order, from nothing but the output's frames and the form; one decompressed frame at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    if form == "plain":
        yield from (unpack(x) for x in output)
        return
    found, starts = _markers_at(output, form)
    order = ORDERS[form]
    ranges = {k: (at + len(marker), stop) for (marker, k), at, stop in zip(order, found, [*found[1:], starts[-1]], strict=True)}
    for _, (low, high) in sorted(ranges.items()):
        i = int(np.searchsorted(starts, low, side="right")) - 1
        while i < len(output) and starts[i] < high:
            yield unpack(output[i])[max(0, low - starts[i]) : high - starts[i]]
            i += 1


def digest(blocks: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for b in blocks:
        h.update(b)
    return h.hexdigest()


def decode(frames: list[bytes]) -> str:
    return b"".join(map(zstandard.ZstdDecompressor().decompress, frames)).decode("utf-8", "replace")


def compress(documents: DataFrame, frame: int = FRAME) -> DataFrame:
    """doc_id, n (units), marked (a marker stands in the text) and frames of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.contains(text, F.lit("<P>")) | F.contains(text, F.lit("<S>")) | F.contains(text, F.lit("<M>"))
    rows = documents.select("doc_id", marked.alias("marked"), text.cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut_frames(t.as_py(), frame) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in done], pa.int64()), pa.array([f for _, f in done], _ARROW_FRAMES)], ["doc_id", "marked", "n", "frames"])

    return rows.mapInArrow(cut, f"doc_id {kind}, marked boolean, n bigint, frames array<{_FRAME_TYPE}>")


_ARROW_FRAMES = pa.list_(pa.struct([("data", pa.binary()), ("chars", pa.int64()), ("units_before", pa.int64()), ("after_word", pa.bool_())]))


def store(documents: DataFrame, path: str, frame: int = FRAME) -> DataFrame:
    """Writes the frames of every row below ``path`` and reads them back."""
    compress(documents, frame).write.parquet(path)
    spark: SparkSession = documents.sparkSession
    return spark.read.parquet(path)


def choose(frames: DataFrame, seed: int = 42, middle_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Adds form, first and second (units before the two cuts) from a hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    number = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    form = F.when((F.col("n") == 0) | F.col("marked") | (number[2] % 100 >= middle_percent), "plain").when(number[3] % 100 < spm_percent, "spm").otherwise("psm")
    a, b = number[0] % (F.col("n") + 1), number[1] % (F.col("n") + 1)
    return frames.select("doc_id", "n", "frames", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def transform(chosen: DataFrame, outputs: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of ``choose``'s rows; with ``outputs`` also the output's frames."""
    kind = chosen.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * outputs]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            done = []
            for n, frames, form, first, second in zip(*(batch.column(c) for c in ("n", "frames", "form", "first", "second")), strict=True):
                out, prefix, middle = rearrange(frames.as_py(), n.as_py(), first.as_py(), second.as_py(), form.as_py())
                done.append((prefix, middle, digest(map(unpack, out)), digest(restore(out, form.as_py())), out))
            columns = list(zip(*done, strict=True)) or [()] * 5
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("form"), *made[: 4 + outputs]], names)

    return chosen.mapInArrow(apply, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + ", output array<binary>" * outputs)
