"""Telephony audio in media columns: WAVE files of mu-law, A-law and IMA ADPCM samples, decoded and resampled to PCM.

Mu-law and A-law bytes expand through 256-entry tables. ADPCM blocks are independent: numpy decodes the same
nibble of all blocks of a batch at once, so the loop runs over a block's samples and not over the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches, id_and_text

#: A payload is a whole number of these.
UNIT = 576
FILL = 255
RATE, OUT_RATE = 8000, 16000
#: Bytes of nibbles in an ADPCM block, behind a header of 4.
BLOCK = 144
ULAW, ALAW, ADPCM = 7, 6, 17
CODECS = (ULAW, ALAW, ADPCM)
NAMES = {ULAW: "mu-law", ALAW: "a-law", ADPCM: "ima-adpcm"}
#: Bytes of payload decoded at a time.
STEP = 1 << 20


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    x = ~np.arange(256) & 255
    size = (((x & 15) << 3) + 132 << (x >> 4 & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit inverted, sign, 3 bits of exponent, 4 of mantissa."""
    x = np.arange(256) ^ 0x55
    low, e = (x & 15) << 4, x >> 4 & 7
    size = np.where(e == 0, low + 8, low + 264 << np.maximum(e - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


# Fixed values of IMA ADPCM: the step sizes and the moves of the step index by the low three bits of a code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

_TABLES = {ULAW: mulaw_table(), ALAW: alaw_table()}


def adpcm_samples(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (a row each, with its header: first sample, step index, 0), decoded across blocks."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(data) + 1, len(blocks)), np.int16)
    out[0] = value = head
    for k in range(2 * len(data)):
        code = (data[k >> 1] >> (4 * (k & 1)) & 15).astype(np.int32)
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def padded(text: bytes) -> bytes:
    """A text's payload: the bytes and FILL up to a positive multiple of UNIT."""
    return text + bytes([FILL]) * (max(-(-len(text) // UNIT), 1) * UNIT - len(text))


def wave(codec: int, data: bytes, *, rate: int, bits: int, align: int, per_block: int | None = None, samples: int | None = None) -> bytes:
    """A WAVE file with one channel."""
    extra = b"" if per_block is None else struct.pack("<H", per_block)
    second = rate * bits // 8 if per_block is None else rate * align // per_block
    fmt = struct.pack("<HHIIHH", codec, 1, rate, second, align, bits) + (struct.pack("<H", len(extra)) + extra if codec != 1 else b"")
    fact = b"" if samples is None else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def stored(payload: bytes, codec: int) -> bytes:
    """The WAVE file that holds a payload as samples: a byte each, or two nibbles of an ADPCM block."""
    if codec != ADPCM:
        return wave(codec, payload, rate=RATE, bits=8, align=1, samples=len(payload))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    blocks = np.zeros((len(rows), BLOCK + 4), np.uint8)
    blocks[:, 4:] = rows
    return wave(ADPCM, blocks.tobytes(), rate=RATE, bits=4, align=BLOCK + 4, per_block=2 * BLOCK + 1, samples=len(rows) * (2 * BLOCK + 1))


def read_wave(media: bytes) -> tuple[int, int, bytes]:
    """Codec, block size and data of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, align = 12, None, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, _, _, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return codec, align, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def payload_of(codec: int, align: int, data: bytes) -> bytes:
    """The bytes that `stored` put in."""
    return data if codec != ADPCM else np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


def doubled(samples: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Twice the rate: between each two samples of a clip the 4-point cubic mean, (-1, 9, 9, -1) / 16; ends repeat."""
    n = len(samples)
    before, after, beyond = np.arange(n) - 1, np.arange(n) + 1, np.arange(n) + 2
    first, last = bounds[:-1], bounds[1:] - 1
    before[first] = first
    after[last] = last
    beyond[last] = last
    inner = last[last > first]
    beyond[inner - 1] = inner
    x = samples.astype(np.int32)
    out = np.empty(2 * n, np.int16)
    out[::2] = samples
    out[1::2] = np.clip((9 * (x + x[after]) - x[before] - x[beyond] + 8) >> 4, -32768, 32767)
    return out


def decode(media: list[bytes]) -> list[tuple[bytes, bytes, str]]:
    """Of each WAVE file the payload read back, its sound as a 16-bit PCM WAVE file at twice the rate, and features."""
    parts = [read_wave(m) for m in media]
    adpcm = [k for k, p in enumerate(parts) if p[0] == ADPCM]
    clips: list[np.ndarray] = [_TABLES[c][np.frombuffer(d, np.uint8)] if c in _TABLES else np.empty(0, np.int16) for c, _, d in parts]
    for align in {parts[k][1] for k in adpcm}:
        own = [k for k in adpcm if parts[k][1] == align]
        rows = np.frombuffer(b"".join(parts[k][2] for k in own), np.uint8).reshape(-1, align)
        samples, at = adpcm_samples(rows), 0
        for k in own:
            n = len(parts[k][2]) // align
            clips[k], at = samples[at : at + n].ravel(), at + n
    bounds = np.cumsum([0, *map(len, clips)])
    pcm = doubled(np.concatenate(clips), bounds)
    out = []
    for (codec, align, data), x, a, b in zip(parts, clips, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        sound = wave(1, pcm[2 * a : 2 * b].tobytes(), rate=OUT_RATE, bits=16, align=2)
        rms = int(np.sqrt(np.mean(np.square(x, dtype=np.float64))))
        turns = int(np.count_nonzero((x[1:] ^ x[:-1]) < 0))
        out.append((payload_of(codec, align, data), sound, f"{NAMES[codec]};{len(x)};rms={rms};crossings={turns};peak={int(np.abs(x.astype(np.int32)).max())}"))
    return out


def store_telephony(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's payload in a WAVE file whose codec the payload's checksum picks.

    Null and empty texts are one unit of fill; equal texts and repeated rows have equal files; ids may be null or repeat;
    a text goes whole into one file, so its file must fit a row; an empty table gives no row. Other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            media = [stored(p, CODECS[zlib.crc32(p) % 3]) for p in map(padded, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def decode_telephony(stored_media: DataFrame) -> DataFrame:
    """The table of store_telephony with payload, pcm (a WAVE file) and feature, from the stored bytes alone.

    A null file gives nulls; repeated rows repeat; an empty table gives no row. A file's sound has up to 8 bytes for a
    byte of payload, and a row of Spark ends at 2 GB, so texts go up to about 200 MB; a longer one ends the job.
    """
    bound_batches(stored_media.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("media").to_pylist()
            ids, sizes = batch.column("doc_id"), batch.column("n_bytes")
            at = 0
            while at < len(media):
                end, size = at, 0
                while end < len(media) and (end == at or size + len(media[end] or b"") <= STEP):
                    size, end = size + len(media[end] or b""), end + 1
                known = [m for m in media[at:end] if m is not None]
                found = iter(decode(known) if known else ())
                rows = [(None, None, None) if m is None else next(found) for m in media[at:end]]
                payload, pcm, feature = (pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.string()), strict=True))
                part = slice(at, end)
                yield pa.RecordBatch.from_arrays([ids[part], sizes[part], pa.array(media[at:end], pa.binary()), payload, pcm, feature], ["doc_id", "n_bytes", "media", "payload", "pcm", "feature"])
                at = end

    return stored_media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, media binary, payload binary, pcm binary, feature string")


def media_digests(media: DataFrame) -> DataFrame:
    """The columns of the contract; the feature closes with the checksum of the resampled sound."""
    tail = F.crc32(F.expr("substring(payload, -32, 32)"))
    feature = F.concat_ws(";", "feature", F.concat(F.lit("pcm="), F.hex(F.crc32("pcm"))))
    return media.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
