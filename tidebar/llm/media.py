"""Media columns: store bytes as 8-bit samples, and find out by signature what a media column really holds.

Sniffing. One Aho-Corasick automaton over the magic strings passes each payload once. Every hit goes
to its format's validator, which follows the structure (chunk lists, check sums, block lengths)
and returns the exact length or nothing; a hit that does not validate is no media. A validated hit at
offset 0 gives the column's true type, whatever was declared; hits inside are carved as embedded
media. Hits inside an embedded item that has been carved are skipped (outermost wins).

Storage. ``encode_samples`` pads bytes with zeros to a positive multiple of 64 and stores them as
unsigned 8-bit mono PCM in a RIFF/WAVE container, which is lossless; ``read_samples`` takes the
samples back from the validated container, not from the source.

Edge cases. Null payloads are empty: stored as 64 zero bytes. Types that are unknown or fail their
validator become ``application/octet-stream``. Equal bytes give equal values; repeated rows are kept;
empty tables give empty results; extra columns are ignored. Texts of any length are stored whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_small_batches

UNKNOWN = "application/octet-stream"
BLOCK, SAMPLE_RATE = 64, 8000

#: Magic strings (type, bytes, offset of the magic in the file).
SIGNATURES = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/bmp", b"BM", 0),
    ("audio/wav", b"WAVEfmt ", 8),
    ("image/webp", b"WEBPVP8", 8),
    ("audio/flac", b"fLaC", 0),
    ("audio/ogg", b"OggS", 0),
    ("audio/midi", b"MThd\x00\x00\x00\x06", 0),
    ("video/mp4", b"ftyp", 4),
    ("application/pdf", b"%PDF-", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
    ("application/zip", b"PK\x03\x04", 0),
]


def png_length(b: bytes, at: int) -> int | None:
    pos = at + 8
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + n
        if end > len(b) or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        pos = end
    return None


def gif_length(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos = blocks(pos + 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0))
        else:
            return None
    return None


def jpeg_length(b: bytes, at: int) -> int | None:
    pos, scanned = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at if scanned else None
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2:
            return None
        pos += 2 + n
        if mark == 0xDA:
            scanned = True
            while pos + 1 < len(b) and not (b[pos] == 0xFF and b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 1
    return pos + 2 - at if scanned and b[pos : pos + 2] == b"\xff\xd9" else None


def bmp_length(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    n, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return n if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= n <= len(b) - at else None


def riff_length(b: bytes, at: int, first: bytes) -> int | None:
    if b[at : at + 4] != b"RIFF" or at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, seen = at + 12, []
    while pos + 8 <= min(end, len(b)):
        kind, n = struct.unpack_from("<4sI", b, pos)
        seen.append(kind)
        pos += 8 + n + (n & 1)
    good = end <= len(b) and pos == end and seen and seen[0].startswith(first)
    return end - at if good and (first != b"fmt " or b"data" in seen) else None


def flac_length(b: bytes, at: int) -> int | None:
    """Frames carry no lengths: a stream with a sound list of metadata blocks reaches to the end."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        last, kind, n = b[pos] >> 7, b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if (first and (kind, n) != (0, 34)) or pos + 4 + n > len(b):
            return None
        pos, first = pos + 4 + n, False
        if last:
            return len(b) - at if b[pos : pos + 1] in (b"\xff", b"") else None
    return None


def ogg_length(b: bytes, at: int) -> int | None:
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b):
        n = b[pos + 26]
        size = 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if b[pos + 4] or pos + size > len(b):
            return None
        last = b[pos + 5] & 4
        pos += size
        if last:
            return pos - at
    return None


def midi_length(b: bytes, at: int) -> int | None:
    if at + 14 > len(b):
        return None
    tracks, pos = struct.unpack_from(">H", b, at + 10)[0], at + 14
    for _ in range(tracks):
        if b[pos : pos + 4] != b"MTrk" or pos + 8 > len(b):
            return None
        pos += 8 + struct.unpack_from(">I", b, pos + 4)[0]
    return pos - at if tracks and pos <= len(b) else None


def mp4_length(b: bytes, at: int) -> int | None:
    pos, kinds = at, []
    while pos + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if n < 8 or pos + n > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        pos += n
    return pos - at if kinds[:1] == [b"ftyp"] and len(kinds) > 1 else None


def pdf_length(b: bytes, at: int) -> int | None:
    """To the last end mark before another PDF begins: files that were added to have several."""
    other = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, other if other >= 0 else len(b))
    return end + 5 - at if end >= 0 and b.rfind(b"startxref", at, end) >= 0 else None


def gzip_length(b: bytes, at: int) -> int | None:
    """All members that follow each other."""
    end, pos = None, at
    while b[pos : pos + 3] == b"\x1f\x8b\x08":
        d, fed = zlib.decompressobj(31), pos
        try:
            while fed < len(b) and not d.eof:
                step = d.unconsumed_tail
                if not step:
                    step = b[fed : fed + (1 << 16)]
                    fed += len(step)
                d.decompress(step, 1 << 20)
            while not d.eof and d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
        except zlib.error:
            break
        if not d.eof:
            break
        end = pos = fed - len(d.unused_data)
    return None if end is None else end - at


def zip_length(b: bytes, at: int) -> int | None:
    """To the end record whose directory lies where it says; end records of stored archives inside do not agree."""
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if at + start + size == end and end + 22 + note <= len(b):
            return end + 22 + note - at
        end = b.find(b"PK\x05\x06", end + 4)
    return None


VALIDATORS = {
    "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "image/bmp": bmp_length,
    "audio/wav": lambda b, at: riff_length(b, at, b"fmt "), "image/webp": lambda b, at: riff_length(b, at, b"VP8"),
    "audio/flac": flac_length, "audio/ogg": ogg_length, "audio/midi": midi_length, "video/mp4": mp4_length,
    "application/pdf": pdf_length, "application/gzip": gzip_length, "application/zip": zip_length,
}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, magic, offset in SIGNATURES:
            self.automaton.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
        self.automaton.make_automaton()

    def items(self, b: bytes) -> list[tuple[str, int, int]]:
        """Validated media in ``b``, outermost first: (type, offset, length)."""
        hits = sorted((end + 1 - n - offset, kind) for end, (kind, n, offset) in self.automaton.iter(b.decode("latin-1")))
        found, behind = [], {False: 0, True: 0}
        for at, kind in hits:
            whole = at == 0
            if at < 0 or (not whole and at < behind[False]):
                continue
            n = VALIDATORS[kind](b, at)
            if n:
                found.append((kind, at, n))
                if not whole:
                    behind[False] = at + n
        return found


def wav_of(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVEfmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n) + payload


def wav_samples(b: bytes) -> bytes | None:
    """The samples of a validated container, else nothing."""
    if b[8:16] != b"WAVEfmt " or riff_length(b, 0, b"fmt ") is None:
        return None
    pos = 12
    while pos + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, pos)
        if kind == b"data":
            return b[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    return None


def encode_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, declared, media``: each text's bytes stored as 8-bit samples."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
            yield pd.DataFrame({"n_bytes": [len(b) for b in raw], "media": [wav_of(b + bytes(-len(b) % BLOCK if b else BLOCK)) for b in raw]})

    # The id stays in the JVM, as pandas has no null integers.
    stored = with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.pandas_udf(run, "n_bytes long, media binary")(text_col).alias("m"))
    return stored.select("doc_id", "m.n_bytes", F.lit("text/plain").alias("declared"), "m.media")


def sniff_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Corrects declared types and carves embedded media.

    In: an id, ``declared`` and ``media`` (and ``n_bytes``, passed through). Out: ``media_type``, ``items`` (type, offset, length, digest of the carved bytes; offsets
    count from the start of the stored bytes), sizes and digests of samples and container, and the sample statistics.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sniffer = Sniffer()
        for declarations, payloads in batches:
            rows = []
            for declared, b in zip(declarations, payloads):
                b = b if isinstance(b, bytes) else b""
                items = sniffer.items(b)
                kind = next((k for k, at, _ in items if at == 0), UNKNOWN)
                inner = [(k, at, n, sha256(b[at : at + n]).hexdigest()) for k, at, n in items if at]
                samples = wav_samples(b) if kind == "audio/wav" else None
                samples = b if samples is None else samples
                x = np.frombuffer(samples, dtype=np.uint8)
                mean, top = (float(x.mean()), int(x.max())) if len(x) else (0.0, 0)
                carved = ",".join(sorted(k for k, *_ in inner)) or "none"
                rows.append((
                    kind, declared != kind, inner, len(samples), sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]),
                    len(b), sha256(b).hexdigest(), f"{kind};carved={carved};mean={mean:.4f};max={top};zeros={int((x == 0).sum())}",
                ))
            yield pd.DataFrame(rows, columns=["media_type", "corrected", "items", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = (
        "media_type string, corrected boolean, items array<struct<type:string,offset:long,length:long,sha256:string>>, payload_bytes long, payload_sha256 string,"
        " tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    sniffed = media.select(F.col(id_col).cast("long").alias("doc_id"), "n_bytes", "declared", F.pandas_udf(run, schema)("declared", "media").alias("s"))
    return sniffed.select("doc_id", "n_bytes", "declared", "s.*")
