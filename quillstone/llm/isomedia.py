"""ISO base media files: write, walk and index them without decoding a payload.

The writer stores bytes as one track of uncompressed 8-bit mono samples. The reader
walks the nested boxes of any such file, decodes the sample tables and gives codec,
duration and the byte ranges of the key frames; it never looks inside the samples. Movie
fragments (moof) are passed over, and edit lists don't shift or cut what is reported.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes, and how many bytes of fields come before those.
NESTED = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "dinf": 0, "edts": 0, "udta": 0, "stsd": 8}
#: Samples a second of the stored track, bytes of a sample, samples of a chunk.
RATE, SAMPLE, CHUNK = 8000, 64, 1024
UNIT = 64


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind.encode()) + body
    return struct.pack(">I4sQ", 1, kind.encode(), len(body) + 16) + body


def full(kind: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, rate: int = RATE, sample: int = SAMPLE, chunk: int = CHUNK) -> bytes:
    """A file whose only track holds payload in samples of equal size, in chunks of up to chunk samples.

    The first sample of each chunk is marked as a key frame. The length of payload has to
    be a multiple of sample.
    """
    count, rest = divmod(len(payload), sample)
    if rest:
        raise ValueError(f"payload of {len(payload)} bytes is no multiple of {sample}")
    chunks = -(-count // chunk)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = count * sample
    ftyp = box("ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ", b"isom")
    entry = box("raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16))
    runs = [(1, chunk)] if count >= chunk else []
    if count % chunk:
        runs.append((chunks, count % chunk))

    def moov(data_at: int) -> bytes:
        offsets = [data_at + i * chunk * sample for i in range(chunks)]
        wide = data_at + length >= 1 << 32
        table = full("co64", struct.pack(f">I{chunks}Q", chunks, *offsets)) if wide else full("stco", struct.pack(f">I{chunks}I", chunks, *offsets))
        stbl = box(
            "stbl",
            full("stsd", struct.pack(">I", 1), entry),
            full("stts", struct.pack(">III", 1, count, sample)),
            full("stss", struct.pack(f">I{chunks}I", chunks, *(1 + i * chunk for i in range(chunks)))),
            full("stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
            full("stsz", struct.pack(">II", sample, count)),
            table,
        )
        minf = box("minf", full("smhd", bytes(4)), box("dinf", full("dref", struct.pack(">I", 1), full("url ", flags=1))), stbl)
        mdia = box("mdia", full("mdhd", struct.pack(">QQIQHH", 0, 0, rate, length, 0x55C4, 0), version=1), full("hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full("tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3)
        mvhd = full("mvhd", struct.pack(">QQIQIH10x", 0, 0, rate, length, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box("moov", mvhd, box("trak", tkhd, mdia))

    header = 8 if length + 8 < 1 << 32 else 16
    data_at = len(ftyp) + len(moov(0)) + header
    if data_at + length >= 1 << 32:
        data_at = len(ftyp) + len(moov(1 << 32)) + header
    return b"".join((ftyp, moov(data_at), box("mdat", payload)))


def walk(data: memoryview, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """Path, start and end of the body of every box, parents first. Raises ValueError at a box that overruns its parent."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError(f"cut off box at {start}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box at {start} has size {size}; its parent ends at {end}")
        name = kind.decode("latin-1")
        here = f"{path}/{name}"
        yield here, body, start + size
        if name in NESTED:
            yield from walk(data, body + NESTED[name], start + size, here)
        start += size


def _table(data: memoryview, at: int, end: int, fmt: str, skip: int = 4) -> list[tuple]:
    """The rows of a counted table; skip: bytes before the count."""
    (n,) = struct.unpack_from(">I", data, at + skip)
    first, row = at + skip + 4, struct.calcsize(f">{fmt}")
    if first + n * row > end:
        raise ValueError(f"table at {at} has {n} rows, more than its box")
    return list(struct.iter_unpack(f">{fmt}", data[first : first + n * row]))


def _compact(data: memoryview, at: int, end: int, bits: int, n: int) -> list[int]:
    """n sizes of 4, 8 or 16 bits each; of two in a byte the upper comes first."""
    if bits not in (4, 8, 16) or at + -(-n * bits // 8) > end:
        raise ValueError(f"table at {at} has {n} sizes of {bits} bits, which its box can't hold")
    if bits == 4:
        return [x for b in data[at : at + -(-n // 2)] for x in (b >> 4, b & 15)][:n]
    return list(struct.unpack_from(f">{n}{'B' if bits == 8 else 'H'}", data, at))


def tracks(data: bytes) -> list[dict]:
    """codec, handler, timescale, duration, samples, and spans and keyframes as (offset, bytes), of each track.

    A span is a stretch of samples that lie together; neighbouring chunks are one span.
    Files without a moov box have no tracks.
    """
    view, found = memoryview(data), []
    for path, at, end in walk(view):
        kind = path.rpartition("/")[2]
        if path == "/moov/trak":
            found.append({"codec": "", "handler": "", "timescale": 0, "duration": 0, "stts": [], "stss": None, "stsc": [], "sizes": (0, 0), "offsets": []})
        if not found:
            continue
        track = found[-1]
        if path.startswith("/moov/trak/mdia/minf/stbl/stsd/") and not track["codec"]:
            track["codec"] = kind
        elif kind == "hdlr" and path.startswith("/moov/trak/mdia/"):
            track["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
        elif kind == "mdhd":
            track["timescale"], track["duration"] = struct.unpack_from(">IQ", view, at + 20) if view[at] else struct.unpack_from(">II", view, at + 12)
        elif kind == "stts":
            track["stts"] = _table(view, at, end, "II")
        elif kind == "stss":
            track["stss"] = [x for (x,) in _table(view, at, end, "I")]
        elif kind == "stsc":
            track["stsc"] = _table(view, at, end, "III")
        elif kind == "stsz":
            same, n = struct.unpack_from(">II", view, at + 4)
            track["sizes"] = (same, n) if same else [x for (x,) in _table(view, at, end, "I", 8)]
        elif kind == "stz2":
            bits, n = struct.unpack_from(">BI", view, at + 7)
            track["sizes"] = _compact(view, at + 12, end, bits, n)
        elif kind in ("stco", "co64"):
            track["offsets"] = [x for (x,) in _table(view, at, end, "I" if kind == "stco" else "Q")]
    return [_placed(t) for t in found]


def _placed(track: dict) -> dict:
    """The byte ranges that the sample tables give."""
    sizes, runs = track["sizes"], track["stsc"]
    same = sizes[0] if isinstance(sizes, tuple) else None
    total = sizes[1] if same is not None else len(sizes)
    keys = iter(track["stss"] if track["stss"] is not None else range(1, total + 1))
    key, sample, run, spans, keyframes = next(keys, None), 0, 0, [], []
    for number, offset in enumerate(track["offsets"], 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= number:
            run += 1
        n = min(runs[run][1], total - sample) if runs else 0
        length = n * same if same is not None else sum(sizes[sample : sample + n])
        while key is not None and key <= sample + n:
            before = key - 1 - sample
            keyframes.append((offset + (before * same if same is not None else sum(sizes[sample : key - 1])), same if same is not None else sizes[key - 1]))
            key = next(keys, None)
        if spans and sum(spans[-1]) == offset:
            spans[-1] = (spans[-1][0], spans[-1][1] + length)
        else:
            spans.append((offset, length))
        sample += n
    return {k: track[k] for k in ("codec", "handler", "timescale", "duration")} | {"samples": total, "ticks": sum(n * d for n, d in track["stts"]), "spans": spans, "keyframes": keyframes}


def payload_of(data: bytes, track: dict) -> bytes:
    """The track's stored bytes."""
    return b"".join(data[at : at + n] for at, n in track["spans"])


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """raw with zero bytes up to a positive multiple of unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def feature(track: dict) -> str:
    """What the index stores of a track: codec, handler, ticks, samples, key frames and their ranges' checksum."""
    ranges = b"".join(struct.pack(">QQ", *x) for x in track["keyframes"])
    return f"{track['codec'].strip()} {track['handler']} {track['duration']}/{track['timescale']} samples={track['samples']} keys={len(track['keyframes'])} first={track['keyframes'][0][0]}+{track['keyframes'][0][1]} ranges={zlib.crc32(ranges)}"


STORED = "doc_id long, n_bytes long, media binary"
INDEXED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframes array<struct<start:long,bytes:long>>"


def media_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each row's text stored as a media file, read back and indexed.

    Null texts count as empty; the payload of an empty text is one unit of zeros. Each row
    is handled by itself: repeated rows and null doc_ids pass through, equal texts give
    equal values, an empty table gives no rows and other columns are ignored. A text of any
    length is one file, and keyframes holds a range for each of its chunks.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                media = mux(padded(raw))
                (track,) = tracks(media)
                stored = payload_of(media, track)
                rows.append((ident, len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(track), track["codec"].strip(), track["duration"] / track["timescale"], [{"start": a, "bytes": n} for a, n in track["keyframes"]]))
            schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())])))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    return whole.mapInArrow(index, INDEXED)
