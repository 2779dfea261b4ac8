"""Reading and rewriting metadata inside JPEG, PNG, WebP, HEIF, PDF, MP4, MP3 and Ogg bytes, with the standard library only.

``read(mime, data)`` gives (key, value) pairs; ``rewrite(mime, data, ...)`` gives new bytes. Both raise :class:`CodecError` for
what they can't handle for certain, so a file never leaves unstripped because it was not understood.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from palimpsest import tags


class CodecError(ValueError):
    """The bytes are damaged or of a kind that isn't supported."""


#: Numbers of EXIF 2.3 tags by name, for the main, the Exif and the GPS directory.
MAIN_TAGS = {
    256: "ImageWidth", 257: "ImageLength", 270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 305: "Software", 306: "DateTime",
    315: "Artist", 513: "JPEGInterchangeFormat", 514: "JPEGInterchangeFormatLength", 700: "Xmp", 33432: "Copyright", 50341: "PrintIM",
}
EXIF_TAGS = {
    33434: "ExposureTime", 33437: "FNumber", 34855: "PhotographicSensitivity", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37385: "Flash",
    37386: "FocalLength", 37500: "MakerNote", 37510: "UserComment", 37520: "SubSecTime", 37521: "SubSecTimeOriginal", 37522: "SubSecTimeDigitized",
    40962: "PixelXDimension", 40963: "PixelYDimension", 41987: "WhiteBalance", 41995: "DeviceSettingDescription", 42016: "ImageUniqueID",
    42032: "CameraOwnerName", 42033: "BodySerialNumber", 42035: "LensMake", 42036: "LensModel", 42037: "LensSerialNumber",
}
GPS_TAGS = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp",
    8: "GPSSatellites", 9: "GPSStatus", 10: "GPSMeasureMode", 11: "GPSDOP", 12: "GPSSpeedRef", 13: "GPSSpeed", 14: "GPSTrackRef", 15: "GPSTrack",
    16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 23: "GPSDestBearingRef", 24: "GPSDestBearing", 27: "GPSProcessingMethod", 29: "GPSDateStamp",
}
EXIF_POINTER, GPS_POINTER = 34665, 34853
THUMBNAIL_AT, THUMBNAIL_SIZE = 513, 514
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: PNG chunks that carry text, times or EXIF.
PNG_PRIVATE = (b"tEXt", b"zTXt", b"iTXt", b"tIME", b"eXIf")


# ---- EXIF directories -------------------------------------------------------------------------------------------------

def _exif_value(order: str, kind: int, raw: bytes) -> str:
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        letter = "I" if kind == 5 else "i"
        parts = struct.unpack(f"{order}{len(raw) // 4}{letter}", raw)
        return ",".join(f"{a}/{b}" for a, b in zip(parts[::2], parts[1::2], strict=True))
    if kind in (3, 4, 8, 9):
        letter = {3: "H", 4: "I", 8: "h", 9: "i"}[kind]
        return ",".join(map(str, struct.unpack(f"{order}{len(raw) // TYPE_SIZES[kind]}{letter}", raw)))
    if kind == 7 and raw[:8] in (b"ASCII\0\0\0", b"UNICODE\0"):
        return raw[8:].decode("utf-8" if raw[:1] == b"A" else "utf-16", "replace").strip("\0 ")
    return raw.decode("latin-1") if kind == 7 else ",".join(map(str, raw))


def read_exif(data: bytes) -> Iterator[tuple[str, str]]:
    """(tag, value) of a TIFF-structured block: the main, Exif and GPS directories."""
    if data[:2] not in (b"II", b"MM"):
        raise CodecError("EXIF block without byte order")
    order = "<" if data[:2] == b"II" else ">"
    todo, seen = [(struct.unpack_from(order + "I", data, 4)[0], MAIN_TAGS)], set()
    while todo:
        at, names = todo.pop(0)
        if at in seen or not at:
            continue
        seen.add(at)
        if at + 2 > len(data):
            raise CodecError("EXIF directory beyond the block")
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(data):
                raise CodecError("EXIF entry beyond the block")
            tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
            size = TYPE_SIZES.get(kind, 0) * n
            where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if where + size > len(data):
                raise CodecError("EXIF value beyond the block")
            if tag in (EXIF_POINTER, GPS_POINTER):
                todo.append((struct.unpack_from(order + "I", data, entry + 8)[0], EXIF_TAGS if tag == EXIF_POINTER else GPS_TAGS))
            elif name := names.get(tag):
                yield name, _exif_value(order, kind, data[where : where + size])


def read_thumbnail(data: bytes) -> bytes | None:
    """The JPEG that the second directory of a TIFF-structured block points to, if there is one."""
    order = "<" if data[:2] == b"II" else ">"
    first = struct.unpack_from(order + "I", data, 4)[0]
    second = struct.unpack_from(order + "I", data, first + 2 + 12 * struct.unpack_from(order + "H", data, first)[0])[0]
    if not second:
        return None
    found = {}
    for i in range(struct.unpack_from(order + "H", data, second)[0]):
        tag, kind, _, value = struct.unpack_from(order + "HHII", data, second + 2 + 12 * i)
        found[tag] = value
    at, size = found.get(THUMBNAIL_AT, 0), found.get(THUMBNAIL_SIZE, 0)
    if at + size > len(data):
        raise CodecError("thumbnail beyond the block")
    return data[at : at + size] if at and size else None


def _rational(text: str) -> tuple[int, int]:
    if "/" in text:
        a, b = text.split("/")
        return int(a), int(b)
    whole, _, part = text.partition(".")
    return int(whole + part), 10 ** len(part)


def degrees_to_rational(degrees: float) -> str:
    """Degrees, minutes and seconds as EXIF writes them."""
    seconds = round(abs(degrees) * 3600 * 10_000)
    return f"{seconds // 36_000_000}/1,{seconds // 600_000 % 60}/1,{seconds % 600_000}/10000"


def rational_to_degrees(text: str, ref: str | None) -> float | None:
    """The signed degrees of EXIF's degrees, minutes and seconds; null if the text is none."""
    parts = [p.split("/") for p in (text or "").split(",")]
    try:
        value = sum(int(a) / int(b) / 60**i for i, (a, b) in enumerate(parts))
    except (ValueError, ZeroDivisionError):
        return None
    return -value if ref in ("S", "W") else value


def write_exif(values: dict[str, str], thumbnail: bytes | None = None) -> bytes:
    """A little-endian EXIF block with ``values`` and perhaps a thumbnail; tags without a known number are an error."""
    where = {name: (directory, number) for directory, names in (("main", MAIN_TAGS), ("exif", EXIF_TAGS), ("gps", GPS_TAGS)) for number, name in names.items()}
    parts: dict[str, dict[int, tuple[int, int, bytes]]] = {"main": {}, "exif": {}, "gps": {}}
    shorts = ("Orientation", "PhotographicSensitivity", "Flash", "WhiteBalance")
    rationals = ("ExposureTime", "FNumber", "FocalLength", "GPSLatitude", "GPSLongitude")
    for name, value in values.items():
        if name not in where:
            raise CodecError(f"no number for tag {name}")
        directory, number = where[name]
        if name in shorts:
            parts[directory][number] = (3, 1, struct.pack("<H", int(value)))
        elif name in rationals:
            pairs = [_rational(v) for v in value.split(",")]
            parts[directory][number] = (5, len(pairs), b"".join(struct.pack("<II", *p) for p in pairs))
        elif name == "UserComment":
            raw = b"ASCII\0\0\0" + value.encode()
            parts[directory][number] = (7, len(raw), raw)
        else:
            raw = value.encode() + b"\0"
            parts[directory][number] = (2, len(raw), raw)
    sizes = {k: 2 + 12 * (len(v) + (len([s for s in ("exif", "gps") if parts[s]]) if k == "main" else 0)) + 4 for k, v in parts.items()}
    start, at = {}, 8
    for k in ("main", "exif", "gps"):
        if k == "main" or parts[k]:
            start[k] = at
            at += sizes[k]
    heap, blocks = b"", []
    for k in start:
        rows = dict(parts[k])
        if k == "main":
            rows |= {p: (4, 1, struct.pack("<I", start[s])) for s, p in (("exif", EXIF_POINTER), ("gps", GPS_POINTER)) if s in start}
        block = struct.pack("<H", len(rows))
        for number in sorted(rows):
            kind, n, raw = rows[number]
            if len(raw) <= 4:
                block += struct.pack("<HHI", number, kind, n) + raw.ljust(4, b"\0")
            else:
                block += struct.pack("<HHII", number, kind, n, at + len(heap))
                heap += raw + b"\0" * (len(raw) % 2)
        blocks.append(block + struct.pack("<I", 0))
    if thumbnail:  # the second directory lies behind all values; what it points to, behind it
        second = at + len(heap)
        blocks[0] = blocks[0][:-4] + struct.pack("<I", second)
        fields = ((259, 3, 6), (THUMBNAIL_AT, 4, second + 2 + 3 * 12 + 4), (THUMBNAIL_SIZE, 4, len(thumbnail)))
        heap += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in fields) + struct.pack("<I", 0) + thumbnail
    return b"II*\0" + struct.pack("<I", 8) + b"".join(blocks) + heap


# ---- JPEG -------------------------------------------------------------------------------------------------------------

def _jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) up to the picture; the last is (0xDA, everything from the scan on)."""
    if data[:2] != b"\xff\xd8":
        raise CodecError("not a JPEG")
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise CodecError("JPEG cut short or out of step")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            yield marker, data[at:]
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise CodecError("JPEG segment beyond the end")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def read_jpeg(data: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for marker, body in _jpeg_segments(data):
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            out += read_exif(body[6:])
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            out.append(("Xmp", body[29:].decode("utf-8", "replace")))
        elif marker == 0xED:
            out.append(("ImageResources", f"{len(body)} bytes"))
        elif marker == 0xFE:
            out.append(("UserComment", body.decode("utf-8", "replace")))
    return out


def _private(marker: int, body: bytes) -> bool:
    """Whether a segment is a comment or application data other than for colours."""
    return marker == 0xFE or 0xE1 <= marker <= 0xEF and not (marker == 0xE2 and body.startswith(b"ICC_PROFILE")) and not (marker == 0xEE and body.startswith(b"Adobe"))


def _scans(data: bytes) -> bytes:
    """``data`` from the first scan to the picture's own end mark, without private segments between scans; what is appended behind goes."""
    out, at, kept = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            return b"".join([*out, data[kept : at + 2]])
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
        elif marker == 0xD8 or at + 4 > len(data):
            break
        else:
            end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
            if end < at + 4 or end > len(data):
                raise CodecError("JPEG segment beyond the end")
            if _private(marker, data[at + 4 : end]):
                out.append(data[kept:at])
                kept = end
            at = end
    raise CodecError("JPEG without an end")


def _thumbnail(data: bytes) -> bytes | None:
    """The embedded preview of a JPEG, itself without metadata."""
    for marker, body in _jpeg_segments(data):
        if marker == 0xE1 and body.startswith(b"Exif\0\0") and (found := read_thumbnail(body[6:])):
            return rewrite_jpeg(found, {})
    return None


def rewrite_jpeg(data: bytes, values: dict[str, str], thumbnail: bool = False) -> bytes:
    """The picture with ``values``, and perhaps its thumbnail, as its only metadata; colour and decoding segments stay, other application
    data and comments go."""
    out = [b"\xff\xd8"]
    small = _thumbnail(data) if thumbnail else None
    if values or small:
        body = b"Exif\0\0" + write_exif(values, small)
        if len(body) > 65_533:
            raise CodecError("EXIF block too large")
        out.append(b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body)
    for marker, body in _jpeg_segments(data):
        if marker == 0xDA:
            out.append(_scans(body))
        elif not _private(marker, body):
            out.append(bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body)
    return b"".join(out)


# ---- PNG --------------------------------------------------------------------------------------------------------------

def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != PNG_MAGIC:
        raise CodecError("not a PNG")
    at = 8
    while True:
        if at + 12 > len(data):
            raise CodecError("PNG cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise CodecError("damaged PNG chunk")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return


def read_png(data: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for kind, body in _png_chunks(data):
        if kind == b"IHDR":
            out += zip(("ImageWidth", "ImageLength"), map(str, struct.unpack(">II", body[:8])), strict=True)
        elif kind == b"eXIf":
            out += read_exif(body)
        elif kind == b"tEXt":
            key, _, value = body.partition(b"\0")
            out.append((key.decode("latin-1"), value.decode("latin-1")))
        elif kind in PNG_PRIVATE:
            out.append((kind.decode(), f"{len(body)} bytes"))
    return out


def rewrite_png(data: bytes, values: dict[str, str]) -> bytes:
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    out = [PNG_MAGIC]
    for kind, body in _png_chunks(data):
        if kind not in PNG_PRIVATE:
            out.append(chunk(kind, body))
        if kind == b"IHDR" and values:
            out.append(chunk(b"eXIf", write_exif(values)))
    return b"".join(out)


# ---- WebP -------------------------------------------------------------------------------------------------------------

#: Chunks that make the picture; others are metadata or unknown and go.
WEBP_PICTURE = (b"VP8 ", b"VP8L", b"ALPH", b"ANIM", b"ANMF", b"ICCP")
#: Bits of the extended header.
WEBP_XMP, WEBP_EXIF, WEBP_ALPHA = 4, 8, 16


def _webp_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise CodecError("not a WebP")
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise CodecError("WebP cut short")
    while at < end:
        if at + 8 > end:
            raise CodecError("WebP chunk cut short")
        kind, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise CodecError("WebP chunk beyond the end")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _webp_exif(body: bytes) -> bytes:
    return body[6:] if body.startswith(b"Exif\0\0") else body


def _webp_size(kind: bytes, body: bytes) -> tuple[int, int, bool]:
    """(width, height, alpha) of a lossy or lossless picture."""
    if kind == b"VP8 ":
        if body[3:6] != b"\x9d\x01\x2a":
            raise CodecError("damaged WebP picture")
        width, height = struct.unpack_from("<HH", body, 6)
        return width & 0x3FFF, height & 0x3FFF, False
    if body[:1] != b"\x2f":
        raise CodecError("damaged WebP picture")
    bits = struct.unpack_from("<I", body, 1)[0]
    return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)


def read_webp(data: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for kind, body in _webp_chunks(data):
        if kind == b"VP8X":
            out += [("ImageWidth", str(int.from_bytes(body[4:7], "little") + 1)), ("ImageLength", str(int.from_bytes(body[7:10], "little") + 1))]
        elif kind in (b"VP8 ", b"VP8L") and not out:
            width, height, _ = _webp_size(kind, body)
            out += [("ImageWidth", str(width)), ("ImageLength", str(height))]
        elif kind == b"EXIF":
            out += read_exif(_webp_exif(body))
        elif kind == b"XMP ":
            out.append(("Xmp", body.decode("utf-8", "replace")))
    return out


def rewrite_webp(data: bytes, values: dict[str, str]) -> bytes:
    """The picture with ``values`` as its only metadata. A plain picture gets the extended header that EXIF needs."""
    chunks = list(_webp_chunks(data))
    header = next((body for kind, body in chunks if kind == b"VP8X"), None)
    kept = [(kind, body) for kind, body in chunks if kind in WEBP_PICTURE]
    if not any(kind in (b"VP8 ", b"VP8L", b"ANMF") for kind, _ in kept):
        raise CodecError("WebP without a picture")
    if header is None and values:
        width, height, alpha = _webp_size(*kept[0])
        header = bytes([WEBP_ALPHA * alpha, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    if header is not None:
        header = bytes([header[0] & ~(WEBP_XMP | WEBP_EXIF) | (WEBP_EXIF if values else 0)]) + header[1:]
        kept.insert(0, (b"VP8X", header))
    if values:
        kept.append((b"EXIF", write_exif(values)))
    body = b"WEBP" + b"".join(struct.pack("<4sI", kind, len(part)) + part + b"\0" * (len(part) % 2) for kind, part in kept)
    return b"RIFF" + struct.pack("<I", len(body)) + body


# ---- MP3 --------------------------------------------------------------------------------------------------------------

#: ID3 frames by version and the keys that they are shown under.
ID3_KEYS = {b"TIT2": "Title", b"TPE1": "Artist", b"TALB": "Album", b"TDRC": "Date", b"TYER": "Date", b"TT2": "Title", b"TP1": "Artist", b"TAL": "Album", b"TYE": "Date"}
ID3_TEXT = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _id3_size(raw: bytes) -> int:
    if any(b & 128 for b in raw):
        raise CodecError("damaged ID3 size")
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3_frames(tag: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, body) of the frames of an ID3v2 tag."""
    version, flags, body = tag[3], tag[5], tag[10:]
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 64:
        at = _id3_size(body[:4]) if version > 3 else 4 + int.from_bytes(body[:4], "big")
    names, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        name, raw = body[at : at + names], body[at + names : at + 2 * names]
        size = _id3_size(raw) if version > 3 else int.from_bytes(raw, "big")
        if at + head + size > len(body):
            raise CodecError("ID3 frame beyond the tag")
        yield name, body[at + head : at + head + size]
        at += head + size


def _mp3_sound(data: bytes) -> tuple[list[bytes], int, int]:
    """(ID3v2 tags, start, end) of what lies between the tags at both ends."""
    tags_, at, end = [], 0, len(data)
    while data[at : at + 3] == b"ID3":
        if at + 10 > end:
            raise CodecError("ID3 tag cut short")
        size = 10 + _id3_size(data[at + 6 : at + 10]) + (10 if data[at + 5] & 16 else 0)
        if at + size > end:
            raise CodecError("ID3 tag beyond the end")
        tags_.append(data[at : at + size])
        at += size
    while True:
        if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
            end -= 128
        elif end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
            size, _, flags = struct.unpack_from("<III", data, end - 20)
            size += 32 if flags >> 31 else 0
            if not 32 <= size <= end - at:
                raise CodecError("APE tag beyond the start")
            end -= size
        elif end - at >= 15 and data[end - 9 : end] == b"LYRICS200":
            size = 15 + int(data[end - 15 : end - 9])
            if size > end - at:
                raise CodecError("lyrics beyond the start")
            end -= size
        elif end - at >= 10 and data[end - 10 : end - 7] == b"3DI":
            size = 20 + _id3_size(data[end - 4 : end])
            if size > end - at:
                raise CodecError("ID3 tag beyond the start")
            tags_.append(data[end - size : end])
            end -= size
        else:
            break
    while at < end and not data[at]:
        at += 1
    if end - at < 4 or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        raise CodecError("no sound behind the tags")
    return tags_, at, end


def read_mp3(data: bytes) -> list[tuple[str, str]]:
    """Title, artist, album and date of the ID3 tags, the first of each; other frames, pictures too, by name and size."""
    found, _, end = _mp3_sound(data)
    out: dict[str, str] = {}
    for tag in found:
        for name, body in _id3_frames(tag):
            if name in ID3_KEYS and body and body[0] in ID3_TEXT:
                out.setdefault(ID3_KEYS[name], body[1:].decode(ID3_TEXT[body[0]], "replace").strip("\0"))
            else:
                out.setdefault(name.decode("latin-1"), f"{len(body)} bytes")
    if len(data) > end and (at := data.rfind(b"TAG", end)) >= 0 and at + 128 <= len(data):
        for key, a, b in (("Title", 3, 33), ("Artist", 33, 63), ("Album", 63, 93), ("Date", 93, 97)):
            if text := data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip():
                out.setdefault(key, text)
    return [*out.items(), ("HasVideo", "no")]


def rewrite_mp3(data: bytes, values: dict[str, str]) -> bytes:
    """The sound without tags at either end. Such a file has no field for a place, so none is written."""
    _, at, end = _mp3_sound(data)
    if b"APETAGEX" in data[at:end] or b"ID3\x03\x00" in data[at:end] or b"ID3\x04\x00" in data[at:end]:
        raise CodecError("a tag inside the sound")
    return data[at:end]


# ---- Ogg --------------------------------------------------------------------------------------------------------------

OGG_KEYS = {"TITLE": "Title", "ARTIST": "Artist", "ALBUM": "Album", "DATE": "Date"}
#: By the beginning of a stream's first packet: what its comment packet begins with and what ends it.
OGG_COMMENTS = {b"\x01vorbis": (b"\x03vorbis", b"\x01"), b"OpusHead": (b"OpusTags", b"")}


def _ogg_crc(data: bytes) -> int:
    """The checksum of a page whose own checksum is zero: the usual polynomial, from zero, bits not mirrored."""
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x104C11DB7) if crc >> 31 else crc << 1
    return crc


def _ogg_pages(data: bytes) -> Iterator[tuple[int, int, int, list[tuple[int, int, bool]]]]:
    """(start, end, stream, (start, end, whether it ends a packet) of the parts of packets) of each page."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise CodecError("Ogg page cut short or out of step")
        lacing = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + len(lacing)
        if len(lacing) < data[at + 26] or body + sum(lacing) > len(data):
            raise CodecError("Ogg page beyond the end")
        parts, a, b = [], body, body
        for n in lacing:
            b += n
            if n < 255:
                parts.append((a, b, True))
                a = b
        if a < b:
            parts.append((a, b, False))
        yield at, b, struct.unpack_from("<I", data, at + 14)[0], parts
        at = b


def _ogg_comments(data: bytes) -> Iterator[tuple[bytes, list[tuple[int, int]], list[int]]]:
    """(beginning of the first packet, (start, end) of the parts of the comment packet, its pages) of each stream."""
    pages = list(_ogg_pages(data))
    heads: dict[int, tuple[bytes, list[tuple[int, int]], list[int]]] = {}
    done: dict[int, int] = {}
    for number, (at, _, stream, parts) in enumerate(pages):
        if data[at + 5] & 2:  # a stream begins
            kind = next((k for k in OGG_COMMENTS if parts and data[parts[0][0] : parts[0][0] + len(k)] == k), None)
            if kind is None:
                raise CodecError("an Ogg stream that is neither Vorbis nor Opus")
            if stream in heads and done[stream] < 2:
                raise CodecError("Ogg stream without comments")
            if stream in heads:
                yield heads[stream]
            heads[stream], done[stream] = (kind, [], []), 0
        if stream not in heads:
            raise CodecError("Ogg page of no stream")
        for a, b, ends in parts:
            if done[stream] == 1:
                heads[stream][1].append((a, b))
                if number not in heads[stream][2]:
                    heads[stream][2].append(number)
            done[stream] += ends
            if done[stream] > 1:
                break
    if not heads or any(n < 2 for n in done.values()):
        raise CodecError("Ogg stream without comments")
    yield from heads.values()


def _texts(packet: bytes, start: bytes) -> Iterator[tuple[str, str]]:
    if not packet.startswith(start):
        raise CodecError("not a comment packet")
    at = len(start)
    at += 4 + struct.unpack_from("<I", packet, at)[0]
    (n,), at = struct.unpack_from("<I", packet, at), at + 4
    for _ in range(n):
        size = struct.unpack_from("<I", packet, at)[0]
        if at + 4 + size > len(packet):
            raise CodecError("comment beyond its packet")
        name, _, text = packet[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        yield name.upper(), text
        at += 4 + size


def read_ogg(data: bytes) -> list[tuple[str, str]]:
    """Title, artist, album and date, the first of each; other comments, pictures too, by name and size."""
    out: dict[str, str] = {}
    for kind, parts, _ in _ogg_comments(data):
        for name, text in _texts(b"".join(data[a:b] for a, b in parts), OGG_COMMENTS[kind][0]):
            if name in OGG_KEYS:
                out.setdefault(OGG_KEYS[name], text)
            else:
                out.setdefault(name, f"{len(text)} characters")
    return [*out.items(), ("HasVideo", "no")]


def rewrite_ogg(data: bytes, values: dict[str, str]) -> bytes:
    """The file with empty comments, padded to their old length, so that no page changes but those of comments. It has no field for a place."""
    read_ogg(data)
    out, pages = bytearray(data), list(_ogg_pages(data))
    for kind, parts, numbers in _ogg_comments(data):
        start, end = OGG_COMMENTS[kind]
        size = sum(b - a for a, b in parts)
        packet = (start + bytes(8) + end).ljust(size, b"\0")
        if len(packet) > size:
            raise CodecError("no room for empty comments")
        for a, b in parts:
            out[a:b], packet = packet[: b - a], packet[b - a :]
        for number in numbers:
            a, b, *_ = pages[number]
            out[a + 22 : a + 26] = bytes(4)
            out[a + 22 : a + 26] = struct.pack("<I", _ogg_crc(out[a:b]))
    return bytes(out)


# ---- MP4 --------------------------------------------------------------------------------------------------------------

PARENTS = (b"moov", b"trak", b"mdia", b"udta", b"minf")


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start, start of content, end) of the boxes between two places."""
    while at < end:
        if at + 8 > end:
            raise CodecError("MP4 box cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise CodecError("MP4 box cut short")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise CodecError("MP4 box beyond its parent")
        yield kind, at, at + head, at + size
        at += size


def _find(data: bytes, *path: bytes) -> Iterator[tuple[int, int]]:
    spans = [(0, len(data))]
    for name in path:
        spans = [(c, e) for a, b in spans for kind, _, c, e in _boxes(data, a, b) if kind == name]
    return iter(spans)


#: User data of QuickTime and item list keys.
MP4_KEYS = {b"\xa9xyz": "Location", b"\xa9nam": "Title", b"\xa9ART": "Artist", b"\xa9alb": "Album", b"\xa9day": "Date"}


def _item_list(data: bytes, c: int, e: int) -> Iterator[tuple[str, str]]:
    """(key, value) of the item list in a user data's metadata box: the first data of each known item."""
    for kind, _, x, y in _boxes(data, c, e):
        if kind != b"meta":
            continue
        body = x + 4 if data[x + 4 : x + 8] != b"hdlr" else x  # QuickTime's has no version
        for k, _, a, b in _boxes(data, body, y):
            if k == b"ilst":
                for item, _, m, n in _boxes(data, a, b):
                    if item in MP4_KEYS:
                        yield from ((MP4_KEYS[item], data[p + 8 : q].decode("utf-8", "replace")) for d, _, p, q in list(_boxes(data, m, n))[:1] if d == b"data" and q - p >= 8)


def read_mp4(data: bytes) -> list[tuple[str, str]]:
    if b"ftyp" not in {k for k, *_ in _boxes(data, 0, len(data))}:
        raise CodecError("not an MP4")
    out, video = [], False
    for c, _ in _find(data, b"moov", b"mvhd"):
        scale, length = struct.unpack_from(">IQ", data, c + 20) if data[c] == 1 else struct.unpack_from(">II", data, c + 12)
        out.append(("DurationMs", str(length * 1000 // scale if scale else 0)))
    for c, e in _find(data, b"moov", b"trak"):
        if _handler(data, c, e) == b"vide" and not video:
            video = True
            for k, _, _, end in _boxes(data, c, e):
                if k == b"tkhd":
                    width, height = struct.unpack_from(">II", data, end - 8)
                    out += [("Width", str(width >> 16)), ("Height", str(height >> 16))]
    out.append(("HasVideo", "yes" if video else "no"))
    said: dict[str, str] = {}
    for c, e in _find(data, b"moov", b"udta"):
        for kind, _, x, y in _boxes(data, c, e):
            if kind in MP4_KEYS and y - x >= 4:
                said.setdefault(MP4_KEYS[kind], data[x + 4 : y].decode("utf-8", "replace"))
        for key, value in _item_list(data, c, e):
            said.setdefault(key, value)
    return [*out, *said.items()]


def _handler(data: bytes, c: int, e: int) -> bytes | None:
    """What kind a track is of."""
    return next((data[x + 8 : x + 12] for k, _, m, n in _boxes(data, c, e) if k == b"mdia" for h, _, x, _ in _boxes(data, m, n) if h == b"hdlr"), None)


def _samples(data: bytes, c: int, e: int) -> Iterator[tuple[int, int]]:
    """(start, end) in the file of the chunks of a track's samples."""
    table = {k: (x, y) for p, _, a, b in _boxes(data, c, e) if p == b"mdia" for q, _, m, n in _boxes(data, a, b) if q == b"minf" for r, _, v, w in _boxes(data, m, n) if r == b"stbl" for k, _, x, y in _boxes(data, v, w)}
    offsets = table.get(b"stco") or table.get(b"co64")
    if offsets is None or b"stsc" not in table or b"stsz" not in table:
        raise CodecError("a track without a sample table")
    wide = b"stco" not in table
    n = struct.unpack_from(">I", data, offsets[0] + 4)[0]
    chunks = struct.unpack_from(f">{n}{'Q' if wide else 'I'}", data, offsets[0] + 8)
    fixed, count = struct.unpack_from(">II", data, table[b"stsz"][0] + 4)
    sizes = [fixed] * count if fixed else struct.unpack_from(f">{count}I", data, table[b"stsz"][0] + 12)
    runs = [struct.unpack_from(">III", data, table[b"stsc"][0] + 8 + 12 * i)[:2] for i in range(struct.unpack_from(">I", data, table[b"stsc"][0] + 4)[0])]
    used, at = 0, 0
    for number, start in enumerate(chunks, 1):
        while at + 1 < len(runs) and runs[at + 1][0] <= number:
            at += 1
        many = runs[at][1] if runs else 0
        size = sum(sizes[used : used + many])
        used += many
        if start + size > len(data):
            raise CodecError("samples beyond the end")
        yield start, start + size
    if used < count:
        raise CodecError("samples without a place")


def _shifted(out: bytearray, movie: tuple[int, int], box: bytes) -> bytes:
    """The file with ``box`` at the end of its movie box and the offsets of all samples behind it moved."""
    start, end = movie
    if struct.unpack_from(">I", out, start)[0] == 0:
        raise CodecError("no room for a location")
    data = bytes(out)
    if b"moof" in {k for k, *_ in _boxes(data, 0, len(data))} and end < len(data):
        raise CodecError("no room for a location before fragments")
    for c, e in _find(data, b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        for kind, _, x, _ in _boxes(data, c, e):
            if kind in (b"stco", b"co64"):
                letter, width = ("I", 4) if kind == b"stco" else ("Q", 8)
                n = struct.unpack_from(">I", data, x + 4)[0]
                places = [p + len(box) if p >= end else p for p in struct.unpack_from(f">{n}{letter}", data, x + 8)]
                if places and max(places) >> (8 * width):
                    raise CodecError("no room for larger offsets")
                out[x + 8 : x + 8 + width * n] = struct.pack(f">{n}{letter}", *places)
    if struct.unpack_from(">I", out, start)[0] == 1:
        out[start + 8 : start + 16] = struct.pack(">Q", end - start + len(box))
    else:
        out[start : start + 4] = struct.pack(">I", end - start + len(box))
    return bytes(out[:end]) + box + bytes(out[end:])


def rewrite_mp4(data: bytes, values: dict[str, str]) -> bytes:
    """The file with user data, metadata and free boxes blanked in place (so that no sample moves), tracks' and movie's times zeroed.

    Tracks other than video and audio are blanked too, and so are their samples. A Location is written into the space that the old user
    data leaves, or into a new box at the movie's end; then the samples behind it move, and the tables that say where they are.
    """
    read_mp4(data)
    out = bytearray(data)
    kept: list[tuple[int, int]] = []
    gone: list[tuple[int, int]] = []
    holes: list[tuple[int, int]] = []
    foreign: list[int] = []

    def blank(a: int, b: int) -> None:
        out[a + 4 : a + 8] = b"free"
        head = 16 if struct.unpack_from(">I", data, a)[0] == 1 else 8
        out[a + head : b] = bytes(b - a - head)

    def walk(a: int, b: int, inside: bool) -> None:
        for kind, start, content, end in _boxes(data, a, b):
            if kind == b"trak" and _handler(data, content, end) not in (b"vide", b"soun"):
                foreign.append(start)
                gone.extend(_samples(data, content, end))
                blank(start, end)
            elif kind in (b"udta", b"meta", b"uuid", b"free", b"skip"):
                blank(start, end)
                if inside:
                    holes.append((start, end))
            elif kind in (b"mvhd", b"tkhd", b"mdhd"):
                n = 16 if data[content] == 1 else 8
                out[content + 4 : content + 4 + n] = bytes(n)
            elif kind == b"hdlr" and end - content >= 12:
                out[content + 24 : end] = bytes(end - content - 24)
            elif kind in PARENTS:
                if kind == b"trak":
                    kept.append((content, end))
                walk(content, end, inside or kind == b"moov")

    walk(0, len(data), False)
    if not kept:
        raise CodecError("no usable track")
    if foreign:
        if b"moof" in {k for k, *_ in _boxes(data, 0, len(data))}:
            raise CodecError("a foreign track in fragments")
        used = [s for c, e in kept for s in _samples(data, c, e)]
        boxes = [(x, y) for k, _, x, y in _boxes(data, 0, len(data)) if k == b"mdat"]
        for a, b in gone:
            if any(a < y and x < b for x, y in used) or (a < b and not any(x <= a and b <= y for x, y in boxes)):
                raise CodecError("samples of a foreign track among others'")
            out[a:b] = bytes(b - a)
    if place := values.get("Location"):
        text = place.encode()
        entry = struct.pack(">I4sHH", len(text) + 12, b"\xa9xyz", len(text), 0x15C7) + text
        box = struct.pack(">I4s", len(entry) + 8, b"udta") + entry
        (movie,) = [(s, e) for k, s, _, e in _boxes(data, 0, len(data)) if k == b"moov"][:1] or [(0, 0)]
        for start, end in holes:
            rest = end - start - len(box)
            if start > movie[0] and end <= movie[1] and (rest == 0 or rest >= 8):
                out[start : start + len(box)] = box
                if rest:
                    out[start + len(box) : end] = struct.pack(">I4s", rest, b"free") + bytes(rest - 8)
                return bytes(out)
        return _shifted(out, movie, box)
    return bytes(out)


# ---- HEIF -------------------------------------------------------------------------------------------------------------

#: Item types that carry metadata.
HEIF_EXIF, HEIF_TEXT = b"Exif", (b"mime", b"uri ")


class _Numbers:
    """Reads big-endian numbers one after the other."""

    def __init__(self, data: bytes, at: int, end: int) -> None:
        self.data, self.at, self.end = data, at, end

    def take(self, size: int) -> int:
        if self.at + size > self.end:
            raise CodecError("HEIF box cut short")
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")


def _heif_items(data: bytes) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """(type, (start, end) of its extents in the file) of the items of a HEIF file."""
    top = list(_boxes(data, 0, len(data)))
    if not top or top[0][0] != b"ftyp":
        raise CodecError("not a HEIF")
    meta = [(c + 4, e) for kind, _, c, e in top if kind == b"meta"]
    if not meta:
        raise CodecError("HEIF without items")
    inner = {kind: (c, e) for kind, _, c, e in _boxes(data, *meta[0])}
    if b"iinf" not in inner or b"iloc" not in inner:
        raise CodecError("HEIF without items")
    start, end = inner[b"iinf"]
    types: dict[int, bytes] = {}
    for kind, _, c, _ in _boxes(data, start + (6 if data[start] == 0 else 8), end):
        if kind == b"infe":
            if data[c] < 2:
                raise CodecError("HEIF items of an old version")
            wide = 4 if data[c] > 2 else 2
            types[int.from_bytes(data[c + 4 : c + 4 + wide], "big")] = data[c + 6 + wide : c + 10 + wide]
    start, end = inner[b"iloc"]
    version, numbers = data[start], _Numbers(data, start + 4, end)
    sizes, more = numbers.take(1), numbers.take(1)
    offset, length, base, index = sizes >> 4, sizes & 15, more >> 4, more & 15 if version else 0
    for _ in range(numbers.take(4 if version == 2 else 2)):
        item = numbers.take(4 if version == 2 else 2)
        method = numbers.take(2) & 15 if version else 0
        elsewhere = numbers.take(2)
        origin = numbers.take(base)
        spans = []
        for _ in range(numbers.take(2)):
            numbers.take(index)
            a = origin + numbers.take(offset)
            spans.append((a, a + numbers.take(length)))
        kind = types.get(item, b"")
        if kind == HEIF_EXIF or kind in HEIF_TEXT:
            if method == 1 and b"idat" in inner:
                spans = [(a + inner[b"idat"][0], b + inner[b"idat"][0]) for a, b in spans]
            elif method or elsewhere:
                raise CodecError("HEIF metadata outside the file")
            if any(b > len(data) or a == b for a, b in spans):
                raise CodecError("HEIF item beyond the end")
            yield kind, spans


def read_heif(data: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for kind, spans in _heif_items(data):
        body = b"".join(data[a:b] for a, b in spans)
        if kind == HEIF_EXIF:
            out += read_exif(body[4 + int.from_bytes(body[:4], "big") :])
        elif body.strip():
            out.append(("Xmp", body.decode("utf-8", "replace")))
    return out


def rewrite_heif(data: bytes, values: dict[str, str]) -> bytes:
    """The file with its metadata items overwritten in place (so that no picture moves) by ``values`` and by blanks.

    ``values`` need an EXIF item with enough room; so a file without one can only be stripped.
    """
    out, left = bytearray(data), values
    for kind, spans in _heif_items(data):
        for a, b in spans:
            out[a:b] = (b" " if kind in HEIF_TEXT else b"\0") * (b - a)
        if kind == HEIF_EXIF:
            a, b = spans[0]
            block = b"\0\0\0\0" + write_exif(left)
            if len(block) > b - a:
                raise CodecError("no room for tags")
            out[a : a + len(block)] = block
            left = {}
    if left:
        raise CodecError("no room for tags")
    for kind, start, content, end in _boxes(data, 0, len(data)):
        if kind in (b"uuid", b"udta", b"free", b"skip"):
            out[start + 4 : start + 8] = b"free"
            out[content:end] = bytes(end - content)
    return bytes(out)


# ---- PDF --------------------------------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"\bstream\r?\n|\bendobj\b")


def _check_pdf(data: bytes) -> None:
    if not data.startswith(b"%PDF-"):
        raise CodecError("not a PDF")
    if b"%%EOF" not in data[-1024:]:
        raise CodecError("PDF cut short")


def _direct_objects(data: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(place, number, generation, body) of the objects in order; a stream whose length is given is passed over by that length."""
    at = 0
    while m := _OBJECT.search(data, at):
        mark = _STREAM.search(data, m.end())
        if mark is None:
            raise CodecError("PDF object without an end")
        if mark[0].startswith(b"stream"):
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", data[m.end() : mark.start()])
            stop = mark.end() + int(length[1]) if length else -1
            if stop < 0 or not re.match(rb"\s*endstream", data[stop : stop + 32]):
                stop = data.find(b"endstream", mark.end())
                if stop < 0:
                    raise CodecError("PDF stream without an end")
            end = data.find(b"endobj", stop)
        else:
            end = mark.start()
        if end < 0:
            raise CodecError("PDF object without an end")
        yield m.start(), int(m[1]), m[2], data[m.end() : end]
        at = end + 6


def _stream(body: bytes) -> bytes:
    """The plain bytes of a stream object without filter, or with Flate and perhaps a row predictor."""
    head, mark = body, re.search(rb"\bstream\r?\n", body)
    if mark is None:
        raise CodecError("not a PDF stream")
    head, raw = body[: mark.start()], body[mark.end() :]
    if length := re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head):
        raw = raw[: int(length[1])]
    else:
        raw = raw[: raw.rindex(b"endstream")]
    filters = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", head)
    if not filters:
        return raw
    if filters[1].strip(b"[] \r\n") not in (b"/FlateDecode", b"/Fl"):
        raise CodecError("a PDF filter that isn't supported")
    out = zlib.decompressobj().decompress(raw)
    predictor = re.search(rb"/Predictor\s+(\d+)", head)
    if predictor and int(predictor[1]) > 1:
        raise CodecError("a PDF predictor that isn't supported")
    return out


def _pdf_objects(data: bytes) -> tuple[dict[int, tuple[bytes, bytes]], bytes]:
    """(objects by number as (generation, body), trailer): what the last revision of a document consists of.

    Objects in compressed object streams are taken out of them; such streams and cross-reference streams aren't among the objects.
    """
    _check_pdf(data)
    objects: dict[int, tuple[bytes, bytes]] = {}
    trailers = [(m.start(), m[1]) for m in re.finditer(rb"(?s)trailer\s*<<(.*?)>>\s*startxref", data)]
    for place, number, generation, body in _direct_objects(data):
        mark = re.search(rb"\bstream\r?\n", body)
        head = body[: mark.start()] if mark else body
        if re.search(rb"/Type\s*/XRef\b", head):
            trailers.append((place, head))
        elif re.search(rb"/Type\s*/ObjStm\b", head):
            plain = _stream(body)
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"N", b"First"))
            table = list(map(int, plain[:first].split()[: 2 * n]))
            starts = [first + x for x in table[1::2]] + [len(plain)]
            for inner, a, b in zip(table[::2], starts[:-1], starts[1:], strict=True):
                objects[inner] = (b"0", b"\n" + plain[a:b].strip() + b"\n")
        else:
            objects[number] = (generation, body)
    trailer = max(trailers, default=(0, b""))[1]
    if b"/Encrypt" in trailer or any(b"/Encrypt" in t for _, t in trailers):
        raise CodecError("encrypted PDF")
    return objects, trailer


def _literal(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[1], m[1]), raw[1:-1])
    return raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")


_STRING = rb"(\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)"


def _info_number(trailer: bytes) -> int | None:
    found = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", trailer)
    return int(found[1]) if found else None


def read_pdf(data: bytes) -> list[tuple[str, str]]:
    objects, trailer = _pdf_objects(data)
    heads = [body.partition(b"stream")[0] for _, body in objects.values()]
    out = [("PageCount", str(sum(bool(re.search(rb"/Type\s*/Page(?![a-zA-Z])", h)) for h in heads)))]
    info = objects.get(_info_number(trailer), (b"", b""))[1]
    for key in tags.PDF_KEYS:
        if m := re.search(rb"/" + key.encode() + rb"\s*" + _STRING, info):
            out.append((key, _literal(m[1])))
    if any(re.search(rb"/Type\s*/Metadata\b|/Metadata\s+\d", h) for h in heads) or b"<x:xmpmeta" in data:
        out.append(("Xmp", "packet"))
    return out


def rewrite_pdf(data: bytes, values: dict[str, str]) -> bytes:
    """The document with ``values`` as its information dictionary and without XMP packets, watermarks, stamps and optional-content
    groups. Objects are rewritten at their old numbers, those of compressed object streams plainly, and a new cross-reference table is
    made; older revisions go."""
    objects, trailer = _pdf_objects(data)
    root = re.search(rb"/Root\s+(\d+)\s+(\d+)\s+R", trailer)
    if not root or int(root[1]) not in objects:
        raise CodecError("PDF without a root")
    info = _info_number(trailer)
    gone = {info} if info else set()
    for number, (_, body) in objects.items():
        body = body.partition(b"stream")[0]
        if re.search(rb"/Type\s*/Metadata", body) or re.search(rb"/Subtype\s*/(Watermark|Stamp)\b", body) or re.search(rb"/IT\s*/Watermark\b", body):
            gone.add(number)
    kept = {n: o for n, o in objects.items() if n not in gone}
    dead = b"|".join(str(n).encode() for n in sorted(gone)) or b"x"
    for number, (generation, body) in kept.items():
        head, mark, rest = body.partition(b"stream")
        head = re.sub(rb"/Metadata\s+\d+\s+\d+\s+R", b"", head)
        head = re.sub(rb"(?s)/OCProperties\s*<<.*?>>(?=\s*(?:/[A-Z]|>>\s*$))", b"", head)
        head = re.sub(rb"(/Annots\s*\[)([^\]]*)(\])", lambda m: m[1] + re.sub(rb"(?<!\d)(?:" + dead + rb")\s+\d+\s+R", b"", m[2]) + m[3], head)
        kept[number] = (generation, head + mark + rest)
    escape = lambda v: b"(" + re.sub(rb"([()\\])", rb"\\\1", v.encode("latin-1")) + b")" if v.isascii() else b"<" + ("﻿" + v).encode("utf-16-be").hex().encode() + b">"
    extra = b""
    if values:
        number = max(kept) + 1
        kept[number] = (b"0", b"\n<< " + b" ".join(b"/" + k.encode() + b" " + escape(v) for k, v in values.items()) + b" >>\n")
        extra = b" /Info %d 0 R" % number
    out, places = bytearray(data[: data.index(b"\n") + 1] if b"\n" in data[:32] else b"%PDF-1.4\n"), {}
    for number in sorted(kept):
        places[number] = len(out)
        out += b"%d %s obj" % (number, kept[number][0]) + kept[number][1] + b"endobj\n"
    size, at = max(kept) + 1, len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for number in range(1, size):
        out += b"%010d %05d n \n" % (places[number], int(kept[number][0])) if number in places else b"0000000000 00000 f \n"
    out += b"trailer\n<< /Size %d /Root %s %s R%s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root[1], root[2], extra, at)
    return bytes(out)


# ---- by type ----------------------------------------------------------------------------------------------------------

READERS = {"image/jpeg": read_jpeg, "image/png": read_png, "image/webp": read_webp, "image/heic": read_heif, "image/heif": read_heif, "audio/mpeg": read_mp3, "audio/ogg": read_ogg, "video/mp4": read_mp4, "audio/mp4": read_mp4, "video/quicktime": read_mp4, tags.PDF_TYPE: read_pdf}
WRITERS = {"image/jpeg": rewrite_jpeg, "image/png": rewrite_png, "image/webp": rewrite_webp, "image/heic": rewrite_heif, "image/heif": rewrite_heif, "audio/mpeg": rewrite_mp3, "audio/ogg": rewrite_ogg, "video/mp4": rewrite_mp4, "audio/mp4": rewrite_mp4, "video/quicktime": rewrite_mp4, tags.PDF_TYPE: rewrite_pdf}


def _guard(call, *args):
    try:
        return call(*args)
    except CodecError:
        raise
    except (struct.error, zlib.error, IndexError, KeyError, TypeError, ValueError, UnicodeError, RecursionError) as e:
        raise CodecError(f"damaged file: {e}") from e


def is_opaque(mime: str | None) -> bool:
    """Whether a type is none of image, video, audio and PDF: such files pass unchanged."""
    return not (mime or "").startswith(("image/", "video/", "audio/")) and mime != tags.PDF_TYPE


def read(mime: str | None, data: bytes | None) -> list[tuple[str, str]]:
    """Attributes of a file; none for an opaque type."""
    if data is None:
        raise CodecError("no bytes")
    if is_opaque(mime):
        return []
    if mime not in READERS:
        raise CodecError(f"unsupported type {mime}")
    return _guard(READERS[mime], data)


def rewrite(mime: str | None, data: bytes | None, values: dict[str, str] | None = None, keep_orientation: bool = True, thumbnail: str = "REMOVE") -> bytes:
    """A file with ``values`` as its only metadata (and its orientation, if kept, and with KEEP_ORIGINAL a JPEG's thumbnail); opaque types unchanged."""
    if data is None:
        raise CodecError("no bytes")
    if is_opaque(mime):
        return data
    if mime not in WRITERS:
        raise CodecError(f"unsupported type {mime}")
    values = dict(values or {})
    if keep_orientation and mime in ("image/jpeg", "image/png", "image/webp", "image/heic", "image/heif"):
        old = dict(_guard(READERS[mime], data)).get("Orientation", "")
        if old.isdigit():
            values["Orientation"] = old
    if mime == "image/jpeg":
        return _guard(rewrite_jpeg, data, values, thumbnail == "KEEP_ORIGINAL")
    return _guard(WRITERS[mime], data, values)
