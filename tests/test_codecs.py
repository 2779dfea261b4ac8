"""Bytes: small files made here, read, rewritten, written, streamed."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.output import name_outputs, route, unique_names
from palimpsest.operators.plans import generate_plans
from palimpsest.sources import codecs as C
from palimpsest.sources.files import catalog, file_targets, read_attributes, read_bytes, rewrite_files
from palimpsest.sources.sinks import write_files
from palimpsest.streaming import clean_arriving

VALUES = {"Make": "Maker", "Model": "M", "Software": "a longer piece of software", "Orientation": "6", "DateTimeOriginal": "2020:01:02 03:04:05", "UserComment": "hello", "ExposureTime": "1/50", "FNumber": "2.8",
          "GPSLatitude": "45/1,30/1,0/10000", "GPSLatitudeRef": "N", "BodySerialNumber": "SECRET99", "PhotographicSensitivity": "100"}
SCAN = b"\xff\xda\x00\x04\x00\x00" + b"pixels\xff\x00more" * 9 + b"\xff\xd9"


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(values=VALUES, xmp=True, tail=b"appended SECRET99"):
    exif = segment(0xE1, b"Exif\0\0" + C.write_exif(values)) if values else b""
    packet = segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x>SECRET99</x>") if xmp else b""
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + exif + packet + segment(0xFE, b"comment SECRET99") + segment(0xDB, bytes(65)) + SCAN + tail


def chunk(kind, body):
    return struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))


def png():
    return C.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"Author\0SECRET99") + chunk(b"eXIf", C.write_exif(VALUES)) + chunk(b"IDAT", zlib.compress(bytes(8))) + chunk(b"IEND", b"")


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def mp4(kind=b"vide", udta=True, last=True):
    mvhd = box(b"mvhd", struct.pack(">IIIII", 0, 99, 99, 1000, 2500) + bytes(80))
    tkhd = box(b"tkhd", struct.pack(">III", 0, 88, 88) + bytes(64) + struct.pack(">II", 640 << 16, 480 << 16))
    track = box(b"trak", tkhd + box(b"mdia", box(b"mdhd", struct.pack(">IIIII", 0, 77, 77, 1000, 2500) + bytes(4)) + box(b"hdlr", bytes(8) + kind + bytes(12) + b"SECRET99\0")))
    place = b"+45.5000-120.2500/"
    user = box(b"udta", box(b"\xa9xyz", struct.pack(">HH", len(place), 0) + place) + box(b"\xa9nam", struct.pack(">HH", 8, 0) + b"SECRET99")) if udta else b""
    movie, media = box(b"moov", mvhd + track + user), box(b"mdat", b"samples" * 5)
    return box(b"ftyp", b"isom\0\0\0\0") + (media + movie if last else movie + media)


def pdf(extra=b""):
    objects = [b"<< /Type /Catalog /Pages 2 0 R /Metadata 5 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Annots [6 0 R 7 0 R] >>", b"<< /Title (A \\(title\\)) /Author <FEFF00E9> /Producer (SECRET99) >>",
               b"<< /Type /Metadata /Subtype /XML /Length 15 >>\nstream\n<x>SECRET99</x>\nendstream", b"<< /Type /Annot /Subtype /Watermark /Contents (SECRET99) >>", b"<< /Type /Annot /Subtype /Link >>"]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    at = len(out)
    out += b"xref\n0 8\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer\n<< /Size 8 /Root 1 0 R /Info 4 0 R" + extra + b" >>\nstartxref\n%d\n%%%%EOF\n" % at


def test_exif_round_trip():
    got = dict(C.read_exif(C.write_exif(VALUES)))
    assert got == VALUES | {"FNumber": "28/10"}
    big = C.write_exif({"Make": "X"}).replace(b"II*\0", b"XX*\0")
    with pytest.raises(C.CodecError):
        dict(C.read_exif(big))


def test_degrees():
    assert C.degrees_to_rational(-45.5) == "45/1,30/1,0/10000"
    assert C.rational_to_degrees("45/1,30/1,0/10000", "S") == -45.5 and C.rational_to_degrees("x", "N") is None and C.rational_to_degrees("1/0", None) is None


def test_jpeg():
    got = dict(C.read("image/jpeg", jpeg()))
    assert got["Make"] == "Maker" and got["Xmp"] == "<x>SECRET99</x>" and got["GPSLatitude"] == "45/1,30/1,0/10000"
    clean = C.rewrite("image/jpeg", jpeg())
    assert C.read("image/jpeg", clean) == [("Orientation", "6")] and b"SECRET99" not in clean and SCAN in clean
    assert C.read("image/jpeg", C.rewrite("image/jpeg", jpeg(), keep_orientation=False)) == []
    assert C.rewrite("image/jpeg", clean) == clean
    assert dict(C.read("image/jpeg", C.rewrite("image/jpeg", jpeg(), {"Make": "Other"})))["Make"] == "Other"
    assert C.read("image/jpeg", C.rewrite("image/jpeg", jpeg(None, False))) == []


def test_jpeg_ends_at_its_own_end_mark():
    clean = C.rewrite("image/jpeg", jpeg(tail=b""))
    assert C.rewrite("image/jpeg", jpeg(tail=jpeg())) == clean and clean.endswith(SCAN) and clean.count(b"\xff\xd9") == 1
    # a second scan, with tables that hold the end mark's bytes and a comment before it
    tables, scan = b"\xff\xc4\x00\x06\xff\xd9\xff\xd9", b"\xff\xda\x00\x04\x00\x00more\xff\xd0\xff\x00\xff\xd9"
    got = C.rewrite("image/jpeg", jpeg(tail=b"")[:-2] + b"\xff\xfe\x00\x0aSECRET99" + tables + scan + jpeg())
    assert got == clean[:-2] + tables + scan


@pytest.mark.parametrize("bad", [b"", b"\xff\xd8", jpeg()[:40], jpeg()[:-70], b"no picture at all"])
def test_damaged_jpeg_is_an_error(bad):
    with pytest.raises(C.CodecError):
        C.rewrite("image/jpeg", bad)


def test_png():
    assert dict(C.read("image/png", png()))["Author"] == "SECRET99"
    clean = C.rewrite("image/png", png(), keep_orientation=False)
    assert b"SECRET99" not in clean and C.read("image/png", clean) == [("ImageWidth", "3"), ("ImageLength", "2")]
    assert dict(C.read("image/png", C.rewrite("image/png", png(), {"Model": "N"})))["Model"] == "N"
    with pytest.raises(C.CodecError):
        C.rewrite("image/png", png()[:-6])


@pytest.mark.parametrize("last", [True, False])
def test_mp4(last):
    got = dict(C.read("video/mp4", mp4(last=last)))
    assert got == {"DurationMs": "2500", "Width": "640", "Height": "480", "HasVideo": "yes", "Location": "+45.5000-120.2500/", "Title": "SECRET99"}
    clean = C.rewrite("video/mp4", mp4(last=last))
    assert b"SECRET99" not in clean and len(clean) == len(mp4(last=last)) and b"samples" * 5 in clean and "Location" not in dict(C.read("video/mp4", clean))
    moved = C.rewrite("video/mp4", mp4(last=last), {"Location": "+01.0000-002.0000/"})
    assert dict(C.read("video/mp4", moved))["Location"] == "+01.0000-002.0000/" and moved.index(b"samples") == mp4(last=last).index(b"samples")


def test_mp4_without_room_or_with_other_tracks():
    place = {"Location": "+01.0000-002.0000/"}
    assert dict(C.read("video/mp4", C.rewrite("video/mp4", mp4(udta=False), place)))["Location"] == place["Location"]
    for data, values in ((mp4(b"text"), {}), (mp4(b"meta"), {}), (mp4()[:60], {}), (b"", {})):
        with pytest.raises(C.CodecError):
            C.rewrite("video/mp4", data, values)


def test_pdf():
    got = dict(C.read("application/pdf", pdf()))
    assert got["PageCount"] == "1" and got["Title"] == "A (title)" and got["Author"] == "é" and got["Producer"] == "SECRET99"
    clean = C.rewrite("application/pdf", pdf())
    assert b"SECRET99" not in clean and C.read("application/pdf", clean) == [("PageCount", "1")] and b"/Subtype /Link" in clean
    new = C.rewrite("application/pdf", pdf(), {"Title": "b (c)", "Author": "ü"})
    assert dict(C.read("application/pdf", new)) == {"PageCount": "1", "Title": "b (c)", "Author": "ü"}
    at = int(new.rsplit(b"startxref", 1)[1].split()[0])
    assert new[at : at + 4] == b"xref"
    for bad in (b"", pdf()[:60], pdf(b" /Encrypt 9 0 R"), pdf().replace(b"/Root 1 0 R", b"")):
        with pytest.raises(C.CodecError):
            C.rewrite("application/pdf", bad)


def full(kind, *parts):
    return box(kind, bytes(4) + b"".join(parts))


def table(chunks, sizes, wide=False):
    """A sample table with one sample a chunk."""
    places = struct.pack(f">I{len(chunks)}{'Q' if wide else 'I'}", len(chunks), *chunks)
    return box(b"minf", box(b"stbl", full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)) + full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)) + full(b"co64" if wide else b"stco", places)))


def movie(first, kinds=(b"vide", b"meta", b"soun"), wide=False, user=b"", last=False):
    """Tracks whose samples lie by turns in one media box; the first of them after ``first`` bytes."""
    samples = {k: [k + b"-A", k + b"-longer-B"] for k in kinds}
    at, places, media = first, {k: [] for k in kinds}, b""
    for i in range(2):
        for k in kinds:
            places[k].append(at)
            at += len(samples[k][i])
            media += samples[k][i]
    tracks = b"".join(box(b"trak", box(b"mdia", full(b"hdlr", bytes(4) + k + bytes(12) + b"n\0") + table(places[k], list(map(len, samples[k])), wide))) for k in kinds)
    head = box(b"ftyp", b"isom\0\0\0\0")
    moov = box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 9, 9, 1000, 2500) + bytes(80)) + tracks + user)
    return head + (box(b"mdat", media) + moov if last else moov + box(b"mdat", media))


def laid_out(last=False, **how):
    """A movie whose tables say where its samples are."""
    return movie(24 if last else len(movie(0, **how)) - len(b"".join(k + b"-A" + k + b"-longer-B" for k in how.get("kinds", (b"vide", b"meta", b"soun")))), last=last, **how)


def played(data):
    """The samples that the tables of video and audio tracks point to."""
    return [data[a:b] for c, e in C._find(data, b"moov", b"trak") if C._handler(data, c, e) in (b"vide", b"soun") for a, b in C._samples(data, c, e)]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("last", [False, True])
def test_foreign_tracks_go_with_their_samples(wide, last):
    data = laid_out(last, wide=wide)
    assert played(data) == [b"vide-A", b"vide-longer-B", b"soun-A", b"soun-longer-B"]
    clean = C.rewrite("video/mp4", data)
    assert played(clean) == played(data) and b"meta-" not in clean and len(clean) == len(data) and clean.count(b"trak") == 2


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("last", [False, True])
def test_a_place_is_written_without_room(wide, last):
    data = laid_out(last, wide=wide, kinds=(b"vide", b"soun"))
    got = C.rewrite("video/mp4", data, {"Location": "+01.0000-002.0000/"})
    assert dict(C.read("video/mp4", got))["Location"] == "+01.0000-002.0000/" and played(got) == played(data) and len(got) > len(data)
    place = {"Location": "+01.0000-002.0000/"}
    assert dict(C.read("video/mp4", C.rewrite("video/mp4", mp4(udta=False, last=False), place)))["Location"] == place["Location"]


def test_item_lists_are_read_and_go():
    item = lambda k, v: box(k, box(b"data", struct.pack(">II", 1, 0) + v))
    user = box(b"udta", full(b"meta", full(b"hdlr", bytes(4) + b"mdir" + bytes(13)) + box(b"ilst", item(b"\xa9nam", b"SECRET99") + item(b"\xa9ART", "Ä".encode()) + item(b"\xa9day", b"2020") + item(b"covr", b"SECRET99"))))
    data = laid_out(kinds=(b"soun",), user=user)
    got = dict(C.read("audio/mp4", data))
    assert (got["Title"], got["Artist"], got["Date"], got["HasVideo"]) == ("SECRET99", "Ä", "2020", "no")
    clean = C.rewrite("audio/mp4", data)
    assert b"SECRET99" not in clean and played(clean) == played(data) and "Title" not in dict(C.read("audio/mp4", clean))


def webp(extended=True, tail=b""):
    part = lambda k, b: struct.pack("<4sI", k, len(b)) + b + b"\0" * (len(b) % 2)
    lossy = part(b"VP8 ", b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 300, 200) + b"pixels")
    if extended:
        body = part(b"VP8X", bytes([8 | 4 | 32, 0, 0, 0]) + (299).to_bytes(3, "little") + (199).to_bytes(3, "little")) + part(b"ICCP", b"colours") + lossy + part(b"EXIF", C.write_exif(VALUES)) + part(b"XMP ", b"<x>SECRET99</x>") + part(b"odd!", b"SECRET99x")
    else:
        body = lossy
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body + tail


def test_webp():
    got = dict(C.read("image/webp", webp()))
    assert got["Make"] == "Maker" and got["Xmp"] == "<x>SECRET99</x>" and (got["ImageWidth"], got["ImageLength"]) == ("300", "200")
    clean = C.rewrite("image/webp", webp(tail=b"SECRET99"), keep_orientation=False)
    assert b"SECRET99" not in clean and b"pixels" in clean and b"colours" in clean and C.read("image/webp", clean) == [("ImageWidth", "300"), ("ImageLength", "200")]
    assert clean[20] == 32 and C.rewrite("image/webp", clean, keep_orientation=False) == clean
    for data in (webp(), webp(False)):
        new = C.rewrite("image/webp", data, {"Model": "N"}, keep_orientation=False)
        assert dict(C.read("image/webp", new)) == {"ImageWidth": "300", "ImageLength": "200", "Model": "N"} and new[20] & 8 and not new[20] & 4
    assert dict(C.read("image/webp", C.rewrite("image/webp", webp())))["Orientation"] == "6"
    assert C.rewrite("image/webp", webp(False)) == webp(False)
    for bad in (b"", webp()[:40], b"RIFF\x04\0\0\0WEBP"):
        with pytest.raises(C.CodecError):
            C.rewrite("image/webp", bad)


def heic(version=1, inside=False, room=600):
    """A HEIF file with a picture, an EXIF item and an XMP packet, in its media box or within the items' box."""
    exif = struct.pack(">I", 6) + b"Exif\0\0" + C.write_exif(VALUES)
    items = [(b"hvc1", b"picture" * 3), (b"Exif", exif + bytes(room - len(exif))), (b"mime", b"<x>SECRET99</x>")]
    wide = ">I" if version == 2 else ">H"
    infe = b"".join(box(b"infe", bytes([3 if version == 2 else 2, 0, 0, 0]) + struct.pack(wide, i) + b"\0\0" + k + b"\0" + (b"application/rdf+xml\0" if k == b"mime" else b"")) for i, (k, _) in enumerate(items, 1))

    def made(first):
        rows, at = b"", first
        for i, (_, body) in enumerate(items, 1):
            within = inside and i > 1
            rows += struct.pack(wide, i) + (struct.pack(">H", int(within)) if version else b"") + struct.pack(">HHII", 0, 1, at - first - len(items[0][1]) if within else at, len(body))
            at += len(body)
        iloc = box(b"iloc", bytes([version, 0, 0, 0, 0x44, 0]) + struct.pack(wide, len(items)) + rows)
        idat = box(b"idat", items[1][1] + items[2][1]) if inside else b""
        meta = full(b"meta", full(b"hdlr", bytes(4) + b"pict" + bytes(13)), full(b"pitm", b"\0\1"), full(b"iinf", struct.pack(">H", 3) + infe), iloc, idat)
        head = box(b"ftyp", b"heic\0\0\0\0mif1") + meta
        return head, head + box(b"uuid", b"SECRET99" * 3) + box(b"mdat", items[0][1] if inside else b"".join(b for _, b in items))

    return made(len(made(0)[0]) + 32 + 8)[1]


@pytest.mark.parametrize("version", [0, 1, 2])
@pytest.mark.parametrize("inside", [False, True])
def test_heif(version, inside):
    if inside and not version:
        return
    data = heic(version, inside)
    got = dict(C.read("image/heic", data))
    assert got["Make"] == "Maker" and got["Xmp"] == "<x>SECRET99</x>" and got["Orientation"] == "6"
    clean = C.rewrite("image/heic", data, keep_orientation=False)
    assert b"SECRET99" not in clean and len(clean) == len(data) and clean.index(b"picture") == data.index(b"picture") and C.read("image/heic", clean) == []
    assert dict(C.read("image/heif", C.rewrite("image/heif", data, {"Model": "N"}))) == {"Model": "N", "Orientation": "6"}
    for bad, values in ((data, {"Software": "x" * 900}), (data[:100], {}), (b"x", {})):
        with pytest.raises(C.CodecError):
            C.rewrite("image/heic", bad, values)


def id3(version, frames, footer=False):
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    if version == 2:
        body = b"".join(k + len(v).to_bytes(3, "big") + v for k, v in frames)
    else:
        body = b"".join(k + (safe(len(v)) if version == 4 else struct.pack(">I", len(v))) + b"\0\0" + v for k, v in frames)
    body += bytes(20)
    tag = bytes([version, 0, 16 if footer else 0]) + safe(len(body))
    return b"ID3" + tag + body + (b"3DI" + tag if footer else b"")


def test_mp3():
    sound = b"\xff\xfb\x90\x64" + b"frames" * 30
    one = id3(3, [(b"TIT2", b"\0SECRET99"), (b"TPE1", b"\1" + "Jo".encode("utf-16")), (b"APIC", b"\0image/png\0SECRET99")])
    old = b"TAG" + b"Other title".ljust(30, b"\0") + bytes(30) + b"Old album".ljust(30, b"\0") + b"1999" + bytes(31)
    ape = b"SECRET99" + b"APETAGEX" + struct.pack("<IIII", 2000, 8 + 32, 1, 0) + bytes(8)
    got = dict(C.read("audio/mpeg", one + sound + ape + old))
    assert got == {"Title": "SECRET99", "Artist": "Jo", "APIC": "19 bytes", "Album": "Old album", "Date": "1999", "HasVideo": "no"}
    for data in (one + sound + ape + old, sound, id3(4, [(b"TDRC", b"\x032020")], footer=True) + sound, id3(2, [(b"TT2", b"\0SECRET99")]) + bytes(7) + sound + b"SECRET99000008LYRICS200", sound + id3(4, [(b"TIT2", b"\0SECRET99")], footer=True) + old):
        clean = C.rewrite("audio/mpeg", data)
        assert clean == sound and C.read("audio/mpeg", clean) == [("HasVideo", "no")]
    assert dict(C.read("audio/mpeg", id3(2, [(b"TT2", b"\0two")]) + sound))["Title"] == "two"
    assert C.rewrite("audio/mpeg", one + sound, {"Location": "+1-1/"}) == sound
    for bad in (b"", b"x", one, one[:30], sound + one + sound, b"ID3\x03\0\0\xff\0\0\0" + sound):
        with pytest.raises(C.CodecError):
            C.rewrite("audio/mpeg", bad)


def ogg(kind=b"vorbis", comments=("TITLE=SECRET99", "artist=Ä", "METADATA_BLOCK_PICTURE=" + "SECRET99" * 50), lengths=(1,)):
    """An Ogg file; packets are laid over pages of ``lengths`` segments (the last one repeats)."""
    packed = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    body = packed("vendor SECRET99") + struct.pack("<I", len(comments)) + b"".join(map(packed, comments))
    first, *rest = [b"\x01vorbis" + bytes(23), b"\x03vorbis" + body + b"\1", b"\x05vorbis setup" * 30, b"sound" * 99] if kind == b"vorbis" else [b"OpusHead" + bytes(11), b"OpusTags" + body, b"sound" * 99]
    segments = [(part, len(part) < 255) for p in rest for part in [p[i : i + 255] for i in range(0, len(p) + 1, 255)]]
    out, number = b"", 0

    def page(parts, begins=0):
        nonlocal out, number
        head = b"OggS\0" + bytes([begins]) + bytes(8) + struct.pack("<II", 77, number)
        tail = bytes([len(parts)]) + bytes(map(len, parts)) + b"".join(parts)
        out += head + struct.pack("<I", C._ogg_crc(head + bytes(4) + tail)) + tail
        number += 1

    page([first], 2)
    while segments:
        n = lengths[min(number - 1, len(lengths) - 1)]
        page([s for s, _ in segments[:n]])
        segments = segments[n:]
    return out


@pytest.mark.parametrize("kind", [b"vorbis", b"opus"])
@pytest.mark.parametrize("lengths", [(1,), (2, 1, 3), (50,)])
def test_ogg(kind, lengths):
    assert C._ogg_crc(b"") == 0 and C._ogg_crc(b"\1") == 0x04C11DB7
    data = ogg(kind, lengths=lengths)
    assert dict(C.read("audio/ogg", data)) == {"Title": "SECRET99", "Artist": "Ä", "METADATA_BLOCK_PICTURE": "400 characters", "HasVideo": "no"}
    clean = C.rewrite("audio/ogg", data, {"Location": "+1-1/"})
    assert b"SECRET99" not in clean and len(clean) == len(data) and clean[-400:] == data[-400:] and C.read("audio/ogg", clean) == [("HasVideo", "no")]
    for a, b, *_ in C._ogg_pages(clean):
        assert struct.unpack_from("<I", clean, a + 22)[0] == C._ogg_crc(clean[a : a + 22] + bytes(4) + clean[a + 26 : b])
    assert C.rewrite("audio/ogg", clean) == clean
    for bad in (b"", data[:60], data[:-5], data.replace(b"OpusHead", b"OtherOne").replace(b"\x01vorbis", b"\x01theora"), data[len(data) // 2 :]):
        with pytest.raises(C.CodecError):
            C.rewrite("audio/ogg", bad)


def test_thumbnails():
    small = jpeg({"Make": "SECRET99"}, tail=b"")
    exif = C.write_exif(VALUES, small)
    assert C.read_thumbnail(exif) == small and dict(C.read_exif(exif)) == VALUES | {"FNumber": "28/10"}
    data = b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + exif) + segment(0xDB, bytes(65)) + SCAN
    assert C._thumbnail(C.rewrite("image/jpeg", data)) is None
    for values in ({}, {"Model": "other and longer"}):
        kept = C.rewrite("image/jpeg", data, values, thumbnail="KEEP_ORIGINAL")
        assert C._thumbnail(kept) == C.rewrite("image/jpeg", small, keep_orientation=False) and b"SECRET99" not in kept
        assert dict(C.read("image/jpeg", kept)) == {"Orientation": "6"} | values
    assert C.rewrite("image/jpeg", jpeg(), thumbnail="KEEP_ORIGINAL") == C.rewrite("image/jpeg", jpeg())


def compressed_pdf(filters=b"/FlateDecode"):
    """A PDF 1.5 whose catalogue, pages and information lie in an object stream, found by a cross-reference stream."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R /Metadata 5 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>", 4: b"<< /Title (SECRET99) /Author (me) >>"}
    table, bodies = b"", b""
    for number, body in inner.items():
        table += b"%d %d " % (number, len(bodies))
        bodies += body + b" "
    packed = zlib.compress(table + bodies)
    page = zlib.compress(b"BT (text with endobj and 9 0 obj inside) Tj ET", 0)
    out = b"%PDF-1.5\n%\xe2\xe3\n"
    out += b"6 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(page), page)
    out += b"5 0 obj\n<< /Type /Metadata /Subtype /XML /Length 15 >>\nstream\n<x>SECRET99</x>\nendstream\nendobj\n"
    out += b"7 0 obj\n<< /Type /ObjStm /N 4 /First %d /Length %d /Filter %s >>\nstream\n%s\nendstream\nendobj\n" % (len(table), len(packed), filters, packed)
    at, rows = len(out), zlib.compress(bytes(27))
    out += b"8 0 obj\n<< /Type /XRef /Size 9 /W [1 1 1] /Root 1 0 R /Info 4 0 R /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(rows), rows)
    return out + b"startxref\n%d\n%%%%EOF\n" % at, page


def test_compressed_pdf():
    data, page = compressed_pdf()
    assert dict(C.read("application/pdf", data)) == {"PageCount": "1", "Title": "SECRET99", "Author": "me", "Xmp": "packet"}
    clean = C.rewrite("application/pdf", data)
    assert b"SECRET99" not in clean and page in clean and C.read("application/pdf", clean) == [("PageCount", "1")] and b"/ObjStm" not in clean
    new = C.rewrite("application/pdf", data, {"Title": "t"})
    assert dict(C.read("application/pdf", new)) == {"PageCount": "1", "Title": "t"} and C.rewrite("application/pdf", new, {"Title": "t"}) == new
    for bad in (compressed_pdf(b"/LZWDecode")[0], data.replace(b"/Info 4 0 R", b"/Encrypt 4 0 R"), data.replace(b"/First ", b"/Fist ")):
        with pytest.raises(C.CodecError):
            C.rewrite("application/pdf", bad)


def test_repeated_targets_are_no_failure(spark):
    files = spark.createDataFrame([("a", "image/jpeg", bytearray(jpeg())), ("b", "image/webp", bytearray(webp()))], "uri string, mime_type string, content binary")
    targets = spark.createDataFrame([("a", 1, "Make", "one"), ("a", 2, "Make", "two"), ("a", 0, "Make", "zero"), ("a", 1, "Model", None), ("c", 1, "Make", "x")], "uri string, entry_ord int, key string, value string")
    done = {r.uri: r for r in rewrite_files(files, targets, keep_orientation=False).collect()}
    assert C.read("image/jpeg", bytes(done["a"].content)) == [("Make", "two")] and done["b"].status == "ok"


def test_other_types():
    assert C.rewrite("text/plain", b"x") == b"x" and C.read(None, b"x") == []
    for mime in ("image/gif", "audio/flac", "video/webm"):
        with pytest.raises(C.CodecError, match="unsupported"):
            C.rewrite(mime, b"x")


@pytest.fixture
def folder(tmp_path):
    made = {"a.jpg": jpeg(), "b.png": png(), "c.mp4": mp4(), "d.pdf": pdf(), "e.heic": b"x", "f.txt": b"plain", "g.jpg": b"broken", "h h.jpg": jpeg(), "empty.pdf": b""}
    for name, data in made.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_files_end_to_end(spark, folder):
    listed = catalog(spark, str(folder / "in"))
    # Spark's file source lists no empty files
    assert {r.display_name for r in listed.collect()} == {"a.jpg", "b.png", "c.mp4", "d.pdf", "e.heic", "f.txt", "g.jpg", "h_h.jpg"}
    files = read_bytes(spark, str(folder / "in"))
    attributes, errors = read_attributes(files)
    assert {r.uri.rsplit("/", 1)[1] for r in errors.collect()} == {"e.heic", "g.jpg"}
    assert attributes.where("value like '%SECRET99%'").select("uri").distinct().count() == 5
    plans = generate_plans(files)
    for targets in (None, file_targets(plans)):
        done = rewrite_files(files, targets)
        status = {r.uri.rsplit("/", 1)[1]: r.status for r in done.collect()}
        assert {k for k, v in status.items() if v == "error"} == {"e.heic", "g.jpg"}
        assert done.where("status = 'error' and content is not null").count() == 0
        assert done.where(F.contains(F.decode("content", "ISO-8859-1"), F.lit("SECRET99"))).count() == 0
    named = unique_names(name_outputs(route(files.drop("content"))))
    saved = write_files(done.where("status = 'ok'").join(named, "uri"), str(folder / "out"))
    again = write_files(done.where("status = 'ok'").join(named, "uri"), str(folder / "out"))
    for written in (saved, again):
        rows = written.collect()
        assert len(rows) == 6 and all(r.status == "ok" and os.path.exists(r.output_path) for r in rows)
    back, _ = read_attributes(read_bytes(spark, str(folder / "out")))
    make = {r.uri.rsplit("/", 1)[1]: r.value for r in back.where("key = 'Make'").collect()}
    assert make == {f"{n}_processed.{e}": p.make for n, e, p in ((x.display_name.rsplit(".", 1)[0], x.display_name.rsplit(".", 1)[1], x) for x in plans.join(listed.select("uri", "display_name"), "uri").collect()) if e in ("jpg", "png") and n != "g"}
    assert not [f for _, _, names in os.walk(folder / "out") for f in names if f.endswith(".pending")]


def test_missing_files_are_an_error(spark, folder):
    assert catalog(spark).count() == 0 and read_bytes(spark).columns[-1] == "content"
    with pytest.raises(Exception, match="(?i)path"):
        catalog(spark, str(folder / "nowhere")).count()


def test_unwritable_results_are_error_rows(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "taken").write_text("a file where a folder should be")
    rows = spark.createDataFrame([("u", "taken", "n", bytearray(b"x")), ("w", "../up/ok", "n", bytearray(b"y")), ("z", "d", "n", None)], "uri string, relative_path string, output_name string, content binary")
    got = {r.uri: r for r in write_files(rows, str(tmp_path / "out")).collect()}
    assert got["u"].status == "error" and got["z"].status == "error" and got["w"].output_path == f"{tmp_path}/out/up/ok/n"


def test_stream(spark, folder):
    for _ in range(2):
        query = clean_arriving(spark, str(folder / "in"), str(folder / "streamed"), str(folder / "marks"))
        query.awaitTermination(120)
        (folder / "in" / "later.jpg").write_bytes(jpeg())
    found = spark.read.parquet(str(folder / "streamed/_results")).collect()
    assert len(found) == 9 and sum(r.status == "error" for r in found) == 2
    assert all(b"SECRET99" not in open(r.output_path, "rb").read() for r in found if r.output_path)
