"""Metadata keys and labels that results are expressed in. Public EXIF 2.3, PDF and media key names."""

#: Tags that a preview of an image shows, in this order.
PREVIEW_TAGS = (
    "Artist", "Copyright", "DateTime", "DateTimeDigitized", "DateTimeOriginal", "ImageDescription", "ImageLength", "ImageWidth",
    "Make", "Model", "Orientation", "Software", "UserComment", "GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef",
    "GPSAltitude", "GPSTimeStamp", "GPSDateStamp", "Flash", "FocalLength", "WhiteBalance", "ExposureTime", "FNumber",
    "PhotographicSensitivity", "BodySerialNumber", "LensMake", "LensModel", "LensSerialNumber",
)

#: Tags that stripping an image removes.
PRIVACY_TAGS = (
    "Artist", "Copyright", "DateTime", "DateTimeDigitized", "DateTimeOriginal", "DeviceSettingDescription", "ImageDescription",
    "ImageUniqueID", "Make", "Model", "Software", "SubSecTime", "SubSecTimeDigitized", "SubSecTimeOriginal", "UserComment",
    "GPSAltitude", "GPSAltitudeRef", "GPSDateStamp", "GPSDestBearing", "GPSDestBearingRef", "GPSImgDirection", "GPSImgDirectionRef",
    "GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "GPSProcessingMethod", "GPSSpeed", "GPSSpeedRef",
    "GPSTimeStamp", "GPSMapDatum", "GPSSatellites", "GPSStatus", "GPSMeasureMode", "GPSDOP", "GPSTrack", "GPSTrackRef", "GPSVersionID",
    "Flash", "FocalLength", "WhiteBalance", "ExposureTime", "FNumber", "PhotographicSensitivity", "BodySerialNumber", "LensMake",
    "LensModel", "LensSerialNumber", "Xmp", "CameraOwnerName", "OwnerName", "ImageResources", "PrintIM",
)

#: Tags that replacing values in an image clears besides.
LEAK_TAGS = ("Artist", "Copyright", "GPSAltitude", "GPSAltitudeRef", "BodySerialNumber", "LensSerialNumber", "Xmp")

#: Tags of an embedded thumbnail.
THUMBNAIL_TAGS = ("JPEGInterchangeFormat", "JPEGInterchangeFormatLength")

#: What strict stripping leaves in an image: nothing that tells who, where, when or with what.
STRUCTURE_TAGS = (
    "ImageWidth", "ImageLength", "BitsPerSample", "Compression", "PhotometricInterpretation", "SamplesPerPixel", "PlanarConfiguration",
    "XResolution", "YResolution", "ResolutionUnit", "YCbCrPositioning", "ColorSpace", "PixelXDimension", "PixelYDimension",
)

#: Keys of a PDF's information dictionary.
PDF_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")

#: The key of a plan's field in an image: (tag, plan column).
IMAGE_TARGETS = (
    ("DateTime", "dateTime"), ("DateTimeOriginal", "dateTime"), ("DateTimeDigitized", "dateTime"), ("Make", "make"), ("Model", "model"),
    ("Software", "software"), ("ImageDescription", "imageDescription"), ("UserComment", "userComment"),
    ("PhotographicSensitivity", "photographicSensitivity"), ("ExposureTime", "exposureTime"), ("FNumber", "fNumber"),
    ("FocalLength", "focalLength"), ("WhiteBalance", "whiteBalance"), ("Flash", "flash"), ("GPSLatitude", "latitude"),
    ("GPSLatitudeRef", "latitudeRef"), ("GPSLongitude", "longitude"), ("GPSLongitudeRef", "longitudeRef"),
)
VIDEO_TARGETS = (("Title", "title"), ("Director", "artist"), ("Year", "year"), ("Genre", "genre"), ("Date", "mediaDate"))
AUDIO_TARGETS = (("Title", "title"), ("Artist", "artist"), ("Album", "album"), ("Year", "year"), ("Genre", "genre"), ("Date", "mediaDate"))
#: What a preview shows for a PDF, and what replacing writes into one.
PDF_PREVIEW_TARGETS = (("Title", "pdfTitle"), ("Author", "author"), ("Creator", "creator"), ("Producer", "producer"))
PDF_TARGETS = (("Title", "pdfTitle"), ("Author", "author"), ("Subject", "subject"), ("Keywords", "keywords"), ("Creator", "creator"), ("Producer", "producer"))

#: Extension by the beginning of a MIME type, first match; a PDF's type must match whole.
EXTENSIONS = (
    ("image/jpeg", ".jpg"), ("image/png", ".png"), ("image/webp", ".webp"), ("image/heif", ".heic"), ("image/heic", ".heic"),
    ("video/mp4", ".mp4"), ("video/quicktime", ".mov"), ("audio/mpeg", ".mp3"), ("audio/mp4", ".m4a"), ("audio/x-m4a", ".m4a"),
)
PDF_TYPE, PDF_EXTENSION, OTHER_EXTENSION = "application/pdf", ".pdf", ".bin"

ARROW = "  →  "
NO_EXIF = "No readable EXIF metadata found"
UNSUPPORTED = "Metadata preview not yet supported for "
NOTHING_TO_REMOVE = "No metadata would be removed"
NO_PLAN = "No replacement plan available"
