"""Reading, stripping, replacing and comparing metadata as rows (uri, key, value).

``attributes`` is what a file holds: (uri, entry_ord, key, value) with any keys. ``entries`` is what a preview shows of it.
``files`` is the catalogue: (uri, mime_type, ...). :func:`records` brings a file's attributes and plan to its row with one exchange of
each table by uri; entries, replacing, previews and differences are then functions of that row's arrays, which hold no more than one
file's metadata, and only the end result is exploded. Rows with a null uri belong to no file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import tags
from palimpsest.functions.labels import duration_label, location_text, plain_sql, resolution_label
from palimpsest.functions.names import blank
from palimpsest.functions.seeded import listed, quoted
from palimpsest.functions.types import media_class
from palimpsest.operators.plans import FIELDS, PLACE


TRACK_KEYS = ("HasVideo", "Width", "Height", "DurationMs")


def _literals(names: Sequence[str]) -> Column:
    return F.expr(listed(names))


ENTRY = "array<struct<entry_ord:int,key:string,value:string>>"


def records(files: DataFrame, attributes: DataFrame, plans: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(uri, mime_type, kind, attrs, plan, error): each file with its attributes in order, its plan and its reading error, null if it has none."""
    held = attributes.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct(F.col("entry_ord").cast("int").alias("entry_ord"), "key", "value"))).alias("attrs"))
    rows = files.select("uri", "mime_type", media_class(F.col("mime_type")).alias("kind")).join(held, "uri", "left")
    if plans is not None:
        rows = rows.join(plans.select("uri", F.struct(*FIELDS).alias("plan")), "uri", "left")
    if errors is not None:
        rows = rows.join(errors.groupBy("uri").agg(F.min("error").alias("error")), "uri", "left")
    rows = rows.withColumn("attrs", F.coalesce("attrs", F.array().cast(ENTRY)))
    return rows if errors is not None else rows.withColumn("error", F.lit(None).cast("string"))


def _entry(order: Column, key: Column, value: Column) -> Column:
    return F.struct(order.cast("int").alias("entry_ord"), key.alias("key"), value.alias("value"))


def _one(key: str, value: Column) -> Column:
    return F.array(_entry(F.lit(0), F.lit(key), value))


def _values(attrs: Column, key: Column | str) -> Column:
    """The last value under ``key``, null if there is none."""
    return F.try_element_at(F.filter(attrs, lambda a: a["key"] == key), F.lit(-1))["value"]


def _in_order(attrs: Column, names: Sequence[str]) -> Column:
    """The attributes under ``names``, in the order of the names; attributes of one name stay in their own order."""
    found = F.filter(attrs, lambda a: a["key"].isin(*names))
    placed = F.transform(found, lambda a: F.struct(F.array_position(_literals(names), a["key"]).cast("int").alias("place"), a["entry_ord"].alias("was"), a["key"].alias("key"), a["value"].alias("value")))
    return F.transform(F.array_sort(placed), lambda a: _entry(a["place"], a["key"], a["value"]))


def _said(attrs: Column) -> Column:
    return F.filter(attrs, lambda a: ~blank(a["value"]))


def _image_entries(shown: Column, error: Column) -> Column:
    failed = _one("Error", F.concat(F.lit("Could not read metadata: "), error))
    return F.when(error.isNotNull(), failed).when(F.size(shown) == 0, _one("Info", F.lit(tags.NO_EXIF))).otherwise(shown)


def _media_entries(attrs: Column) -> Column:
    value = lambda k: _values(attrs, k)
    shown = [("Title", value("Title")), ("Artist", value("Artist")), ("Album", value("Album")), ("Date", value("Date")), ("Location (Raw)", value("Location")),
             ("Resolution", F.when(value("HasVideo") == "yes", resolution_label(value("Width"), value("Height")))),
             ("Duration", F.when(value("DurationMs").isNotNull(), duration_label(value("DurationMs"))))]
    return F.filter(F.array(*[_entry(F.lit(i), F.lit(k), v) for i, (k, v) in enumerate(shown, 1)]), lambda a: a["value"].isNotNull())


def _pdf_entries(attrs: Column) -> Column:
    known = _in_order(F.filter(attrs, lambda a: a["value"].isNotNull()), ("PageCount", *tags.PDF_KEYS))
    return F.transform(known, lambda a: _entry(a["entry_ord"], F.when(a["key"] == "PageCount", "Page Count").otherwise(a["key"]), a["value"]))


def with_entries(rows: DataFrame, held: str = "attrs", name: str = "shown") -> DataFrame:
    """``rows`` of :func:`records` with what a preview shows of each file's attributes ``held``, as an array ``name``: images their tags, or one
    Error or Info row; media title to duration; PDFs the page count and what the information dictionary has; types that can't be read one Info row."""
    kind, attrs = F.col("kind"), F.col(held)
    none = _one("Info", F.concat(F.lit(tags.UNSUPPORTED), F.coalesce("mime_type", F.lit(""))))
    rows = rows.withColumn("__tagged", F.when(kind == "image", _in_order(_said(attrs), tags.PREVIEW_TAGS)))
    shown = F.when(kind == "image", _image_entries(F.col("__tagged"), F.col("error"))).when(kind.isin("video", "audio"), _media_entries(attrs)).when(kind == "pdf", _pdf_entries(attrs)).otherwise(none)
    return rows.withColumn(name, shown).drop("__tagged")


def project_tags(attributes: DataFrame, names: Sequence[str] = tags.PREVIEW_TAGS) -> DataFrame:
    """Entries of the tags ``names``, in their order; null and blank values are left out."""
    order = F.array_position(_literals(names), F.col("key"))
    return attributes.where(F.col("key").isin(*names) & ~blank(F.col("value"))).select("uri", order.cast("int").alias("entry_ord"), "key", "value")


def metadata_entries(files: DataFrame, attributes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """What a preview shows of every file: (uri, entry_ord, key, value), see :func:`with_entries`; ``errors`` is (uri, error)."""
    return with_entries(records(files, attributes, errors=errors)).select("uri", F.inline("shown"))


def _of_class(files: DataFrame, attributes: DataFrame, *kinds: str) -> DataFrame:
    return attributes.join(files.where(media_class(F.col("mime_type")).isin(*kinds)).select("uri"), "uri", "left_semi").select("uri", "entry_ord", "key", "value")


def _kept_by_image_rules(rows: DataFrame, keep_orientation: bool, thumbnail: str) -> DataFrame:
    """Orientation stays only on demand and if it says something; thumbnail tags stay only on demand."""
    rows = rows.where((F.col("key") != "Orientation") | (F.lit(keep_orientation) & ~blank(F.col("value"))))
    return rows if thumbnail == "KEEP_ORIGINAL" else rows.where(~F.col("key").isin(*tags.THUMBNAIL_TAGS))


def strip_image(files: DataFrame, attributes: DataFrame, keep_orientation: bool = True, thumbnail: str = "REMOVE", strict: bool = True) -> DataFrame:
    """What is left of the attributes of image files.

    ``strict`` leaves only structural tags; otherwise the listed privacy tags go and unlisted ones (such as maker notes) stay.
    """
    rows = _of_class(files, attributes, "image")
    if strict:
        thumbs = tags.THUMBNAIL_TAGS if thumbnail == "KEEP_ORIGINAL" else ()
        rows = rows.where(F.col("key").isin(*tags.STRUCTURE_TAGS, "Orientation", *thumbs))
    else:
        rows = rows.where(~F.col("key").isin(*tags.PRIVACY_TAGS))
    return _kept_by_image_rules(rows, keep_orientation, thumbnail)


def strip_pdf(files: DataFrame, attributes: DataFrame, strict: bool = True) -> DataFrame:
    """What is left of the attributes of PDF files: the information dictionary's keys go, and the XMP packet too if ``strict``."""
    return _of_class(files, attributes, "pdf").where(~F.col("key").isin(*tags.PDF_KEYS, *(("Xmp",) if strict else ())))


def strip_media(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """What is left of the attributes of video and audio files after rewriting their tracks: what the tracks themselves say."""
    return _of_class(files, attributes, "video", "audio").where(F.col("key").isin(*TRACK_KEYS))


def keep_tracks(tracks: Column) -> Column:
    """Of an array of tracks (with a field mime) those of video and audio; none left is an error."""
    kept = F.filter(tracks, lambda t: F.startswith(t["mime"], F.lit("video/")) | F.startswith(t["mime"], F.lit("audio/")))
    return F.when(F.size(kept) > 0, kept).otherwise(F.raise_error("no usable track"))


def keep_annotations(annotations: Column) -> Column:
    """Of an array of annotations (subtype, intent) those that are no watermark or stamp."""
    odd = lambda a: F.coalesce(a["subtype"].isin("Watermark", "Stamp"), F.lit(False)) | F.coalesce(a["intent"] == "Watermark", F.lit(False))
    return F.filter(annotations, lambda a: ~odd(a))


def _text_of(field: str, column: str) -> str:
    """A plan's field as SQL text: coordinates as plain numbers."""
    return plain_sql(column) if field in PLACE[:2] else f"cast({column} as string)"


def target_rows(plans: DataFrame, targets: Sequence[tuple[str, str]]) -> DataFrame:
    """(uri, entry_ord, key, value) of the plan fields in ``targets``; null fields are left out."""
    rows = ", ".join(f"struct({i} as entry_ord, {quoted(k)} as key, {_text_of(f, f)} as value)" for i, (k, f) in enumerate(targets, 1))
    return plans.selectExpr("uri", f"inline(array({rows}))").where("value is not null")


def targets_of(plan: str, targets: Sequence[tuple[str, str]]) -> Column:
    """The fields of the plan in column ``plan`` under the keys of ``targets``, as an array; null fields, and all of a null plan, are left out."""
    rows = ", ".join(f"struct({i} as entry_ord, {quoted(k)} as key, {_text_of(f, f'{plan}.{f}')} as value)" for i, (k, f) in enumerate(targets, 1))
    return F.expr(f"filter(array({rows}), a -> a.value is not null)")


def _set(kept: Column, new: Column) -> Column:
    """``kept`` without the keys that ``new`` sets, and ``new`` behind it."""
    keys = F.transform(new, lambda a: a["key"])
    return F.concat(F.filter(kept, lambda a: ~F.array_contains(keys, a["key"])), F.transform(new, lambda a: _entry(a["entry_ord"] + 1000, a["key"], a["value"])))


KINDS = (("image",), ("pdf",), ("video", "audio"))


def _of_kind(kind: Column, kinds: Sequence[str], rules: dict[str, Callable[[], Column]], otherwise: Column) -> Column:
    """What the rule of a file's type says, ``rules`` by the first of KINDS; only those of ``kinds`` are made."""
    out = None
    for group in KINDS:
        if set(group) & set(kinds):
            out = (F if out is None else out).when(kind.isin(*group), rules[group[0]]())
    return out.otherwise(otherwise)


def _kept(kind: Column, attrs: Column, keep_orientation: bool, thumbnail: str, strict: bool, listed: Sequence[str], kinds: Sequence[str] = sum(KINDS, ())) -> Column:
    """What the rules of a file's type leave of its attributes. ``listed`` are the tags that images lose if not ``strict``."""
    thumbs = tags.THUMBNAIL_TAGS if thumbnail == "KEEP_ORIGINAL" else ()

    def image() -> Column:
        if strict:
            left = F.filter(attrs, lambda a: a["key"].isin(*tags.STRUCTURE_TAGS, "Orientation", *thumbs))
        else:
            left = F.filter(attrs, lambda a: ~a["key"].isin(*listed, *(() if thumbs else tags.THUMBNAIL_TAGS)))
        return F.filter(left, lambda a: (a["key"] != "Orientation") | (F.lit(keep_orientation) & ~blank(a["value"])))

    pdf = lambda: F.filter(attrs, lambda a: ~a["key"].isin(*tags.PDF_KEYS, *(("Xmp",) if strict else ())))
    media = lambda: F.filter(attrs, lambda a: a["key"].isin(*TRACK_KEYS))
    return _of_kind(kind, kinds, {"image": image, "pdf": pdf, "video": media}, attrs)


def _replaced(kind: Column, attrs: Column, plan: str, keep_orientation: bool = True, thumbnail: str = "REMOVE", strict: bool = True, kinds: Sequence[str] = sum(KINDS, ())) -> Column:
    """A file's attributes after replacing: images and PDFs get the plan's tags, media its place (as containers hold it, in single precision)."""
    none = F.array().cast(ENTRY)

    def place() -> Column:
        text = F.format_string("%+.4f%+.4f/", F.col(plan)["latitude"].cast("float"), F.col(plan)["longitude"].cast("float"))
        return F.when(F.col(plan).isNotNull(), F.array(_entry(F.lit(1), F.lit("Location"), text))).otherwise(none)

    new = _of_kind(kind, kinds, {"image": lambda: targets_of(plan, tags.IMAGE_TARGETS), "pdf": lambda: targets_of(plan, tags.PDF_TARGETS), "video": place}, none)
    return _set(_kept(kind, attrs, keep_orientation, thumbnail, strict, tags.LEAK_TAGS, kinds), new)


def _poisoned(files: DataFrame, attributes: DataFrame, plans: DataFrame, kinds: tuple[str, ...], **rules) -> DataFrame:
    rows = records(files, attributes, plans).where(F.col("kind").isin(*kinds))
    return rows.select("uri", F.inline(_replaced(F.col("kind"), F.col("attrs"), "plan", kinds=kinds, **rules)))


def poison_image(files: DataFrame, attributes: DataFrame, plans: DataFrame, keep_orientation: bool = True, thumbnail: str = "REMOVE", strict: bool = True) -> DataFrame:
    """The attributes of image files after replacing: strict strips first, otherwise only the leak tags go and the plan's tags are set."""
    return _poisoned(files, attributes, plans, ("image",), keep_orientation=keep_orientation, thumbnail=thumbnail, strict=strict)


def poison_pdf(files: DataFrame, attributes: DataFrame, plans: DataFrame, strict: bool = True) -> DataFrame:
    """The attributes of PDF files with an information dictionary from their plans."""
    return _poisoned(files, attributes, plans, ("pdf",), strict=strict)


def poison_media(files: DataFrame, attributes: DataFrame, plans: DataFrame) -> DataFrame:
    """The attributes of video and audio files after replacing: the tracks and the plan's place."""
    return _poisoned(files, attributes, plans, ("video", "audio"))


def preview_targets_of(kind: Column, plan: str, entries: Column, keep_orientation: bool = True) -> Column:
    """What the literal preview of replacing shows of one file: the plan's values under the keys of its type, and the orientation that stays."""
    old = _values(entries, "Orientation")
    images = targets_of(plan, tags.IMAGE_TARGETS)
    if keep_orientation:
        images = F.concat(images, F.filter(F.array(_entry(F.lit(len(tags.IMAGE_TARGETS) + 1), F.lit("Orientation"), old)), lambda a: a["value"].isNotNull()))
    place = F.array(_entry(F.lit(0), F.lit("Location"), location_text(F.col(plan)["latitude"], F.col(plan)["longitude"])))
    return (
        F.when(kind == "image", images).when(kind == "video", F.concat(place, targets_of(plan, tags.VIDEO_TARGETS)))
        .when(kind == "audio", F.concat(place, targets_of(plan, tags.AUDIO_TARGETS))).when(kind == "pdf", targets_of(plan, tags.PDF_PREVIEW_TARGETS))
        .otherwise(F.array().cast(ENTRY))
    )


def last_wins(entries: DataFrame) -> DataFrame:
    """(uri, entry_ord, key, value): of repeated keys the last value, at the place of the first."""
    return entries.groupBy("uri", "key").agg(F.min("entry_ord").alias("entry_ord"), F.max_by("value", "entry_ord").alias("value")).select("uri", "entry_ord", "key", "value")


def first_match(entries: DataFrame, key: str) -> DataFrame:
    """(uri, value): the first value under ``key``."""
    return entries.where(F.col("key") == key).groupBy("uri").agg(F.min_by("value", "entry_ord").alias("value"))


def _change(o: Column, n: Column, strict: bool = False) -> tuple[Column, Column]:
    """(change_kind, label) of an old and a new value. ADDED: only new; UNCHANGED: equal; CHANGED: both and different; only old: REMOVED if ``strict``, else UNCHANGED."""
    gone = F.concat(o, F.lit(tags.ARROW + "[REMOVED]")) if strict else F.concat(F.lit("[UNCHANGED] "), o)
    kind = F.when(o.isNull(), "ADDED").when(n.isNull(), "REMOVED" if strict else "UNCHANGED").when(o == n, "UNCHANGED").otherwise("CHANGED")
    label = F.when(o.isNull(), F.concat(F.lit("[ADDED] "), n)).when(n.isNull(), gone).when(o == n, F.concat(F.lit("[UNCHANGED] "), o)).otherwise(F.concat(F.lit("[CHANGED] "), o, F.lit(tags.ARROW), n))
    return kind, label


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, entry_ord, key, change_kind, old_value, new_value, value) over the keys of two tables of entries, old ones first.

    A full outer join by (uri, key), for tables that aren't records of the same files; ``value`` is the rendered label.
    """
    a = last_wins(old).select("uri", "key", F.col("entry_ord").alias("old_ord"), F.col("value").alias("old_value"))
    b = last_wins(new).select("uri", "key", F.col("entry_ord").alias("new_ord"), F.col("value").alias("new_value"))
    kind, label = _change(F.col("old_value"), F.col("new_value"))
    both = a.join(b, ["uri", "key"], "full_outer")
    return both.select("uri", F.coalesce("old_ord", F.col("new_ord") + 10_000).alias("entry_ord"), "key", kind.alias("change_kind"), "old_value", "new_value", label.alias("value"))


def remove_preview(files: DataFrame, attributes: DataFrame, strict: bool = True, keep_orientation: bool = True, errors: DataFrame | None = None) -> DataFrame:
    """(uri, entry_ord, key, value): what removing does to each entry, or one Info row for a file without entries.

    ``strict`` marks only what stripping really removes; otherwise every entry, placeholders included, counts as removed.
    """
    rows = with_entries(records(files, attributes, errors=errors))
    if strict:
        rows = rows.withColumn("__after", _kept(F.col("kind"), F.col("attrs"), keep_orientation, "REMOVE", True, tags.PRIVACY_TAGS))
        rows = with_entries(rows, "__after", "__left").withColumn("__left", F.transform("__left", lambda a: a["key"]))

    def mark(a: Column) -> Column:
        gone = F.concat(a["value"], F.lit(tags.ARROW + "[REMOVED]"))
        value = F.when(F.array_contains("__left", a["key"]) | (a["entry_ord"] == 0), a["value"]).otherwise(gone) if strict else gone
        return _entry(a["entry_ord"], a["key"], value)

    marked = F.when(F.size("shown") == 0, _one("Info", F.lit(tags.NOTHING_TO_REMOVE))).otherwise(F.transform("shown", mark))
    return rows.select("uri", F.inline(marked))


def changes(files: DataFrame, attributes: DataFrame, plans: DataFrame, keep_orientation: bool = True, errors: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(uri, kind, entry_ord, key, change_kind, old_value, new_value, value): what changes in each file that has a plan, old entries first.

    ``strict`` compares what a preview shows of the file with what it shows of the file as replacing really leaves it; otherwise with
    the plan's own values, in which case what only the file has counts as unchanged. Of repeated keys the last value counts.
    """
    rows = with_entries(records(files, attributes, plans, errors)).where("plan is not null")
    if strict:
        rows = rows.withColumn("__after", _replaced(F.col("kind"), F.col("attrs"), "plan", keep_orientation))
        rows = with_entries(rows.withColumn("error", F.lit(None).cast("string")), "__after", "target")
        rows = rows.withColumns({c: F.filter(c, lambda a: a["entry_ord"] > 0) for c in ("shown", "target")})  # without placeholders
    else:
        rows = rows.withColumn("target", preview_targets_of(F.col("kind"), "plan", F.col("shown"), keep_orientation))
    side = lambda name, new: F.transform(name, lambda a, i: F.struct(F.lit(new).alias("new"), i.alias("at"), a["key"].alias("key"), a["value"].alias("text")))
    # Rows are dealt by uri already, so grouping by uri and key moves nothing.
    both = rows.select("uri", "kind", F.inline(F.concat(side("shown", False), side("target", True))))
    old, new = F.when(~F.col("new"), F.col("at")), F.when(F.col("new"), F.col("at"))
    found = both.groupBy("uri", "kind", "key").agg(
        F.min(old).alias("old_at"), F.min(new).alias("new_at"), F.max_by("text", old).alias("old_value"), F.max_by("text", new).alias("new_value")
    )
    kind, label = _change(F.col("old_value"), F.col("new_value"), strict)
    order = (F.coalesce("old_at", F.col("new_at") + 10_000) + 1).cast("int")
    return found.select("uri", "kind", order.alias("entry_ord"), "key", kind.alias("change_kind"), "old_value", "new_value", label.alias("value"))


def poison_preview(files: DataFrame, attributes: DataFrame, plans: DataFrame, keep_orientation: bool = True, errors: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The rows of :func:`changes`; a file without a plan gets one Info row."""
    none = F.lit(None).cast("string")
    found = changes(files, attributes, plans, keep_orientation, errors, strict).drop("kind")
    bare = files.where("uri is not null").join(plans.select("uri"), "uri", "left_anti")
    info = [F.lit(0).alias("entry_ord"), F.lit("Info").alias("key"), none.alias("change_kind"), none.alias("old_value"), none.alias("new_value"), F.lit(tags.NO_PLAN).alias("value")]
    return found.unionByName(bare.select("uri", *info))


def change_counts(files: DataFrame, attributes: DataFrame, plans: DataFrame, strict: bool = True) -> DataFrame:
    """(mime_class, change_kind, n_entries, n_files): how many entries of how many files replacing adds, changes, removes and leaves."""
    per_file = changes(files, attributes, plans, strict=strict).groupBy("uri", "kind", "change_kind").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(F.col("kind").alias("mime_class"), "change_kind").agg(F.sum("n").alias("n_entries"), F.count(F.lit(1)).alias("n_files"))


def leak_audit(before: DataFrame, after: DataFrame, public: Sequence[str] = (*tags.STRUCTURE_TAGS, "Orientation", *TRACK_KEYS, "PageCount")) -> DataFrame:
    """(uri, key, value, after_key): original values that still occur in the file's output, under any key; structural keys are no leak."""
    old = before.where(~F.col("key").isin(*public) & ~blank(F.col("value"))).select("uri", "key", "value").distinct()
    new = after.where(~F.col("key").isin(*public)).select("uri", F.col("key").alias("after_key"), "value").distinct()
    return old.join(new, ["uri", "value"]).select("uri", "key", "value", "after_key")

