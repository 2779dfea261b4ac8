"""Options of a run, with defaults, and reading them from stored key/value rows."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("POISON_METADATA", "REMOVE_METADATA")
FOLDERS = ("UNIFIED", "SPLIT")
THUMBNAILS = ("KEEP_ORIGINAL", "REMOVE")
OUTPUT_ACTIONS = ("SAVE_TO_DEFAULT_FOLDER", "SAVE_TO_SHARED_FOLDER", "SHARE_TO_ANOTHER_APP")
NIGHT_MODES = ("AUTOMATIC", "BATTERY_SAVER", "ALWAYS_ON", "ALWAYS_OFF")
APP_FOLDER = "Processed"


@dataclass(frozen=True)
class Settings:
    """One value per option. ``seed``, ``now_ms`` and ``now_year`` make every generated value a function of the input."""

    use_random_file_names: bool = False
    folder_structure: str = "SPLIT"
    use_subfolders_in_unified: bool = True
    unified_saving_path: str | None = f"Download/{APP_FOLDER}"
    pictures_saving_path: str | None = f"Pictures/{APP_FOLDER}"
    music_saving_path: str | None = f"Music/{APP_FOLDER}"
    movies_saving_path: str | None = f"Movies/{APP_FOLDER}"
    documents_saving_path: str | None = f"Documents/{APP_FOLDER}"
    keep_image_orientation: bool = True
    share_result_as_default: bool = False
    default_prefix: str = ""
    default_suffix: str = "_processed"
    night_mode: str = "AUTOMATIC"
    oled_mode: bool = False
    auto_handle_shared_files: bool = False
    shared_files_processing_mode: str = "REMOVE_METADATA"
    shared_files_output_action: str = "SHARE_TO_ANOTHER_APP"
    shared_files_custom_path: str | None = None
    thumbnail_handling: str = "REMOVE"
    allow_internet_for_map: bool = False
    use_nearby_scramble: bool = False
    language: str = "SYSTEM"
    seed: str = field(default="0", metadata={"ours": True})
    now_ms: int = field(default=1_700_000_000_000, metadata={"ours": True})
    now_year: int = field(default=2023, metadata={"ours": True})
    strict: bool = field(default=True, metadata={"ours": True})


#: Options whose stored value must be one of these; another counts as not stored.
CHOICES = {
    "folder_structure": FOLDERS, "thumbnail_handling": THUMBNAILS, "shared_files_processing_mode": MODES,
    "shared_files_output_action": OUTPUT_ACTIONS, "night_mode": NIGHT_MODES,
}
#: Options that fall back to the old common path before their default.
OLD_PATH_KEY = "default_saving_path"
OLD_PATH_USERS = ("unified_saving_path", "pictures_saving_path")


def choice_or(value: Column, choices: tuple[str, ...], default: str) -> Column:
    """``value`` if it is one of ``choices``, else ``default``."""
    return F.when(value.isin(*choices), value).otherwise(F.lit(default))


def choice_or_error(value: Column, choices: tuple[str, ...], name: str) -> Column:
    """``value`` if it is one of ``choices``, else an error."""
    return F.when(value.isin(*choices), value).otherwise(F.raise_error(F.concat(F.lit(f"no such {name}: "), F.coalesce(value, F.lit("null")))))


def read_settings(stored: DataFrame, profile: str = "profile") -> DataFrame:
    """(profile, option, value as text) for every option of every profile in ``stored`` (profile, key, value).

    Of repeated keys the largest value counts. A missing or null value, or one that isn't allowed, is the default;
    flags other than true and false are the default too. An option without a default stays null.
    """
    options = [f for f in fields(Settings) if not f.metadata.get("ours")]
    keys = [f.name for f in options] + [OLD_PATH_KEY]
    wide = stored.groupBy(profile).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"v_{k}") for k in keys])
    rows = []
    for f in options:
        value, default = F.col(f"v_{f.name}"), F.lit(str(f.default).lower() if isinstance(f.default, bool) else f.default).cast("string")
        if f.name in CHOICES:
            value = choice_or(value, CHOICES[f.name], f.default)
        elif isinstance(f.default, bool):
            value = choice_or(value, ("true", "false"), str(f.default).lower())
        elif f.name in OLD_PATH_USERS:
            value = F.coalesce(value, F.col(f"v_{OLD_PATH_KEY}"), default)
        rows.append(F.struct(F.lit(f.name).alias("option"), F.coalesce(value, default).alias("value")))
    return wide.select(profile, F.inline(F.array(*rows)))
