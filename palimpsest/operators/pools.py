"""Values that replacements are drawn from. Fake values only have to look plausible; every list is a parameter of Pools."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import product

#: One maker for each lens mount that is still built, and for each large phone platform, spelled as their files spell it, with the
#: name and first number of a series of models.
MAKERS: dict[str, tuple[str, int]] = {
    "RICOH IMAGING COMPANY, LTD.": ("PENTAX K-", 3),
    "NIKON CORPORATION": ("NIKON Z ", 5),
    "SIGMA": ("SIGMA fp ", 1),
    "FUJIFILM": ("GFX", 50),
    "Hasselblad": ("X", 1),
    "OM Digital Solutions": ("OM-", 1),
    "Canon": ("Canon EOS R", 5),
    "LEICA CAMERA AG": ("LEICA SL", 1),
    "samsung": ("Galaxy S", 21),
    "Apple": ("iPhone ", 12),
}
#: Models of a maker and releases of a model's software: consecutive numbers.
MODELS, RELEASES = 4, 3


def _said(*parts: tuple[str, ...]) -> tuple[str, ...]:
    """All combinations, as phrases."""
    return tuple(" ".join(p) for p in product(*parts))


def _stop(x: float) -> str:
    """A number cut to two digits, as lens and shutter scales are engraved."""
    return f"{math.floor(x * 10 + 1e-9) / 10:.1f}" if x < 10 else str(math.floor(x))


_HOURS = ("at dawn", "before noon", "at dusk")
_PLACES = ("Riverside path", "Hill road", "Village green", "Canal lock", "Forest edge", "Old quay", "Market hall")
_THINGS = ("Bicycle", "Doorway", "Clouds", "Lamp post", "Boats", "Shadows", "Staircase")
_NOTES = ("Handheld", "Tripod", "Test shot", "From the archive")
_LENSES = ("wide end", "long end", "normal")


@dataclass(frozen=True)
class Pools:
    """One list per kind of value."""

    models: dict[str, tuple[str, ...]] = field(default_factory=lambda: {m: tuple(f"{name}{first + i}" for i in range(MODELS)) for m, (name, first) in MAKERS.items()})
    software: dict[str, tuple[str, ...]] = field(default_factory=lambda: {m: tuple(f"{name.strip(' -')} Ver.{i}.00" for i in range(1, RELEASES + 1)) for m, (name, _) in MAKERS.items()})
    #: For makers that aren't in the lists.
    other_models: tuple[str, ...] = tuple(f"Camera {i}" for i in range(1, MODELS + 1))
    other_software: tuple[str, ...] = tuple(f"Ver.{i}.00" for i in range(1, RELEASES + 1))
    subjects: tuple[str, ...] = _THINGS
    places: tuple[str, ...] = _PLACES
    hours: tuple[str, ...] = _HOURS
    remarks: tuple[str, ...] = _said(_NOTES, _LENSES)
    #: Full stops: speeds and exposure times double, diaphragm numbers grow by the root of two, focal lengths too.
    iso: tuple[str, ...] = tuple(str(100 << i) for i in range(8))
    exposure: tuple[str, ...] = tuple(f"1/{1 << i}" for i in range(1, 13))
    aperture: tuple[str, ...] = tuple(_stop(2 ** (i / 2)) for i in range(1, 9))
    focal: tuple[str, ...] = tuple(f"{16 * 2 ** (i / 2):.0f}" for i in range(8))
    #: The standard's codes: white balance automatic or manual; flash fired or not (bit 0) under each flash mode (bits 3 and 4).
    balance: tuple[str, ...] = tuple(map(str, range(2)))
    flash: tuple[str, ...] = tuple(str(mode << 3 | fired) for mode in range(4) for fired in range(2))
    audio_titles: tuple[str, ...] = _said(("Track", "Recording"), tuple(map(str, range(1, 8))))
    audio_artists: tuple[str, ...] = _said(("Quartet", "Trio", "Choir", "Band"), ("North", "South"))
    audio_albums: tuple[str, ...] = _said(("Live", "Studio"), ("I", "II", "III"))
    audio_genres: tuple[str, ...] = ("Choral", "Chamber", "Percussion", "Field recording", "Spoken word")
    video_titles: tuple[str, ...] = _said(("Episode", "Part", "Chapter"), tuple(map(str, range(1, 6))))
    video_directors: tuple[str, ...] = _said(("Studio", "Workshop"), ("Red", "Green", "Blue", "White"))
    video_genres: tuple[str, ...] = ("Tutorial", "Time-lapse", "Walkthrough", "Short film")
    authors: tuple[str, ...] = tuple(f"Editor {i}" for i in range(1, 9))
    pdf_titles: tuple[str, ...] = _said(("Leaflet", "Handout", "Form"), tuple(map(str, range(1, 5))))
    pdf_tools: tuple[str, ...] = _said(("Page composer", "Print service"), ("1.0", "1.1", "2.0"))
    subject: str = "Printed matter"
    keywords: tuple[str, ...] = ("print", "leaflet", "edition", "layout", "sheet")

    @property
    def makes(self) -> tuple[str, ...]:
        return tuple(self.models)


POOLS = Pools()
