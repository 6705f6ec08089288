"""Constants of page layout analysis. All are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

#: Order of region types when a page is compiled; any other type comes last.
COMPILE_RANK = {"header": 0, "body": 1, "unknown": 2, "engraving": 3, "footnote": 4, "pagenum": 5}
OTHER_RANK = 99
#: Types that a project export holds, in this order.
EXPORT_RANK = {"header": 0, "body": 1, "footnote": 2}
#: Types a person may give a region.
EDITABLE_TYPES = ("body", "header", "pagenum", "footnote")
#: File name endings of page images and their media types; the first is the default.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff"}
#: Languages whose page numbers are read as digits only.
LATIN_MODELS = ("eng", "fra", "deu", "spa", "ita", "por", "lat")


@dataclass(frozen=True)
class Split:
    """Spread splitting."""

    single_below: float = 1.1
    smoothing: int = 20
    band: tuple[float, float] = (0.35, 0.65)
    contrast: float = 0.08
    clamp: tuple[float, float] = (0.15, 0.85)


@dataclass(frozen=True)
class Layout:
    """Region detection; lengths are shares of the page."""

    min_area: float = 0.0005
    max_area: float = 0.85
    min_height: float = 0.010
    edge: float = 0.12
    edge_width: float = 0.13
    seam_height: float = 0.60
    seam_aspect: float = 0.25
    gutter: tuple[float, float] = (0.42, 0.58)
    gutter_width: float = 0.12
    sharp_floor: float = 30.0
    sharp_share: float = 0.15
    sharp_from: int = 3
    overlap: float = 0.3
    merged_confidence: float = 0.9
    noise: float = 0.20
    gap_body: float = 0.10
    gap_paragraph: float = 0.025
    gap_other: float = 0.06
    column_overlap: float = 0.5
    blend_overlap: float = 0.4


@dataclass(frozen=True)
class Template:
    """Statistics of a volume's layout."""

    needed: int = 3
    counted: int = 50
    variance_of_one: float = 0.1
    base: float = 0.95
    slope: float = 4.5
    least: float = 0.3


SPLIT, LAYOUT, TEMPLATE = Split(), Layout(), Template()
