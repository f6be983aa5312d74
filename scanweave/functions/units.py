"""Physical units and constants, mostly as driver arithmetic and plain columns."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values (CODATA 2018): speed of light, Planck's constant, electron mass and charge.
C, H, ME, E = 299792458.0, 6.62607015e-34, 9.1093837015e-31, 1.602176634e-19

#: How a reciprocal length can be written, spaces left out and in lower case; {} stands for the length.
_FORMS = ("1/{}", "{}^-1", "{}-1", "{}⁻¹", "{}^{{-1}}", "{}$^{{-1}}$", "${}^{{-1}}$", "k_{}^-1", "per{}", "{}¯¹")
#: The lengths, and the names of the two other detector units.
_LENGTHS = {"1/Å": ("å", "a", "ang", "angstrom", "\\aa"), "1/nm": ("nm", "nanometer", "nanometre")}
_OTHERS = {"px": ("px", "pixel", "pixels"), "mrad": ("mrad", "mrads", "milliradian", "milliradians")}
SPELLINGS = {f.format(x): unit for unit, names in _LENGTHS.items() for x in names for f in _FORMS} | {x: unit for unit, names in _OTHERS.items() for x in names}


def parse_unit(text: str | None) -> str | None:
    """px, mrad, 1/nm or 1/Å; None for a blank or unknown label, which claims nothing (px claims that an axis isn't calibrated)."""
    return SPELLINGS.get("".join((text or "").lower().split()))


def wavelength(kev: float) -> float:
    """Relativistic electron wavelength in Å."""
    if kev <= 0:
        raise ValueError("the energy must be positive")
    v = kev * 1e3
    return H / sqrt(2 * ME * E * v * (1 + E * v / (2 * ME * C * C))) * 1e10


def per_angstrom(unit: str | None, kev: float | None = None, px_scale: float | None = None) -> float:
    """How many 1/Å one of the unit is; milliradians need the energy, pixels a scale; an axis whose unit isn't specified counts as 1/Å."""
    unit = parse_unit(unit)
    if unit in ("1/Å", None):
        return 1.0
    if unit == "1/nm":
        return 0.1
    if unit == "mrad":
        if kev is None:
            raise ValueError("milliradians need the beam energy")
        return 1e-3 / wavelength(kev)
    if px_scale is None:
        raise ValueError("the detector isn't calibrated")
    return px_scale


def convert(value: Column, source: str, target: str, kev: float | None = None, px_scale: float | None = None) -> Column:
    return value * (per_angstrom(source, kev, px_scale) / per_angstrom(target, kev, px_scale))


def flat_detector(radius: Column, camera_length: float, kev: float) -> Column:
    """The scattering vector 2 / lambda * sin(atan(R / L) / 2) of a radius on a flat screen."""
    return F.sin(F.atan(radius / camera_length) / 2) * (2 / wavelength(kev))


def electric_field(mrad_per_px: float, thickness_nm: float, kev: float) -> float:
    """Field in MV/cm for a beam shift of one pixel: gamma * m * v^2 * angle / (e * thickness)."""
    if min(mrad_per_px, thickness_nm, kev) <= 0:
        raise ValueError("scale, thickness and energy must be positive")
    gamma = 1 + kev * 1e3 * E / (ME * C * C)
    v2 = C * C * (1 - 1 / gamma**2)
    return gamma * ME * v2 * mrad_per_px * 1e-3 / (E * thickness_nm * 1e-9) / 1e8


def strain_display(df, strains: tuple[str, ...] = ("exx", "eyy", "exy"), angle: str = "omega"):
    """Strains in percent, the rotation in degrees."""
    return df.withColumns({s: F.col(s) * 100 for s in strains} | {angle: F.degrees(angle)})


def positional_sigma(width: Column, photons: Column, background: Column, pixel: float = 1.0) -> Column:
    """Localisation error of a spot: width s, N photons, background b a pixel of size a."""
    s2 = width * width + pixel * pixel / 12
    return F.sqrt(s2 / photons + 8 * 3.141592653589793 * s2 * s2 * background * background / (pixel * pixel * photons * photons))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", "_"), F.lit("_"))


def identifier(text: Column) -> Column:
    """A Python name: other characters as underscores, an underscore before a digit or for nothing."""
    name = F.regexp_replace(text, "[^0-9a-zA-Z_]+", "_")
    return F.when(name.rlike("^[0-9]") | (name == ""), F.concat(F.lit("_"), name)).otherwise(name)


def line_name(text: Column) -> tuple[Column, Column]:
    """(element, line) of a name like Fe_Ka."""
    return F.regexp_extract(text, "^([A-Z][a-z]?)_([A-Za-z0-9]+)$", 1), F.regexp_extract(text, "^([A-Z][a-z]?)_([A-Za-z0-9]+)$", 2)
