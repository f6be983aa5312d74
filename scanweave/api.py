"""The scripting API: eight functions, each returning a Result with its provenance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .axes import Axis
from .functions.roi import Disk, PixelRing, corner_blocks
from .operators import fields, frames, matching, strain, virtual

VERSION = "1"


@dataclass(frozen=True)
class Result:
    df: DataFrame
    action: str
    params: dict = field(default_factory=dict)

    @property
    def provenance(self) -> dict:
        return {"action": self.action, "params": self.params, "version": VERSION}


class MissingDependency(NotImplementedError):
    """What an operator needs isn't part of this library; name says what."""

    def __init__(self, operator: str, name: str):
        super().__init__(f"{operator} needs {name}, which this library doesn't have")


def find_vectors(scan: DataFrame, shape: tuple[int, int], radius: float, method: str = "nxcorr", threshold: float | None = None, min_distance: float | None = None, ky: Axis | None = None, kx: Axis | None = None, beam_stop=None) -> Result:
    """Vectors of a scan of frames; the threshold is 0.5 for nxcorr and 10 for dog unless given. The neural method needs trained weights."""
    if method == "neural":
        raise MissingDependency("the neural detector", "its trained weights")
    df = frames.find_vectors(scan, shape, radius, method, threshold, min_distance, ky, kx, beam_stop)
    used = frames.DEFAULT_THRESHOLD[method] if threshold is None else threshold
    return Result(df, "find_vectors", {"method": method, "radius": radius, "threshold": used, "min_distance": min_distance})


def orientation_map(scan: DataFrame, *_, **__) -> Result:
    raise MissingDependency("template orientation mapping", "a diffraction simulation library")


def vector_orientation_map(vectors: DataFrame, *_, **__) -> Result:
    raise MissingDependency("vector orientation mapping", "a crystallography library for its plans")


def strain_map(vectors: DataFrame, reference: DataFrame, sizes: dict[str, int], tolerance: float, robust: bool = False, rotation: float = 0.0, flip: bool = False, alignment: str = "raw") -> Result:
    """Strain against reference vectors (ref, gx, gy), their zero beam left out."""
    ref = matching.zero_beam_filtered(reference)
    df = strain.robust_strain_map(vectors, ref, tolerance, sizes, alignment=alignment) if robust else strain.strain_map(vectors, ref, tolerance, sizes, ref.count(), alignment=alignment)
    return Result(strain.rotate_tensor(df, rotation, flip), "strain_map", {"tolerance": tolerance, "robust": robust, "rotation": rotation, "flip": flip, "alignment": alignment})


def center_zero_beam(vectors: DataFrame, sizes: dict[str, int], half_width: float, plane: str = "none", corner_fraction: float = 0.1) -> Result:
    """Vectors less their position's zero beam: the brightest vector within half_width of the origin; plane "whole_scan" or "corners" puts a plane through them."""
    from .functions.roi import Box
    from .operators.ragged import brightest

    keys = list(sizes)
    beam = brightest(vectors.where(Box(0.0, 0.0, half_width).predicate(F.col("kx"), F.col("ky"))), keys).select(*keys, F.col("kx").alias("sx"), F.col("ky").alias("sy"))
    if plane not in ("none", "whole_scan", "corners"):
        raise ValueError("plane is none, whole_scan or corners")
    if plane != "none":
        y, x = keys[-2:]
        where = corner_blocks(sizes[y], sizes[x], corner_fraction)(F.col(y), F.col(x)) if plane == "corners" else None
        from .operators.grid import nav_grid

        out = nav_grid(vectors.sparkSession, **sizes)
        for name in ("sx", "sy"):
            p = fields.plane_fit(beam, name, where, y, x)
            out = out.crossJoin(F.broadcast(p)).withColumn(name, F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("c")).drop("a", "b", "c")
        beam = out
    return Result(matching.shift_vectors(vectors, beam, tuple(keys)), "center_zero_beam", {"half_width": half_width, "plane": plane})


def dpc_map(scan: DataFrame, shape: tuple[int, int], rotation: float | None = None, flip: bool = False, mode: str = "electric", mrad_per_px: float | None = None, thickness_nm: float | None = None, energy_kev: float | None = None) -> Result:
    """Beam shifts by centre of mass, centred, turned (by the best angle where none is given) and calibrated where all constants are."""
    h, w = shape
    com = virtual.centre_of_mass(scan, w, h, (w - 1) / 2, (h - 1) / 2).withColumnsRenamed({"sx": "fx", "sy": "fy"})
    if rotation is None:
        best = fields.rotation_estimate(fields.minus_plane(com.select("y", "x", "fx", "fy")), mode).first()
        rotation, flip = (best["angle"] or 0.0, bool(best["flip"])) if best else (0.0, False)
    return Result(fields.dpc_map(com, rotation, flip, None, mrad_per_px, thickness_nm, energy_kev), "dpc_map", {"rotation": rotation, "flip": flip, "mode": mode})


def virtual_image(scan: DataFrame, shape: tuple[int, int], cx: float, cy: float, r: float, r_inner: float = 0.0, mean: bool = False) -> Result:
    """The frames' masked pixels summed (or averaged); a mask without pixels is an error."""
    return Result(virtual.frame_image(scan, PixelRing(cx, cy, r, r_inner), shape[1], shape[0], mean), "virtual_image", {"cx": cx, "cy": cy, "r": r, "r_inner": r_inner, "mean": mean})


def vector_virtual_image(vectors: DataFrame, sizes: dict[str, int], cx: float, cy: float, r: float, r_inner: float = 0.0, time: int | None = None, weighted: bool = True) -> Result:
    return Result(virtual.virtual_image(vectors, Disk(cx, cy, r, r_inner), sizes, weighted, time), "vector_virtual_image", {"cx": cx, "cy": cy, "r": r, "r_inner": r_inner, "time": time, "weighted": weighted})
