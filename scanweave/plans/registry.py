"""Actions by name: their function, parameters with types and limits, and what data they apply to; and guarded expressions."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import atoms, fields, frames, neighbourhood, orientation, ragged, shape, spectra, strain, virtual


@dataclass(frozen=True)
class Action:
    name: str
    run: Callable
    kinds: tuple[str, ...]
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def parameters(self) -> dict[str, inspect.Parameter]:
        return dict(list(inspect.signature(self.run).parameters.items())[1:])

    def __call__(self, df: DataFrame, **params):
        known = self.parameters()
        if extra := set(params) - set(known):
            raise TypeError(f"{self.name} has no parameter {sorted(extra)[0]}")
        if missing := [n for n, p in known.items() if p.default is p.empty and n not in params]:
            raise TypeError(f"{self.name} needs {missing[0]}")
        for n, (low, high) in self.limits.items():
            if n in params and not low <= params[n] <= high:
                raise ValueError(f"{n} of {self.name} lies between {low} and {high}")
        return self.run(df, **params)


_FRAMES, _VECTORS, _FIELD, _SPECTRA, _ATOMS, _LONG = ("frames",), ("vectors",), ("field",), ("spectra",), ("atoms",), ("long",)
ACTIONS = {
    a.name: a
    for a in (
        Action("rebin", shape.rebin, _LONG), Action("crop", shape.crop, _LONG), Action("downsample", shape.downsample, _LONG, {"k": (1, 4096)}),
        Action("virtual_imaging", virtual.frame_image, _FRAMES), Action("navigator", virtual.navigator, _FRAMES), Action("vector_virtual_imaging", virtual.virtual_image, _VECTORS),
        Action("find_vectors", frames.find_vectors, _FRAMES, {"radius": (0.5, 1000)}), Action("line_profile", frames.line_profiles, _FRAMES, {"width": (1, 1000)}), Action("drift_correction", frames.drift, _FRAMES, {"upsample": (1, 100)}),
        Action("static_background", frames.static_background, _FRAMES), Action("dynamic_background", frames.dynamic_background, _FRAMES, {"sigma": (0.1, 1000)}), Action("fft", frames.map_frames, _FRAMES),
        Action("center_of_mass", virtual.centre_of_mass, _FRAMES), Action("dpc", fields.dpc_map, _FIELD), Action("rotation", fields.rotation_estimate, _FIELD, {"step": (0.01, 90)}),
        Action("strain", strain.strain_map, _VECTORS, {"tolerance": (0, 1e6)}), Action("robust_strain", strain.robust_strain_map, _VECTORS), Action("clusters", frames.clusters, _VECTORS),
        Action("fit", spectra.fit, _SPECTRA), Action("seeded_fit", spectra.seeded_fit, _SPECTRA, {"stride": (1, 1024)}), Action("remove_background", spectra.remove_background, _SPECTRA), Action("quantify", spectra.quantify, ("maps",)),
        Action("dictionary_indexing", orientation.dictionary_index, ("patterns",), {"k": (1, 10_000)}), Action("merge_phases", orientation.merge_phases, ("scores",)),
        Action("blur", neighbourhood.blur, ("map",), {"sigma": (0, 1000)}), Action("median_filter", neighbourhood.median_filter, ("map",)), Action("reduce", ragged.reduce_map, _VECTORS), Action("count_map", ragged.count_map, _VECTORS),
        Action("atom_shapes", atoms.shape_properties, _ATOMS), Action("dumbbells", atoms.dumbbell_pairs, _ATOMS),
    )
}


def run(name: str, df: DataFrame, **params):
    if name not in ACTIONS:
        raise KeyError(f"no action is called {name}")
    return ACTIONS[name](df, **params)


def applicable(kind: str) -> list[str]:
    return sorted(n for n, a in ACTIONS.items() if kind in a.kinds)


#: What a guarded expression may call.
ALLOWED = frozenset("abs sqrt exp ln log10 pow sin cos tan atan atan2 hypot floor ceil round rint bround least greatest coalesce if nullif size element_at slice array_max array_min transform aggregate filter zip_with cast double int".split())


def evaluate(df: DataFrame, **expressions: str) -> DataFrame:
    """df with columns from expressions in which only allowed functions are called; subqueries and other statements are errors."""
    for text in expressions.values():
        for name in re.findall(r"([A-Za-z_][A-Za-z_0-9]*)\s*\(", text):
            if name.lower() not in ALLOWED | {"and", "or", "not", "in", "then", "else", "when"}:
                raise ValueError(f"{name} can't be called here")
        if re.search(r";|\bselect\b|--|/\*", text, re.IGNORECASE):
            raise ValueError("only expressions are allowed")
    return df.withColumns({n: F.expr(t) for n, t in expressions.items()})


def preview(df: DataFrame, at: dict[str, int], **expressions: str) -> DataFrame:
    """The expressions at one position only."""
    for k, v in at.items():
        df = df.where(F.col(k) == v)
    return evaluate(df.limit(1), **expressions)
