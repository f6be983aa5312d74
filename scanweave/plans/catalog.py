"""All queries of the scan operators, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("core_queries", "field_queries", "model_queries", "kernel_queries", "extra_queries", "source_queries", "planted_queries", "image_queries")
#: Queries over made-up input alone: they are tests of their operators, and aren't registered.
WITHOUT_TABLES = frozenset(
    "coarse_seeds zero_beam_filter model_curve edges_in_range d_spacings spot_reflections playback_clock movie_frame_list member_offsets member_votes snapped_reference phase_of_rings band_pattern "
    "band_zone_axes orientation_grid exchangeable_components composition_elements axis_metadata cif_cell chunk_edges movie_stacks synthetic_disks synthetic_spectra calibration_positions actions_for_frames "
    "detector_rays composed_origin planted_fit planted_seeded_fit planted_polish planted_atoms_by_mass planted_atoms_by_fit planted_drift planted_offsets planted_votes planted_disks_nxcorr planted_disks_dog "
    "judged_against_truth stored_axes_json".split()
)


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        found = getattr(import_module(f"{__package__}.{name}"), what)
        if clash := out.keys() & found.keys():
            raise ValueError(f"two queries are called {sorted(clash)[0]}")
        out |= found
    return out


def _registered(found: dict) -> dict:
    return {name: f for name, f in found.items() if name not in WITHOUT_TABLES}


def queries() -> dict:
    return _registered(_all("QUERIES"))


def oracle_sql() -> dict[str, str]:
    return _registered(_all("SQL"))


def unregistered() -> tuple[dict, dict[str, str]]:
    """The queries over made-up input, and their SQL."""
    return tuple({name: f for name, f in _all(what).items() if name in WITHOUT_TABLES} for what in ("QUERIES", "SQL"))
