"""Model components: numpy functions of (x, parameters), each parameter of shape (rows, 1), and Column forms."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from math import log, pi, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
_erf = np.frompyfunc(math.erf, 1, 1)


def _power_law(x, a, left_cutoff, origin, r):
    base = x - origin
    live = (x > left_cutoff) & (base > 0)
    return np.where(live, a * np.power(np.where(live, base, 1.0), -r), 0.0)


#: kind -> (parameter names, function). A Gaussian's A is its area, GaussianHF has height and full width at half maximum.
KINDS = {
    "Gaussian": (("A", "centre", "sigma"), lambda x, a, c, s: a / ((s + TINY) * sqrt(2 * pi)) * np.exp(-((x - c) ** 2) / (2 * (s + TINY) ** 2))),
    "GaussianHF": (("centre", "fwhm", "height"), lambda x, c, w, h: h * np.exp(-4 * log(2) * (x - c) ** 2 / (w + TINY) ** 2)),
    "Lorentzian": (("A", "centre", "gamma"), lambda x, a, c, g: a / pi * g / ((x - c) ** 2 + g**2 + TINY)),
    "PowerLaw": (("A", "left_cutoff", "origin", "r"), _power_law),
    "Offset": (("offset",), lambda x, o: o + 0 * x),
    "Exponential": (("A", "tau"), lambda x, a, t: a * np.exp(-x / (t + TINY))),
    "Arctan": (("A", "k", "x0"), lambda x, a, k, x0: a * np.arctan(k * (x - x0))),
    "Erf": (("A", "origin", "sigma"), lambda x, a, o, s: a * _erf((x - o) / sqrt(2) / (s + TINY)).astype(float) / 2),
    "HeavisideStep": (("A", "n"), lambda x, a, n: a * np.where(x > n, 1.0, np.where(x < n, 0.0, 0.5))),
    "Logistic": (("a", "b", "c", "origin"), lambda x, a, b, c, o: a / (1 + b * np.exp(-c * (x - o)))),
}


def _erf_slope(x, o, s):
    u = (x - o) / sqrt(2) / (s + TINY)
    return np.exp(-u * u) / sqrt(pi), u


def _power_law_gradient(x, a, left_cutoff, origin, r):
    base = x - origin
    live = (x > left_cutoff) & (base > 0)
    b = np.where(live, base, 1.0)
    p = np.where(live, np.power(b, -r), 0.0)
    return p, 0 * p, a * r * p / b, -a * p * np.log(b)


def _gaussian_gradient(x, a, c, s):
    s = s + TINY
    g = np.exp(-((x - c) ** 2) / (2 * s * s)) / (s * sqrt(2 * pi))
    return g, a * g * (x - c) / s**2, a * g * ((x - c) ** 2 / s**3 - 1 / s)


def _gaussian_hf_gradient(x, c, w, h):
    w, k = w + TINY, 4 * log(2)
    g = np.exp(-k * (x - c) ** 2 / w**2)
    return 2 * k * h * g * (x - c) / w**2, 2 * k * h * g * (x - c) ** 2 / w**3, g


def _lorentzian_gradient(x, a, c, g):
    d = (x - c) ** 2 + g**2 + TINY
    return g / (pi * d), 2 * a * g * (x - c) / (pi * d * d), a / pi * (1 / d - 2 * g * g / (d * d))


def _exponential_gradient(x, a, t):
    e = np.exp(-x / (t + TINY))
    return e, a * e * x / (t + TINY) ** 2


def _arctan_gradient(x, a, k, x0):
    d = 1 + (k * (x - x0)) ** 2
    return np.arctan(k * (x - x0)), a * (x - x0) / d, -a * k / d


def _erf_gradient(x, a, o, s):
    e, u = _erf_slope(x, o, s)
    return _erf(u).astype(float) / 2, -a * e / sqrt(2) / (s + TINY), -a * e * u / (s + TINY)


def _logistic_gradient(x, a, b, c, o):
    e = np.exp(-c * (x - o))
    d = 1 + b * e
    return 1 / d, -a * e / d**2, a * b * e * (x - o) / d**2, -a * b * c * e / d**2


def _step_gradient(x, a, n):
    # flat but for the jump itself, whose slope counts as 0
    return np.where(x > n, 1.0, np.where(x < n, 0.0, 0.5)), 0 * (x + n)


#: kind -> the curve's derivatives by each parameter, in their order.
GRADIENTS = {
    "Gaussian": _gaussian_gradient, "GaussianHF": _gaussian_hf_gradient, "Lorentzian": _lorentzian_gradient, "PowerLaw": _power_law_gradient, "Offset": lambda x, o: (1 + 0 * x,), "Exponential": _exponential_gradient, "Arctan": _arctan_gradient,
    "Erf": _erf_gradient, "HeavisideStep": _step_gradient, "Logistic": _logistic_gradient,
}


def polynomial(order: int):
    return tuple(f"a{k}" for k in range(order + 1)), lambda x, *a: sum(c * x**k for k, c in enumerate(a))


def tabulated(table: np.ndarray, x0: float, dx: float):
    """(intensity, onset_shift): a curve on a uniform grid, linear between its points and constant beyond."""
    grid = x0 + dx * np.arange(len(table))
    return ("intensity", "onset_shift"), lambda x, i, s: i * np.interp(x - s, grid, table)


def edge(tables: list[list[float]], x0: float, dx: float):
    """An edge's curve and its derivatives: the first table is its cross-section, the others a basis of its fine structure, whose coefficients follow intensity and onset_shift. The derivative by the shift is a difference over a channel, so that it has no jumps."""
    grid = x0 + dx * np.arange(len(tables[0]))
    at = lambda x, s, t: np.interp(x - s, grid, np.asarray(t, float))
    shape = lambda x, s, c: at(x, s, tables[0]) + sum((k * at(x, s, t) for k, t in zip(c, tables[1:], strict=True)), np.zeros(1))

    def gradient(x, i, s, *c):
        slope = (shape(x, s + dx / 2, c) - shape(x, s - dx / 2, c)) / dx
        return shape(x, s, c), i * slope, *[i * at(x, s, t) for t in tables[1:]]

    return lambda x, i, s, *c: i * shape(x, s, c), gradient


def column(kind: str, x: Column, p: list[Column]) -> Column:
    """A component as an expression, for models that need no Python."""
    tau = 2 * pi
    made = {
        "Gaussian": lambda a, c, s: a / (s * sqrt(tau)) * F.exp(-((x - c) ** 2) / (2 * s * s)),
        "Lorentzian": lambda a, c, g: a / pi * g / ((x - c) ** 2 + g * g),
        "PowerLaw": lambda a, cut, o, r: F.when((x > cut) & (x - o > 0), a * F.pow(x - o, -r)).otherwise(0.0),
        "Offset": lambda o: o,
        "Exponential": lambda a, t: a * F.exp(-x / t),
        "Arctan": lambda a, k, x0: a * F.atan(k * (x - x0)),
        "HeavisideStep": lambda a, n: a * F.when(x > n, 1.0).when(x < n, 0.0).otherwise(0.5),
        "Logistic": lambda a, b, c, o: a / (1 + b * F.exp(-c * (x - o))),
    }
    if kind not in made:
        raise ValueError(f"{kind} has no expression")
    return made[kind](*p)


@dataclass
class Parameter:
    name: str
    value: float
    free: bool = True
    low: float = -np.inf
    high: float = np.inf


@dataclass
class Component:
    kind: str
    parameters: list[Parameter]
    name: str = ""
    active: bool = True
    #: Of an Edge: its tables, and the offset and scale of their axis.
    tables: list | None = None
    axis: tuple[float, float] = (0.0, 1.0)

    @classmethod
    def of(cls, kind: str, name: str = "", fixed: tuple[str, ...] = (), bounds: dict | None = None, order: int = 1, **values: float) -> Component:
        names = polynomial(order)[0] if kind == "Polynomial" else KINDS[kind][0]
        if set(values) - set(names):
            raise ValueError(f"{kind} has no parameter {sorted(set(values) - set(names))[0]}")
        return cls(kind, [Parameter(n, float(values.get(n, 0.0)), n not in fixed, *(bounds or {}).get(n, (-np.inf, np.inf))) for n in names], name or kind)

    def curve(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(rows, channels) for packed parameters (rows, n)."""
        if self.kind == "Edge":
            f = edge(self.tables, *self.axis)[0]
        else:
            f = polynomial(len(self.parameters) - 1)[1] if self.kind == "Polynomial" else KINDS[self.kind][1]
        return np.broadcast_to(f(x[None, :], *(p[:, [k]] for k in range(p.shape[1]))), (len(p), len(x)))

    def gradient(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(rows, parameters, channels): the curve's derivatives by each parameter."""
        if self.kind == "Edge":
            parts = edge(self.tables, *self.axis)[1](x[None, :], *(p[:, [k]] for k in range(p.shape[1])))
        elif self.kind == "Polynomial":
            parts = [x[None, :] ** k for k in range(p.shape[1])]
        else:
            parts = GRADIENTS[self.kind](x[None, :], *(p[:, [k]] for k in range(p.shape[1])))
        return np.stack([np.broadcast_to(g, (len(p), len(x))) for g in parts], axis=1)

    @classmethod
    def edge(cls, name: str, tables: list[list[float]], axis: tuple[float, float], fit_onset: bool = True, fit_fine: bool = True, intensity: float = 1.0) -> Component:
        """An edge prepared for the batched fit: its curves on the spectra's axis, its onset and fine structure free or held."""
        fine = [Parameter(f"fine_{k}", 0.0, fit_fine) for k in range(len(tables) - 1)]
        return cls("Edge", [Parameter("intensity", intensity), Parameter("onset_shift", 0.0, fit_onset), *fine], name, True, [list(map(float, t)) for t in tables], axis)

    def scaled_to(self, x: np.ndarray, y: np.ndarray, fraction: float = 0.5) -> Component:
        """The component with its amplitude (A, height, intensity, offset or a) such that its peak reaches a fraction of the data's greatest value."""
        linear = next((p for p in self.parameters if p.name in ("A", "height", "intensity", "offset", "a")), None)
        if linear is not None:
            before, linear.value = linear.value, 1.0
            peak = float(np.abs(np.nan_to_num(self.curve(np.asarray(x, float), np.array([[p.value for p in self.parameters]])))).max())
            linear.value = float(np.nanmax(y)) * fraction / peak if peak > 0 else before
        return self

    def clamped_to(self, low: float, high: float) -> Component:
        """The component with its place (centre, origin, x0 or n) inside the axis and bound to it."""
        for p in self.parameters:
            if p.name in ("centre", "origin", "x0", "n") and self.kind not in ("PowerLaw", "Logistic"):
                p.low, p.high = max(p.low, low), min(p.high, high)
                p.value = float(min(max(p.value, p.low), p.high))
        return self


@dataclass
class Model:
    """A sum of active components; parameters are packed component after component."""

    components: list[Component]
    channel_ranges: list[tuple[int, int]] = field(default_factory=list)

    def active(self) -> list[Component]:
        return [c for c in self.components if c.active]

    def parameters(self) -> list[Parameter]:
        return [p for c in self.active() for p in c.parameters]

    def slices(self) -> list[slice]:
        out, at = [], 0
        for c in self.active():
            out.append(slice(at, at + len(c.parameters)))
            at += len(c.parameters)
        return out

    def values(self) -> np.ndarray:
        return np.array([p.value for p in self.parameters()])

    def free(self) -> np.ndarray:
        return np.array([p.free for p in self.parameters()])

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([p.low for p in self.parameters()]), np.array([p.high for p in self.parameters()])

    def curve(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return sum(c.curve(x, p[:, s]) for c, s in zip(self.active(), self.slices(), strict=True))

    def jacobian(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(rows, parameters, channels): a sum's derivatives are its components', each in its own rows."""
        return np.concatenate([c.gradient(x, p[:, s]) for c, s in zip(self.active(), self.slices(), strict=True)], axis=1)

    def spread(self, low: float, high: float) -> Model:
        """The model with components of one kind that stand at one place spread evenly over the axis."""
        groups: dict[tuple, list[Parameter]] = {}
        for c in self.active():
            for p in c.parameters:
                if p.name == "centre":
                    groups.setdefault((c.kind, p.value), []).append(p)
        for same in groups.values():
            for k, p in enumerate(same if len(same) > 1 else ()):
                p.value = low + (k + 1) * (high - low) / (len(same) + 1)
        return self

    def to_dict(self) -> dict:
        return {"components": [{"kind": c.kind, "name": c.name, "active": c.active, "parameters": [vars(p) for p in c.parameters], "tables": c.tables, "axis": list(c.axis)} for c in self.components], "channel_ranges": [list(r) for r in self.channel_ranges]}

    @classmethod
    def from_dict(cls, d: dict) -> Model:
        return cls([Component(c["kind"], [Parameter(**p) for p in c["parameters"]], c["name"], c["active"], c.get("tables"), tuple(c.get("axis", (0.0, 1.0)))) for c in d["components"]], [tuple(r) for r in d["channel_ranges"]])
