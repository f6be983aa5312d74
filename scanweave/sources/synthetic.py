"""Synthetic scans with known truth, made on the executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_filter
from ..operators.grid import nav_grid


def spectrum_image(spark: SparkSession, ny: int = 4, nx: int = 5, channels: int = 256) -> DataFrame:
    """(y, x, spectrum, true_area, true_centre): a constant 5 and a Gaussian of width 3 on an axis from 0 to 50, its area 20 to 60 and centre 20 to 30 over the scan."""
    pos = F.col("y") * nx + F.col("x")
    area, centre = 20 + 40 * pos / (ny * nx - 1), 20 + 10 * pos / (ny * nx - 1)
    step = 50.0 / (channels - 1)
    value = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: 5 + F.col("true_area") / (3 * np.sqrt(2 * np.pi)) * F.exp(-((i * step - F.col("true_centre")) ** 2) / 18))
    return nav_grid(spark, y=ny, x=nx).withColumn("true_area", area).withColumn("true_centre", centre).withColumn("spectrum", value)


def disks(spark: SparkSession, ny: int = 4, nx: int = 5, size: int = 16) -> DataFrame:
    """(y, x, frame): a disk of radius 3 in the middle, k + 1 bright at the k-th position in C order."""
    mid = (size - 1) // 2 + 1
    inside = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.when((F.floor(i / size) - mid) ** 2 + (i % size - mid) ** 2 <= 9, F.col("y") * nx + F.col("x") + 1).otherwise(0).cast("double"))
    return nav_grid(spark, y=ny, x=nx).withColumn("frame", inside)


def drifting_movie(spark: SparkSession, frames: int = 12, height: int = 96, width: int = 112, seed: int = 3) -> DataFrame:
    """(t, frame, true_dy, true_dx): a fixed scene seen through a moving window, shifted exactly in Fourier space."""
    margin = 16

    def make(batches):
        rng = np.random.default_rng(seed)
        scene = gaussian_filter(rng.normal(size=(height + 2 * margin, width + 2 * margin)), 2.0)
        spec = np.fft.fft2(scene)
        ky, kx = np.fft.fftfreq(scene.shape[0])[:, None], np.fft.fftfreq(scene.shape[1])[None, :]
        for rows in batches:
            out = []
            for t in rows["t"]:
                dy, dx = 0.7 * t - 0.02 * t * t, -0.4 * t
                moved = np.fft.ifft2(spec * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real
                out.append((int(t), moved[margin:-margin, margin:-margin].ravel(), dy, dx))
            yield pd.DataFrame(out, columns=["t", "frame", "true_dy", "true_dx"])

    return spark.range(frames).select(F.col("id").cast("int").alias("t")).mapInPandas(make, "t int, frame array<double>, true_dy double, true_dx double")


def strained_vectors(spark: SparkSession, ny: int = 4, nx: int = 5, strain: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(vectors, reference): eight lattice vectors at each position, those measured stretched in real space along x by strain times the position's x share."""
    ref = [(i, float(gx), float(gy)) for i, (gx, gy) in enumerate([(1, 0), (0, 1), (1, 1), (1, -1)])]
    reference = spark.createDataFrame(ref, "ref int, gx double, gy double")
    both = reference.union(reference.select("ref", -F.col("gx"), -F.col("gy")))
    v = nav_grid(spark, nav_y=ny, nav_x=nx).crossJoin(F.broadcast(both)).withColumn("true_exx", strain * F.col("nav_x") / (nx - 1))
    # real space stretched by 1 + e shrinks reciprocal space by as much
    v = v.select("nav_y", "nav_x", (F.col("gx") / (1 + F.col("true_exx"))).alias("kx"), F.col("gy").alias("ky"), F.lit(1.0).alias("intensity"), "true_exx", (F.xxhash64("nav_y", "nav_x", "gx", "gy")).alias("ord"))
    return v, reference


def particles_at(truth: DataFrame, drift: DataFrame) -> DataFrame:
    """(t, id, y, x): particles (id, birth, death, y, x in the laboratory) present at birth <= t < death, in the sample's frame."""
    return drift.join(truth, (F.col("t") >= F.col("birth")) & (F.col("t") < F.col("death"))).select("t", "id", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"))


def eels_image(spark: SparkSession, ny: int = 16, nx: int = 16, channels: int = 1024, edges: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """(y, x, spectrum, concentration): 200 to 800 eV, a power law of exponent 3 whose thickness grows with y, and core-loss edges (300, 450 and 600 eV unless given) of concentrations that vary along x; Poisson noise. concentration maps an edge to its truth."""
    onset = edges or {"A": 300.0, "B": 450.0, "C": 600.0}

    def make(batches):
        x = np.linspace(200, 800, channels)
        for rows in batches:
            out = []
            for y, xx in rows[["y", "x"]].itertuples(index=False):
                rng = np.random.default_rng((seed, int(y), int(xx)))
                u = xx / max(1, nx - 1)
                c = {n: float(v) for n, v in zip(onset, (u, 1 - u, 0.5), strict=False)}
                v = (1 + y / ny) * 2e10 * x**-3.0
                for n, e in onset.items():
                    v = v + np.where(x >= e, 400 * c.get(n, 0.0) * (x / e) ** -2.5, 0)
                out.append((int(y), int(xx), rng.poisson(v).astype(float), c))
            yield pd.DataFrame(out, columns=["y", "x", "spectrum", "concentration"])

    return nav_grid(spark, y=ny, x=nx).mapInPandas(make, "y int, x int, spectrum array<double>, concentration map<string,double>")


def eds_image(spark: SparkSession, ny: int = 16, nx: int = 16, channels: int = 2048, lines: dict[str, float] | None = None, seed: int = 2) -> DataFrame:
    """(y, x, spectrum, concentration): 0 to 20 keV, a falling background and X-ray lines (Fe, Ni and Cu K alpha and beta unless given) of width 0.06 keV; Poisson noise."""
    at = lines or {"Fe_Ka": 6.40, "Fe_Kb": 7.06, "Ni_Ka": 7.47, "Ni_Kb": 8.26, "Cu_Ka": 8.05, "Cu_Kb": 8.90}

    def make(batches):
        x = np.linspace(0, 20, channels)
        for rows in batches:
            out = []
            for y, xx in rows[["y", "x"]].itertuples(index=False):
                rng = np.random.default_rng((seed, int(y), int(xx)))
                u = xx / max(1, nx - 1)
                c = {"Fe": u, "Ni": 1 - u, "Cu": y / max(1, ny - 1)}
                v = 20 * np.exp(-x / 4)
                for n, e in at.items():
                    element, line = n.split("_")
                    v = v + 300 * c.get(element, 0.0) * (1.0 if line == "Ka" else 0.13) * np.exp(-((x - e) ** 2) / (2 * 0.06**2))
                out.append((int(y), int(xx), rng.poisson(v).astype(float), {k: float(w) for k, w in c.items()}))
            yield pd.DataFrame(out, columns=["y", "x", "spectrum", "concentration"])

    return nav_grid(spark, y=ny, x=nx).mapInPandas(make, "y int, x int, spectrum array<double>, concentration map<string,double>")


def atom_lattice(ny: int = 8, nx: int = 10, spacing: float = 16.0, dumbbell: float = 0.0, displacement: float = 0.0, ellipticity: float = 1.0, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(image, positions (y, x)): Gaussians of width 2.5 on a grid that isn't square; a partner at a distance along x, random displacements and elongation if asked for."""
    rng = np.random.default_rng(seed)
    base = np.array([((i + 1) * spacing, (j + 1) * spacing) for i in range(ny) for j in range(nx)])
    base = base + rng.normal(0, displacement, base.shape) if displacement else base
    points = np.concatenate([base, base + [0, dumbbell]]) if dumbbell else base
    yy, xx = np.mgrid[: int((ny + 1) * spacing), : int((nx + 1) * spacing)]
    image = np.zeros(yy.shape)
    for y, x in points:
        image += np.exp(-((yy - y) ** 2) / (2 * 2.5**2) - (xx - x) ** 2 / (2 * (2.5 * ellipticity) ** 2))
    return image, points


def tilt_members(spark: SparkSession, members: int = 7, ny: int = 32, nx: int = 36, most: int = 3, seed: int = 5) -> DataFrame:
    """(member, tilt, azimuth, frame, true_oy, true_ox): overview images of one area, member 0 untilted and the rest on a ring of 1 degree, displaced by planted whole pixels."""
    rng = np.random.default_rng(seed)
    scene = gaussian_filter(rng.normal(size=(ny + 2 * most, nx + 2 * most)), 1.5)
    rows = []
    for m in range(members):
        oy, ox = (0, 0) if m == 0 else (int(v) for v in rng.integers(-most, most + 1, 2))
        cut = scene[most - oy : most - oy + ny, most - ox : most - ox + nx]
        rows.append((m, 0.0 if m == 0 else 1.0, 0.0 if m == 0 else 360.0 * (m - 1) / (members - 1), cut.ravel().tolist(), oy, ox))
    return spark.createDataFrame(rows, "member int, tilt double, azimuth double, frame array<double>, true_oy int, true_ox int")
