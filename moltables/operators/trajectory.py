"""Per-frame geometry: torsions, RMSD, fluctuations, covariance, gyration, water dipoles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltables.operators.features import products
from moltables.functions.geometry import dihedral, point
from moltables.operators.structure import XYZ, centre_of_mass

BACKBONE = ("N", "CA", "C", "O")


def residue_backbone(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per residue with the points N, CA and C (null when missing)."""
    at = lambda n: F.max(F.when(F.col("name") == n, point(*XYZ))).alias(n)
    return atoms.filter(F.col("name").isin("N", "CA", "C")).groupBy(*keys, "chain", "resseq").agg(at("N"), at("CA"), at("C"))


def torsions(atoms: DataFrame, keys: Sequence[str], fill_zero: bool = False) -> DataFrame:
    """phi and psi of every residue of every frame; null (or 0) without both neighbours' atoms.

    Neighbours are the residues numbered one less and one more; they are the
    rows before and after in one window over a chain of a frame, if the numbers fit.
    """
    on = [*keys, "chain", "resseq"]
    w = Window.partitionBy(*keys, "chain").orderBy("resseq")
    beside = lambda move, step, c: F.when(move("resseq").over(w) == F.col("resseq") + step, move(c).over(w))
    d = residue_backbone(atoms, keys).withColumns({"_pc": beside(F.lag, -1, "C"), "_nn": beside(F.lead, 1, "N")})
    both = F.col("_pc").isNotNull() & F.col("_nn").isNotNull() & F.col("N").isNotNull() & F.col("CA").isNotNull() & F.col("C").isNotNull()
    other = F.lit(0.0) if fill_zero else F.lit(None).cast("double")
    phi = F.when(both, dihedral(F.col("_pc"), F.col("N"), F.col("CA"), F.col("C"))).otherwise(other)
    psi = F.when(both, dihedral(F.col("N"), F.col("CA"), F.col("C"), F.col("_nn"))).otherwise(other)
    return d.select(*on, phi.alias("phi_deg"), psi.alias("psi_deg"))


def backbone_rmsd(atoms: DataFrame, keys: Sequence[str], frame: str, ident: Sequence[str], reference_frame: int = 0,
                  names: Sequence[str] | None = BACKBONE) -> DataFrame:
    """RMSD of each frame to one frame, centred but not rotated; 0 where atom counts differ.

    With matched atoms the centred RMSD is the root of the summed variances of
    the coordinate differences, so one aggregation is enough.
    """
    sel = atoms if names is None else atoms.filter(F.col("name").isin(*names))
    on = [*keys, *ident]
    ref = sel.filter(F.col(frame) == reference_frame).select(*on, *[F.col(c).alias(f"r{c}") for c in XYZ])
    n_ref = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    d = sel.join(ref, on, "left")
    parts = sum([F.coalesce(F.var_pop(F.col(c) - F.col(f"r{c}")), F.lit(0.0)) for c in XYZ], F.lit(0.0))
    g = d.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("_n"), F.count("rx").alias("_m"), F.sqrt(parts).alias("_rmsd"))
    g = g.join(n_ref, list(keys)) if keys else g.join(F.broadcast(n_ref))
    same = (F.col("_n") == F.col("_nr")) & (F.col("_m") == F.col("_nr"))
    return g.select(*keys, frame, F.when(same, F.col("_rmsd")).otherwise(0.0).alias("rmsd_angstrom"))


def fluctuation(atoms: DataFrame, keys: Sequence[str], label: str | None = "resname") -> DataFrame:
    """Root mean square fluctuation of each residue's point over frames; 0 with one frame."""
    rms = F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z"))
    aggs = [F.when(F.count(F.lit(1)) > 1, rms).otherwise(0.0).alias("rmsf_angstrom")]
    if label:
        aggs.insert(0, F.first(label).alias(label))
    return atoms.groupBy(*keys).agg(*aggs)


def vector_covariance(frames: DataFrame, vec: str) -> DataFrame:
    """(i, j, cov) of coordinates i <= j, sample covariance over frames; each task adds its products up before anything is shuffled.

    Rows without a vector are left out. The products are taken about the
    first vector, so that large offsets do not cost digits.
    """
    got = frames.filter(F.col(vec).isNotNull()).select(vec)
    first = got.limit(1).collect()
    shift = np.array(first[0][0], float) if first else np.zeros(0)
    s = products(got.select(F.lit(0).alias("_c"), vec), "_c", vec, shift)
    n = s.filter("i = -1").select(F.col("s").alias("_n"))
    m = s.filter("i = -2").select(F.col("j").alias("_j"), F.col("s").alias("_s"))
    d = s.filter("i >= 0").join(F.broadcast(n))
    d = d.join(m, F.col("i") == F.col("_j")).drop("_j").withColumnRenamed("_s", "_si").join(m, F.col("j") == F.col("_j"))
    return d.select("i", "j", F.try_divide(F.col("s") - F.col("_si") * F.col("_s") / F.col("_n"), F.col("_n") - 1).alias("cov"))


def frame_table(torsion: DataFrame, rmsd: DataFrame, keys: Sequence[str], frame: str, timestep: float, keep: Sequence[str] = ()) -> DataFrame:
    """frame, time, phi, psi and RMSD side by side; ``keep`` names further torsion columns such as the residue."""
    return torsion.join(rmsd, [*keys, frame]).select(
        *keys, frame, *keep, (F.col(frame) * timestep).alias("time_ps"), "phi_deg", "psi_deg", "rmsd_angstrom")


def gyration(atoms: DataFrame, keys: Sequence[str], mass: Column) -> DataFrame:
    """Mass-weighted radius of gyration per frame (variance form, centred on the frame's mean first)."""
    mid = atoms.groupBy(*keys).agg(*[F.avg(c).alias(f"_0{c}") for c in XYZ])
    d = atoms.join(mid, list(keys)).withColumn("_m", mass)
    c = {v: F.col(v) - F.col(f"_0{v}") for v in XYZ}
    m = F.sum("_m")
    first = sum([(F.sum(F.col("_m") * c[v]) / m) ** 2 for v in XYZ], F.lit(0.0))
    second = F.sum(F.col("_m") * sum([c[v] ** 2 for v in XYZ], F.lit(0.0))) / m
    return d.groupBy(*keys).agg(F.sqrt(F.greatest(second - first, F.lit(0.0))).alias("rg"))


def centred(atoms: DataFrame, keys: Sequence[str], selection: Column, mass: Column, box: Sequence[float] | None = None) -> DataFrame:
    """Subtract each frame's mass centre of the selection; wrap into [-box/2, box/2) when a box is given."""
    com = centre_of_mass(atoms.filter(selection), keys, mass).drop("mass")
    d = atoms.join(com, list(keys))
    out = []
    for i, v in enumerate(XYZ):
        e = F.col(v) - F.col(f"c{v}")
        if box:
            e = F.pmod(e + box[i] / 2.0, F.lit(float(box[i]))) - box[i] / 2.0
        out.append(e.alias(v))
    return d.select(*[c for c in atoms.columns if c not in XYZ], *out)


def water_dipoles(atoms: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """Per water (one O, two H): oxygen z, cosine of the dipole with z, and P2; a zero vector has cosine 0."""
    el = F.substring(name, 1, 1)
    o, h = el == "O", el == "H"
    mean = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    g = atoms.groupBy(*keys).agg(
        F.count_if(o).alias("_no"), F.count_if(h).alias("_nh"),
        *[mean(o, c).alias(f"_o{c}") for c in XYZ], *[mean(h, c).alias(f"_h{c}") for c in XYZ])
    g = g.filter((F.col("_no") == 1) & (F.col("_nh") == 2))
    mu = {c: F.col(f"_h{c}") - F.col(f"_o{c}") for c in XYZ}
    n = F.sqrt(mu["x"] ** 2 + mu["y"] ** 2 + mu["z"] ** 2)
    g = g.withColumn("cos_theta", F.when(n > 0, mu["z"] / n).otherwise(0.0))
    return g.select(*keys, F.col("_oz").alias("z"), "cos_theta", (0.5 * (3 * F.col("cos_theta") ** 2 - 1)).alias("p2"))
