"""Unit conversions and small physical formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Molar mass of water, particles per mole, kT in kcal/mol at 298 K, kT to kcal/mol.
WATER_MOLAR_MASS = 18.01528
PER_MOLE = 6.02214076e23
KT = 0.593
KT_TO_KCAL = 0.5924
DEBYE_PER_ELECTRON_ANGSTROM = 4.796


def wrap360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def degree_force_constant(rk2: Column) -> Column:
    """k per degree squared from an rk2 per radian squared."""
    return F.lit(2.0) * rk2 * F.lit((math.pi / 180.0) ** 2)


def counts_to_density(count: Column, area: float) -> Column:
    """g/cm3 from molecules per bin and cross-section area (A2)."""
    return count / F.lit(area) * F.lit(WATER_MOLAR_MASS / PER_MOLE * 1e24)


def sd_to_density(sd: Column, area: float, dz: float, frames: int, same_divisor: bool = True) -> Column:
    """Density of a count sd: the divisor of the mean, or (parity) frames times bin volume."""
    div = area if same_divisor else frames * area * dz
    return sd / F.lit(div) * F.lit(WATER_MOLAR_MASS / PER_MOLE * 1e24)


def network_decay(distance: Column, shift: float, rate: float, power: float) -> Column:
    return F.exp(-F.lit(rate) * F.pow(distance - F.lit(shift), F.lit(power)))
