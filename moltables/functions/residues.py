"""Residue and atom name rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from moltables.functions.sequence import lookup

# Residue renaming, in rule order.
RESIDUE_RENAMES = {"TRI": "TRIO", "POP": "POPC", "DOP": "DOPE", "SWM": "SWM4"}

# Segment of a residue; anything else is protein.
SEGMENTS = {"TIP3": "TIP3", "SOD": "IONS", "CLA": "IONS", "DOPE": "MEMB", "POPC": "MEMB", "TRIO": "MEMB"}

# Nucleotide renaming and the atom names left out of RNA files.
DNA_TO_RNA = {" DA": " A ", " DT": " U ", " DC": " C ", " DG": " G "}
RNA_DROPPED_RECORDS = ("CONECT", "MASTER")
RNA_DROPPED_ATOMS = ("C5M", "OXT", "P", "O1P", "O2P", "H51", "H52", "H53", "HTER", "HCAP", "H2'2")

# Masses by atom-name element in structure files.
NAME_MASSES = {"C": 12.01, "H": 1.008, "P": 30.97, "N": 14.01, "O": 16.0, "Cl": 35.45, "F": 19.0, "S": 32.065}

# Atomic weights by element of a typed atom.
ELEMENT_MASSES = {
    "H": 1.00794, "Li": 6.941, "B": 10.811, "C": 12.011, "N": 14.00674, "O": 15.9994, "F": 18.9984032,
    "Na": 22.98968, "Mg": 24.3050, "Al": 26.981539, "Si": 28.0855, "P": 30.973762, "S": 32.066, "Cl": 35.4527,
    "K": 39.0983, "Ca": 40.078, "Cr": 51.9961, "Mn": 54.93805, "Fe": 55.847, "Co": 58.93320, "Cu": 63.546,
    "Zn": 65.39, "Se": 78.96, "Br": 79.904, "Mo": 95.94, "Sn": 118.710, "I": 126.90447, "LP": 0.0,
}

# Numeric docking atom type of a typed atom.
DOCK_TYPES = {
    "C.2": 1, "C.ar": 1, "C.1": 1, "C.cat": 1, "C.3": 5, "H": 6, "H.spc": 6, "H.t3p": 6, "H-C": 7, "N.2": 8, "N.1": 8, "N.ar":
    8, "N.pl3": 8, "N.am": 8, "N.4": 9, "N.3": 10, "O.2": 11, "O.co2": 11, "O.spc": 11, "O.t3p": 11, "O.3": 12, "P.3": 13,
    "S.3": 14, "S.2": 14, "S.o": 14, "S.o2": 14, "F": 15, "Cl": 16, "Br": 17, "I": 18, "Na": 19, "K": 19, "Li": 20, "Al": 20,
    "Mg": 20, "Ca": 21, "Si": 24, "LP": 25, "Du": 25, "Du.C": 25, "ANY": 25, "HEV": 25, "HET": 25, "HAL": 25, "Cr.oh": 25,
    "Cr.th": 25, "Se": 25, "Fe": 25, "Cu": 25, "Sn": 25, "Mo": 25, "Mn": 25, "Co.oh": 25, "Zn": 26,
}
CARBON_TYPES = ("C.1", "C.2", "C.3", "C.ar", "C.cat")


# Residue names by class. Chain-end forms carry an N or C prefix.
RESIDUE_NAMES = {
    "protein": """
        ALA ARG ASN ASP CYS CYX GLN GLU GLY HID HIE HIP HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL NALA NARG NASN
        NASP NCYS NCYX NGLN NGLU NGLY NHID NHIE NHIP NHIS NILE NLEU NLYS NMET NPHE NPRO NSER NTHR NTRP NTYR NVAL CALA
        CARG CASN CASP CCYS CCYX CGLN CGLU CGLY CHID CHIE CHIP CHIS CILE CLEU CLYS CMET CPHE CPRO CSER CTHR CTRP CTYR
        CVAL ACE ASH AS4 CHYP CYM GLH GL4 HYP LYN NHE NME
    """.split(),
    "dna": "DA DA3 DA5 DAN DC DC3 DC5 DCN DG DG3 DG5 DGN DT DT3 DT5 DTN".split(),
    "rna": "A A3 A5 AN AMP C C3 C5 CN CMP G G3 G5 GN GMP U U3 U5 UN UMP OHE".split(),
    "lipid": "POPE DOPC AR CHL DHA LAL MY OL PA PC PE PGR PH- PS ST".split(),
    "carbohydrate": "0GB 4GB 0YA 4YA 0fA 0YB 2MA 4YB NLN UYB VMB 0SA 6LB ROH".split(),
    "charmm_water": "TIP3".split(),
    "water": "WAT".split(),
}
RESIDUE_CLASSES = {name: group for group, names in RESIDUE_NAMES.items() for name in names}


def rename_residues(text: Column, renames: Mapping[str, str] | None = None) -> Column:
    """Replace names anywhere in the text, rule after rule."""
    for old, new in (renames or RESIDUE_RENAMES).items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def segment_of(resname: Column, rules: Mapping[str, str] | None = None, default: str = "PROA") -> Column:
    return F.substring(F.coalesce(lookup(F.trim(resname), rules or SEGMENTS), F.lit(default)), 1, 5)


def dna_to_rna(line: Column) -> Column:
    for old, new in DNA_TO_RNA.items():
        line = F.replace(line, F.lit(old), F.lit(new))
    return line


def kept_in_rna(line: Column) -> Column:
    """False for bond/master records and for the dropped atom names (third word)."""
    words = F.split(F.trim(line), r"\s+")
    third = F.coalesce(F.get(words, F.lit(2)), F.lit(""))
    return ~F.get(words, F.lit(0)).isin(*RNA_DROPPED_RECORDS) & ~third.isin(*RNA_DROPPED_ATOMS)


def residue_class(resname: Column) -> Column:
    return F.coalesce(lookup(resname, RESIDUE_CLASSES), F.lit("unknown"))


def mass_of_name(name: Column) -> Column:
    """Mass from a 4-column atom name: two letters if known, else one; a leading non-letter is skipped."""
    core = F.when(F.substring(name, 1, 1).rlike("[A-Za-z]"), name).otherwise(F.substring(name, 2, 10))
    one, two = F.substring(core, 1, 1), F.substring(core, 1, 2)
    return F.coalesce(F.when(two.rlike("^[A-Za-z]{2}$"), lookup(two, NAME_MASSES)), lookup(one, NAME_MASSES))


def element_of_type(atom_type: Column) -> Column:
    return F.substring_index(atom_type, ".", 1)


def mass_of_type(atom_type: Column) -> Column:
    return lookup(element_of_type(atom_type), ELEMENT_MASSES)


def is_heavy(atom_type: Column) -> Column:
    return ~atom_type.startswith("H")
