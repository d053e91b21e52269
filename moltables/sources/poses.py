"""Docked pose files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltables.sources.lines import in_order, number, word

# Fixed values of the pose files: the record's end, and the remarks that hold names, scores, SMILES and distances.
ENDMDL = "ENDMDL\n"


def pdbqt_poses(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(poses, atoms) of docking output; poses are numbered by their result remark."""
    v = F.col("value")
    head = v.startswith("REMARK VINA RESULT:")
    score = F.when(head, number(F.regexp_extract(v, r"REMARK VINA RESULT:\s+(-?\d+\.\d+)", 1)))
    name = F.when(v.startswith("REMARK  Name = "), F.regexp_extract(v, r"Name\s*=\s*(\S+)", 1))
    o = in_order(lines).scan(sums={"pose": head.cast("int")})
    d = o.df.filter(F.col("pose") > 0)
    atoms = d.filter(v.startswith("ATOM") | v.startswith("HETATM")).select("file", "block", "seq", "pose", "value")
    poses = d.groupBy("file", "pose").agg(
        F.max(score).alias("score"), F.max(name).alias("name"),
        F.count_if(v.startswith("ATOM") | v.startswith("HETATM")).alias("n_atoms"),
    ).filter((F.col("n_atoms") > 0) & F.col("score").isNotNull())
    return poses, atoms.join(poses.select("file", "pose"), ["file", "pose"], "left_semi")


def _numbered(records: DataFrame) -> DataFrame:
    return in_order(records.filter(F.col("value").contains("MODEL"))).row_number("pose").df


def pose_records(records: DataFrame) -> DataFrame:
    """Combined pose files read as ENDMDL records: name, score and ATOM coordinates."""
    v = F.col("value")
    lines = F.filter(F.split(v, r"\r?\n"), lambda s: F.trim(s).startswith("ATOM"))
    atom = lambda s: F.struct(
        word(s, 2).alias("name"), *[number(word(s, i)).alias(c) for i, c in ((5, "x"), (6, "y"), (7, "z"))])
    return _numbered(records).select(
        "file", "pose",
        F.nullif(F.regexp_extract(v, r"REMARK\s+Name\s*=\s*(\S+)", 1), F.lit("")).alias("name"),
        number(F.nullif(F.regexp_extract(v, r"VINA RESULT:\s*(-?\d+\.\d+)", 1), F.lit(""))).alias("score"),
        F.transform(lines, atom).alias("atoms"),
    )


def annotated_poses(records: DataFrame) -> DataFrame:
    """Pose files with name, SMILES, score and distance; incomplete models are left out."""
    v = F.col("value")
    get = lambda pat: F.nullif(F.regexp_extract(v, pat, 1), F.lit(""))
    return _numbered(records).select(
        "file", "pose",
        get(r"REMARK Name = (\S+)").alias("name"),
        get(r"REMARK SMILES = (\S+)").alias("smiles"),
        number(get(r"REMARK Vina score: (-?\d+\.\d+)")).alias("score"),
        number(get(r"REMARK Distance from crystal ligand centroid: (\d+\.\d+)")).alias("distance"),
        F.filter(F.split(v, r"\r?\n"), lambda s: s.startswith("ATOM") | s.startswith("HETATM")).alias("atom_lines"),
    ).dropna(subset=["name", "smiles", "score", "distance"])


def smiles_and_scores(records: DataFrame) -> DataFrame:
    return annotated_poses(records).select("file", "pose", "smiles", "score")


_NAME = re.compile(r"^#{10}\s+Name:\s*(\S+)", re.M)
_ENERGY = re.compile(r"^#{10}\s+Total Energy:\s*(\S+)", re.M)


def split_pose_text(chunks: Iterator[str]) -> Iterator[tuple[str, float | None, str]]:
    """(name, energy, text) per pose from lines of an unpacked pose archive."""
    held: list[str] = []

    def done():
        text = "".join(held)
        name = _NAME.search(text)
        if not name:
            return None
        e = _ENERGY.search(text)
        try:
            energy = float(e.group(1)) if e else None
        except ValueError:
            energy = None
        return name.group(1), energy, text

    for line in chunks:
        if _NAME.match(line) and held:
            row = done()
            if row:
                yield row
            held = []
        held.append(line)
    row = done()
    if row:
        yield row
