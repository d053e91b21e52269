"""Fixed-width structure files: PDB, PQR, GRO, trajectories, PREPI, CRD and PSF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltables.sources.lines import in_order, number, word, words


def _cut(start: int, end: int) -> Column:
    return F.substring("value", start + 1, end - start)


def _atom_columns(pqr: bool) -> list[Column]:
    name = _cut(12, 16)
    bare = F.trim(name)
    record = F.trim(_cut(0, 6))
    resname = F.trim(_cut(17, 20))
    radius = number(_cut(62, 70))
    tail = (
        [number(_cut(54, 62)).alias("charge"), F.when(radius >= 0, radius).alias("radius")] if pqr else
        [number(_cut(54, 60)).alias("occupancy"), F.coalesce(number(_cut(60, 66)), F.lit(0.0)).alias("bfactor")]
    )
    return [
        record.alias("record"),
        F.coalesce(F.trim(_cut(6, 11)).try_cast("int"), F.lit(0)).alias("serial"),
        F.when(~bare.rlike(r"\s"), bare).otherwise(name).alias("name"),
        _cut(16, 17).alias("altloc"),
        resname.alias("resname"),
        _cut(21, 22).alias("chain"),
        F.trim(_cut(22, 26)).try_cast("int").alias("resseq"),
        _cut(26, 27).alias("icode"),
        F.when(record == "ATOM", " ").when(resname.isin("HOH", "WAT"), "W").otherwise("H").alias("hetero"),
        number(_cut(30, 38)).alias("x"), number(_cut(38, 46)).alias("y"), number(_cut(46, 54)).alias("z"),
        *tail,
        _cut(72, 76).alias("segid"),
        F.upper(F.trim(_cut(76, 78))).alias("element"),
    ]


def is_atom() -> Column:
    return F.substring("value", 1, 6).isin("ATOM  ", "HETATM")


def numbered_models(lines: DataFrame) -> DataFrame:
    """Lines with ``model``: 0 before the first MODEL record, then 0, 1, … per record."""
    d = in_order(lines.withColumn("_m", F.when(F.col("value").startswith("MODEL"), 1).otherwise(0)))
    out = d.scan(sums={"model": F.col("_m")}).df
    return out.withColumn("model", F.greatest(F.col("model") - 1, F.lit(0)).cast("int")).drop("_m")


def pdb_atoms(lines: DataFrame, pqr: bool = False) -> tuple[DataFrame, DataFrame]:
    """(atoms, rejects): rejects are atom records without coordinates or residue number."""
    d = numbered_models(lines).filter(is_atom()).select("file", "block", "seq", "model", *_atom_columns(pqr), "value")
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull() | F.col("resseq").isNull()
    return d.filter(~bad).drop("value"), d.filter(bad).select("file", "block", "seq", "value")


def pdb_sections(lines: DataFrame) -> DataFrame:
    """Lines marked ``header`` (before the first atom or model), ``body`` or ``trailer`` (from END or CONECT)."""
    v = F.col("value")
    starts = v.startswith("ATOM") | v.startswith("HETATM") | v.startswith("MODEL")
    ends = (F.trim(F.substring("value", 1, 6)) == "END") | v.startswith("CONECT")
    o = in_order(lines.withColumns({"_s": starts.cast("int"), "_e": ends.cast("int")}))
    d = o.scan(sums={"_ns": F.col("_s"), "_ne": F.col("_e")}).df
    section = F.when(F.col("_ne") > 0, "trailer").when(F.col("_ns") > 0, "body").otherwise("header")
    return d.withColumn("section", section).drop("_s", "_e", "_ns", "_ne")


def pdb_side_records(lines: DataFrame) -> DataFrame:
    """ANISOU / SIGUIJ / SIGATM values with the serial of the atom before them.

    U values are divided by 10^4; SIGATM holds plain x, y, z, occupancy and B sigmas.
    """
    tag = F.trim(F.substring("value", 1, 6))
    o = in_order(numbered_models(lines).withColumn("_at", F.when(is_atom(), F.trim(_cut(6, 11)).try_cast("int"))))
    d = o.scan(lasts={"serial": F.col("_at")}).df
    u = F.array(*[number(_cut(28 + 7 * i, 35 + 7 * i)) / 10000.0 for i in range(6)])
    sig = F.array(*[number(_cut(30, 38)), number(_cut(38, 46)), number(_cut(46, 54)),
                    number(_cut(54, 60)), number(_cut(60, 66))])
    return d.filter(tag.isin("ANISOU", "SIGUIJ", "SIGATM")).select(
        "file", "block", "seq", "model", "serial", tag.alias("record"),
        F.when(tag == "SIGATM", sig).otherwise(u).alias("values"),
    )


def trajectory_frames(records: DataFrame) -> DataFrame:
    """Atoms of frames read as ENDMDL-terminated records; frames count from 0 per file."""
    has = F.col("value").contains("ATOM")
    framed = in_order(records.filter(has)).row_number("frame").df.withColumn("frame", F.col("frame") - 1)
    lines = framed.select("file", "frame", F.posexplode(F.split("value", r"\r?\n")).alias("ordinal", "value"))
    return lines.filter(is_atom()).select("file", "frame", "ordinal", *_atom_columns(False))


def gro_frames(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) of GRO text; coordinates and box in Angstrom.

    A frame starts at the first line or right after a box line.
    """
    v = F.col("value")
    box_like = F.trim(v).rlike(r"^(-?\d+\.\d+\s+){2}-?\d+\.\d+(\s+-?\d+\.\d+){0,6}$")
    o = in_order(lines.filter(F.trim("value") != "").withColumn("_box", box_like))
    o = o.scan(lags={"_after_box": F.col("_box")})
    o = o.with_columns({"_title": F.coalesce(F.col("_after_box"), F.lit(True))})
    d = o.scan(sums={"frame": F.col("_title").cast("int")}, lags={"_after_title": F.col("_title")}).df
    d = d.withColumn("frame", (F.col("frame") - 1).cast("int"))
    is_line = ~F.col("_box") & ~F.col("_title") & ~F.coalesce(F.col("_after_title"), F.lit(False))
    nm = lambda a, b: number(_cut(a, b)) * 10.0
    atoms = d.filter(is_line).select(
        "file", "block", "seq", "frame", F.trim(_cut(0, 5)).try_cast("int").alias("resseq"),
        F.trim(_cut(5, 10)).alias("resname"), F.trim(_cut(10, 15)).alias("name"),
        F.trim(_cut(15, 20)).try_cast("int").alias("serial"),
        nm(20, 28).alias("x"), nm(28, 36).alias("y"), nm(36, 44).alias("z"),
    )
    box = F.transform(words(v), lambda t: t.try_cast("double") * 10.0)
    frames = d.filter(F.col("_title") | F.col("_box")).groupBy("file", "frame").agg(
        F.max(F.when(F.col("_title"), F.trim("value"))).alias("title"),
        F.max(F.when(F.col("_box") & ~F.col("_title"), box)).alias("box"),
    )
    return atoms, frames


def split_structure(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms, rest, box): box from CRYST1 lengths and angles."""
    atoms, _ = pdb_atoms(lines)
    cryst = F.col("value").startswith("CRYST1")
    spans = ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))
    box = lines.filter(cryst).select("file", F.array(*[number(_cut(a, b)) for a, b in spans]).alias("box"))
    return atoms, lines.filter(~is_atom() & ~cryst), box


def split_ligand(lines: DataFrame, resname: str) -> tuple[DataFrame, DataFrame]:
    """(ligand coordinates, protein lines) by residue name."""
    atoms, _ = pdb_atoms(lines)
    lig = atoms.filter(F.col("resname") == resname).select("file", "block", "seq", "name", "x", "y", "z")
    return lig, lines.filter(is_atom() & (F.trim(_cut(17, 20)) != resname))


def prepi_atoms(lines: DataFrame) -> DataFrame:
    """Template atoms between the second line after CORRECT and LOOP, dummies left out."""
    w = words(F.col("value"))
    kept = lines.filter(~F.col("value").contains("DUMM"))
    marked = kept.withColumns({
        "_c": F.array_contains(w, "CORRECT").cast("int"), "_l": F.array_contains(w, "LOOP").cast("int"),
    })
    d = in_order(marked).scan(sums={"_nc": F.col("_c"), "_nl": F.col("_l"),
                                    "_rows": F.lit(1)}, lasts={"_at": F.when(F.col("_c") == 1, F.lit(1))})
    d = d.scan(sums={"_since": (F.col("_nc") > 0).cast("int")}).df
    body = (F.col("_nc") > 0) & (F.col("_nl") == 0) & (F.col("_since") > 2) & (F.trim("value") != "")
    d = d.filter(body)
    return in_order(d.select("file", "block", "seq", "value")).row_number("ordinal").df.select(
        "file", "ordinal", word(F.col("value"), 1).alias("name"), word(F.col("value"), 2).alias("type"), "value")


def psf_atom_section(lines: DataFrame) -> DataFrame:
    """Lines with ``in_atoms``: as many lines as the count before !NATOM says."""
    v = F.col("value")
    head = v.contains("!NATOM")
    count = F.when(head, word(v, 0).try_cast("bigint"))
    o = in_order(lines).scan(lasts={"_n": count}, sums={"_row": F.lit(1), "_heads": head.cast("int")})
    o = o.with_columns({"_h": F.when(head, F.col("_row"))}).scan(lasts={"_hrow": F.col("_h")})
    past = F.col("_row") - F.col("_hrow")
    return o.df.withColumn("in_atoms", F.coalesce(past.between(1, F.col("_n")), F.lit(False))).drop(
        "_n", "_row", "_heads", "_h", "_hrow")


def crd_atom_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``in_atoms``: everything but comments, the EXT count line and blanks."""
    v = F.col("value")
    return lines.withColumn("in_atoms", ~(v.startswith("*") | v.contains("EXT") | (F.trim("value") == "")))
