import gzip
import json

import pytest
from pyspark.sql import functions as F

from moltables.operators.scores import run_totals
from moltables.sources import archives, documents, mol2, poses, scores, simulation, structures, tables
from moltables.sources.lines import read_lines
from moltables.streaming import scores as stream


def test_assay_export(spark, write):
    p = write("a.csv", "Target ChEMBL ID;Smiles;Standard Value;X\nT1;CC;30;x\nT1;;5;x\nT1;CO;;x\nT1;CN;abc;x\n")
    got = sorted((r["smiles"], r["potency"], r["potency_m"]) for r in tables.read_assays(spark, p).collect())
    assert got == [("CC", 30.0, 30.0 * 1e-9), ("CN", None, None)]


def test_pairs_and_duplicates(spark, write):
    from moltables.operators.compounds import duplicate_report
    p = write("a.csv", "Z1,CC\nZ2,CO\nZ3,CC\nbad\n\nZ4,C,N\n")
    good, bad = tables.id_smiles_pairs(read_lines(spark, p))
    assert good.count() == 3 and bad.count() == 3
    rep = {r["key"]: (r["first_id"], r["n_duplicates"], r["duplicates"]) for r in duplicate_report(
        good.withColumn("at", F.struct("block", "seq")), "smiles", "id", "at").collect()}
    assert rep == {"CC": ("Z1", 1, ["Z3"]), "CO": ("Z2", 0, None)}


def test_large_duplicate_group_is_cut_into_lists(spark):
    from moltables.operators.compounds import duplicate_report
    d = spark.range(25).select(F.lit("CC").alias("s"), F.col("id").alias("i"))
    got = {r["part"]: r["duplicates"] for r in duplicate_report(d, "s", "i", "i", chunk=10).collect()}
    assert got == {0: list(range(1, 11)), 1: list(range(11, 21)), 2: list(range(21, 25))}


ATOM = "{:<6}{:>5} {:<4}{}{:>3} {}{:>4}{}   {:>8}{:>8}{:>8}{:>6}{:>6}      {:<4}{:>2}"


def pdb_line(rec, serial, name, res, chain, seq, x, y, z, occ="1.00", b="0.00", seg="", el="C"):
    return ATOM.format(rec, serial, name, " ", res, chain, seq, " ", x, y, z, occ, b, seg, el)


def test_pdb_fields_and_rejects(spark, write):
    text = "\n".join([
        "HEADER x", "MODEL        1", pdb_line("ATOM", 1, " CA ", "ALA", "A", 1, "1.000", "2.000", "3.000", "", ""),
        "ANISOU    1  CA  ALA A   1     " + "".join(f"{v:>7}" for v in (100, 200, 300, 1, 2, 3))[3:],
        pdb_line("HETATM", "xx", " O  ", "HOH", "A", 1, "1.0", "2.0", "3.0"), pdb_line("ATOM", 3, " N  ", "GLY", "B", 2, "bad", "2.0", "3.0"),
        "ENDMDL", "MODEL        2", pdb_line("ATOM", 1, " N B", "ALA", "A", 1, "1.0", "2.0", "3.0"), "ENDMDL", "END", "MASTER"]) + "\n"
    lines = read_lines(spark, write("a.pdb", text))
    atoms, bad = structures.pdb_atoms(lines)
    got = {(r["model"], r["name"]): r for r in atoms.collect()}
    assert set(got) == {(0, "CA"), (0, "O"), (1, " N B")}
    assert got[(0, "CA")]["occupancy"] is None and got[(0, "CA")]["bfactor"] == 0.0
    assert got[(0, "O")]["serial"] == 0 and got[(0, "O")]["hetero"] == "W"
    assert bad.count() == 1
    sec = {r["section"]: r["n"] for r in structures.pdb_sections(lines).groupBy("section").agg(F.count("*").alias("n")).collect()}
    assert sec["header"] == 1 and sec["trailer"] == 2
    side = structures.pdb_side_records(lines).collect()
    assert len(side) == 1 and side[0]["serial"] == 1


def test_trajectory_records_and_gro(spark, write):
    frame = lambda k: f"MODEL {k}\n" + "\n".join(pdb_line("ATOM", i + 1, n, "ALA", "A", 1, f"{k + i:.3f}", "0.0", "0.0") for i, n in enumerate((" N  ", " CA "))) + "\nENDMDL\n"
    p = write("t.pdb", frame(1) + frame(2) + frame(3))
    got = structures.trajectory_frames(read_lines(spark, p, sep="ENDMDL\n")).groupBy("frame").agg(F.sum("x").alias("x")).collect()
    assert {r["frame"]: r["x"] for r in got} == {0: 3.0, 1: 5.0, 2: 7.0}
    gro = "".join(f"title {k}\n2\n    1WAT     OW    1   0.100   0.200   0.300\n    1WAT    HW1    2   0.400   0.500   0.600\n   1.0 2.0 3.0\n" for k in range(2))
    atoms, frames = structures.gro_frames(read_lines(spark, write("a.gro", gro)))
    assert atoms.count() == 4 and abs(atoms.agg(F.sum("z")).first()[0] - 18.0) < 1e-9
    f = {r["frame"]: (r["title"], [round(b, 6) for b in r["box"]]) for r in frames.collect()}
    assert f == {0: ("title 0", [10.0, 20.0, 30.0]), 1: ("title 1", [10.0, 20.0, 30.0])}


def test_mol2_headers_belong_to_the_next_molecule(spark, write):
    def mol(n):
        return (f"########## Name: {n}\n@<TRIPOS>MOLECULE\n{n}\n2 1 1 0 0\nSMALL\nUSER\n@<TRIPOS>ATOM\n1 C1 0.0 0.0 0.0 C.3 1 LIG 0.1\n"
                "2 H1 1.0 0.0 0.0 H 1 LIG -0.1\n@<TRIPOS>BOND\n1 1 2 1\n")
    mols, atoms, bonds = mol2.read_mol2(spark, write("m.mol2", mol("A") + mol("B")))
    assert {(r["mol_id"], r["name"], r["header"]) for r in mols.collect()} == {(1, "A", "########## Name: A"), (2, "B", "########## Name: B")}
    assert atoms.count() == 4 and bonds.count() == 2 and atoms.filter("heavy").count() == 2


def test_pose_files(spark, write, tmp_path):
    one = "MODEL 1\nREMARK VINA RESULT:    -8.1  0 0\nREMARK  Name = L1\nATOM      1  C   LIG  1 1.0 2.0 3.0\nENDMDL\nMODEL 2\nREMARK VINA RESULT:    -7.0\nREMARK  Name = L2\nATOM      1  C   LIG  1 4.0 5.0 6.0\nENDMDL\n"
    ps, atoms = poses.pdbqt_poses(read_lines(spark, write("a.pdbqt", one)))
    assert {(r["pose"], r["score"], r["name"]) for r in ps.collect()} == {(1, -8.1, "L1"), (2, -7.0, "L2")} and atoms.count() == 2
    rec = poses.pose_records(read_lines(spark, write("b.pdb", one), sep=poses.ENDMDL)).collect()
    assert [(r["name"], r["score"], len(r["atoms"])) for r in sorted(rec, key=lambda r: r["pose"])] == [("L1", -8.1, 1), ("L2", -7.0, 1)]
    note = "MODEL 1\nREMARK Name = A\nREMARK SMILES = CC\nREMARK Vina score: -5.5\nREMARK Distance from crystal ligand centroid: 1.25 A\nATOM x\nENDMDL\nMODEL 2\nREMARK Name = B\nENDMDL\n"
    got = poses.annotated_poses(read_lines(spark, write("c.pdb", note), sep=poses.ENDMDL)).collect()
    assert [(r["name"], r["smiles"], r["score"], r["distance"]) for r in got] == [("A", "CC", -5.5, 1.25)]
    text = "########## Name: Z1\n########## Total Energy: -3.5\nx\n########## Name: Z1\n########## Total Energy: -4.5\n########## Name: Z2\n########## Total Energy: 600\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "test.mol2.gz.0").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "arc" / "test.mol2.gz.1").write_bytes(gzip.compress(text.encode())[:40])
    ok = {r["file"][-1]: r["ok"] for r in archives.archive_states(spark, str(tmp_path / "arc")).collect()}
    assert ok == {"0": True, "1": False}
    arc = archives.read_pose_archives(spark, str(tmp_path / "arc" / "test.mol2.gz.0"))
    from moltables.operators.scores import best_poses
    best, missing = best_poses(arc, spark.createDataFrame([("Z1",), ("Z2",)], "name string"))
    assert [(r["name"], r["energy"], r["ordinal"]) for r in best.collect()] == [("Z1", -4.5, 1)]
    assert [r["name"] for r in missing.collect()] == ["Z2"]


def test_run_log_totals(spark, write):
    row = "1 ZINC1 " + " ".join("x" * 19) + "\n"
    log = "start\nmol#  id\n" + row + "2 ZINC2 bump here\n3 ZINC3 clash here\nwe reached the end\nclose SDIFILE\ntotal number of hierarchies: 16114\nelapsed time (sec): 5484.6802 (hour): 1.5235\n"
    t = run_totals(scores.run_log_events(read_lines(spark, write("OUTDOCK", log)))).first()
    assert (t["docked"], t["scored"], t["bump"], t["clash"], t["total_hierarchies"], t["total_secs"]) == (3, 1, 1, 1, 16114.0, 5484.6802)


def test_energy_log_blocks(spark, write):
    log = (" NSTEP = 1  TIME(PS) = 0.5  TEMP(K) = 300.0  PRESS = 1.0\n Etot = -5.0 EKtot = 1.0 EPtot = -6.0\n A V E R A G E S   O V E R  2 S T E P S\n"
           " NSTEP = 2  TIME(PS) = 1.0  TEMP(K) = 310.0  PRESS = 1.0\n R M S  F L U C T U A T I O N S\n NSTEP = 2  TIME(PS) = 1.0  TEMP(K) = 3.0  PRESS = 1.0\n")
    got = {(r["block"], r["time"], r["metric"]): r["value"] for r in simulation.energy_log(read_lines(spark, write("md.out", log))).collect()}
    assert got[("instant", 0.5, "TEMP(K)")] == 300.0 and got[("instant", 0.5, "EPtot")] == -6.0
    assert got[("average", 1.0, "TEMP(K)")] == 310.0 and got[("rms", 1.0, "TEMP(K)")] == 3.0


def test_sequence_documents(spark, tmp_path):
    doc = {"name": "a", "sequences": [{"protein": {"id": ["A"], "sequence": "MKV"}}, {"protein": {"id": ["B"]}}, {"ligand": {}}], "modelSeeds": [1], "dialect": "d", "version": 1}
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "a.json").write_text(json.dumps(doc))
    (tmp_path / "x" / "b.json").write_text("{broken")
    good, bad = documents.read_sequence_documents(spark, str(tmp_path / "x"))
    assert [r["sequence"] for r in documents.proteins(good).collect()] == ["MKV"] and bad.count() == 1


def test_prepi_and_crd(spark, write):
    text = "x\nCORRECT OMIT DU\n0.0\n1 DUMM DU\n2 C1 C\n\n3 N1 N\nLOOP\n4 O1 O\n"
    got = structures.prepi_atoms(read_lines(spark, write("a.prepi", text))).orderBy("ordinal").collect()
    assert [r["name"] for r in got] == ["C1", "N1"]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "compound_id string, score double, row int"
    for k, data in enumerate(([("a", 3.0, 1), ("b", 2.0, 2)], [("a", 1.0, 3), ("c", 9.0, 4)])):
        spark.createDataFrame(data, schema).write.mode("append").parquet(src)
        st = stream.score_stream(spark, src, schema)
        stream.best_score_updates(st, F.col("compound_id"), "score", ["row"], out, str(tmp_path / "c")).awaitTermination()
    got = {r["compound"]: (r["score"], r["row"]) for r in stream.current_best(spark, out).collect()}
    assert got == {"a": (1.0, 3), "b": (2.0, 2), "c": (9.0, 4)}
    st = stream.score_stream(spark, src, schema)
    stream.append_new_targets(st, "compound_id", str(tmp_path / "t"), str(tmp_path / "c2"))
    assert stream.read_table(spark, str(tmp_path / "t")).count() == 4
    stream.compact_best(spark, out)
    assert stream.BatchTable(spark, out).read().count() == 3
    assert {r["compound"]: (r["score"], r["row"]) for r in stream.current_best(spark, out).collect()} == got


def test_a_batch_that_failed_half_way_runs_again(spark, tmp_path, monkeypatch):
    """The second batch is lost after its rows are written, before it counts; the run goes on from its own beginning."""
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    schema = "key string, n int"
    old = spark.createDataFrame([("a", 0)], schema)
    old.write.parquet(src)
    stream.append_new_targets(stream.score_stream(spark, src, schema), "key", out, ckpt)
    for k in range(1, 4):  # three files, a file a batch; target b comes in all of them, a is known
        spark.createDataFrame([("a", k), ("b", k)], schema).coalesce(1).write.mode("append").parquet(src)
    note, calls = stream.BatchTable.note, []

    def lost(self, kind, source, batch, *rest):
        calls.append(kind)
        if kind == "batch" and calls.count("batch") == 2:
            raise RuntimeError("lost")
        note(self, kind, source, batch, *rest)
    monkeypatch.setattr(stream.BatchTable, "note", lost)
    with pytest.raises(Exception, match="lost"):
        stream.append_new_targets(stream.score_stream(spark, src, schema, files_per_trigger=1), "key", out, ckpt)
    monkeypatch.setattr(stream.BatchTable, "note", note)
    assert len(list((tmp_path / "out" / "rows").iterdir())) == 3 and stream.read_table(spark, out).count() == 2
    stream.append_new_targets(stream.score_stream(spark, src, schema, files_per_trigger=1), "key", out, ckpt)
    assert sorted((r["key"], r["n"]) for r in stream.read_table(spark, out).collect()) == [("a", 0), ("b", 1), ("b", 2), ("b", 3)]
    stream.BatchTable(spark, out).compact()
    stream.append_new_targets(stream.score_stream(spark, src, schema), "key", out, ckpt)
    assert stream.read_table(spark, out).count() == 4


def test_registry_takes_a_null_key_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, at int, v string"
    for k in range(3):
        spark.createDataFrame([(None, k, "x"), ("a", k, "y"), (f"n{k}", k, None)], schema).coalesce(1).write.mode("append").parquet(src)
        stream.grow_registry(stream.score_stream(spark, src, schema), out, "key", "at", "v", str(tmp_path / "c")).awaitTermination()
    assert sorted((str(r["key"]), r["at"]) for r in stream.read_table(spark, out).collect()) == [("None", 0), ("a", 0)]


def test_files_of_one_block_are_read_once(spark):
    """Rendered lines need no carry between blocks; those cut into ranges do."""
    from moltables.sources import structures as ST
    from moltables.sources.lines import lines_from

    rows = [(f, 10 * m + i, v) for f in (1, 2) for m in range(3) for i, v in enumerate(["MODEL", f"ATOM  {m:5d}", "ENDMDL"])]
    d = spark.createDataFrame(rows, "f long, at long, v string")
    want = sorted((str(f), at, v, at // 10) for f, at, v in rows)
    for hot, joins in ((False, 0), (True, 1)):
        got = ST.numbered_models(lines_from(d, d["f"].cast("string"), d["at"], d["v"], hot=hot))
        assert sorted((r["file"], r["seq"], r["value"], r["model"]) for r in got.collect()) == want
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == joins
