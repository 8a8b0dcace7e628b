import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.project import Project, initialize
from strandloom.sources import extracts, pack, pdb, reports, sinks
from strandloom.streaming import hits

XYZ = np.array([[0, 0, 0], [3, 0, 0], [6, 1, 0], [9, 1, 1], [12, 0, 1]], float)


def coordinate_text():
    lines, n = [], 0
    for i, c in enumerate(XYZ):
        for k, name in enumerate(("N", "CA", "C", "O")):
            n += 1
            x, y, z = c + (0 if name == "CA" else 0.1 * (k + 1))
            lines.append(f"ATOM  {n:5d}  {name:<3s} ALA A{i + 1:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00")
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    tables = {
        "query_meta": pd.DataFrame([("testA", 5, "AAAAA", "HHHHH", "toy", "1-5")], columns=["id", "length", "sequence", "dssp", "compnd", "domain_string"]),
        "summary": pd.DataFrame([(1, 1, 1, 10.0)], columns=["alignment_id", "protein_id", "namespace_id", "z_score"]),
        "id_mapping": pd.DataFrame([(1, "1abcA", "PDB", 1)], columns=["protein_id", "target_id", "namespace_raw", "namespace_id"]),
        "segments": pd.DataFrame([(1, 1, 1, 5)], columns=["alignment_id", "q_start", "s_start", "length"]),
        "colab_pack_index": pd.DataFrame([("1.1abcA", "1abcA", 5, 0, 5, "toy", "")], columns=["umid", "dali_id", "length", "start_idx", "end_idx", "compnd", "centroid"]),
        "pfam": pd.DataFrame([("1abcA", "PF00001", 1e-10, 1, 5, "PDB", "CL0001")], columns=["target_name", "query_accession", "e_value", "env_from", "env_to", "database", "clan"]),
    }
    arrays = {"coords": XYZ.astype(np.float16), "seq": np.frombuffer(b"AAAAA", np.uint8), "dssp": np.frombuffer(b"HHHHH", np.uint8)}
    return pack.save(tmp_path_factory.mktemp("pack") / "toy.tar.gz", tables, arrays, coordinate_text())


def test_pack_to_view(spark, archive):
    p = Project(spark).load_pack(str(archive))
    (row,) = p.views["dom_0-5"].collect()
    assert (row.alignment_length, row.query_coverage, row.sequence_identity, row.pfam, row.clan, row.pfam_rank) == (5, 1.0, 1.0, "PF00001", "CL0001", 1)
    assert row.rmsd < 1e-2 and row.sequ_pileup == "AAAAA" and row.dssp_pileup == "HHHHH"
    assert p.views[p.add_fold_subset("dom_0-5")].count() == 1
    assert p.add_domains("1-2, 3-5") == ["dom_0", "dom_1"] and p.views["dom_0"].first().alignment_length == 2
    assert p.domain_ranges("dom_0-5_FOLD") == [(0, 5)]
    assert p.add_custom_subset("z_score >= 10 & pfam == 'PF00001'", "good", "dom_0-5") and p.views["good"].count() == 1
    assert not p.add_custom_subset("", "none") and not p.add_custom_subset("z_score + 1", "none") and not p.add_custom_subset("nothing > 1", "none")
    assert row.pfam_domains[0].id == "PF00001" and row.clan_domains[0].id == "CL0001" and p.structure("1abcA")["length"] == 5
    assert p.next_name("dom_0-5", "x") == "dom_0-5_x_0"


def test_many_packs(spark, archive):
    rows = pack.load_many(spark, str(archive.parent), "segments").collect()
    assert [(r.alignment_id, r.q_start, r.length) for r in rows] == [(1, 1, 5)] and rows[0].pack.endswith("toy.tar.gz")
    (one,) = pack.load_many(spark, str(archive), "structures").collect()
    assert one.seq == "AAAAA" and len(one.xyz) == 15
    assert pack.load_many(spark, str(archive), "mini_ligand").count() == 0


def test_broken_packs_are_refused(spark, archive, tmp_path):
    bad = tmp_path / "bad.tar.gz"
    bad.write_bytes(archive.read_bytes()[:-20])
    with pytest.raises(ValueError):
        pack.complete(bad)
    bad.write_text("<html>")
    with pytest.raises(ValueError):
        pack.complete(bad)
    assert initialize(spark, str(bad)) == (None, None, None)
    assert pack.located("some/where.tar.gz").name == "where.tar.gz"
    with pytest.raises(ValueError):
        pack.located("http:///x")


def test_session_round_trip(spark, archive, tmp_path):
    p = Project(spark).load_pack(str(archive))
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    assert p.add_view("domain 1", rows) and p.add_view("domain_1", rows.withColumn("id", F.lit(2))) and not p.add_view("domain_1", rows)
    p.add_model("line", {"w": [1.0, 2.0]})
    p.bookmark("plot", "histogram", "domain 1")
    p.save(str(tmp_path / "s"))
    with pytest.raises(FileExistsError):
        p.save(str(tmp_path / "s"))
    q = Project.open(spark, str(tmp_path / "s"))
    assert [q.views[n].first().id for n in ("domain 1", "domain_1")] == [1, 2] and q.models == p.models and q.plots == p.plots
    assert q.views["dom_0-5"].first().alignment_length == 5 and q.inventory().count() == 4


def test_reports(spark, tmp_path):
    table = tmp_path / "r.tsv"
    table.write_text("# note\nTarget\tnamespace\tz_score\tqstarts\tsstarts\tlengths\nquery\tPDB\t99\t[1]\t[1]\t[5]\n1abcA\tPDB\t10\t[1, 9]\t[2, 12]\t[5, 3]\n.\tPDB\t1\t[1]\t[1]\t[1]\n2xyzB\tAFDB2\tx\t3\t4\t\n")
    summary, segments = reports.read_table(spark, str(table))
    assert [tuple(x) for x in summary.orderBy("alignment_id").collect()] == [(1, "1abcA", 10.0, "PDB"), (2, "2xyzB", None, "AFDB2")]
    assert sorted(map(tuple, segments.collect())) == [(1, 1, 2, 5), (1, 9, 12, 3), (2, 3, 4, 0)]
    out, mapping = reports.identified(summary)
    assert [(x.protein_id, x.target_id, x.namespace_id) for x in mapping.orderBy("protein_id").collect()] == [(1, "1abcA", 1), (2, "2xyzB", 2)]
    text = tmp_path / "r.txt"
    text.write_text("# No:  Chain   Z\n   1:  1abc-A 10.2 x\n\n# Structural equivalences\n" + f"{'   1':<5}{'':16}{'   1':>5}-{'   5':>5}{'':4}{'   3':>5}-{'   7':>5}\n# end\n   2: zzz 3\n")
    summary, segments = reports.read_text(spark, str(text))
    assert [tuple(x) for x in summary.collect()] == [(1, "1abcA", 10.2, None)]
    assert [tuple(x) for x in segments.collect()] == [(1, 1, 3, 5)]


def test_metadata_and_domain_tree():
    node = lambda n, a, b, size, *ends: f"{n:4d} + {a:4d}{b:4d}{size:4d}{len(ends) // 2:4d}" + "".join(f"{e:4d}" for e in ends)
    text = '>>>> testA  300\n-sequence "AAA"\n-dssp "HHH"\n-compnd "toy"\n' + "\n".join([node(1, 2, 3, 300, 1, 300), node(2, 0, 0, 200, 1, 200), node(3, 0, 0, 100, 201, 300)])
    meta = reports.parse_metadata(text)
    assert meta["id"] == "testA" and meta["length"] == 300 and meta["sequence"] == "AAA" and meta["domain_string"] == "1-200, 201-300"
    assert reports.parse_metadata(">>>> q 7\n")["domain_string"] == "1-7"


def test_fasta_and_pairs(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text(">one/5-9\nAC-\nDE\n>two\nA\n")
    got = [tuple(x) for x in reports.read_gapped_fasta(spark, str(f)).orderBy("record").collect()]
    assert got == [(1, "one/5-9", 5, "AC-DE"), (2, "two", 1, "A")]
    assert reports.aligned_pairs("AC-D", "A-GD", 5, 1) == [(5, 1), (7, 3)]


def test_coordinates(spark):
    rows = pdb.atoms(pdb.lines_of(spark, coordinate_text()))
    ca = pdb.alpha_carbons(rows).orderBy("i").collect()
    assert np.allclose([[x.x, x.y, x.z] for x in ca], XYZ) and {x.aa for x in ca} == {"A"}
    broken = rows.where("NOT (resnum = 3 AND name = 'O')")
    assert pdb.renumbered(broken, "A").select("resnum").distinct().count() == 4
    again = pdb.atoms(pdb.atom_text(rows))
    assert again.count() == rows.count()
    assert "CA  ALA A   1" in pdb.trace_text(pdb.alpha_carbons(rows)).orderBy("i").first().value


def test_extracts(spark):
    hit = spark.createDataFrame([("hitA", "PF00001.3", "label"), ("unwantedA", "PF00001", "label"), ("hitA", "PF00001", "OTHER"), ("target_name", "query_accession", "label")], "target_name string, query_accession string, database string")
    entries = spark.createDataFrame([("PF00001", "CL0001")], "AC string, CL string")
    ids = spark.createDataFrame([("hitA",), ("hitA",)], "target_id string")
    (row,) = extracts.annotation_hits(ids, hit, entries, "LABEL").collect()
    assert row.clan == "CL0001"
    names = spark.createDataFrame([("PF00001", "CL1", "x"), ("PF10417", None, None), ("PF9", "CL2", "y")], "pfam string, clan string, clan_short string")
    used = spark.createDataFrame([("PF00001",), ("PF10417",), ("PF00001",)], "query_accession string")
    assert {x.pfam: (x.clan, x.clan_short) for x in extracts.descriptions(names, used).collect()} == {"PF00001": ("CL1", "x"), "PF10417": ("PF10417", "")}
    sizes = spark.createDataFrame([(1, 5), (2, 7)], "o int, length int")
    assert [(x.start_idx, x.end_idx) for x in pack.offsets(sizes, "o").orderBy("o").collect()] == [(0, 5), (5, 12)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "AC", [1, 2])], "id int, s string, v array<int>")
    sinks.tsv(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first().v == "[1,2]"
    sinks.fasta(df, "id", "s", str(tmp_path / "f"))
    assert [x.value for x in spark.read.text(str(tmp_path / "f")).collect()] == [">1", "AC"]
    assert sinks.newick("(a,b);", tmp_path / "n").read_text() == "(a,b);\n"


def test_stream(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = hits.parquet_stream(spark, str(tmp_path / "in"), events.schema)
    hits.run_once(hits.first_seen(stream, "ts", ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    counts = hits.windowed_counts(events, "ts", "event_type", "value")
    assert counts.agg({"n": "sum"}).first()[0] == events.count()
