"""Readers and writers: small literal texts and round trips."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from specimen_spark.sources import flatfile, readers, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return [(r["title"], r["seq"]) for r in df.orderBy("ord").collect()]


def joined(path):
    return "\n".join(open(f).read().rstrip("\n") for f in sorted(glob.glob(f"{path}/part-*")))


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fas", ">Musca_prima x\nAC GU\n\n# note\nac\n>\nAA\n")
    assert rows(readers.read_fasta(spark, p)) == [("Musca prima x", "ACGTac"), ("No name specified in file", "AA")]


def test_fasta_split_within_files(spark, tmp_path):
    for name, end in (("a.fas", "\n"), ("b.fas", "\r\n"), ("c.fas", "\r")):
        lines = [f"{'  ' if i % 11 == 3 else ''}>name_{i}{end}ACGU{'A' * (i % 70)}{end}# note{end}ac{'g' * (i % 9)}" for i in range(300)]
        (tmp_path / name).write_bytes((("" if name == "b.fas" else f"head{end}") + end.join(lines)).encode())
    put(tmp_path, "d.fas", "")
    whole = readers.parse_fasta(readers.whole_files(spark, str(tmp_path)))
    want = sorted(map(tuple, whole.collect()))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = readers.read_fasta(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(map(tuple, got.collect())) == want and len(want) == 900
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_mega(spark, tmp_path):
    p = put(tmp_path, "a.meg", '#mega\nTITLE "x"\n\n#b_c AC "note" GT\n#a AA\n#b_c TT\n')
    assert rows(readers.read_mega(spark, p)) == [("a", "AA"), ("b c", "ACGTTT")]


NEXUS = """#NEXUS
[a comment]
BEGIN DATA;
 DIMENSIONS NTAX=2 NCHAR=8;
 FORMAT DATATYPE=DNA MISSING=N GAP=. INTERLEAVE;
 MATRIX
Musca_prima AC.N [4:1-4]
Apis_secunda (AG)CGT

Musca_prima GGTT
Apis_secunda AAAA
;
END;
BEGIN SETS;
 CHARSET one = 1-3 5;
 CHARSET two (STANDARD) = 6-.;
 TAXSET x = 1 2;
END;
BEGIN CODONS;
 CODONPOSSET * cp = 1: 1-7\\3, 2: 2-8\\3;
END;
"""


def test_nexus(spark, tmp_path):
    s, c = readers.read_nexus(spark, put(tmp_path, "a.nex", NEXUS))
    assert rows(s) == [("Musca prima", "AC-?GGTT"), ("Apis secunda", "[AG]CGTAAAA")]
    got = {(r["name"], r["pos"], r["from"], r["to"], r["stride"]) for r in c.collect()}
    assert got == {("one", None, 1, 3, 1), ("one", None, 5, 5, 1), ("two", None, 6, 8, 1), ("codons", 1, 1, 7, 3), ("codons", 2, 2, 8, 3)}


def test_tnt(spark, tmp_path):
    s, c, bad = readers.read_tnt(spark, put(tmp_path, "a.tnt", "nstates dna;\nxread\n'title'\n6 2\nA_b ACGTAC\nC_d AC[AG]TAC\n;\nxgroup\n=0 (one) 0.2\n=1 (two_pos1) 3 4 5\n;\nproc /;\n"))
    assert rows(s) == [("A b", "ACGTAC"), ("C d", "AC[AG]TAC")]
    assert {(r["name"], r["pos"], r["from"], r["to"]) for r in c.collect()} == {("one", None, 1, 3), ("two", 1, 4, 6)}
    assert bad.count() == 0
    assert readers.read_tnt(spark, put(tmp_path, "b.tnt", "xread\n5 3\nA AC\n;"))[2].count() == 1


def test_any_and_grid(spark, tmp_path):
    put(tmp_path, "l1.fas", ">A b\nACGT\n")
    put(tmp_path, "l2.nex", NEXUS)
    got = {r["locus"] for r in readers.load_grid(spark, str(tmp_path)).collect()}
    assert got == {"l1", "l2"}


def sequences(spark):
    return spark.createDataFrame([(0, "Musca prima", "AC-T" * 30, None, "1"), (1, "Apis secunda", "ACGT" * 30, "Apidae", None)], "ord long, title string, seq string, family string, gi string").withColumn("species", F.col("title"))


@pytest.mark.parametrize("write,read", [(writers.write_fasta, readers.read_fasta), (writers.write_nexus, lambda s, p: readers.read_nexus(s, p)[0]), (writers.write_tnt, lambda s, p: readers.read_tnt(s, p)[0]), (writers.write_mega, readers.read_mega)])
def test_round_trip(spark, tmp_path, write, read):
    df = sequences(spark)
    write(df, str(tmp_path / "out"))
    text = joined(tmp_path / "out")
    assert sorted(rows(read(spark, put(tmp_path, "back.txt", text)))) == sorted((r["title"], r["seq"]) for r in df.collect())
    with pytest.raises(Exception, match="(?i)exists"):
        write(df, str(tmp_path / "out"))


def test_phylip_and_alignment(spark, tmp_path):
    writers.write_phylip(sequences(spark), str(tmp_path / "p"))
    assert joined(tmp_path / "p").startswith("2 120\nMusca_prima AC-T")
    assert writers.export_for_alignment(sequences(spark)).orderBy("ord").first()["line"].startswith(">seq1\n")
    with pytest.raises(ValueError):
        writers.export_for_alignment(sequences(spark).withColumn("gi", F.lit("1")))


def grid(spark):
    return spark.createDataFrame([("l1", "t", 0, "ACGT", 4, False), ("l2", "t", 0, "AA", 2, False), ("l1", "u", 1, "AC-T", 4, False)], "locus string, taxon string, ord long, seq string, actual_length int, cancelled boolean")


def test_supermatrix(spark, tmp_path):
    writers.write_supermatrix_nexus(grid(spark), str(tmp_path / "m"))
    s, c = readers.read_nexus(spark, put(tmp_path, "m.nex", joined(tmp_path / "m")))
    assert rows(s) == [("t", "ACGTAA"), ("u", "AC-T??")]
    assert {(r["name"], r["from"], r["to"]) for r in c.collect()} == {("l1", 1, 4), ("l2", 5, 6)}
    writers.write_supermatrix_tnt(grid(spark), str(tmp_path / "t"))
    assert "=1 (l2) 4.5" in joined(tmp_path / "t")
    with pytest.raises(ValueError):
        writers.write_supermatrix_nexus(grid(spark).withColumn("cancelled", F.lit(True)), str(tmp_path / "x"))
    writers.write_sequences(grid(spark), str(tmp_path / "s"))
    back = readers.read_sequences(spark, put(tmp_path, "s.txt", joined(tmp_path / "s")))
    assert {(r["locus_override"], r["taxon_override"], r["seq"]) for r in back.collect()} == {("l1", "t", "ACGT"), ("l2", "t", "AA"), ("l1", "u", "AC-T")}
    writers.write_by_locus(grid(spark), str(tmp_path / "by"), include_na=True)
    assert sorted(os.listdir(tmp_path / "by"))[-2:] == ["locus=l1", "locus=l2"]
    writers.write_grid_tsv(grid(spark), str(tmp_path / "tsv"))
    assert joined(tmp_path / "tsv").splitlines()[0] == "taxon\tl1\tl2"


FLAT = """LOCUS       X1
DEFINITION  Musca prima
            gene.
ACCESSION   X1
VERSION     X1.1  GI:77
FEATURES             Location/Qualifiers
     gene            2..4
                     /gene="abc"
     CDS             complement(1..3)
                     /product="some
                     thing"
     misc            join(1..2,5..6)
     bad             complement(join(1..2,3..4))
ORIGIN
        1 aacg tt
//
LOCUS       X2
ACCESSION   X2
ORIGIN
        1 acgt
//
"""


def test_flat_file(spark, tmp_path):
    loci = flatfile.read_flatfile(spark, put(tmp_path, "a.gb", FLAT))
    got = {r["accession"]: (r["name"], r["gi"], r["origin"]) for r in loci.collect()}
    assert got == {"X1": ("Musca prima gene.", "77", "AACGTT"), "X2": ("X2", None, "ACGT")}
    features = flatfile.features_by_gene(flatfile.explode_features(loci))
    by = {r["gene"]: r["location"] for r in features.collect()}
    assert set(by) == {"gene abc-gene", "product some thing-CDS", "misc"}
    cut = {r["feature"]: r["seq"] for r in flatfile.extract_features(features, loci).collect()}
    assert cut == {"gene": "ACG", "CDS": "GTT", "misc": "AATT"}
    assert flatfile.features_intersect(features).count() == 3
    assert flatfile.list_sections(loci).where("section = 'ORIGIN'").count() == 2


def test_restore_titles(spark):
    a = spark.createDataFrame([(0, "seq12"), (1, "seqU5"), (2, "other")], "ord long, title string")
    o = spark.createDataFrame([("gi|12| Musca prima",), ("x [uniqueid:5]",), ("gi|99| gone",)], "title string")
    back, missing = flatfile.restore_titles(a, o)
    assert [r["title"] for r in back.orderBy("ord").collect()] == ["gi|12| Musca prima", "x [uniqueid:5]", "other"]
    assert [r["title"] for r in missing.collect()] == ["gi|99| gone"]


def test_files_of_one_name_become_loci_of_their_own(spark, tmp_path):
    put(tmp_path, "l1.fas", ">A b\nACGT\n")
    put(tmp_path, "l1.nex", NEXUS)
    put(tmp_path, "l2.fas", ">A b\nACGT\n")
    got = readers.load_grid(spark, str(tmp_path))
    assert {(r["locus"], r["n"]) for r in got.groupBy("locus").agg(F.count(F.lit(1)).alias("n")).collect()} == {("l1", 1), ("l1_2", 2), ("l2", 1)}


def test_custom_export(spark, tmp_path):
    df = sequences(spark)
    writers.export_custom(df, str(tmp_path / "one"), max_length=4)
    assert joined(tmp_path / "one").startswith(">Musc\nAC-T")
    writers.export_custom(df, str(tmp_path / "by"), by_family=True, mark="", two_lines=False, head="h")
    assert {n for n in os.listdir(tmp_path / "by") if "=" in n} == {"family=none", "family=Apidae"}
