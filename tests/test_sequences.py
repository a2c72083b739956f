"""Unit facts on titles, sequences, distances and lists."""

import pytest
from pyspark.sql import functions as F

from specimen_spark.functions import sequences as S
from specimen_spark.operators import charsets, consensus, grid, lists, pairs


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "s string").select(f(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize("title,genus,epithet,sub,gi,family,warning", [
    ("gi|12| Musca domestica", "Musca", "domestica", None, "12", None, False),
    ("Musca domestica nova (family: Muscidae)", "Musca", "domestica", "nova", None, "Muscidae", False),
    ("Musca sp.x", "Musca", "sp", None, None, None, False),
    ("nothing here", None, None, None, None, None, True),
    ("gi|7:1-20 ABC", None, None, None, "7", None, True),
    ("", None, None, None, None, None, True),
])
def test_titles(spark, title, genus, epithet, sub, gi, family, warning):
    r = S.parse_titles(spark.createDataFrame([(title,)], "title string")).first()
    assert (r["genus"], r["species_epithet"], r["subspecies"], r["gi"], r["family"], r["warning"]) == (genus, epithet, sub, gi, family, warning)


@pytest.mark.parametrize("n,want", [(5, "T rex"), (9, "Tyran rex"), (50, "Tyrannosaurus rex"), (1, "T"), (2, "Tr"), (3, "T r"), (0, "")])
def test_short_names(spark, n, want):
    assert S.parse_titles(spark.createDataFrame([("Tyrannosaurus rex",)], "title string")).select(S.short_name(n)).first()[0] == want


@pytest.mark.parametrize("raw,want", [
    ("--AC-GT?-", "__AC-GT?_"), ("[AG]c(ct)t", "RCYT"), ("????", "????"), ("----", "____"), ("ACU", None), ("AC_", None), ("a c\ng", "ACG"), ("", ""), ("[ACTG]A", "NA"),
])
def test_normalise(spark, raw, want):
    assert one(spark, raw, S.normalise) == want


def test_profile(spark):
    seq = S.mark_external(F.col("s"))
    r = S.profile(spark.createDataFrame([("----ACTG?WRKYSMBHDVN----????",)], "s string").select(seq.alias("seq"))).first()
    assert (r["length"], r["actual_length"], r["ambiguous"], r["first_real"], r["last_real"]) == (28, 15, 11, 4, 19)


def test_subsequence_and_complement(spark):
    assert one(spark, "AAATTTCCCGGG", lambda s: S.subsequence(s, 1, 10)) == "AAATTTCCCG"
    assert one(spark, "AAATTT-CCGGG", lambda s: S.subsequence(s, 1, 8)) == "AAATTT-C"
    assert one(spark, "AACG", lambda s: S.subsequence(s, 4, 1)) == "CGTT"
    assert one(spark, "AACG", lambda s: S.subsequence(s, 1, 5)) is None
    assert one(spark, "ACTG-RYKM-SW-BDHV-N", lambda s: S.complement(s, "legacy")) == "TGAC-YRMK-WS-ACGT-N"
    assert one(spark, "RN-", lambda s: S.expand_ambiguity(s)) == "[AG][ACTG]-"


def _pairs(spark, a, b, method, least=1):
    rows = spark.createDataFrame([(0, "x", a, "A b", "A", "b"), (1, "y", b, "A b", "A", "b")], "ord long, title string, seq string, species string, genus string, species_epithet string")
    rows = rows.withColumn("seq", S.mark_external(F.col("seq")))
    return pairs.pair_distances(rows, method, least).first()


def test_distances(spark):
    r = _pairs(spark, "--ATCCCTGGTA", "ACCGCCCT--CG", "transversions")
    assert (r["overlap"], r["dist"]) == (10, 0.2)
    r = _pairs(spark, "A" * 25 + "-" * 77, "-" * 10 + "AAAAATTTTT" + "?????" + "-" * 77, "uncorrected")
    assert (r["overlap"], r["dist"]) == (10, 0.5)
    assert _pairs(spark, "ACGT", "----", "uncorrected") is None


def test_planes_cover_long_sequences(spark):
    a, b = "ACGT" * 50, "ACGA" * 50
    r = _pairs(spark, a, b, "uncorrected")
    assert (r["overlap"], r["dist"]) == (200, 0.25)


def test_consensus_and_barcodes(spark):
    df = spark.createDataFrame([("g", 0, "AC-_"), ("g", 1, "GC--"), ("h", 2, "A?"), ("h", 3, "A")], "species string, ord long, seq string")
    got = {r["species"]: r["consensus"] for r in consensus.consensus(df, "species").collect()}
    assert got == {"g": "RC--", "h": "A?"}
    got = {r["species"]: r["barcode"] for r in consensus.barcodes(df, 2).collect()}
    assert got["g"] == "-C-" + "-" and got["h"][0] == "A"


def test_lists(spark):
    df = spark.createDataFrame([(0, "A b"), (1, None), (2, "A b"), (3, "C d")], "ord long, species string")
    kept, counts = lists.filter_species(df, ["a B", "x y"])
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2]
    assert {r["name"]: r["n"] for r in counts.collect()} == {"a B": 2, "x y": 0}
    assert sorted(r["ord"] for r in lists.filter_multi(df).collect()) == [0, 2]
    assert sorted(r["ord"] for r in lists.drop_species(df, "A b").collect()) == [1, 3]
    one = lists.sample_specimens(df, 2, 3, 5)
    assert one.count() == 6 and sorted(map(tuple, one.collect())) == sorted(map(tuple, lists.sample_specimens(df, 2, 3, 5).collect()))


def test_add_and_rename(spark):
    g = spark.createDataFrame([("l", "t", 0, "ACGT", 4, False)], "locus string, taxon string, ord long, seq string, actual_length int, cancelled boolean")
    new = spark.createDataFrame([("t", 1, "AC-T"), ("t", 2, "AC?T"), ("u", 3, "ACG"), ("v", 4, "????")], "taxon string, ord long, seq string")
    out, refused = grid.add_to_grid(g, new, "l")
    assert [(r["taxon"], r["ord"]) for r in out.collect()] == [("t", 1)]
    assert [r["taxon"] for r in refused.collect()] == ["u"]
    two = g.unionByName(g.select("locus", F.lit("u").alias("taxon"), F.lit(9).cast("long").alias("ord"), "seq", "actual_length", "cancelled"))
    renamed, lost = grid.rename_taxa(two, spark.createDataFrame([("u", "t")], "taxon string, new_taxon string"))
    assert [(r["taxon"], r["ord"]) for r in renamed.collect()] == [("t", 0)] and lost.count() == 1


def test_intervals(spark):
    iv = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 9, 9)], "name string, from int, to int")
    assert sorted((r["from"], r["to"]) for r in charsets.combine_intervals(iv).collect()) == [(1, 6), (9, 9)]


@pytest.mark.parametrize("method", ["uncorrected", "k2p", "transversions"])
@pytest.mark.parametrize("scope", ["all", "intra", "inter_congeneric"])
def test_numpy_tiles_equal_columns(spark, method, scope, monkeypatch):
    from specimen_spark.operators import pairs
    from specimen_spark.plans import fixtures

    seqs = fixtures.ragged(lambda s, d: fixtures.sequences(s, d))(spark, "/root/testdata/sf0.001").where("ord < 60").persist()
    got = []
    for words in (0, 99):
        monkeypatch.setattr(pairs, "COLUMN_WORDS", words)
        rows = pairs.pair_distances(seqs, method, 30, scope, blocks=3, valid_only=False).collect()
        got.append(sorted((r["a"], r["b"], r["species_a"], r["species_b"], r["genus_a"], r["genus_b"], r["overlap"], None if r["dist"] is None else round(r["dist"], 12), r["bucket"]) for r in rows))
    assert got[0] == got[1] and got[0]


def test_blocks_follow_the_rows(spark, monkeypatch):
    from specimen_spark.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK_ROWS", 10)
    assert pairs.blocks_for(spark.range(1000)) == 100
