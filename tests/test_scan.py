"""Files read by many tasks against parsers of whole texts."""

import random

import pytest

from specimen_spark.sources import flatfile, readers, writers

NEXUS = """#NEXUS [a comment
over lines BEGIN DATA; matrix]
BEGIN TAXA; DIMENSIONS NTAX=3; TAXLABELS data matrix begin;
END;
begin
 characters [inside] ;
 DIMENSIONS NTAX=3 NCHAR=40; FORMAT DATATYPE=DNA
 MISSING=- GAP=. INTERLEAVE;
 MATRIX Musca_prima ACGT [one
 two; END;
 three] ..--
Apis_secunda (AG)CGTACGT [4]

'begin it' AC[x]GT[y]ACGT
%s
;
END;
BEGIN SETS; CHARSET one = 1-3 [c] 5; CHARSET two = 4-.;
END;
BEGIN DATA; MATRIX late ACGT
;
END;
"""
TNT = """nstates dna;
xread
'a title; xread 5 5
 more'
40 3
one ACGT[AG]
two ACGTR
&%%[dna]
%s
three ACG; xgroup =0 (one) 0.3 7 ;
proc /;
"""
MEGA = """#mega
TITLE a title # no name
"a #comment
over lines"
#one ACGT "x" AC
 GT
#two AC"
#three no
"GT
%s
#one TTTT
"""
FLAT = "".join(f"""LOCUS       L{i}
DEFINITION  name {i}
            goes on
ACCESSION   A{i}
FEATURES             Location/Qualifiers
     gene            3..{i + 4}
                     /gene="g{i}"
ORIGIN
        1 acgtacgtac gtacgtacgt
//
""" for i in range(40)) + "\n"


def filler(seed, line):
    rng = random.Random(seed)
    return "\n".join(line(i % 17, "".join(rng.choices("ACGT", k=rng.randint(1, 30)))) for i in range(60))


def put(folder, name, text):
    (folder / name).write_text(text)
    return {"file": name, "text": text}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [900, 1 << 20])
def test_each_format_in_splits_of_any_size(spark, tmp_path, small_splits, size):
    texts = [put(tmp_path, f"{i}.nex", NEXUS % filler(i, lambda k, s: f"t{k} [{k}] {s}" if k % 3 else f"t{k} {s[:3]}[a\nb] {s}")) for i in range(2)]
    files = spark.createDataFrame(texts)
    small_splits(size)
    for got, want in zip(readers.read_nexus(spark, str(tmp_path)), readers.parse_nexus(files), strict=True):
        assert rows(got.select(*want.columns)) == rows(want) and want.count() > 2

    tnt, mega, flat = (tmp_path / x for x in ("tnt", "mega", "flat"))
    for folder in (tnt, mega, flat):
        folder.mkdir()
    files = spark.createDataFrame([put(tnt, f"{i}.tnt", TNT % filler(i, lambda k, s: f"t{k} {s}")) for i in range(2)])
    for got, want in zip(readers.read_tnt(spark, str(tnt)), readers.parse_tnt(files), strict=True):
        assert rows(got.select(*want.columns)) == rows(want) and want.count() > 1
    files = spark.createDataFrame([put(mega, f"{i}.meg", MEGA % filler(i, lambda k, s: f'#t{k} {s} "no\n#te" {s}\n {s}')) for i in range(2)])
    want = readers.parse_mega(files)
    assert rows(readers.read_mega(spark, str(mega)).select(*want.columns)) == rows(want) and want.count() > 20
    files = spark.createDataFrame([put(flat, f"{i}.gb", FLAT) for i in range(2)])
    want = flatfile.parse_flatfile(files)
    got = flatfile.read_flatfile(spark, str(flat))
    columns = ["file", "locus_id", "name", "accession", "origin", "sections"]
    assert rows(got.select(*columns)) == rows(want.select(*columns)) and want.count() == 80


def test_splits_beyond_the_broadcast(spark, tmp_path, small_splits, monkeypatch):
    from specimen_spark.sources import scan

    monkeypatch.setattr(scan, "BROADCAST_SPLITS", 0)
    monkeypatch.setattr(readers, "BROADCAST_SPLITS", 0)
    files = spark.createDataFrame([put(tmp_path, "a.nex", NEXUS % filler(3, lambda k, s: f"t{k} {s}"))])
    small_splits(900)
    assert rows(readers.read_nexus(spark, str(tmp_path))[0]) == rows(readers.parse_nexus(files)[0])


def test_any_format_is_told_by_its_first_line(spark, tmp_path, small_splits):
    texts = [put(tmp_path, "a.nex", NEXUS % ""), put(tmp_path, "b.tnt", TNT % ""), put(tmp_path, "c.meg", MEGA % ""), put(tmp_path, "d.fas", "\n>x y\nACGT\n>z\nAC\n"), put(tmp_path, "e.seq", "#sequences\n\n>x\n^g.colname l\n^g.cancelled\nACGT\n\n>y\nACG\n"), put(tmp_path, "f.txt", "other\n")]
    small_splits(500)
    want = readers.parse_any(spark.createDataFrame(texts))
    assert rows(readers.read_any(spark, str(tmp_path)).select(*want.columns)) == rows(want)


def test_parts_of_a_writer_are_one_file(spark, tmp_path):
    df = spark.createDataFrame([(i, f"Musca s{i}", "".join(random.Random(i).choices("ACGT-?", k=200))) for i in range(60)], "ord long, title string, seq string").repartition(4)
    want = sorted((i, f"Musca s{i}") for i in range(60))
    for write, read in ((writers.write_nexus, lambda s, p: readers.read_nexus(s, p, True)[0]), (writers.write_tnt, lambda s, p: readers.read_tnt(s, p, True)[0])):
        path = str(tmp_path / write.__name__)
        write(df, path)
        got = read(spark, path)
        assert sorted((r["ord"], r["title"]) for r in got.collect()) == want and {r["file"] for r in got.collect()} == {write.__name__}
        assert rows(got.select("ord", "seq")) == rows(df.select("ord", "seq"))


def test_intermediates_are_dropped_by_session(spark, tmp_path):
    from specimen_spark.operators import storage

    storage.drop_intermediates(spark)
    other = spark.newSession()
    mine, its = storage.store(spark.range(5)), storage.store(other.range(7))
    path = mine.inputFiles()[0]
    assert mine.count() == 5 and storage.drop_intermediates(spark) == 1
    assert not storage.hadoop_path(spark, path)[0].exists(storage.hadoop_path(spark, path)[1])
    assert its.count() == 7 and storage.drop_intermediates(other) == 1 and storage.drop_intermediates(other) == 0
