"""Queries that lay sequences out in each file format, a hundred sequences a file, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import fresh_path
from ..sources import flatfile, formats, readers, writers
from . import fixtures as X

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


FILE = "concat('f', cast(ord div 100 as string), '.txt')"
NAME = "concat('T_', lpad(cast(ord as string), 8, '0'))"
PLAIN = "translate(seq, '_', '-')"


def _files(spark, d, line: str, head: str = "", foot: str = ""):
    """One text for each hundred of ord; `line` is an SQL expression of ord, title and seq."""
    s = X.sequences(spark, d).select("ord", F.expr(FILE).alias("file"), F.expr(line).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return s.groupBy("file").agg(F.concat(F.lit(head), text, F.lit(foot)).alias("text"))


def _sql(title: str = "'T ' || lpad(ord::VARCHAR, 8, '0')", seq: str = "translate(seq, '_', '-')", more: str = "") -> str:
    return X.sql(f"SELECT 'f' || ord // 100 || '.txt' AS file, row_number() OVER (PARTITION BY ord // 100 ORDER BY ord) - 1 AS ord, {title} AS title, {seq} AS seq{more} FROM s")


@query("parse_fasta", _sql("title"))
def parse_fasta(spark, d):
    return readers.parse_fasta(_files(spark, d, f"concat('>', translate(title, ' ', '_'), '\n', substring({PLAIN}, 1, 40), '\n# note\n', substring({PLAIN}, 41, 40))"))


@query("parse_mega", _sql())
def parse_mega(spark, d):
    return readers.parse_mega(_files(spark, d, f"concat('#', {NAME}, ' ', substring({PLAIN}, 1, 30), ' \"note\" ', '\n#', {NAME}, ' ', substring({PLAIN}, 31, 40))", "#mega\nTITLE x\n\n"))


NEXUS = "#NEXUS\nBEGIN DATA;\n DIMENSIONS NTAX=9 NCHAR=64;\n FORMAT DATATYPE=DNA MISSING=? GAP=- INTERLEAVE;\n MATRIX\n"
SETS = "\n;\nEND;\nBEGIN SETS;\n CHARSET one = 1-16 20;\n CHARSET two = 33-.;\nEND;\nBEGIN CODONS;\n CODONPOSSET * c = 1: 1-61\\3, 2: 2-62\\3, 3: 3-63\\3;\nEND;\n"


def _nexus(spark, d):
    return readers.parse_nexus(_files(spark, d, f"concat({NAME}, ' ', substring({PLAIN}, 1, 30), ' [30:1-30]\n', {NAME}, ' ', substring({PLAIN}, 31, 40))", NEXUS, SETS))


@query("parse_nexus", _sql())
def parse_nexus(spark, d):
    return _nexus(spark, d)[0]


def _written(spark, d, write, rows, name: str) -> str:
    """The folder that a writer made of rows; its parts are one file."""
    path = f"{fresh_path(spark, name)}/whole"
    write(rows, path)
    return path


@query("own_format", X.sql("SELECT title, translate(seq, '_', '-') AS seq FROM s"))
def own_format(spark, d):
    """A user's own format, registered, written through its commit and read again."""
    formats.register(spark, formats.Tabbed())
    path = f"{fresh_path(spark, 'own')}/files"
    X.sequences(spark, d).select("title", F.translate("seq", "_", "-").alias("seq")).write.format("tabbed").mode("append").save(path)
    return spark.read.format("tabbed").load(path).select("title", "seq")


@query("scan_nexus", X.sql("SELECT 'whole' AS file, ord, replace(left(regexp_replace(title, '[^\\w.]+', '_', 'g'), 32), '_', ' ') AS title, translate(seq, '_', '-') AS seq FROM s"))
def scan_nexus(spark, d):
    """One interleaved file in parts, read by as many tasks; a taxon's lines lie in many of them."""
    return readers.read_nexus(spark, _written(spark, d, lambda s, p: writers.write_nexus(s, p, 10), X.sequences(spark, d), "nexus"), True)[0]


@query("scan_tnt", X.sql("SELECT 'whole' AS file, ord, regexp_replace(regexp_replace(title, '[^\\w.]+', '_', 'g'), '_', ' ', 'g') AS title, translate(seq, '_', '-') AS seq FROM s"))
def scan_tnt(spark, d):
    return readers.read_tnt(spark, _written(spark, d, writers.write_tnt, X.sequences(spark, d), "tnt"), True)[0]


@query("scan_mega", X.sql("SELECT 'whole' AS file, row_number() OVER (ORDER BY title) - 1 AS ord, title, seq FROM (SELECT replace(left(regexp_replace(replace(title, ' ', '_'), '[^\\w.+*-]', '_', 'g'), 40), '_', ' ') AS title, translate(seq, '_', '-') AS seq FROM s)"))
def scan_mega(spark, d):
    return readers.read_mega(spark, _written(spark, d, writers.write_mega, X.sequences(spark, d), "mega"), True)


ODD = "\nBEGIN SETS;\n CHARSET a (VECTOR) = 0101;\n CHARSET b = ALL;\n CHARSET c = REMAINDER;\n CHARSET d = 3-9;\nEND;\n"


def _odd(spark, d):
    kind = F.expr("if(cast(substring(file, 2, length(file) - 5) as int) % 2 = 0, replace(text, 'DATATYPE=DNA', 'DATATYPE=Continuous'), text)")
    return _files(spark, d, f"concat({NAME}, ' ', {PLAIN})", NEXUS, "\n;\nEND;" + ODD).withColumn("text", kind)


@query("nexus_problems", X.sql("SELECT DISTINCT 'f' || ord // 100 || '.txt' AS file, v.* FROM s, (VALUES ('character set', 'CHARSET a (VECTOR) = 0101'), ('character set', 'CHARSET b = ALL'), ('character set', 'CHARSET c = REMAINDER')) v(problem, what) UNION ALL SELECT DISTINCT 'f' || ord // 100 || '.txt', 'continuous data', '' FROM s WHERE (ord // 100) % 2 = 0"))
def nexus_problems(spark, d):
    return readers.nexus_problems(_odd(spark, d))


@query("nexus_without_problems", X.sql("SELECT 'f' || ord // 100 || '.txt' AS file, count(*) AS sequences, 'd' AS sets FROM s WHERE (ord // 100) % 2 = 1 GROUP BY ALL"))
def nexus_without_problems(spark, d):
    sequences, sets = readers.parse_nexus(_odd(spark, d))
    names = sets.groupBy(F.concat("source", F.lit(".txt")).alias("file")).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("sets"))
    return sequences.groupBy("file").agg(F.count(F.lit(1)).alias("sequences")).join(names, "file")


@query("parse_charsets", X.sql("SELECT DISTINCT 'f' || ord // 100 AS source, v.* FROM s, (VALUES ('one', NULL, 1, 16, 1), ('one', NULL, 20, 20, 1), ('two', NULL, 33, 64, 1), ('codons', 1, 1, 61, 3), ('codons', 2, 2, 62, 3), ('codons', 3, 3, 63, 3)) v(name, pos, \"from\", \"to\", stride)"))
def parse_charsets(spark, d):
    return _nexus(spark, d)[1]


def _tnt(spark, d):
    return readers.parse_tnt(_files(spark, d, f"concat({NAME}, ' ', {PLAIN})", "nstates dna;\nxread\n'a title'\n64 1\n", "\n;\nxgroup\n=0 (one) 0.15 19\n=1 (two_pos2) 33. \n;\nproc /;"))


@query("parse_tnt", _sql())
def parse_tnt(spark, d):
    return _tnt(spark, d)[0]


@query("tnt_groups", X.sql("SELECT DISTINCT 'f' || ord // 100 AS source, v.* FROM s, (VALUES ('one', NULL, 1, 16, 1), ('one', NULL, 20, 20, 1), ('two', 2, 34, 64, 1)) v(name, pos, \"from\", \"to\", stride)"))
def tnt_groups(spark, d):
    return _tnt(spark, d)[1]


@query("tnt_problems", X.sql("SELECT 'f' || ord // 100 || '.txt' AS file, 64 AS nchar, 1 AS ntax, count(*) AS taxa, 64 AS shortest, 64 AS longest FROM s GROUP BY ord // 100 HAVING count(*) <> 1"))
def tnt_problems(spark, d):
    return _tnt(spark, d)[2]


@query("parse_sequences", _sql("title", more=", 'l' || ord % 3 AS locus_override, CASE WHEN ord % 2 = 0 THEN species END AS taxon_override, ord % 7 = 0 AS cancelled"))
def parse_sequences(spark, d):
    return readers.parse_sequences(_files(spark, d, f"concat('>', title, '\n^grid.colname l', cast(ord % 3 as string), if(ord % 2 = 0, concat('\n^grid.seqname ', coalesce(species, '')), ''), if(ord % 7 = 0, '\n^grid.cancelled', ''), '\n', {PLAIN})", "#sequences\n"))


@query("parse_any_format", X.sql("SELECT v.letter || ord // 100 || '.txt' AS file, v.format, count(*) AS n FROM s, (VALUES ('f', 'nexus'), ('g', 'fasta'), ('m', 'mega'), ('t', 'tnt'), ('q', 'sequences')) v(letter, format) GROUP BY ALL"))
def parse_any_format(spark, d):
    line = f"concat({NAME}, ' ', {PLAIN})"
    texts = {
        "f": _files(spark, d, line, NEXUS, SETS), "g": _files(spark, d, f"concat('>', title, '\n', {PLAIN})"), "m": _files(spark, d, f"concat('#', {NAME}, ' ', {PLAIN})", "#mega\nTITLE x\n\n"),
        "t": _files(spark, d, line, "xread\n'x'\n64 9\n", "\n;\nproc /;"), "q": _files(spark, d, f"concat('>', title, '\n', {PLAIN})", "#sequences\n"),
    }
    every = None
    for letter, df in texts.items():
        df = df.withColumn("file", F.translate("file", "f", letter))
        every = df if every is None else every.unionByName(df)
    return readers.parse_any(every).groupBy("file", "format").agg(F.count(F.lit(1)).alias("n"))


@query("fasta_lines", X.sql("SELECT ord, '>' || replace(title, ' ', '_') || chr(10) || translate(seq, '_', '-') AS line FROM s"))
def fasta_lines(spark, d):
    return writers.fasta_lines(X.sequences(spark, d))


@query("alignment_lines", X.sql("SELECT ord, '>seq' || gi || chr(10) || translate(seq, '_', '-') AS line FROM s"))
def alignment_lines(spark, d):
    return writers.export_for_alignment(X.sequences(spark, d))


#: Names of ten sequences each, of which some look like the numbered names of others; cut to 12 characters.
_BASE = "substr(translate(coalesce(species, 'none'), ' ', '_'), 1, 9) || CASE WHEN ord % 4 = 1 THEN '_2' WHEN ord % 9 = 2 THEN '_3' WHEN ord % 10 = 7 THEN '_2_2' ELSE '' END"


def greedy(base: str, most: int, root: str) -> str:
    """Name after name in list order, by recursion over the rows of a family; the names given so far come along."""
    cut = f"substr(b, 1, {most} - length(n::VARCHAR) - 1)"
    return f"""b0 AS MATERIALIZED (SELECT ord, substr({base}, 1, {most}) AS b FROM s), fam AS MATERIALIZED (SELECT *, {root} AS root FROM b0),
line AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ord) AS i FROM fam),
go AS (SELECT root, i, ord, b AS name, [b] AS taken FROM line WHERE i = 1
  UNION ALL SELECT root, i, ord, name, list_append(taken, name) FROM (SELECT l.root, l.i, l.ord, g.taken, CASE WHEN NOT list_contains(g.taken, l.b) THEN l.b ELSE list_filter(list_transform(range(2, l.i + 2), lambda n: {cut.replace('b,', 'l.b,')} || '_' || n), lambda x: NOT list_contains(g.taken, x))[1] END AS name
    FROM go g JOIN line l ON l.root = g.root AND l.i = g.i + 1))"""


@query("unique_names", X.sql("SELECT ord, name FROM go", greedy(_BASE, 14, "CASE WHEN b LIKE 'none%' THEN 'none' ELSE substr(b, 1, 8) END")).replace("WITH", "WITH RECURSIVE", 1))
def unique_names(spark, d):
    return writers.unique_names(X.sequences(spark, d), F.expr(_BASE), 14).select("ord", "name")


@query("parse_nexus_symbols", _sql())
def parse_nexus_symbols(spark, d):
    """Files that write gaps and missing characters the other way round, or by other signs."""
    three = "translate(translate(seq, '_', '-'), '-?', if((ord div 100) % 3 = 1, '?-', if((ord div 100) % 3 = 2, '.!', '-?')))"
    files = _files(spark, d, f"concat({NAME}, ' ', {three})", NEXUS, SETS)
    kind = F.pmod(F.regexp_extract("file", r"(\d+)", 1).cast("int"), F.lit(3))
    text = F.when(kind == 1, F.replace("text", F.lit("MISSING=? GAP=-"), F.lit("MISSING=- GAP=?"))).when(kind == 2, F.replace("text", F.lit("MISSING=? GAP=-"), F.lit("GAP=. MISSING=!"))).otherwise(F.col("text"))
    return readers.parse_nexus(files.withColumn("text", text))[0]


@query("restore_titles", X.sql("SELECT ord, title FROM s"))
def restore_titles(spark, d):
    s = X.sequences(spark, d)
    return flatfile.restore_titles(s.select("ord", F.concat(F.lit("seq"), "gi").alias("title")), s.select("title"))[0]


FLAT = """concat('LOCUS       L', cast(ord as string), '\n', 'DEFINITION  ', title, '\n', 'ACCESSION   L', cast(ord as string), '\n', 'VERSION     L.1  GI:', gi, '\n', 'FEATURES             Location/Qualifiers\n',
 '     gene            3..20\n                     /gene="g', cast(ord % 4 as string), '"\n', '     CDS             complement(11..25)\n                     /product="p', cast(ord % 3 as string), '"\n', '     misc            join(1..4,31..40)\n',
 'ORIGIN\n        1 ', translate(lower(substring(seq, 1, 20)), '_?', '--'), ' ', translate(lower(substring(seq, 21, 44)), '_?', '--'), '\n//')"""


def _loci(spark, d):
    s = X.sequences(spark, d).select("ord", F.concat(F.lit("r"), F.col("ord").cast("string")).alias("file"), F.expr(FLAT).alias("text"))
    return flatfile.parse_flatfile(s.select("file", "text"))


@query("parse_flat_file", X.sql("SELECT 'r' || ord AS file, title AS name, 'L' || ord AS accession, gi, translate(seq, '_?', '--') AS origin FROM s"))
def parse_flat_file(spark, d):
    return _loci(spark, d).select("file", "name", "accession", "gi", "origin")


@query("scan_flat_file", X.sql("SELECT 'whole' AS file, row_number() OVER (ORDER BY 'r' || ord) - 1 AS locus_id, title AS name, 'L' || ord AS accession, gi, translate(seq, '_?', '--') AS origin FROM s"))
def scan_flat_file(spark, d):
    """All records in one file of many parts, numbered through it."""
    path = _written(spark, d, writers.write_flatfile, _loci(spark, d), "flat")
    return flatfile.read_flatfile(spark, path, True).select("file", "locus_id", "name", "accession", "gi", "origin")


@query("feature_groups", X.sql("SELECT gene, count(*) AS features FROM (SELECT 'gene g' || ord % 4 || '-gene' AS gene FROM s UNION ALL SELECT 'product p' || ord % 3 || '-CDS' FROM s UNION ALL SELECT 'misc' FROM s) GROUP BY gene"))
def feature_groups(spark, d):
    return flatfile.features_by_gene(flatfile.explode_features(_loci(spark, d))).groupBy("gene").agg(F.count(F.lit(1)).alias("features"))


@query("extract_features", X.sql("""SELECT 'r' || ord AS file, f.feature, CASE f.feature WHEN 'gene' THEN substr(o, 3, 18) WHEN 'CDS' THEN reverse(translate(substr(o, 11, 15), 'ACGTRN', 'TGCAYN')) ELSE substr(o, 1, 4) || substr(o, 31, 10) END AS seq
  FROM (SELECT ord, translate(seq, '_?', '--') AS o FROM s), (VALUES ('gene'), ('CDS'), ('misc')) f(feature)"""))
def extract_features(spark, d):
    loci = _loci(spark, d)
    return flatfile.extract_features(flatfile.explode_features(loci), loci).select("file", "feature", "seq")


@query("features_intersect", X.sql("SELECT 'r' || ord AS file, v.* FROM s, (VALUES (0, 1), (0, 2)) v(a, b)"))
def features_intersect(spark, d):
    return flatfile.features_intersect(flatfile.explode_features(_loci(spark, d))).select("file", "a", "b")


#: Intervals of one chromosome: of every sequence one that begins at its number, of many lengths.
_SPANS = "SELECT 'chr' AS file, 0::BIGINT AS locus_id, ord AS feature_id, ord * 3 % 1009 + 1 AS f, ord * 3 % 1009 + 1 + (ord * ord) % 7 + CASE WHEN ord % 50 = 0 THEN 300 WHEN ord % 211 = 5 THEN 5000 ELSE 0 END AS t FROM s"


@query("intervals_of_one_locus", X.sql(f"SELECT x.file, x.locus_id, x.feature_id AS a, y.feature_id AS b FROM ({_SPANS}) x JOIN ({_SPANS}) y ON x.feature_id < y.feature_id AND x.f <= y.t AND y.f <= x.t"))
def intervals_of_one_locus(spark, d):
    ends = F.expr("ord * 3 % 1009 + 1"), F.expr("ord * 3 % 1009 + 1 + (ord * ord) % 7 + case when ord % 50 = 0 then 300 when ord % 211 = 5 then 5000 else 0 end")
    rows = X.sequences(spark, d).select(F.lit("chr").alias("file"), F.lit(0).cast("long").alias("locus_id"), F.col("ord").alias("feature_id"), F.array(F.struct(ends[0].alias("from"), ends[1].alias("to"))).alias("location"))
    return flatfile.features_intersect(rows)


@query("list_sections", X.sql("SELECT section, count(*) AS n FROM s, (VALUES ('LOCUS'), ('DEFINITION'), ('ACCESSION'), ('VERSION'), ('FEATURES'), ('ORIGIN')) v(section) GROUP BY section"))
def list_sections(spark, d):
    return flatfile.list_sections(_loci(spark, d)).groupBy("section").agg(F.count(F.lit(1)).alias("n"))
