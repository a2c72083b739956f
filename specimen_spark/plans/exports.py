"""Queries on what the writers put into files: lines with their sort keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs
from ..sources import flatfile, readers, writers
from . import fixtures as X
from .files import FLAT, NAME, NEXUS, PLAIN, SETS, _files, _loci, greedy

QUERIES, ORACLE_SQL = {}, {}
NL = "chr(10)"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


T = "t AS MATERIALIZED (SELECT *, translate(seq, '_', '-') AS t FROM s)"
#: The concatenation of the live cells, by taxon.
MATRIX = """cc AS MATERIALIZED (SELECT row_number() OVER (ORDER BY taxon) AS ord, taxon, regexp_replace(taxon, '[^\\w.]+', '_', 'g') AS name, translate(seq, '_', '-') AS t FROM (
  SELECT taxon, string_agg(coalesce(seq, repeat('?', 16)), '' ORDER BY locus) AS seq FROM (SELECT DISTINCT taxon FROM g WHERE NOT cancelled) CROSS JOIN (SELECT DISTINCT locus FROM g) LEFT JOIN (SELECT * FROM g WHERE NOT cancelled) USING (locus, taxon) GROUP BY taxon)),
lo AS MATERIALIZED (SELECT locus, row_number() OVER (ORDER BY locus) - 1 AS k FROM (SELECT DISTINCT locus FROM g WHERE NOT cancelled)),
ts AS MATERIALIZED (SELECT taxonset, string_agg((ord)::VARCHAR, ' ' ORDER BY ord) AS ks, string_agg((ord - 1)::VARCHAR, ' ' ORDER BY ord) AS k0 FROM (SELECT 'CHARSETS_ATLEAST_' || k AS taxonset, taxon FROM (SELECT taxon, count(*) AS n FROM g WHERE NOT cancelled GROUP BY 1), (VALUES (8), (7), (6), (5), (4), (3), (2)) v(k) WHERE n >= k
  UNION ALL SELECT 'TAXA_HAVING_' || locus, taxon FROM g WHERE NOT cancelled) JOIN cc USING (taxon) GROUP BY taxonset)"""


@query("mega_lines", X.sql(f"SELECT ord, '#' || left(regexp_replace(replace(title, ' ', '_'), '[^\\w.+*-]', '_', 'g'), 40) || chr(9) || t AS line FROM t UNION ALL SELECT -1, '#MEGA' || {NL} || 'TITLE sequences' || {NL}", T))
def mega_lines(spark, d):
    return writers.mega_lines(X.sequences(spark, d))


@query("nexus_lines", X.sql(f"""SELECT b AS block, ord, rpad(left(regexp_replace(title, '[^\\w.]+', '_', 'g'), 32), 33, ' ') || substr(t, b * 40 + 1, 40) || ' [' || least(40, 64 - b * 40) || ':' || b * 40 + 1 || '-' || least(64, b * 40 + 40) || ']' AS line FROM t, range(2) r(b)
  UNION ALL SELECT -1, 0, '#NEXUS' || {NL} || {NL} || 'BEGIN DATA;' || {NL} || chr(9) || 'DIMENSIONS NTAX=' || (SELECT count(*) FROM s) || ' NCHAR=64;' || {NL} || chr(9) || 'FORMAT DATATYPE=DNA MISSING=? GAP=- INTERLEAVE;' || {NL} || chr(9) || 'MATRIX'
  UNION ALL SELECT 1099511627776, 0, {NL} || ';' || {NL} || {NL} || 'END;'""", T))
def nexus_lines(spark, d):
    return writers.nexus_lines(X.sequences(spark, d), 40)


def _head(flag: str) -> str:
    return f"""SELECT -1 AS block, 0 AS ord, '#NEXUS' || {NL} || {NL} || 'BEGIN DATA;' || {NL} || chr(9) || 'DIMENSIONS NTAX=' || (SELECT count(*) FROM cc) || ' NCHAR=64;' || {NL} || chr(9) || 'FORMAT DATATYPE=DNA MISSING=? GAP=-{flag};' || {NL} || chr(9) || 'MATRIX' AS line
  UNION ALL SELECT 1099511627776, 0, {NL} || ';' || {NL} || {NL} || 'END;'"""


_SETS = f"""SELECT 4398046511104, row_number() OVER (ORDER BY kind, line), line FROM (SELECT 1 AS kind, chr(9) || 'TAXSET ' || taxonset || ' = ' || ks || ';' AS line FROM ts UNION ALL SELECT 2, chr(9) || 'CHARSET ' || locus || ' = ' || k * 16 + 1 || '-' || k * 16 + 16 || ';' FROM lo)
  UNION ALL SELECT 4398046511104, -1, {NL} || 'BEGIN SETS;' UNION ALL SELECT 4398046511104, 1099511627776, 'END;'"""
_CODONS = f"""SELECT 2199023255552, p + 1, chr(9) || chr(9) || p || ': ' || string_agg(k * 16 + p || '-' || k * 16 + 12 + p || '\\3', ' ' ORDER BY k) || CASE WHEN p < 3 THEN ',' ELSE '' END FROM lo, range(1, 4) r(p) GROUP BY p
  UNION ALL SELECT 2199023255552, 0, 'BEGIN CODONS;' || {NL} || chr(9) || 'CODONPOSSET * CodonPositions =' UNION ALL SELECT 2199023255552, 9, chr(9) || ';' || {NL} || 'END;' || {NL}
  UNION ALL SELECT 8796093022208, row_number() OVER (ORDER BY locus, p), chr(9) || 'CHARSET ' || locus || '_pos' || p || ' = ' || k * 16 + p || '-' || k * 16 + 12 + p || '\\3;' FROM lo, range(1, 4) r(p)
  UNION ALL SELECT 8796093022208, 0, {NL} || 'BEGIN ASSUMPTIONS;' UNION ALL SELECT 8796093022208, 1099511627776, 'END;'"""


def _positions(g):
    """Codon tracks of each locus in two parts, which follow each other by three."""
    parts = F.expr("explode(flatten(transform(array(1, 2, 3), p -> array(named_struct('pos', p, 'from', p, 'to', p + 6), named_struct('pos', p, 'from', p + 9, 'to', p + 12)))))")
    return g.select("locus").distinct().select("locus", parts.alias("x")).select("locus", "x.*")


@query("supermatrix_nexus_lines", X.sql(f"{_head('')} UNION ALL SELECT 0, ord, rpad(name, 33, ' ') || t FROM cc UNION ALL {_SETS} UNION ALL {_CODONS}", X.SQL_GRID, MATRIX))
def supermatrix_nexus_lines(spark, d):
    g = X.grid(spark, d)
    return writers.supermatrix_nexus_lines(g, allow_cancelled=True, positions=_positions(g))


@query("supermatrix_blocks_lines", X.sql(f"{_head(' INTERLEAVE')} UNION ALL SELECT k + 1, ord, rpad(name, 33, ' ') || substr(t, (k * 16 + 1)::INTEGER, 16) || ' [' || locus || ']' FROM cc, lo UNION ALL {_SETS}", X.SQL_GRID, MATRIX))
def supermatrix_blocks_lines(spark, d):
    return writers.supermatrix_nexus_lines(X.grid(spark, d), "blocks", allow_cancelled=True)


@query("supermatrix_tnt_lines", X.sql(f"""SELECT 0 AS block, ord, name || ' ' || t AS line FROM cc UNION ALL SELECT -9, 0, 'nstates dna;' || {NL} || 'xread' || {NL} || '''concatenation' UNION ALL SELECT -1, 0, '''' || {NL} || '64 ' || (SELECT count(*) FROM cc) UNION ALL SELECT 1099511627776, 0, ';' UNION ALL SELECT 8796093022208, 0, 'proc /;'
  UNION ALL SELECT 2199023255552, k, '=' || k || ' (' || locus || ') ' || k * 16 || '.' || k * 16 + 15 FROM lo UNION ALL SELECT 2199023255552, -1, 'xgroup' UNION ALL SELECT 2199023255552, 1099511627776, ';'
  UNION ALL SELECT 2199023255553, r, '=' || r || ' (' || taxonset || ') ' || k0 FROM (SELECT *, row_number() OVER (ORDER BY taxonset) - 1 AS r FROM ts) UNION ALL SELECT 2199023255553, -1, 'agroup' UNION ALL SELECT 2199023255553, 1099511627776, ';'""", X.SQL_GRID, MATRIX))
def supermatrix_tnt_lines(spark, d):
    return writers.supermatrix_tnt_lines(X.grid(spark, d), allow_cancelled=True)


@query("supermatrix_tnt_codons", X.sql(f"""SELECT 0 AS block, ord, name || ' ' || t AS line FROM cc UNION ALL SELECT -9, 0, 'nstates dna;' || {NL} || 'xread' || {NL} || '''concatenation' UNION ALL SELECT -1, 0, '''' || {NL} || '64 ' || (SELECT count(*) FROM cc) UNION ALL SELECT 1099511627776, 0, ';' UNION ALL SELECT 8796093022208, 0, 'proc /;'
  UNION ALL SELECT 2199023255552, k + 3 * (SELECT count(*) FROM lo), '=' || k + 3 * (SELECT count(*) FROM lo) || ' (' || locus || ') ' || k * 16 || '.' || k * 16 + 15 FROM lo UNION ALL SELECT 2199023255552, k * 3 + p - 1, '=' || k * 3 + p - 1 || ' (' || locus || '_pos' || p || ') ' || string_agg((k * 16 + p - 1 + 3 * j)::VARCHAR, ' ' ORDER BY j) FROM lo, range(1, 4) r(p), range(5) t(j) GROUP BY k, locus, p UNION ALL SELECT 2199023255552, -1, 'xgroup' UNION ALL SELECT 2199023255552, 1099511627776, ';'
  UNION ALL SELECT 2199023255553, r, '=' || r || ' (' || taxonset || ') ' || k0 FROM (SELECT *, row_number() OVER (ORDER BY taxonset) - 1 AS r FROM ts) UNION ALL SELECT 2199023255553, -1, 'agroup' UNION ALL SELECT 2199023255553, 1099511627776, ';'""", X.SQL_GRID, MATRIX))
def supermatrix_tnt_codons(spark, d):
    g = X.grid(spark, d)
    return writers.supermatrix_tnt_lines(g, allow_cancelled=True, positions=_positions(g))


@query("tnt_lines", X.sql(f"""SELECT 0 AS block, ord, regexp_replace(title, '[^\\w.]+', '_', 'g') || ' ' || t AS line FROM t UNION ALL SELECT -9, 0, 'nstates dna;' || {NL} || 'xread' || {NL} || '''sequences' UNION ALL SELECT -1, 0, '''' || {NL} || '64 ' || (SELECT count(*) FROM s) UNION ALL SELECT 1099511627776, 0, ';' UNION ALL SELECT 8796093022208, 0, 'proc /;'
  UNION ALL SELECT CASE WHEN k < 32 THEN 2199023255552 ELSE -8 END, k, '=' || k || ' (set' || k || ') ' || k || '.' || k + 1 FROM range(40) r(k) UNION ALL SELECT 2199023255552, -1, 'xgroup' UNION ALL SELECT 2199023255552, 1099511627776, ';' UNION ALL SELECT -8, -1, '@xgroup' UNION ALL SELECT -8, 1099511627776, ';'""", T))
def tnt_lines(spark, d):
    return writers.tnt_lines(X.sequences(spark, d), groups=[(f"set{k}", k, k + 1) for k in range(40)])


@query("phylip_lines", X.sql("SELECT 0 AS block, ord, regexp_replace(title, '[^\\w]+', '_', 'g') || ' ' || t AS line FROM t UNION ALL SELECT -1, 0, (SELECT count(*) FROM s) || ' 64'", T))
def phylip_lines(spark, d):
    return writers.phylip_lines(X.sequences(spark, d))


@query("sequences_lines", X.sql(f"SELECT locus, ord, '>' || taxon || {NL} || '^grid.colname ' || locus || {NL} || '^grid.seqname ' || taxon || {NL} || CASE WHEN cancelled THEN '^grid.cancelled' || {NL} ELSE '' END || translate(seq, '_', '-') || {NL} AS line FROM g UNION ALL SELECT '', -1, '#sequences' || {NL}", X.SQL_GRID))
def sequences_lines(spark, d):
    return writers.sequences_lines(X.grid(spark, d))


@query("grid_table", X.sql("SELECT taxon, " + ", ".join(f"max(seq) FILTER (locus = 'locus{k}') AS locus{k}" for k in range(X.LOCI)) + " FROM g WHERE NOT cancelled GROUP BY taxon", X.SQL_GRID))
def grid_table(spark, d):
    return writers.grid_table(X.grid(spark, d))


@query("by_locus_lines", X.sql(f"SELECT locus, taxon, '>' || replace(taxon, ' ', '_') || {NL} || translate(coalesce(seq, repeat('?', 16)), '_', '-') AS line FROM (SELECT DISTINCT taxon FROM g WHERE NOT cancelled) CROSS JOIN (SELECT DISTINCT locus FROM g) LEFT JOIN (SELECT * FROM g WHERE NOT cancelled) USING (locus, taxon)", X.SQL_GRID))
def by_locus_lines(spark, d):
    return writers.by_locus_lines(X.grid(spark, d), include_na=True, allow_cancelled=True)


@query("custom_lines", X.sql("""SELECT coalesce(family, 'none') AS family, ord, '%' || name || chr(9) || t AS line FROM t JOIN go USING (ord)
  UNION ALL SELECT f, o, x FROM (SELECT DISTINCT coalesce(family, 'none') AS f FROM s), (VALUES (-1, 'begin'), (4611686018427387904, 'end')) v(o, x)""", T, greedy("concat_ws(' ', species, gi)", 12, "substr(b, 1, 8)")).replace("WITH", "WITH RECURSIVE", 1))
def custom_lines(spark, d):
    return writers.custom_lines(X.sequences(spark, d), "species_gi", 12, False, "%", head="begin", foot="end")


@query("custom_lines_of_species", X.sql(f"SELECT coalesce(family, 'none') AS family, ord, '>' || title || {NL} || t AS line FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY length(regexp_replace(seq, '[_?-]', '', 'g')) DESC, ord) AS r FROM t) WHERE r = 1 OR species IS NULL", T))
def custom_lines_of_species(spark, d):
    return writers.custom_lines(X.sequences(spark, d), one_per_species=True)


@query("distance_lines", X.sql("SELECT dist, dist::VARCHAR AS line FROM pr WHERE species_a = species_b", X.SQL_CHARS, X.SQL_PAIRS))
def distance_lines(spark, d):
    return writers.distance_lines(pairs.pair_distances(X.sequences(spark, d), min_overlap=X.MIN_OVERLAP, scope="intra"))


@query("gene_lines", X.sql(f"""SELECT replace(gene, ' ', '_') AS gene, '>gi|' || gi || '|_' || replace(title, ' ', '_') || '_(' || feature || ')' || {NL} || seq AS line FROM (
  SELECT title, gi, feature, CASE feature WHEN 'gene' THEN 'gene_g' || ord % 4 || '-gene' WHEN 'CDS' THEN 'product_p' || ord % 3 || '-CDS' ELSE 'misc' END AS g0, CASE feature WHEN 'gene' THEN 'gene g' || ord % 4 || '_gene' WHEN 'CDS' THEN 'product p' || ord % 3 || '_CDS' ELSE 'misc' END AS gene,
    CASE feature WHEN 'gene' THEN substr(o, 3, 18) WHEN 'CDS' THEN reverse(translate(substr(o, 11, 15), 'ACGTRN', 'TGCAYN')) ELSE substr(o, 1, 4) || substr(o, 31, 10) END AS seq FROM (SELECT *, translate(seq, '_?', '--') AS o FROM s), (VALUES ('gene'), ('CDS'), ('misc')) f(feature)) WHERE g0 IN (SELECT 'gene_g' || ord % 4 || '-gene' FROM s GROUP BY 1 HAVING count(*) >= 150 UNION ALL SELECT 'product_p' || ord % 3 || '-CDS' FROM s GROUP BY 1 HAVING count(*) >= 150 UNION ALL SELECT 'misc' FROM s HAVING count(*) >= 150)"""))
def gene_lines(spark, d):
    loci = _loci(spark, d)
    features = flatfile.extract_features(flatfile.features_by_gene(flatfile.explode_features(loci)), loci)
    return writers.gene_lines(features.withColumn("species", F.col("file")), 150)


@query("flatfile_lines", X.sql(f"""SELECT 'r' || ord AS file, 0::BIGINT AS locus_id, 'LOCUS       L' || ord || {NL} || 'DEFINITION  ' || title || {NL} || 'ACCESSION   L' || ord || {NL} || 'VERSION     L.1  GI:' || gi || {NL} || 'FEATURES    Location/Qualifiers' || {NL} ||
  '     gene            3..20' || {NL} || '                     /gene="g' || ord % 4 || '"' || {NL} || '     CDS             complement(11..25)' || {NL} || '                     /product="p' || ord % 3 || '"' || {NL} || '     misc            join(1..4,31..40)' || {NL} ||
  'ORIGIN      ' || {NL} || '        1 ' || o[1:20] || ' ' || o[21:] || {NL} || '//' AS line FROM (SELECT *, translate(lower(seq), '_?', '--') AS o FROM s)"""))
def flatfile_lines(spark, d):
    return writers.flatfile_lines(_loci(spark, d))


#: What four files hold for each hundred sequences: a Nexus file, FASTA files of the same name and of the name that this
#: one would get, and a dump.  Every seventh FASTA row is cut short, every fifth comes twice, first with fewer bases.
LOADED = """fl AS MATERIALIZED (
  SELECT 'f' || ord // 100 || '.nex' AS file, 'T ' || lpad(ord::VARCHAR, 8, '0') AS taxon, NULL AS named, ord AS k, seq, false AS cancelled FROM s
  UNION ALL SELECT 'f' || ord // 100 || '.txt', title, NULL, ord * 2 + c, CASE WHEN ord % 7 = 1 THEN substr(seq, 1, 60) WHEN ord % 5 = 0 AND c = 0 THEN substr(seq, 1, 20) || repeat('?', 44) ELSE seq END, false FROM s, (VALUES (0), (1)) v(c) WHERE c = 1 OR ord % 5 = 0
  UNION ALL SELECT 'f' || ord // 100 || '_2.fas', title, NULL, ord, seq, false FROM s WHERE ord % 3 = 0
  UNION ALL SELECT 'q' || ord // 100 || '.seq', coalesce(species, 'none'), CASE WHEN ord % 2 = 0 THEN 'f' || ord // 100 ELSE 'dump' END, ord, seq, ord % 4 = 0 FROM s),
n1 AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS ord, length(regexp_extract(translate(seq, '_', '-'), '^[-?]*')) AS lead FROM fl),
n2 AS (SELECT *, CASE WHEN lead = length(seq) THEN translate(seq, '-', '_') ELSE translate(seq[:lead], '-', '_') || translate(seq[lead + 1:], '_', '-') END AS s1 FROM n1),
n3 AS (SELECT *, length(regexp_extract(s1, '[-?]*$')) AS tail FROM n2),
cell AS (SELECT file, taxon, ord, cancelled, coalesce(named, CASE WHEN file LIKE '%.nex' THEN split_part(file, '.', 1) ELSE split_part(file, '.', 1) || '_2' END) AS locus,
  s1[:length(s1) - tail] || translate(s1[length(s1) - tail + 1:], '-', '_') AS seq FROM n3),
long AS (SELECT *, length(regexp_replace(seq, '[_?]', '', 'g'))::INTEGER AS actual_length FROM cell),
fixed AS (SELECT *, first(length(seq)) OVER (PARTITION BY locus ORDER BY file, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS len FROM long WHERE actual_length > 0),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY locus, taxon ORDER BY length(seq) = len DESC, actual_length DESC, file DESC, ord DESC) AS r FROM fixed)"""


def _loaded(spark, d):
    nexus = _files(spark, d, f"concat({NAME}, ' ', {PLAIN})", NEXUS, SETS).withColumn("file", F.regexp_replace("file", "txt$", "nex"))
    cut = f"if(ord % 7 = 1, substring({PLAIN}, 1, 60), {PLAIN})"
    twice = f"if(ord % 5 = 0, concat('>', title, '\n', if(ord % 7 = 1, substring({PLAIN}, 1, 60), concat(substring({PLAIN}, 1, 20), repeat('?', 44))), '\n'), '')"
    fasta = _files(spark, d, f"concat({twice}, '>', title, '\n', {cut})")
    second = _files(spark, d, f"if(ord % 3 = 0, concat('>', title, '\n', {PLAIN}), '')").withColumn("file", F.regexp_replace("file", "[.]txt$", "_2.fas"))
    dump = _files(spark, d, f"concat('>x', ord, '\n^g.colname ', if(ord % 2 = 0, concat('f', cast(ord div 100 as string)), 'dump'), '\n^g.seqname ', coalesce(species, 'none'), if(ord % 4 = 0, '\n^g.cancelled', ''), '\n', {PLAIN})", "#sequences\n")
    dump = dump.withColumn("file", F.regexp_replace(F.translate("file", "f", "q"), "txt$", "seq"))
    return readers.parse_any(nexus.unionByName(fasta).unionByName(second).unionByName(dump))


@query("load_grid", X.sql("SELECT locus, taxon, ord, seq, actual_length, cancelled FROM placed WHERE r = 1 AND length(seq) = len", LOADED))
def load_grid(spark, d):
    return readers.grid_of(_loaded(spark, d))


@query("load_grid_refused", X.sql("SELECT locus, taxon, file, ord, CASE WHEN length(seq) < len THEN 'too short' WHEN length(seq) > len THEN 'too long' ELSE 'shorter or earlier' END AS reason FROM placed WHERE length(seq) <> len OR r > 1", LOADED))
def load_grid_refused(spark, d):
    return readers.filled(_loaded(spark, d))[1]


@query("reload_grid", X.sql("SELECT locus, taxon, s3 AS seq, length(regexp_replace(s3, '[_?]', '', 'g'))::INTEGER AS actual_length, cancelled FROM (SELECT *, s2[:length(s2) - tail] || translate(s2[length(s2) - tail + 1:], '-', '_') AS s3 FROM (SELECT *, length(regexp_extract(s2, '[-_?]*$')) AS tail FROM (SELECT *, translate(seq[:lead], '-', '_') || seq[lead + 1:] AS s2 FROM (SELECT *, length(regexp_extract(seq, '^[-_?]*')) AS lead FROM g))))", X.SQL_GRID))
def reload_grid(spark, d):
    """The dump of a grid is the grid again, but for gaps at the ends of a cell, which are missing."""
    lines = writers.sequences_lines(X.grid(spark, d)).groupBy(F.lit("dump.txt").alias("file"), F.col("locus").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    texts = lines.where("part <> ''").select(F.concat("part", F.lit(".txt")).alias("file"), F.concat(F.lit("#sequences\n"), "text").alias("text"))
    return readers.grid_of(readers.parse_any(texts)).drop("ord")


@query("combine_features", X.sql("SELECT feature, 2 * count(*) AS n FROM s, (VALUES ('gene'), ('CDS'), ('misc')) f(feature) GROUP BY feature"))
def combine_features(spark, d):
    features = flatfile.explode_features(_loci(spark, d))
    return flatfile.combine_features(features, features).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
