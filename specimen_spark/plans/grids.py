"""Queries on clusters, grids and character sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charsets, clusters, consensus, grid, near
from ..operators.gridstore import GridStore
from ..operators.storage import fresh_path
from . import fixtures as X
from .lists import CLASS
from .pairwise import PAIRS

QUERIES, ORACLE_SQL = {}, {}
G = (X.SQL_GRID,)
#: The reference taxon is the sequence with ord 1, by its title.
REF_SQL = "(SELECT title FROM s WHERE ord = 1)"


def _reference(spark, d) -> str:
    return X.raw_sequences(spark, d).where("ord = 1").first()["title"]



def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _found(spark, d):
    return clusters.clusters_of(X.sequences(spark, d), 0.03, X.MIN_OVERLAP)


# connected components by recursion over the sequences of each component
CLUSTERS = """ed AS MATERIALIZED (SELECT q AS x, m AS y FROM mir WHERE bucket <= 3000), reach AS (SELECT ord AS x, ord AS y FROM s UNION SELECT r.x, e.y FROM reach r JOIN ed e ON e.x = r.y),
cl AS MATERIALIZED (SELECT x AS ord, min(y) AS cluster FROM reach GROUP BY x), kd AS MATERIALIZED (SELECT ord, coalesce(species, '{' || title || '}') AS kind, cluster, length(regexp_extract(seq, '^[-_?]*')) AS lo, length(seq) - 1 - length(regexp_extract(seq, '[-_?]*$')) AS hi FROM s JOIN cl USING (ord))"""


def _sql(select: str) -> str:
    return X.sql(select, *PAIRS, CLUSTERS).replace("WITH", "WITH RECURSIVE", 1)


@query("clusters", _sql("SELECT ord, cluster FROM cl"))
def clusters_query(spark, d):
    return _found(spark, d)


@query("near_clusters", _sql("SELECT ord, cluster FROM cl"))
def near_clusters(spark, d):
    """By segments, or inside tiles where very many pairs have segments in common."""
    s = X.sequences(spark, d)
    return clusters.clusters(s, near.near_links(s, 0.03, X.MIN_OVERLAP), 0.03)


@query("cluster_report", _sql("""SELECT cluster, size, species, max_dist, coalesce(valid_pairs, 0) AS valid_pairs, coalesce(over, 0)::BIGINT AS over, CASE WHEN species = 1 THEN CASE WHEN partial = 0 THEN 'perfect' ELSE 'split' END ELSE CASE WHEN partial = 0 THEN 'lumped' ELSE 'lumped+split' END END AS status
  FROM (SELECT cluster, sum(here)::BIGINT AS size, count(*) AS species, max(CASE WHEN here < total THEN 1 ELSE 0 END) AS partial FROM (SELECT cluster, kind, count(*) AS here FROM kd GROUP BY 1, 2) JOIN (SELECT kind, count(*) AS total FROM kd GROUP BY 1) USING (kind) GROUP BY 1)
  LEFT JOIN (SELECT a.cluster, max(dist) AS max_dist, count(*) AS valid_pairs, sum(CASE WHEN bucket > 3000 THEN 1 ELSE 0 END) AS over FROM pr JOIN cl a ON a.ord = pr.a JOIN cl b ON b.ord = pr.b AND a.cluster = b.cluster GROUP BY 1) USING (cluster)"""))
def cluster_report(spark, d):
    return clusters.cluster_report_of(X.sequences(spark, d), _found(spark, d), 0.03, X.MIN_OVERLAP)


@query("cluster_consensus", _sql(f"SELECT cluster, max(size) AS size, string_agg(CASE WHEN n < size THEN '?' ELSE ch END, '' ORDER BY pos) AS consensus FROM (SELECT *, max(n) OVER (PARTITION BY cluster) AS size FROM (SELECT cluster, pos, count(*) AS n, {CLASS} AS ch FROM c JOIN cl USING (ord) GROUP BY cluster, pos)) GROUP BY cluster"))
def cluster_consensus(spark, d):
    return consensus.consensus(X.sequences(spark, d).join(_found(spark, d), "ord"), "cluster")


@query("species_cluster_report", _sql("""SELECT kind, count(*) AS clusters, coalesce(any_value(o.others), 0) AS others, greatest(0, min(hi) - max(lo) + 1) AS shared_extent FROM (SELECT kind, cluster, min(lo) AS lo, max(hi) AS hi FROM kd GROUP BY 1, 2)
  LEFT JOIN (SELECT x.kind, count(DISTINCT y.kind) AS others FROM kd x JOIN kd y ON x.cluster = y.cluster AND x.kind <> y.kind GROUP BY 1) o USING (kind) GROUP BY kind"""))
def species_cluster_report(spark, d):
    return clusters.species_cluster_report(X.sequences(spark, d), _found(spark, d))


@query("cluster_matrix", _sql("SELECT a.cluster, pr.a, pr.b, dist FROM pr JOIN cl a ON a.ord = pr.a JOIN cl b ON b.ord = pr.b AND a.cluster = b.cluster"))
def cluster_matrix(spark, d):
    return clusters.cluster_matrix_of(X.sequences(spark, d), _found(spark, d), X.MIN_OVERLAP)


@query("grid_summary", X.sql("SELECT taxon, count(*) AS loci, sum(actual_length)::BIGINT AS combined_length FROM g WHERE NOT cancelled GROUP BY taxon", *G))
def grid_summary(spark, d):
    return grid.grid_summary(X.grid(spark, d))


@query("grid_cells", X.sql("""SELECT locus, taxon, CASE WHEN seq IS NULL THEN 'no data' WHEN cancelled THEN 'excised' ELSE 'ok' END AS status, actual_length, len(regexp_extract_all(seq, 'N')) AS n_count, len(regexp_extract_all(seq, '-')) AS indels
  FROM (SELECT DISTINCT taxon FROM g) CROSS JOIN (SELECT DISTINCT locus FROM g) LEFT JOIN g USING (locus, taxon)""", *G))
def grid_cells(spark, d):
    return grid.grid_cells(X.grid(spark, d))


@query("grid_cells_codons", X.sql("""SELECT locus, taxon, CASE WHEN seq IS NULL THEN 'no data' WHEN cancelled THEN 'excised' ELSE 'ok' END AS status, actual_length, len(regexp_extract_all(seq, 'N')) AS n_count, len(regexp_extract_all(seq, '-')) AS indels, CASE locus WHEN 'locus1' THEN '1, 2, 3' WHEN 'locus2' THEN '1, N' END AS codon_positions
  FROM (SELECT DISTINCT taxon FROM g) CROSS JOIN (SELECT DISTINCT locus FROM g) LEFT JOIN g USING (locus, taxon)""", *G))
def grid_cells_codons(spark, d):
    g = X.grid(spark, d)
    positions = g.select("locus").distinct().select("locus", F.explode(F.expr("case locus when 'locus1' then array(1, 2, 3) when 'locus2' then array(0, 1) else array() end")).alias("pos"))
    return grid.grid_cells(g, positions)


@query("grid_store", X.sql("""SELECT locus, taxon, ord, seq, actual_length, (batch < 2 AND ((locus = 'locus0' AND ord % 17 = 4) OR ord % 19 = 4)) AS cancelled FROM (SELECT *, row_number() OVER (PARTITION BY locus, taxon ORDER BY actual_length DESC, batch DESC) AS r FROM (
    SELECT locus, taxon, ord, 0 AS batch, seq, actual_length FROM g WHERE ord % 2 = 0
    UNION ALL SELECT locus, taxon, ord, 1, t, length(regexp_replace(t, '[_?]', '', 'g'))::INTEGER FROM (SELECT *, CASE WHEN ord % 6 = 0 THEN replace(seq, 'A', '?') ELSE seq END AS t FROM g WHERE ord % 3 = 0 AND NOT (locus = 'locus1' AND ord % 9 = 0))
    UNION ALL SELECT locus, taxon, ord, 3, seq, actual_length FROM g WHERE ord % 2 = 1) WHERE actual_length > 0) WHERE r = 1""", *G))
def grid_store(spark, d):
    """Four batches, of which the second holds shorter rows and rows of another length and the third cancels cells; a base is made of three."""
    g = X.grid(spark, d).select("locus", "taxon", "ord", "seq")
    store = GridStore(spark, fresh_path(spark, "grid"), 8)
    store.append(g.where("ord % 2 = 0"), 0)
    cut = F.when((F.col("locus") == "locus1") & (F.col("ord") % 9 == 0), F.substring("seq", 1, 9)).when(F.col("ord") % 6 == 0, F.translate("seq", "A", "?")).otherwise(F.col("seq"))
    store.append(g.where("ord % 3 = 0").withColumn("seq", cut), 1)
    store.cancel(g.where("locus = 'locus0' and ord % 17 = 4").select("locus", "taxon").unionByName(g.where("ord % 19 = 4").select(F.lit(None).cast("string").alias("locus"), "taxon")), 2)
    store.compact()
    store.append(g.where("ord % 2 = 1"), 3)
    return store.read()


@query("concatenate_mixed", X.sql("SELECT taxon, string_agg(coalesce(CASE WHEN mixed AND locus <> 'locus3' THEN replace(replace(seq, 'R', '[AG]'), 'N', '[ACTG]') ELSE seq END, repeat('?', 16)), '' ORDER BY locus) AS seq FROM (SELECT taxon, bool_or(locus = 'locus3') AS mixed FROM g WHERE NOT cancelled GROUP BY 1) CROSS JOIN (SELECT DISTINCT locus FROM g) LEFT JOIN (SELECT * FROM g WHERE NOT cancelled) USING (locus, taxon) GROUP BY taxon", *G))
def concatenate_mixed(spark, d):
    return grid.concatenate(X.grid(spark, d).withColumn("kind", F.when(F.col("locus") == "locus3", "STANDARD").otherwise("DNA")))


@query("concatenate", X.sql("SELECT taxon, string_agg(coalesce(seq, repeat('?', 16)), '' ORDER BY locus) AS seq FROM (SELECT DISTINCT taxon FROM g WHERE NOT cancelled) CROSS JOIN (SELECT DISTINCT locus FROM g) LEFT JOIN (SELECT * FROM g WHERE NOT cancelled) USING (locus, taxon) GROUP BY taxon", *G))
def concatenate(spark, d):
    return grid.concatenate(X.grid(spark, d))


@query("charset_ranges", X.sql("SELECT locus, row_number() OVER (ORDER BY locus) * 16 - 15 AS first, row_number() OVER (ORDER BY locus) * 16 AS last FROM (SELECT DISTINCT locus FROM g)", *G))
def charset_ranges(spark, d):
    return grid.charset_ranges(X.grid(spark, d))


@query("taxonsets", X.sql("""SELECT 'LENGTH_ATLEAST_' || k AS taxonset, taxon FROM (SELECT taxon, sum(actual_length) AS l FROM g WHERE NOT cancelled GROUP BY 1), (VALUES (30), (40), (50)) v(k) WHERE l >= k
  UNION ALL SELECT 'CHARSETS_ATLEAST_' || k, taxon FROM (SELECT taxon, count(*) AS n FROM g WHERE NOT cancelled GROUP BY 1), (VALUES (4), (3), (2)) v(k) WHERE n >= k
  UNION ALL SELECT 'TAXA_HAVING_' || locus, taxon FROM g WHERE NOT cancelled""", *G))
def taxonsets(spark, d):
    return grid.taxonsets(X.grid(spark, d), (30, 40, 50), (4, 3, 2))


@query("add_to_grid", X.sql("""SELECT locus, taxon, ord, seq FROM (SELECT *, row_number() OVER (PARTITION BY locus, taxon ORDER BY actual_length DESC, new DESC, ord DESC) AS r FROM (
  SELECT locus, taxon, ord, seq, actual_length, 0 AS new FROM g UNION ALL SELECT 'locus0', title, ord, substr(seq, 17, 16), length(regexp_replace(substr(seq, 17, 16), '[_?]', '', 'g')), 1 FROM s WHERE ord % 5 > 0 AND length(regexp_replace(substr(seq, 17, 16), '[_?]', '', 'g')) > 0)) WHERE r = 1""", *G))
def add_to_grid(spark, d):
    s = X.sequences(spark, d)
    new = s.select("ord", F.col("title").alias("taxon"), F.expr("if(ord % 5 = 0, substring(seq, 17, 12), substring(seq, 17, 16))").alias("seq"))
    return grid.add_to_grid(X.grid(spark, d), new, "locus0")[0].select("locus", "taxon", "ord", "seq")


@query("grid_refusals", X.sql("SELECT 'locus0' AS locus, title AS taxon, ord, 'wrong length' AS reason FROM s WHERE ord % 5 = 0 AND length(regexp_replace(substr(seq, 17, 12), '[_?]', '', 'g')) > 0", *G))
def grid_refusals(spark, d):
    s = X.sequences(spark, d)
    new = s.select("ord", F.col("title").alias("taxon"), F.expr("if(ord % 5 = 0, substring(seq, 17, 12), substring(seq, 17, 16))").alias("seq"))
    return grid.add_to_grid(X.grid(spark, d), new, "locus0")[1]


@query("cancel_cells", X.sql("SELECT locus, taxon, CASE WHEN ord % 10 = 0 OR (ord % 10 = 5 AND locus = 'locus1') THEN NOT cancelled ELSE cancelled END AS cancelled FROM g", *G))
def cancel_cells(spark, d):
    g = X.grid(spark, d)
    cells = g.where("ord % 10 = 0").select(F.lit(None).cast("string").alias("locus"), "taxon").unionByName(g.where("ord % 10 = 5 and locus = 'locus1'").select("locus", "taxon"))
    return grid.cancel(g, cells).select("locus", "taxon", "cancelled")


@query("drop_locus_and_taxon", X.sql(f"SELECT locus, taxon FROM g WHERE locus <> 'locus2' AND taxon <> {REF_SQL}", *G))
def drop_locus_and_taxon(spark, d):
    return grid.drop_taxon(grid.drop_locus(X.grid(spark, d), "locus2"), _reference(spark, d)).select("locus", "taxon")


@query("rename_taxa", X.sql("SELECT locus, taxon, ord FROM (SELECT locus, CASE WHEN ord % 4 = 1 THEN coalesce((SELECT any_value(t.title) FROM s t WHERE t.ord = g.ord - 1), g.taxon) ELSE taxon END AS taxon, ord, row_number() OVER (PARTITION BY locus, ord - (CASE WHEN ord % 4 = 1 THEN 1 ELSE 0 END) ORDER BY actual_length DESC, (CASE WHEN ord % 4 = 1 THEN 0 ELSE 1 END) DESC, ord) AS r FROM g) WHERE r = 1", *G))
def rename_taxa(spark, d):
    s = X.sequences(spark, d).select("ord", "title")
    mapping = s.alias("x").join(s.alias("y"), F.expr("x.ord % 4 = 1 and y.ord = x.ord - 1")).select(F.col("x.title").alias("taxon"), F.col("y.title").alias("new_taxon"))
    return grid.rename_taxa(X.grid(spark, d), mapping)[0].select("locus", "taxon", "ord")


NAMED = "n AS MATERIALIZED (SELECT locus, regexp_replace(taxon, '^gi.[0-9]+. ', '') || ' ' || ord AS taxon, ord, seq, actual_length, cancelled FROM g)"
_ORDERS = {"taxon": "", "second": "CASE WHEN regexp_matches(taxon, '^\\w+\\s+\\w+') THEN regexp_extract(taxon, '^\\w+\\s+(\\w+)', 1) END NULLS LAST,", "loci": "loci DESC,", "length": "combined_length DESC,"}


def _named(spark, d):
    return X.grid(spark, d).withColumn("taxon", F.concat(F.regexp_replace("taxon", "^gi.[0-9]+. ", ""), F.lit(" "), F.col("ord").cast("string")))


for _kind, _keys in _ORDERS.items():

    def _ordered(spark, d, kind=_kind):
        return grid.rows_in_order(_named(spark, d), kind, "Apis secunda 1")

    query(f"grid_rows_by_{_kind}", X.sql(f"SELECT *, row_number() OVER (ORDER BY CASE WHEN taxon = 'Apis secunda 1' THEN 0 ELSE 1 END, {_keys} taxon) AS place FROM (SELECT taxon, sum(CASE WHEN cancelled THEN 0 ELSE 1 END)::BIGINT AS loci, sum(CASE WHEN cancelled THEN 0 ELSE actual_length END)::BIGINT AS combined_length FROM n GROUP BY taxon)", *G, NAMED))(_ordered)


@query("grid_to_list", X.sql("SELECT row_number() OVER (ORDER BY taxon) AS ord, taxon AS title, seq FROM (SELECT taxon, string_agg(coalesce(seq, repeat('?', 16)), '' ORDER BY locus) AS seq FROM (SELECT DISTINCT taxon FROM g WHERE NOT cancelled) CROSS JOIN (SELECT DISTINCT locus FROM g) LEFT JOIN (SELECT * FROM g WHERE NOT cancelled) USING (locus, taxon) GROUP BY taxon)", *G))
def grid_to_list(spark, d):
    return grid.grid_to_list(X.grid(spark, d))


@query("locus_to_list", X.sql("SELECT row_number() OVER (ORDER BY taxon) AS ord, taxon AS title, seq FROM g WHERE locus = 'locus2' AND NOT cancelled", *G))
def locus_to_list(spark, d):
    return grid.locus_to_list(X.grid(spark, d), "locus2")


SQL_CELLS = """gc AS MATERIALIZED (SELECT locus, taxon, q AS pos, (CASE ch WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'T' THEN 4 WHEN 'G' THEN 8 WHEN 'R' THEN 9 WHEN 'N' THEN 15 ELSE 0 END)::INTEGER AS m, ch = '-' AS i, ch IN ('A', 'G', 'R') AS p, ch IN ('C', 'T', 'Y') AS y
  FROM (SELECT locus, taxon, unnest(range(16)) AS q, substr(seq, unnest(range(16)) + 1, 1) AS ch FROM g WHERE NOT cancelled))"""


@query("find_distances", X.sql("""SELECT locus, taxon, other, overlap, 1.0::DOUBLE - same::DOUBLE / overlap AS dist FROM (SELECT x.locus, x.taxon, y.taxon AS other, sum(CASE WHEN (x.m > 0 AND y.m > 0) OR (x.i AND (y.m > 0 OR y.i)) OR (y.i AND x.m > 0) THEN 1 ELSE 0 END)::INTEGER AS overlap,
  sum(CASE WHEN (x.m & y.m) > 0 OR (x.i AND y.i) THEN 1 ELSE 0 END)::INTEGER AS same FROM gc x JOIN gc y ON x.locus = y.locus AND x.pos = y.pos AND x.taxon <> y.taxon WHERE x.locus = 'locus1' GROUP BY ALL) WHERE overlap >= 8 AND 1.0::DOUBLE - same::DOUBLE / overlap BETWEEN 0.0 AND 0.1""", *G, SQL_CELLS))
def find_distances(spark, d):
    return grid.find_distances(X.grid(spark, d), 0.0, 0.1, "locus1", 8).select("locus", "taxon", "other", "overlap", "dist")


@query("near_cells", X.sql("""SELECT locus, taxon, other, overlap, 1.0::DOUBLE - same::DOUBLE / overlap AS dist FROM (SELECT x.locus, x.taxon, y.taxon AS other, sum(CASE WHEN (x.m > 0 AND y.m > 0) OR (x.i AND (y.m > 0 OR y.i)) OR (y.i AND x.m > 0) THEN 1 ELSE 0 END)::INTEGER AS overlap,
  sum(CASE WHEN (x.m & y.m) > 0 OR (x.i AND y.i) THEN 1 ELSE 0 END)::INTEGER AS same FROM gc x JOIN gc y ON x.locus = y.locus AND x.pos = y.pos AND x.taxon <> y.taxon GROUP BY ALL) WHERE overlap >= 8 AND 1.0::DOUBLE - same::DOUBLE / overlap < 0.06251""", *G, SQL_CELLS))
def near_cells(spark, d):
    """Cells of every locus that are close to each other, by segments."""
    return near.near_cells(X.grid(spark, d), 0.0625, 8).select("locus", "taxon", "other", "overlap", "dist")


SQL_REF = f"""rd AS MATERIALIZED (SELECT locus, taxon, CASE WHEN taxon = {REF_SQL} THEN 'reference' WHEN g.cancelled IS NULL THEN 'no data' WHEN g.cancelled THEN 'excised' WHEN r.locus IS NULL THEN 'no reference' WHEN dist IS NULL THEN 'no overlap' ELSE 'ok' END AS status, CASE WHEN taxon <> {REF_SQL} AND NOT g.cancelled AND r.locus IS NOT NULL THEN dist END AS dist
  FROM (SELECT DISTINCT taxon FROM g) CROSS JOIN (SELECT DISTINCT locus FROM g) LEFT JOIN g USING (locus, taxon) LEFT JOIN (SELECT locus FROM g WHERE taxon = {REF_SQL} AND NOT cancelled) r USING (locus)
  LEFT JOIN (SELECT locus, taxon, CASE WHEN overlap >= 1 THEN tv / overlap END AS dist FROM (SELECT x.locus, x.taxon, sum(CASE WHEN (x.p OR x.y) AND (z.p OR z.y) THEN 1 ELSE 0 END + CASE WHEN (x.i AND (z.m > 0 OR z.i)) OR (z.i AND x.m > 0) THEN 1 ELSE 0 END)::INTEGER AS overlap, sum(CASE WHEN (x.p AND z.y) OR (x.y AND z.p) THEN 1 ELSE 0 END)::DOUBLE AS tv
    FROM gc x JOIN gc z ON x.locus = z.locus AND x.pos = z.pos AND z.taxon = {REF_SQL} GROUP BY 1, 2)) dd USING (locus, taxon))"""
SQL_SCALED = "sc AS MATERIALIZED (SELECT *, CASE WHEN max(dist) OVER (PARTITION BY locus) > min(dist) OVER (PARTITION BY locus) THEN (dist - min(dist) OVER (PARTITION BY locus)) / (max(dist) OVER (PARTITION BY locus) - min(dist) OVER (PARTITION BY locus)) WHEN dist IS NOT NULL THEN 0.0 END AS scaled FROM rd)"


def _ref(spark, d):
    return grid.reference_distances(X.grid(spark, d), _reference(spark, d))


@query("reference_distances", X.sql("SELECT * FROM rd", *G, SQL_CELLS, SQL_REF))
def reference_distances(spark, d):
    return _ref(spark, d)


@query("normalise_distances", X.sql("SELECT locus, taxon, round(scaled, 9) AS scaled FROM sc", *G, SQL_CELLS, SQL_REF, SQL_SCALED))
def normalise_distances(spark, d):
    return grid.normalise_distances(_ref(spark, d)).select("locus", "taxon", F.round("scaled", 9).alias("scaled"))


@query("taxon_scores", X.sql("SELECT taxon, round(avg(scaled), 9) AS score FROM sc WHERE locus <> 'locus3' GROUP BY taxon", *G, SQL_CELLS, SQL_REF, SQL_SCALED))
def taxon_scores(spark, d):
    return grid.taxon_scores(grid.normalise_distances(_ref(spark, d)), "locus3")


@query("locus_ranks", X.sql("SELECT locus, taxon, dist, rank() OVER (PARTITION BY locus ORDER BY dist) - 1 AS rank FROM rd WHERE dist IS NOT NULL", *G, SQL_CELLS, SQL_REF))
def locus_ranks(spark, d):
    return grid.locus_ranks(_ref(spark, d))


_CORR = "SELECT x.locus AS l1, y.locus AS l2, CASE WHEN stddev_pop(x.dist) > 1e-9 AND stddev_pop(y.dist) > 1e-9 THEN corr(x.dist, y.dist) ELSE 0.0 END AS r FROM rd x JOIN rd y ON x.taxon = y.taxon AND x.locus < y.locus WHERE x.status = 'ok' AND y.status = 'ok' GROUP BY 1, 2 UNION ALL SELECT DISTINCT locus, locus, 1.0 FROM rd"


@query("locus_correlation", X.sql(f"SELECT l1, l2, round(r, 7) AS r FROM ({_CORR})", *G, SQL_CELLS, SQL_REF))
def locus_correlation(spark, d):
    return grid.locus_correlation(_ref(spark, d))


@query("average_r", X.sql(f"SELECT round(avg(r), 6) AS average_r FROM ({_CORR})", *G, SQL_CELLS, SQL_REF))
def average_r(spark, d):
    return grid.average_r(grid.locus_correlation(_ref(spark, d))).select(F.round("average_r", 6).alias("average_r"))


_INFLUENCE = """cd AS MATERIALIZED (SELECT reference, locus, taxon, tv / overlap AS dist FROM (SELECT x.locus, x.taxon, z.taxon AS reference, sum(CASE WHEN (x.p OR x.y) AND (z.p OR z.y) THEN 1 ELSE 0 END + CASE WHEN (x.i AND (z.m > 0 OR z.i)) OR (z.i AND x.m > 0) THEN 1 ELSE 0 END)::INTEGER AS overlap, sum(CASE WHEN (x.p AND z.y) OR (x.y AND z.p) THEN 1 ELSE 0 END)::DOUBLE AS tv
    FROM gc x JOIN gc z ON x.locus = z.locus AND x.pos = z.pos AND x.taxon <> z.taxon GROUP BY ALL) WHERE overlap >= 1),
tm AS MATERIALIZED (SELECT x.reference, x.taxon, x.locus AS l1, y.locus AS l2, x.dist AS dx, y.dist AS dy FROM cd x JOIN cd y ON x.reference = y.reference AND x.taxon = y.taxon AND x.locus < y.locus),
sm AS MATERIALIZED (SELECT reference, l1, l2, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dx * dx) AS sxx, sum(dy * dy) AS syy, sum(dx * dy) AS sxy FROM tm GROUP BY ALL),
wr AS MATERIALIZED (SELECT *, CASE WHEN n * sxx - sx * sx > 1e-12 AND n * syy - sy * sy > 1e-12 THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) ELSE 0.0 END AS r FROM sm),
dl AS MATERIALIZED (SELECT reference, taxon, l1, l2, CASE WHEN vx > 1e-12 AND vy > 1e-12 THEN ((n - 1) * (sxy - dx * dy) - (sx - dx) * (sy - dy)) / (sqrt(vx) * sqrt(vy)) ELSE 0.0 END - r AS delta FROM (SELECT tm.*, n, sx, sy, sxy, r, (n - 1) * (sxx - dx * dx) - (sx - dx) * (sx - dx) AS vx, (n - 1) * (syy - dy * dy) - (sy - dy) * (sy - dy) AS vy FROM tm JOIN wr USING (reference, l1, l2))),
ce AS (SELECT reference, locus, taxon, sum(delta) AS delta FROM (SELECT reference, taxon, l1 AS locus, delta FROM dl UNION ALL SELECT reference, taxon, l2, delta FROM dl) GROUP BY ALL),
av AS (SELECT reference, locus, taxon, round((all_r + k + delta) / (k * (k + 1) / 2), 7) AS average_r, round((all_r + k) / (k * (k + 1) / 2), 7) AS now FROM ce JOIN (SELECT reference, sum(r) AS all_r FROM wr GROUP BY 1) USING (reference) CROSS JOIN (SELECT count(DISTINCT locus) AS k FROM g))"""


@query("correlation_influence", X.sql("SELECT reference, locus, count(*) AS cells, max(average_r) AS best, min(average_r) AS least FROM (SELECT *, row_number() OVER (PARTITION BY reference, locus ORDER BY average_r DESC, taxon) AS place FROM av WHERE average_r <> now) WHERE place <= 10 GROUP BY reference, locus", *G, SQL_CELLS, _INFLUENCE))
def correlation_influence(spark, d):
    """Every taxon as the reference; of the ten cells the best and the least r, as ties in the last digit decide which they are."""
    found = grid.influence_of_all(X.grid(spark, d))
    return found.groupBy("reference", "locus").agg(F.count(F.lit(1)).alias("cells"), F.max("average_r").alias("best"), F.min("average_r").alias("least"))


@query("random_locus_groups", X.sql(f"""SELECT replicate, "group", locus, taxon FROM ce WHERE (replicate, "group", taxon) NOT IN (SELECT (replicate, "group", taxon) FROM (SELECT *, row_number() OVER (PARTITION BY replicate, "group" ORDER BY md5('1|' || replicate || '|' || "group" || '|' || taxon), taxon) AS r FROM (SELECT DISTINCT replicate, "group", taxon FROM ce WHERE taxon <> {REF_SQL})) WHERE r <= 5)""", *G,
  """gr AS (SELECT replicate, locus, floor((row_number() OVER (PARTITION BY replicate ORDER BY md5('1|' || replicate || '|' || locus), locus) - 1) / 2)::BIGINT AS "group" FROM (SELECT DISTINCT locus FROM g), (SELECT unnest(range(1, 4))::INTEGER AS replicate)), ce AS MATERIALIZED (SELECT * FROM g JOIN gr USING (locus))"""))
def random_locus_groups(spark, d):
    return grid.random_locus_groups(X.grid(spark, d), 2, 3, 5, _reference(spark, d), 1).select("replicate", "group", "locus", "taxon")


@query("random_locus_groups_na", X.sql("""SELECT replicate, "group", locus, taxon, coalesce(seq, repeat('?', 16)) AS seq FROM (SELECT DISTINCT replicate, "group", taxon FROM g JOIN gr USING (locus)) JOIN gr USING (replicate, "group") LEFT JOIN g USING (locus, taxon)""", *G,
  """gr AS MATERIALIZED (SELECT replicate, locus, floor((row_number() OVER (PARTITION BY replicate ORDER BY md5('1|' || replicate || '|' || locus), locus) - 1) / 2)::BIGINT AS "group" FROM (SELECT DISTINCT locus FROM g), (SELECT unnest(range(1, 4))::INTEGER AS replicate))"""))
def random_locus_groups_na(spark, d):
    return grid.random_locus_groups(X.grid(spark, d), 2, 3, seed=1, include_na=True).select("replicate", "group", "locus", "taxon", "seq")


SQL_SETS = "cs AS MATERIALIZED (SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, 'set' || label AS name, (min(vec_id) % 60)::INTEGER + 1 AS f, (min(vec_id) % 60)::INTEGER + 5 + (count(*) % 7)::INTEGER AS t FROM embeddings GROUP BY 1, 2)"


def _sets(spark, d):
    return _sets_of(spark.read.parquet(f"{d}/embeddings.parquet"))


def _sets_of(e):
    start = (F.min("vec_id") % 60).cast("int") + 1
    return e.groupBy(F.expr("if(vec_id % 2 = 0, 'even', 'odd')").alias("source"), F.concat(F.lit("set"), F.col("label").cast("string")).alias("name")).agg(start.alias("from"), (start + 4 + (F.count(F.lit(1)) % 7).cast("int")).alias("to")).withColumns({"pos": F.lit(0), "stride": F.lit(1)})


@query("charset_overlaps", "WITH " + SQL_SETS + " SELECT x.source, x.name AS a, y.name AS b, greatest(x.f, y.f) AS first, least(x.t, y.t) AS last FROM cs x JOIN cs y ON x.source = y.source AND x.name < y.name AND x.f <= y.t AND y.f <= x.t")
def charset_overlaps(spark, d):
    return charsets.check_overlaps(_sets(spark, d))


@query("split_by_charset", X.sql("SELECT name, ord, title, substr(seq, f, t - f + 1) AS seq FROM s JOIN cs ON cs.source = CASE WHEN ord % 2 = 0 THEN 'even' ELSE 'odd' END WHERE f <= length(seq)", SQL_SETS))
def split_by_charset(spark, d):
    s = X.sequences(spark, d).withColumn("source", F.expr("if(ord % 2 = 0, 'even', 'odd')"))
    return charsets.split_by_charset(s, _sets(spark, d))


@query("combine_intervals", "WITH " + SQL_SETS + ", m AS (SELECT source AS name, f, t, max(t) OVER (PARTITION BY source ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM cs), k AS (SELECT *, sum(CASE WHEN b IS NULL OR f > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS grp FROM m) SELECT name, min(f) AS \"from\", max(t) AS \"to\" FROM k GROUP BY name, grp")
def combine_intervals(spark, d):
    return charsets.combine_intervals(_sets(spark, d).select(F.col("source").alias("name"), "from", "to"))


@query("rebase_positions", "WITH " + SQL_SETS + ", tr(pos, f) AS (VALUES (1, 2), (2, 3), (3, 1)) SELECT source, name, pos, min(p - cs.f + 1) AS \"from\", min(least(cs.t, 64) - cs.f + 1) AS \"to\", 3 AS stride FROM cs CROSS JOIN tr CROSS JOIN range(1, 65) r(p) WHERE (p - tr.f) % 3 = 0 AND p >= tr.f AND p BETWEEN cs.f AND cs.t GROUP BY source, name, pos")
def rebase_positions(spark, d):
    cuts = _sets(spark, d)
    tracks = cuts.select("source").distinct().withColumn("x", F.explode(F.expr("array(named_struct('pos', 1, 'from', 2), named_struct('pos', 2, 'from', 3), named_struct('pos', 3, 'from', 1))")))
    return charsets.rebase_positions(tracks.select("source", F.lit("all").alias("name"), "x.pos", "x.from", F.lit(64).alias("to"), F.lit(3).alias("stride")), cuts)
