"""Queries on pairs: distances, ranking, identification, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import match_line
from ..operators import every, near, pairs, ranking, summaries, tiles
from ..operators.reference import KeptReference
from ..operators.storage import fresh_path
from . import fixtures as X

QUERIES, ORACLE_SQL = {}, {}
PAIRS = (X.SQL_CHARS, X.SQL_PAIRS)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def measured(spark, d, columns="overlap int, dist double", **kw):
    return every.every_pair(X.sequences(spark, d), columns, min_overlap=X.MIN_OVERLAP, **kw)


def counted(spark, d, scope, twice=True):
    return tiles.distance_counts(X.sequences(spark, d), scope, X.MIN_OVERLAP, twice=twice)


@query("pair_distances", X.sql("SELECT a, b, overlap, dist, bucket FROM pr", *PAIRS))
def pair_distances(spark, d):
    return measured(spark, d, "overlap int, dist double, bucket long")


@query("intraspecific_pairs", X.sql("SELECT a, b, overlap, dist FROM pr WHERE species_a = species_b", *PAIRS))
def intraspecific(spark, d):
    return measured(spark, d, scope="intra")


@query("congeneric_pairs", X.sql("SELECT a, b, overlap, dist FROM pr WHERE genus_a = genus_b AND species_a <> species_b", *PAIRS))
def congeneric(spark, d):
    return measured(spark, d, scope="inter_congeneric")


SQL_K2P = X.sql(f"""SELECT a, b, overlap, CASE WHEN 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN round(greatest(0.0, -0.5 * ln(1 - 2 * p - q) - 0.25 * ln(1 - 2 * q)), 6) END AS dist
  FROM (SELECT a, b, overlap, ts / n AS p, tv / n AS q FROM (SELECT x.ord AS a, y.ord AS b, sum(CASE WHEN x.m > 0 AND y.m > 0 THEN 1 ELSE 0 END)::INTEGER AS overlap,
      sum(CASE WHEN (x.p OR x.y) AND (y.p OR y.y) THEN 1 ELSE 0 END)::DOUBLE AS n, sum(CASE WHEN (x.p AND y.y) OR (x.y AND y.p) THEN 1 ELSE 0 END)::DOUBLE AS tv,
      sum(CASE WHEN ((x.p AND y.p) OR (x.y AND y.y)) AND x.m <> y.m THEN 1 ELSE 0 END)::DOUBLE AS ts
    FROM c x JOIN c y ON x.pos = y.pos AND x.ord < y.ord AND x.species = y.species GROUP BY 1, 2) WHERE overlap >= {X.MIN_OVERLAP} AND n > 0)""", X.SQL_CHARS)
#: The same over all pairs.
SAME_SPECIES = " AND x.species = y.species"


@query("k2p_distances", SQL_K2P)
def k2p(spark, d, scope="intra"):
    return measured(spark, d, scope=scope, method="k2p", valid_only=False, digits=6)


@query("k2p_distances_all", SQL_K2P.replace(SAME_SPECIES, ""))
def k2p_all(spark, d):
    return k2p(spark, d, "all")


SQL_TRANSVERSIONS = X.sql(f"""SELECT a, b, overlap, tv / overlap AS dist FROM (SELECT x.ord AS a, y.ord AS b,
    sum(CASE WHEN ((x.p OR x.y) AND (y.p OR y.y)) THEN 1 ELSE 0 END + CASE WHEN (x.i AND (y.m > 0 OR y.i)) OR (y.i AND x.m > 0) THEN 1 ELSE 0 END)::INTEGER AS overlap,
    sum(CASE WHEN (x.p AND y.y) OR (x.y AND y.p) THEN 1 ELSE 0 END)::DOUBLE AS tv FROM c x JOIN c y ON x.pos = y.pos AND x.ord < y.ord AND x.species = y.species GROUP BY 1, 2) WHERE overlap >= {X.MIN_OVERLAP}""", X.SQL_CHARS)


@query("transversion_distances", SQL_TRANSVERSIONS)
def transversions(spark, d, scope="intra"):
    return measured(spark, d, scope=scope, method="transversions")


@query("transversion_distances_all", SQL_TRANSVERSIONS.replace(SAME_SPECIES, ""))
def transversions_all(spark, d):
    return transversions(spark, d, "all")


@query("overlap_report", X.sql("""SELECT x.ord AS a, y.ord AS b, x.species AS species, sum(CASE WHEN (x.m > 0 AND y.m > 0) OR (x.i AND (y.m > 0 OR y.i)) OR (y.i AND x.m > 0) THEN 1 ELSE 0 END)::INTEGER AS overlap
  FROM c x JOIN c y ON x.pos = y.pos AND x.ord < y.ord AND x.species = y.species GROUP BY ALL""", X.SQL_CHARS))
def overlap_report(spark, d):
    return every.every_pair(X.sequences(spark, d), "species string, overlap int", min_overlap=0, scope="intra", valid_only=False)


@query("distance_band", X.sql("SELECT a, b, dist FROM pr WHERE dist BETWEEN 0.02 AND 0.05", *PAIRS))
def distance_band(spark, d):
    return near.distance_band(X.sequences(spark, d), 0.02, 0.05, X.MIN_OVERLAP).select("a", "b", "dist")


@query("near_pairs", X.sql("SELECT a, b, species_a, species_b, genus_a, genus_b, twins, overlap, dist, bucket FROM pr WHERE bucket <= 3000", *PAIRS))
def near_pairs(spark, d):
    """By segments, or inside tiles where very many pairs have segments in common."""
    return near.near_pairs(X.sequences(spark, d), 0.03, X.MIN_OVERLAP)


@query("near_distance_band", X.sql("SELECT a, b, dist FROM pr WHERE dist BETWEEN 0.02 AND 0.05", *PAIRS))
def near_distance_band(spark, d):
    return near.distance_band(X.sequences(spark, d), 0.02, 0.05, X.MIN_OVERLAP).select("a", "b", "dist")


@query("near_best_match", X.sql("""SELECT q, species_q, best_bucket, best_dist, ties, species_in_block, has_conspecific FROM (SELECT s.ord AS q, any_value(s.species) AS species_q, min(m.bucket) AS best_bucket, min(m.dist) AS best_dist, count(*) AS ties, count(DISTINCT coalesce(m.species_m, '#' || m.m)) AS species_in_block, max(coalesce(m.species_q = m.species_m, false)) AS has_conspecific
  FROM s JOIN mir m ON m.q = s.ord JOIN (SELECT q, min(bucket) AS b FROM mir GROUP BY q) n ON n.q = m.q AND m.bucket = n.b WHERE m.bucket <= 3000 GROUP BY s.ord)""", *PAIRS))
def near_best_match(spark, d):
    """The nearest block of each sequence that has a neighbour within the threshold."""
    got = near.near_best_match(X.sequences(spark, d), 0.03, X.MIN_OVERLAP)
    return got.select("q", "species_q", "best_bucket", "best_dist", "ties", "species_in_block", "has_conspecific")


@query("query_distances", X.sql("SELECT q, m, overlap, dist, round(dist * overlap)::INTEGER AS mismatches FROM mir WHERE q % 50 = 0", *PAIRS))
def query_distances(spark, d):
    s = X.sequences(spark, d)
    return every.query_pairs(s.where("ord % 50 = 0"), s, "overlap int, dist double, mismatches int", X.MIN_OVERLAP)


@query("kept_reference", X.sql("SELECT q, m, overlap, dist, round(dist * overlap)::INTEGER AS mismatches FROM mir WHERE q % 50 = 0", *PAIRS))
def kept_reference(spark, d):
    s = X.sequences(spark, d)
    kept = KeptReference.make(s, fresh_path(spark, "reference"))
    return kept.distances(s.where("ord % 50 = 0"), min_overlap=X.MIN_OVERLAP).select("q", "m", "overlap", "dist", "mismatches")


@query("match_lines", X.sql("SELECT x.ord AS a, y.ord AS b, string_agg(CASE WHEN (x.m & y.m) > 0 THEN '|' ELSE ' ' END, '' ORDER BY x.pos) AS line FROM c x JOIN c y ON y.ord = x.ord + 1 AND x.pos = y.pos GROUP BY 1, 2", X.SQL_CHARS))
def match_lines(spark, d):
    s = X.sequences(spark, d).select("ord", "seq")
    x, y = s.alias("x"), s.alias("y")
    return x.join(y, F.col("y.ord") == F.col("x.ord") + 1).select(F.col("x.ord").alias("a"), F.col("y.ord").alias("b"), match_line(F.col("x.seq"), F.col("y.seq")).alias("line"))


RANKED = "rk AS MATERIALIZED (SELECT *, coalesce(species_q = species_m, false) AS con, row_number() OVER (PARTITION BY q ORDER BY bucket, coalesce(species_q = species_m, false) DESC, m) AS rank FROM mir)"


@query("rank_neighbours", X.sql("SELECT q, m, rank, dist FROM rk", *PAIRS, RANKED))
def rank_neighbours(spark, d):
    return ranking.rank_neighbours_of(X.sequences(spark, d), X.MIN_OVERLAP)


def _best(threshold: float) -> str:
    return f"""bm AS MATERIALIZED (SELECT s.ord AS q, s.species AS species_q, t.* EXCLUDE (q),
  CASE WHEN s.species IS NULL THEN 'unnamed' WHEN best_bucket IS NULL THEN 'no match' WHEN species_in_block > 1 AND has_conspecific THEN 'ambiguous' WHEN has_conspecific THEN 'correct' ELSE 'incorrect' END AS verdict
  FROM s LEFT JOIN (SELECT q, min(bucket) AS best_bucket, min(dist) AS best_dist, count(*) AS ties, count(DISTINCT coalesce(species_m, '#' || m)) AS species_in_block, bool_or(coalesce(species_q = species_m, false)) AS has_conspecific
    FROM (SELECT *, min(bucket) OVER (PARTITION BY q) AS best FROM mir) WHERE bucket = best GROUP BY q) t ON s.ord = t.q)"""


def _close(threshold: float) -> str:
    return f"CASE WHEN species_q IS NULL THEN 'unnamed' WHEN best_bucket > {int(round(threshold * 100_000))} THEN 'beyond threshold' ELSE verdict END"


@query("best_match", X.sql(f"SELECT *, {_close(0.03)} AS close_verdict FROM bm", *PAIRS, _best(0.03)))
def best_match(spark, d):
    return ranking.best_match_of(X.sequences(spark, d), 0.03, X.MIN_OVERLAP)


@query("best_match_totals", X.sql(f"SELECT verdict, {_close(0.08)} AS close_verdict, count(*) AS queries, sum(CASE WHEN best_bucket = 0 THEN 1 ELSE 0 END)::BIGINT AS at_zero FROM bm GROUP BY 1, 2", *PAIRS, _best(0.08)))
def best_match_totals(spark, d):
    return ranking.best_match_totals(ranking.best_match_of(X.sequences(spark, d), 0.08, X.MIN_OVERLAP))


@query("first_con_and_allo", X.sql("""SELECT q, c.m AS con, c.dist AS con_dist, c.overlap AS con_overlap, o.m AS allo, o.dist AS allo_dist, o.overlap AS allo_overlap FROM (SELECT DISTINCT q FROM mir)
  LEFT JOIN (SELECT q, m, dist, overlap FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket, m) AS r FROM rk WHERE con) WHERE r = 1) c USING (q)
  LEFT JOIN (SELECT q, m, dist, overlap FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket, m) AS r FROM rk WHERE NOT con) WHERE r = 1) o USING (q)""", *PAIRS, RANKED))
def first_con_and_allo(spark, d):
    return ranking.first_con_and_allo_of(X.sequences(spark, d), X.MIN_OVERLAP)


@query("all_species_barcodes", X.sql("""SELECT s.ord AS q, s.species, f.species_m AS first_species, coalesce(e.stop - 1, t.n) AS run,
  CASE WHEN f.bucket IS NULL OR f.bucket > 3000 THEN 'no match' WHEN coalesce(e.stop - 1, t.n) = 1 THEN 'ambiguous' WHEN f.species_m = s.species AND coalesce(e.stop - 1, t.n) = coalesce(v.n, 0) - 1 THEN 'correct'
       WHEN f.species_m <> s.species AND coalesce(e.stop - 1, t.n) = coalesce(v.n, 0) THEN 'incorrect' ELSE 'ambiguous' END AS verdict
  FROM s LEFT JOIN (SELECT q, species_m, bucket FROM rn WHERE rank = 1) f ON f.q = s.ord
  LEFT JOIN (SELECT r.q, min(r.rank) AS stop FROM rn r JOIN rn f ON f.q = r.q AND f.rank = 1 AND f.species_m <> r.species_m GROUP BY 1) e ON e.q = s.ord
  LEFT JOIN (SELECT q, count(*) AS n FROM rn GROUP BY 1) t ON t.q = s.ord
  LEFT JOIN (SELECT species_q AS species, count(DISTINCT q) AS n FROM mir WHERE species_q = species_m GROUP BY 1) v ON v.species = f.species_m
  WHERE s.species IS NOT NULL""", *PAIRS, "rn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket, coalesce(species_q = species_m, false) DESC, m) AS rank FROM mir WHERE species_m IS NOT NULL)"))
def all_species_barcodes(spark, d):
    return ranking.all_species_barcodes_of(X.sequences(spark, d), 0.03, X.MIN_OVERLAP)


@query("extreme_pairwise", X.sql("""SELECT q, f.m AS far_con, f.dist AS far_dist, f.overlap AS far_overlap, n.m AS near_allo, n.dist AS near_dist, n.overlap AS near_overlap FROM (SELECT DISTINCT q FROM mir)
  LEFT JOIN (SELECT q, m, dist, overlap FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket DESC, m) AS r FROM mir WHERE species_q = species_m) WHERE r = 1) f USING (q)
  LEFT JOIN (SELECT q, m, dist, overlap FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket, m) AS r FROM mir WHERE genus_q = genus_m AND species_q <> species_m) WHERE r = 1) n USING (q)""", *PAIRS))
def extreme_pairwise(spark, d):
    return ranking.extreme_pairwise_of(X.sequences(spark, d), X.MIN_OVERLAP)


@query("species_summary", X.sql("""SELECT species, count(*) AS total, count(v.ord) AS valid, count(*) - count(v.ord) AS invalid, max(length(regexp_replace(seq, '[_?]', '', 'g'))) AS longest, sum(CASE WHEN length(seq) < 40 THEN 1 ELSE 0 END)::BIGINT AS short, string_agg(gi, ',' ORDER BY ord) AS gis
  FROM s LEFT JOIN (SELECT DISTINCT q AS ord FROM mir WHERE species_q = species_m) v USING (ord) WHERE species IS NOT NULL GROUP BY species""", *PAIRS))
def species_summary(spark, d):
    return summaries.species_summary_of(X.sequences(spark, d), X.MIN_OVERLAP)


@query("species_totals", X.sql("""SELECT (SELECT count(*) FROM s) AS sequences, (SELECT count(DISTINCT species) FROM s) AS species, (SELECT count(*) FROM s WHERE species IS NULL) AS unnamed, (SELECT count(*) FROM s WHERE length(seq) < 40) AS short,
  count(DISTINCT q) AS valid_sequences, count(DISTINCT species_q) AS valid_species, floor(floor(count(DISTINCT species_q)::DOUBLE / (SELECT count(DISTINCT species) FROM s) * 100000) / 100000 * 10000) / 100 AS valid_percent FROM mir WHERE species_q = species_m""", *PAIRS))
def species_totals(spark, d):
    s = X.sequences(spark, d)
    return summaries.species_totals(s, summaries.species_summary_of(s, X.MIN_OVERLAP), X.MIN_OVERLAP)


@query("pairwise_summary", X.sql("""SELECT *, floor(floor(inside::DOUBLE / (n_intra + n_inter) * 100000) / 100000 * 10000) / 100 AS inside_percent FROM (SELECT o.*,
    (SELECT count(*) FROM dd WHERE dist BETWEEN min_inter AND max_intra) AS inside, (SELECT count(*) FROM dd WHERE dist BETWEEN trimmed_inter AND trimmed_intra) AS inside_trimmed
  FROM (SELECT min(dist) FILTER (k = 'intra') AS min_intra, max(dist) FILTER (k = 'intra') AS max_intra, count(*) FILTER (k = 'intra') AS n_intra, min(dist) FILTER (k = 'inter') AS min_inter, max(dist) FILTER (k = 'inter') AS max_inter, count(*) FILTER (k = 'inter') AS n_inter,
      coalesce(min(dist) FILTER (k = 'intra' AND 20 * down < n), max(dist) FILTER (k = 'intra')) AS trimmed_intra, max(dist) FILTER (k = 'inter' AND (up = 1 OR 20 * (up - 1) < n)) AS trimmed_inter FROM dd) o)""", *PAIRS,
    "dd AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY dist) AS up, row_number() OVER (PARTITION BY k ORDER BY dist DESC) AS down FROM (SELECT dist, CASE WHEN species_a = species_b THEN 'intra' ELSE 'inter' END AS k, unnest(range(CASE WHEN species_a = species_b AND twins THEN 2 ELSE 1 END)) AS copy FROM pr WHERE species_a = species_b OR (genus_a = genus_b AND species_a <> species_b)))"))
def pairwise_summary(spark, d):
    return summaries.pairwise_summary_of(counted(spark, d, "intra"), counted(spark, d, "inter_congeneric"))


@query("distance_histogram", X.sql("""SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cumulative FROM (SELECT bin::INTEGER AS bin, (SELECT count(*) FROM pr WHERE species_a = species_b AND CASE WHEN bin = 0 THEN dist <= 0.0 WHEN bin = 31 THEN dist > 0.3 ELSE dist >= (0.0 + 1e-6)::DOUBLE + 0.01::DOUBLE * (bin - 1) AND dist <= (0.0 + 1e-6)::DOUBLE + 0.01::DOUBLE * bin END) AS n FROM range(32) t(bin))""", *PAIRS))
def distance_histogram(spark, d):
    return summaries.distance_histogram(counted(spark, d, "intra", False), 0.0, 0.3, 0.01)


@query("standard_tables", X.sql("""SELECT k AS kind, hi AS "to", step, bin, n, sum(n) OVER (PARTITION BY k, hi, step ORDER BY bin DESC)::BIGINT AS cumulative FROM (SELECT k, hi, step, bin::INTEGER AS bin, (SELECT coalesce(sum(n), 0)::BIGINT FROM ct WHERE ct.k = t.k AND CASE WHEN bin = 0 THEN dist <= 0.0 WHEN bin = steps + 1 THEN dist > hi ELSE dist >= (0.0 + 1e-6)::DOUBLE + step * (bin - 1) AND dist <= (0.0 + 1e-6)::DOUBLE + step * bin END) AS n
  FROM (SELECT k, hi::DOUBLE AS hi, step::DOUBLE AS step, steps, unnest(range(steps + 2)) AS bin FROM (VALUES ('intra'), ('inter')) a(k), (VALUES (0.2, 0.005, 40), (0.3, 0.01, 30), (1.0, 0.05, 20)) b(hi, step, steps)) t)""", *PAIRS,
    "ct AS MATERIALIZED (SELECT dist, CASE WHEN species_a = species_b THEN 'intra' ELSE 'inter' END AS k, sum(CASE WHEN species_a = species_b AND twins THEN 2 ELSE 1 END) AS n FROM pr WHERE species_a = species_b OR (genus_a = genus_b AND species_a <> species_b) GROUP BY 1, 2)"))
def standard_tables(spark, d):
    return summaries.standard_tables_of(counted(spark, d, "intra"), counted(spark, d, "inter_congeneric"), "backward")


@query("place_in_distributions", X.sql("""SELECT q, m, dist, round(100.0 * (SELECT count(*) + count(*) FILTER (p.twins) FROM pr p WHERE p.species_a = p.species_b AND p.dist > mir.dist) / (SELECT count(*) + count(*) FILTER (p.twins) FROM pr p WHERE p.species_a = p.species_b), 6) AS intra_farther,
  round(100.0 * (SELECT count(*) FROM pr p WHERE p.genus_a = p.genus_b AND p.species_a <> p.species_b AND p.dist < mir.dist) / (SELECT count(*) FROM pr p WHERE p.genus_a = p.genus_b AND p.species_a <> p.species_b), 6) AS inter_closer FROM mir WHERE q % 50 = 0""", *PAIRS))
def place_in_distributions(spark, d):
    s = X.sequences(spark, d)
    found = pairs.query_distances(s.where("ord % 50 = 0"), s, min_overlap=X.MIN_OVERLAP).select("q", "m", "dist")
    return pairs.place_in_counts(found, counted(spark, d, "intra"), counted(spark, d, "inter_congeneric"))


@query("saturated_pairs", SQL_K2P.replace("SELECT a, b, overlap, CASE WHEN", "SELECT a, b, overlap FROM (SELECT a, b, overlap, CASE WHEN", 1) + ") WHERE dist IS NULL")
def saturated_pairs(spark, d):
    return pairs.saturated(measured(spark, d, scope="intra", method="k2p", valid_only=False), X.MIN_OVERLAP).select("a", "b", "overlap")


@query("pairwise_explorer", X.sql("SELECT q, floor(dist / 0.005)::BIGINT AS class, count(*) AS members, round(avg(dist), 9) AS mean_dist FROM mir WHERE species_q = species_m GROUP BY 1, 2", *PAIRS))
def pairwise_explorer(spark, d):
    return summaries.pairwise_explorer_of(X.sequences(spark, d), min_overlap=X.MIN_OVERLAP)


CONG = "sp AS MATERIALIZED (SELECT genus, species, avg(smallest) AS smallest, avg(mean) AS mean FROM s LEFT JOIN (SELECT q, min(dist) AS smallest, avg(dist) AS mean FROM mir WHERE genus_q = genus_m AND species_q <> species_m GROUP BY q) x ON x.q = s.ord WHERE species IS NOT NULL GROUP BY genus, species)"


@query("distance_analysis_species", X.sql("SELECT genus, species, round(smallest, 9) AS smallest, round(mean, 9) AS mean FROM sp", *PAIRS, CONG))
def distance_analysis_species(spark, d):
    return summaries.distance_analysis_of(X.sequences(spark, d), X.MIN_OVERLAP)[0]


@query("distance_analysis_genus", X.sql("SELECT genus, round(avg(smallest), 9) AS smallest, round(avg(mean), 9) AS mean, count(mean) AS species_compared FROM sp GROUP BY genus", *PAIRS, CONG))
def distance_analysis_genus(spark, d):
    return summaries.distance_analysis_of(X.sequences(spark, d), X.MIN_OVERLAP)[1]
