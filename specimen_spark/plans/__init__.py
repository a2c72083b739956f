"""The registered queries over the driver's tables, and their SQL twins."""

from . import exports, files, fixtures, grids, lists, pairwise

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (lists, pairwise, grids, files, exports):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)

#: Also asked of sequences of unequal lengths, of many words, short ones and ones of equal titles among them.
_RAGGED = (
    "parse_titles", "normalise_profile", "consensus", "barcodes", "filter_multi", "valid_partner", "one_per_species", "pair_distances", "intraspecific_pairs", "congeneric_pairs", "k2p_distances_all",
    "transversion_distances_all", "overlap_report", "distance_band", "query_distances", "rank_neighbours", "best_match", "best_match_totals", "first_con_and_allo", "all_species_barcodes", "extreme_pairwise",
    "species_summary", "species_totals", "pairwise_summary", "distance_histogram", "standard_tables", "pairwise_explorer", "distance_analysis_species", "distance_analysis_genus", "clusters", "cluster_report",
    "species_cluster_report", "cluster_matrix", "place_in_distributions",
)
for _name in _RAGGED:
    QUERIES[f"ragged_{_name}"] = fixtures.ragged(QUERIES[_name])
    ORACLE_SQL[f"ragged_{_name}"] = fixtures.ragged_sql(ORACLE_SQL[_name])
