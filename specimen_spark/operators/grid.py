"""The sparse grid of taxa and loci: adding, renaming, concatenating, comparing loci."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import influence
from .lists import draw
from .near import near_cells
from .pairs import SCALE, in_numpy, measured, side_by_side, sides, tiled, tiles_met
from .storage import numbered, store
from ..functions.sequences import expand_ambiguity, with_planes, words_needed


def loci_of(grid: DataFrame) -> DataFrame:
    """locus, length (that of its first row) and loc_ord (0-based, by name)."""
    lengths = grid.groupBy("locus").agg(F.min_by(F.length("seq"), "ord").alias("length"))
    return lengths.withColumn("loc_ord", F.row_number().over(W.orderBy("locus")) - 1)


def add_to_grid(grid: DataFrame, new: DataFrame, locus: str) -> tuple[DataFrame, DataFrame]:
    """(grid with the new rows (ord, taxon, seq), rows refused with their reason).

    Empty rows are left out.  The first row accepted fixes the locus' length; rows of another
    length are refused.  Of rows with one taxon the longer stays, of equal ones the later.
    """
    rows = new.select(F.lit(locus).alias("locus"), "taxon", "ord", "seq", F.regexp_count("seq", F.lit("[^_?]")).alias("actual_length"), F.lit(False).alias("cancelled")).where("actual_length > 0")
    fixed = grid.where(F.col("locus") == locus).select(F.lit(0).alias("age"), F.length("seq").alias("l"), "ord").unionByName(rows.select(F.lit(1).alias("age"), F.length("seq").alias("l"), "ord"))
    rows = rows.crossJoin(F.broadcast(fixed.agg(F.min_by("l", F.struct("age", "ord")).alias("_len"))))
    refused = rows.where(F.length("seq") != F.col("_len")).select("locus", "taxon", "ord", F.lit("wrong length").alias("reason"))
    fits = rows.where(F.length("seq") == F.col("_len")).drop("_len")
    whole = grid.withColumn("_new", F.lit(0)).unionByName(fits.withColumn("_new", F.lit(1)))
    return _longest(whole, ["actual_length", "_new", "ord"]).drop("_new"), refused


def _longest(rows: DataFrame, by: list[str]) -> DataFrame:
    """The greatest row of each locus and taxon; combined before the shuffle."""
    others = [c for c in rows.columns if c not in ("locus", "taxon")]
    best = rows.groupBy("locus", "taxon").agg(F.max_by(F.struct(*others), F.struct(*by)).alias("b"))
    return best.select("locus", "taxon", "b.*").select(*rows.columns)


def grid_summary(grid: DataFrame) -> DataFrame:
    """Per taxon, without cancelled cells: loci and combined actual length."""
    return grid.where("not cancelled").groupBy("taxon").agg(F.count(F.lit(1)).alias("loci"), F.sum("actual_length").alias("combined_length"))


def grid_cells(grid: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Every taxon at every locus: lengths, N and gap counts, and a status.

    positions: codon positions (locus, pos 0 to 3); adds those that the locus has, 0 as N.
    """
    every = grid.select("taxon").distinct().crossJoin(loci_of(grid).select("locus", "length"))
    cells = every.join(grid, ["locus", "taxon"], "left")
    status = F.when(F.col("seq").isNull(), "no data").when(F.col("cancelled"), "excised").otherwise("ok")
    out = cells.select("locus", "taxon", status.alias("status"), "actual_length", F.regexp_count("seq", F.lit("N")).alias("n_count"), F.regexp_count("seq", F.lit("-")).alias("indels"))
    if positions is None:
        return out
    label = F.when(F.col("pos") == 0, "N").otherwise(F.col("pos").cast("string"))
    known = positions.groupBy("locus").agg(F.array_join(F.sort_array(F.collect_set(label)), ", ").alias("codon_positions"))
    return out.join(known, "locus", "left")


def concatenate(grid: DataFrame, mode: str = "complete") -> DataFrame:
    """taxon and its sequence over all loci by name; complete fills absent cells with `?`.

    Where grid has a column `kind` and a taxon's cells are not all DNA, the ambiguity codes of those
    that are become the bases they stand for, in brackets.
    """
    present = grid.where("not cancelled")
    if "kind" in grid.columns:
        mixed = present.groupBy("taxon").agg(F.max(F.col("kind") != "DNA").alias("_mixed"))
        present = present.join(mixed, "taxon").withColumn("seq", F.when(F.col("_mixed") & (F.col("kind") == "DNA"), expand_ambiguity(F.col("seq"))).otherwise(F.col("seq")))
    if mode == "complete":
        every = present.select("taxon").distinct().crossJoin(loci_of(grid).select("locus", "length"))
        present = every.join(present.select("locus", "taxon", "seq"), ["locus", "taxon"], "left").withColumn("seq", F.coalesce("seq", F.expr("repeat('?', length)")))
    parts = F.array_sort(F.collect_list(F.struct("locus", "seq")))
    return present.groupBy("taxon").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))


def second_word(name: Column) -> Column:
    """The word after the first, where a name begins with two; else null."""
    return F.nullif(F.regexp_extract(name, r"^\w+\s+(\w+)\b", 1), F.lit(""))


def rows_in_order(grid: DataFrame, kind: str = "taxon", reference: str | None = None) -> DataFrame:
    """taxon, loci, combined_length and place (from 1): the grid's rows in an order.

    kind: taxon; second (word of the name, names without one last); loci or length (most first).
    The reference taxon comes first; ties are in order of the names.  Cancelled cells don't count.
    """
    rows = grid.select("taxon").distinct().join(grid_summary(grid), "taxon", "left").select("taxon", F.coalesce("loci", F.lit(0)).alias("loci"), F.coalesce("combined_length", F.lit(0)).alias("combined_length"))
    keys = {"taxon": [], "second": [second_word(F.col("taxon")).asc_nulls_last()], "loci": [F.desc("loci")], "length": [F.desc("combined_length")]}[kind]
    first = [] if reference is None else [F.when(F.col("taxon") == reference, 0).otherwise(1)]
    return numbered(rows, [*first, *keys, F.col("taxon")])


def grid_to_list(grid: DataFrame) -> DataFrame:
    """ord (by name), title and seq: each taxon's concatenation."""
    return numbered(concatenate(grid), [F.col("taxon")], "ord").select("ord", F.col("taxon").alias("title"), "seq")


def locus_to_list(grid: DataFrame, locus: str) -> DataFrame:
    """ord (by name), title and seq: the live cells of one locus."""
    rows = grid.where((F.col("locus") == locus) & ~F.col("cancelled"))
    return numbered(rows.select("taxon", "seq"), [F.col("taxon")], "ord").select("ord", F.col("taxon").alias("title"), "seq")


def charset_ranges(grid: DataFrame) -> DataFrame:
    """First and last position of each locus in the concatenation."""
    w = W.orderBy("locus").rowsBetween(W.unboundedPreceding, 0)
    return loci_of(grid).select("locus", (F.sum("length").over(w) - F.col("length") + 1).alias("first"), F.sum("length").over(w).alias("last"))


LENGTHS = (400, 600, 800, 1000, 1200, 1400, 1600, 2000, 3000, 4000)
COUNTS = (8, 7, 6, 5, 4, 3, 2)


def taxonsets(grid: DataFrame, lengths: tuple[int, ...] = LENGTHS, counts: tuple[int, ...] = COUNTS) -> DataFrame:
    """(taxonset, taxon): by combined length, by number of loci, and by locus."""
    per = grid_summary(grid)
    by_length = per.select("taxon", "combined_length", F.explode(F.array(*map(F.lit, lengths))).alias("k")).where("combined_length >= k").select(F.concat(F.lit("LENGTH_ATLEAST_"), "k").alias("taxonset"), "taxon")
    by_count = per.select("taxon", "loci", F.explode(F.array(*map(F.lit, counts))).alias("k")).where("loci >= k").select(F.concat(F.lit("CHARSETS_ATLEAST_"), "k").alias("taxonset"), "taxon")
    by_locus = grid.where("not cancelled").select(F.concat(F.lit("TAXA_HAVING_"), "locus").alias("taxonset"), "taxon")
    return by_length.unionByName(by_count).unionByName(by_locus)


def cancel(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """Toggles the cells (locus, taxon); a null locus means the whole row."""
    cells = cells.select("locus", "taxon").distinct()
    one = cells.where("locus is not null").withColumn("_one", F.lit(True))
    row = cells.where("locus is null").select("taxon", F.lit(True).alias("_row"))
    marked = grid.join(one, ["locus", "taxon"], "left").join(row, "taxon", "left")
    return marked.withColumn("cancelled", F.when(F.col("_one") | F.col("_row"), ~F.col("cancelled")).otherwise(F.col("cancelled"))).select(*grid.columns)


def drop_locus(grid: DataFrame, locus: str) -> DataFrame:
    return grid.where(F.col("locus") != locus)


def drop_taxon(grid: DataFrame, taxon: str) -> DataFrame:
    return grid.where(F.col("taxon") != taxon)


def rename_taxa(grid: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(renamed grid, cells that gave way): per locus the longer stays, of equal ones the one there before."""
    m = mapping.select(F.col("taxon").alias("_f"), F.col("new_taxon").alias("_n"))
    moved = grid.join(m, F.col("taxon") == F.col("_f"), "left").withColumn("_old", F.when(F.col("_n").isNull(), 1).otherwise(0))
    moved = moved.withColumn("_was", F.col("taxon")).withColumn("taxon", F.coalesce("_n", "taxon")).drop("_f", "_n").withColumn("_back", -F.col("ord"))
    won = _longest(moved, ["actual_length", "_old", "_back"])
    lost = moved.join(won.select("locus", "taxon", F.col("_was").alias("_won")), ["locus", "taxon"]).where("_was <> _won")
    return won.select(*grid.columns), lost.select("locus", "taxon", F.col("_was").alias("dropped"), F.col("_won").alias("kept"))


def cell_distances(grid: DataFrame, method: str = "uncorrected", min_overlap: int = 0, lo: float = 0.0, hi: float = float("inf")) -> DataFrame:
    """(locus, taxon, other, overlap, dist) of the live cells of each locus, both directions, with lo <= dist <= hi.

    Cells of a locus are dealt out over tiles, as one locus may hold all rows; long ones are compared in numpy.
    """
    rows = grid.where("not cancelled")
    words = words_needed(rows)
    cells = rows.select("locus", "taxon", "seq")
    if in_numpy(words, method):
        out = tiles_met(tiled(cells, ["locus"], "taxon", rows.count()), "locus", "taxon", words, method, min_overlap).withColumnsRenamed({"a": "taxon", "b": "other"})
    else:
        r = tiled(with_planes(cells, words).drop("seq"), ["locus"], "taxon", rows.count())
        x, y, met = sides(r, "taxon", method)
        on = (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.locus") == F.col("y.locus")) & met
        out = measured(x.join(y, on), words, method, min_overlap, ["x.locus as locus", "x.taxon as taxon", "y.taxon as other"])
    out = out.where(F.col("dist").between(lo, hi))
    side = lambda a, b: F.struct("locus", F.col(a).alias("taxon"), F.col(b).alias("other"), "overlap", "dist")
    return out.select(F.explode(F.array(side("taxon", "other"), side("other", "taxon"))).alias("p")).select("p.*")


def find_distances(grid: DataFrame, lo: float, hi: float, locus: str | None = None, min_overlap: int = 0) -> DataFrame:
    """Pairs of cells of a locus whose distance lies in the band, both directions."""
    cells = grid if locus is None else grid.where(F.col("locus") == locus)
    if hi >= 1:
        return cell_distances(cells, "uncorrected", min_overlap, lo, hi)
    # what is near leaves its tile, and the rest is never measured
    return near_cells(cells, math.ceil(hi * SCALE) / SCALE, min_overlap).where(F.col("dist").between(lo, hi))


def influence_of_all(grid: DataFrame, method: str = "transversions", min_overlap: int = 1, top: int = 10) -> DataFrame:
    """correlation_influence with every taxon as the reference: reference, locus, taxon, average_r, place.

    By a method of a user's own, or where a taxon has two cells at a locus, all distances are joined.
    """
    if method in influence.METHODS:
        cells = store(grid.where("not cancelled and locus is not null and taxon is not null and seq is not null").select("locus", "taxon", "seq"))
        if cells.count() == cells.select("locus", "taxon").distinct().count():
            return influence.influence(cells, grid.agg(F.count_distinct("locus")).first()[0], method, min_overlap, top)
    dists = cell_distances(grid, method, min_overlap).select(F.col("other").alias("reference"), "locus", "taxon", "dist", F.lit("ok").alias("status"))
    return correlation_influence(dists, top, ["reference"], grid.agg(F.count_distinct("locus").alias("k")))


def reference_distances(grid: DataFrame, taxon: str, method: str = "transversions", min_overlap: int = 1) -> DataFrame:
    """Per locus and taxon the distance to the reference taxon, with a status where there is none."""
    words = words_needed(grid)
    rows = grid.where("not cancelled").select("locus", "taxon", "seq")
    by_row = in_numpy(words, method)
    if not by_row:
        rows = with_planes(rows, words).drop("seq")
    ref = rows.where(F.col("taxon") == taxon)  # one row per locus
    joined = rows.alias("x").join(ref.alias("y"), F.col("x.locus") == F.col("y.locus"))
    if by_row:
        got = side_by_side(joined.select("x.locus", "x.taxon", F.col("x.seq").alias("seq"), F.col("y.seq").alias("other_seq")), words, method, min_overlap)
    else:
        got = measured(joined, words, method, min_overlap, ["x.locus as locus", "x.taxon as taxon"])
    every = grid.select("taxon").distinct().crossJoin(loci_of(grid).select("locus"))
    have = grid.select("locus", "taxon", "cancelled")
    refs = grid.where((F.col("taxon") == taxon) & ~F.col("cancelled")).select("locus", F.lit(True).alias("has_ref"))
    out = every.join(have, ["locus", "taxon"], "left").join(refs, "locus", "left").join(got, ["locus", "taxon"], "left")
    status = (
        F.when(F.col("taxon") == taxon, "reference").when(F.col("cancelled").isNull(), "no data").when(F.col("cancelled"), "excised")
        .when(F.col("has_ref").isNull(), "no reference").when(F.col("dist").isNull(), "no overlap").otherwise("ok")
    )
    return out.select("locus", "taxon", status.alias("status"), F.when(status == "ok", F.col("dist")).alias("dist"))


def normalise_distances(dists: DataFrame) -> DataFrame:
    """Distances of each locus scaled to [0, 1] over its valid cells."""
    ends = dists.groupBy("locus").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    scaled = F.coalesce(F.try_divide(F.col("dist") - F.col("lo"), F.col("hi") - F.col("lo")), F.when(F.col("dist").isNotNull(), F.lit(0.0)))
    return dists.join(ends, "locus").withColumn("scaled", scaled).drop("lo", "hi")


def taxon_scores(scaled: DataFrame, exclude: str | None = None) -> DataFrame:
    rows = scaled if exclude is None else scaled.where(F.col("locus") != exclude)
    return rows.groupBy("taxon").agg(F.round(F.avg("scaled"), 9).alias("score"))


def locus_ranks(dists: DataFrame) -> DataFrame:
    """0-based competition rank within a locus; counts per distance keep the window small."""
    per = dists.where("dist is not null").groupBy("locus", "dist").agg(F.count(F.lit(1)).alias("n"))
    rank = F.coalesce(F.sum("n").over(W.partitionBy("locus").orderBy("dist").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dists.join(per.select("locus", "dist", rank.alias("rank")), ["locus", "dist"]).select("locus", "taxon", "dist", "rank")


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _r(n, sx, sy, sxx, syy, sxy):
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy))).otherwise(F.lit(0.0))


def _pair_terms(dists: DataFrame, keys: list[str]) -> DataFrame:
    d = dists.where("status = 'ok'").select(*keys, "locus", "taxon", "dist")
    one, two = d.withColumnsRenamed({"locus": "l1", "dist": "dx"}), d.withColumnsRenamed({"locus": "l2", "dist": "dy"})
    return one.join(two, [*keys, "taxon"]).where("l1 < l2")


def _sums(terms: DataFrame, keys: list[str]) -> DataFrame:
    return terms.groupBy(*keys, "l1", "l2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("dy") * F.col("dy")).alias("syy"), F.sum(F.col("dx") * F.col("dy")).alias("sxy"),
    )


def locus_correlation(dists: DataFrame) -> DataFrame:
    """Pearson r of each pair of loci over taxa that have both; 0 without variance, 1 with itself."""
    between = _sums(_pair_terms(dists, []), []).select("l1", "l2", F.round(_r(*map(F.col, _SUMS)), 7).alias("r"))
    own = dists.select(F.col("locus").alias("l1"), F.col("locus").alias("l2")).distinct().withColumn("r", F.lit(1.0))
    return between.unionByName(own)


def average_r(correlation: DataFrame) -> DataFrame:
    return correlation.agg(F.round(F.avg("r"), 7).alias("average_r"))


def correlation_influence(dists: DataFrame, top: int = 10, keys: list[str] | None = None, loci: DataFrame | None = None) -> DataFrame:
    """Per locus the cells without which the average r would be highest, unchanged ones left out.

    Each cell's terms are subtracted from the sums of its locus pairs; nothing is scanned again.
    keys: columns of dists that keep several references apart; loci: one row with their number k.
    """
    keys = keys or []
    terms = _pair_terms(dists, keys)
    sums = _sums(terms, keys)
    loci = F.broadcast(dists.agg(F.count_distinct("locus").alias("k")) if loci is None else loci)
    whole = sums.groupBy(*keys).agg(F.sum(_r(*map(F.col, _SUMS))).alias("all_r"))
    t = terms.join(sums, [*keys, "l1", "l2"])
    less = _r(F.col("n") - 1, F.col("sx") - F.col("dx"), F.col("sy") - F.col("dy"), F.col("sxx") - F.col("dx") * F.col("dx"), F.col("syy") - F.col("dy") * F.col("dy"), F.col("sxy") - F.col("dx") * F.col("dy"))
    change = t.select(*keys, "taxon", F.explode(F.array("l1", "l2")).alias("locus"), (less - _r(*map(F.col, _SUMS))).alias("delta"))
    cells = change.groupBy(*keys, "locus", "taxon").agg(F.sum("delta").alias("delta")).crossJoin(loci)
    cells = cells.join(whole, keys) if keys else cells.crossJoin(F.broadcast(whole))
    pairs = F.col("k") * (F.col("k") + 1) / 2
    cells = cells.select(*keys, "locus", "taxon", F.round((F.col("all_r") + F.col("k") + F.col("delta")) / pairs, 7).alias("average_r"), F.round((F.col("all_r") + F.col("k")) / pairs, 7).alias("now")).where("average_r <> now")
    rank = F.row_number().over(W.partitionBy(*keys, "locus").orderBy(F.desc("average_r"), "taxon"))
    return cells.withColumn("place", rank).where(F.col("place") <= top).select(*keys, "locus", "taxon", "average_r", "place")


def random_locus_groups(grid: DataFrame, size: int, replicates: int, delete: int = 0, protect: str | None = None, seed: int = 0, include_na: bool = False) -> DataFrame:
    """replicate, locus and its group of `size` loci; `delete` random taxa per group leave, one stays.

    include_na: each taxon of a group gets a row of missing characters where it lacks one of its loci.
    """
    loci = grid.select("locus").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    order = F.row_number().over(W.partitionBy("replicate").orderBy(draw(seed, "replicate", "locus"), "locus"))
    groups = loci.withColumn("group", F.floor((order - 1) / size))
    cells = grid.join(groups, "locus")
    if include_na:
        every = cells.select("replicate", "group", "taxon").distinct().join(groups, ["replicate", "group"]).join(loci_of(grid).select("locus", "length"), "locus")
        missing = every.join(cells.select("replicate", "group", "locus", "taxon"), ["replicate", "group", "locus", "taxon"], "left_anti").withColumn("seq", F.expr("repeat('?', length)"))
        cells = cells.unionByName(missing.drop("length"), allowMissingColumns=True)
    if not delete:
        return cells
    taxa = cells.select("replicate", "group", "taxon").distinct()
    if protect is not None:
        taxa = taxa.where(F.col("taxon") != protect)
    gone = taxa.withColumn("_r", F.row_number().over(W.partitionBy("replicate", "group").orderBy(draw(seed, "replicate", "group", "taxon"), "taxon"))).where(F.col("_r") <= delete)
    return cells.join(gone.drop("_r"), ["replicate", "group", "taxon"], "left_anti")
