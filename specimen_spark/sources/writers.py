"""Writers: each makes a folder of ordered text parts, never over an existing one.

Lines carry a sort key and are sorted by range, so parts are written in parallel and read in order
of their names.  Writers of grids refuse cancelled cells unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.charsets import combine_intervals
from ..operators.grid import charset_ranges, concatenate, taxonsets
from ..operators.names import first_free_names
from ..operators.storage import numbered
from .flatfile import with_minimum_species

_GAPS = ("_", "-")


def _write(lines: DataFrame, path: str, *keys: str) -> None:
    """lines: `line` and sort keys."""
    lines.sort(*keys).select("line").write.mode("error").text(path)


def wrap(seq: Column, width: int) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, rf"(.{{{width}}})", "$1\n"), r"\n$", "")


def refuse_cancelled(grid: DataFrame, allow: bool = False) -> DataFrame:
    """The live cells; an error when there are cancelled ones and they aren't allowed."""
    if not allow and not grid.where("cancelled").isEmpty():
        raise ValueError("the grid has cancelled cells; pass allow_cancelled=True to leave them out")
    return grid.where("not cancelled")


def unique_names(df: DataFrame, name: Column, most: int = 0) -> DataFrame:
    """Adds `name`, cut to `most` characters; one that a row before has gets the first free of _2, _3, ..., within `most`."""
    return df.join(first_free_names(df, name, "ord", most), df["ord"].eqNullSafe(F.col("at"))).drop("at")


def fasta_lines(df: DataFrame) -> DataFrame:
    return df.select("ord", F.concat(F.lit(">"), F.translate("title", " ", "_"), F.lit("\n"), wrap(F.translate("seq", *_GAPS), 70)).alias("line"))


def write_fasta(df: DataFrame, path: str) -> None:
    _write(fasta_lines(df), path, "ord")


def mega_lines(df: DataFrame, title: str = "sequences") -> DataFrame:
    rows = unique_names(df, F.regexp_replace(F.translate("title", " ", "_"), r"[^\w.+*-]", "_"), 40)
    lines = rows.select(F.col("ord"), F.concat(F.lit("#"), "name", F.lit("\t"), F.translate("seq", *_GAPS)).alias("line"))
    return _rows(df, [(-1, f"#MEGA\nTITLE {title}\n")], "ord long, line string").unionByName(lines)


def write_mega(df: DataFrame, path: str, title: str = "sequences") -> None:
    _write(mega_lines(df, title), path, "ord")


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _blocks(df: DataFrame, name: str, every: int) -> DataFrame:
    """Lines `name chunk [n:a-b]` of an interleaved matrix, with keys block and ord."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(every))
    rows = df.select("ord", name, "seq", F.posexplode(starts).alias("block", "at"))
    chunk = F.substring(F.col("seq"), F.col("at") + 1, F.lit(every))
    return rows.select(F.col("block").cast("long").alias("block"), "ord", F.concat(F.rpad(F.col(name), 33, " "), chunk, F.lit(" ["), F.length(chunk).cast("string"), F.lit(":"), (F.col("at") + 1).cast("string"), F.lit("-"), (F.col("at") + F.length(chunk)).cast("string"), F.lit("]")).alias("line"))


def _framed(lines: DataFrame, head: str, foot: str, more: DataFrame | None = None) -> DataFrame:
    every = lines.select("block", F.col("ord").cast("long").alias("ord"), "line").unionByName(_rows(lines, [(-1, 0, head), (1 << 40, 0, foot)], "block long, ord long, line string"))
    return every if more is None else every.unionByName(more)


def _size(rows: DataFrame) -> tuple[int, int]:
    return tuple(rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("seq")), F.lit(0))).first())


def nexus_lines(df: DataFrame, interleave_at: int = 80) -> DataFrame:
    """(block, ord, line) of a list as one interleaved DATA block, names unique and at most 32 characters."""
    rows = unique_names(df, F.regexp_replace("title", r"[^\w.]+", "_"), 32).withColumn("seq", F.translate("seq", *_GAPS))
    n, longest, plain = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("seq")), F.lit(0)), F.coalesce(F.min(F.col("seq").rlike("^[ACGTRYKMSWBDHVN?-]*$").cast("int")), F.lit(1))).first()
    head = f"#NEXUS\n\nBEGIN DATA;\n\tDIMENSIONS NTAX={n} NCHAR={longest};\n\tFORMAT DATATYPE={'DNA' if plain else 'STANDARD'} MISSING=? GAP=- INTERLEAVE;\n\tMATRIX"
    return _framed(_blocks(rows, "name", interleave_at), head, "\n;\n\nEND;")


def write_nexus(df: DataFrame, path: str, interleave_at: int = 80) -> None:
    _write(nexus_lines(df, interleave_at), path, "block", "ord")


def _set_lines(grid: DataFrame, rows: DataFrame) -> DataFrame:
    """SETS of the concatenation as lines after its matrix (block, ord, line)."""
    taxa = rows.select("taxon", F.col("ord").alias("k"))
    sets = taxonsets(grid).join(taxa, "taxon").groupBy("taxonset").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: k.cast("string")), " ").alias("ks"))
    sets = sets.select(F.concat(F.lit("\tTAXSET "), "taxonset", F.lit(" = "), "ks", F.lit(";")).alias("line"), F.lit(1).alias("kind"))
    ranges = charset_ranges(grid).select(F.concat(F.lit("\tCHARSET "), "locus", F.lit(" = "), "first", F.lit("-"), "last", F.lit(";")).alias("line"), F.lit(2).alias("kind"))
    return sets.unionByName(ranges).select(F.lit(1 << 42).alias("block"), F.row_number().over(W.orderBy("kind", "line")).cast("long").alias("ord"), "line")


def codon_intervals(grid: DataFrame, positions: DataFrame) -> DataFrame:
    """(locus, pos, from, to): codon positions (locus, pos 0 to 3, from, to) in the concatenation, merged.

    Neighbouring intervals of one locus become one: those that follow each other, at pos 1 to 3 by 3.
    """
    ranges = charset_ranges(grid).select("locus", F.col("first").alias("_f"))
    moved = positions.join(ranges, "locus").select(F.concat_ws("|", "locus", "pos").alias("name"), "pos", (F.col("from") + F.col("_f") - 1).alias("from"), (F.col("to") + F.col("_f") - 1).alias("to"))
    plain = combine_intervals(moved.where("pos = 0").drop("pos"), 1)
    coding = combine_intervals(moved.where("pos > 0").drop("pos"), 3)
    return plain.unionByName(coding).select(F.split_part("name", F.lit("|"), F.lit(1)).alias("locus"), F.split_part("name", F.lit("|"), F.lit(2)).cast("int").alias("pos"), "from", "to")


def _codon_lines(grid: DataFrame, positions: DataFrame) -> DataFrame:
    """The CODONS block, before the SETS, and one set for each locus and position, after them."""
    iv = codon_intervals(grid, positions)
    label = F.when(F.col("pos") == 0, F.lit("N")).otherwise(F.col("pos").cast("string"))
    text = F.when(F.col("from") == F.col("to"), F.col("from").cast("string")).otherwise(F.concat("from", F.lit("-"), "to", F.when(F.col("pos") > 0, F.lit("\\3")).otherwise(F.lit(""))))
    listed = lambda *keys: iv.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", text.alias("t")))), lambda x: x["t"]), " ").alias("t"), F.first(label).alias("p"))
    last = F.col("pos") == F.max("pos").over(W.partitionBy())
    rows = listed("pos").select((F.col("pos") + 1).cast("long").alias("ord"), F.concat(F.lit("\t\t"), "p", F.lit(": "), "t", F.when(last, F.lit("")).otherwise(F.lit(","))).alias("line"))
    codons = rows.unionByName(_rows(grid, [(0, "BEGIN CODONS;\n\tCODONPOSSET * CodonPositions ="), (9, "\t;\nEND;\n")], "ord long, line string")).withColumn("block", F.lit(1 << 41))
    sets = listed("locus", "pos").select(F.concat(F.lit("\tCHARSET "), "locus", F.lit("_pos"), "p", F.lit(" = "), "t", F.lit(";")).alias("line"))
    sets = sets.select(F.row_number().over(W.orderBy("line")).cast("long").alias("ord"), "line")
    assumptions = sets.unionByName(_rows(grid, [(0, "\nBEGIN ASSUMPTIONS;"), (1 << 40, "END;")], "ord long, line string")).withColumn("block", F.lit(1 << 43))
    return codons.unionByName(assumptions).select("block", "ord", "line")


def supermatrix_nexus_lines(grid: DataFrame, mode: str = "single", interleave_at: int = 1000, allow_cancelled: bool = False, positions: DataFrame | None = None) -> DataFrame:
    """(block, ord, line) of the concatenation with its SETS.

    mode: single (a line per taxon), interleaved (by width), blocks (one for each locus), naked (no
    SETS).  positions: codon positions (locus, pos 0 to 3, from, to), which add a CODONS and an
    ASSUMPTIONS block.
    """
    live = refuse_cancelled(grid, allow_cancelled)
    rows = numbered(concatenate(live), [F.col("taxon")], "ord")
    rows = unique_names(rows, F.regexp_replace("taxon", r"[^\w.]+", "_")).withColumn("seq", F.translate("seq", *_GAPS))
    n, longest = _size(rows)
    if mode == "interleaved":
        lines = _blocks(rows, "name", interleave_at)
    elif mode == "blocks":
        ranges = charset_ranges(live).withColumn("block", F.row_number().over(W.orderBy("locus")).cast("long"))
        chunk = F.substring(F.col("seq"), F.col("first").cast("int"), (F.col("last") - F.col("first") + 1).cast("int"))
        lines = rows.crossJoin(ranges).select("block", "ord", F.concat(F.rpad("name", 33, " "), chunk, F.lit(" ["), "locus", F.lit("]")).alias("line"))
    else:
        lines = rows.select(F.lit(0).cast("long").alias("block"), "ord", F.concat(F.rpad("name", 33, " "), "seq").alias("line"))
    flag = " INTERLEAVE" if mode in ("interleaved", "blocks") else ""
    head = f"#NEXUS\n\nBEGIN DATA;\n\tDIMENSIONS NTAX={n} NCHAR={longest};\n\tFORMAT DATATYPE=DNA MISSING=? GAP=-{flag};\n\tMATRIX"
    more = None
    if mode != "naked":
        more = _set_lines(live, rows).unionByName(_rows(grid, [(1 << 42, -1, "\nBEGIN SETS;"), (1 << 42, 1 << 40, "END;")], "block long, ord long, line string"))
        if positions is not None:
            more = more.unionByName(_codon_lines(live, positions))
    return _framed(lines, head, "\n;\n\nEND;", more)


def write_supermatrix_nexus(grid: DataFrame, path: str, mode: str = "single", interleave_at: int = 1000, allow_cancelled: bool = False, positions: DataFrame | None = None) -> None:
    _write(supermatrix_nexus_lines(grid, mode, interleave_at, allow_cancelled, positions), path, "block", "ord")


def _tnt(rows: DataFrame, title: str, groups: DataFrame | None, agroups: DataFrame | None) -> DataFrame:
    """A TNT file; groups and agroups: (place, text), of which 32 each go into the body, the rest into the title."""
    rows = rows.withColumn("seq", F.translate("seq", *_GAPS))
    n, longest = _size(rows)
    lines = rows.select(F.lit(0).cast("long").alias("block"), "ord", F.concat("name", F.lit(" "), "seq").alias("line"))
    out = lines.select("block", F.col("ord").cast("long").alias("ord"), "line").unionByName(_rows(rows, [(-9, 0, f"nstates dna;\nxread\n'{title}"), (-1, 0, f"'\n{longest} {n}"), (1 << 40, 0, ";"), (1 << 43, 0, "proc /;")], "block long, ord long, line string"))
    for i, (kind, found) in enumerate((("xgroup", groups), ("agroup", agroups))):
        if found is None or found.isEmpty():
            continue
        line = F.concat(F.lit("="), "place", F.lit(" "), "text")
        inner = found.select(F.when(F.col("place") < 32, F.lit((1 << 41) + i)).otherwise(F.lit(-8 + i)).alias("block"), F.col("place").cast("long").alias("ord"), line.alias("line"))
        out = out.unionByName(inner).unionByName(_rows(rows, [((1 << 41) + i, -1, kind), ((1 << 41) + i, 1 << 40, ";")], "block long, ord long, line string"))
        if not found.where("place >= 32").isEmpty():
            out = out.unionByName(_rows(rows, [(-8 + i, -1, f"@{kind}"), (-8 + i, 1 << 40, ";")], "block long, ord long, line string"))
    return out


def tnt_lines(df: DataFrame, title: str = "sequences", groups: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """(block, ord, line) of a list for TNT; groups: (name, first, last from 0)."""
    rows = unique_names(df, F.regexp_replace("title", r"[^\w.]+", "_"))
    found = _rows(df, [(i, f"({name}) {a}.{b}") for i, (name, a, b) in enumerate(groups or [])], "place int, text string") if groups else None
    return _tnt(rows, title, found, None)


def write_tnt(df: DataFrame, path: str, title: str = "sequences", groups: list[tuple[str, int, int]] | None = None) -> None:
    _write(tnt_lines(df, title, groups), path, "block", "ord")


def _codon_groups(grid: DataFrame, positions: DataFrame) -> DataFrame:
    """(locus, pos, text): for codon positions 1 to 3 of each locus, its places in the concatenation, from 0."""
    ranges = charset_ranges(grid).select("locus", F.col("first").alias("_f"))
    moved = positions.where("pos between 1 and 3").join(ranges, "locus")
    each = moved.select("locus", "pos", F.explode(F.sequence(F.col("from") + F.col("_f") - 2, F.col("to") + F.col("_f") - 2, F.lit(3).cast("long"))).alias("k"))
    places = F.array_join(F.transform(F.array_sort(F.collect_set("k")), lambda k: k.cast("string")), " ")
    return each.groupBy("locus", "pos").agg(F.concat(F.lit("("), F.first("locus"), F.lit("_pos"), F.first("pos").cast("string"), F.lit(") "), places).alias("text"))


def supermatrix_tnt_lines(grid: DataFrame, allow_cancelled: bool = False, positions: DataFrame | None = None) -> DataFrame:
    """(block, ord, line) of the concatenation for TNT, loci as xgroup, taxonsets (of taxa by place) as agroup.

    positions: codon positions (locus, pos 0 to 3, from, to); 1 to 3 of each locus come before the loci as groups.
    """
    live = refuse_cancelled(grid, allow_cancelled)
    rows = numbered(concatenate(live), [F.col("taxon")], "ord")
    named = unique_names(rows, F.regexp_replace("taxon", r"[^\w.]+", "_"))
    groups = charset_ranges(live).select("locus", F.lit(9).alias("pos"), F.concat(F.lit("("), "locus", F.lit(") "), F.col("first") - 1, F.lit("."), F.col("last") - 1).alias("text"))
    if positions is not None:
        groups = groups.unionByName(_codon_groups(live, positions).select("locus", F.col("pos").cast("int").alias("pos"), "text"))
    # a few groups for each locus, and loci last
    groups = groups.select((F.row_number().over(W.orderBy(F.col("pos") == 9, "locus", "pos")) - 1).alias("place"), "text")
    taxa = rows.select("taxon", (F.col("ord") - 1).alias("k"))
    sets = taxonsets(live).join(taxa, "taxon").groupBy("taxonset").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: k.cast("string")), " ").alias("ks"))
    agroups = sets.select((F.row_number().over(W.orderBy("taxonset")) - 1).alias("place"), F.concat(F.lit("("), "taxonset", F.lit(") "), "ks").alias("text"))
    return _tnt(named, "concatenation", groups, agroups)


def write_supermatrix_tnt(grid: DataFrame, path: str, allow_cancelled: bool = False, positions: DataFrame | None = None) -> None:
    _write(supermatrix_tnt_lines(grid, allow_cancelled, positions), path, "block", "ord")


def phylip_lines(df: DataFrame) -> DataFrame:
    rows = unique_names(df, F.regexp_replace("title", r"[^\w]+", "_")).withColumn("seq", F.translate("seq", *_GAPS))
    n, longest = _size(rows)
    lines = rows.select(F.lit(0).cast("long").alias("block"), F.col("ord").cast("long").alias("ord"), F.concat("name", F.lit(" "), "seq").alias("line"))
    return lines.unionByName(_rows(df, [(-1, 0, f"{n} {longest}")], "block long, ord long, line string"))


def write_phylip(df: DataFrame, path: str) -> None:
    _write(phylip_lines(df), path, "block", "ord")


def sequences_lines(grid: DataFrame, prefix: str = "grid") -> DataFrame:
    """(locus, ord, line): every cell with its locus, name and state, cancelled ones included."""
    state = F.when(F.col("cancelled"), F.lit(f"^{prefix}.cancelled\n")).otherwise(F.lit(""))
    line = F.concat(F.lit(">"), "taxon", F.lit(f"\n^{prefix}.colname "), "locus", F.lit(f"\n^{prefix}.seqname "), "taxon", F.lit("\n"), state, F.translate("seq", *_GAPS), F.lit("\n"))
    return _rows(grid, [("", -1, "#sequences\n")], "locus string, ord long, line string").unionByName(grid.select("locus", "ord", line.alias("line")))


def write_sequences(grid: DataFrame, path: str, prefix: str = "grid") -> None:
    _write(sequences_lines(grid, prefix), path, "locus", "ord")


def grid_table(grid: DataFrame) -> DataFrame:
    """One row per taxon, one column per locus."""
    loci = [r["locus"] for r in grid.select("locus").distinct().orderBy("locus").collect()]
    return grid.where("not cancelled").groupBy("taxon").pivot("locus", loci).agg(F.first("seq"))


def write_grid_tsv(grid: DataFrame, path: str, allow_cancelled: bool = False) -> None:
    grid_table(refuse_cancelled(grid, allow_cancelled)).sort("taxon").write.mode("error").csv(path, sep="\t", header=True)


def by_locus_lines(grid: DataFrame, include_na: bool = False, allow_cancelled: bool = False) -> DataFrame:
    """(locus, taxon, line): FASTA of each locus; absent cells as missing characters where asked for."""
    live = refuse_cancelled(grid, allow_cancelled)
    if include_na:
        loci = live.groupBy("locus").agg(F.min_by(F.length("seq"), "ord").alias("length"))
        every = live.select("taxon").distinct().crossJoin(loci)
        live = every.join(live.select("locus", "taxon", "seq"), ["locus", "taxon"], "left").withColumn("seq", F.coalesce("seq", F.expr("repeat('?', length)")))
    line = F.concat(F.lit(">"), F.translate("taxon", " ", "_"), F.lit("\n"), wrap(F.translate("seq", *_GAPS), 70))
    return live.select("locus", "taxon", line.alias("line"))


def write_by_locus(grid: DataFrame, path: str, include_na: bool = False, allow_cancelled: bool = False) -> None:
    """One folder per locus."""
    lines = by_locus_lines(grid, include_na, allow_cancelled)
    lines.repartitionByRange("locus", "taxon").sortWithinPartitions("locus", "taxon").select("locus", "line").write.mode("error").partitionBy("locus").text(path)


def custom_lines(df: DataFrame, style: str = "full", max_length: int = 0, two_lines: bool = True, mark: str = ">", one_per_species: bool = False, head: str = "", foot: str = "") -> DataFrame:
    """(family, ord, line): names by style (full, species_gi, gi_species), cut and unique, after `mark`.

    one_per_species keeps the longest sequence of a species, of equal ones the first; unnamed rows
    stay.  head and foot frame each family.
    """
    names = {"full": F.col("title"), "species_gi": F.coalesce(F.concat_ws(" ", "species", "gi"), "title"), "gi_species": F.coalesce(F.concat_ws(" ", "gi", "species"), "title")}
    if one_per_species:
        size = F.length(F.regexp_replace("seq", "[_?-]", ""))
        best = df.where("species is not null").groupBy("species").agg(F.max_by("ord", F.struct(size, -F.col("ord"))).alias("ord")).select("ord")
        df = df.where("species is null").unionByName(df.where("species is not null").join(best, "ord", "left_semi"))
    rows = unique_names(df, names[style], max_length)
    lines = rows.select(F.coalesce("family", F.lit("none")).alias("family"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit(mark), "name", F.lit("\n" if two_lines else "\t"), F.translate("seq", *_GAPS)).alias("line"))
    for text, place in ((head, -1), (foot, 1 << 62)):
        if text:
            lines = lines.unionByName(lines.select("family").distinct().select("family", F.lit(place).cast("long").alias("ord"), F.lit(text).alias("line")))
    return lines


def export_custom(df: DataFrame, path: str, by_family: bool = False, **options) -> None:
    """The lines of custom_lines, in one folder or one for each family."""
    lines = custom_lines(df, **options).sort("family", "ord") if by_family else custom_lines(df.withColumn("family", F.lit(None).cast("string")), **options).sort("ord")
    out = lines.select("family", "line").write.mode("error").partitionBy("family") if by_family else lines.select("line").write.mode("error")
    out.text(path)


def write_window_stats(stats: DataFrame, path: str) -> None:
    stats.sort("start").write.mode("error").csv(path, header=True)


def distance_lines(pairs: DataFrame) -> DataFrame:
    """(dist, line), to be sorted."""
    return pairs.select("dist", F.col("dist").cast("string").alias("line"))


def write_distances(pairs: DataFrame, path: str) -> None:
    _write(distance_lines(pairs), path, "dist")


def gene_lines(features: DataFrame, min_species: int = 0) -> DataFrame:
    """(gene, line) of extracted features (gene, title, seq); genes of fewer species are left out.

    With a minimum, features need a species.
    """
    if min_species:
        features = with_minimum_species(features, min_species)
    gene = F.regexp_replace("gene", r"[^a-zA-Z0-9_().]", "_").alias("gene")
    return features.select(gene, F.concat(F.lit(">"), F.translate("title", " ", "_"), F.lit("\n"), wrap(F.col("seq"), 70)).alias("line"))


def write_features_by_gene(features: DataFrame, path: str, min_species: int = 0) -> None:
    """One folder per gene group."""
    gene_lines(features, min_species).sort("gene", "line").write.mode("error").partitionBy("gene").text(path)


def flatfile_lines(loci: DataFrame) -> DataFrame:
    body = F.array_join(F.transform("sections", lambda s: F.concat(F.rpad(s["name"], 12, " "), F.regexp_replace(s["value"], r"\s+$", ""))), "\n")
    return loci.select("file", "locus_id", F.concat(body, F.lit("\n//")).alias("line"))


def write_flatfile(loci: DataFrame, path: str) -> None:
    _write(flatfile_lines(loci), path, "file", "locus_id")


def export_for_alignment(df: DataFrame, path: str | None = None) -> DataFrame:
    """`>seq<GI>`, or `>seqU<ord>` without a GI, 80 to a line; an id that comes twice is an error."""
    rows = df.select("ord", F.concat(F.lit("seq"), F.coalesce("gi", F.concat(F.lit("U"), F.col("ord").cast("string")))).alias("id"), F.translate("seq", *_GAPS).alias("seq"))
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if twice:
        raise ValueError(f"id {twice[0]['id']} comes more than once")
    lines = rows.select("ord", F.concat(F.lit(">"), "id", F.lit("\n"), wrap(F.col("seq"), 80)).alias("line"))
    if path:
        _write(lines, path, "ord")
    return lines
