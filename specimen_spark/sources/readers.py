"""Readers of sequence files as DataFrames.

Readers take files of any size: FASTA is split at records, other formats by the state that each split
starts in (see scan).  Parsers take texts, one file per row, apart with native functions.  A sequence's order
is its place in its file.  Columns: file, ord, title, seq (and overrides where a format has them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import collapse_groups, mark_external
from ..operators.names import first_free_names
from ..operators.storage import numbered, store
from .scan import BROADCAST_SPLITS, Mega, Nexus, Tnt, heads, records, scan


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file (name without folders) and its text with plain line ends: for small files that go to a parser as a whole."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return text.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))


def locus_name(file: Column) -> Column:
    """The file's name without its extension of one to four characters."""
    return F.regexp_replace(file, r"\.\w{1,4}$", "")


def _records(text: Column) -> Column:
    """What follows each `>` at the start of a line."""
    return F.filter(F.split(F.concat(F.lit("\n"), text), r"\n[ \t]*>"), lambda x, i: i > 0)


def _body(record: Column) -> Column:
    """A record's residues: without its first line, blank, comment and command lines and white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\n[ \t]*[#^@][^\n]*", ""), r"\s", "")


def _fasta(rows: DataFrame) -> DataFrame:
    """file, ord, title and seq of records (file, ord, r)."""
    name = F.trim(F.translate(F.regexp_extract("r", r"^[^\n]*", 0), "_", " "))
    seq = F.translate(_body(F.col("r")), "Uu", "Tt")
    return rows.select("file", F.col("ord").cast("long").alias("ord"), F.when(name == "", "No name specified in file").otherwise(name).alias("title"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA files of any size, as parse_fasta."""
    return _fasta(_split_records(spark, path))


def _split_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, r): Spark splits files at records, which are numbered by split.

    A record's place is its place in its split after the records of the splits before.
    """
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_name", "file"), ("file_path", "_path"), ("file_block_start", "_block"))]
    rows = spark.read.option("lineSep", "\n>").text(path).select(*where, F.monotonically_increasing_id().alias("_id"), "value")
    split = W.partitionBy("_path", "_block")
    first = (F.col("_block") == 0) & (F.row_number().over(split.orderBy("_id")) == 1)
    rows = rows.withColumn("text", F.concat(F.when(first, "").otherwise(">"), F.regexp_replace("value", "\r\n?", "\n")))
    records = rows.select("file", "_path", "_block", "_id", F.posexplode(_records(F.col("text"))).alias("_k", "r"))
    records = records.withColumn("_n", F.row_number().over(split.orderBy("_id", "_k")) - 1)
    sizes = records.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_path", "_block", before.alias("_before"))
    return records.join(starts, ["_path", "_block"]).select("file", (F.col("_before") + F.col("_n")).alias("ord"), "r")


def parse_fasta(files: DataFrame) -> DataFrame:
    """FASTA: blank and # lines dropped, `_` in names as a space, U as T; unnamed records get a name."""
    return _fasta(files.select("file", F.posexplode(_records(F.col("text"))).alias("ord", "r")))


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`#sequences` dumps of any size, as parse_sequences."""
    return _cells(_split_records(spark, path))


def parse_sequences(files: DataFrame) -> DataFrame:
    """`#sequences` dumps: FASTA-like, with ^commands that set the cell's locus, name and state."""
    return _cells(files.select("file", F.posexplode(_records(F.col("text"))).alias("ord", "r")))


def _cells(rows: DataFrame) -> DataFrame:
    """The sequences of records (file, ord, r) with their commands."""
    command = lambda name: F.nullif(F.trim(F.regexp_extract("r", rf"\n[ \t]*\^\w+\.{name}[ \t]+([^\n]*)", 1)), F.lit(""))
    return rows.select(
        "file", F.col("ord").cast("long").alias("ord"), F.trim(F.regexp_extract("r", r"^[^\n]*", 0)).alias("title"), _body(F.col("r")).alias("seq"),
        command("colname").alias("locus_override"), command("seqname").alias("taxon_override"), F.col("r").rlike(r"\n[ \t]*\^\w+\.cancelled").alias("cancelled"),
    )


def _interleaved(lines: DataFrame) -> DataFrame:
    """(file, n, name, data) lines as one row per name, in order of first place."""
    parts = lines.groupBy("file", "name").agg(F.min("n").alias("at"), F.array_sort(F.collect_list(F.struct("n", "data"))).alias("p"))
    return parts.select("file", "at", "name", F.array_join(F.transform("p", lambda x: x["data"]), "").alias("seq"))


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """ord by position within each file."""
    items = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("name").alias("title"), "seq"))).alias("i"))
    return items.select("file", F.posexplode("i").alias("ord", "x")).select("file", F.col("ord").cast("long").alias("ord"), "x.title", "x.seq")


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """As _numbered, for files of any size: places are counted by range."""
    placed = numbered(rows.select("file", *order, F.col("name").alias("title"), "seq") if "name" not in order else rows.select("file", "name", F.col("name").alias("title"), "seq"), [F.col("file"), *map(F.col, order)])
    first = placed.groupBy("file").agg(F.min("place").alias("_first"))
    return placed.join(first, "file").select("file", (F.col("place") - F.col("_first")).alias("ord"), "title", "seq")


def read_mega(spark: SparkSession, path: str | list[str], folder: bool = False) -> DataFrame:
    """MEGA files of any size, as parse_mega; with `folder`, the parts in a folder are one file."""
    found = records(scan(spark, path, Mega(), folder)).withColumn("r", F.regexp_replace("text", r"^[ \t]*#", ""))
    return _placed(_interleaved(_mega_lines(found, "record")), ["name"])


def parse_mega(files: DataFrame) -> DataFrame:
    """MEGA: `#name data` lines, a name that comes again goes on; quoted comments dropped; ordered by name."""
    text = F.regexp_replace(F.regexp_replace("text", r'"[^"]*"', ""), r"(?is)^\s*#mega\b.*?\btitle\b[^\n]*", "")
    rows = files.where(F.col("text").rlike(r"(?i)^\s*#mega\b"))
    chunks = rows.select("file", F.posexplode(F.filter(F.split(F.concat(F.lit("\n"), text), r"\n[ \t]*#"), lambda x, i: i > 0)).alias("n", "r"))
    return _numbered(_interleaved(_mega_lines(chunks, "n")), ["name"])


def _mega_lines(chunks: DataFrame, n: str) -> DataFrame:
    """(file, n, name, data) of records r."""
    return chunks.select("file", F.col(n).alias("n"), F.translate(F.regexp_extract("r", r"^(\S+)", 1), "_", " ").alias("name"), F.regexp_replace(F.regexp_replace("r", r"^\S+", ""), r"\s", "").alias("data"))


def _groups(data: Column) -> Column:
    return F.translate(data, "()", "[]")


def read_nexus(spark: SparkSession, path: str | list[str], folder: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nexus files of any size, as parse_nexus; with `folder`, the parts in a folder are one file."""
    pieces = scan(spark, path, Nexus(), folder)
    found = heads(pieces).where(F.col("text").rlike(r"(?i)^\s*#nexus"))
    symbols = store(found.select("file", *_symbols(), _continuous().alias("continuous")))
    lines = pieces.where("kind = 'matrix'").select("file", "n", F.col("text").alias("line"))
    lines = lines.join(F.broadcast(symbols) if symbols.count() <= BROADCAST_SPLITS else symbols, "file").where("not continuous and trim(line) <> ''")
    return _placed(_interleaved(_nexus_lines(lines)), ["at"]), _nexus_sets(found)


#: What character sets can't be read from: other notations, and names of other sets.
_OTHER_SETS = r"(?i)\(\s*vector\s*\)|\b(all|remainder)\b"
_CHARSET = r"(?is)\b(charset\s+[^=;]+=[^;]*);"


def nexus_problems(files: DataFrame) -> DataFrame:
    """(file, problem, what): matrices of continuous data, and character sets in a notation that isn't read.

    parse_nexus leaves these out.
    """
    files = files.where(F.col("text").rlike(r"(?i)^\s*#nexus")).withColumn("text", F.regexp_replace("text", r"\[[^\]]*\]", ""))
    continuous = files.where(_continuous()).select("file", F.lit("continuous data").alias("problem"), F.lit("").alias("what"))
    sets = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(_CHARSET), F.lit(1))).alias("s")).where(F.col("s").rlike(_OTHER_SETS))
    return continuous.unionByName(sets.select("file", F.lit("character set").alias("problem"), F.trim("s").alias("what")))


def _continuous() -> Column:
    return F.col("text").rlike(r"(?is)\bformat\b[^;]*\bdatatype\s*=\s*continuous\b")


def parse_nexus(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, charsets) of Nexus files: DATA or CHARACTERS blocks, interleaved or not; SETS.

    Bracketed comments are dropped, alternatives in parentheses kept in brackets, the file's own gap
    and missing symbols become - and ?.  Character sets: name, pos (null, or 0-3 from CODONPOSSET),
    from, to, stride.  A number that stands alone is an interval of one position.  What cannot be read
    is left out and listed by nexus_problems.
    """
    files = files.where(F.col("text").rlike(r"(?i)^\s*#nexus")).withColumn("text", F.regexp_replace("text", r"\[[^\]]*\]", ""))
    matrix = F.regexp_extract("text", r"(?is)\bbegin\s+(?:data|characters)\s*;.*?\bmatrix\b(.*?);", 1)
    rows = files.select("file", *_symbols(), F.posexplode(F.when(_continuous(), F.array().cast("array<string>")).otherwise(F.split(matrix, "\n"))).alias("n", "line")).where("trim(line) <> ''")
    return _numbered(_interleaved(_nexus_lines(rows)), ["at"]), _nexus_sets(files)


def _symbols() -> list[Column]:
    """The file's own gap and missing symbols."""
    symbol = lambda word, default: F.coalesce(F.nullif(F.regexp_extract("text", rf"(?is)\bformat\b[^;]*\b{word}\s*=\s*([^\s;])", 1), F.lit("")), F.lit(default))
    return [symbol("gap", "-").alias("gap"), symbol("missing", "?").alias("missing")]


def _nexus_lines(rows: DataFrame) -> DataFrame:
    """(file, n, name, data) of lines with their file's symbols."""
    quoted = F.regexp_extract("line", r"^\s*'([^']*)'", 1)
    name = F.translate(F.when(quoted != "", quoted).otherwise(F.regexp_extract("line", r"^\s*(\S+)", 1)), "_", " ")
    data = _groups(F.regexp_replace(F.regexp_replace("line", r"^\s*('[^']*'|\S+)", ""), r"\s", ""))
    data = F.call_function("translate", data, F.concat("gap", "missing"), F.lit("-?"))
    return rows.select("file", "n", name.alias("name"), data.alias("data"))


def _nexus_sets(files: DataFrame) -> DataFrame:
    """Character sets and codon positions of texts without comments."""
    interval = r"(\d+)\s*(?:-\s*(\d+|\.))?\s*(?:\\\s*(\d+))?"
    total = F.coalesce(F.nullif(F.regexp_extract("text", r"(?is)\bnchar\s*=\s*(\d+)", 1), F.lit("")), F.lit("0")).cast("int")
    sets = files.select("file", total.alias("nchar"), F.explode(F.regexp_extract_all("text", F.lit(_CHARSET), F.lit(1))).alias("s")).where(~F.col("s").rlike(_OTHER_SETS))
    sets = sets.select("file", "nchar", F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract("s", r"(?is)^charset\s+([^=]*)=", 1)), r"(?i)\s*\(standard\)", ""), r"^\*\s*|'", "").alias("name"), F.lit(None).cast("int").alias("pos"), F.regexp_extract("s", r"(?s)=(.*)$", 1).alias("body"))
    codons = files.select("file", total.alias("nchar"), F.explode(F.regexp_extract_all("text", F.lit(r"(?is)\bcodonposset\b[^=;]*=([^;]*);"), F.lit(1))).alias("s"))
    codons = codons.select("file", "nchar", F.explode(F.split("s", ",")).alias("s")).where(F.col("s").rlike(r"(?i)^\s*[n123]\s*:"))
    codons = codons.select("file", "nchar", F.lit("codons").alias("name"), F.translate(F.upper(F.regexp_extract("s", r"(?i)^\s*([n123])\s*:", 1)), "N", "0").cast("int").alias("pos"), F.regexp_extract("s", r"(?s):(.*)$", 1).alias("body"))
    both = sets.unionByName(codons).select("file", "nchar", "name", "pos", F.explode(F.regexp_extract_all("body", F.lit(rf"({interval})"), F.lit(1))).alias("i"))
    first, to, stride = (F.regexp_extract("i", interval, k) for k in (1, 2, 3))
    last = F.when(to == "", first.cast("int")).when(to == ".", F.col("nchar")).otherwise(F.nullif(F.nullif(to, F.lit("")), F.lit(".")).cast("int"))
    charsets = both.select(locus_name(F.col("file")).alias("source"), "name", "pos", first.cast("int").alias("from"), last.alias("to"), F.coalesce(F.nullif(stride, F.lit("")).cast("int"), F.lit(1)).alias("stride"))
    return charsets


def read_tnt(spark: SparkSession, path: str | list[str], folder: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """TNT files of any size, as parse_tnt; with `folder`, the parts in a folder are one file."""
    pieces = scan(spark, path, Tnt(), folder)
    found = store(heads(pieces).where(F.col("text").rlike(r"(?i)\bxread\b")))
    parts = found.select("file", *_tnt_numbers())
    rows = pieces.where("kind = 'matrix'").select("file", "n", F.col("text").alias("line")).where("trim(line) <> '' and not trim(line) like '&%'")
    sequences = _placed(_interleaved(_tnt_lines(rows)), ["at"])
    return sequences, _tnt_groups(found, parts), _tnt_problems(parts, sequences)


_XREAD = r"(?is)\bxread\s+(?:'[^']*'\s*)?(\d+)\s+(\d+)\s*(.*?);"


def _tnt_numbers() -> list[Column]:
    return [F.regexp_extract("text", _XREAD, k).alias(n) for k, n in ((1, "nchar"), (2, "ntax"))]


def _tnt_lines(rows: DataFrame) -> DataFrame:
    """(file, n, name, data) of lines."""
    return rows.select("file", "n", F.translate(F.regexp_extract("line", r"^\s*(\S+)", 1), "_", " ").alias("name"), _groups(F.regexp_replace(F.regexp_replace("line", r"^\s*\S+", ""), r"\s", "")).alias("data"))


def _tnt_problems(parts: DataFrame, sequences: DataFrame) -> DataFrame:
    """Files whose number of taxa or of characters isn't what they say."""
    sites = F.length(F.regexp_replace("seq", r"\[[^\]]*\]", "N"))
    found = sequences.groupBy("file").agg(F.count(F.lit(1)).alias("taxa"), F.min(sites).alias("shortest"), F.max(sites).alias("longest"))
    return parts.select("file", F.col("nchar").try_cast("int").alias("nchar"), F.col("ntax").try_cast("int").alias("ntax")).join(found, "file", "left").where("not (taxa <=> ntax) or not (shortest <=> nchar) or not (longest <=> nchar)")


def parse_tnt(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, charsets, problems) of TNT files: xread with an optional quoted title, xgroup.

    Problems are files whose number of taxa or of characters isn't what they say.
    """
    files = files.where(F.col("text").rlike(r"(?i)\bxread\b"))
    parts = files.select("file", *_tnt_numbers(), F.regexp_extract("text", _XREAD, 3).alias("m"))
    rows = parts.select("file", F.posexplode(F.split("m", "\n")).alias("n", "line")).where("trim(line) <> '' and not trim(line) like '&%'")
    sequences = _numbered(_interleaved(_tnt_lines(rows)), ["at"])
    return sequences, _tnt_groups(files, parts), _tnt_problems(parts, sequences)


def _tnt_groups(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Character sets of xgroup commands."""
    groups = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)\bxgroup\b([^;']*)(?:;|')"), F.lit(1))).alias("g"))
    one = groups.select("file", F.explode(F.filter(F.split("g", r"=\s*\d+\s*"), lambda x: F.trim(x) != "")).alias("g"))
    named = one.select("file", F.trim(F.regexp_extract("g", r"\(([^)]*)\)", 1)).alias("name"), F.regexp_replace("g", r"\([^)]*\)", "").alias("ids"))
    each = named.select("file", "name", F.explode(F.filter(F.split(F.trim("ids"), r"\s+"), lambda x: x != "")).alias("i")).join(parts.select("file", F.col("nchar").try_cast("int").alias("nchar")), "file")
    a, b = F.regexp_extract("i", r"^(\d*)", 1), F.regexp_extract("i", r"\.(\d*)$", 1)
    whole = F.col("i").contains(".")
    lo = F.coalesce(F.nullif(a, F.lit("")).cast("int"), F.lit(0))
    hi = F.when(whole, F.coalesce(F.nullif(b, F.lit("")).cast("int"), F.col("nchar") - 1)).otherwise(lo)
    numbers = each.select("file", "name", F.explode(F.sequence(lo, hi)).alias("k")).distinct()
    runs = numbers.groupBy("file", "name").agg(F.array_sort(F.collect_list("k")).alias("k")).select("file", "name", F.posexplode("k").alias("i", "k"))
    merged = runs.groupBy("file", "name", (F.col("k") - F.col("i")).alias("_g")).agg((F.min("k") + 1).alias("from"), (F.max("k") + 1).alias("to"))
    position = F.regexp_extract("name", r"_pos([123N])$", 1)
    charsets = merged.select(
        locus_name(F.col("file")).alias("source"), F.regexp_replace("name", r"_pos[123N]$", "").alias("name"),
        F.when(position == "", F.lit(None)).when(position == "N", F.lit(0)).otherwise(F.nullif(F.nullif(position, F.lit("")), F.lit("N")).cast("int")).alias("pos"), "from", "to", F.lit(1).alias("stride"),
    )
    return charsets


def file_format() -> Column:
    """The format of a file's text, by its head; null when none fits."""
    t = F.col("text")
    return (
        F.when(t.rlike(r"^\s*>"), "fasta").when(t.rlike(r"(?i)^\s*#nexus"), "nexus").when(t.rlike(r"(?i)^\s*(nstates\b[^;]*;\s*)?xread\b"), "tnt")
        .when(t.rlike(r"(?i)^\s*#mega\b"), "mega").when(t.rlike(r"(?i)^\s*#sequences\b"), "sequences")
    )


def read_any(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of any of the formats and any size, as parse_any; a file's format is told by its first line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    first = lines.where("block = 0 and trim(value) <> ''").groupBy("path").agg(F.min_by("value", "id").alias("text"))
    # one row for each file, which the driver lists in any case
    kinds = {r["path"]: r["format"] for r in first.select("path", F.when(F.col("text").rlike(r"(?i)^\s*nstates\b"), "tnt").otherwise(file_format()).alias("format")).collect()}
    read = {"fasta": read_fasta, "nexus": lambda s, p: read_nexus(s, p)[0], "tnt": lambda s, p: read_tnt(s, p)[0], "mega": read_mega, "sequences": read_sequences}
    found = {}
    for kind, reader in read.items():
        own = sorted(p for p, k in kinds.items() if k == kind)
        if own:
            found[kind] = reader(spark, own)
    return _every(found or {"fasta": parse_fasta(spark.createDataFrame([], "file string, text string"))})


def parse_any(files: DataFrame) -> DataFrame:
    """file, format, ord, title, seq, and what `#sequences` dumps say of a cell: locus_override, taxon_override, cancelled."""
    files = files.withColumn("format", file_format())
    of = lambda kind: files.where(F.col("format") == kind)
    return _every({"fasta": parse_fasta(of("fasta")), "nexus": parse_nexus(of("nexus"))[0], "tnt": parse_tnt(of("tnt"))[0], "mega": parse_mega(of("mega")), "sequences": parse_sequences(of("sequences"))})


def _every(found: dict[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in found.items():
        if kind != "sequences":
            df = df.select("*", F.lit(None).cast("string").alias("locus_override"), F.lit(None).cast("string").alias("taxon_override"), F.lit(False).alias("cancelled"))
        part = df.select("file", F.lit(kind).alias("format"), "ord", "title", "seq", "locus_override", "taxon_override", "cancelled")
        out = part if out is None else out.unionByName(part)
    return out


def unique_loci(files: DataFrame) -> DataFrame:
    """file and locus: the file's name without its ending, or the first free of its _2, _3, ...; files go by name.

    Where rows name their locus themselves (locus_override), that name is taken for the files behind.
    """
    if "locus_override" not in files.columns:
        files = files.withColumn("locus_override", F.lit(None).cast("string"))
    own = files.select("file", "locus_override").distinct()
    own = own.select("file", F.coalesce("locus_override", locus_name(F.col("file"))).alias("base"), F.col("locus_override").isNotNull().alias("forced"))
    # a file's own name is settled before what its rows name, so the key holds both
    key = F.struct("file", F.col("forced").alias("f"), "base").alias("key")
    names = first_free_names(own.select(key, "base", "forced"), F.col("base"), "key", forced=F.col("forced"))
    return names.where("not at.f").select("at.file", F.col("name").alias("locus"))


def filled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grid, refused rows with their reason) from file, title, ord and seq of files, in order of files and rows.

    Each file is a locus; rows may name their locus and taxon and be cancelled themselves.  Outer gaps
    count as missing and rows without a base are left out.  The first row fixes a locus' length; others of
    another length are refused.  Of rows with one taxon the longest stays, of equal ones the last; the
    others are listed as dropped.
    """
    for c, kind in (("locus_override", "string"), ("taxon_override", "string"), ("cancelled", "boolean")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    cells = rows.join(unique_loci(rows), "file", "left").select(
        F.coalesce("locus_override", "locus").alias("locus"), F.coalesce("taxon_override", "title").alias("taxon"), "file", "ord", mark_external(collapse_groups(F.upper("seq"))).alias("seq"), F.coalesce("cancelled", F.lit(False)).alias("cancelled")
    ).withColumn("actual_length", F.regexp_count("seq", F.lit("[^_?]"))).where("actual_length > 0")
    cells = cells.withColumn("_n", F.length(F.regexp_replace("seq", r"\[[^\]]*\]", "N")))  # alternatives are one position
    lengths = cells.groupBy("locus").agg(F.min_by("_n", F.struct("file", "ord")).alias("_len"))
    cells = cells.join(lengths, "locus")
    fits = cells.where("_n = _len")
    best = fits.groupBy("locus", "taxon").agg(F.max_by(F.struct("file", "ord", "seq", "actual_length", "cancelled"), F.struct("actual_length", "file", "ord")).alias("b"))
    grid = best.select("locus", "taxon", "b.ord", "b.seq", "b.actual_length", "b.cancelled")
    lost = fits.join(best.select("locus", "taxon", F.col("b.file").alias("_f"), F.col("b.ord").alias("_o")), ["locus", "taxon"]).where("file <> _f or ord <> _o").withColumn("reason", F.lit("shorter or earlier"))
    refused = cells.where("_n <> _len").withColumn("reason", F.when(F.col("_n") < F.col("_len"), "too short").otherwise("too long"))
    columns = ["locus", "taxon", "file", "ord", "reason"]
    return grid, refused.select(*columns).unionByName(lost.select(*columns))


def grid_of(rows: DataFrame) -> DataFrame:
    """The grid of files (file, title, ord, seq): see filled()."""
    return filled(rows)[0]


def load_grid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """locus, taxon, ord, seq, actual_length, cancelled: see filled()."""
    return grid_of(read_any(spark, path))
