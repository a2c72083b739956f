"""Column functions on titles and aligned sequences: all native expressions, one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# IUPAC codes and the bases they stand for, in the order A C T G.
IUPAC = {
    "A": "A", "C": "C", "T": "T", "G": "G", "R": "AG", "Y": "CT", "K": "TG", "M": "AC", "S": "CG",
    "W": "AT", "B": "CTG", "D": "ATG", "H": "ACT", "V": "ACG", "N": "ACTG",
}
BITS = {"A": 1, "C": 2, "T": 4, "G": 8}
MASK = {code: sum(BITS[b] for b in bases) for code, bases in IUPAC.items()}
CODE = {mask: code for code, mask in MASK.items()}
#: Complements by IUPAC, and as older releases of such tools write them.
COMPLEMENT = {"iupac": ("ACGTRYKMSWBDHVN", "TGCAYRMKSWVHDBN"), "legacy": ("ACGTRYKMSWBDHVN", "TGCAYRMKWSACGTN")}
WORD = 64


def _t(c: Column, of: str, to: str) -> Column:
    return F.translate(c, of, to)


# titles ---------------------------------------------------------------------------------------

_THREE = r"([A-Z][a-z]+) ([a-z]+) ([a-z]+)\b"
_TWO = r"([A-Z][a-z]+) ([a-z]+)\b"
_DOT = r"([A-Z][a-z]+) ([a-z]+)\.\b"


def clean_title(title: Column) -> Column:
    return F.trim(F.replace(title, F.lit("\n"), F.lit(" ")))


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_titles(df: DataFrame, title: str = "title") -> DataFrame:
    """Adds genus, species_epithet, subspecies, species, gi, family and warning, from the title.

    Three words, else two, else a word that ends with a dot (which sets the warning, as does a
    title without a genus).  A missing part is null.
    """
    t = clean_title(F.col(title))
    got = lambda pattern, i: F.regexp_extract(t, pattern, i)
    three, two, dot = t.rlike(_THREE), t.rlike(_TWO), t.rlike(_DOT)
    part = lambda i: _null_if_empty(F.when(three, got(_THREE, i)).when(two, got(_TWO, i)).when(dot, got(_DOT, i)))
    genus, epithet = part(1), part(2)
    return df.withColumns({
        title: t, "genus": genus, "species_epithet": epithet, "subspecies": _null_if_empty(F.when(three, got(_THREE, 3))),
        "species": F.when(genus.isNotNull() & epithet.isNotNull(), F.concat_ws(" ", genus, epithet)),
        "gi": _null_if_empty(got(r"gi\|(\d+)[\|:]", 1)), "family": _null_if_empty(got(r"\(family:\s*([a-zA-Z]+)\s*\)", 1)),
        "warning": genus.isNull() | (~three & ~two & dot),
    })


def display_name() -> Column:
    """The name to show: cut titles in braces where parsing warned, else species with its details."""
    c = F.col
    built = F.concat(
        c("species"),
        F.coalesce(F.concat(F.lit(" ("), c("subspecies"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" (Family "), c("family"), F.lit(")")), F.lit("")),
        F.concat(F.lit(" (gi:"), c("gi"), F.lit(")")),
    )
    return F.when(c("warning"), F.concat(F.lit("{"), F.substring("title", 1, 80), F.lit("}"))).when(c("gi").isNull() | c("species").isNull(), c("title")).otherwise(built)


def short_name(n: int) -> Column:
    """The longest of several forms of the name that fits in n characters."""
    c = F.col
    tagged = F.when(c("gi").isNotNull(), F.concat(F.lit("gi|"), c("gi"), F.lit("| "), c("title"))).otherwise(c("title"))
    named = F.when(c("gi").isNotNull(), F.concat(F.lit("gi|"), c("gi"), F.lit("| "), c("species"))).otherwise(c("species"))
    g, e = c("genus"), c("species_epithet")
    if n <= 0:
        return F.when(c("species").isNull(), F.substring(tagged, 1, 0)).otherwise(F.lit(""))
    if n <= 3:
        first = {1: F.substring(g, 1, 1), 2: F.concat(F.substring(g, 1, 1), F.substring(e, 1, 1)), 3: F.concat_ws(" ", F.substring(g, 1, 1), F.substring(e, 1, 1))}[n]
        return F.when(c("species").isNull(), F.substring(tagged, 1, n)).otherwise(first)
    less_genus = F.concat_ws(" ", F.substring(g, F.lit(1), (F.lit(n - 1) - F.length(e)).cast("int")), e)
    least = F.concat_ws(" ", F.substring(g, 1, 1), F.substring(e, 1, n - 2))
    return (
        F.when(c("species").isNull(), F.substring(tagged, 1, n))
        .when(F.length("title") <= n, c("title"))
        .when(F.length(named) <= n, named)
        .when(F.length(e) + 2 <= n, less_genus)
        .otherwise(least)
    )


def taxon_key(use: str = "full") -> Column:
    """The grid's row name: the override, else the title, or the species where preferred and known."""
    c = F.col
    own = F.coalesce(c("species"), c("title")) if use == "species" else c("title")
    return F.coalesce(c("taxon_override"), own)


# sequences ------------------------------------------------------------------------------------


def collapse_groups(seq: Column) -> Column:
    """Bracketed alternatives such as [AG] or (CT) as their IUPAC code."""
    for mask, code in sorted(CODE.items(), reverse=True):
        bases = [b for b in "ACTG" if mask & BITS[b]]
        if len(bases) > 1:
            ahead = "".join(f"(?=[ACTG]*{b})" for b in bases)
            seq = F.regexp_replace(seq, rf"[\[(]{ahead}[{''.join(bases)}]+[\])]", code)
    return F.regexp_replace(seq, r"[\[(]([ACTG])[\])]", "$1")


def mark_external(seq: Column) -> Column:
    """Gaps before the first and after the last base as `_`; missing characters are passed over."""
    head = F.regexp_extract(seq, r"^[-?]*", 0)
    rest = F.substring(seq, F.length(head) + 1, F.length(seq))
    tail = F.regexp_extract(rest, r"[-?]*$", 0)
    return F.concat(_t(head, "-", "_"), F.substring(rest, F.lit(1), F.length(rest) - F.length(tail)), _t(tail, "-", "_"))


def normalise(seq: Column) -> Column:
    """Upper case, alternatives as codes, outer gaps as `_`; null where a character isn't allowed."""
    plain = collapse_groups(F.upper(F.regexp_replace(seq, r"\s", "")))
    return F.when(plain.rlike(r"^[ACGTRYKMSWBDHVN?-]*$"), mark_external(plain))


def normalise_sequences(df: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows with normalised sequences, rows whose sequence isn't valid)."""
    out = df.withColumn("_n", normalise(F.col(seq)))
    good = out.where("_n is not null").withColumn(seq, F.col("_n")).drop("_n")
    return good, out.where("_n is null").drop("_n")


def profile(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds length, base counts, actual_length, internal_gaps, ambiguous, first_real and last_real."""
    c = F.col(seq)
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    real = r"[^-_?]"
    first = F.regexp_instr(c, F.lit(real)) - 1
    return df.withColumns({
        "length": F.length(c), "n_a": count("A"), "n_c": count("C"), "n_g": count("G"), "n_t": count("T"),
        "actual_length": count("[^_?]"), "internal_gaps": count("-"), "ambiguous": count("[RYKMSWBDHVN]"),
        "first_real": first, "last_real": F.when(first < 0, F.lit(-1)).otherwise(F.length(c) - F.regexp_instr(F.reverse(c), F.lit(real))),
    })


def complement(seq: Column, kind: str = "iupac") -> Column:
    return _t(seq, *COMPLEMENT[kind])


def subsequence(seq: Column, first: Column | int, last: Column | int, kind: str = "iupac") -> Column:
    """Positions first to last, from 1; turned around and complemented where first > last; null outside."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    lo, hi = F.least(a, b), F.greatest(a, b)
    cut = F.substring(seq, lo, (hi - lo + 1).cast("int"))
    return F.when((lo >= 1) & (hi <= F.length(seq)), F.when(a > b, F.reverse(complement(cut, kind))).otherwise(cut))


def expand_ambiguity(seq: Column, begin: str = "[", end: str = "]") -> Column:
    """Ambiguity codes as the bases they stand for, in brackets."""
    # each code first becomes a small letter of its own, so that letters put in are never replaced again
    codes, marks = "RYKMSWBDHVN", "rykmswbdhvn"
    out = _t(seq, codes, marks)
    for code, mark in zip(codes, marks, strict=True):
        out = F.replace(out, F.lit(mark), F.lit(begin + IUPAC[code] + end))
    return out


def external_to_missing(seq: Column) -> Column:
    return _t(seq, "_", "?")


def match_line(a: Column, b: Column) -> Column:
    """`|` where two aligned sequences agree or their codes share a base; else a space."""
    code = lambda s: F.transform(F.split(_t(s, "-_?", "   "), ""), lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in MASK.items() for y in kv]), x), F.lit(0)))
    return F.array_join(F.zip_with(code(a), code(b), lambda x, y: F.when(F.coalesce(x, F.lit(0)).bitwiseAND(F.coalesce(y, F.lit(0))) != 0, F.lit("|")).otherwise(F.lit(" "))), "")


# planes ---------------------------------------------------------------------------------------

PLANES = ("a", "c", "t", "g", "i", "p", "y")
_SYMBOLS = "ACTGRYKMSWBDHVN-?_"
_MEMBERS = {
    **{low: "".join(k for k, m in MASK.items() if m & BITS[low.upper()]) for low in "actg"},
    "i": "-", "p": "AGR", "y": "CTY",
}


def plane_words(seq: Column, plane: str, words: int) -> list[Column]:
    """A plane's 64-bit words, one bit per position; positions past the end are 0."""
    bits = F.rpad(_t(seq, _SYMBOLS, "".join("1" if s in _MEMBERS[plane] else "0" for s in _SYMBOLS)), words * WORD, "0")
    half = lambda at: F.conv(F.substring(bits, at, 32), 2, 10).cast("long")
    return [F.shiftleft(half(64 * w + 1), 32).bitwiseOR(half(64 * w + 33)) for w in range(words)]


def word_of(part: Column, letters: str) -> Column:
    """64 bits, the first one highest: where a part of 64 characters has one of the letters."""
    bits = _t(part, _SYMBOLS, "".join("1" if s in letters else "0" for s in _SYMBOLS))
    half = lambda at: F.conv(F.substring(bits, at, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def with_planes(df: DataFrame, words: int, seq: str = "seq") -> DataFrame:
    """Adds one column `<plane><word>` for each plane and word; `words` covers the longest sequence."""
    return df.withColumns({f"{p}{w}": c for p in PLANES for w, c in enumerate(plane_words(F.col(seq), p, words))})


def words_needed(df: DataFrame, seq: str = "seq") -> int:
    return words_of(df.agg(F.max(F.length(seq))).first()[0] or 1)


def words_of(length: int) -> int:
    return max(1, -(-length // WORD))
