"""Files of any size, read by many tasks: the state of a parser, carried over splits.

A line of a Nexus, TNT or MEGA file means nothing by itself: it may lie in a comment, in a matrix or
between commands.  What a split does to the parser's state is a small table, from each state that it may start in
to the state that it ends in.  Tables compose, so one row for each split is enough to tell where
every split starts, and then all splits are parsed at once.

A scan needs a Scanner and gives rows (file, kind, n, record, text): the lines of the matrix as kind
`matrix`, numbered through the file, and all other text as kind `head`.  Where the format has records,
they are numbered too.  A folder of parts, as writers make them, can be read as one file.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import store

#: Splits whose starts are broadcast at most; the starts of more are joined by shuffling lines.
BROADCAST_SPLITS = 200_000

Piece = tuple[str, str]


class Scanner(ABC):
    """A line parser with few states.  State 0 is that at the start of a file."""

    #: Number of states, and those in which a line goes on over its end.
    states = 1
    joined: frozenset[int] = frozenset()
    #: What a line must hold to change a state at all.
    special: re.Pattern

    @abstractmethod
    def feed(self, state: int, line: str) -> tuple[int, list[Piece]]:
        """The state behind a line, and its pieces (kind, text) in order."""

    def begins(self, state: int, line: str) -> bool:
        """Does a record begin with this line?"""
        return False

    def ends(self, state: int, line: str) -> bool:
        """Does a record end with this line?"""
        return False

    def plain(self, state: int) -> str | None:
        """The kind of a line without anything special; null where it shows nothing."""
        raise NotImplementedError

    def step(self, state: int, line: str) -> tuple[int, list[Piece]]:
        if self.special.search(line):
            return self.feed(state, line)
        kind = self.plain(state)
        return state, [(kind, line)] if kind else []


class Nexus(Scanner):
    """States: in a comment or not, times: between blocks, behind BEGIN, in a data block, in its matrix, behind it, behind BEGIN of another block."""

    states = 12
    joined = frozenset(range(6, 12))
    special = re.compile(r"[\[\];]|\b(?:begin|data|characters|matrix|end|endblock)\b", re.I)
    _tokens = re.compile(r"\[|\]|;|\b(?:begin|data|characters|matrix)\b", re.I)
    OUT, BEGIN, DATA, MATRIX, DONE, OTHER = range(6)

    def plain(self, state: int) -> str | None:
        return None if state >= 6 else "matrix" if state == self.MATRIX else "head"

    def feed(self, state: int, line: str) -> tuple[int, list[Piece]]:
        pieces, comment, mode, at = [], state >= 6, state % 6, 0

        def show(text: str) -> None:
            if not comment:
                pieces.append(("matrix" if mode == self.MATRIX else "head", text))

        for token in self._tokens.finditer(line):
            word = token[0].lower()
            if comment:
                if word == "]":
                    comment, at = False, token.end()
            elif word == "[":
                show(line[at : token.start()])
                comment, at = True, token.end()
            elif word == ";":
                if mode == self.MATRIX:
                    show(line[at : token.start()])
                    mode, at = self.DONE, token.start()
                elif mode == self.BEGIN:
                    mode = self.OTHER
            elif mode in (self.OUT, self.OTHER) and word == "begin":
                mode = self.BEGIN
            elif mode == self.BEGIN and word in ("data", "characters"):
                mode = self.DATA
            elif mode == self.DATA and word == "matrix":
                show(line[at : token.end()])
                mode, at = self.MATRIX, token.end()
        show(line[at:])
        return mode + 6 * comment, pieces


class Tnt(Scanner):
    """States: before xread, behind it, in its title, before the two numbers, in the matrix, behind it."""

    states = 7
    joined = frozenset()
    special = re.compile(r"[';]|\bxread\b|\d", re.I)
    _tokens = re.compile(r"'|;|\bxread\b|\d+|\S", re.I)
    OUT, XREAD, TITLE, NCHAR, NTAX, MATRIX, DONE = range(7)

    def plain(self, state: int) -> str | None:
        return "matrix" if state == self.MATRIX else "head"

    def feed(self, state: int, line: str) -> tuple[int, list[Piece]]:
        pieces, at = [], 0
        if state == self.MATRIX and ";" not in line:
            return state, [("matrix", line)]
        if state == self.DONE:
            return state, [("head", line)]
        for token in self._tokens.finditer(line):
            word = token[0].lower()
            if state == self.OUT and word == "xread":
                state = self.XREAD
            elif state == self.XREAD and word == "'":
                state = self.TITLE
            elif state == self.TITLE and word == "'":
                state = self.NCHAR
            elif state in (self.XREAD, self.NCHAR) and word.isdigit():
                state = self.NTAX
            elif state == self.NTAX and word.isdigit():
                state = self.MATRIX
                pieces.append(("head", line[: token.end()]))
                at = token.end()
            elif state == self.MATRIX and word == ";":
                pieces.append(("matrix", line[at : token.start()]))
                state, at = self.DONE, token.start()
                break
        pieces.append(("matrix" if state == self.MATRIX else "head", line[at:]))
        return state, pieces


class Mega(Scanner):
    """States: before #mega, behind it, among names, and the latter two in a quoted comment."""

    states = 5
    joined = frozenset((3, 4))
    special = re.compile(r'["#]')

    def plain(self, state: int) -> str | None:
        return {0: "head", 1: "head", 2: "matrix"}.get(state)

    def begins(self, state: int, line: str) -> bool:
        return state in (1, 2) and bool(re.match(r"[ \t]*#", line))

    def feed(self, state: int, line: str) -> tuple[int, list[Piece]]:
        pieces: list[Piece] = []
        for i, text in enumerate(line.split('"')):
            if i and state:
                state = {1: 3, 2: 4, 3: 1, 4: 2}[state]
            if state in (3, 4):
                continue
            mark = text.lstrip().startswith("#") and not pieces
            if state == 0 and mark and re.match(r"\s*#mega\b", text, re.I):
                state = 1
            elif state == 1 and mark:
                state = 2
            pieces.append((self.plain(state) or "head", text))
        return state, pieces


class FlatFile(Scanner):
    """Records that end with a line that begins with //."""

    special = re.compile("^//")

    def plain(self, state: int) -> str | None:
        return "matrix"

    def feed(self, state: int, line: str) -> tuple[int, list[Piece]]:
        return state, []

    def ends(self, state: int, line: str) -> bool:
        return True


def _lines(spark: SparkSession, path: str | list[str], folder: bool) -> DataFrame:
    """file, part (parts of a file go by it), block, value; the rows of a split come in order."""
    where = [F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block")]
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1) if folder else F.col("_metadata.file_name")
    return spark.read.text(path).select(name.alias("file"), *where, "value")


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(file, part, block) and the lines of each batch's share of a split; shares of one split follow each other."""
    for batch in batches:
        files, parts, blocks, values = (batch[c].tolist() for c in ("file", "part", "block", "value"))
        at = 0
        while at < len(batch):
            to = at
            while to < len(batch) and blocks[to] == blocks[at] and parts[to] == parts[at]:
                to += 1
            yield (files[at], parts[at], blocks[at]), values[at:to]
            at = to


def _tables(scanner: Scanner):
    """Per split and state that it may start in: the state it ends in, and the lines and records that end or begin in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ends, lines, records = None, [], [], []

        def row() -> pd.DataFrame:
            return pd.DataFrame([(*key, ends, lines, records)], columns=["file", "part", "block", "ends", "lines", "records"])

        for own, values in _splits(batches):
            if own != key:
                if key is not None:
                    yield row()
                key, ends, lines, records = own, list(range(scanner.states)), [0] * scanner.states, [0] * scanner.states
            for line in values:
                if scanner.special.search(line):
                    behind = {s: (scanner.feed(s, line)[0], scanner.begins(s, line) + scanner.ends(s, line)) for s in set(ends)}
                    for s in range(scanner.states):
                        ends[s], more = behind[ends[s]]
                        records[s] += more
                for s in range(scanner.states):
                    lines[s] += ends[s] not in scanner.joined
        if key is not None:
            yield row()

    return run


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """The splits of one file in order: the state that each starts in, and the lines and records before it."""
    rows = rows.sort_values(["part", "block"])
    state, before, record, out = 0, 0, 0, []
    for r in rows.itertuples():
        out.append((r.part, r.block, state, before, record))
        state, before, record = r.ends[state], before + r.lines[state], record + r.records[state]
    return pd.DataFrame(out, columns=["part", "block", "state", "before", "record"])


def _parsed(scanner: Scanner):
    """Lines with their numbers and records, one row for each kind of text in them; `cut` where a line goes on behind its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, n, i, record, begun = None, 0, 0, 0, 0, False
        for batch in batches:
            out: list[tuple] = []
            for own, chosen in batch.groupby(["part", "block"], sort=False):
                if own != key:
                    key, i = own, 0
                    state, n, record = (int(chosen[c].iloc[0]) for c in ("state", "before", "record"))
                    begun = state in scanner.joined  # its first line began in the split before
                file = chosen["file"].iloc[0]
                for line in chosen["value"]:
                    special = scanner.special.search(line)
                    record += bool(special) and scanner.begins(state, line)
                    ends = bool(special) and scanner.ends(state, line)
                    state, pieces = scanner.step(state, line)
                    goes_on = state in scanner.joined
                    texts: dict[str, str] = {}
                    for kind, text in pieces:
                        texts[kind] = texts.get(kind, "") + text
                    out += [(file, kind, n, record, text, begun or goes_on, *own, i) for kind, text in texts.items()]
                    begun, i, n, record = goes_on, i + 1, n + (not goes_on), record + ends
            yield pd.DataFrame(out, columns=["file", "kind", "n", "record", "text", "cut", "part", "block", "i"])

    return run


def scan(spark: SparkSession, path: str | list[str], scanner: Scanner, folder: bool = False) -> DataFrame:
    """(file, kind, n, record, text) of files, or with `folder` of folders of parts, in as many tasks as they have splits.

    Empty lines have no text but are counted.
    """
    lines = _lines(spark, path, folder)
    tables = lines.mapInPandas(_tables(scanner), "file string, part string, block long, ends array<int>, lines array<long>, records array<long>")
    starts = store(tables.groupBy("file").applyInPandas(_starts, "part string, block long, state int, before long, record long"))
    if starts.count() <= BROADCAST_SPLITS:
        found = lines.join(F.broadcast(starts), ["part", "block"])
    else:
        numbered = lines.withColumn("id", F.monotonically_increasing_id())
        found = numbered.join(starts, ["part", "block"]).sortWithinPartitions("part", "block", "id")
    pieces = found.select("file", "part", "block", "value", "state", "before", "record").mapInPandas(_parsed(scanner), "file string, kind string, n long, record long, text string, cut boolean, part string, block long, i long")
    pieces = store(pieces)
    # only lines that go on over their end have pieces in several rows, maybe of several splits
    order = F.struct("part", "block", "i", "text")
    joined = pieces.where("cut").groupBy("file", "kind", "n").agg(F.min("record").alias("record"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), "").alias("text"))
    columns = ["file", "kind", "n", "record", "text"]
    return pieces.where("not cut").select(*columns).unionByName(joined.select(*columns))


def heads(pieces: DataFrame) -> DataFrame:
    """(file, text): what each file holds besides its matrix."""
    rows = pieces.where("kind = 'head'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("x"))
    return rows.select("file", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


def records(pieces: DataFrame) -> DataFrame:
    """(file, record, text): the lines of each record."""
    rows = pieces.where("kind = 'matrix'").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("x"))
    return rows.select("file", "record", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))
