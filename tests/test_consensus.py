"""Consensus by words of bits against position by position."""

import random

import pytest

from specimen_spark.functions.sequences import CODE, MASK
from specimen_spark.operators import consensus


def one_by_one(seqs):
    out = []
    for i in range(max(map(len, seqs), default=0)):
        column = [s[i] if i < len(s) else "?" for s in seqs]
        mask = 0
        for ch in column:
            mask |= MASK.get(ch, 0)
        out.append("?" if "?" in column else CODE[mask] if mask else "-" if "-" in column else "_")
    return "".join(out)


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 300])
def test_positions(spark, length):
    rng = random.Random(length)
    groups = {g: ["".join(rng.choices("ACGTRYKMSWBDHVN-_?" if g % 2 else "AAAACG-_", k=length if g < 4 else rng.randint(0, length))) for _ in range(1 + g)] for g in range(6)}
    df = spark.createDataFrame([(g, s) for g, own in groups.items() for s in own], "g int, seq string").repartition(3)
    got = {r["g"]: (r["size"], r["consensus"]) for r in consensus.consensus(df, "g").collect()}
    assert got == {g: (len(own), one_by_one(own)) for g, own in groups.items()}


def barcode_one_by_one(seqs, least):
    out = []
    for i in range(max(map(len, seqs), default=0)):
        column = [s[i] for s in seqs if i < len(s)]
        run, found = "?", 0
        for ch in column:
            mask = MASK.get(run, 0) | MASK.get(ch, 0)
            run = CODE[mask] if mask else "-" if "-" in (run, ch) else "_" if "_" in (run, ch) else "?"
            found += run == "?" or ch == run
        out.append("N" if len(column) > 1 and found < least else run)
    text = "".join(out) or "?"
    if len(seqs) < 2:
        return text
    inner = text.strip("N")
    return text.replace("N", "-") if not inner else "-" * (len(text) - len(text.lstrip("N"))) + inner + "-" * (len(text) - len(text.rstrip("N")))


@pytest.mark.parametrize(("length", "least"), [(0, 1), (1, 1), (63, 2), (64, 3), (65, 2), (300, 4)])
def test_barcodes(spark, monkeypatch, length, least):
    monkeypatch.setattr(consensus, "BLOCK", 3)  # many blocks of places
    rng = random.Random(length + least)
    groups = {f"G s{g}": ["".join(rng.choices("ACGTRYKMSWBDHVN-_?" if g % 2 else "AAAAAAAAAG-_", k=length if g < 4 else rng.randint(0, length))) for _ in range(1 + 2 * g)] for g in range(6)}
    rows = [[None, g, s] for g, own in groups.items() for s in own]
    for i, r in enumerate(rows):
        r[0] = i * 2 - 9
    rows += [[100_000, None, "ACGT"], [100_001, "G s9", None]]
    df = spark.createDataFrame(rows, "ord long, species string, seq string").repartition(3, "seq")
    got = {r["species"]: (r["sequences"], r["barcode"]) for r in consensus.barcodes(df, least).collect()}
    assert got == {g: (len(own), barcode_one_by_one(own, least)) for g, own in groups.items()}
