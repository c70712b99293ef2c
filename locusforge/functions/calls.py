"""Decoding of genotype text, as Columns and as Python functions that agree."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of bases that one ambiguity letter stands for. Fixed values of the nucleotide code.
AMBIGUITY = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}
NOT_CALLED = ("N", "-", "?", "NN", "")


def gt_dosage(gt: Column, allele: int = 1, alleles: int = 2) -> Column:
    """How often ``allele`` stands in a call such as ``0/1`` or ``1|1``, of any ploidy.

    A part without call, or an index other than the reference and ``allele``, makes the call missing.
    """
    parts = F.split(gt, r"[/|]")
    good = F.forall(parts, lambda x: x.isin("0", str(allele)))
    return F.when(gt.isNotNull() & (gt != "") & good, F.size(F.filter(parts, lambda x: x == str(allele)))).cast("int")


def ds_dosage(ds: Column) -> Column:
    """A dosage number rounded half to even; negative or unreadable is missing."""
    v = ds.try_cast("double")
    return F.when((v >= 0) & ~F.isnan(v), F.bround(v, 0)).cast("int")


def split_call(gt: str) -> list[str] | None:
    return None if not gt or gt in (".", "./.", ".|.") else re.split(r"[/|]", gt)


def call_dosage(gt: str, allele: int = 1) -> int:
    """The Python form of ``gt_dosage``; -9 is missing."""
    parts = split_call(gt)
    if not parts:
        return -9
    want = str(allele)
    if any(p not in ("0", want) for p in parts):
        return -9
    return min(127, parts.count(want))


def number_dosage(text: str) -> int:
    """The Python form of ``ds_dosage``; a list of numbers counts by its first."""
    try:
        v = float(text.split(",")[0])
    except ValueError:
        return -9
    return int(round(v)) if v >= 0 and v != float("inf") else -9


def letter_dosage(call: str, ref: str, alt: str) -> int:
    """A one- or two-letter call: 0 for the reference, 2 for the other allele, 1 for both; -9 is missing."""
    c = call.strip().upper()
    if c in NOT_CALLED:
        return -9
    if len(c) == 1:
        pair = AMBIGUITY.get(c, c + c)
    else:
        pair = c.replace("/", "").replace("|", "")
    if len(pair) != 2 or any(x not in (ref, alt) for x in pair):
        return -9
    return sum(x == alt for x in pair)
