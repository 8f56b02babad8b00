"""Identifiers and names: cleaning, splitting, classifying."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = ["L1-L2", "L2-L3", "L3-L4", "L4-L5", "L5-S1"]


def norm_id(c: Column) -> Column:
    """Trimmed id; a whole number written with ".0" loses it, leading zeros stay."""
    return F.regexp_replace(F.trim(c.cast("string")), r"^(\d+)\.0$", "$1")


def patient_of(sample_id: Column) -> Column:
    return F.split(sample_id, "_")[0]


def level_of(sample_id: Column) -> Column:
    return F.get(F.split(sample_id, "_"), F.lit(1))


def task_of(level: Column, levels: list[str]) -> Column:
    """Position of the level in the list, from 0; null if it is not there."""
    at = F.array_position(F.lit(levels), level)
    return F.when(at > 0, (at - 1).cast("int"))


def base_case(case_id: Column) -> Column:
    return F.substring_index(case_id, "_", 1)


def condition_of(case_id: Column) -> Column:
    """What follows the first "_", without one "_image" and then one "_mask" at its end; "gold" without a "_"."""
    rest = F.regexp_replace(case_id, r"^[^_]*_", "")
    bare = F.regexp_replace(F.regexp_replace(rest, "_image$", ""), "_mask$", "")
    return F.when(F.instr(case_id, "_") == 0, F.lit("gold")).otherwise(bare)


def finite(c: Column) -> Column:
    """The number as a double; null for NaN, infinities and what is no number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


#: Grades in roman numerals.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5}


def grade_of(c: Column) -> Column:
    """Grade 1 to 5 from a number or a roman numeral; anything else is null."""
    text = F.upper(F.trim(c.cast("string")))
    roman = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    number = text.try_cast("double").try_cast("int")
    return F.coalesce(F.element_at(roman, text), F.when(number.between(1, 5), number))


#: Feature families by the first part of a name.
FAMILIES = {"classic": "classic", "pyradiomics": "pyradiomics", "pyr": "pyradiomics", "deep": "deep", "deeppca": "deep", "tensor": "tensor", "tucker": "tensor", "tensorpca": "tensor"}


def family_of(feature: Column) -> Column:
    first = F.lower(F.split(feature, "_")[0])
    families = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.when(F.contains(feature, F.lit("_")), F.try_element_at(families, first))  # a name of one part has none


def forced_names(names: list[str], segments: list[str] = SEGMENTS) -> list[str]:
    """Trimmed feature names without their segment part, each once, in the given order; of several parts, that of the list's first segment goes, once."""
    bare = [(name or "").strip() for name in names]
    parts = [next((part for s in segments if (part := f"_{s}_") in name), "_") for name in bare]
    return [n for n in dict.fromkeys(name.replace(part, "_", 1) for name, part in zip(bare, parts, strict=True)) if n]


#: How signs of comparison are spelled in a name.
SIGNS = {">=": "ge_", "<=": "le_", ">": "gt_", "<": "lt_", "=": "eq_"}
_SIGN = re.compile(">=|<=|[<>=]")


def name_part(text: str) -> str:
    """A text as part of a column or file name: signs of comparison spelled out, runs of blanks, dashes, underscores and signs that a
    file name may not have as one "_", none at the ends; "empty" for nothing."""
    spelled = _SIGN.sub(lambda m: SIGNS[m[0]], str(text).strip())
    return re.sub(r"[\\/:*?\"|\s_-]+", "_", spelled).strip("_") or "empty"


def dummy_name(column: str, level: str, prefix: str = "") -> str:
    """Name of a level's dummy column."""
    return f"{prefix}{name_part(column)}__{name_part(level)}"


#: What marks a file as a mask.
MASK_MARKS = ["_mask", "_seg", "-mask", "-seg"]


def pair_key(path: Column, mask: bool = False) -> Column:
    """Folder and file name without its suffixes; of a mask also without the marks, wherever they stand in the name."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    stem = F.regexp_extract(path, r"(\.?[^./]*)[^/]*$", 1)
    for mark in MASK_MARKS if mask else []:
        stem = F.replace(stem, F.lit(mark), F.lit(""))
    return F.concat(F.coalesce(folder, F.lit("")), stem)
