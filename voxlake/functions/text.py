"""File names and text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of names and log lines.
STRICT_NAME = r"^{kind}_(\d+)\.nrrd$"
SIGNED_FLOAT = r"(-?\d+\.?\d*(?:[eE][-+]?\d+)?)"
METRIC_IN_TEXT = r"(?i)(?:best|val|metric)[^0-9\-]*([0-9]+\.[0-9]+)"
DETECTION_NAME = r"^(\d+)_boxes$"
TRAIN_MARK, TRAIN_LABEL = "training_epoch_end", "Train loss reached"
VAL_MARK, VAL_LABEL = "validation_epoch_end", "Val loss reached"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def _captured_long(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint")


def case_id_from_name(path: Column, kind: str | None = None, strict: bool = True) -> Column:
    """Case number in a file name, NULL where the name does not fit.

    Strict names are ``<kind>_<digits>.nrrd`` (any zero padding). The lax form
    takes the last ``_`` token of the stem.
    """
    if strict:
        return _captured_long(base_name(path), STRICT_NAME.format(kind=kind or "(?:DATA|MASK)"))
    return _captured_long(F.element_at(F.split(stem(path), "_"), -1), r"^(\d+)$")


def detection_case_id(path: Column) -> Column:
    return _captured_long(stem(path), DETECTION_NAME)


def canonical_names(case_id: Column) -> Column:
    """Struct of the image, label and sidecar names of a case."""
    label = F.format_string("%04d.nii.gz", case_id)
    return F.struct(
        F.format_string("%04d_0000.nii.gz", case_id).alias("image"),
        label.alias("label"),
        sidecar_name(label).alias("sidecar"),
    )


def sidecar_name(label: Column) -> Column:
    return F.concat(stem(label), F.lit(".json"))


def parse_signed_float(line: Column, label: str) -> Column:
    """Number after ``<label>:``, NULL where the line has none."""
    found = F.regexp_extract(line, label + r":\s*" + SIGNED_FLOAT, 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def last_metric_in_text(text: Column, default: float = 0.0) -> Column:
    """Last ``best|val|metric ... <decimal>`` in a text."""
    found = F.regexp_extract_all(text, F.lit(METRIC_IN_TEXT), 1)
    last = F.try_element_at(found, F.lit(-1)).try_cast("double")
    return F.coalesce(last, F.lit(default))
