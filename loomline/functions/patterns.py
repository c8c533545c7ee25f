"""Counts of many patterns in one pass over Arrow batches: RE2 reads a text once a pattern, however many alternatives that has."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import text as T


def re2(pattern: str) -> str:
    """The pattern for RE2 on text made by :func:`flat`. It must begin with a word boundary and a word's letter and know no class but the dot and white space.

    RE2 counts on in what a match leaves of the text, where its first character would stand at a boundary: a match
    that ends inside a word takes the rest of it along, in which none could begin.
    """
    if not re.match(r"\\b[(a-z0-9]", pattern) or re.search(r"\(\?|\\[^bs]|[\[\]^$_]|[^\x00-\x7F]", pattern):
        raise ValueError(f"not a pattern of whole words: {pattern}")
    return pattern.replace(".", r"[^\n\r]").replace(r"\s", r"[\t\n\x0b\f\r ]") + r"(?:\B\w+)?"


def flat(c: Column) -> Column:
    """The text with other letters and digits as _, other line ends as CR and all else beyond ASCII as one control character each."""
    letters = F.regexp_replace(c, r"[\p{L}\p{Nd}&&[^\x00-\x7F]]", "_")
    plain = F.regexp_replace(F.regexp_replace(letters, r"[\u0085\u2028\u2029]", "\r"), r"[^\x00-\x7F]", "\x01")
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(plain)


def match_counts(c: Column, patterns: Sequence[str]) -> Column:
    """Array of the numbers that :func:`loomline.functions.text.matches` gives for each pattern; a null text counts as empty."""
    forms = [re2(p) for p in patterns]

    @F.arrow_udf("array<int>")
    def counted(texts: pa.Array) -> pa.Array:
        found = [pc.count_substring_regex(pc.fill_null(texts, ""), p).to_numpy(zero_copy_only=False).astype(np.int32) for p in forms]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(forms)), pa.array(np.stack(found, 1).ravel()))

    # whether a combining mark belongs to a word depends on what it stands on, which is left to the JVM; line ends beyond ASCII are no white space
    marked = c.rlike(r"[\p{Mn}\u0085\u2028\u2029]" if any(r"\s" in p for p in patterns) else r"\p{Mn}")
    # deterministic, so that filters on other columns go below it
    return F.when(marked, F.array(*(T.matches(c, p) for p in patterns))).otherwise(counted(flat(F.coalesce(c, F.lit("")))))
