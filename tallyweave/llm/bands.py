"""The MinHash band join (operator 4): near copies from equal bands of signatures, verified on the shingles.

A signature's BANDS bands are the block keys of a text's shingle set; texts meet where a band is equal.
What follows is the search of `nearsets`: large bands are worked off from their first members outwards,
shingle sets are made once for texts that a candidate names, and only verified links unite.

A pair of likeness s has no band in common with a probability of (1 - s**4)**32: under 1 in 10 million at 0.8.
Defined results: see nearsets; texts without words are equal to each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyweave.llm.common import importable, materialize
from tallyweave.llm.minhash import WIDTH, band_keys, signatures
from tallyweave.llm.nearsets import grouped, made_prints, near_sets


def band_prints(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """Prints as nearsets has them, with the whole set as its only part and the bands of its signature as keys."""

    def keys(texts: list[str], sets: list[np.ndarray], pieces: list[np.ndarray]) -> list[np.ndarray]:
        return list(band_keys(signatures([t.encode().lower() for t in texts], width)))

    return made_prints(docs, width, lambda x: [(0, x)], keys)


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """(doc_id, row, component_id): the smallest doc_id of each row's component; row is the XXH64 of the text."""
    importable(docs.sparkSession)
    prints = materialize(band_prints(docs, width=width), "band-prints")
    return grouped(prints, near_sets(docs, prints, threshold=threshold, width=width))
