"""Words of whole Arrow text columns, as a dictionary of exact strings and codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm import arrays


@dataclass
class Words:
    """Distinct words, and for every word its code and the row it is in, in text order."""

    names: pa.Array
    code: np.ndarray
    row: np.ndarray
    n_rows: int


def byte_map(is_word: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every byte that is in no word as a space, other bytes as they are."""
    out = arrays.lower(np.arange(256, dtype=np.uint8))
    return np.where(is_word, out, np.uint8(32)).astype(np.uint8)


def split(data: np.ndarray, bounds: np.ndarray, mapped: np.ndarray, longer: int = 0) -> Words:
    """Words of more than ``longer`` bytes of texts given end to end as UTF-8; ``mapped`` comes from ``byte_map``.

    A byte below 128 stands for itself in UTF-8, so replacing such bytes keeps texts valid.
    """
    n = len(bounds) - 1
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.tobytes().translate(mapped.tobytes()))]
    texts = pa.LargeStringArray.from_buffers(n, *buffers[1:])
    lists = pc.ascii_split_whitespace(texts)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    # Spaces at the ends of a text leave empty pieces.
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > longer
    if not some.all():
        flat, row = flat.filter(pa.array(some)), row[some]
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(coded.dictionary, code, row.astype(np.int64), n)


def string_hash(names: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, computed piece by piece so that tables of powers stay small."""
    data, bounds = arrays.utf8(names)
    out = np.zeros(len(names), np.uint64)
    for i, j in arrays.spans(bounds):
        prefix = arrays.prefix_hash(data[bounds[i] : bounds[j]])
        inner = bounds[i : j + 1] - bounds[i]
        out[i:j] = arrays.range_hash(prefix, inner[:-1], inner[1:])
    return out
