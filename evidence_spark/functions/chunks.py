"""Flat chunks of text blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SENTENCE_END

#: Characters of blocks whose chunks are Python objects at once.
PIECE = 4 << 20
_SENTENCE = re.compile(f"(?<={SENTENCE_END})")


def flat_pieces(text: str, size: int, overlap: int) -> list[str]:
    """Greedy chunks of about `size` characters; each flush starts the next buffer with the last `overlap` ones."""
    size = max(size, 100)
    overlap = min(max(overlap, 0), size - 1)
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    parts: list[str] = []
    for sentence in filter(None, _SENTENCE.split(text)):
        parts += [sentence[i : i + size] for i in range(0, len(sentence), size)]
    out, held = [], ""
    for part in parts:
        if held and len(held) + len(part) > size:
            out.append(held)
            held = held[len(held) - overlap :] if overlap else ""
        held += part
    out.append(held)
    return [x for x in (p.strip() for p in out) if x]


def chunk_flat(text: Column, size: int = 600, overlap: int = 60) -> Column:
    """Array of the chunks of a block; null and blank blocks have none."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done, made, held = [], [], 0
            for t in texts:
                block = t.as_py() or ""
                made.append(flat_pieces(block, size, overlap))
                held += len(block)
                if held > PIECE:
                    done.append(pa.array(made, pa.list_(pa.string())))
                    made, held = [], 0
            yield pa.concat_arrays([*done, pa.array(made, pa.list_(pa.string()))])

    return run(text)
