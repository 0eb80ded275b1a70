"""Cutting texts into overlapping chunks and tagging them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError, quoted, require

CHUNK_SIZE = 1_000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of a text, each later part keeping its separator in front."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *[separator + r for r in rest]] if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``, starting each chunk with at
    most ``overlap`` characters of the one before."""
    chunks: list[str] = []
    held: list[str] = []
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            chunks.append("".join(held).strip())
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    chunks.append("".join(held).strip())
    return [c for c in chunks if c]


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS) -> list[str]:
    """Split at the coarsest separator present; pieces that are still too long
    are split again at finer ones."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    chunks: list[str] = []
    fitting: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        if fitting:
            chunks += _packed(fitting, size, overlap)
            fitting = []
        chunks += split_text(piece, size, overlap, finer) if finer else [piece]
    return chunks + _packed(fitting, size, overlap) if fitting else chunks


def chunk_text(
    df: DataFrame,
    text: str = "text",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk: all other columns, ``chunk_no`` and ``chunk``.

    A projection with one Arrow function, so nothing is shuffled.
    """
    require(df, text)
    if not 0 <= overlap < chunk_size:
        raise ParameterError("overlap must be smaller than chunk_size")

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split_text(t, chunk_size, overlap) if isinstance(t, str) else [])

    rest = [quoted(c) for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(cut(quoted(text))).alias("chunk_no", "chunk"))


def attach_metadata(df: DataFrame, metadata: dict[str, str], column: str = "metadata") -> DataFrame:
    """Merge entries into a text map; new values win over old ones."""
    pairs = [x for k, v in metadata.items() for x in (F.lit(str(k)), F.lit(str(v)))]
    added = F.create_map(*pairs)
    if column not in df.columns:
        return df.withColumn(column, added)
    old = F.coalesce(quoted(column), F.create_map().cast("map<string,string>"))
    untouched = F.map_filter(old, lambda k, _: ~k.isin(*[str(k_) for k_ in metadata]))
    return df.withColumn(column, F.map_concat(untouched, added))
