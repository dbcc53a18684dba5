"""Overlapping character windows over a text column, in time linear in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import strip
from paperloom.schemas import CHUNK_OVERLAP, CHUNK_SIZE


def window_shape(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> tuple[int, int]:
    """``(window size, step)`` of windows that share ``overlap`` characters with the next."""
    if not 0 <= overlap < size:
        raise ValueError(f"windows of {size} characters cannot share {overlap} and go on")
    return size, size - overlap


def window_count(length: Column, size: int, step: int) -> Column:
    """Number of windows: a window is opened only if the one before it stopped short of the end."""
    beyond_first = F.greatest(length - size, F.lit(0))
    return F.floor((beyond_first + (step - 1)) / step).cast("int") + 1


def cells(text: Column, step: int) -> Column:
    """The text cut into consecutive pieces of ``step`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))


def chunk_documents(
    df: DataFrame,
    text_col: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per non-blank window: the columns of ``df`` without the text, ``chunk_index`` and ``text``.

    A window of ``size`` characters starts at every multiple of the step.  Cutting the text once into step-long cells
    and joining neighbouring cells avoids searching for the n-th character again for each window.
    """
    size, step = window_shape(size, overlap)
    keep = [name for name in df.columns if name != text_col]
    stripped = df.select(*keep, strip(F.col(text_col)).alias("_text"))
    cut = stripped.select(*keep, F.char_length("_text").alias("_length"), cells(F.col("_text"), step).alias("_cells"))

    windows = F.col("_cells")
    for ahead in range(1, -(-size // step)):
        following = F.slice("_cells", ahead + 1, F.greatest(F.size("_cells"), F.lit(1)))
        windows = F.zip_with(windows, following, lambda left, right: F.concat(left, F.coalesce(right, F.lit(""))))
    windows = F.slice(windows, F.lit(1), window_count(F.col("_length"), size, step))
    windows = F.transform(windows, lambda window: strip(F.left(window, F.lit(size))))
    windows = F.filter(windows, lambda window: window != "")
    return cut.select(*keep, F.posexplode(windows).alias("chunk_index", "text"))


def chunk_id(paper_id: Column, chunk_index: Column) -> Column:
    return F.concat(paper_id, F.lit("::chunk_"), chunk_index.cast("string"))
