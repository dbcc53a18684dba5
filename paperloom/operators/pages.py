"""Page assembly, scanned-document gate and chunking across pages.

A document's full text is its stripped pages joined by a blank line.  It is never built as one value: pages get their
start position inside it, and chunks are put together from the page fragments they cover.  Positions come from a prefix
sum in two levels, over blocks of pages and within a block, so one huge document spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.chunking import cells, window_count, window_shape
from paperloom.functions.text import strip
from paperloom.schemas import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHARS_PER_PAGE, SCANNED_PDF, SUCCESS
from paperloom.session import cut_lineage

PAGES_PER_BLOCK = 1024
CHUNKS_PER_BLOCK = 1024
SEPARATOR = "\n\n"


def _block(number: str, size: int) -> Column:
    return F.floor(F.col(number) / size)


def _stripped(pages: DataFrame) -> DataFrame:
    return pages.select(
        "paper_id", "page_no", strip(F.col("text")).alias("text"), _block("page_no", PAGES_PER_BLOCK).alias("block")
    )


def page_lengths(pages: DataFrame) -> DataFrame:
    """Pages without their texts: ``(paper_id, page_no, length, block)``, all that block spans are made of."""
    return _stripped(pages).select("paper_id", "page_no", F.char_length("text").alias("length"), "block")


def block_spans(lengths: DataFrame) -> DataFrame:
    """Per (paper_id, block): where the block starts in the full text, plus document totals, from :func:`page_lengths`.

    At most PAGES_PER_BLOCK page lengths meet in one group; everything above that works on one row per block.
    """
    gap = len(SEPARATOR)
    lengths = lengths.groupBy("paper_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("page_no", "length"))).alias("pages")
    )
    filled = F.transform("pages", lambda page: page["length"] > 0)
    per_block = lengths.select(
        "paper_id",
        "block",
        F.size("pages").cast("bigint").alias("page_count"),
        F.aggregate(
            "pages", F.lit(0).cast("bigint"), lambda total, page: total + page["length"] + gap
        ).alias("block_chars"),
        F.nullif(F.array_position(filled, True), F.lit(0)).alias("first_filled"),
        F.nullif(F.array_position(F.reverse(filled), True), F.lit(0)).alias("last_filled"),
    )
    document = W.partitionBy("paper_id")
    before = document.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    placed = per_block.withColumn(
        "block_start", F.coalesce(F.sum("block_chars").over(before), F.lit(0)).cast("bigint")
    )
    # Blank pages add only their separator, so the first and last visible characters follow from page counts.
    visible_from = F.col("block_start") + gap * (F.col("first_filled") - 1)
    visible_to = F.col("block_start") + F.col("block_chars") - gap * F.col("last_filled")
    return placed.select(
        "paper_id",
        "block",
        "block_start",
        F.sum("page_count").over(document).alias("page_count"),
        (F.sum("block_chars").over(document) - gap).alias("n_chars"),
        F.min(visible_from).over(document).alias("text_from"),
        F.max(visible_to).over(document).alias("text_to"),
    )


def _gate(min_chars: float) -> Column:
    too_thin = F.col("n_chars") / F.col("page_count") < min_chars
    return F.when(too_thin, F.lit(SCANNED_PDF)).otherwise(F.lit(SUCCESS)).alias("status")


def document_status(pages: DataFrame, min_chars: float = MIN_CHARS_PER_PAGE) -> DataFrame:
    """Page count, length of the full text and gate result per document that has pages."""
    totals = pages.groupBy("paper_id").agg(
        F.count("*").alias("page_count"), F.sum(F.char_length(strip(F.col("text")))).alias("page_chars")
    )
    full_length = F.col("page_chars") + len(SEPARATOR) * (F.col("page_count") - 1)
    return totals.select("paper_id", "page_count", full_length.alias("n_chars")).select("*", _gate(min_chars))


def block_status(blocks: DataFrame, min_chars: float = MIN_CHARS_PER_PAGE) -> DataFrame:
    """The same from block spans, without another look at the pages."""
    return blocks.select("paper_id", "page_count", "n_chars").distinct().select("*", _gate(min_chars))


def page_spans(
    pages: DataFrame, min_chars: float = MIN_CHARS_PER_PAGE, blocks: DataFrame | None = None
) -> DataFrame:
    """The assembled documents, one row per page; only those in ``blocks`` where block spans are given.

    ``char_start`` places the stripped page in the full text, ``text_from``/``text_to`` bound its stripped form, and
    ``status`` is the gate result of the document.  Page numbers must be unique within a document.
    """
    blocks = block_spans(page_lengths(pages)) if blocks is None else blocks
    spans = _stripped(pages).join(blocks, ["paper_id", "block"])
    earlier = W.partitionBy("paper_id", "block").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length("text") + len(SEPARATOR)).over(earlier), F.lit(0))
    return spans.select(
        "paper_id",
        "page_no",
        "text",
        (F.col("block_start") + offset).alias("char_start"),
        "page_count",
        "n_chars",
        "text_from",
        "text_to",
        _gate(min_chars),
    )


def chunk_pages(spans: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping windows over each assembled document: ``(paper_id, chunk_index, text)``.

    Every page is cut at the window starts; a fragment goes to the window it lies in and, shortened to what is needed, to
    the earlier windows that reach into it.  A window gathers at most ``size`` characters.  The assembled windows are
    stored once before they are numbered.
    """
    size, step = window_shape(size, overlap)
    visible = spans.where((F.col("char_start") >= F.col("text_from")) & (F.col("char_start") < F.col("text_to")))
    piece = F.when(
        F.col("char_start") + F.char_length("text") < F.col("text_to"), F.concat("text", F.lit(SEPARATOR))
    ).otherwise(F.col("text"))
    pieces = visible.select(
        "paper_id",
        (F.col("char_start") - F.col("text_from")).alias("start"),
        (F.col("text_to") - F.col("text_from")).alias("total"),
        piece.alias("piece"),
    )
    to_boundary = (F.lit(step) - F.pmod("start", F.lit(step))).cast("int")
    head = F.left(F.col("piece"), to_boundary)
    tail = F.substring(F.col("piece"), to_boundary + 1, F.char_length("piece"))
    fragments = pieces.select(
        "paper_id",
        "start",
        "total",
        F.floor(F.col("start") / step).alias("first_cell"),
        F.posexplode(F.concat(F.array(head), cells(tail, step))).alias("nth", "fragment"),
    ).select(
        "paper_id",
        "total",
        (F.col("first_cell") + F.col("nth")).alias("cell"),
        F.when(F.col("nth") == 0, F.col("start"))
        .otherwise((F.col("first_cell") + F.col("nth")) * step)
        .alias("position"),
        "fragment",
    )
    reach = -(-size // step) - 1
    targets = F.transform(
        F.sequence(F.lit(0), F.lit(reach)), lambda back: (F.col("cell") - back).cast("bigint")
    )
    shares = fragments.select("*", F.explode(targets).alias("window")).where(
        (F.col("window") >= 0)
        & (F.col("window") < window_count(F.col("total"), size, step))
        & (F.col("position") < F.col("window") * step + size)
    )
    kept_chars = (F.col("window") * step + size - F.col("position")).cast("int")
    windows = shares.groupBy("paper_id", "window").agg(
        F.sort_array(
            F.collect_list(F.struct("position", F.left(F.col("fragment"), kept_chars).alias("fragment")))
        ).alias("parts")
    )
    text = strip(F.array_join(F.transform("parts", lambda part: part["fragment"]), ""))
    written = cut_lineage(windows.select("paper_id", "window", text.alias("text")))
    # Only a blank window makes the chunk numbers of its paper differ from the window numbers.
    # Mostly few: stored, so that Spark knows their size and need not shuffle all windows to find out.
    gaps = cut_lineage(written.where("text = ''").select("paper_id").distinct())
    dense = written.join(gaps, "paper_id", "left_anti").select(
        "paper_id", F.col("window").cast("int").alias("chunk_index"), "text"
    )
    return dense.unionByName(number_windows(written.join(gaps, "paper_id", "left_semi").where("text <> ''")))


def number_windows(windows: DataFrame) -> DataFrame:
    """Dense ``chunk_index`` over the remaining windows of each paper, again by blocks and within a block."""
    blocked = windows.withColumn("block", _block("window", CHUNKS_PER_BLOCK))
    counts = blocked.groupBy("paper_id", "block").agg(F.count("*").alias("in_block"))
    before = W.partitionBy("paper_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "paper_id", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("first_index")
    )
    nth = F.row_number().over(W.partitionBy("paper_id", "block").orderBy("window"))
    return blocked.join(starts, ["paper_id", "block"]).select(
        "paper_id", (F.col("first_index") + nth - 1).cast("int").alias("chunk_index"), "text"
    )
