"""Benchmark items in documents, allowing for edits: pigeonhole pieces and Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import kinds_of
from paperloom.session import cut_lineage

#: Edits allowed, in percent of an item's normalised characters.
EDIT_PERCENT = 5
#: Shorter items, in normalised characters, must stand word for word.
LEAST_CHARS = 40
#: Characters of benchmark texts that one pass over the documents looks for.
PASS_CHARS = 2_000_000
FOUND = "doc_id long, item_id long, errors int, first_char int, last_char int"
_gap = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """Lower case, every run of other characters than letters and digits a space."""
    return _gap.sub(" ", text.lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces and where they start: ``errors`` edits leave one of them whole."""
    cuts = [len(item) * n // (errors + 1) for n in range(errors + 2)]
    return [(low, item[low:high]) for low, high in zip(cuts, cuts[1:], strict=False)]


def nearest(item: str, text: str) -> tuple[int, int]:
    """Fewest edits between ``item`` and any substring of ``text``, and where the first such substring ends.

    Myers' recurrence: one integer holds a whole column of the distance matrix as its vertical differences.
    """
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    at: dict[str, int] = {}
    for place, letter in enumerate(item):
        at[letter] = at.get(letter, 0) | 1 << place
    up, down, score = full, 0, size
    best, end = size, 0
    for place, letter in enumerate(text, 1):
        equal = at.get(letter, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise = down | (full & ~(across | up))
        fall = up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up = fall | (full & ~(vertical | rise))
        down = rise & vertical
        if score < best:
            best, end = score, place
    return best, end


class Matcher:
    """Finds items in normalised texts; every piece of every item is a word of one automaton.

    Items of fewer than ``least`` characters have no errors and are whole words.
    """

    def __init__(self, items: list[tuple[int, str]], percent: int, least: int = LEAST_CHARS):
        import ahocorasick

        self.items = [(item_id, text, len(text) * percent // 100 if len(text) >= least else None) for item_id, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for nth, (_, text, errors) in enumerate(self.items):
            for start, piece in pieces(text, errors or 0):
                places.setdefault(piece, []).append((nth, start + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, own in places.items():
            self.automaton.add_word(piece, own)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item found: fewest errors, first and last character of the leftmost place with them."""
        found: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, list[int]] = {}
        if not self.items:
            return found
        for last, own in self.automaton.iter(text):
            for nth, length in own:
                item_id, item, errors = self.items[nth]
                start = last + 1 - length
                if errors is None:
                    if (not start or text[start - 1] == " ") and text[last + 1 : last + 2] in ("", " "):
                        place = (0, start, last)
                        found[item_id] = min(place, found.get(item_id, place))
                    continue
                # A look around a start covers all places that begin within the errors of it.
                looked = tried.setdefault(nth, [])
                if any(abs(start - before) <= errors for before in looked[-8:]):
                    continue
                looked.append(start)
                low = max(0, start - 2 * errors)
                best, end = nearest(item, text[low : start + len(item) + 2 * errors])
                if best <= errors and (item_id not in found or best <= found[item_id][0]):
                    _, size = nearest(item[::-1], text[low : low + end][::-1])
                    place = (best, low + end - size, low + end - 1)
                    found[item_id] = min(place, found.get(item_id, place))
        return found


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], percent: int, least: int) -> Matcher:
    return Matcher(list(items), percent, least)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT, least: int = LEAST_CHARS, carry: Sequence[str] = ()
) -> DataFrame:
    """``(doc_id, item_id, errors, first_char, last_char)``: benchmark items that documents hold with few edits; after them
    the columns ``carry`` of the document's row.

    Texts are compared in lower case with every run of other characters as one space; an item of n such characters may
    differ by ``n * percent // 100`` insertions, deletions and replacements; one of fewer than ``least`` must stand there
    without any, as whole words. One row per row of ``docs`` and item: the
    place with the fewest errors, the first of equal ones; places count in the normalised text.

    The distinct items go to the tasks in blocks of a fixed number of characters, a pass over ``docs`` for each, so that memory
    does not grow with the benchmark. Null texts, items without a letter or digit and documents without a hit
    give no rows; a null ``doc_id`` or ``item_id`` is kept. Further columns are ignored.
    """
    distinct = benchmark.where("text is not null").select("item_id", "text").distinct()
    sized = distinct.withColumn("deal", F.xxhash64("item_id", "text"))
    passes = max(1, -(-(sized.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // PASS_CHARS))
    found = None
    for turn in range(passes):
        block = sized.where(F.pmod("deal", F.lit(passes)) == turn).select("item_id", "text").collect()
        items = sorted({(row.item_id, normalised(row.text)) for row in block}, key=lambda item: (item[0] is not None, item[0] or 0, item[1]))
        own, sent = _pass(docs, tuple((item_id, text) for item_id, text in items if text), percent, least, carry)
        if passes > 1:
            # The hits are stored, so that one pass's items are held at a time.
            own = cut_lineage(own)
            sent.destroy()
        found = own if found is None else found.union(own)
    return found


def _pass(docs: DataFrame, items: tuple[tuple[int, str], ...], percent: int, least: int, carry: Sequence[str]) -> tuple[DataFrame, Broadcast]:
    """The hits of one block of items, and the broadcast that holds it."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(sent.value, percent, least)
        for batch in batches:
            rows = [
                (doc_id, item_id, *hit, at)
                for at, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
                if text
                for item_id, hit in matcher.find(normalised(text)).items()
            ]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = [column.split()[0] for column in FOUND.split(", ")]
            columns = [pa.array([row[n] for row in rows], kind) for n, kind in enumerate(kinds)]
            at = pa.array([row[-1] for row in rows], pa.int64())
            columns += [batch.column(name).take(at) for name in carry]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *carry])

    return docs.select("doc_id", "text", *carry).mapInArrow(search, FOUND + kinds_of(docs, carry)), sent
