"""APA and BibTeX citations and display strings, built from stored metadata by native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import present, words
from paperloom.schemas import SOURCE_LABELS


def _year(published: Column, missing: str) -> Column:
    return F.coalesce(F.year(published).cast("string"), F.lit(missing))


def _letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^a-zA-Z]", ""))


def _last_name_first(name: Column, parts: Column) -> Column:
    initials = F.transform(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda part: F.concat(F.left(part, F.lit(1)), F.lit(".")),
    )
    return F.when(F.size(parts) < 2, name).otherwise(
        F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(initials, " "))
    )


def apa_authors(authors: Column) -> Column:
    """Up to 20 names in full, beyond that the first 19, an ellipsis and the last."""
    count = F.size(authors)
    listed = F.filter(authors, lambda name, nth: (count <= 20) | (nth < 19) | (nth == count - 1))
    split = F.transform(listed, lambda name: F.struct(name.alias("name"), words(name).alias("parts")))

    def joint(nth: Column) -> Column:
        at_end = nth == F.least(count, F.lit(20)) - 1
        return (
            F.when(nth == 0, F.lit(""))
            .when(at_end & (count > 20), F.lit(", ... "))
            .when(at_end, F.lit(", & "))
            .otherwise(F.lit(", "))
        )

    pieces = F.transform(
        split, lambda author, nth: F.concat(joint(nth), _last_name_first(author["name"], author["parts"]))
    )
    return F.when(count > 0, F.array_join(pieces, "")).otherwise(F.lit("Unknown Author"))


def apa_citation(title: Column, authors: Column, published: Column, doi: Column, url: Column) -> Column:
    link = (
        F.when(present(doi), F.concat(F.lit(" https://doi.org/"), doi))
        .when(present(url), F.concat(F.lit(" "), url))
        .otherwise(F.lit(""))
    )
    return F.concat(
        apa_authors(authors), F.lit(" ("), _year(published, "n.d."), F.lit("). "), F.rtrim(title, F.lit(".")), F.lit("."), link
    )


def bibtex_key(title: Column, authors: Column, published: Column) -> Column:
    """Letters of the first author's last name, the year, letters of the first title word."""
    last_name = _letters(F.try_element_at(words(F.get(authors, F.lit(0))), F.lit(-1)))
    first_word = _letters(F.get(words(title), F.lit(0)))
    return F.concat(
        F.coalesce(last_name, F.lit("unknown")), _year(published, "nd"), F.coalesce(first_word, F.lit("paper"))
    )


def bibtex_citation(title: Column, authors: Column, published: Column, doi: Column, url: Column) -> Column:
    names = F.when(F.size(authors) > 0, F.array_join(authors, " and ")).otherwise(F.lit("Unknown Author"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"  {name} = {{"), value, F.lit("},"))

    lines = F.array(
        F.concat(F.lit("@article{"), bibtex_key(title, authors, published), F.lit(",")),
        field("title", title),
        field("author", names),
        field("year", _year(published, "n.d.")),
        F.when(present(doi), field("doi", doi)),
        F.when(present(url), field("url", url)),
        F.lit("}"),
    )
    return F.array_join(lines, "\n")


def first_author_last_name(authors: Column) -> Column:
    return F.coalesce(F.try_element_at(words(F.get(authors, F.lit(0))), F.lit(-1)), F.lit("Unknown"))


def byline(authors: Column) -> Column:
    """The first four authors, marked when there are more."""
    more = F.when(F.size(authors) > 4, F.lit(", et al.")).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(authors, 1, 4), ", "), more)


def source_label(source: Column) -> Column:
    labels = F.create_map(*[F.lit(item) for pair in SOURCE_LABELS.items() for item in pair])
    return F.coalesce(F.try_element_at(labels, source), source)
