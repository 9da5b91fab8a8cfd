"""Labels of journeys and ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = " → "
DOT = " · "


def station_pair(label: Column) -> Column:
    """struct<board, alight, line> of 'board → alight · line'; null without an arrow, line null without a dot."""
    ends = F.split(F.element_at(F.split(label, DOT), 1), ARROW)
    line = F.when(F.contains(label, F.lit(DOT)), F.trim(F.element_at(F.split(label, DOT), 2)))
    return F.when(F.size(ends) == 2, F.struct(F.trim(ends[0]).alias("board"), F.trim(ends[1]).alias("alight"), line.alias("line")))


def pair_label(board: Column, alight: Column, line: Column) -> Column:
    return F.concat(board, F.lit(ARROW), alight, F.when(line.isNotNull(), F.concat(F.lit(DOT), line)).otherwise(F.lit("")))


def normal_name(name: Column) -> Column:
    """Lower case, without punctuation, words that mean a station, and doubled spaces."""
    plain = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N} ]", " ")
    plain = F.regexp_replace(plain, r"\b(rail|underground|tube|railway|train) station\b|\bstation\b", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def line_token(name: Column) -> Column:
    """What a line's name begins with, before 'line' or a bracket."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s*(\bline\b.*|\(.*)$", ""))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def place_label(label: Column, venue: Column, generic: Column) -> Column:
    """Home and Work come before a venue's name, that before what is generic."""
    return F.when(label.isin("Home", "Work"), label).otherwise(F.coalesce(venue, label, generic))


def is_named(label: Column) -> Column:
    return label.isNotNull() & ~label.rlike(r"^(Place|Stay) ?\d*$")


def bus_label(ref: Column, name: Column) -> Column:
    return F.when(ref.isNotNull(), F.concat(F.lit("Bus "), ref)).otherwise(name)


def profile_text(profile: Column) -> Column:
    """24 shares as comma-joined thousandths."""
    return F.array_join(F.transform(profile, lambda p: F.floor(p * 1000 + 0.5).cast("string")), ",")


def profile_of(text: Column) -> Column:
    """The shares of such a text; null unless there are 24 numbers."""
    parts = F.split(text, ",")
    ok = (F.size(parts) == 24) & F.forall(parts, lambda p: F.trim(p).rlike(r"^\d+$"))
    return F.when(ok, F.transform(parts, lambda p: F.trim(p).try_cast("double") / 1000))
