"""Shell globs as anchored regexes.  ``*`` crosses ``/``, as in Python's fnmatch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(glob: Column) -> Column:
    return F.ltrim(glob, F.lit("/"))


def has_wildcard(glob: Column) -> Column:
    return glob.rlike(r"[*?\[]")


def glob_regex(glob: Column, and_below: bool = False) -> Column:
    """Regex for a column of globs, built with string functions only; with
    ``and_below`` it also covers everything under a matching path.

    The glob is cut into bracket sets, wildcards and plain text; each piece is
    translated on its own and the pieces are joined again.
    """
    pieces = F.regexp_extract_all(glob, F.lit(r"(?s)\[!?\]?[^\]]*\]|\*+|\?|\[|[^*?\[]+"), F.lit(0))

    def escape(text: Column) -> Column:
        return F.regexp_replace(text, r"([\\\[\]&^~|-])", r"\\$1")

    def member(token: Column) -> Column:
        low, high = F.substring(token, 1, 1), F.substring(token, 3, 1)
        span = F.when(low <= high, F.concat(escape(low), F.lit("-"), escape(high))).otherwise(F.lit(""))
        return F.when(F.char_length(token) == 3, span).otherwise(escape(token))

    def bracket(piece: Column) -> Column:
        body = F.regexp_replace(F.substring(piece, 2, 1 << 30), r"\]\z", "")
        negated = body.startswith("!")
        members = F.regexp_extract_all(F.regexp_replace(body, r"\A!", ""), F.lit("(?s).-.|."), F.lit(0))
        inside = F.array_join(F.transform(members, member), "")
        return (
            F.when((inside == "") & negated, F.lit("."))
            .when(inside == "", F.lit("(?!)"))
            .otherwise(F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), inside, F.lit("]")))
        )

    def translate(piece: Column) -> Column:
        return (
            F.when(piece.startswith("*"), F.lit(".*"))
            .when(piece == "?", F.lit("."))
            .when(piece == "[", F.lit(r"\["))
            .when(piece.startswith("["), bracket(piece))
            .otherwise(F.regexp_replace(piece, r"([^\p{L}\p{N}_/])", r"\\$1"))
        )

    end = r")(?:/.*)?\z" if and_below else r")\z"
    return F.concat(F.lit(r"(?s)\A(?:"), F.array_join(F.transform(pieces, translate), ""), F.lit(end))
