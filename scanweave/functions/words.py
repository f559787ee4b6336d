"""Where a rule could match at all, judged by the words it requires.

Hundreds of words are looked for in every file.  One string search per word costs
more than everything else in the scan, so all words are found together in one pass
by an automaton, in an Arrow batch function.  (Measured on prose: about 14 times
faster than ``contains`` per word in SQL.)  A worker without the library searches for the
words one by one, with the same result; the driver's own libraries play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from .regex import required_words
from .text import LINE_BREAK, sql_string

# Shorter words are on nearly every line: looking for them is wasted work.
MIN_WORD = 3


def clauses_of(pattern: str) -> list[list[str]]:
    """Required words worth looking for; empty means every line must be tried."""
    return [c for c in required_words(pattern) if min(map(len, c)) >= MIN_WORD]


def candidate_lines_sql(text: str, short_lines: str, patterns: tuple[str, ...]) -> str:
    """``array<array<int>>``: per pattern all short lines if ``text`` has its words."""
    tests = []
    for pattern in patterns:
        clauses = [" OR ".join(f"contains({text}, {sql_string(w)})" for w in c) for c in clauses_of(pattern)]
        found = " AND ".join(f"({c})" for c in clauses)
        tests.append(f"CASE WHEN {found} THEN {short_lines} END" if found else "CAST(NULL AS ARRAY<INT>)")
    return f"array({', '.join(tests)})"


def candidate_lines_udf(patterns: tuple[str, ...], max_chars: int | None = None, library: bool = True, bits: tuple[int, ...] | None = None):
    """``array<array<int>>`` of the text: per pattern the numbers of the lines, of
    at most ``max_chars`` if given, that hold its required words, as
    :func:`~scanweave.functions.text.fold_sql` writes them.

    With ``bits``, one per pattern, the function takes a second column, a mask: only the words
    of patterns whose bit is set are searched, and with no bit set the text is not looked at.
    The function carries its word lists with it and imports what it needs where it
    runs, so executors need no copy of this package.
    """
    clauses = [[frozenset(c) for c in clauses_of(p)] for p in patterns]
    n_patterns, line_break = len(patterns), LINE_BREAK

    def folded(text):
        """ASCII letters in lower case, and the characters that match one; words have no others."""
        if text.isascii():
            return text.lower()
        for odd, letter in zip("\u017f\u212a\u0131\u0130", "skii"):
            text = text.replace(odd, letter)
        return text.encode().lower().decode()

    def finder(mask):
        """The search for the patterns of one mask."""
        import re
        from bisect import bisect_right

        asked_by = {}
        chosen = [no for no in range(n_patterns) if mask is None or bits[no] & mask]
        for no in chosen:
            for word in clauses[no][0] if clauses[no] else ():
                asked_by.setdefault(word, []).append(no)
        words = sorted({w for no in chosen for c in clauses[no] for w in c})
        try:
            if not library:
                raise ImportError
            from ahocorasick import Automaton

            automaton = Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            occurrences = automaton.iter
        except ImportError:

            def occurrences(text):
                for word in words:
                    at = text.find(word)
                    while at >= 0:
                        yield at + len(word) - 1, word
                        at = text.find(word, at + 1)

        breaks = re.compile(line_break)

        def find(text):
            on_line = {}
            if text and words:
                text = folded(text)
                ends = None
                for at, word in occurrences(text):
                    if ends is None:
                        ends = [(m.start(), m.end()) for m in breaks.finditer(text)]
                        starts = [0] + [e for _, e in ends]
                    on_line.setdefault(bisect_right(starts, at), set()).add(word)
            if not on_line:
                return []
            out = [None] * n_patterns
            for n in sorted(on_line):
                end = ends[n - 1][0] if n <= len(ends) else len(text)
                if max_chars is not None and end - starts[n - 1] > max_chars:
                    continue
                found = on_line[n]
                for no in {no for w in found for no in asked_by.get(w, ())}:
                    if not any(found.isdisjoint(c) for c in clauses[no]):
                        if out[no] is None:
                            out[no] = []
                        out[no].append(n)
            return out

        return find

    if bits is None:

        @F.pandas_udf("array<array<int>>")
        def candidate_lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import pandas

            find = finder(None)
            for texts in batches:
                yield pandas.Series([find(t) for t in texts], index=texts.index, dtype=object)

        return candidate_lines

    @F.pandas_udf("array<array<int>>")
    def active_candidate_lines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import pandas

        finders = {}  # as many as there are sets of active domains

        def find(text, mask):
            if not mask or not text:
                return []
            if mask not in finders:
                finders[mask] = finder(mask)
            return finders[mask](text)

        for texts, masks in batches:
            yield pandas.Series([find(t, int(m)) for t, m in zip(texts, masks)], index=texts.index, dtype=object)

    return active_candidate_lines
