"""Rule patterns, written in Python syntax, as Spark ``rlike`` literals.

Spark matches with the JVM's regex engine.  Character classes there are ASCII by
default, so the shorthand classes are spelled out as the Unicode sets Python
uses; matching then gives the same answer on every line.
"""

from __future__ import annotations

import re

try:  # the public name moved between Python versions
    from re import _constants as _c, _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p

# The characters Python counts as whitespace, word and digit.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
# Not before one of the printable ASCII characters, none of which is a space.
NO_SPACE = "(?-i:(?![!-~]))"

_CLASS = {"s": SPACE, "w": WORD, "d": DIGIT}
_EDGE = (
    f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
)
_QUANTIFIER = re.compile(r"\{\d*(,\d*)?\}")


def to_java(pattern: str) -> str:
    """Rewrite a Python pattern for the JVM regex engine."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch, two = pattern[i], pattern[i : i + 2]
        if ch == "\\" and len(two) == 2:
            key = two[1]
            if key.lower() in _CLASS:
                body = _CLASS[key.lower()]
                if in_class:
                    out.append(body if key.islower() else two)
                else:
                    out.append(f"[{body}]" if key.islower() else f"[^{body}]")
            elif key in "bB" and not in_class:
                out.append(_EDGE[key == "B"])
            elif key == "Z":
                out.append(r"\z")
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch == "[" or two == "&&":  # both are operators inside a JVM class
                ch = "\\" + ch
        elif ch == "[":
            in_class = True
            head = re.match(r"\[\^?\]?", pattern[i:]).group()
            ch = head.replace("]", r"\]")
            i += len(head) - 1
        elif ch == "{":
            quantifier = _QUANTIFIER.match(pattern, i)
            if quantifier and quantifier.group() not in ("{}", "{,}"):
                ch = quantifier.group().replace("{,", "{0,")
                i = quantifier.end() - 1
            else:
                ch = r"\{"
        elif ch == "}":
            ch = r"\}"
        elif pattern.startswith("(?P<", i):
            ch, i = "(?<", i + 3
        elif pattern.startswith("(?P=", i):
            name = pattern[i + 4 : pattern.index(")", i)]
            ch, i = rf"\k<{name}>", i + 4 + len(name)
        out.append(ch)
        i += 1
    return "".join(out)


def java_line_pattern(pattern: str) -> str:
    """Search pattern for one line (or a few joined lines): ignore case, multi-line.

    A pattern that looks around before it takes a digit would look around at every character;
    the digit is asked for first.  One that starts with a space would compare every character with
    ten ranges, each in both cases; the printable ASCII ones, nearly all, are ruled out by one range.
    """
    first = f"(?=[{DIGIT}])" if _looks_before_digit(pattern) else NO_SPACE if _starts_with_space(pattern) else ""
    return "(?imu)" + first + to_java(pattern)


def java_name_pattern(pattern: str) -> str:
    """Pattern anchored at the start of a file name, ignoring case."""
    return "(?iu)^(?:" + to_java(pattern) + ")"


def names_line_break(pattern: str) -> bool:
    """Was the pattern written for several lines, that is, does it ask for a line feed?"""
    return _holds_line_feed(_p.parse(pattern, re.IGNORECASE | re.MULTILINE))


def _holds_line_feed(items) -> bool:
    for op, arg in items:
        if op is _c.LITERAL and arg == 10 or op is _c.IN and (_c.LITERAL, 10) in arg and arg[0][0] is not _c.NEGATE:
            return True
        if op is _c.BRANCH:
            parts = arg[1]
        elif op is _c.SUBPATTERN:
            parts = [arg[3]]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            parts = [arg[2]]
        else:  # what is only looked at does not make a match longer
            continue
        if any(map(_holds_line_feed, parts)):
            return True
    return False


def _looks_before_digit(pattern: str) -> bool:
    """Does every match start with a digit, and the pattern with an assertion?"""
    items = _p.parse(pattern, re.IGNORECASE | re.MULTILINE)
    return bool(items) and items[0][0] in (_c.ASSERT, _c.ASSERT_NOT, _c.AT) and _starts_with(items, _c.CATEGORY_DIGIT)


def _starts_with_space(pattern: str) -> bool:
    """Does every match start with a space, which the pattern takes before anything else?"""
    items = _p.parse(pattern, re.IGNORECASE | re.MULTILINE)
    return bool(items) and items[0][0] not in (_c.ASSERT, _c.ASSERT_NOT, _c.AT) and _starts_with(items, _c.CATEGORY_SPACE)


def _starts_with(items, category) -> bool:
    for op, arg in items:
        if op in (_c.ASSERT, _c.ASSERT_NOT, _c.AT):
            continue  # takes no character
        if op is _c.SUBPATTERN:
            return _starts_with(arg[3], category)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            return arg[0] >= 1 and _starts_with(arg[2], category)
        return op is _c.IN and arg == [(_c.CATEGORY, category)]
    return False


def required_words(pattern: str) -> list[list[str]]:
    """Literal text that every match contains, as lower-case ASCII alternatives.

    ``[[a, b], [c]]`` means: a match contains ``a`` or ``b``, and it contains ``c``.
    The scan tests these with plain string search before it runs the regex.  A wrong
    answer would lose findings, so whatever is not understood adds no requirement.
    The most selective requirements come first; three are enough.
    """
    clauses = {frozenset(_minimal(c)) for c in _clauses(_p.parse(pattern, re.IGNORECASE | re.MULTILINE))}
    ranked = sorted(clauses, key=lambda c: (-min(4, min(map(len, c))), len(c), sorted(c)))
    return [sorted(c) for c in ranked[:3]]


def _clauses(items) -> list[set[str]]:
    found, run = [], {""}
    for op, arg in items:
        exact = _exact(op, arg)
        if exact and len(run) * len(exact) <= 24:
            run = {a + b for a in run for b in exact}
            continue
        if run != {""}:
            found.append(run)
        run = exact or {""}
        if exact:
            continue
        if op is _c.SUBPATTERN:
            found += _clauses(arg[3])
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            found += _clauses(arg[2])
        elif op is _c.BRANCH:
            parts = [max(_clauses(p), key=lambda c: (min(map(len, c)), -len(c)), default=None) for p in arg[1]]
            if all(parts):
                found.append(set().union(*parts))
    if run != {""}:
        found.append(run)
    return found


def _exact(op, arg) -> set[str] | None:
    """All texts an element can match, if they are few and ASCII."""
    if op is _c.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is _c.IN:
        sets = [_exact(o, a) if o is _c.LITERAL else None for o, a in arg]
        return set().union(*sets) if len(sets) <= 6 and all(sets) else None
    if op is _c.SUBPATTERN:
        return _exact_run(arg[3])
    if op is _c.BRANCH:
        parts = [_exact_run(p) for p in arg[1]]
        return set().union(*parts) if all(parts) else None
    return None


def _exact_run(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        exact = _exact(op, arg)
        if not exact or len(out) * len(exact) > 24:
            return None
        out = {a + b for a in out for b in exact}
    return out


def _minimal(words: set[str]) -> set[str]:
    return {w for w in words if not any(o != w and o in w for o in words)}
