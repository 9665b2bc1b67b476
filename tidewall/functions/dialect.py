"""How the fixed patterns are run by Spark's regex functions.

* ``d`` flag: ``.`` stops only at a newline.  ``U`` flag: ``\\w``, ``\\d`` and ``\\b`` follow Unicode.
* ``\\s`` is widened to the white space class the scores use.
* Case-insensitive patterns run case-sensitively on *folded* text.  Folding maps every character that a
  case-insensitive ASCII letter can match (including dotless i, long s and the Kelvin sign) to that letter, once per
  text instead of once per pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_IN_PATTERN = r"[\s\x1c-\x1f\x85\p{Z}]"


#: White space that stays on the line, and a run of white space with a line's end in it.
ON_LINE = r"[\s&&[^\n]]"
OVER_LINES = rf"(?>{ON_LINE}*+\n\s*+)"


def java_pattern(pattern: str, folded: bool = False) -> str:
    """The pattern as Spark runs it; ``folded`` patterns are matched against folded text."""
    return _java(_lowered(pattern) if folded else pattern)


def search_pattern(pattern: str, folded: bool = False) -> str:
    """The same for tests of whether the pattern occurs at all, in time linear in the text (`linear`)."""
    return _java(linear(_lowered(pattern) if folded else pattern))


def _java(pattern: str) -> str:
    return "(?Ud)" + pattern.replace(r"\s", SPACE_IN_PATTERN)


def _lowered(pattern: str) -> str:
    assert not any(e in pattern for e in (r"\S", r"\W", r"\D", r"\B"))
    return pattern.lower()


def linear(pattern: str) -> str:
    """A pattern that occurs in the same texts and reads a line, or what stands between two marks, a few times at most.

    As written, every ``HEAD`` of ``HEAD.*NEXT.*LAST`` rescans the rest of its line, and so does every ``NEXT``.  Of the
    pieces found on one line the first ends first, so whatever a later one reaches, the first reaches too: atomic groups
    commit to it.  Pieces with white space may run over a line's end.  Those are alternatives of their own: what they
    take of their last line is its beginning, so a line has one such piece, and scanning from it is linear again.
    """
    if re.search(r"\[\^[>)]\]\*", pattern):
        return _marked(pattern)
    opened, begin, body = pattern.partition(r"(?:^|;|\n)\s*")
    if begin:
        # as written, every line's end in a run of white space reads the run to its end
        return rf"{opened}(?:^\s*+|;\s*+|(?<!\s){OVER_LINES}){body}"
    # letters with an `e` among them, up to white space: the first `e` decides
    pattern = pattern.replace("[a-za-z]*e[a-za-z]*", "[a-df-z]*+e[a-z]*+")
    head, *rest = re.split(r"(?<!\\)\.\*\??", pattern.replace("(.*?)", ".*?"))
    if not rest:
        return pattern
    on_line, over_lines = _piece(head)
    tail = _rest(rest)
    forms = [rf"^(?>.*?{on_line}){tail}", *(form + tail for form in over_lines)]
    if head.endswith(r"\s+") and rest[0].startswith(r"\s+"):  # nothing between them but their white space
        assert len(rest) == 1
        forms.append(head[:-3] + r"\s{2,}+" + rest[0][3:])
    return "(?m)" + (forms[0] if len(forms) == 1 else f"(?:{'|'.join(forms)})")


def _piece(piece: str) -> tuple[str, list[str]]:
    """The piece on one line, and its forms by which of its runs of white space is the first to leave the line."""
    group = re.fullmatch(r"\(([^()]*)\)([^()]*)", piece)
    choices = [f"(?:{c}){group[2]}" for c in group[1].split("|")] if group else [piece]
    over_lines = []
    for choice in choices:
        runs = list(re.finditer(r"\\s[+*]", choice))
        for run in runs:
            before, behind = choice[: run.start()], choice[run.end():]
            over_lines.append(_stay(before) + OVER_LINES + re.sub(r"(\\s[+*])", r"\1+", behind))
    return _stay(piece), over_lines


def _stay(piece: str) -> str:
    return re.sub(r"\\s([+*])", lambda run: f"{ON_LINE}{run[1]}+", piece)


def _rest(pieces: list[str]) -> str:
    """What follows the head: the first of each piece on the line, or the one that leaves it, then the last piece."""
    piece, *more = pieces
    if not more:
        if piece.startswith(r"\s+"):  # one sign of the run is enough, the gap takes the others
            return rf".*(?:{ON_LINE}|\n\s*+){piece[3:]}"
        return f".*{piece}"
    on_line, over_lines = _piece(piece)
    tail = _rest(more)
    forms = [f"(?>.*?{form}){tail}" for form in (on_line, *over_lines)]
    return forms[0] if len(forms) == 1 else f"(?:{'|'.join(forms)})"


def _marked(pattern: str) -> str:
    """``HEAD[^x]*REST``: the stretches between two marks `x` are read from their beginning, where their first head counts."""
    head, mark, rest = re.fullmatch(r"(.*?)\[\^(.)\]\*(.*)", pattern).groups()
    if rest.removeprefix("\\") == mark:  # any mark behind the first head of the text
        return rf"\A(?>(?s).*?(?-s){head})[^{mark}]*+{rest}"
    first = rf"(?:\A|{mark})(?>[^{mark}]*?{head})"
    if not rest.startswith(mark):
        return rf"{first}[^{mark}]*?{rest}"
    # the mark, then more on its line: head and mark on one line, or the mark is the first of its line
    behind = rest.removeprefix(mark).replace("(.*?)", ".*")
    return rf"(?m)(?:^(?>.*?{head})[^{mark}\n]*+{mark}{behind}|{first}[^{mark}\n]*+\n[^{mark}]*+{mark}{behind})"


def fold_lower(lowered: Column) -> Column:
    """Lower-cased text folded for case-insensitive matching."""
    return F.replace(F.replace(lowered, F.lit("ſ"), F.lit("s")), F.lit("ı"), F.lit("i"))


def fold(text: Column, folded_lower: Column) -> Column:
    """Original text folded for case-insensitive matching; differs only where a dotted capital I occurs."""
    dotted = F.lit("İ")
    return F.when(
        F.contains(text, dotted), fold_lower(F.lower(F.replace(text, dotted, F.lit("i"))))
    ).otherwise(folded_lower)
