"""What the modules of SQL share: fixed values written out once more, and pieces of SQL."""

from __future__ import annotations

#: Fixed values.
QUESTIONS = (
    ("explain", "What does `{name}` do and why is it designed this way?"),
    ("domain", "What is the domain-specific intuition behind the logic in `{name}`?"),
    ("connect", "How does `{name}` fit into the broader `{repo}` system?"),
    ("implement", "Walk through the key implementation decisions in `{name}` and what alternatives were considered."),
    ("debug", "What are the edge cases or failure modes in `{name}` and how are they handled?"),
    ("compare", "What are the tradeoffs in the approach taken by `{name}` compared to simpler alternatives?"),
)
BOILERPLATE = ("this code appears to be", "handles financial data processing", "financial data processing", "code analysis", "system component")
#: Pieces of SQL: a line end, and a text without white space at its ends.
NL = "chr(10)"
STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def quoted(said: str) -> str:
    return "'" + said.replace("'", "''") + "'"
