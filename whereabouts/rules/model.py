"""Shape of a rule and of a language's lexical settings."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """One way in which a row of a file can define names.

    ``regex`` runs on the masked row and ``group`` gives the names, spread by ``expand``.
    ``policy`` gives the rows that belong to the definition:

    ======= ==========================================================
    LINE    the row alone
    LOGICAL the row, up to where the brackets opened on it are closed
    BLOCK   the construct with its body
    CLOSES  the construct that the row closes
    INSIDE  the innermost construct around the row
    SECTION the section around the row
    ======= ==========================================================

    ``gate`` must match the masked row, ``parent`` the opener around it (its bracket, then its
    masked row). ``start`` asks for the first row of a statement. ``bare`` runs the rule on the
    row without nested brackets and default-value calls. ``needs`` lists words, by blanks, one of
    which must occur in the row: a byte search that spares most rows the pattern.
    """

    languages: tuple[str, ...]
    rule_id: str
    kind: str
    regex: str
    policy: str = "LINE"
    group: int = 1
    gate: str = ""
    parent: str = ""
    expand: str = ""
    start: bool = False
    bare: bool = False
    transform: str = ""
    needs: str = ""


class Context(NamedTuple):
    """A construct whose header is shown around a hit; ``show`` is ROW, HEADER or WHOLE."""

    languages: tuple[str, ...]
    regex: str
    show: str


class Lexis(NamedTuple):
    """How rows of a language group into literals, statements and blocks."""

    token: str
    comment: str
    blocks: str  # indent | bracket | heading
    openers: str = r"[(\[{]"
    closers: str = r"[)\]}]"
    continues: str = ""  # row goes on when its masked text matches
    continued: str = ""  # ... or when the next code row starts with this
    attach: str = ""  # rows that belong to what follows, beside comments
    head: str = ""  # indent mode: rows that open a block
    level: tuple[str, ...] = ()  # heading mode: one pattern per level
    attaches: bool = False  # comments above belong to what follows
    shows_first: bool = False  # the first row of a hidden span stays visible


class RuleSet(NamedTuple):
    """All that an extraction goes by. ``groups`` names the language whose rules serve one that has none."""

    rules: list[Rule]
    contexts: list[Context]
    lexis: dict[tuple[str, ...], Lexis]
    references: list[Rule]
    groups: dict[str, str]
