"""Inline markup to text, as an expression.

A text is cut into tokens. A first fold over them pairs `[` and `![` with the ends of links. A second one
keeps the pieces of the output and the places of what is open: emphasis marks and labels. A closing mark
blanks itself and its opener, within the same label; an opener that nothing closes stays as it is written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.text import plain_text

# The characters that a backslash escapes.
_ESCAPED = r"[!-/:-@\[-`{-~]"
_TOKENS = "|".join(
    [
        rf"\\{_ESCAPED}",
        r"(?<!`)(`+)(?!`)(?s:.*?[^`])\1(?!`)",  # code, its closing run as long as the opening one
        r"`+",
        r"!\[",
        r"\[",
        r"\]\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)",  # end of a link and its target
        r"\]",
        r"[*_]",
        r"[^\\`!\[\]*_]+",
        r"(?s:.)",
    ]
)

_OPEN = "array<struct<at:int,mark:string>>"


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once; an expression used twice would be computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _set(pieces: Column, blank) -> Column:
    """The pieces, empty where `blank` holds for their index."""
    return F.transform(pieces, lambda x, i: F.when(blank(i), F.lit("")).otherwise(x))


def _code(token: Column) -> Column:
    """The text of a code span: line ends are spaces, and one space at both ends goes."""
    inside = F.regexp_replace(F.regexp_replace(token, "^`+|`+$", ""), r"\n", " ")
    return F.regexp_replace(inside, r"^ (.*[^ ].*) $", "$1")


def _step(state: Column, token: Column) -> Column:
    text, before, after = token["text"], token["before"], token["after"]
    pieces, opened = state["pieces"], state["opened"]

    def result(pieces: Column, opened: Column) -> Column:
        return F.struct(pieces.alias("pieces"), opened.alias("opened"))

    def last(wanted) -> Column:
        """Number of the last opener (from 1) that `wanted` holds for, null if none."""
        return F.array_max(F.filter(F.transform(opened, lambda o, i: F.when(wanted(o), i + 1)), lambda k: k.isNotNull()))

    def with_piece(piece: Column, opened: Column) -> Column:
        return result(F.concat(pieces, F.array(piece)), opened)

    def opener() -> Column:
        one = F.array(F.struct(F.size(pieces).alias("at"), text.alias("mark")))
        return with_piece(text, F.concat(opened, one))

    plain = with_piece(text, opened)

    # Emphasis: a mark opens before a character and closes behind one; underscores not within a word.
    space = lambda c: c.isNull() | c.rlike(r"^\s$")
    word = lambda c: c.isNotNull() & c.rlike(r"^[\p{L}\p{N}]$")
    sign = lambda c: c.isNotNull() & c.rlike(r"^[\p{P}\p{S}]$")
    left = ~space(after) & (~sign(after) | space(before) | sign(before))
    right = ~space(before) & (~sign(before) | space(after) | sign(after))
    star = text == "*"
    opens = left & (star | ~word(before))
    closes = right & (star | ~word(after))
    def emphasis() -> Column:
        inner = F.coalesce(last(lambda o: o["mark"].isin("[", "![")), F.lit(0))
        earlier = F.size(pieces) - token["run"]  # marks of one run do not close each other
        same = last(lambda o: (o["mark"] == text) & (o["at"] < earlier))

        def close(k: Column) -> Column:
            at = F.element_at(opened, k)["at"]
            return result(F.concat(_set(pieces, lambda i: i == at), F.array(F.lit(""))), F.slice(opened, 1, k - 1))

        def decide(k: Column) -> Column:
            return F.when(closes & k.isNotNull(), close(k)).when(opens, opener()).otherwise(plain)

        return _let(F.when(same > inner, same), decide)

    def linked(k: Column) -> Column:
        """The label stays, an image leaves nothing."""
        found = F.element_at(opened, k)
        blank = lambda i: F.when(found["mark"] == "[", i == found["at"]).otherwise(i >= found["at"])
        return result(F.concat(_set(pieces, blank), F.array(F.lit(""))), F.slice(opened, 1, k - 1))

    return (
        F.when(text.rlike(rf"^\\{_ESCAPED}$"), with_piece(F.substring(text, 2, 1), opened))
        .when(text.rlike("(?s)^`.*[^`].*`$"), with_piece(_code(text), opened))
        .when(text.isin("*", "_"), emphasis())
        .when(token["link"] & text.isin("[", "!["), opener())
        .when(token["link"], _let(last(lambda o: o["mark"].isin("[", "![")), linked))
        .otherwise(plain)
    )


def _links(tokens: Column) -> Column:
    """Indexes of the tokens that begin and end links. A link holds no other link, but images; a bracket
    without a target ends none and takes its opener along."""

    def step(state: Column, token: Column) -> Column:
        text, opened, found = token["text"], state["opened"], state["found"]
        top = F.try_element_at(opened, F.lit(-1))
        below = F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0)))
        outside = F.when(top["mark"] == "[", F.filter(below, lambda o: o["mark"] != "[")).otherwise(below)
        me = F.array(F.struct(token["i"].alias("at"), text.alias("mark")))
        paired = F.concat(found, F.array(top["at"], token["i"]))
        ends = text.startswith("](") & top.isNotNull()
        opened = F.when(text.isin("[", "!["), F.concat(opened, me)).when(ends, outside).when(text == "]", below).otherwise(opened)
        return F.struct(opened.alias("opened"), F.when(ends, paired).otherwise(found).alias("found"))

    start = F.struct(F.array().cast(_OPEN).alias("opened"), F.array().cast("array<int>").alias("found"))
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("text"), i.alias("i")))
    return F.aggregate(numbered, start, step, lambda s: s["found"])


def markup_text(text: Column) -> Column:
    """`text` without markup: emphasis marks, code ticks, escapes, links (their labels stay, nested
    images too) and images (nothing stays).

    For cells of a table: the fold's work grows with the square of a text's number of tokens, so it is left
    out where there is nothing but links.
    """
    # A run of one mark has the characters before and behind the run around each of its marks.
    kind = "array<struct<text:string,side:string,run:int>>"

    def beside(tokens: Column, at: int) -> Column:
        """For each token the character that stands before it (at = -1) or, backwards, behind it."""

        def step(state: Column, text: Column) -> Column:
            last = F.try_element_at(state, F.lit(-1))
            run = text.isin("*", "_") & (F.coalesce(last["text"], F.lit("")) == text)
            side = F.when(run, last["side"]).otherwise(F.substring(last["text"], at, 1))
            place = F.when(run, last["run"] + 1).otherwise(0)
            return F.concat(state, F.array(F.struct(text.alias("text"), side.alias("side"), place.alias("run"))))

        return F.aggregate(tokens, F.array().cast(kind), step)

    def placed(seen: Column) -> Column:
        """The tokens with what stands around them, and whether they are part of a link."""
        return F.transform(
            F.arrays_zip(seen["before"].alias("b"), seen["after"].alias("a")),
            lambda t, i: F.struct(
                t["b"]["text"].alias("text"),
                t["b"]["side"].alias("before"),
                t["b"]["run"].alias("run"),
                t["a"]["side"].alias("after"),
                F.array_contains(seen["links"], i).alias("link"),
            ),
        )

    def folded(tokens: Column) -> Column:
        seen = F.struct(
            beside(tokens, -1).alias("before"),
            F.reverse(beside(F.reverse(tokens), 1)).alias("after"),
            _links(tokens).alias("links"),
        )
        start = F.struct(F.array().cast("array<string>").alias("pieces"), F.array().cast(_OPEN).alias("opened"))
        return F.aggregate(_let(seen, placed), start, _step, lambda s: F.array_join(s["pieces"], ""))

    whole = _let(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), folded)
    links_only = plain_text(text)  # most cells
    simple = ~text.rlike(r"[\\`!]") & ~links_only.rlike(r"[*_\[]")
    return F.when(~text.rlike(r"[\\`*_\[]"), text).when(simple, links_only).otherwise(whole)
