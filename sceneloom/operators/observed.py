"""What the language's first parser makes of a scene, with its quirks: a cursor over the scene's tokens.

The rules differ from those of `statements` in what they lose. A comment or a text that begins a statement is lost, and of those that follow every second; what
comes after an even number is swallowed in their place. An ElseIf or Else goes to the innermost If that has just ended, whatever its indent, and is dropped if what follows stands
further out. An option outside a choice gives way to one that follows it at once. A modifier before an If becomes an option of its own. In a choice, what is no option is taken for one
without being consumed; where the first parser would go round forever, this one stops: a rule that has begun again without moving is an error.
A scene without a statement is an error, as any error is the end of its scene.

Rules are generators that yield the rules they need, and one loop runs them; so the nesting of a scene is limited by memory alone. A scene's tokens, without
their texts, are held while it is parsed.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .expressions import LEVELS, NO_OPERAND, NOT_CLOSED, OPERANDS, PREFIX, RIGHT
from .statements import MISSING, MODIFIERS, NO_BUTTON, NOT_ENDED, PROSE_IN_CHOICE, SECOND, UNKNOWN

STUCK = "No rule goes on"
#: The kinds of statements whose token has another name.
KINDS = {"CreateVariable": "DeclareVariable", "CreateTempVariable": "DeclareVariable"}
ROW = "scene_name string, place int, parent int, kind string, token_idx int, last_token int, kept array<int>, lost array<int>, complete boolean, error string"


class Token(NamedTuple):
    idx: int
    type: str
    line: int
    position: int
    indent: float


class ParseError(Exception):
    pass


@dataclass
class Statement:
    place: int
    parent: int | None
    kind: str
    token: int
    last: int = -1
    kept: list[int] = field(default_factory=list)
    lost: list[int] = field(default_factory=list)
    complete: bool = False


Rule = Generator["Rule", None, None]


class Cursor:
    """A place among the tokens of one scene, and the statements begun so far."""

    def __init__(self, scene: str, tokens: list[Token]):
        self.scene, self.tokens, self.at = scene, tokens, 0
        self.begun: list[Statement] = []
        self.open: list[Statement] = []

    # ---- looking and moving

    def next(self) -> Token:
        return self.tokens[min(self.at, len(self.tokens) - 1)]

    def last(self) -> Token:
        return self.tokens[self.at - 1] if self.at else Token(-1, "", 0, 0, 0.0)

    def ended(self) -> bool:
        return self.next().type == "SceneEnd"

    def same_line(self) -> bool:
        return self.next().line == self.last().line

    def deeper(self, indent: float) -> bool:
        return self.next().indent > indent

    def take(self, types: tuple[str, ...], line: bool = True, indent: bool = True) -> bool:
        """Moves over the next token if it is of these types, and on the line and of the indent of the last one, where that is asked."""
        found = self.next()
        if self.ended() or found.type not in types or line and not self.same_line() or indent and found.indent != self.last().indent:
            return False
        self.at += 1
        return True

    def where(self, token: Token) -> str:
        return f"{self.scene}:{token.line}:{token.position}[{token.indent:g}]"

    def fail(self, message: str, token: Token) -> None:
        place = "at end of scene" if token.type == "SceneEnd" else f"at '{token.type}'"
        raise ParseError(f"Error: {message} {place} {self.where(token)}")

    def need(self, kind: str, message: str) -> None:
        if not self.take((kind,)):
            self.fail(message, self.next())

    def end_line(self) -> None:
        if self.same_line():
            found = self.next()
            self.fail(f"{NOT_ENDED}{found.type} instead at {found.line}:{found.position}", found)

    # ---- statements

    def begin(self, kind: str) -> Statement:
        own = Statement(len(self.begun), self.open[-1].place if self.open else None, kind, self.last().idx)
        self.begun.append(own)
        self.open.append(own)
        return own

    def end(self) -> None:
        own = self.open.pop()
        own.last, own.complete = self.last().idx, True

    def statement(self) -> Rule:
        self.take(("SceneStart",), False, False)
        kind = self.next().type
        rule = RULES.get(kind)
        if self.ended() or rule is None:
            raise ParseError(f"{UNKNOWN}{kind} at {self.where(self.next())}")
        self.at += 1
        yield rule(self, kind)

    def body(self, indent: float) -> Rule:
        while self.deeper(indent):
            yield self.statement()

    def block(self, kind: str) -> Rule:
        own = self.begin(kind)
        own.lost.append(self.last().idx)
        while self.take((kind,), False, True):
            matched = self.last().idx
            if not self.ended():
                self.at += 1
                own.lost.append(matched)
            own.kept.append(self.last().idx)
        self.end()
        return
        yield

    def plain(self, kind: str) -> Rule:
        """A statement of one line: a name, perhaps a second one, perhaps an expression, and the line's end."""
        self.begin(KINDS.get(kind, kind))
        if kind in MISSING:
            self.need("Identifier", MISSING[kind])
        if kind in SECOND and self.same_line():
            self.need("Identifier", SECOND[kind])
        if kind == "PageBreak" and self.same_line():
            self.need("Prose", NO_BUTTON)
        if kind == "SetVariable" or kind in KINDS and self.same_line():
            yield self.expression()
        if kind != "Label":
            self.end_line()
        self.end()

    def choice(self, kind: str) -> Rule:
        self.begin(kind)
        indent = self.last().indent
        while self.deeper(indent):
            before = self.at
            if self.take(("Comment",), False, False):
                yield self.block("Comment")
            elif self.take(("If",), False, False):
                yield self.condition("If")
            elif self.take(("Prose",), False, False):
                self.fail(PROSE_IN_CHOICE, self.last())
            else:
                yield self.option("")
            if self.at == before:
                self.fail(STUCK, self.next())
        self.end()

    def option(self, kind: str) -> Rule:
        """kind is that of the token moved over, if any: in a choice the option's own comes yet."""
        entry, own = self.last().idx, self.begin("ChoiceOption")
        while self.next().type in MODIFIERS and self.take(MODIFIERS, False, False):
            if self.last().type == "SelectableIf":
                yield self.expression()
        if self.take(("ChoiceOption",), False, False) and kind:
            own.lost.append(entry)
        own.token = self.last().idx
        yield self.body(self.last().indent)
        self.end()

    def condition(self, kind: str) -> Rule:
        own, indent = self.begin(kind), self.last().indent
        yield self.expression()
        while self.deeper(indent) or kind == "If" and self.same_line():
            yield self.statement()
        if kind == "If":
            for branch, rule in (("ElseIf", self.condition), ("Else", self.otherwise)):
                while self.take((branch,), False, False):
                    if self.next().indent < indent:
                        own.lost.append(self.last().idx)
                        break
                    yield rule(branch)
                    if branch == "Else":
                        break
        self.end()

    def otherwise(self, kind: str) -> Rule:
        self.begin(kind)
        yield self.body(self.last().indent)
        self.end()

    # ---- expressions, of which nothing is kept

    def expression(self, level: int = 0) -> Rule:
        if level == len(LEVELS):
            yield self.operand()
            return
        yield self.expression(level + 1)
        while self.take(LEVELS[level]):
            yield self.expression(level if level == RIGHT else level + 1)

    def operand(self) -> Rule:
        while self.take(PREFIX):
            pass
        if self.take(("OpenParenthesis",)):
            yield self.expression()
            self.need("CloseParenthesis", NOT_CLOSED)
        elif not self.take(OPERANDS):
            self.fail(NO_OPERAND, self.next())

    # ---- all of it

    def scene_statements(self) -> Rule:
        while not self.ended():
            yield self.statement()

    def run(self) -> str | None:
        """Parses the scene; the error that ends it, or None."""
        rules: list[Rule] = [self.scene_statements()]
        try:
            while rules:
                try:
                    rules.append(next(rules[-1]))
                except StopIteration:
                    rules.pop()
        except ParseError as e:
            return str(e)
        return None


RULES = {k: Cursor.plain for k in (*MISSING, "Return", "PageBreak")} | {"Prose": Cursor.block, "Comment": Cursor.block, "Choice": Cursor.choice, "ChoiceOption": Cursor.option, "If": Cursor.condition}


def statements_observed(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, place, parent, kind, token_idx, last_token, kept, lost, complete, error) by the rules of the first parser.

    A row for each statement, in the order in which they begin: place numbers them, parent is the place of the one around it, token_idx its token and last_token the last one it has moved over, kept the tokens that a
    comment or text has collected, and lost those that it, or a branch, has dropped. A scene that fails has one more row, of the kind Error with the whole text, and its open statements are
    not complete. tokens are of the scanner's columns, with each scene's start and end.
    """
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in ROW.split(", ")]

    def told(scene: str, own: list[Token]) -> pa.RecordBatch:
        cursor = Cursor(scene, own)
        error = cursor.run()
        rows = [(scene, s.place, s.parent, s.kind, s.token, s.last if s.complete else None, s.kept, s.lost, s.complete, None) for s in cursor.begun]
        if error:
            rows.append((scene, len(rows), None, "Error", cursor.next().idx, None, [], [], False, error))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, own = None, []
        for batch in batches:
            for name, *token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and name != scene:
                    yield told(scene, own)
                    own = []
                scene = name
                own.append(Token(*token))
        if own:
            yield told(scene, own)

    rows = tokens.select("scene_name", "token_idx", "type", "line_number", "position", "indent").repartition("scene_name").sortWithinPartitions("scene_name", "token_idx")
    return rows.mapInArrow(of, ROW)
