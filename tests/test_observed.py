"""The observed parser against plain recursive descent, and its quirks one by one."""

import random

import pytest

from sceneloom.operators import scanner, statements
from sceneloom.sources import scenes

from .test_scanner import scenes_of


class Stop(Exception):
    pass


def plain(tokens):
    """Rows (kind, token, kept, lost) in the order in which statements begin, and the text of the error, by functions that call each other. tokens: (idx, type, line, position, indent)."""
    at, rows = 0, []

    def peek():
        return tokens[at]

    def prev():
        return tokens[at - 1]

    def check(kind, line=True, indent=True):
        if peek()[1] == "SceneEnd":
            return False
        if line and peek()[2] != prev()[2]:
            return False
        if indent and peek()[4] != prev()[4]:
            return False
        return peek()[1] == kind

    def match(*kinds, line=True, indent=True):
        nonlocal at
        if any(check(k, line, indent) for k in kinds):
            at += 1
            return True
        return False

    def anywhere(*kinds):
        return match(*kinds, line=False, indent=False)

    def fail(message, token):
        raise Stop(f"Error: {message} " + ("at end of scene " if token[1] == "SceneEnd" else f"at '{token[1]}' ") + f"{token[2]}:{token[3]}")

    def consume(kind, message):
        if not match(kind):
            fail(message, peek())

    def line_change():
        if peek()[2] == prev()[2]:
            fail(f"Expected end of statement, found {peek()[1]} instead at {peek()[2]}:{peek()[3]}", peek())

    def statement():
        if anywhere("SceneStart"):
            return statement()
        for kind, rule in (("CreateVariable", declare), ("CreateTempVariable", declare), ("SetVariable", assign), ("Prose", lambda: block("Prose")), ("Choice", choice), ("ChoiceOption", lambda: option(True)), ("If", condition), ("GoSub", lambda: jump("GoSub", "Expect subroutine name.")),
                           ("GoSubScene", lambda: jump("GoSubScene", "Expect scene name.", "Expect subroutine label name.")), ("Return", lambda: jump("Return")), ("GotoLabel", lambda: jump("GotoLabel", "Expect label name.")), ("GotoScene", lambda: jump("GotoScene", "Expect scene name.", "Expect label name.")),
                           ("Label", lambda: jump("Label", "Expect label name.", ends=False)), ("PageBreak", page_break), ("InputText", lambda: jump("InputText", "Expect variable name to store input text.")), ("Comment", lambda: block("Comment"))):
            if anywhere(kind):
                return rule()
        raise Stop(f"Unknown statement block starting {peek()[1]} at {peek()[2]}:{peek()[3]}")

    def begin(kind):
        rows.append([kind, prev()[0], [], []])
        return rows[-1]

    def block(kind):
        nonlocal at
        own = begin(kind)
        own[3].append(prev()[0])
        while match(kind, line=False):
            first = prev()[0]
            if peek()[1] != "SceneEnd":
                at += 1
                own[3].append(first)
            own[2].append(prev()[0])

    def jump(kind, first=None, second=None, ends=True):
        begin(kind)
        if first:
            consume("Identifier", first)
        if second and peek()[2] == prev()[2]:
            consume("Identifier", second)
        if ends:
            line_change()

    def page_break():
        begin("PageBreak")
        if peek()[2] == prev()[2]:
            consume("Prose", "Expect button text after page break.")
        line_change()

    def declare():
        begin("DeclareVariable")
        consume("Identifier", "Expect variable name")
        if peek()[2] == prev()[2]:
            expression()
        line_change()

    def assign():
        begin("SetVariable")
        consume("Identifier", "Expect variable name")
        expression()
        line_change()

    def body(indent):
        while peek()[4] > indent:
            statement()

    def choice():
        begin("Choice")
        indent = prev()[4]
        while peek()[4] > indent:
            was = at
            if anywhere("Comment"):
                block("Comment")
            elif anywhere("If"):
                condition()
            elif anywhere("Prose"):
                fail("Prose is not allowed directly inside Choice statements. Did you mean to put it inside a ChoiceOption?", prev())
            else:
                option(False)
            if at == was:
                fail("No rule goes on", peek())

    def option(by_statement):
        own, entry = begin("ChoiceOption"), prev()[0]
        while peek()[1] in ("DisableReuse", "HideReuse", "AllowReuse", "SelectableIf"):
            if anywhere("SelectableIf"):
                expression()
            else:
                anywhere("DisableReuse", "HideReuse", "AllowReuse")
        if anywhere("ChoiceOption") and by_statement:
            own[3].append(entry)
        own[1] = prev()[0]
        body(prev()[4])

    def condition():
        own, indent = begin("If"), prev()[4]
        expression()
        while peek()[4] > indent or peek()[2] == prev()[2]:
            statement()
        while anywhere("ElseIf"):
            if peek()[4] < indent:
                own[3].append(prev()[0])
                break
            begin("ElseIf")
            inner = prev()[4]
            expression()
            body(inner)
        if anywhere("Else"):
            if peek()[4] < indent:
                own[3].append(prev()[0])
            else:
                begin("Else")
                body(prev()[4])

    def expression():
        comparison()
        while match("LogicalAnd", "LogicalOr"):
            comparison()

    def comparison():
        term()
        while match("GreaterThanOperator", "GreaterThanEqualsOperator", "LessThanOperator", "LessThanEqualsOperator", "EqualityOperator", "NotEqualityOperator"):
            term()

    def term():
        factor()
        while match("SubtractionOperator", "AdditionOperator", "ConcatenationOperator"):
            term()

    def factor():
        unary()
        while match("DivisionOperator", "MultiplicationOperator", "ModulusOperator"):
            unary()

    def unary():
        if match("NotOperator", "SubtractionOperator", "AdditionOperator", "FairmathAdditionOperator", "FairmathSubtractionOperator"):
            return unary()
        if match("NumberLiteral", "StringLiteral", "BooleanLiteral", "Identifier"):
            return None
        if match("OpenParenthesis"):
            expression()
            return consume("CloseParenthesis", "Expect ')' after expression.")
        return fail("Expect expression.", peek())

    try:
        while peek()[1] != "SceneEnd":
            statement()
    except Stop as e:
        return rows, str(e)
    return rows, None


LINES = ["*choice", "#A", "*set x 1", "*set x (a + 1) * 2", "*if (a)", "*if a #B", "*elseif b", "*else ", "Prose", "*comment c", "*comment d", "*hide_reuse #C", "*hide_reuse *if (a) #D", "*disable_reuse *selectable_if (b) #E", "*label l", "*goto l", "*goto_scene s", "*page_break Go", "*temp t", "*return ", "*gosub f", "*input_text n"]


def test_observed_parser_against_recursive_descent(spark):
    draw = random.Random(3)
    texts = []
    for k in range(400):
        indent, lines = 0, []
        for _ in range(draw.randint(1, 14)):
            indent = max(0, indent + draw.choice([-1, 0, 0, 1])) if k % 4 else draw.choice([0, 1, 2])
            lines.append("  " * indent + draw.choice(LINES if k % 3 else [*LINES, "*finish", "*set", "*goto a b", "*set x )"]))
        texts.append("\n".join(lines))
    texts += ["*choice\n    #A\n  *set x 1", "*choice\n  #A\n    *choice\n        #B\n      *else \n  #C", "*choice\n    #A\n      ok\n  *page_break\n#B"]
    tokens = scanner.scan(spark.createDataFrame([(f"s{k:03d}", "", t) for k, t in enumerate(texts)], scenes.SCENE))
    by: dict = {}
    for r in tokens.orderBy("scene_name", "token_idx").collect():
        by.setdefault(r.scene_name, []).append((r.token_idx, r.type, r.line_number, r.position, r.indent))
    found: dict = {}
    for r in statements.parsed(tokens, "observed").orderBy("scene_name", "place").collect():
        found.setdefault(r.scene_name, []).append(r)
    ended = {"fine": 0, "stuck": 0, "failed": 0}
    for name, own in by.items():
        rows, error = plain(own)
        got = found.get(name, [])
        failed = [r.error for r in got if r.kind == "Error"]
        assert [[r.kind, r.token_idx, r.kept, r.lost] for r in got if r.kind != "Error"] == rows, texts[int(name[1:])]
        assert bool(failed) == bool(error)
        if error:
            assert failed[0].replace(f"{name}:", "").rpartition("[")[0] == error
        ended["stuck" if error and "No rule" in error else "failed" if error else "fine"] += 1
    assert min(ended.values()) >= 3, ended


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("*comment a\n*comment b\n*set x 1", [("Comment", [3], [1, 2])]),  # then `x` begins no statement
        ("*comment a\n*comment b\n*comment c\n*label l", [("Comment", [3], [1, 2]), ("Label", [], [])]),
        ("*if a\n  *if b\n    *label x\n*else \n  *label y", [("If", [], []), ("If", [], []), ("Label", [], []), ("Else", [], []), ("Label", [], [])]),
        ("#A\n#B\n*label x", [("ChoiceOption", [], [1]), ("Label", [], [])]),
        ("*choice\n  *set x 1", [("Choice", [], []), ("ChoiceOption", [], []), ("SetVariable", [], [])]),
        ("*choice\n  *hide_reuse *if (a) #x", [("Choice", [], []), ("ChoiceOption", [], []), ("If", [], []), ("ChoiceOption", [], [])]),
        ("", []),
    ],
)
def test_quirks(spark, text, expected):
    rows = statements.parsed(scanner.scan(scenes_of(spark, text)), "observed").orderBy("place").collect()
    shown = [(r.kind, r.kept, r.lost) for r in rows if r.kind != "Error"]
    assert shown[: len(expected)] == expected
    if not text:
        assert rows[0].error == "Unknown statement block starting SceneEnd at s00:1:0[0]"


def test_deep_scenes_and_unknown_semantics(spark):
    deep = "\n".join("\t" * k + "*if (a)" for k in range(3000))
    rows = statements.parsed(scanner.scan(scenes_of(spark, deep)), "observed").collect()
    assert len(rows) == 3000 and all(r.complete for r in rows)
    assert statements.parsed(scanner.scan(scenes_of(spark).limit(0)), "observed").count() == 0
    with pytest.raises(ValueError, match="no such semantics"):
        statements.parsed(scanner.scan(scenes_of(spark, "a")), "guessed")
