"""Golden scanner and expression cases, the switch of semantics, sources and sinks."""

import gzip
import http.server
import json
import pathlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from sceneloom.operators import scanner, statements, token_types
from sceneloom.sources import scenes, token_json
from sceneloom.sources.kept import shared_folder
from sceneloom.streaming.scenes import stream_scenes, stream_segments

GOLDEN = [
    ("Hello\n*label start\nBye", ["Prose[Hello\n]@0:0", "Label@1:0", "Identifier[start]@1:7", "SceneEnd@3:0"]),
    ("*hide_reuse *if (ok) #Go @{b x|y}", ["HideReuse@0:0", "If@0:12", "OpenParenthesis@0:16", "Identifier[ok]@0:17", "CloseParenthesis@0:19", "ChoiceOption[Go @{b x|y}]@0:21", "SceneEnd@1:0"]),
    ("*set x 3*4", ["SetVariable@0:0", "Identifier[x]@0:5", "NumberLiteral[3.0]@0:7", "SceneEnd@1:0"]),
    ("*else if (a)", ["Else@0:0", "Identifier[if]@0:6", "OpenParenthesis@0:9", "Identifier[a]@0:10", "CloseParenthesis@0:11", "SceneEnd@1:0"]),
    ("*else", ["SceneEnd@1:0"]),
    ("*ifid 12", ["If@0:0", "Identifier[id]@0:3", "NumberLiteral[12.0]@0:6", "SceneEnd@1:0"]),
    ("*comment note", ["Comment[note]@0:0", "SceneEnd@1:0"]),
    ("\tHello\n#A", ["Prose[H\tHello\n]@0:1", "ChoiceOption[A]@1:0", "SceneEnd@2:0"]),
    ("  Hi\n#A", ["Prose[  Hi\n]@0:2", "ChoiceOption[A]@1:0", "SceneEnd@2:0"]),
    ("*page_break Next", ["PageBreak@0:0", "Prose[ Next]@0:11", "SceneEnd@1:0"]),
    ("5 * 3\n", ["Prose[5 ]@0:0", "SceneEnd@2:0"]),
    ("*set v %- 5", ["SetVariable@0:0", "Identifier[v]@0:5", "FairmathAdditionOperator[%-]@0:7", "NumberLiteral[5.0]@0:10", "SceneEnd@1:0"]),
    ("*set n 1.2.3", ["SetVariable@0:0", "Identifier[n]@0:5", "NumberLiteral[1.2]@0:7", "SceneEnd@1:0"]),
    ('*set s "a\\"b"', ["SetVariable@0:0", "Identifier[s]@0:5", 'StringLiteral[a"b]@0:7', "SceneEnd@1:0"]),
    ("", ["SceneEnd@1:0"]),
]


def scenes_of(spark, *contents):
    return spark.createDataFrame([(f"s{k:02d}", "", c) for k, c in enumerate(contents)], "scene_name string, source_url string, content string")


def shown(r):
    value = next((r[c] for c in ("content", "value_str", "value_num", "raw_value", "raw_text") if r[c] is not None), None)
    return r.type + (f"[{value}]" if value is not None else "") + f"@{r.line_number}:{r.position}"


def test_golden_scenes(spark):
    rows = scanner.scan(scenes_of(spark, *[c for c, _ in GOLDEN])).orderBy("scene_name", "token_idx").collect()
    for k, (_, expected) in enumerate(GOLDEN):
        own = [r for r in rows if r.scene_name == f"s{k:02d}"]
        assert [r.token_idx for r in own] == list(range(len(own)))
        assert own[0].type == "SceneStart" and [shown(r) for r in own[1:]] == expected


# Each keyword with its token type and what follows it, and each lexeme with its type, as the language's description has them.
KEYWORD_CASES = [
    ("*label a", "Label", "Identifier"), ("*hide_reuse #a", "HideReuse", "ChoiceOption"), ("*disable_reuse #a", "DisableReuse", "ChoiceOption"), ("*allow_reuse #a", "AllowReuse", "ChoiceOption"),
    ("*gosub a", "GoSub", "Identifier"), ("*gosub_scene a", "GoSubScene", "Identifier"), ("*return ", "Return", None), ("*goto a", "GotoLabel", "Identifier"), ("*goto_scene a", "GotoScene", "Identifier"),
    ("*goto_random_scene a", "GotoRandomScene", "Identifier"), ("#a", "ChoiceOption", None), ("*if a", "If", "Identifier"), ("*elseif a", "ElseIf", "Identifier"), ("*elsif a", "ElseIf", "Identifier"), ("*else a", "Else", "Identifier"),
    ("*create a", "CreateVariable", "Identifier"), ("*temp a", "CreateTempVariable", "Identifier"), ("*set a", "SetVariable", "Identifier"), ("*choice #a", "Choice", "ChoiceOption"), ("*fake_choice #a", "FakeChoice", "ChoiceOption"),
    ("*finish a", "Finish", "Prose"), ("*ending a", "Ending", "Prose"), ("*stat_chart #a", "StatChart", "ChoiceOption"), ("*line_break #a", "LineBreak", "ChoiceOption"), ("*selectable_if a", "SelectableIf", "Identifier"),
    ("*link a", "Link", "Identifier"), ("*comment a", "Comment", None), ("*image a", "Image", "Identifier"), ("*input_number a", "InputNumber", "Identifier"), ("*input_text a", "InputText", "Identifier"),
    ("*author a", "Author", "Identifier"), ("*page_break a", "PageBreak", "Prose"), ("*save_checkpoint #a", "SaveCheckpoint", "ChoiceOption"), ("*restore_checkpoint #a", "RestoreCheckpoint", "ChoiceOption"),
    ("*delete a", "DeleteVariable", "Identifier"), ("*rand a", "GenerateRandom", "Identifier"), ("*random", "GenerateRandom", "Identifier"), ("*settings", "SetVariable", "Identifier"),
    ("*scene_list a", None, None), ("*achievement a", None, None), ("*return", None, None), ("*else", None, None), ("*nothing", None, None),
]
LEXEME_CASES = [
    ("7", "NumberLiteral"), ("'s'", "StringLiteral"), ('"s"', "StringLiteral"), ("(", "OpenParenthesis"), (")", "CloseParenthesis"), ("%+", "FairmathAdditionOperator"), ("%-", "FairmathAdditionOperator"), (">=", "GreaterThanEqualsOperator"),
    ("<=", "LessThanEqualsOperator"), ("!=", "NotEqualityOperator"), ("@{", "OpenMultiReplace"), ("${", "OpenPrint"), ("+", "AdditionOperator"), ("-", "SubtractionOperator"), ("/", "DivisionOperator"), ("%", "ModulusOperator"),
    ("&", "ConcatenationOperator"), ("=", "EqualityOperator"), (">", "GreaterThanOperator"), ("<", "LessThanOperator"), ("|", "MultiReplaceElse"), ("}", "CloseBrace"), ("a_9", "Identifier"), ("true", "BooleanLiteral"),
    ("false", "BooleanLiteral"), ("and", "LogicalAnd"), ("or", "LogicalOr"), ("not", "NotOperator"), ("round", "RoundOperator"), ("length", "LengthOperator"), ("modulo", "ModulusOperator"), ("And", "Identifier"), ("{", None), ("é", None), ("$", None),
]


def test_every_keyword_and_lexeme(spark):
    rows = scanner.scan(scenes_of(spark, *[c for c, *_ in KEYWORD_CASES], *[f"*if {x}" for x, _ in LEXEME_CASES])).orderBy("scene_name", "token_idx").collect()
    types: dict = {}
    for r in rows:
        types.setdefault(r.scene_name, []).append(r.type)
    every = [types[k][1:-1] for k in sorted(types)]
    assert every == [[t for t in case[1:] if t] for case in KEYWORD_CASES] + [["If", *([t] if t else [])] for _, t in LEXEME_CASES]


def test_intended_keywords(spark):
    contents = ["*else", "*return", "*else if (a)", "*ifid 12", "*if $!{a} $!!{b} ${c}", "*elsewhere", "a\r\n\r\nb\r\n#x", "tail\n"]
    rows = scanner.scan(scenes_of(spark, *contents), "intended").orderBy("scene_name", "token_idx").collect()
    own = lambda k: [r.type for r in rows if r.scene_name == f"s{k:02d}"][1:-1]
    assert [own(k) for k in range(4)] == [["Else"], ["Return"], ["ElseIf", "OpenParenthesis", "Identifier", "CloseParenthesis"], ["GameIdentifier", "NumberLiteral"]]
    assert own(4) == ["If", "OpenPrintCapitaliseFirst", "Identifier", "CloseBrace", "OpenPrintCapitaliseAll", "Identifier", "CloseBrace", "OpenPrint", "Identifier", "CloseBrace"]
    assert own(5) == [] and own(7) == ["Prose"] and next(r for r in rows if r.scene_name == "s06" and r.type == "Prose").content == "a\n\nb\n"
    with pytest.raises(ValueError, match="no such semantics"):
        scanner.scan(scenes_of(spark, "a"), "guessed")


def test_observed_line_ends_tabs_and_print_forms(spark):
    rows = scanner.scan(scenes_of(spark, "a\r\nb\r\n#x", "\t\tHello\n\tHi\n#x", "*if $!{a}")).orderBy("scene_name", "token_idx").collect()
    own = lambda k: [shown(r) for r in rows if r.scene_name == f"s{k:02d}"][1:-1]
    assert own(0)[0] == "Prose[a\nb\r\n]@0:0" and own(1)[0] == "Prose[He\t\tHello\nH\tHi\n]@0:2"
    assert own(2) == ["If@0:0", "Identifier[a]@0:7", "CloseBrace@0:8"]


def test_nulls_repeated_names_and_long_lines(spark):
    long = "*set x " + "a + " * 20_000 + "b"
    found = spark.createDataFrame([("n", "u1", None), ("r", "u2", "*label a"), ("r", "u1", "*label b"), ("long", "u", long), ("empty", "u", "")], scenes.SCENE)
    rows = scanner.scan(scenes.with_own_names(scenes.without_missing(found))).collect()
    labels = {(r.scene_name, r.value_str) for r in rows if r.scene_name.startswith("r") and r.type == "Identifier"}
    assert labels == {("r", "b"), ("r~2", "a")} and not [r for r in rows if r.scene_name == "n"]
    own = [r for r in rows if r.scene_name == "long"]
    assert len(own) == 40_005 and all(long[r.position : r.position + 1] in "ab+x" for r in own if r.type not in ("SceneStart", "SceneEnd", "SetVariable"))
    assert scanner.scan(found.limit(0)).count() == 0


def test_intended_semantics(spark):
    rows = scanner.scan(scenes_of(spark, "\tHello\n#A\nBye", "a\r\nb\r\n#x", "*set v %- 5"), "intended").orderBy("scene_name", "token_idx").collect()
    own = lambda k: [shown(r) for r in rows if r.scene_name == k][1:]
    assert own("s00") == ["Prose[\tHello\n]@0:1", "ChoiceOption[A]@1:0", "Prose[Bye\n]@2:0", "SceneEnd@3:0"]
    assert own("s01")[0] == "Prose[a\nb\n]@0:0"
    assert own("s02")[2] == "FairmathSubtractionOperator[%-]@0:7"


def test_segments_tile_their_lines(spark):
    found = scanner.lines(scenes_of(spark, *[c for c, _ in GOLDEN]))
    tiles = scanner.segments(found).groupBy("scene_name", "line_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"]), "").alias("joined"))
    both = found.join(tiles, ["scene_name", "line_number"]).select(F.expr("substring(line, start + 1)").alias("rest"), "joined").collect()
    assert both and all(r.rest == r.joined for r in both)


EXPRESSIONS = [
    ("a-b-c", "a b c - -", None),
    ("%+ 10", "10.0 ~%+", None),
    ("round(2)", None, "Expect expression."),
    ('&"a"', None, "Expect expression."),
    ("a or b and c", "a b or c and", None),
    ("not (a = 1) and b", "a 1.0 = ~not b and", None),
    ("a/b/c", "a b / c /", None),
    ("(a", None, "Expect ')' after expression."),
    ("", None, "Expect expression."),
    ("a )", None, "Expected end of statement"),
    ("(a b)", None, "Expect ')' after expression."),
    ("a b", None, "Expected end of statement"),
    ("a +", None, "Expect expression."),
    ("()", None, "Expect expression."),
    ("- - (a) - -b", "a ~- ~- b ~- -", None),
]


def test_expressions(spark):
    rows = statements.expressions(scanner.scan(scenes_of(spark, *[f"*set x {e}" for e, _, _ in EXPRESSIONS]))).orderBy("scene_name").collect()
    assert [(r.postfix, r.error) for r in rows] == [(p, e) for _, p, e in EXPRESSIONS]


#: Binary operators from the loosest to the tightest, those of one list alike; the third binds to the right.
GRAMMAR = [["and", "or"], [">", ">=", "<", "<=", "=", "!="], ["-", "+", "&"], ["/", "%"]]


def descend(words):
    """The postfix order of an expression by recursive descent."""
    at = 0

    def level(k):
        nonlocal at
        if k == len(GRAMMAR):
            return unary()
        left = level(k + 1)
        while at < len(words) and words[at] in GRAMMAR[k]:
            operator = words[at]
            at += 1
            left = [*left, *level(k if k == 2 else k + 1), operator]
        return left

    def unary():
        nonlocal at
        at += 1
        word = words[at - 1]
        if word in ("not", "-", "+", "%+", "%-"):
            return [*unary(), f"~{word}"]
        if word == "(":
            inner = level(0)
            at += 1
            return inner
        return [word]

    found = level(0)
    assert at == len(words)
    return found


def test_postfix_against_recursive_descent(spark):
    draw = random.Random(4)

    def expression(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.25:
            return [draw.choice("abcd")]
        if kind < 0.4:
            return [draw.choice(["not", "-", "%+"]), *expression(depth - 1)]
        if kind < 0.55:
            return ["(", *expression(depth - 1), ")"]
        return [*expression(depth - 1), draw.choice(draw.choice(GRAMMAR)), *expression(depth - 1)]

    cases = [expression(5) for _ in range(400)]
    # A prefix operator before an operand and its binary operators binds tighter than those, in both.
    rows = statements.expressions(scanner.scan(spark.createDataFrame([(f"s{k:03d}", "", f"*if {' '.join(c)}") for k, c in enumerate(cases)], scenes.SCENE))).orderBy("scene_name").collect()
    assert [(r.postfix.split(), r.error) for r in rows] == [(descend(c), None) for c in cases]


def descend_tree(words):
    """The same as nested tuples: (kind, operator or value, children)."""
    at = 0

    def level(k):
        nonlocal at
        if k == len(GRAMMAR):
            return unary()
        left = level(k + 1)
        while at < len(words) and words[at] in GRAMMAR[k]:
            operator = words[at]
            at += 1
            left = ("Binary", operator, (("left", left), ("right", level(k if k == 2 else k + 1))))
        return left

    def unary():
        nonlocal at
        at += 1
        word = words[at - 1]
        if word in ("not", "-", "+", "%+", "%-"):
            return ("Unary", word, (("operand", unary()),))
        if word == "(":
            inner = level(0)
            at += 1
            return ("Grouping", None, (("expression", inner),))
        return ("Identifier", word, ())

    return level(0)


def test_expression_trees_against_recursive_descent(spark):
    draw = random.Random(9)

    def expression(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.2:
            return [draw.choice("abcd")]
        if kind < 0.35:
            return [draw.choice(["not", "-", "%+"]), *expression(0)]
        if kind < 0.55:
            return ["(", *expression(depth - 1), ")"]
        return [*expression(depth - 1), draw.choice(draw.choice(GRAMMAR)), *expression(depth - 1)]

    cases = [expression(5) for _ in range(400)] + [["(", "a", ")", "-", "(", "(", "b", ")", ")"]]
    rows = statements.expression_tree(scanner.scan(spark.createDataFrame([(f"s{k:03d}", "", f"*if {' '.join(c)}") for k, c in enumerate(cases)], scenes.SCENE))).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.scene_name, []).append(r)

    def nested(own, node):
        children = sorted((r for r in own if r.parent == node.node), key=lambda r: r.node)
        return (node.kind, node.operator or node.value, tuple((r.slot, nested(own, r)) for r in sorted(children, key=lambda r: r.slot)))

    for k, case in enumerate(cases):
        own = by[f"s{k:03d}"]
        (root,) = [r for r in own if r.slot == "root"]
        assert root.parent is None and nested(own, root) == descend_tree(case), case
        assert len(own) == sum(w != ")" for w in case)


TREE = """*if (a)
  One
  *elseif (c)
    Two
*elseif (b)
  Three
*else if
  *choice
    *hide_reuse *disable_reuse *selectable_if (d) #First
      Body
    *if (e) #Second
      More
    #Third
*else 
  Late
*page_break Next
*label here"""


def test_statement_tree(spark):
    rows = statements.tree(scanner.scan(scenes_of(spark, TREE))).orderBy("token_idx").collect()
    name = {r.token_idx: (r.text or r.kind).strip() for r in rows}
    got = [(name[r.token_idx], name.get(r.parent_idx), r.slot, r.ordinal) for r in rows]
    assert got == [
        ("If", None, "root", 0), ("One", "If", "body", 0), ("ElseIf", "If", "body", 1), ("Two", "ElseIf", "body", 0), ("ElseIf", "If", "else_if", 0), ("Three", "ElseIf", "body", 0), ("Else", "If", "else", 0),
        ("Choice", "Else", "body", 0), ("First", "Choice", "body", 0), ("Body", "First", "body", 0), ("If", "Choice", "body", 1), ("Second", "If", "body", 0), ("More", "Second", "body", 0), ("Third", "Choice", "body", 2),
        ("Else", None, "root", 1), ("Late", "Else", "body", 0), ("Next", None, "root", 2), ("Label", None, "root", 3),
    ]
    assert {r.text: r.reuse for r in rows if r.kind == "ChoiceOption"} == {"First": "disable_reuse", "Second": None, "Third": None}
    options = statements.choice_options(scanner.scan(scenes_of(spark, TREE))).collect()
    assert len({r.choice_idx for r in options}) == 1 and {r.text: (r.selectable_idx is not None, r.if_idx is not None) for r in options} == {"First": (True, False), "Second": (False, True), "Third": (False, False)}
    assert statements.tree(scanner.scan(scenes_of(spark).limit(0))).count() == 0


def test_errors_of_structure(spark):
    contents = ["*choice\n  *set x 1\n  #A", "*else \nx\n#a", "*hide_reuse Text\n#a", "*choice\n  *comment fine\n  *hide_reuse #A\n  *if (a)\n    #B", "*if (a)\n  *set x 1\n*else \n  *set x 2"]
    found: dict = {}
    for r in statements.parse_errors(scanner.scan(scenes_of(spark, *contents))).collect():
        found.setdefault(r.scene_name, []).append(r.message)
    assert found == {"s00": ["Expected ChoiceOption token after modifiers"], "s01": ["Unknown statement block starting Else"], "s02": ["Expected ChoiceOption token after modifiers"]}


def test_parse_errors(spark):
    rows = statements.parse_errors(scanner.scan(scenes_of(spark, "*gosub f x", "*finish", "*choice\n  Prose\n  #A\n    ok\n#B", "*goto_scene s l"))).collect()
    found = {r.scene_name: r.message for r in rows}
    assert found["s00"].startswith("Expected end of statement") and found["s01"].startswith("Unknown statement block starting Finish") and found["s02"].startswith("Prose is not allowed") and "s03" not in found


def test_unknown_statements_end_no_chain_of_branches(spark):
    contents = ["*if (a)\n*finish\n*else \n  x\n#a", "*if (a)\n*delete b\n*elseif (c)\n*image d\n*else \n*image e\n*else \n", "*finish\n*else \n"]
    tokens = scanner.scan(scenes_of(spark, *contents))
    branches = {(r.scene_name, r.token_idx) for r in statements.else_pairing(statements.parents(tokens)).collect() if r.if_idx is None}
    found = [(r.scene_name, r.token_idx, r.message) for r in statements.parse_errors(tokens).collect()]
    assert {(s, k) for s, k, message in found if message == "Unknown statement block starting Else"} == branches and len(branches) == 2
    assert sorted((s, message.split(" at ")[0].split()[-1]) for s, _, message in found) == [("s00", "Finish"), ("s01", "DeleteVariable"), ("s01", "Else"), ("s01", "Image"), ("s01", "Image"), ("s02", "Else"), ("s02", "Finish")]


def test_structural_errors_of_branches_beside_unknown_statements(spark):
    tokens = scanner.scan(scenes_of(spark, "  *set x 1\n*if (a)\n*delete b\n*else \n  *set x 2", "*if (a)\n  *finish\n    *set x 1\n*elsif (b)\n*link c\n*else \n#d"))
    found = sorted((r.scene_name, r.message.split(" at ")[0]) for r in statements.structural_errors(tokens).collect())
    assert found == [("s00", "Unknown statement block starting DeleteVariable"), ("s01", "Unknown statement block starting Finish"), ("s01", "Unknown statement block starting Link")]
    assert all(r.if_idx is not None for r in statements.else_pairing(statements.parents(tokens)).collect())


def test_errors_of_second_operands_and_the_first_error(spark):
    contents = ["*goto_scene a 5", '*gosub_scene b "q"', "*goto_scene a b c", "*page_break", "*label a\n*set x 1\n*finish\n*set", "*set x 1\n*set y", "  *if (a) b", "*set x\n  *goto_scene s l\n", "*temp t", "*goto\tx", "*set 5"]
    rows: dict = {}
    for r in statements.errors(scanner.scan(scenes_of(spark, *contents))).collect():
        rows.setdefault(r.scene_name, []).append((r.token_idx, r.message, r.found_idx, r.source))
    rows = {k: sorted(v) for k, v in rows.items()}
    assert rows == {
        "s00": [(1, "Expect label name.", 3, "structure")], "s01": [(1, "Expect subroutine label name.", 3, "structure")], "s02": [(1, "Expected end of statement, found Identifier", 4, "structure")],
        "s04": [(6, "Unknown statement block starting Finish at s04:2:0", 6, "structure"), (7, "Expect variable name", 8, "structure")],
        "s05": [(4, "Expect expression.", 6, "expression")], "s06": [(1, "Expected end of statement", 5, "expression")], "s07": [(1, "Expect expression.", 3, "expression")], "s10": [(1, "Expect variable name", 2, "structure")],
    }
    found = {r.scene_name: (r.parsed, r.n_statements, r.error) for r in statements.parse_outcome(scanner.scan(scenes_of(spark, *contents, ""))).collect()}
    assert found["s00"] == (False, 0, "Error: Expect label name. at 'NumberLiteral' s00:0:14[0]") and found["s02"] == (False, 0, "Error: Expected end of statement, found Identifier instead at 0:16 at 'Identifier' s02:0:16[0]")
    assert found["s03"] == (True, 1, None) and found["s04"] == (False, 2, "Unknown statement block starting Finish at s04:2:0[0]") and found["s05"] == (False, 1, "Error: Expect expression. at end of scene s05:2:0[0]")
    assert found["s07"] == (False, 0, "Error: Expect expression. at 'GotoScene' s07:1:2[1]") and found["s08"] == (True, 1, None) and found["s11"] == (True, 0, None)


def test_blocks_and_spans_of_statements(spark):
    text = "*comment a\n*comment b\n  *comment deeper\n  *comment again\n*comment c\n*if (x)\n  *comment d\n  *comment e\n  *set y 1\n  *comment f\n*label z"
    rows = statements.tree_of_blocks(scanner.scan(scenes_of(spark, text))).orderBy("token_idx").collect()
    assert [(r.kind, r.n_tokens, r.ordinal, r.text) for r in rows] == [("Comment", 2, 0, "a\nb"), ("Comment", 2, 0, "deeper\nagain"), ("Comment", 1, 1, "c"), ("If", 1, 2, ""), ("Comment", 2, 0, "d\ne"), ("SetVariable", 1, 1, ""), ("Comment", 1, 2, "f"), ("Label", 1, 3, "")]
    tokens = scanner.scan(scenes_of(spark, text, TREE, "", "*set x 1"))
    found = statements.spans(tokens).collect()
    end = {r.scene_name: r.token_idx for r in tokens.filter("type = 'SceneEnd'").collect()}
    up = {(r.scene_name, r.token_idx): r.parent_idx for r in statements.parents(tokens).collect()}
    assert len(found) == len(up)
    by = {(r.scene_name, r.token_idx): r for r in found}
    for (scene, at), r in by.items():
        inside = [x for x in found if x.scene_name == scene and at <= x.token_idx <= r.last_token]
        assert r.size == len(inside) and all(x.last_token <= r.last_token for x in inside)
        over = up[scene, at]
        assert r.depth == (0 if over is None else by[scene, over].depth + 1) and (over is None or r.last_token <= by[scene, over].last_token)
    for scene, last in end.items():
        roots = sorted((r.token_idx, r.last_token) for r in found if r.scene_name == scene and r.depth == 0)
        assert [x for a, b in roots for x in range(a, b + 1)] == list(range(1, last))


@pytest.mark.parametrize("semantics", ["observed", "intended"])
def test_large_scenes_in_blocks(spark, semantics):
    draw = random.Random(5)
    kinds = ["Prose here", "", "   ", "*set x 1", "#Option @{a b|c}", "*page_break Next", "  *if (a) #Go", "\tTab", "x\r", "*comment c", "  more", "*hide_reuse tail", "*goto_scene", "    deep", "*choice"]
    texts = {"long": [draw.choice(kinds) for _ in range(120)], "prose": ["Only prose"] * 40, "end": ["*label a"] + [""] * 20 + ["tail\r"], "one": ["x"], "blank": [""], "first": ["\t"] * 9 + ["*label b"], "crlf": ["a\r", "b\r", "c\r"]}
    whole = spark.createDataFrame([(k, "", "\n".join(v)) for k, v in texts.items()], scenes.SCENE)
    rows = spark.createDataFrame([(k, i, line) for k, v in texts.items() for i, line in enumerate(v)], "scene_name string, line_number long, line string").repartition(3)
    expected = scanner.scan(whole, semantics)
    found = scanner.scan_large(rows, semantics, block_lines=4)
    assert found.columns == expected.columns and sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    own = statements.parents(expected)
    assert sorted(map(str, statements.parents_in_blocks(found, 4).select(own.columns).collect())) == sorted(map(str, own.collect()))
    assert scanner.scan_large(rows.limit(0), semantics).count() == 0


def test_parents_of_deep_scenes_in_blocks(spark):
    draw = random.Random(8)
    lines, indent = [], 0
    for _ in range(400):
        indent = max(0, min(12, indent + draw.choice([-5, -1, 0, 0, 0, 1, 1, 2])))
        lines.append(" " * indent + draw.choice(["*set x 1", "*if (a) #B", "*comment c"]))
    rows = spark.createDataFrame([("s", i, line) for i, line in enumerate(lines)], "scene_name string, line_number long, line string")
    tokens = scanner.scan_large(rows, block_lines=7)
    own = statements.parents(scanner.scan(spark.createDataFrame([("s", "", "\n".join(lines))], scenes.SCENE)))
    for size in (1, 7, 50, 1000):
        assert sorted(map(str, statements.parents_in_blocks(tokens, size).select(own.columns).collect())) == sorted(map(str, own.collect()))


def test_positions_of_many_segments(spark):
    line = "*set x " + "a " * 3
    wide = "".join(f"*set v{k} " for k in range(3000))
    rows = scanner.segments(scanner.lines(scenes_of(spark, wide, "  " + line))).orderBy("scene_name", "segment").collect()
    own = [r for r in rows if r.scene_name == "s00"]
    assert len(own) == 3000 and all(wide[r.position : r.position + len(r.text)] == r.text for r in own) and rows[-1].position == 2


def test_scene_list(spark):
    rows = scenes.scene_list(scenes_of(spark, "*title T\n*scene_list\n  startup\n  ch1\n*create x 1", "*scene_list\n a\n bc")).orderBy("scene_name", "place").collect()
    assert [(r.scene_name, r.listed) for r in rows] == [("s00", "startup"), ("s00", "ch1"), ("s01", "a"), ("s01", "b")]
    with pytest.raises(Exception, match="empty scene"):
        scenes.scene_list(scenes_of(spark, "")).collect()


def test_files_json_and_stream(spark, tmp_path):
    for name, text in (("one", "Hi\n*label a"), ("two", scenes.MISSING_SCENE)):
        (tmp_path / f"{name}.txt").write_text(text)
    read = scenes.read_scenes(spark, str(tmp_path))
    assert {r.scene_name for r in read.collect()} == {"one", "two"} and scenes.without_missing(read).count() == 1
    tokens = scanner.scan(scenes.without_missing(read))
    token_json.write_tokens(tokens, str(tmp_path / "json"))
    assert sorted(token_json.read_tokens(spark, str(tmp_path / "json")).collect(), key=str) == sorted(tokens.collect(), key=str)
    assert token_json.nested_by_scene(tokens).count() == 1
    query = stream_segments(stream_scenes(spark, str(tmp_path / "*.txt"))).writeStream.format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("streamed").filter("type = 'Label'").count() == 1


def test_nested_json_round_trip(spark, tmp_path):
    tokens = scanner.scan(scenes_of(spark, *[c for c, _ in GOLDEN]))
    token_json.write_nested(tokens, str(tmp_path / "nested"))
    columns = scanner.TOKEN.fieldNames()
    assert sorted(token_json.read_nested(spark, str(tmp_path / "nested")).select(columns).collect(), key=str) == sorted(tokens.select(columns).collect(), key=str)
    (tmp_path / "one.json").write_text('[\n  [\n {"type": "NumberLiteral", "sceneName": "a", "lineNumber": 1, "position": 2, "indent": 0.5, "value": 3},\n {"type": "BooleanLiteral", "sceneName": "a", "value": true}], [{"type": "Comment", "sceneName": "b", "value": "c"}]]')
    found = {(r.scene_name, r.token_idx): (r.type, r.value_num, r.value_bool, r.value_str) for r in token_json.read_nested(spark, str(tmp_path / "one.json")).collect()}
    assert found == {("a", 0): ("NumberLiteral", 3.0, None, None), ("a", 1): ("BooleanLiteral", None, True, None), ("b", 0): ("Comment", None, None, "c")}


@pytest.mark.parametrize("n_bytes", ["128m", "700"])
def test_pretty_json_in_blocks(spark, tmp_path, n_bytes):
    tricky = ['*set s "a]}[{"', "*comment }\\" + '"', "5 [ { # x } ]", "*label a\n#B \"q\" @{c d|e}\nTail\n*if true"]
    tokens = scanner.scan(scenes_of(spark, *[c for c, _ in GOLDEN], *tricky))
    token_json.write_pretty(tokens, str(tmp_path / "pretty"))
    parts = sorted((tmp_path / "pretty").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    read = json.loads(whole)
    assert [[t["type"] for t in scene] for scene in read] == [[r.type for r in sorted(own, key=lambda r: r.token_idx)] for _, own in sorted(_by_scene(tokens).items())] and whole.startswith('[\n  [\n    {\n      "type": "SceneStart",\n      "sceneName": "s00",\n      "lineNumber": 0,')
    columns = scanner.TOKEN.fieldNames()
    expected = sorted(map(str, tokens.select(columns).collect()))
    (tmp_path / "own.json").write_text(json.dumps(read, indent=4))
    (tmp_path / "flat.json").write_text("[" + ",\n".join("\n[\n" + ",\n".join(json.dumps(t) for t in scene) + "\n]" for scene in read) + "\n]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", n_bytes)
    try:
        for name in ("pretty", "own.json", "flat.json"):
            found = token_json.read_pretty(spark, str(tmp_path / name)).select(columns)
            assert sorted(map(str, found.collect())) == expected, name
            if n_bytes == "700":
                assert spark.read.text(str(tmp_path / name)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    token_json.write_pretty(tokens.limit(0), str(tmp_path / "none"))
    assert token_json.read_pretty(spark, str(tmp_path / "none")).count() == 0


def _bytes_in(folder):
    return sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*") if p.is_file())


def test_pretty_json_keeps_less_than_its_text(spark, tmp_path):
    lines = ["*set x (1 + 2) * a", "Text [of {a}] body", "*if (a) #Go @{b c|d}", "*comment }] note"]
    tokens = scanner.scan(scenes_of(spark, *["\n".join(f"{line} {k}" for k in range(100) for line in lines) for _ in range(10)]))
    shared = shared_folder(spark).removeprefix("file:").rsplit("/", 1)[0]
    before = _bytes_in(shared)
    token_json.write_pretty(tokens, str(tmp_path / "pretty"))
    text = sum(p.stat().st_size for p in (tmp_path / "pretty").glob("part-*"))
    columns = scanner.TOKEN.fieldNames()
    found = token_json.read_pretty(spark, str(tmp_path / "pretty")).select(columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, tokens.select(columns).collect()))
    assert _bytes_in(shared) - before < text / 2


@pytest.mark.parametrize("n_bytes", ["128m", "5000"])
def test_pretty_json_compressed_with_long_texts(spark, tmp_path, monkeypatch, n_bytes):
    monkeypatch.setattr(token_json, "FILE_TOKENS", 7)
    tokens = scanner.scan(scenes_of(spark, *['a "b] {c' * 4000 + "\n*label a\n#B", "*set x 5\n" * 9 + "*comment \\" * 3000, "#q", "*set y 1e5\n" + "*set z 123456789012.5\n"]))
    token_json.write_pretty(tokens, str(tmp_path / "packed"), "gzip")
    parts = sorted((tmp_path / "packed").glob("part-*"))
    read = json.loads(gzip.decompress(b"".join(p.read_bytes() for p in parts)))
    assert len(parts) > 3 and [[t["type"] for t in scene] for scene in read] == [[r.type for r in sorted(own, key=lambda r: r.token_idx)] for _, own in sorted(_by_scene(tokens).items())]
    columns = scanner.TOKEN.fieldNames()
    expected = sorted(map(str, tokens.select(columns).collect()))
    (tmp_path / "own.json").write_text(json.dumps(read, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", n_bytes)
    try:
        for name in ("packed", "own.json"):
            assert sorted(map(str, token_json.read_pretty(spark, str(tmp_path / name)).select(columns).collect())) == expected, name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_pretty_json_of_a_scene_without_a_name(spark, tmp_path):
    for k, names in enumerate((["b", None, "a"], [None])):
        tokens = scanner.scan(spark.createDataFrame([(name, "", f"*set x {i}\n#A") for i, name in enumerate(names)], "scene_name string, source_url string, content string"))
        token_json.write_pretty(tokens, str(tmp_path / str(k)))
        assert len(json.loads("".join(p.read_text() for p in sorted((tmp_path / str(k)).glob("part-*"))))) == len(names)
        found = token_json.read_pretty(spark, str(tmp_path / str(k)))
        assert sorted(map(str, found.collect())) == sorted(map(str, tokens.select(found.columns).collect()))


def _by_scene(tokens):
    found: dict = {}
    for r in tokens.collect():
        found.setdefault(r.scene_name, []).append(r)
    return found


def test_http_source(spark):
    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            known = self.path == "/scenes/startup.txt"
            self.send_response(200 if known else 404)
            self.end_headers()
            self.wfile.write(b"*scene_list\n  startup\n*x" if known else scenes.MISSING_SCENE.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(scenes.HttpScenes)
        base = f"http://127.0.0.1:{server.server_port}"
        found = spark.read.format("http_scenes").option("base", base).option("names", "startup, gone").option("timeout", "10").load()
        assert {r.scene_name for r in found.collect()} == {"startup", "gone"}
        assert [tuple(r) for r in scenes.scene_list(scenes.without_missing(found)).collect()] == [("startup", 0, "startup")]
    finally:
        server.shutdown()


def test_http_source_partitions():
    reader = scenes.HttpScenes({"base": "http://x/", "names": "a, b,"}).reader(scenes.SCENE)
    assert [p.name for p in reader.partitions()] == ["a", "b"]


def test_declared_types(spark):
    sources = spark.createDataFrame([("a.ts", "export * from './b';\ninterface IfToken extends Token { type: 'If'; }\ninterface NoToken extends Token { x: 1 }")], "path string, content string")
    assert [tuple(r) for r in token_types.exported_modules(sources).collect()] == [("a.ts", "./b")]
    assert [tuple(r) for r in token_types.declared_types(sources).collect()] == [("IfToken", "If"), ("NoToken", None)]
    graph = spark.createDataFrame([("s/index.ts", "export * from './a';\nexport  *  from \"./sub\";export * from './gone'"), ("s/a.ts", "export * from './index'"), ("s/sub/index.ts", "export * from './if-token'"), ("s/sub/if-token.ts", "export * from './a'"), ("s/other.ts", "")], "path string, content string")
    assert {tuple(r) for r in token_types.reachable_files(graph, "s/index.ts").collect()} == {("s/index.ts", 0), ("s/a.ts", 1), ("s/sub/index.ts", 1), ("s/sub/if-token.ts", 2)}
    assert token_types.union_text(token_types.declared_types(sources)).first()[0] == "'If'"
