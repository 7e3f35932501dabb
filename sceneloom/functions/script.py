"""The script language: its keywords, lexemes and the patterns that cut lines into segments and lexemes."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, functions as F

# Each keyword with its token type and what follows it. X: an expression up to the next
# command, P: prose up to the next command, E: prose to the end of the line, C: a comment, O: an option's text.
KEYWORDS = {
    "*label": ("Label", "X"),
    "*hide_reuse": ("HideReuse", "P"),
    "*disable_reuse": ("DisableReuse", "P"),
    "*allow_reuse": ("AllowReuse", "P"),
    "*gosub ": ("GoSub", "X"),
    "*gosub_scene ": ("GoSubScene", "X"),
    "*return ": ("Return", "X"),
    "*goto ": ("GotoLabel", "X"),
    "*goto_scene": ("GotoScene", "X"),
    "*goto_random_scene": ("GotoRandomScene", "X"),
    "#": ("ChoiceOption", "O"),
    "*if": ("If", "X"),
    "*elseif": ("ElseIf", "X"),
    "*elsif": ("ElseIf", "X"),
    "*else ": ("Else", "X"),
    "*create": ("CreateVariable", "X"),
    "*temp": ("CreateTempVariable", "X"),
    "*set": ("SetVariable", "X"),
    "*choice": ("Choice", "P"),
    "*fake_choice": ("FakeChoice", "P"),
    "*finish": ("Finish", "E"),
    "*ending": ("Ending", "E"),
    "*stat_chart": ("StatChart", "P"),
    "*line_break": ("LineBreak", "P"),
    "*selectable_if": ("SelectableIf", "X"),
    "*link": ("Link", "X"),
    "*comment": ("Comment", "C"),
    "*image": ("Image", "X"),
    "*input_number": ("InputNumber", "X"),
    "*input_text": ("InputText", "X"),
    "*author": ("Author", "X"),
    "*page_break": ("PageBreak", "E"),
    "*save_checkpoint": ("SaveCheckpoint", "P"),
    "*restore_checkpoint": ("RestoreCheckpoint", "P"),
    "*delete": ("DeleteVariable", "X"),
    "*rand": ("GenerateRandom", "X"),
}
#: Keywords that make no token; the rest of their line is dropped, as that of unknown commands.
SILENT = ("*scene_list", "*achievement")
#: Token types without a keyword of their own.
STRUCTURAL = ("SceneStart", "SceneEnd", "Prose")

# The lexemes of one and two characters and the words with a type of their own.
OPERATORS = {
    "%+": "FairmathAdditionOperator",
    "%-": "FairmathAdditionOperator",
    ">=": "GreaterThanEqualsOperator",
    "<=": "LessThanEqualsOperator",
    "!=": "NotEqualityOperator",
    "@{": "OpenMultiReplace",
    "${": "OpenPrint",
    "+": "AdditionOperator",
    "-": "SubtractionOperator",
    "*": "MultiplicationOperator",
    "/": "DivisionOperator",
    "%": "ModulusOperator",
    "&": "ConcatenationOperator",
    "=": "EqualityOperator",
    ">": "GreaterThanOperator",
    "<": "LessThanOperator",
    "|": "MultiReplaceElse",
    "}": "CloseBrace",
    "(": "OpenParenthesis",
    ")": "CloseParenthesis",
}
WORDS = {
    "true": "BooleanLiteral",
    "false": "BooleanLiteral",
    "and": "LogicalAnd",
    "or": "LogicalOr",
    "not": "NotOperator",
    "round": "RoundOperator",
    "length": "LengthOperator",
    "modulo": "ModulusOperator",
}
#: Lexemes whose tokens carry no raw value.
BARE = ("OpenMultiReplace", "OpenPrint", "OpenPrintCapitaliseFirst", "OpenPrintCapitaliseAll", "MultiReplaceElse", "CloseBrace", "OpenParenthesis", "CloseParenthesis", "BooleanLiteral")
MISSING_SCENE = '{"error":"couldn\'t find scene"}\n'
#: What counts as blank at the ends of prose; the same set in Java's and RE2's notation.
BLANK_JAVA = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BLANK_RE2 = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


# What `intended` semantics adds to the keywords and lexemes, and names otherwise.
INTENDED_KEYWORDS = {
    "*else if": ("ElseIf", "X"),
    "*else": ("Else", "X"),
    "*return": ("Return", "X"),
    "*ifid": ("GameIdentifier", "X"),
}
INTENDED_OPERATORS = {
    "%-": "FairmathSubtractionOperator",
    "$!{": "OpenPrintCapitaliseFirst",
    "$!!{": "OpenPrintCapitaliseAll",
}
#: Keywords that only count at the end of a line, or before a space.
TO_THE_END = ("*else", "*return")


@dataclass(frozen=True)
class Language:
    """The tables and patterns of one semantics.

    A line without its indentation is the concatenation of the matches of `segment`, leftmost first. An expression is
    the concatenation of those of `lexeme`; the last alternative, any character, and spaces make no token.
    """

    keywords: dict[str, tuple[str, str]]
    operators: dict[str, str]
    segment: str
    keyword: str
    lexeme: str


def language(semantics: str = "observed") -> Language:
    """Observed, a keyword counts as soon as it is complete, so that shorter ones win; intended, longer ones do."""
    if semantics not in ("observed", "intended"):
        raise ValueError(f"no such semantics: {semantics}")
    observed = semantics == "observed"
    keywords = KEYWORDS if observed else dict(sorted((KEYWORDS | INTENDED_KEYWORDS).items(), key=lambda x: -len(x[0])))
    shown = {k: k[1:] + (r"\z" if k in TO_THE_END else "") for k in keywords if k != "#"}
    of_mode = lambda mode: "|".join(shown[k] for k, (_, m) in keywords.items() if m == mode and k in shown)
    # Where one keyword begins another one, that of the other mode must not win: expressions and prose run as far, but comments and rests do not.
    segment = rf"#(?s:.*)|\*(?:{of_mode('C')}|{of_mode('E')})(?s:.*)|\*(?:{of_mode('X')})[^*#]*|\*(?:{of_mode('P')})[^*#]*|\*(?s:.*)|[^*#]+"
    print_forms = "" if observed else r"\$!!\{|\$!\{|"
    lexeme = r"""[ \t]+|[0-9][0-9.]*|"(?:\\(?s:.)|[^"\\])*(?:"|\\?\z)|'(?:\\(?s:.)|[^'\\])*(?:'|\\?\z)|%\+|%-|>=|<=|!=|@\{|""" + print_forms + r"""\$\{|[-+*/%&=><|}()]|[A-Za-z_][A-Za-z0-9_]*|(?s:.)"""
    return Language(keywords, OPERATORS if observed else OPERATORS | INTENDED_OPERATORS, segment, r"^(?:#|\*(?:" + "|".join(shown.values()) + "))", lexeme)


OBSERVED = language()
SEGMENT, KEYWORD, LEXEME = OBSERVED.segment, OBSERVED.keyword, OBSERVED.lexeme
CLOSED = r"""^(?:"(?:\\(?s:.)|[^"\\])*"|'(?:\\(?s:.)|[^'\\])*')\z"""


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a key in a fixed table, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), key)


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, BLANK_JAVA + "+", "") == ""


def is_variable_name(value: Column) -> Column:
    """Letters, digits and underscores only; true for an empty string."""
    return ~F.regexp_like(value, F.lit("[^A-Za-z0-9_]"))
