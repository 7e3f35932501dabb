"""The catalogue of named queries over scripts, with the SQL that checks them.

Scripts come from two places: `documents` are scenes of prose; the events of each user make a scene of
commands, one line an event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.script import BARE, BLANK_RE2, CLOSED, KEYWORDS, SEGMENT, WORDS, language
from ..operators import scanner, statements, token_types
from ..sources import scenes as sources, token_json
from ..sources.kept import delete_folder, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

# ---- scripts ----------------------------------------------------------------------------------------------

#: The line of an odd event: the first rule that holds. <event> is its number, <k> a number of its properties, <k7> that modulo 7.
RULES = [
    ("event_id % 11 = 0", "*comment note <event>"),
    ("event_id % 13 = 0", "*choice"),
    ("event_id % 17 = 0", "    #Option <k> @{flag a|b}"),
    ("event_id % 19 = 0", "*label lbl_<k>"),
    ("event_id % 23 = 0", "*page_break Next <k>"),
    ("event_id % 29 = 0", "*gosub_scene user_<k7>"),
    ("event_id % 31 = 0", "*unknown <k>"),
    ("event_id % 37 = 0", "\tTabbed prose <k>"),
    ("event_type = 'view'", "You saw item <k>."),
    ("event_type = 'click'", "*goto_scene user_<k7> lbl_<k>"),
    ("event_type = 'signup'", "*create v_<k> <k>"),
    ("event_type = 'purchase'", "*set v_<k> %+ <k>"),
]
OTHERWISE = "  *if (v_<k> >= <k>) and not (done)"
#: The lines of even events, in turn, indented by two spaces up to three times: every keyword, every lexeme, and their edges.
LINES = [
    "*choice", "#Take it <k>", "Text of a body <k>", "*if (v_<k> > 3) #Maybe @{v_<k> one|two}", "*else ", "Otherwise <k>", "*elseif (v_<k> < 2)", "Then <k>", "*else ", "Last <k>", "*if v_<k>", "Yes <k>", "*elsif v_<k> != 3",
    "*hide_reuse #Hidden <k>", "*disable_reuse #Once <k>", "*allow_reuse #Again <k>", "*hide_reuse *if (v_<k> > 3) #Maybe <k>", "*allow_reuse *disable_reuse *hide_reuse *selectable_if (v_<k> <= 2) #Both", "*selectable_if (v_<k> >= 1) #Select <k>", "*hide_reuse Not an option",
    "*goto_scene user_1 5", "*gosub_scene user_2 \"q\"", "*goto_scene user_3 lbl_<k> z", "*page_break #Option", "*if v_<k> w",
    "*gosub lbl_<k>", "*gosub lbl_<k> extra", "*gosub_scene user_1 lbl_<k> x", "*return ", "*return", "*goto lbl_<k>", "*goto lbl_<k> then", "*goto_scene", "*goto_random_scene", "*else", "*else if (v_<k> = 1)", "*ifid 12-<k>",
    "*temp t_<k> \"a\\\"b<k>\"", "*temp t_<k>", "*create", "*create 5", "*create c_<k>", "*set", "*label", "*fake_choice", "*finish The end <k>", "*finish", "*ending", "*ending Well <k>", "*stat_chart", "*line_break Then <k>", "*link https://example.org/<k>",
    "*scene_list", "*achievement a_<k> hidden 10", "*image pic_<k>.png", "*input_number n_<k> 1 10", "*input_text name_<k>", "*input_text 5", "*author A. Writer <k>", "*save_checkpoint", "*restore_checkpoint", "*delete v_<k>", "*rand r_<k> 1 6", "*random_<k>", "*comment", "*comment  two <k>", "*page_break", "#",
    "*set v_<k> v_<k> - 1 + 2", "*set v_<k> a-b-c", "*set v_<k> (4 / 2) % 3", "*set v_<k> 3*4", "*set s_<k> 'single quoted'", "*set s_<k> \"open", "*set v_<k> \"a\" & \"b\"", "*set v_<k> %- 10", "*set v_<k> round(2.5) modulo 2", "*set v_<k> length(\"abc\")",
    "*set b_<k> true and (false or not b)", "*set v_<k> <k>.25.5", "*set v_<k> .5", "*set v_<k> ${name} @{flag yes|no}", "*set v_<k> $!{name} $!!{name}", "*set v_<k> {x} [y], é ~ ! _z9", "*set v_<k> a = 1", "*set v_<k> (a", "*set v_<k> )", "*if not (v_<k>)", "*set x-<k>", "*settings on",
    "Stars 5 * <k> here", "Tail # option <k>", "\t\tTwo tabs <k>", " \t Mixed <k>", "   ", "", "Text with CR <k>\r", "*set cr_<k> 1\r", " ", "Mail a@b.c <k>",
]


def _even_line() -> str:
    return f"CAST(floor(event_id / 2) AS INT) % {len(LINES)}"


def _script_line() -> F.Column:
    """The line of an event, from event_id, event_type and k."""
    odd = F.lit(OTHERWISE)
    for when, template in reversed(RULES):
        odd = F.when(F.expr(when), template).otherwise(odd)
    number = F.expr(_even_line())
    even = F.concat(F.repeat(F.lit("  "), F.expr("CAST(floor(event_id / 14) % 4 AS INT)")), F.get(F.array(*map(F.lit, LINES)), number))
    line = F.when(F.col("event_id") % 2 == 1, odd).otherwise(even)
    for mark, value in (("<event>", F.col("event_id")), ("<k7>", F.col("k") % 7), ("<k>", F.col("k"))):
        line = F.replace(line, F.lit(mark), value.cast("string"))
    return line


def script_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each user, of one line an event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = events.select("event_id", "user_id", "event_type", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("long").alias("k"))
    found = found.select("user_id", "event_id", _script_line().alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "line")))
    found = found.groupBy("user_id").agg(ordered.alias("lines"))
    return found.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("scene_name"), F.lit(None).cast("string").alias("source_url"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"))


def script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scene of all events, as rows (scene_name, line_number, line): it is never one text."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = events.select("event_id", "event_type", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("long").alias("k"))
    return found.select(F.lit("all").alias("scene_name"), F.col("event_id").alias("line_number"), _script_line().alias("line"))


def document_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("scene_name"), "lang", F.col("text").alias("content"))


# ---- the same in SQL -----------------------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _table(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in values.items()) + " END"


_ODD = "CASE " + " ".join(f"WHEN {when} THEN {_text(line)}" for when, line in RULES) + f" ELSE {_text(OTHERWISE)} END"
_EVEN = f"repeat('  ', CAST(floor(event_id / 14) % 4 AS INT)) || list_extract([{', '.join(map(_text, LINES))}], {_even_line()} + 1)"
SCRIPT_SQL = f"""scenes AS (
  SELECT 'user_' || CAST(user_id AS VARCHAR) AS scene_name, string_agg(line, chr(10) ORDER BY event_id) AS content
  FROM (SELECT event_id, user_id, replace(replace(replace(CASE WHEN event_id % 2 = 1 THEN {_ODD} ELSE {_EVEN} END, '<event>', CAST(event_id AS VARCHAR)), '<k7>', CAST(k % 7 AS VARCHAR)), '<k>', CAST(k AS VARCHAR)) AS line
        FROM (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events))
  GROUP BY user_id)"""
ONE_SCENE_SQL = SCRIPT_SQL.replace("'user_' || CAST(user_id AS VARCHAR) AS scene_name", "'all' AS scene_name").replace("  GROUP BY user_id)", "  )")
#: Lines of a block of the one scene: few, so that there are many.
ONE_SCENE_BLOCK = 512
DOCUMENT_SQL = "scenes AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS scene_name, lang, text AS content FROM documents)"

LINES_SQL = r"""once AS (SELECT scene_name, CASE WHEN contains(content, chr(13) || chr(10)) THEN substring(content, 1, strpos(content, chr(13) || chr(10)) - 1) || substring(content, strpos(content, chr(13) || chr(10)) + 1) ELSE content END AS content FROM scenes),
split AS (SELECT scene_name, string_split(content, chr(10)) AS every FROM once),
raw AS (SELECT scene_name, len(every) AS n_lines, unnest(every) AS line, unnest(range(len(every))) AS line_number FROM split),
lines AS (SELECT *, start - spaces AS tabs, (start - spaces) + spaces * 0.5::DOUBLE AS indent
  FROM (SELECT *, length(lead) AS start, length(replace(lead, chr(9), '')) AS spaces
        FROM (SELECT *, regexp_extract(line, '^[\t ]*') AS lead FROM raw)))"""
def _segments_sql(semantics: str = "observed") -> str:
    own = language(semantics)
    return f"""pieces AS (SELECT scene_name, line_number, line, indent, start, regexp_extract_all(substring(line, CAST(start + 1 AS BIGINT)), {_text(own.segment)}) AS every FROM lines),
numbered AS (SELECT scene_name, line_number, line, indent, start, unnest(every) AS text, unnest(range(len(every))) AS segment FROM pieces),
placed AS (SELECT *, start + sum(length(text)) OVER (PARTITION BY scene_name, line_number ORDER BY segment) - length(text) AS position,
  regexp_matches(text, '^[*#]') AS command FROM numbered),
keyed AS (SELECT *, CASE WHEN command THEN nullif(regexp_extract(text, {_text(own.keyword)}), '') END AS keyword FROM placed),
segments AS (SELECT *, {_table({k: t for k, (t, _) in own.keywords.items()}, "keyword")} AS type,
  {_table({k: m for k, (_, m) in own.keywords.items()}, "keyword")} AS mode, substring(text, length(keyword) + 1) AS after FROM keyed)"""


def _lexemes_sql(semantics: str = "observed") -> str:
    own = language(semantics)
    return f"""lexed AS (SELECT scene_name, line_number, indent, segment, position + length(keyword) AS base, regexp_extract_all(after, {_text(own.lexeme)}) AS every FROM segments WHERE mode = 'X' AND after <> ''),
cut AS (SELECT scene_name, line_number, indent, segment, base, unnest(every) AS lex, unnest(range(len(every))) AS lexeme FROM lexed),
typed AS (SELECT *, base + sum(length(lex)) OVER (PARTITION BY scene_name, line_number, segment ORDER BY lexeme) - length(lex) AS position,
  CASE WHEN regexp_matches(lex, '^[0-9]') THEN 'NumberLiteral' WHEN lex[1] IN ('"', '''') THEN 'StringLiteral'
       WHEN regexp_matches(lex, '^[A-Za-z_]') THEN coalesce({_table(WORDS, "lex")}, 'Identifier') ELSE {_table(own.operators, "lex")} END AS type FROM cut),
lexemes AS (SELECT scene_name, type, line_number, position, indent, segment, lexeme,
  CASE WHEN type = 'Identifier' THEN lex WHEN type = 'StringLiteral' THEN regexp_replace(CASE WHEN regexp_matches(lex, {_text(CLOSED)}) THEN substring(lex, 2, length(lex) - 2) ELSE substring(lex, 2) END, '\\\\((?s:.))', '\\1', 'g') END AS value_str,
  CASE WHEN type = 'NumberLiteral' THEN CAST(regexp_extract(lex, '^[0-9]+(?:\\.[0-9]*)?') AS DOUBLE) END AS value_num,
  CASE WHEN type = 'BooleanLiteral' THEN lex = 'true' END AS value_bool,
  CASE WHEN type NOT IN ('Identifier', 'StringLiteral', 'NumberLiteral', {", ".join(map(_text, BARE))}) THEN lex END AS raw_value
  FROM typed WHERE type IS NOT NULL)"""


PROSE_SQL = f"""happened AS (
  SELECT scene_name, line_number, 0 AS segment, 1 AS kind, start AS position, indent,
    CASE WHEN tabs = 0 THEN line WHEN length(line) > 2 * tabs + spaces THEN substring(line, start + 1, tabs) || line ELSE substring(line, start + 1) END AS text
  FROM lines WHERE NOT regexp_matches(line, '[*#]') AND length(line) > start
  UNION ALL SELECT scene_name, line_number, 1073741824, 2, NULL, indent, NULL FROM lines
  UNION ALL SELECT scene_name, line_number, segment, 0, NULL, indent, NULL FROM segments WHERE command
  UNION ALL SELECT scene_name, line_number, segment, 1, position, indent, text FROM segments WHERE NOT command AND regexp_matches(line, '[*#]')
  UNION ALL SELECT scene_name, line_number, segment, 1, position + length(keyword), indent, after FROM segments WHERE mode = 'P' AND after <> ''),
islands AS (SELECT *, coalesce(sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scene_name ORDER BY line_number, segment, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM happened),
begun AS (SELECT *, max(CASE WHEN kind = 1 AND regexp_replace(text, {_text(BLANK_RE2 + "+")}, '', 'g') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY scene_name, island ORDER BY line_number, segment, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun FROM islands),
blocks AS (SELECT scene_name, island, string_agg(CASE WHEN kind = 1 THEN text WHEN kind = 2 AND begun = 1 THEN chr(10) END, '' ORDER BY line_number, segment, kind) AS content,
  arg_min(line_number, (line_number, segment)) FILTER (WHERE kind = 1) AS line_number, arg_min(position, (line_number, segment)) FILTER (WHERE kind = 1) AS position,
  arg_min(indent, (line_number, segment)) FILTER (WHERE kind = 1) AS indent, max(line_number) FILTER (WHERE kind = 0) AS flush_line, max(segment) FILTER (WHERE kind = 0) AS segment
  FROM begun GROUP BY scene_name, island),
prose AS (SELECT * FROM blocks WHERE regexp_replace(content, {_text(BLANK_RE2 + "+")}, '', 'g') <> '')"""
TOKENS_SQL = """every_token AS (
  SELECT scene_name, -1 AS at_line, 0 AS segment, 0 AS part, 0 AS lexeme, 'SceneStart' AS type, 0 AS line_number, 0 AS position, 0.0::DOUBLE AS indent, NULL::VARCHAR AS content, NULL::VARCHAR AS value_str, NULL::DOUBLE AS value_num, NULL::BOOLEAN AS value_bool, NULL::VARCHAR AS raw_value, NULL::VARCHAR AS raw_text, NULL::BOOLEAN AS has_multi_replace FROM lines WHERE line_number = 0
  UNION ALL SELECT scene_name, 2147483647, 1, 0, 0, 'SceneEnd', n_lines, 0, 0.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lines WHERE line_number = 0
  UNION ALL SELECT scene_name, line_number, segment, 1, 0, type, line_number, position, indent, NULL, CASE WHEN mode = 'C' AND after <> '' THEN substring(after, 2) END, NULL, NULL, NULL, CASE WHEN mode = 'O' AND after <> '' THEN after END, CASE WHEN mode = 'O' AND after <> '' THEN contains(after, '@{') END FROM segments WHERE type IS NOT NULL
  UNION ALL SELECT scene_name, line_number, segment, 2, 0, 'Prose', line_number, position + length(keyword), indent, after, NULL, NULL, NULL, NULL, NULL, NULL FROM segments WHERE mode = 'E' AND after <> ''
  UNION ALL SELECT scene_name, line_number, segment, 2, lexeme, type, line_number, position, indent, NULL, value_str, value_num, value_bool, raw_value, NULL, NULL FROM lexemes
  UNION ALL SELECT scene_name, flush_line, segment, 0, 0, 'Prose', line_number, position, indent, content, NULL, NULL, NULL, NULL, NULL, NULL FROM prose WHERE flush_line IS NOT NULL),
tokens AS (SELECT scene_name, CAST(row_number() OVER (PARTITION BY scene_name ORDER BY at_line, segment, part, lexeme) - 1 AS INTEGER) AS token_idx, type,
  CAST(line_number AS INTEGER) AS line_number, CAST(position AS INTEGER) AS position, indent, content, value_str, value_num, value_bool, raw_value, raw_text, has_multi_replace FROM every_token)"""
_SAME = "CASE WHEN lead(line_number, {k}) OVER w = line_number THEN lead({c}, {k}) OVER w END"
NEAR_SQL = (
    "near AS (SELECT *, coalesce(lag(line_number) OVER w, 0) = line_number AS same_line, coalesce(lag(indent) OVER w, 0.0) = indent AS same_indent, "
    + ", ".join([*(_SAME.format(c="type", k=k) + f" AS type_{k}" for k in (1, 2, 3)), *(_SAME.format(c="coalesce(value_str, content)", k=k) + f" AS text_{k}" for k in (1, 2))])
    + " FROM tokens WINDOW w AS (PARTITION BY scene_name ORDER BY token_idx))"
)
_IN = lambda types: ", ".join(map(_text, types))
PARENTS_SQL = f"""marked_statements AS (SELECT *, type = 'Prose' AND coalesce(lag(type) OVER w = 'PageBreak' AND lag(line_number) OVER w = line_number, false) AS taken FROM tokens WINDOW w AS (PARTITION BY scene_name ORDER BY token_idx)),
begun_statements AS (SELECT scene_name, token_idx, type, line_number, indent FROM marked_statements WHERE NOT taken AND type IN ({_IN((*statements.STATEMENTS, *statements.INNER))})),
parents AS (SELECT a.scene_name, a.token_idx, any_value(a.type) AS type, any_value(a.line_number) AS line_number, any_value(a.indent) AS indent,
  coalesce(max(b.token_idx) FILTER (WHERE b.line_number = a.line_number AND b.type = 'If'), max(b.token_idx) FILTER (WHERE b.indent < a.indent)) AS parent_idx
  FROM begun_statements a LEFT JOIN begun_statements b ON a.scene_name = b.scene_name AND b.token_idx < a.token_idx AND (b.indent < a.indent OR b.line_number = a.line_number) GROUP BY a.scene_name, a.token_idx)"""
PAIRS_SQL = """branches AS (SELECT *, CASE WHEN type IN ('ElseIf', 'Else') THEN 1 ELSE 0 END AS branch FROM parents),
chained AS (SELECT *, sum(1 - branch) OVER w AS number, max(CASE WHEN branch = 0 THEN token_idx END) OVER w AS head FROM branches WINDOW w AS (PARTITION BY scene_name, parent_idx, indent ORDER BY token_idx)),
closed AS (SELECT *, coalesce(max(CASE WHEN type = 'Else' THEN 1 ELSE 0 END) OVER (PARTITION BY scene_name, parent_idx, indent, number ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM chained),
pairs AS (SELECT c.scene_name, c.token_idx, c.type, CASE WHEN h.type = 'If' AND c.closed = 0 THEN c.head END AS if_idx FROM closed c LEFT JOIN parents h ON c.scene_name = h.scene_name AND c.head = h.token_idx WHERE c.branch = 1)"""
OPTIONS_SQL = """on_line AS (SELECT scene_name, line_number, max(token_idx) FILTER (WHERE type = 'DisableReuse') AS disable_reuse, max(token_idx) FILTER (WHERE type = 'HideReuse') AS hide_reuse, max(token_idx) FILTER (WHERE type = 'AllowReuse') AS allow_reuse,
  max(token_idx) FILTER (WHERE type = 'SelectableIf') AS selectable_idx, max(token_idx) FILTER (WHERE type = 'If') AS if_idx FROM parents GROUP BY ALL),
options AS (SELECT o.scene_name, o.token_idx, CASE WHEN p.type = 'Choice' THEN p.token_idx WHEN p.type = 'If' AND g.type = 'Choice' THEN g.token_idx END AS choice_idx,
  CASE WHEN disable_reuse IS NOT NULL THEN 'disable_reuse' WHEN hide_reuse IS NOT NULL THEN 'hide_reuse' WHEN allow_reuse IS NOT NULL THEN 'allow_reuse' END AS reuse, selectable_idx, if_idx, t.raw_text AS text
  FROM parents o JOIN on_line l ON o.scene_name = l.scene_name AND o.line_number = l.line_number JOIN tokens t ON o.scene_name = t.scene_name AND o.token_idx = t.token_idx
  LEFT JOIN parents p ON o.scene_name = p.scene_name AND o.parent_idx = p.token_idx LEFT JOIN parents g ON p.scene_name = g.scene_name AND p.parent_idx = g.token_idx WHERE o.type = 'ChoiceOption')"""
TREE_SQL = """placed_statements AS (SELECT p.scene_name, p.token_idx, coalesce(e.if_idx, p.parent_idx) AS parent_idx, CASE WHEN e.if_idx IS NOT NULL THEN CASE WHEN p.type = 'Else' THEN 'else' ELSE 'else_if' END WHEN p.parent_idx IS NULL THEN 'root' ELSE 'body' END AS slot, p.type AS kind
  FROM parents p LEFT JOIN pairs e USING (scene_name, token_idx) WHERE p.type NOT IN ('HideReuse', 'DisableReuse', 'AllowReuse', 'SelectableIf')),
tree AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY s.scene_name, s.parent_idx, s.slot ORDER BY s.token_idx) - 1 AS INTEGER) AS ordinal,
  CASE WHEN kind IN ('CreateVariable', 'CreateTempVariable', 'SetVariable', 'InputText') AND type_1 = 'Identifier' THEN text_1 END AS variable,
  CASE kind WHEN 'CreateVariable' THEN 'Global' WHEN 'CreateTempVariable' THEN 'Temporary' END AS scope,
  CASE WHEN kind IN ('GotoScene', 'GoSubScene') AND type_1 = 'Identifier' THEN text_1 END AS target_scene,
  CASE WHEN kind IN ('GotoScene', 'GoSubScene') AND type_1 = 'Identifier' AND type_2 = 'Identifier' THEN text_2 WHEN kind IN ('GotoLabel', 'GoSub', 'Label') AND type_1 = 'Identifier' THEN text_1 END AS target_label,
  CASE WHEN kind = 'PageBreak' THEN CASE WHEN type_1 = 'Prose' THEN text_1 END ELSE coalesce(raw_text, value_str, content) END AS text,
  o.reuse, o.selectable_idx FROM placed_statements s JOIN near n USING (scene_name, token_idx) LEFT JOIN (SELECT scene_name, token_idx, reuse, selectable_idx FROM options) o USING (scene_name, token_idx))"""


DEPTHS_SQL = """below AS (SELECT scene_name, token_idx, 0 AS depth FROM parents WHERE parent_idx IS NULL UNION ALL SELECT p.scene_name, p.token_idx, b.depth + 1 FROM below b JOIN parents p ON p.scene_name = b.scene_name AND p.parent_idx = b.token_idx),
depths AS (SELECT scene_name, token_idx, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY scene_name ORDER BY token_idx) AS number FROM below)"""
# Expressions, from the top down: a span of lexemes is split at its loosest operator, again and again. The levels are written out here.
EXPRESSION_SQL = f"""on_lines AS (SELECT *, max(CASE WHEN type IN ({_IN((*statements.STATEMENTS, *statements.INNER))}) THEN token_idx END) OVER (PARTITION BY scene_name, line_number ORDER BY token_idx) AS head FROM tokens WHERE type NOT IN ('Prose', 'SceneStart', 'SceneEnd')),
lexed_expr AS (SELECT l.scene_name, l.head, h.type AS of, l.token_idx - l.head - CASE WHEN h.type IN ('CreateVariable', 'CreateTempVariable', 'SetVariable') THEN 2 ELSE 1 END AS place, l.token_idx AS token, l.type,
  coalesce(l.raw_value, l.value_str, CAST(l.value_num AS VARCHAR), CAST(l.value_bool AS VARCHAR), CASE l.type WHEN 'OpenParenthesis' THEN '(' WHEN 'CloseParenthesis' THEN ')' ELSE l.type END) AS shown,
  CASE WHEN l.type IN ('LogicalAnd', 'LogicalOr') THEN 0 WHEN l.type IN ('EqualityOperator', 'NotEqualityOperator', 'GreaterThanOperator', 'GreaterThanEqualsOperator', 'LessThanOperator', 'LessThanEqualsOperator') THEN 1
       WHEN l.type IN ('SubtractionOperator', 'AdditionOperator', 'ConcatenationOperator') THEN 2 WHEN l.type IN ('DivisionOperator', 'MultiplicationOperator', 'ModulusOperator') THEN 3 END AS level
  FROM on_lines l JOIN tokens h ON l.scene_name = h.scene_name AND l.head = h.token_idx WHERE h.type IN ('CreateVariable', 'CreateTempVariable', 'SetVariable', 'If', 'ElseIf', 'SelectableIf')),
begun_expr AS (SELECT scene_name, head, of, max(place) AS last_place FROM lexed_expr GROUP BY ALL HAVING max(place) >= 0 OR of NOT IN ('CreateVariable', 'CreateTempVariable')),
due_expr AS (SELECT *, place = 0 OR coalesce(lag(type) OVER w NOT IN ('NumberLiteral', 'StringLiteral', 'BooleanLiteral', 'Identifier', 'CloseParenthesis'), true) AS due FROM lexed_expr WHERE place >= 0 WINDOW w AS (PARTITION BY scene_name, head ORDER BY place)),
role_expr AS (SELECT *, CASE WHEN due AND type IN ('NumberLiteral', 'StringLiteral', 'BooleanLiteral', 'Identifier') THEN 'operand' WHEN due AND type IN ('NotOperator', 'SubtractionOperator', 'AdditionOperator', 'FairmathAdditionOperator', 'FairmathSubtractionOperator') THEN 'prefix'
  WHEN due AND type = 'OpenParenthesis' THEN 'open' WHEN due THEN 'bad' WHEN type = 'CloseParenthesis' THEN 'close' WHEN level IS NOT NULL THEN 'binary' ELSE 'bad' END AS role FROM due_expr),
deep_expr AS (SELECT *, sum(CASE role WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY scene_name, head ORDER BY place) AS left_open FROM role_expr),
wrong_expr AS (SELECT scene_name, head, arg_min(CASE WHEN role = 'bad' AND due THEN 'Expect expression.' WHEN role = 'bad' AND left_open > 0 THEN 'Expect '')'' after expression.' ELSE 'Expected end of statement' END, place) AS message FROM deep_expr WHERE role = 'bad' OR left_open < 0 GROUP BY ALL),
failed_expr AS (SELECT b.*, coalesce(w.message, CASE WHEN last_place < 0 OR d.role IN ('binary', 'prefix', 'open') THEN 'Expect expression.' WHEN d.left_open > 0 THEN 'Expect '')'' after expression.' END) AS error
  FROM begun_expr b LEFT JOIN wrong_expr w USING (scene_name, head) LEFT JOIN deep_expr d ON b.scene_name = d.scene_name AND b.head = d.head AND b.last_place = d.place),
sound_expr AS (SELECT d.* FROM deep_expr d JOIN failed_expr f USING (scene_name, head) WHERE error IS NULL),
spans AS (SELECT scene_name, head, 0 AS low, last_place AS high, NULL::INTEGER AS parent, 'root' AS slot, '' AS path FROM failed_expr WHERE error IS NULL
  UNION ALL SELECT scene_name, head, child.low, child.high, token, child.slot, path || child.mark FROM (
    SELECT scene_name, head, token, path, unnest(CASE WHEN role = 'binary' THEN [{{'low': low, 'high': spot - 1, 'slot': 'left', 'mark': '0'}}, {{'low': spot + 1, 'high': high, 'slot': 'right', 'mark': '1'}}]
      WHEN role = 'prefix' THEN [{{'low': low + 1, 'high': high, 'slot': 'operand', 'mark': '0'}}] WHEN role = 'open' THEN [{{'low': low + 1, 'high': high - 1, 'slot': 'expression', 'mark': '0'}}] ELSE [] END) AS child
    FROM (SELECT s.scene_name, s.head, s.low, s.high, s.path, arg_min(struct_pack(token := x.token, role := x.role, spot := x.place), (CASE WHEN x.role = 'binary' THEN x.level ELSE 9 END, CASE WHEN x.role <> 'binary' OR x.level = 2 THEN x.place ELSE -x.place END)) AS node
      FROM spans s JOIN sound_expr x ON s.scene_name = x.scene_name AND s.head = x.head AND x.place BETWEEN s.low AND s.high JOIN sound_expr l ON s.scene_name = l.scene_name AND s.head = l.head AND l.place = s.low
      WHERE x.place = s.low OR (x.role = 'binary' AND x.left_open = l.left_open - CASE WHEN l.role = 'open' THEN 1 ELSE 0 END) GROUP BY ALL), LATERAL (SELECT node.token AS token, node.role AS role, node.spot AS spot))),
nodes AS (SELECT s.scene_name, s.head, s.parent, s.slot, s.path, arg_min(struct_pack(token := x.token, role := x.role, type := x.type, shown := x.shown), (CASE WHEN x.role = 'binary' THEN x.level ELSE 9 END, CASE WHEN x.role <> 'binary' OR x.level = 2 THEN x.place ELSE -x.place END)) AS node
  FROM spans s JOIN sound_expr x ON s.scene_name = x.scene_name AND s.head = x.head AND x.place BETWEEN s.low AND s.high JOIN sound_expr l ON s.scene_name = l.scene_name AND s.head = l.head AND l.place = s.low
  WHERE x.place = s.low OR (x.role = 'binary' AND x.left_open = l.left_open - CASE WHEN l.role = 'open' THEN 1 ELSE 0 END) GROUP BY ALL)"""
_TREE_OF_EXPRESSIONS = """SELECT scene_name, head AS token_idx, node.token AS node, parent, slot, CASE node.role WHEN 'binary' THEN 'Binary' WHEN 'prefix' THEN 'Unary' WHEN 'open' THEN 'Grouping' ELSE CASE node.type WHEN 'Identifier' THEN 'Identifier' ELSE 'Literal' END END AS kind,
  CASE WHEN node.role IN ('binary', 'prefix') THEN node.shown END AS operator, CASE WHEN node.role = 'operand' THEN node.shown END AS value FROM nodes"""
#: In postfix order a node comes after all below it, whose paths begin with its own.
_POSTFIX = """SELECT f.scene_name, f.head AS token_idx, f.of AS type, string_agg(CASE node.role WHEN 'prefix' THEN '~' || node.shown ELSE node.shown END, ' ' ORDER BY path || '2') FILTER (WHERE node.role <> 'open') AS postfix, any_value(error) AS error
FROM failed_expr f LEFT JOIN nodes n USING (scene_name, head) GROUP BY ALL"""


# What a parser complains of, written out: the statement, the text, and how many tokens further on it fails.
_NEXT = ", ".join(f"lead({c}, {k}) OVER w AS next_{c}_{k}" for k in (1, 2, 3) for c in ("token_idx", "type", "line_number", "position", "indent"))
ERRORS_SQL = f"""ahead AS (SELECT t.*, {_NEXT}, coalesce(lag(line_number) OVER w, 0) <> line_number OR token_idx = 1 AS new_line FROM tokens t WINDOW w AS (PARTITION BY scene_name ORDER BY token_idx)),
told AS (
  SELECT scene_name, token_idx, 'Unknown statement block starting ' || type || ' at ' || scene_name || ':' || line_number || ':' || position AS message, token_idx AS found_idx, type AS found_type, line_number AS found_line, position AS found_position, indent AS found_indent, 'U' AS form
    FROM ahead WHERE new_line AND type IN ('GotoRandomScene', 'FakeChoice', 'Finish', 'Ending', 'StatChart', 'LineBreak', 'Link', 'Image', 'InputNumber', 'Author', 'SaveCheckpoint', 'RestoreCheckpoint', 'DeleteVariable', 'GenerateRandom')
  UNION ALL SELECT scene_name, token_idx, CASE type WHEN 'GoSub' THEN 'Expect subroutine name.' WHEN 'GoSubScene' THEN 'Expect scene name.' WHEN 'GotoScene' THEN 'Expect scene name.' WHEN 'GotoLabel' THEN 'Expect label name.' WHEN 'Label' THEN 'Expect label name.'
    WHEN 'InputText' THEN 'Expect variable name to store input text.' ELSE 'Expect variable name' END, next_token_idx_1, next_type_1, next_line_number_1, next_position_1, next_indent_1, 'E'
    FROM ahead WHERE type IN ('CreateVariable', 'CreateTempVariable', 'SetVariable', 'GoSub', 'GoSubScene', 'GotoScene', 'GotoLabel', 'Label', 'InputText') AND NOT (next_type_1 = 'Identifier' AND next_line_number_1 = line_number)
  UNION ALL SELECT scene_name, token_idx, CASE type WHEN 'GotoScene' THEN 'Expect label name.' ELSE 'Expect subroutine label name.' END, next_token_idx_2, next_type_2, next_line_number_2, next_position_2, next_indent_2, 'E'
    FROM ahead WHERE type IN ('GotoScene', 'GoSubScene') AND next_type_1 = 'Identifier' AND next_line_number_1 = line_number AND next_line_number_2 = line_number AND next_type_2 <> 'Identifier'
  UNION ALL SELECT scene_name, token_idx, 'Expect button text after page break.', next_token_idx_1, next_type_1, next_line_number_1, next_position_1, next_indent_1, 'E' FROM ahead WHERE type = 'PageBreak' AND next_line_number_1 = line_number AND next_type_1 <> 'Prose'
  UNION ALL SELECT scene_name, token_idx, 'Expected end of statement, found ' || next_type_1, next_token_idx_1, next_type_1, next_line_number_1, next_position_1, next_indent_1, 'L' FROM ahead WHERE type = 'Return' AND next_line_number_1 = line_number
  UNION ALL SELECT scene_name, token_idx, 'Expected end of statement, found ' || next_type_2, next_token_idx_2, next_type_2, next_line_number_2, next_position_2, next_indent_2, 'L' FROM ahead WHERE type IN ('GotoLabel', 'GoSub', 'InputText') AND next_type_1 = 'Identifier' AND next_line_number_1 = line_number AND next_line_number_2 = line_number
  UNION ALL SELECT scene_name, token_idx, 'Expected end of statement, found ' || next_type_3, next_token_idx_3, next_type_3, next_line_number_3, next_position_3, next_indent_3, 'L' FROM ahead WHERE type IN ('GotoScene', 'GoSubScene') AND next_type_1 = 'Identifier' AND next_type_2 = 'Identifier' AND next_line_number_1 = line_number AND next_line_number_2 = line_number AND next_line_number_3 = line_number
  UNION ALL SELECT p.scene_name, p.token_idx, CASE WHEN p.type = 'Prose' THEN 'Prose is not allowed directly inside Choice statements. Did you mean to put it inside a ChoiceOption?' ELSE 'Expected ChoiceOption token after modifiers' END, p.token_idx, p.type, p.line_number, a.position, p.indent, 'E'
    FROM parents p JOIN parents c ON p.scene_name = c.scene_name AND p.parent_idx = c.token_idx JOIN ahead a ON p.scene_name = a.scene_name AND p.token_idx = a.token_idx
    WHERE c.type = 'Choice' AND p.type NOT IN ('Comment', 'If', 'ElseIf', 'Else', 'ChoiceOption', 'HideReuse', 'DisableReuse', 'AllowReuse', 'SelectableIf')
  UNION ALL SELECT scene_name, token_idx, 'Expected ChoiceOption token after modifiers', token_idx, type, line_number, position, indent, 'E' FROM (SELECT a.scene_name, a.token_idx, any_value(a.type) AS type, any_value(a.line_number) AS line_number, any_value(t.position) AS position, any_value(a.indent) AS indent, arg_min(b.type, b.token_idx) AS next_type
    FROM parents a JOIN ahead t ON a.scene_name = t.scene_name AND a.token_idx = t.token_idx LEFT JOIN parents b ON a.scene_name = b.scene_name AND a.line_number = b.line_number AND b.token_idx > a.token_idx AND b.type NOT IN ('HideReuse', 'DisableReuse', 'AllowReuse', 'SelectableIf')
    WHERE a.type IN ('HideReuse', 'DisableReuse', 'AllowReuse', 'SelectableIf') GROUP BY a.scene_name, a.token_idx) WHERE coalesce(next_type, '') NOT IN ('ChoiceOption', 'If')
  UNION ALL SELECT p.scene_name, p.token_idx, 'Unknown statement block starting ' || p.type, p.token_idx, p.type, p.line_number, a.position, a.indent, 'U' FROM pairs p0 JOIN parents p ON p0.scene_name = p.scene_name AND p0.token_idx = p.token_idx JOIN ahead a ON p.scene_name = a.scene_name AND p.token_idx = a.token_idx WHERE if_idx IS NULL
  UNION ALL SELECT f.scene_name, f.head, f.error, coalesce(w.token, a.token_idx), coalesce(b.type, a.type), coalesce(b.line_number, a.line_number), coalesce(b.position, a.position), coalesce(b.indent, a.indent), 'X'
    FROM failed_expr f JOIN ahead h ON f.scene_name = h.scene_name AND f.head = h.token_idx LEFT JOIN (SELECT scene_name, head, arg_min(token, place) AS token FROM deep_expr WHERE role = 'bad' OR left_open < 0 GROUP BY ALL) w ON f.scene_name = w.scene_name AND f.head = w.head LEFT JOIN ahead b ON w.scene_name = b.scene_name AND w.token = b.token_idx
    LEFT JOIN (SELECT scene_name, head, max(token) AS token FROM deep_expr GROUP BY ALL) e ON f.scene_name = e.scene_name AND f.head = e.head LEFT JOIN ahead a ON f.scene_name = a.scene_name AND a.token_idx = coalesce(e.token, f.head + CASE WHEN f.of IN ('CreateVariable', 'CreateTempVariable', 'SetVariable') THEN 1 ELSE 0 END) + 1
    WHERE error IS NOT NULL AND (f.of IN ('If', 'ElseIf', 'SelectableIf') OR (h.next_type_1 = 'Identifier' AND h.next_line_number_1 = h.line_number))),
reported AS (SELECT scene_name, token_idx, message, found_idx, form, CASE WHEN form = 'U' THEN 'Unknown statement block starting ' || found_type || ' at ' || place ELSE 'Error: ' || message || CASE WHEN form = 'L' THEN ' instead at ' || found_line || ':' || found_position ELSE '' END
    || CASE WHEN found_type = 'SceneEnd' THEN ' at end of scene ' ELSE ' at ''' || found_type || ''' ' END || place END AS report
  FROM (SELECT *, scene_name || ':' || found_line || ':' || found_position || '[' || CASE WHEN found_indent = floor(found_indent) THEN CAST(CAST(found_indent AS BIGINT) AS VARCHAR) ELSE CAST(found_indent AS VARCHAR) END || ']' AS place FROM told))"""


def _with(*parts: str, of: str = SCRIPT_SQL) -> str:
    return "WITH RECURSIVE " + ",\n".join((of, LINES_SQL, *parts))


SEGMENTED, TOKENISED = (_segments_sql(),), (_segments_sql(), _lexemes_sql(), PROSE_SQL, TOKENS_SQL)
# Intended: every CRLF is a line end, tabs double no text, and the last block needs no command after it.
INTENDED_SQL = "WITH " + ",\n".join((
    SCRIPT_SQL,
    "once AS (SELECT scene_name, replace(content, chr(13) || chr(10), chr(10)) AS content FROM scenes),\n" + LINES_SQL.split("\n", 1)[1],
    _segments_sql("intended"),
    _lexemes_sql("intended"),
    PROSE_SQL.replace("CASE WHEN tabs = 0 THEN line", "CASE WHEN true THEN line"),
    TOKENS_SQL.replace("SELECT scene_name, flush_line, segment, 0, 0, 'Prose'", "SELECT scene_name, coalesce(flush_line, 2147483647), coalesce(segment, 0), 0, 0, 'Prose'").replace(" FROM prose WHERE flush_line IS NOT NULL", " FROM prose"),
))

# ---- queries -------------------------------------------------------------------------------------------------


def _lines(spark, d):
    return scanner.lines(script_scenes(spark, d))


def _segments(spark, d):
    return scanner.segments(_lines(spark, d))


def _tokens(spark, d):
    return scanner.scan(script_scenes(spark, d))


def segment_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments of prose, of commands and of options the documents of each language have."""
    docs = document_scenes(spark, sf_dir)
    pieces = F.explode(F.regexp_extract_all("line", F.lit(SEGMENT), F.lit(0)))
    found = docs.select("lang", F.explode(F.split("content", "\n", -1)).alias("line")).select("lang", F.regexp_replace("line", r"^[\t ]+", "").alias("line"))
    head = F.when(F.substring("text", 1, 1).isin("*", "#"), F.substring("text", 1, 1)).otherwise("prose")
    found = found.select("lang", pieces.alias("text")).withColumn("head", head)
    return found.groupBy("lang", "head").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("text")).alias("n_chars"))


def scene_list_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions and nations as a startup scene's list."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("  "), x["n_name"], F.lit(" \n"))), "")
    startup = nation.groupBy(F.concat(F.lit("startup_"), F.col("n_regionkey").cast("string")).alias("scene_name")).agg(F.concat(F.lit("*title T\n*scene_list\n"), names, F.lit("*create x 1\n  tail")).alias("content"))
    return sources.scene_list(startup)


def missing_scene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_scenes(spark, sf_dir)
    replaced = docs.withColumn("content", F.when(F.length("content") % 7 == 0, F.lit(sources.MISSING_SCENE)).otherwise(F.col("content")))
    return sources.without_missing(replaced).groupBy("lang").agg(F.count(F.lit(1)).alias("n_scenes"))


def control_flow_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = script_scenes(spark, sf_dir)
    marked = scenes.withColumn("content", F.when(F.length("content") % 5 == 0, F.concat(F.lit("*create implicit_control_flow true\n"), F.col("content"))).otherwise(F.col("content")))
    return sources.implicit_control_flow(marked)


def token_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all scripts, written as one pretty-printed array in a folder of files, and read back."""
    folder = shared_folder(spark, "token-json")
    token_json.write_pretty(_tokens(spark, sf_dir), folder, "gzip")
    found = token_json.read_pretty(spark, folder)
    delete_folder(spark, folder)
    return found.select(*STRUCTURE, *scanner.VALUES)


ROOT = "src/index.ts"
#: The text of a customer's module: <a> to <c> are the numbers of those it exports from, <n> its own, <m> that modulo 1000. ^ stands for a line's end.
MODULE_TEXT = [
    ("c_custkey % 7 = 0", "export * from '<up>m<a>'; export  *  from \"<up>m<b>\"^interface T<m>Token extends Token { value: { type: 'inner', more: { type: 'x' } }; }"),
    ("c_custkey % 2 = 0", "import x from '<up>m1'^export * from '<up>m<a>'^export * from '<up>m<b>'^export * from '<up>m<c>'^export * from '<up>gone'^export interface T<m>Token extends Token {^  value: { type: 'inner'; };^  type: 'T<n>';^}"),
]
MODULE_OTHERWISE = "export * from '<up>m<b>';export * from '<up>m<a>'^interface OtherToken extends Node { type: 'no' }^interface T<m>Token extends Token { type: \"T<n>\"; kind: 'k' }"
_MODULE_PATH = "CASE WHEN c_custkey = 1 THEN 'src/index.ts' WHEN c_custkey % 5 = 0 THEN concat('src/m', c_custkey, '.ts') WHEN c_custkey % 11 = 0 THEN concat('src/m', c_custkey, '-token.ts') ELSE concat('src/m', c_custkey, '/index.ts') END"
_MODULE_CONTENT = "CASE " + " ".join(f"WHEN {when} THEN {_text(x)}" for when, x in MODULE_TEXT) + f" ELSE {_text(MODULE_OTHERWISE)} END"
_MODULE_MARKS = {"<a>": "2 * c_custkey", "<b>": "2 * c_custkey + 1", "<c>": "CAST(floor(c_custkey / 2) AS BIGINT)", "<n>": "c_custkey", "<m>": "c_custkey % 1000"}


def _module_sql(new_line: str, string: str) -> str:
    text = f"replace({_MODULE_CONTENT}, '<up>', CASE WHEN c_custkey = 1 OR c_custkey % 5 = 0 OR c_custkey % 11 = 0 THEN './' ELSE '../' END)"
    for mark, value in _MODULE_MARKS.items():
        text = f"replace({text}, '{mark}', CAST({value} AS {string}))"
    return f"SELECT {_MODULE_PATH} AS path, replace({text}, '^', {new_line}) AS content"


def module_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source text for each customer, that exports from others and declares types."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sql = _module_sql("'\\n'", "STRING").removeprefix("SELECT ")
    path, content = sql.split(" AS path, ")
    return customers.select(F.expr(path).alias("path"), F.expr(content.removesuffix(" AS content")).alias("content"))


MODULE_SQL = f"""sources AS ({_module_sql("chr(10)", "VARCHAR")} FROM customer),
exported AS (SELECT path, unnest(regexp_extract_all(content, 'export\\s*\\*\\s*from\\s*[''"]([^''"]+)', 1)) AS module FROM sources WHERE path LIKE '%index.ts'),
aimed AS (SELECT path, CASE WHEN starts_with(module, '../') THEN 'src/' || substring(module, 4) ELSE regexp_replace(path, '[^/]*$', '') || regexp_replace(module, '^[.]/', '') END AS target FROM exported),
led AS (SELECT DISTINCT a.path, coalesce(f.path, i.path) AS next FROM aimed a LEFT JOIN sources f ON f.path = a.target || '.ts' LEFT JOIN sources i ON i.path = a.target || '/index.ts' WHERE coalesce(f.path, i.path) IS NOT NULL),
distance AS (SELECT '{ROOT}' AS path, 0 AS depth UNION SELECT l.next, r.depth + 1 FROM distance r JOIN led l ON l.path = r.path WHERE r.depth < 40),
reach AS (SELECT path, min(depth) AS depth FROM distance GROUP BY path)"""
DECLARED_SQL = """SELECT name, arg_min(struct_pack(t := type), path).t AS type FROM (SELECT path, regexp_extract(content, 'interface (T[0-9]+Token) extends Token', 1) AS name, nullif(regexp_extract(regexp_replace(regexp_replace(content, '\\{[^{}]*more[^{}]*\\{[^{}]*\\}[^{}]*\\}', '', 'g'), 'value: \\{[^{}]*\\}', '', 'g'), 'Token extends Token \\{[^}]*type: [''"]([^''"]*)', 1), '') AS type FROM sources) WHERE name <> '' GROUP BY name"""


def _columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


STRUCTURE = ("scene_name", "token_idx", "type", "line_number", "position", "indent")
CATALOG: dict[str, tuple[Query, str | None]] = {
    "segment_counts_by_lang": (
        segment_counts_by_lang,
        f"""WITH line AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
cut AS (SELECT lang, unnest(regexp_extract_all(regexp_replace(line, '^[\\t ]+', ''), {_text(SEGMENT)})) AS text FROM line)
SELECT lang, CASE WHEN text[1] IN ('*', '#') THEN text[1] ELSE 'prose' END AS head, count(*) AS n_segments, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM cut GROUP BY ALL""",
    ),
    "scene_list_extract": (
        scene_list_extract,
        """WITH startup AS (SELECT 'startup_' || CAST(n_regionkey AS VARCHAR) AS scene_name, '*title T' || chr(10) || '*scene_list' || chr(10) || string_agg('  ' || n_name || ' ' || chr(10), '' ORDER BY n_nationkey) || '*create x 1' || chr(10) || '  tail' AS content FROM nation GROUP BY n_regionkey),
begun AS (SELECT scene_name, substring(content, strpos(content, '*scene_list') + 11) AS rest FROM startup),
listed AS (SELECT scene_name, list_filter(list_transform(string_split(substring(rest, 1, strpos(rest, '*') - 1), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS every FROM begun)
SELECT scene_name, unnest(every) AS listed, CAST(unnest(range(len(every))) AS INTEGER) AS place FROM listed""",
    ),
    "missing_scene_filter": (missing_scene_filter, "SELECT lang, count(*) AS n_scenes FROM documents WHERE length(text) % 7 <> 0 GROUP BY lang"),
    "control_flow_probe": (control_flow_probe, f"WITH {SCRIPT_SQL} SELECT scene_name, length(content) % 5 = 0 AS implicit_control_flow FROM scenes"),
    "scene_lines": (lambda s, d: _lines(s, d).select("scene_name", "line_number", "line", "n_lines", "start"), f"{_with()} SELECT scene_name, CAST(line_number AS INTEGER) AS line_number, line, CAST(n_lines AS INTEGER) AS n_lines, CAST(start AS INTEGER) AS start FROM lines"),
    "indent_by_line": (lambda s, d: _lines(s, d).groupBy("indent", "tabs", "spaces").agg(F.count(F.lit(1)).alias("n")), f"{_with()} SELECT indent, CAST(tabs AS INTEGER) AS tabs, CAST(spaces AS INTEGER) AS spaces, count(*) AS n FROM lines GROUP BY ALL"),
    "command_positions": (lambda s, d: _segments(s, d).filter("command").select("scene_name", "line_number", "segment", "position", "keyword", "text"), f"{_with(*SEGMENTED)} SELECT scene_name, CAST(line_number AS INTEGER) AS line_number, CAST(segment AS INTEGER) AS segment, CAST(position AS INTEGER) AS position, keyword, text FROM segments WHERE command"),
    "unknown_commands": (lambda s, d: _segments(s, d).filter("command and type is null").groupBy("text").agg(F.count(F.lit(1)).alias("n")), f"{_with(*SEGMENTED)} SELECT text, count(*) AS n FROM segments WHERE command AND type IS NULL GROUP BY text"),
    "keyword_histogram": (lambda s, d: _segments(s, d).filter("type is not null").groupBy("type", "mode").agg(F.count(F.lit(1)).alias("n")), f"{_with(*SEGMENTED)} SELECT type, mode, count(*) AS n FROM segments WHERE type IS NOT NULL GROUP BY ALL"),
    "prose_blocks_of_documents": (lambda s, d: scanner.scan(document_scenes(s, d)).filter("type = 'Prose'").select("scene_name", "token_idx", "line_number", "position", "indent", "content"), f"{_with(*TOKENISED, of=DOCUMENT_SQL)} SELECT scene_name, token_idx, line_number, position, indent, content FROM tokens WHERE type = 'Prose'"),
    "prose_dropped_tail": (lambda s, d: scanner.prose_tails(script_scenes(s, d)), f"{_with(_segments_sql(), PROSE_SQL)} SELECT scene_name, content FROM prose WHERE flush_line IS NULL"),
    "tokens_per_scene": (lambda s, d: _tokens(s, d).groupBy("scene_name").agg(F.count(F.lit(1)).alias("n_tokens")), f"{_with(*TOKENISED)} SELECT scene_name, count(*) AS n_tokens FROM tokens GROUP BY scene_name"),
    "module_reach": (lambda s, d: token_types.reachable_files(module_sources(s, d), ROOT), f"WITH RECURSIVE {MODULE_SQL} SELECT path, min(depth) AS depth FROM reach GROUP BY path"),
    "declared_types": (lambda s, d: token_types.declared_types(module_sources(s, d)), f"WITH RECURSIVE {MODULE_SQL} {DECLARED_SQL}"),
    "reached_types": (lambda s, d: token_types.declared_types(module_sources(s, d).join(token_types.reachable_files(module_sources(s, d), ROOT), "path").drop("depth")), f"WITH RECURSIVE {MODULE_SQL} {DECLARED_SQL.replace('FROM sources', 'FROM sources WHERE path IN (SELECT path FROM reach)')}"),
    "expr_tree": (lambda s, d: statements.expression_tree(_tokens(s, d)), f"{_with(*TOKENISED, EXPRESSION_SQL)} {_TREE_OF_EXPRESSIONS}"),
    "expr_postfix": (lambda s, d: statements.expressions(_tokens(s, d)), f"{_with(*TOKENISED, EXPRESSION_SQL)} {_POSTFIX}"),
    "statements_observed": (lambda s, d: statements.parsed(_tokens(s, d), "observed").withColumns({c: F.array_join(c, ",") for c in ("kept", "lost")}), None),
    "comment_blocks": (
        lambda s, d: statements.comment_blocks(_tokens(s, d)),
        f"""{_with(*TOKENISED)}, marked AS (SELECT *, CASE WHEN type = 'Comment' AND NOT coalesce(lag(type) OVER w = 'Comment' AND lag(indent) OVER w = indent, false) THEN 1 ELSE 0 END AS begins FROM tokens WINDOW w AS (PARTITION BY scene_name ORDER BY token_idx)),
numbered_blocks AS (SELECT *, sum(begins) OVER (PARTITION BY scene_name ORDER BY token_idx) AS block FROM marked)
SELECT scene_name, min(token_idx) AS first_token, count(*) AS n_comments, string_agg(coalesce(value_str, ''), chr(10) ORDER BY token_idx) AS text FROM numbered_blocks WHERE type = 'Comment' GROUP BY scene_name, block""",
    ),
}


def _add_token_queries() -> None:
    """Queries that are a filter and a choice of columns of the token table."""
    plain = {
        "tokens_all": (None, [*STRUCTURE, *scanner.VALUES]),
        "command_tokens": (f"type IN ({_IN(t for t, _ in KEYWORDS.values())})", STRUCTURE),
        "structural_tokens": ("type IN ('SceneStart', 'SceneEnd')", STRUCTURE),
        "choice_options": ("type = 'ChoiceOption'", [*STRUCTURE, "raw_text"]),
        "multireplace_flag": ("has_multi_replace", ["scene_name", "token_idx", "raw_text"]),
        "comments": ("type = 'Comment'", [*STRUCTURE, "value_str"]),
        "prose_blocks": ("type = 'Prose'", [*STRUCTURE, "content"]),
        "expr_tokens": ("raw_value IS NOT NULL OR value_str IS NOT NULL OR value_num IS NOT NULL OR type LIKE '%Parenthesis'", [*STRUCTURE, "value_str", "value_num", "value_bool", "raw_value"]),
        "number_literals": ("type = 'NumberLiteral'", ["scene_name", "token_idx", "value_num"]),
        "string_literals": ("type = 'StringLiteral'", ["scene_name", "token_idx", "value_str"]),
        "identifiers": ("type = 'Identifier'", ["scene_name", "token_idx", "value_str"]),
        "boolean_literals": ("type = 'BooleanLiteral'", ["scene_name", "token_idx", "value_bool"]),
        "fairmath_tokens": ("type = 'FairmathAdditionOperator'", [*STRUCTURE, "raw_value"]),
    }
    for name, (where, columns) in plain.items():
        CATALOG[name] = ((lambda s, d, w=where, c=tuple(columns): _columns(_tokens(s, d).filter(w) if w else _tokens(s, d), *c)), f"{_with(*TOKENISED)} SELECT {', '.join(columns)} FROM tokens" + (f" WHERE {where}" if where else ""))
    every = [*STRUCTURE, *scanner.VALUES]
    CATALOG["tokens_intended"] = (lambda s, d: scanner.scan(script_scenes(s, d), "intended").select(*every), f"{INTENDED_SQL} SELECT {', '.join(every)} FROM tokens")
    one = lambda s, d: scanner.scan_large(script_rows(s, d), block_lines=ONE_SCENE_BLOCK)
    CATALOG["tokens_of_one_scene"] = (lambda s, d: one(s, d).select(*every), f"{_with(*TOKENISED, of=ONE_SCENE_SQL)} SELECT {', '.join(every)} FROM tokens")
    CATALOG["parents_of_one_scene"] = (lambda s, d: statements.parents_in_blocks(one(s, d), ONE_SCENE_BLOCK), f"{_with(*TOKENISED, PARENTS_SQL, of=ONE_SCENE_SQL)} SELECT * FROM parents")
    CATALOG["token_json_round_trip"] = (lambda s, d: token_json.tokens_of(token_json.nested_by_scene(_tokens(s, d)).select(F.from_json("tokens", "array<string>").alias("scene"))).select(*every), f"{_with(*TOKENISED)} SELECT {', '.join(every)} FROM tokens")
    CATALOG["token_json_file"] = (token_json_file, f"{_with(*TOKENISED)} SELECT {', '.join(every)} FROM tokens")
    CATALOG["operator_histogram"] = (lambda s, d: _tokens(s, d).filter("raw_value is not null").groupBy("type", "raw_value").agg(F.count(F.lit(1)).alias("n")), f"{_with(*TOKENISED)} SELECT type, raw_value, count(*) AS n FROM tokens WHERE raw_value IS NOT NULL GROUP BY ALL")
    near = {
        "same_line_flags": (lambda t: statements.with_neighbours(t).groupBy("type", "same_line").agg(F.count(F.lit(1)).alias("n")), "SELECT type, same_line, count(*) AS n FROM near GROUP BY ALL"),
        "indent_change_flags": (lambda t: statements.with_neighbours(t).filter(~F.col("same_indent")).select("scene_name", "token_idx", "indent"), "SELECT scene_name, token_idx, indent FROM near WHERE NOT same_indent"),
        "scope_flags": (statements.scope_flags, f"SELECT scene_name, token_idx, type, next_indent > indent AS child_scope, next_indent >= indent AS sibling_scope FROM (SELECT *, lead(indent) OVER w AS next_indent, lag(type) OVER w AS last_type, lag(line_number) OVER w AS last_line FROM tokens WINDOW w AS (PARTITION BY scene_name ORDER BY token_idx)) WHERE type IN ({_IN((*statements.STATEMENTS, *statements.INNER))}) AND NOT (type = 'Prose' AND coalesce(last_type = 'PageBreak' AND last_line = line_number, false))"),
        "declared_variables": (statements.declared_variables, "SELECT scene_name, token_idx, text_1 AS variable, CASE WHEN type = 'CreateTempVariable' THEN 'Temporary' ELSE 'Global' END AS scope, type_2 IS NOT NULL AS has_expression FROM near WHERE type IN ('CreateVariable', 'CreateTempVariable') AND type_1 = 'Identifier'"),
        "set_variables": (statements.set_variables, "SELECT scene_name, token_idx, text_1 AS variable, type_2 AS expression_starts FROM near WHERE type = 'SetVariable' AND type_1 = 'Identifier'"),
        "goto_edges": (statements.goto_edges, "SELECT scene_name, token_idx, CASE WHEN type = 'GotoScene' THEN text_1 END AS target_scene, CASE WHEN type = 'GotoLabel' THEN text_1 WHEN type_2 = 'Identifier' THEN text_2 END AS target_label FROM near WHERE type IN ('GotoScene', 'GotoLabel') AND type_1 = 'Identifier'"),
        "gosub_edges": (statements.gosub_edges, "SELECT scene_name, token_idx, CASE WHEN type = 'GoSubScene' THEN text_1 END AS target_scene, CASE WHEN type = 'GoSub' THEN text_1 WHEN type_2 = 'Identifier' THEN text_2 END AS target_label FROM near WHERE type IN ('GoSubScene', 'GoSub') AND type_1 = 'Identifier'"),
        "labels": (statements.labels, "SELECT scene_name, token_idx, text_1 AS label FROM near WHERE type = 'Label' AND type_1 = 'Identifier'"),
        "input_vars": (statements.input_variables, "SELECT scene_name, token_idx, text_1 AS variable FROM near WHERE type = 'InputText' AND type_1 = 'Identifier'"),
        "page_breaks": (statements.page_breaks, "SELECT scene_name, token_idx, CASE WHEN type_1 = 'Prose' THEN text_1 END AS button_text FROM near WHERE type = 'PageBreak'"),
        "prose_to_eol": (lambda t: statements.with_neighbours(t).filter("type in ('PageBreak', 'Finish', 'Ending') and type_1 = 'Prose'").select("scene_name", "type", F.col("text_1").alias("text")), "SELECT scene_name, type, text_1 AS text FROM near WHERE type IN ('PageBreak', 'Finish', 'Ending') AND type_1 = 'Prose'"),
        "unparseable_statements": (lambda t: statements.unparseable(t).groupBy("scene_name", "type").agg(F.count(F.lit(1)).alias("n")), f"SELECT scene_name, type, count(*) AS n FROM near WHERE (NOT same_line OR token_idx = 1) AND type NOT IN ({_IN((*statements.STATEMENTS, *statements.INNER, 'SceneStart', 'SceneEnd'))}) GROUP BY ALL"),
    }
    for name, (of, tail) in near.items():
        CATALOG[name] = ((lambda s, d, f=of: f(_tokens(s, d))), f"{_with(*TOKENISED, NEAR_SQL)} {tail}")
    scoped = {
        "statement_parent": (statements.parents, "SELECT * FROM parents"),
        "else_pairing": (lambda t: statements.else_pairing(statements.parents(t)), "SELECT * FROM pairs"),
        "choice_options_full": (statements.choice_options, "SELECT * FROM options"),
        "structural_errors": (statements.structural_errors, "SELECT scene_name, token_idx, message FROM reported WHERE form <> 'X'"),
        "parse_errors": (statements.parse_errors, "SELECT scene_name, token_idx, message FROM reported"),
        "parse_outcome": (statements.parse_outcome, "SELECT scene_name, any_value(e.report) IS NULL AS parsed, count(*) FILTER (WHERE b.token_idx IS NOT NULL AND (e.found IS NULL OR b.token_idx < e.token_idx)) AS n_statements, any_value(e.report) AS error FROM (SELECT DISTINCT scene_name FROM tokens) s LEFT JOIN parents b USING (scene_name) LEFT JOIN (SELECT scene_name, min((found_idx, token_idx)) AS found, arg_min(token_idx, (found_idx, token_idx, report)) AS token_idx, arg_min(report, (found_idx, token_idx, report)) AS report FROM reported GROUP BY scene_name) e USING (scene_name) GROUP BY scene_name"),
        "statement_tree": (statements.tree, "SELECT scene_name, token_idx, parent_idx, slot, ordinal, kind, variable, scope, target_scene, target_label, reuse, selectable_idx, text FROM tree"),
        "statement_blocks": (lambda t: statements.tree_of_blocks(t).withColumn("tokens", F.array_join("tokens", ",")), "SELECT scene_name, CAST(min(token_idx) AS INTEGER) AS token_idx, parent_idx, slot, CAST(block - 1 AS INTEGER) AS ordinal, any_value(kind) AS kind, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(token_idx, ',' ORDER BY token_idx) AS tokens, string_agg(coalesce(text, ''), chr(10) ORDER BY token_idx) AS text FROM (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY scene_name, parent_idx, slot ORDER BY token_idx) AS block FROM (SELECT t.*, coalesce(kind IN ('Comment', 'Prose') AND lag(kind) OVER w = kind AND lag(t.token_idx) OVER w = t.token_idx - 1 AND lag(n.indent) OVER w = n.indent, false) AS joins FROM tree t JOIN tokens n USING (scene_name, token_idx) WINDOW w AS (PARTITION BY t.scene_name, t.parent_idx, t.slot ORDER BY t.token_idx))) GROUP BY scene_name, parent_idx, slot, block"),
        "statement_spans": (statements.spans, "SELECT a.scene_name, a.token_idx, CAST(coalesce(min(b.token_idx), any_value(e.scene_end)) - 1 AS INTEGER) AS last_token, any_value(a.depth) AS depth, CAST(coalesce(min(b.number), any_value(e.n) + 1) - any_value(a.number) AS INTEGER) AS size FROM depths a LEFT JOIN depths b ON a.scene_name = b.scene_name AND b.token_idx > a.token_idx AND b.depth <= a.depth JOIN (SELECT scene_name, max(token_idx) AS scene_end, any_value(n) AS n FROM tokens JOIN (SELECT scene_name, count(*) AS n FROM parents GROUP BY scene_name) USING (scene_name) GROUP BY scene_name) e ON a.scene_name = e.scene_name GROUP BY a.scene_name, a.token_idx"),
        "choice_children": (statements.choice_children, "SELECT a.scene_name, a.token_idx, a.type, a.parent_idx AS choice_idx FROM parents a JOIN parents c ON a.scene_name = c.scene_name AND a.parent_idx = c.token_idx WHERE c.type = 'Choice'"),
    }
    for name, (of, tail) in scoped.items():
        CATALOG[name] = ((lambda s, d, f=of: f(_tokens(s, d))), f"{_with(*TOKENISED, NEAR_SQL, PARENTS_SQL, PAIRS_SQL, OPTIONS_SQL, TREE_SQL, EXPRESSION_SQL, ERRORS_SQL, DEPTHS_SQL)} {tail}")


_add_token_queries()


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
