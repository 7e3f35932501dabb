"""The scanner: scenes to tokens, with DataFrame functions only.

Everything but prose is a function of one line. A line, without its indentation, is cut into segments by one
regular expression that tiles it; a segment is a command with what belongs to it, or prose. Segments are cut into
atoms: a keyword, a lexeme, a stretch of text, a line's end. Positions are running sums of their lengths. Prose
runs on over lines until the next command: blocks are islands between commands, numbered by a running count. So the
scenes are read once, and the only shuffle is that of atoms by scene, for those sums and the tokens' numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.script import BARE, CLOSED, WORDS, is_blank, language, lookup
from ..sources.kept import kept

#: Segments of a line that are summed up at a time.
STEP = 256
#: Lines of a scene that one task takes, where a scene is spread over tasks.
BLOCK_LINES = 4096

TOKEN = T.StructType([
    T.StructField("scene_name", T.StringType()),
    T.StructField("token_idx", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("indent", T.DoubleType()),
    T.StructField("content", T.StringType()),
    T.StructField("value_str", T.StringType()),
    T.StructField("value_num", T.DoubleType()),
    T.StructField("value_bool", T.BooleanType()),
    T.StructField("raw_value", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("has_multi_replace", T.BooleanType()),
])
VALUES = TOKEN.fieldNames()[6:]
_ARRAY = T.ArrayType(T.StructType([f for f in TOKEN if f.name not in ("scene_name", "token_idx")]))


def lines(scenes: DataFrame, semantics: str = "observed") -> DataFrame:
    """Rows (scene_name, line_number, line, n_lines, tabs, spaces, indent, start).

    Observed, only the first CRLF of a scene is a line end of one character; intended, all are.
    """
    first = F.locate("\r\n", F.col("content"))
    once = F.when(first > 0, F.expr("concat(substring(content, 1, locate('\\r\\n', content) - 1), '\\n', substring(content, locate('\\r\\n', content) + 2))")).otherwise(F.col("content"))
    content = once if semantics == "observed" else F.regexp_replace("content", "\r\n", "\n")
    split = scenes.select("scene_name", F.split(content, "\n", -1).alias("all"))
    return indented(split.select("scene_name", F.size("all").alias("n_lines"), F.posexplode("all").alias("line_number", "line")))


def lines_of_rows(rows: DataFrame, semantics: str = "observed") -> DataFrame:
    """The rows of lines() from rows (scene_name, line_number, line), for scenes too large to be one text.

    Numbers run from 0 without gaps. A line that ends in a carriage return, but for a scene's last, had a CRLF as its end.
    """
    ends = F.col("line").endswith("\r")
    of_scene = rows.groupBy("scene_name").agg((F.max("line_number") + 1).cast("int").alias("n_lines"), F.min(F.when(ends, F.col("line_number"))).alias("first"))
    found = rows.join(of_scene, "scene_name")
    loses = ends & (F.col("line_number") < F.col("n_lines") - 1)
    if semantics == "observed":
        loses = loses & (F.col("line_number") == F.col("first"))
    line = F.when(loses, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    return indented(found.select("scene_name", "n_lines", F.col("line_number").cast("int").alias("line_number"), line.alias("line")))


def indented(found: DataFrame) -> DataFrame:
    """Rows (scene_name, n_lines, line_number, line) with what their indentation says."""
    found = found.withColumn("lead", F.regexp_extract("line", "^[\t ]*", 0))
    found = found.withColumns({"start": F.length("lead"), "spaces": F.length(F.replace("lead", F.lit("\t"), F.lit("")))})
    found = found.withColumn("tabs", F.col("start") - F.col("spaces"))
    return found.select("scene_name", "line_number", "line", "n_lines", "tabs", "spaces", (F.col("tabs") + F.col("spaces") * 0.5).alias("indent"), "start")


def cut(found: DataFrame, semantics: str = "observed", ends: bool = False) -> DataFrame:
    """From lines, a row for each segment: its number, text, command, keyword, type, mode and after (what follows the keyword).

    With ends, each line has one more segment, a line feed, which no line holds.
    """
    own = language(semantics)
    pieces = F.regexp_extract_all(F.expr("substring(line, start + 1)"), F.lit(own.segment), F.lit(0))
    placed = found.select("*", F.posexplode(F.concat(pieces, F.array(F.lit("\n"))) if ends else pieces).alias("segment", "text"))
    placed = placed.withColumn("command", F.substring("text", 1, 1).isin("*", "#"))
    placed = placed.withColumn("keyword", F.when(F.col("command"), F.nullif(F.regexp_extract("text", own.keyword, 0), F.lit(""))))
    return placed.withColumns({
        "type": F.when(F.col("command"), lookup({k: t for k, (t, _) in own.keywords.items()}, F.col("keyword"))),
        "mode": F.when(F.col("command"), lookup({k: m for k, (_, m) in own.keywords.items()}, F.col("keyword"))),
        "after": F.expr("substring(text, length(keyword) + 1)"),
    })


def segments(found: DataFrame, semantics: str = "observed") -> DataFrame:
    """From lines, rows with segment (its number), position, text, command, keyword, type, mode and after (what follows the keyword).

    A row follows from its line alone, so this goes for streams too. Each segment is counted once.
    """
    pieces = F.regexp_extract_all(F.expr("substring(line, start + 1)"), F.lit(language(semantics).segment), F.lit(0))
    # A running sum of lengths within a row: of STEP segments at a time, and of those sums, as each step copies what is summed up so far.
    lengths = F.transform(pieces, F.length)
    running = lambda begin, values: F.aggregate(values, F.array(begin), lambda got, x: F.array_append(got, F.element_at(got, -1) + x))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / STEP).cast("int")), lambda i: F.slice(lengths, i * STEP + 1, F.lit(STEP)))
    found = found.withColumn("parts", parts)
    found = found.withColumn("bases", running(F.col("start"), F.transform("parts", lambda p: F.aggregate(p, F.lit(0), lambda total, x: total + x))))
    ends = F.flatten(F.transform("parts", lambda p, i: F.slice(running(F.get("bases", i), p), F.lit(1), F.size(p))))
    placed = cut(found.withColumn("starts", ends), semantics)
    return placed.select("scene_name", "line_number", "line", "indent", "segment", F.get("starts", F.col("segment")).alias("position"), "text", "command", "keyword", "type", "mode", "after")


def atoms(found: DataFrame, semantics: str = "observed", by: tuple[str, ...] = ("scene_name",)) -> DataFrame:
    """From lines, rows (scene_name, line_number, segment, part, position, indent, n_lines, kind, type, mode, text).

    kind is C for a command, with what follows an option or a comment as its text, L for a lexeme, R for prose that a
    command takes to the end of its line, T for other text, and N for a line's end. The text of T is what the line adds to
    the prose block: observed, the whole line if it holds no command, and even more if it begins with tabs.
    """
    plain = ~F.regexp_like("line", F.lit("[*#]"))
    doubled = F.expr("concat(substring(line, start + 1, tabs), line)")
    whole = F.when((F.col("tabs") == 0) | F.lit(semantics == "intended"), F.col("line")).when(F.length("line") > 2 * F.col("tabs") + F.col("spaces"), doubled).otherwise(F.expr("substring(line, start + 1)"))
    found = found.withColumn("whole", F.when(plain, whole))
    placed = cut(found, semantics, ends=True)
    rest = F.when(F.col("after") != "", F.array("keyword", "after")).otherwise(F.array("keyword"))
    parts = F.when(F.col("mode") == "X", F.concat(F.array("keyword"), F.regexp_extract_all("after", F.lit(language(semantics).lexeme), F.lit(0)))).when(F.col("keyword").isNotNull(), rest).otherwise(F.array("text"))
    own = [*by[1:], "scene_name", "line_number", "segment", "start", "indent", "n_lines", "type", "mode"]
    placed = placed.select(*own, "command", "whole", F.when(F.col("mode").isin("C", "O"), F.col("after")).alias("after"), F.posexplode(parts).alias("part", "atom"))
    kind = F.when(F.col("command") & (F.col("part") == 0), "C").when(F.col("mode") == "X", "L").when(F.col("mode") == "E", "R").when(F.col("mode") == "P", "T").when(F.col("command"), "-").when(F.col("atom") == "\n", "N").otherwise("T")
    placed = placed.filter(kind != "-").select(*own, "part", F.length("atom").alias("width"), kind.alias("kind"), F.when(kind == "C", F.nullif(F.col("after"), F.lit(""))).when(kind == "N", None).when((kind == "T") & F.col("whole").isNotNull(), F.col("whole")).otherwise(F.col("atom")).alias("text"))
    line = Window.partitionBy(*by, "line_number").orderBy("segment", "part").rowsBetween(Window.unboundedPreceding, 0)
    position = F.col("start") + F.sum("width").over(line) - F.col("width")
    # By these alone, as the windows to come need it; those by line are then inside a partition too.
    return placed.repartition(*by).select(*by[1:], "scene_name", "line_number", "segment", "part", position.cast("int").alias("position"), "indent", "n_lines", "kind", "type", "mode", "text")


def _values(found: DataFrame, semantics: str) -> DataFrame:
    """Atoms with the type and the values of the token that each is, in the columns of TOKEN; type is null for those that are none."""
    lex, first = F.col("text"), F.substring("text", 1, 1)
    kind = F.when(first.isin('"', "'"), "StringLiteral").when(F.regexp_like(lex, F.lit("^[0-9]")), "NumberLiteral")
    kind = kind.when(F.regexp_like(lex, F.lit("^[A-Za-z_]")), F.coalesce(lookup(WORDS, lex), F.lit("Identifier"))).otherwise(lookup(language(semantics).operators, lex))
    of = F.col("kind")
    found = found.withColumn("token", F.when(of == "C", F.col("type")).when(of == "R", "Prose").when(of == "L", kind))
    inner = F.when(F.regexp_like(lex, F.lit(CLOSED)), F.expr("substring(text, 2, length(text) - 2)")).otherwise(F.expr("substring(text, 2)"))
    token, option = F.col("token"), (of == "C") & (F.col("mode") == "O")
    values = {
        "content": F.when(of == "R", lex),
        "value_str": F.when((of == "C") & (F.col("mode") == "C"), F.expr("substring(text, 2)")).when(token == "Identifier", lex).when(token == "StringLiteral", F.regexp_replace(inner, r"\\((?s:.))", "$1")),
        "value_num": F.when(token == "NumberLiteral", F.regexp_extract(lex, r"^[0-9]+(?:\.[0-9]*)?", 0).cast("double")),
        "value_bool": F.when(token == "BooleanLiteral", lex == "true"),
        "raw_value": F.when((of == "L") & ~token.isin("Identifier", "StringLiteral", "NumberLiteral", *BARE), lex),
        "raw_text": F.when(option, lex),
        "has_multi_replace": F.when(option & lex.isNotNull(), F.contains(lex, F.lit("@{"))),
    }
    return found.select("*", *[v.alias(c) for c, v in values.items()])


def blocks(found: DataFrame, semantics: str = "observed", by: tuple[str, ...] = ("scene_name",)) -> DataFrame:
    """From atoms, rows (scene_name, island, tokens, begins, ends, n_lines, flushed, pieces): what stands from one command to the next.

    tokens are those of the command and its expression, pieces the texts and line ends after it. flushed is whether a command follows;
    begins and ends, whether the island is its scene's first or last. Islands are those of the columns `by`.
    """
    in_order = Window.partitionBy(*by).orderBy("line_number", "segment", "part")
    island = F.sum(F.when(F.col("kind") == "C", 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    placed = _values(found, semantics).withColumn("island", island)
    last = (F.col("kind") == "N") & (F.col("line_number") == F.col("n_lines") - 1)
    first = (F.col("line_number") == 0) & (F.col("segment") == 0) & (F.col("part") == 0)
    at = [F.col(c) for c in ("line_number", "segment", "part")]
    token = F.struct(*at, F.col("token").alias("type"), "position", "indent", *VALUES)
    piece = F.struct(*at, "position", "indent", "text")
    return placed.groupBy(*by, "island").agg(
        F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), token))).alias("tokens"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("T", "N"), piece))).alias("pieces"),
        F.max(first).alias("begins"), F.max(last).alias("ends"), F.max("n_lines").alias("n_lines"),
    )


def prose(found: DataFrame) -> DataFrame:
    """blocks with content, their prose, null if that is blank, and start, where its first text stands.

    A line's end counts only after text that is not blank.
    """
    is_text = lambda x: x["text"].isNotNull()
    started = F.array_position(F.transform("pieces", lambda x: is_text(x) & ~is_blank(x["text"])), F.lit(True))
    content = F.array_join(F.transform("pieces", lambda x, i: F.when(is_text(x), x["text"]).when((F.col("started") > 0) & (i >= F.col("started")), "\n").otherwise("")), "")
    found = found.withColumn("started", started)
    return found.withColumn("content", F.when(F.col("started") > 0, content)).withColumn("start", F.get(F.filter("pieces", is_text), F.lit(0))).drop("pieces", "started")


def prose_tails(scenes: DataFrame, semantics: str = "observed") -> DataFrame:
    """Rows (scene_name, content): the prose after each scene's last command, which observed semantics drops."""
    return prose(blocks(atoms(lines(scenes, semantics), semantics), semantics)).filter("ends and content is not null").select("scene_name", "content")


def scan(scenes: DataFrame, semantics: str = "observed") -> DataFrame:
    """All tokens of all scenes, in the columns of TOKEN. semantics is `observed` or `intended`.

    Scenes of null content have no tokens, not even those of their start and end. Scenes need names of their own: see with_own_names().
    """
    return numbered(told(prose(blocks(atoms(lines(scenes, semantics), semantics), semantics)), semantics))


def scan_large(rows: DataFrame, semantics: str = "observed", block_lines: int = BLOCK_LINES) -> DataFrame:
    """The tokens of scan() from rows (scene_name, line_number, line), where a scene may be larger than a task: no task takes more than a block of block_lines lines.

    Islands of a block that other blocks don't add to are done in the block. Text before a block's first command belongs to the last command of
    the blocks before; which one that is follows from a row for each block, and only such edges, two a block at most, meet by a shuffle. The tokens' numbers are counted in a block,
    and begin where the blocks before end: a running sum over a row for each block. Only a prose token's own text is as long as the prose is. Two stages are kept in the shared folder.
    """
    by = ("scene_name", "block")
    found = lines_of_rows(rows, semantics).withColumn("block", F.expr(f"line_number div {block_lines}"))
    parts = kept(blocks(atoms(found, semantics, by), semantics, by))
    of_block = parts.groupBy(*by).agg(F.max("island").alias("last"))
    before = Window.partitionBy("scene_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("last") > 0, F.struct("block", F.col("last").alias("island"))), ignorenulls=True).over(before)
    of_block = of_block.select(*by, "last", owner.alias("owner"))
    parts = parts.join(of_block, list(by))
    inner = parts.filter("island > 0 and island < last").drop("last", "owner")
    edges = parts.filter("island = 0 or island = last")
    head = F.col("island") == 0
    edges = edges.withColumns({"block": F.when(head, F.coalesce("owner.block", F.lit(-1))).otherwise(F.col("block")).cast("int"), "island": F.when(head, F.coalesce("owner.island", F.lit(0))).otherwise(F.col("island"))})
    edges = edges.groupBy(*by, "island").agg(
        F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"), F.array_sort(F.flatten(F.collect_list("pieces"))).alias("pieces"), F.max("begins").alias("begins"), F.max("ends").alias("ends"), F.max("n_lines").alias("n_lines"),
    )
    every = kept(told(prose(inner.unionByName(edges)), semantics, by))
    start = every.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    start = start.select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    every = numbered(every, by).join(start, list(by))
    return every.select("scene_name", (F.col("token_idx") + F.col("start")).cast("int").alias("token_idx"), *TOKEN.fieldNames()[2:])


def told(found: DataFrame, semantics: str, by: tuple[str, ...] = ("scene_name",)) -> DataFrame:
    """From prose(), rows (by, island, at, x): the tokens of each island, in order."""
    nothing = [F.lit(None).cast(TOKEN[c].dataType).alias(c) for c in VALUES]
    row = lambda kind, line, position, indent, values: F.struct(F.lit(kind).alias("type"), line.cast("int").alias("line_number"), position.cast("int").alias("position"), indent.alias("indent"), *values)
    start = row("SceneStart", F.lit(0), F.lit(0), F.lit(0.0), nothing)
    end = row("SceneEnd", F.col("n_lines"), F.lit(0), F.lit(0.0), nothing)
    block = row("Prose", F.col("start.line_number"), F.col("start.position"), F.col("start.indent"), [F.col("content"), *nothing[1:]])
    own = F.transform("tokens", lambda x: F.struct(*[x[c].alias(c) for c in ("type", "line_number", "position", "indent", *VALUES)]))
    emitted = F.col("content").isNotNull() & (F.lit(semantics == "intended") | ~F.col("ends"))
    only = lambda when, what: F.when(when, F.array(what)).otherwise(F.array().cast(_ARRAY))
    every = F.concat(only(F.col("begins"), start), own, only(emitted, block), only(F.col("ends"), end))
    return found.select(*by, "island", F.posexplode(every).alias("at", "x"))


def numbered(every: DataFrame, by: tuple[str, ...] = ("scene_name",)) -> DataFrame:
    """From told(), the tokens in the columns of TOKEN, numbered within the columns `by`."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy("island", "at")) - 1
    return every.select(*by, number.cast("int").alias("token_idx"), *[F.col(f"x.{c}").alias(c) for c in ("type", "line_number", "position", "indent", *VALUES)])
