"""Statements read off the token table: scopes by windows and stacks of blocks, operands by looking ahead."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import expressions as of_expressions
from ..sources.kept import kept

#: Token types that begin a statement.
STATEMENTS = ("CreateVariable", "CreateTempVariable", "SetVariable", "Prose", "Choice", "ChoiceOption", "If", "GoSub", "GoSubScene", "Return", "GotoLabel", "GotoScene", "Label", "PageBreak", "InputText", "Comment")
#: Types that only stand inside other statements.
INNER = ("ElseIf", "Else", "HideReuse", "DisableReuse", "AllowReuse", "SelectableIf")
MODIFIERS = ("HideReuse", "DisableReuse", "AllowReuse", "SelectableIf")
#: What may stand directly in a choice. Branches and modifiers have rules of their own.
IN_CHOICE = ("Comment", "If", "ElseIf", "Else", "ChoiceOption", *MODIFIERS)
# The texts of errors.
UNKNOWN = "Unknown statement block starting "
PROSE_IN_CHOICE = "Prose is not allowed directly inside Choice statements. Did you mean to put it inside a ChoiceOption?"
NO_OPTION = "Expected ChoiceOption token after modifiers"
MISSING = {
    "CreateVariable": "Expect variable name",
    "CreateTempVariable": "Expect variable name",
    "SetVariable": "Expect variable name",
    "GoSub": "Expect subroutine name.",
    "GoSubScene": "Expect scene name.",
    "GotoScene": "Expect scene name.",
    "GotoLabel": "Expect label name.",
    "Label": "Expect label name.",
    "InputText": "Expect variable name to store input text.",
}
#: What follows the name of a scene, if anything does on its line.
SECOND = {"GoSubScene": "Expect subroutine label name.", "GotoScene": "Expect label name."}
NO_BUTTON = "Expect button text after page break."
#: Statements that end their line, and how many tokens further on the next line has to have begun.
ENDS = {"Return": 1, "GotoLabel": 2, "GoSub": 2, "InputText": 2, "GotoScene": 3, "GoSubScene": 3}
NOT_ENDED = "Expected end of statement, found "
#: Lines of a scene that one task takes, where a scene is spread over tasks.
BLOCK_LINES = 4096
def in_scene():
    return Window.partitionBy("scene_name").orderBy("token_idx")


def with_neighbours(tokens: DataFrame) -> DataFrame:
    """tokens with same_line and same_indent (as the token before), next_type, next_value and after_next_value (on the same line)."""
    on_line = lambda column, k: F.when(F.lead("line_number", k).over(in_scene()) == F.col("line_number"), F.lead(column, k).over(in_scene()))
    text = F.coalesce("value_str", "content")
    tokens = tokens.withColumn("text", text)
    return tokens.select(
        "*",
        F.coalesce(F.lag("line_number").over(in_scene()), F.lit(0)).eqNullSafe(F.col("line_number")).alias("same_line"),
        F.coalesce(F.lag("indent").over(in_scene()), F.lit(0.0)).eqNullSafe(F.col("indent")).alias("same_indent"),
        *[on_line("type", k).alias(f"type_{k}") for k in (1, 2, 3)],
        *[on_line("text", k).alias(f"text_{k}") for k in (1, 2)],
    )


def scope_flags(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, type, child_scope, sibling_scope), one for each token that begins a statement or stands inside one: whether the next token stands deeper, and whether it stands no further out.

    A scene's end has no indent, so nothing deeper than that is in the scope of what it follows.
    """
    after = F.lead("indent").over(in_scene())
    found = tokens.select("scene_name", "token_idx", "type", F.coalesce(after > F.col("indent"), F.lit(False)).alias("child_scope"), F.coalesce(after >= F.col("indent"), F.lit(False)).alias("sibling_scope"), begins().alias("begins"))
    return found.filter("begins").drop("begins")


def _named(tokens: DataFrame, *types: str) -> DataFrame:
    return with_neighbours(tokens).filter(F.col("type").isin(*types) & (F.col("type_1") == "Identifier"))


def declared_variables(tokens: DataFrame) -> DataFrame:
    scope = F.when(F.col("type") == "CreateTempVariable", "Temporary").otherwise("Global")
    return _named(tokens, "CreateVariable", "CreateTempVariable").select("scene_name", "token_idx", F.col("text_1").alias("variable"), scope.alias("scope"), F.col("type_2").isNotNull().alias("has_expression"))


def set_variables(tokens: DataFrame) -> DataFrame:
    return _named(tokens, "SetVariable").select("scene_name", "token_idx", F.col("text_1").alias("variable"), F.col("type_2").alias("expression_starts"))


def jumps(tokens: DataFrame, to_scene: str, to_label: str) -> DataFrame:
    """Rows (scene_name, token_idx, target_scene, target_label), for a goto or a gosub. A target label in the own scene has no scene."""
    far = F.col("type") == to_scene
    label = F.when(far, F.when(F.col("type_2") == "Identifier", F.col("text_2"))).otherwise(F.col("text_1"))
    return _named(tokens, to_scene, to_label).select("scene_name", "token_idx", F.when(far, F.col("text_1")).alias("target_scene"), label.alias("target_label"))


def goto_edges(tokens: DataFrame) -> DataFrame:
    return jumps(tokens, "GotoScene", "GotoLabel")


def gosub_edges(tokens: DataFrame) -> DataFrame:
    return jumps(tokens, "GoSubScene", "GoSub")


def labels(tokens: DataFrame) -> DataFrame:
    return _named(tokens, "Label").select("scene_name", "token_idx", F.col("text_1").alias("label"))


def input_variables(tokens: DataFrame) -> DataFrame:
    return _named(tokens, "InputText").select("scene_name", "token_idx", F.col("text_1").alias("variable"))


def page_breaks(tokens: DataFrame) -> DataFrame:
    return with_neighbours(tokens).filter("type = 'PageBreak'").select("scene_name", "token_idx", F.when(F.col("type_1") == "Prose", F.col("text_1")).alias("button_text"))


def comment_blocks(tokens: DataFrame) -> DataFrame:
    """Neighbouring comments of one indent as one block: (scene_name, first_token, n_comments, text)."""
    joins = (F.lag("type").over(in_scene()) == "Comment") & (F.lag("indent").over(in_scene()) == F.col("indent"))
    begun = tokens.withColumn("begins", F.when((F.col("type") == "Comment") & ~F.coalesce(joins, F.lit(False)), 1).otherwise(0))
    block = begun.withColumn("block", F.sum("begins").over(in_scene())).filter("type = 'Comment'")
    parts = F.array_sort(F.collect_list(F.struct("token_idx", "value_str")))
    found = block.groupBy("scene_name", "block").agg(F.min("token_idx").alias("first_token"), F.count(F.lit(1)).alias("n_comments"), parts.alias("parts"))
    return found.select("scene_name", "first_token", "n_comments", F.array_join(F.transform("parts", lambda x: F.coalesce(x["value_str"], F.lit(""))), "\n").alias("text"))


def unparseable(tokens: DataFrame) -> DataFrame:
    """First tokens of lines that begin no statement: (scene_name, token_idx, type, message)."""
    first = with_neighbours(tokens).filter(~F.col("same_line") | (F.col("token_idx") == 1))
    wrong = first.filter(~F.col("type").isin(*STATEMENTS, *INNER, "SceneStart", "SceneEnd"))
    where = F.format_string("%s:%d:%d", "scene_name", "line_number", "position")
    return wrong.select("scene_name", "token_idx", "type", F.concat(F.lit(UNKNOWN), F.col("type"), F.lit(" at "), where).alias("message"))


def begins() -> Column:
    """Whether a token begins a statement or stands inside one. Prose that a page break takes as its button text begins none."""
    taken = F.coalesce((F.lag("type").over(in_scene()) == "PageBreak") & (F.lag("line_number").over(in_scene()) == F.col("line_number")), F.lit(False))
    return F.col("type").isin(*STATEMENTS, *INNER) & ~((F.col("type") == "Prose") & taken)


def begun(tokens: DataFrame) -> DataFrame:
    """The tokens that begin a statement or stand inside one."""
    return tokens.withColumn("begins", begins()).filter("begins").drop("begins")


def stacked(found: DataFrame, by: tuple[str, ...] = ("scene_name",)) -> DataFrame:
    """found with parent_idx, parent_type, depth (0 without a parent) and choice_idx, which stands at options only.

    The parent is the last If before a statement on its line, or else the nearest statement before it with less indent. choice_idx is
    the choice that an option stands in, directly or in one If. Rows of a false column counts, if found has one, have no parent and are none. found has to be clustered by
    the columns `by`, as it is after a window over them; its rows pass in order, and only the statements that are open at a row are held.
    """
    passed = found.sortWithinPartitions(*by, "token_idx")
    read = [found.columns.index(c) for c in ("token_idx", "type", "line_number", "indent")]
    key = [found.columns.index(c) for c in by]
    counts = found.columns.index("counts") if "counts" in found.columns else None
    names = [*found.columns, "parent_idx", "parent_type", "depth", "choice_idx"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, stack, an_if, if_line = None, [], None, None  # open statements: token, indent, type, parent's token and type, depth
        for batch in batches:
            ups, kinds, depths, choices = [], [], [], []
            keep = batch.column(counts).to_pylist() if counts is not None else [True] * batch.num_rows
            for own, at, kind, line, indent, counted in zip(zip(*(batch.column(k).to_pylist() for k in key), strict=True), *(batch.column(k).to_pylist() for k in read), keep, strict=True):
                if own != scene:
                    scene, stack, an_if, if_line = own, [], None, None
                up = None
                if counted:
                    while stack and stack[-1][1] >= indent:
                        stack.pop()
                    up = an_if if if_line == line else stack[-1] if stack else None
                    stack.append((at, indent, kind, up[0] if up else None, up[2] if up else None, up[5] + 1 if up else 0))
                    if kind == "If":
                        an_if, if_line = stack[-1], line
                over = None if up is None else (up[3], up[4]) if up[2] == "If" else (up[0], up[2])
                ups.append(up[0] if up else None)
                kinds.append(up[2] if up else None)
                depths.append(up[5] + 1 if up else 0)
                choices.append(over[0] if kind == "ChoiceOption" and over and over[1] == "Choice" else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ups, pa.int32()), pa.array(kinds, pa.string()), pa.array(depths, pa.int32()), pa.array(choices, pa.int32())], names=names)

    added = [T.StructField("parent_idx", T.IntegerType()), T.StructField("parent_type", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("choice_idx", T.IntegerType())]
    return passed.mapInArrow(of, T.StructType([*found.schema.fields, *added]))


def placed(found: DataFrame) -> DataFrame:
    """The rows of begun() with what stacked() adds."""
    return stacked(found)


def parents(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, type, line_number, indent, parent_idx): the statement that each one stands in, by placed()."""
    columns = ["scene_name", "token_idx", "type", "line_number", "indent"]
    return placed(begun(tokens.select(columns))).select(*columns, "parent_idx")


def parents_in_blocks(tokens: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The rows of parents(), where a scene may be larger than a task: no task takes more than a block of block_lines lines.

    Each block finds the parents that stand in it. What stays open is, of each block, the last statement of each indent that no later one of the
    block closes: a row for an indent. A statement whose parent is not in its block has the latest of those, of all blocks before, with less indent;
    so per indent that is looked for, a running maximum over the blocks' rows gives it. tokens have to come in the columns of scan_large(),
    whose neighbours are found by line; a page break and its button text stand on one line.
    """
    columns = ["scene_name", "token_idx", "type", "line_number", "indent"]
    on_line = Window.partitionBy("scene_name", "line_number").orderBy("token_idx")
    taken = F.coalesce(F.lag("type").over(on_line) == "PageBreak", F.lit(False)) & (F.col("type") == "Prose")
    found = tokens.select(*columns, F.expr(f"line_number div {block_lines}").alias("block")).withColumn("taken", taken).filter(F.col("type").isin(*STATEMENTS, *INNER) & ~F.col("taken")).drop("taken")
    block = Window.partitionBy("scene_name", "block").orderBy("token_idx")
    last = F.coalesce(F.min("indent").over(block.rowsBetween(1, Window.unboundedFollowing)) > F.col("indent"), F.lit(True))
    found = kept(stacked(found.repartition("scene_name", "block").withColumn("stays", last), ("scene_name", "block")).drop("parent_type", "depth", "choice_idx"))
    looks = F.col("parent_idx").isNull() & (F.col("block") > 0) & (F.col("indent") > 0)
    sought = found.filter(looks).select("scene_name", "block", "indent").distinct()
    indents = sought.groupBy("scene_name").agg(F.collect_set("indent").alias("indents"))  # as many as a line has different indents
    stay = found.filter("stays").join(indents, "scene_name").select("scene_name", "block", "token_idx", F.explode(F.filter("indents", lambda x: x > F.col("indent"))).alias("indent"))
    stay = stay.groupBy("scene_name", "block", "indent").agg(F.max("token_idx").alias("token_idx"))
    before = Window.partitionBy("scene_name", "indent").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    both = stay.unionByName(sought.withColumn("token_idx", F.lit(None).cast("int"))).groupBy("scene_name", "block", "indent").agg(F.max("token_idx").alias("token_idx"), F.max(F.col("token_idx").isNull()).alias("asked"))
    carried = both.withColumn("carried", F.max("token_idx").over(before)).filter("asked").select("scene_name", "block", "indent", "carried")
    return found.join(carried, ["scene_name", "block", "indent"], "left").select("scene_name", "token_idx", "type", "line_number", "indent", F.coalesce("parent_idx", "carried").alias("parent_idx"))


def with_branches(found: DataFrame) -> DataFrame:
    """Rows with parent_idx, with if_idx: the If that an ElseIf or Else belongs to, null at all others and at those that belong to none.

    Among statements of one parent and one indent, a chain is an If, any number of ElseIf and one Else, with nothing between.
    Rows of a false column counts, if found has one, are no statements, so nothing ends a chain there.
    """
    of = ["scene_name", "parent_idx", "indent", *(["counts"] if "counts" in found.columns else [])]
    among = Window.partitionBy(*of).orderBy("token_idx")
    branch = F.col("type").isin("ElseIf", "Else")
    head = F.last(F.when(~branch, F.struct("token_idx", "type")), ignorenulls=True).over(among.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(branch, 0).otherwise(1)).over(among.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy(*of, "number").orderBy("token_idx").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max(F.col("type") == "Else").over(within), F.lit(False))
    chain = found.withColumns({"head": head, "number": number}).withColumn("closed", closed)
    return chain.withColumn("if_idx", F.when(branch & (F.col("head.type") == "If") & ~F.col("closed"), F.col("head.token_idx"))).drop("head", "number", "closed")


def else_pairing(found: DataFrame) -> DataFrame:
    """From parents(), each ElseIf and Else with the If that it belongs to, null if it belongs to none: rows (scene_name, token_idx, type, if_idx)."""
    return with_branches(found).filter("type in ('ElseIf', 'Else')").select("scene_name", "token_idx", "type", "if_idx")


def on_line(kind: str) -> Column:
    """The last statement of a kind on the line."""
    return F.max(F.when(F.col("type") == kind, F.col("token_idx"))).over(Window.partitionBy("scene_name", "line_number"))


def with_modifiers(found: DataFrame) -> DataFrame:
    """Statements with reuse and selectable_idx at options: what the modifiers before the option on its line say, disable before hide before allow.

    An option takes the rest of its line, so all else on the line comes before it.
    """
    option = F.col("type") == "ChoiceOption"
    marked = found.withColumns({f"_{k}": on_line(k) for k in MODIFIERS})
    reuse = F.when(F.col("_DisableReuse").isNotNull(), "disable_reuse").when(F.col("_HideReuse").isNotNull(), "hide_reuse").when(F.col("_AllowReuse").isNotNull(), "allow_reuse")
    return marked.withColumns({"reuse": F.when(option, reuse), "selectable_idx": F.when(option, F.col("_SelectableIf"))}).drop(*[f"_{k}" for k in MODIFIERS])


def choice_options(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, choice_idx, reuse, selectable_idx, if_idx, text), one for each option; if_idx is an If before it on its line."""
    found = placed(begun(tokens.select("scene_name", "token_idx", "type", "line_number", "indent", "raw_text")))
    found = with_modifiers(found).withColumn("if_idx", on_line("If")).filter("type = 'ChoiceOption'")
    return found.select("scene_name", "token_idx", "choice_idx", "reuse", "selectable_idx", "if_idx", F.col("raw_text").alias("text"))


def tree(tokens: DataFrame, *more: str) -> DataFrame:
    """Every statement with its place and its parts, as rows of one table.

    (scene_name, token_idx, parent_idx, slot, ordinal, kind, variable, scope, target_scene, target_label, reuse,
    selectable_idx, text). A statement without a parent is in the slot root. An ElseIf or Else that belongs to an If has
    it as its parent, in the slot else_if or else; all others are in the body of their parent. ordinal counts from 0 in
    a slot. Modifiers of options are columns of the option. The expressions are in expressions(), by token_idx, that of
    a SelectableIf too. Tokens are read once. more are columns of the token that come too.
    """
    kind, named, far = F.col("type"), F.col("type_1") == "Identifier", F.col("type").isin("GotoScene", "GoSubScene")
    near = with_neighbours(tokens).select(
        "scene_name", "token_idx", "type", "line_number", "indent",
        F.when(kind.isin("CreateVariable", "CreateTempVariable", "SetVariable", "InputText") & named, F.col("text_1")).alias("variable"),
        F.when(kind == "CreateVariable", "Global").when(kind == "CreateTempVariable", "Temporary").alias("scope"),
        F.when(far & named, F.col("text_1")).alias("target_scene"),
        F.when(far & named & (F.col("type_2") == "Identifier"), F.col("text_2")).when(kind.isin("GotoLabel", "GoSub", "Label") & named, F.col("text_1")).alias("target_label"),
        F.when(kind == "PageBreak", F.when(F.col("type_1") == "Prose", F.col("text_1"))).otherwise(F.coalesce("raw_text", "text")).alias("text"),
    )
    found = with_modifiers(with_branches(placed(begun(near)))).filter(~kind.isin(*MODIFIERS))
    slot = F.when(F.col("if_idx").isNotNull(), F.when(kind == "Else", "else").otherwise("else_if")).when(F.col("parent_idx").isNull(), "root").otherwise("body")
    found = found.withColumns({"slot": slot, "parent_idx": F.coalesce("if_idx", "parent_idx")})
    ordinal = F.row_number().over(Window.partitionBy("scene_name", "parent_idx", "slot").orderBy("token_idx")) - 1
    return found.select("scene_name", "token_idx", "parent_idx", "slot", ordinal.cast("int").alias("ordinal"), kind.alias("kind"), "variable", "scope", "target_scene", "target_label", "reuse", "selectable_idx", "text", *more)


def tree_of_blocks(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, parent_idx, slot, ordinal, kind, n_tokens, tokens, text): tree() with neighbouring comments, and neighbouring prose, as one statement each.

    Tokens are neighbours that follow each other with one indent, in one place of the tree. ordinal counts blocks; token_idx is the first token, tokens has all, text theirs, by lines.
    """
    block = F.col("kind").isin("Comment", "Prose")
    order = Window.partitionBy("scene_name", "parent_idx", "slot").orderBy("token_idx")
    follows = block & (F.lag("kind").over(order) == F.col("kind")) & (F.lag("token_idx").over(order) == F.col("token_idx") - 1) & (F.lag("indent").over(order) == F.col("indent"))
    found = tree(tokens, "indent").withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    found = found.withColumn("ordinal", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.array_sort(F.collect_list(F.struct("token_idx", F.coalesce("text", F.lit("")).alias("text"))))
    found = found.groupBy("scene_name", "parent_idx", "slot", F.col("ordinal").cast("int").alias("ordinal"), "kind").agg(parts.alias("parts"))
    return found.select("scene_name", F.get("parts", F.lit(0))["token_idx"].alias("token_idx"), "parent_idx", "slot", "ordinal", "kind", F.size("parts").alias("n_tokens"), F.transform("parts", lambda x: x["token_idx"]).alias("tokens"), F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))


def spans(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, last_token, depth, size): each statement as an interval of its scene's tokens.

    It ends before the next statement of no greater depth, or before the scene's end; so the intervals nest as the statements do, those of one parent follow each other without
    gaps, and those without one tile the scene from its first statement on. size is the number of statements in it, its own counted. Tokens that begin no statement belong to that before them.
    """
    order = in_scene()
    near = tokens.select("scene_name", "token_idx", "type", "line_number", "indent", begins().alias("counts"), F.max("token_idx").over(Window.partitionBy("scene_name")).alias("end"))
    found = stacked(near.filter("counts")).select("scene_name", "token_idx", "depth", "end")
    found = found.withColumns({"number": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("scene_name"))})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, stack = None, []
        for batch in batches:
            last, size = [], []
            for own, at, depth, end, number, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != scene:
                    scene, stack = own, []
                while stack and stack[-1][0] > depth:
                    stack.pop()
                last.append((stack[-1][1] if stack else end) - 1)
                size.append((stack[-1][2] if stack else n + 1) - number)
                stack.append((depth, at, number))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(last, pa.int32()), batch.column(2), pa.array(size, pa.int32())], names=["scene_name", "token_idx", "last_token", "depth", "size"])

    return found.sortWithinPartitions("scene_name", F.col("token_idx").desc()).mapInArrow(of, "scene_name string, token_idx int, last_token int, depth int, size int")


def choice_children(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, type, choice_idx): what stands directly in a choice, with the choice's token."""
    found = parents(tokens)
    choices = found.filter("type = 'Choice'").select("scene_name", F.col("token_idx").alias("choice_idx"))
    return found.withColumnRenamed("parent_idx", "choice_idx").join(choices, ["scene_name", "choice_idx"]).select("scene_name", "token_idx", "type", "choice_idx")


def expressions(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, type, postfix, error), one for each statement that has an expression; an error leaves no postfix order."""
    return of_expressions.expressions(tokens, (*STATEMENTS, *INNER))


def expression_tree(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, node, parent, slot, kind, operator, value): the nodes of all expressions that can be parsed."""
    return of_expressions.nodes(tokens, (*STATEMENTS, *INNER))


def _in(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("type")]


def where(token: Column) -> Column:
    """A place as scene:line:position[indent], with whole indents without a fraction."""
    indent = F.when(token["indent"] == F.floor(token["indent"]), F.floor(token["indent"]).cast("string")).otherwise(token["indent"].cast("string"))
    return F.concat(F.col("scene_name"), F.lit(":"), token["line_number"].cast("string"), F.lit(":"), token["position"].cast("string"), F.lit("["), indent, F.lit("]"))


def report(message: Column, token: Column) -> Column:
    """The whole text of an error at a token."""
    return F.concat(F.lit("Error: "), message, F.when(token["type"] == "SceneEnd", F.lit(" at end of scene ")).otherwise(F.concat(F.lit(" at '"), token["type"], F.lit("' "))), where(token))


def judged(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, counts, told): each statement, each token that stands where one is due but begins none, and each scene's first token, with all that is wrong with it; from one pass over the tokens.

    counts says whether it is a statement. told has (source, message, found_idx, report), as in errors().
    """
    order = in_scene()
    this = F.struct("token_idx", "type", "line_number", "position", "indent")
    near = tokens.select("scene_name", "token_idx", "type", "line_number", "position", "indent", of_expressions.shown().alias("shown"), this.alias("at_0"), begins().alias("counts"), *[F.lead(this, k).over(order).alias(f"at_{k}") for k in (1, 2, 3)], (F.coalesce(F.lag("line_number").over(order), F.lit(0)) != F.col("line_number")).alias("new_line"), F.lag("token_idx").over(order).isNull().alias("begins_scene"))
    near = of_expressions.with_errors(near, (*STATEMENTS, *INNER))
    near = near.withColumn("unknown", (F.col("new_line") | (F.col("token_idx") == 1)) & ~F.col("type").isin(*STATEMENTS, *INNER, "SceneStart", "SceneEnd"))
    rows = stacked(near.filter("counts or unknown or begins_scene").drop("shown"))
    rows = with_branches(rows)
    modifier = F.col("type").isin(*MODIFIERS)
    after = Window.partitionBy("scene_name", "line_number").orderBy("token_idx").rowsBetween(1, Window.unboundedFollowing)
    next_other = F.first(F.when(~modifier & F.col("counts"), F.col("type")), ignorenulls=True).over(after)
    rows = rows.withColumn("loose", modifier & ~F.coalesce(next_other.isin("ChoiceOption", "If"), F.lit(False)))

    same = lambda k: F.coalesce(F.col(f"at_{k}.line_number") == F.col("line_number"), F.lit(False))
    named = lambda k: same(k) & (F.col(f"at_{k}.type") == "Identifier")
    told: list[Column] = []

    def tell(when: Column, message: Column, token: Column, whole: Column | None = None, source: str = "structure") -> None:
        told.append(F.when(when, F.struct(F.lit(source).alias("source"), message.alias("message"), token["token_idx"].alias("found_idx"), F.coalesce(whole, report(message, token)).alias("report") if whole is not None else report(message, token).alias("report"))))

    unknown = F.concat(F.lit(UNKNOWN), F.col("type"))
    unknown_at = F.concat(unknown, F.lit(" at "), where(F.col("at_0")))
    tell(F.col("unknown"), F.concat(unknown, F.lit(" at "), F.concat_ws(":", "scene_name", "line_number", "position")), F.col("at_0"), unknown_at)
    missing = _in(MISSING)
    tell(F.col("counts") & missing.isNotNull() & ~named(1), missing, F.col("at_1"))
    second = _in(SECOND)
    tell(F.col("counts") & second.isNotNull() & named(1) & same(2) & ~named(2), second, F.col("at_2"))
    tell(F.col("counts") & (F.col("type") == "PageBreak") & same(1) & (F.col("at_1.type") != "Prose"), F.lit(NO_BUTTON), F.col("at_1"))
    further = _in({k: str(v) for k, v in ENDS.items()}).cast("int")
    extra = F.get(F.array("at_1", "at_2", "at_3"), further - 1)
    sound = (missing.isNull() | named(1)) & (second.isNull() | ~same(2) | named(2))
    tell(F.col("counts") & further.isNotNull() & sound & F.coalesce(extra["line_number"] == F.col("line_number"), F.lit(False)), F.concat(F.lit(NOT_ENDED), extra["type"]), extra, F.concat(F.lit("Error: "), F.lit(NOT_ENDED), extra["type"], F.lit(" instead at "), extra["line_number"].cast("string"), F.lit(":"), extra["position"].cast("string"), F.lit(" at '"), extra["type"], F.lit("' "), where(extra)))
    inside = (F.col("parent_type") == "Choice") & ~F.col("type").isin(*IN_CHOICE)
    tell(F.col("counts") & inside, F.when(F.col("type") == "Prose", PROSE_IN_CHOICE).otherwise(NO_OPTION), F.col("at_0"))
    tell(F.col("counts") & F.col("loose"), F.lit(NO_OPTION), F.col("at_0"))
    tell(F.col("counts") & F.col("type").isin("ElseIf", "Else") & F.col("if_idx").isNull(), unknown, F.col("at_0"), unknown_at)
    tell(F.col("counts") & F.col("expr_error").isNotNull() & (F.col("type").isin("If", "ElseIf", "SelectableIf") | named(1)), F.col("expr_error"), F.col("expr_at"), source="expression")
    return rows.select("scene_name", "token_idx", "counts", F.array_compact(F.array(*told)).alias("told"))


def errors(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, source, message, found_idx, report) of all that cannot be parsed, from one pass over the tokens.

    token_idx is the statement's token, found_idx the token at which it fails, report the whole text with its place. source is structure or expression. In structure:
    unknown statements, missing operands, tokens after a statement's end, what may not stand in a choice,
    modifiers without an option, and branches without an If. A statement may have several.
    """
    return judged(tokens).select("scene_name", "token_idx", F.explode("told").alias("x")).select("scene_name", "token_idx", "x.*")


def structural_errors(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, message) of errors(), but for what is inside expressions."""
    return errors(tokens).filter("source = 'structure'").select("scene_name", "token_idx", "message")


def parse_errors(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, token_idx, message) of errors()."""
    return errors(tokens).select("scene_name", "token_idx", "message")


def parsed(tokens: DataFrame, semantics: str = "intended") -> DataFrame:
    """The statements of all scenes: intended, tree(); observed, what the language's first parser makes of them, statements_observed()."""
    if semantics == "observed":
        from .observed import statements_observed

        return statements_observed(tokens)
    if semantics != "intended":
        raise ValueError(f"no such semantics: {semantics}")
    return tree(tokens)


def parse_outcome(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, parsed, n_statements, error), one for each scene: what a parser that stops at the first error makes of it.

    The first error is the one that fails at the earliest token; of several at one token, that of the earliest statement. error is its whole text, null for a scene
    without any. n_statements counts the statements begun before it: all, if there is none.
    """
    own = F.array_min(F.transform("told", lambda x: F.struct(x["found_idx"].alias("found_idx"), F.col("token_idx").alias("token_idx"), x["report"].alias("report"))))
    found = judged(tokens).select("scene_name", "token_idx", "counts", own.alias("own"))
    found = found.withColumn("first", F.min("own").over(Window.partitionBy("scene_name")))
    before = F.col("counts") & (F.col("first").isNull() | (F.col("token_idx") < F.col("first.token_idx")))
    whole = found.groupBy("scene_name").agg(F.first("first").alias("first"), F.sum(before.cast("int")).alias("n_statements"))
    return whole.select("scene_name", F.col("first").isNull().alias("parsed"), "n_statements", F.col("first.report").alias("error"))
