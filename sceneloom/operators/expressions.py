"""Expressions as trees, one row a node, and in postfix order, with windows only.

A token's part in an expression follows from the token before it: after an operand or a closing parenthesis an operator is due,
anywhere else an operand. Running sums give the depth of parentheses; what stands in one pair of them is a group. In a group,
operators and operands alternate, and the tree is decided by comparing neighbours: an operator hangs below the nearest one on its
left or right that binds looser (of equals: the later one, where they bind to the left), whichever of the two binds tighter. As there
are but four levels of precedence, the nearest one of each level is a window function. The postfix order follows in the same way: an operator comes
out at the nearest looser operator on its right, or at the end of its group.

All windows are within one line of a scene, so a scene of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Types whose statement holds an expression, after so many operands.
WITH_EXPRESSION = {"CreateVariable": 1, "CreateTempVariable": 1, "SetVariable": 1, "If": 0, "ElseIf": 0, "SelectableIf": 0}
#: Statements that may have none.
OPTIONAL = ("CreateVariable", "CreateTempVariable")
#: Binary operators by rising precedence; those of the level RIGHT bind to the right.
LEVELS = (
    ("LogicalAnd", "LogicalOr"),
    ("EqualityOperator", "NotEqualityOperator", "GreaterThanOperator", "GreaterThanEqualsOperator", "LessThanOperator", "LessThanEqualsOperator"),
    ("SubtractionOperator", "AdditionOperator", "ConcatenationOperator"),
    ("DivisionOperator", "MultiplicationOperator", "ModulusOperator"),
)
RIGHT = 2
PREFIX = ("NotOperator", "SubtractionOperator", "AdditionOperator", "FairmathAdditionOperator", "FairmathSubtractionOperator")
OPERANDS = ("NumberLiteral", "StringLiteral", "BooleanLiteral", "Identifier")
# The texts of errors.
NO_OPERAND = "Expect expression."
NOT_ENDED = "Expected end of statement"
NOT_CLOSED = "Expect ')' after expression."
_EXPRESSION = ["scene_name", "line_number", "statement"]


def shown() -> Column:
    """A lexeme as it is shown in postfix order."""
    bracket = F.when(F.col("type") == "OpenParenthesis", "(").when(F.col("type") == "CloseParenthesis", ")")
    return F.coalesce("raw_value", "value_str", F.col("value_num").cast("string"), F.col("value_bool").cast("string"), bracket, F.col("type"))


def lexemes(tokens: DataFrame, statements: tuple[str, ...]) -> DataFrame:
    """Rows (scene_name, line_number, statement, of, place, token_idx, type, shown, indent, position): the lexemes of expressions, from place 0 on, and for each expression a row of place -1.

    statement is the token of the statement, of its type. statements are the types that begin or belong to one. An expression is what follows the statement's operands on its line,
    up to the next command. A created variable may have none; then it has no row.
    """
    line = Window.partitionBy("scene_name", "line_number").orderBy("token_idx").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("type").isin(*statements), F.struct("token_idx", "type")), ignorenulls=True).over(line)
    found = tokens.filter(~F.col("type").isin("Prose", "SceneStart", "SceneEnd")).select("scene_name", "line_number", "token_idx", "type", "indent", "position", shown().alias("shown"), head.alias("head"))
    operands = F.when(F.col("head.type").isin(*[t for t, n in WITH_EXPRESSION.items() if n]), 1).otherwise(0)
    after = F.col("token_idx") - F.col("head.token_idx")
    found = found.filter(F.col("head.type").isin(*WITH_EXPRESSION)).filter((after == 0) | (after > operands))
    found = found.select("scene_name", "line_number", F.col("head.token_idx").alias("statement"), F.col("head.type").alias("of"), F.when(after == 0, -1).otherwise(after - operands - 1).alias("place"), "token_idx", "type", "shown", "indent", "position")
    has_any = F.max(F.col("place") >= 0).over(Window.partitionBy(*_EXPRESSION))
    return found.withColumn("has_any", has_any).filter(F.col("has_any") | ~F.col("of").isin(*OPTIONAL)).drop("has_any")


def with_roles(found: DataFrame) -> DataFrame:
    """lexemes() with role (operand, prefix, open, close, binary, bad; head at place -1), level, depth (of parentheses around it, an open one's own counted too) and error, its expression's."""
    order = Window.partitionBy(*_EXPRESSION).orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*_EXPRESSION)
    due = (F.col("place") <= 0) | ~F.lag("type").over(order).isin(*OPERANDS, "CloseParenthesis")
    kind, level = F.col("type"), F.lit(None).cast("int")
    for k, types in enumerate(LEVELS):
        level = F.when(kind.isin(*types), k).otherwise(level)
    role = F.when(F.col("place") < 0, "head").when(due, F.when(kind.isin(*OPERANDS), "operand").when(kind.isin(*PREFIX), "prefix").when(kind == "OpenParenthesis", "open").otherwise("bad"))
    role = role.when(kind == "CloseParenthesis", "close").when(level.isNotNull(), "binary").otherwise("bad")
    found = found.withColumns({"due": due, "role": role})
    found = found.withColumn("level", F.when(F.col("role") == "binary", level))
    opened, closed = (F.sum(F.when(F.col("role") == r, 1).otherwise(0)).over(so_far) for r in ("open", "close"))
    found = found.withColumn("depth", opened - closed + F.when(F.col("role") == "close", 1).otherwise(0))
    open_before = F.col("depth") > 0
    wrong = F.when((F.col("role") == "bad") & F.col("due"), NO_OPERAND).when((F.col("role") == "bad") & open_before, NOT_CLOSED).when((F.col("role") == "bad") | ((F.col("role") == "close") & ~open_before), NOT_ENDED)
    found = found.withColumn("wrong", wrong)
    first = F.min(F.when(F.col("wrong").isNotNull(), F.struct("place", "wrong", "token_idx"))).over(whole)
    last = F.max_by(F.struct("role", F.when(F.col("role") == "close", F.col("depth") - 1).otherwise(F.col("depth")).alias("left_open")), "place").over(whole)
    found = found.withColumns({"first": first, "last": last})
    at_end = F.when(F.col("last.role").isin("head", "binary", "prefix", "open"), NO_OPERAND).when(F.col("last.left_open") > 0, NOT_CLOSED)
    return found.withColumns({"error": F.coalesce("first.wrong", at_end), "error_token": F.col("first.token_idx")}).drop("due", "wrong", "first", "last")


def with_errors(tokens: DataFrame, statements: tuple[str, ...]) -> DataFrame:
    """All rows of tokens, which have the columns of lexemes and shown, with expr_error at statements whose expression cannot be parsed, and expr_at, a struct of the token at which it fails.

    A token at which it fails for want of one is the next one, on whatever line. tokens also have at_0, at_1 and at_2, structs of the token itself and of the next ones.
    """
    line = Window.partitionBy("scene_name", "line_number").orderBy("token_idx").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("type").isin(*statements), F.struct("token_idx", "type")), ignorenulls=True).over(line)
    found = tokens.withColumn("head", head)
    after = F.col("token_idx") - F.col("head.token_idx")
    operands = F.when(F.col("head.type").isin(*[t for t, n in WITH_EXPRESSION.items() if n]), 1).otherwise(0)
    is_part = F.col("head.type").isin(*WITH_EXPRESSION) & ((after == 0) | (after > operands)) & ~F.col("type").isin("Prose", "SceneStart", "SceneEnd")
    is_part = F.coalesce(is_part, F.lit(False))
    # What is no part of an expression is one of its own, of which nothing is asked.
    found = found.withColumns({"statement": F.when(is_part, F.col("head.token_idx")).otherwise(-1 - F.col("token_idx")), "of": F.when(is_part, F.col("head.type")), "place": F.when(is_part & (after > 0), after - operands - 1).otherwise(-1)})
    found = with_roles(found)
    whole = Window.partitionBy(*_EXPRESSION)
    # Where there is no lexeme, the next token is the one after the operands.
    last = F.max_by(F.when((F.col("place") < 0) & (F.col("of").isin(*[t for t, n in WITH_EXPRESSION.items() if n])), F.col("at_2")).otherwise(F.col("at_1")), "place").over(whole)
    wrong = F.max(F.when(F.col("token_idx") == F.col("error_token"), F.struct("at_0")))
    found = found.withColumns({"n_places": F.max("place").over(whole), "expr_at": F.coalesce(wrong.over(whole)["at_0"], last)})
    asked = F.col("of").isNotNull() & (F.col("place") < 0) & ((F.col("n_places") >= 0) | ~F.col("of").isin(*OPTIONAL))
    return found.withColumn("expr_error", F.when(asked, F.col("error"))).drop("head", "statement", "of", "place", "n_places", "role", "level", "depth", "error", "error_token")


def below(left: Column, right: Column) -> Column:
    """Of two operators (place, level), one on the left and one on the right, the one that binds tighter; the other one if either is null. It is what stands between them hangs from."""
    tighter = (left["level"] > right["level"]) | ((left["level"] == right["level"]) & (left["level"] != RIGHT))
    return F.when(right.isNull() | tighter, left).otherwise(right)


def grouped(found: DataFrame, failed: bool = False) -> DataFrame:
    """with_roles() without errors, each row with group, the place of the parenthesis that it stands in, null outside of any; closed, where that one is closed; and above_left, above_right, nearest operators to hang from.

    An open parenthesis is two rows: role open in the group around it, and opener in its own. With failed, the head of each expression with an error comes too.
    """
    sound = found.filter("if(error is null, place >= 0, place = -1)" if failed else "error is null and place >= 0")
    roles = F.explode(F.when(F.col("role") == "open", F.array(F.lit("open"), F.lit("opener"))).otherwise(F.array("role")))
    sound = sound.select("*", roles.alias("as")).drop("role").withColumnRenamed("as", "role")
    sound = sound.withColumn("depth", F.when(F.col("role") == "open", F.col("depth") - 1).otherwise(F.col("depth")))
    of_depth = Window.partitionBy(*_EXPRESSION, "depth").orderBy("place")
    sound = sound.withColumn("group", F.last(F.when(F.col("role") == "opener", F.col("place")), ignorenulls=True).over(of_depth.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(*_EXPRESSION, "depth", "group")
    before = group.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    at = lambda k: F.when(F.col("level") == k, F.struct("place", "level"))
    left = [F.last(at(k), ignorenulls=True).over(before) for k in range(len(LEVELS))]
    right = [F.first(at(k), ignorenulls=True).over(after) for k in range(len(LEVELS))]
    # What is not an operator binds tighter than any: all operators may be above it.
    own = F.coalesce("level", F.lit(len(LEVELS)))
    may_left = [F.when((own > k) | ((own == k) & F.lit(k == RIGHT)), x) for k, x in enumerate(left)]
    may_right = [F.when((own > k) | ((own == k) & F.lit(k != RIGHT)), x) for k, x in enumerate(right)]
    return sound.withColumns({"closed": F.max(F.when(F.col("role") == "close", F.col("place"))).over(group), "above_left": F.greatest(*may_left), "above_right": F.least(*may_right)})


def nodes(tokens: DataFrame, statements: tuple[str, ...]) -> DataFrame:
    """Rows (scene_name, token_idx, node, parent, slot, kind, operator, value) of all expressions without errors, one a node.

    token_idx is the statement's token, node and parent are tokens, kind is Binary, Unary, Grouping, Literal or Identifier. slot is left or right of a Binary, operand of a
    Unary, expression of a Grouping, and root, without a parent, at the top.
    """
    return trees(grouped(with_roles(lexemes(tokens, statements))))


def trees(found: DataFrame) -> DataFrame:
    """nodes() from grouped()."""
    base = Window.partitionBy(*_EXPRESSION).orderBy("place", F.col("role") == "opener")
    first = F.min(F.col("token_idx")).over(Window.partitionBy(*_EXPRESSION)) - F.min("place").over(Window.partitionBy(*_EXPRESSION))
    under = below(F.col("above_left"), F.col("above_right"))
    after_prefix = F.coalesce(F.lag("role").over(base) == "prefix", F.lit(False)) & (F.col("role") != "binary")
    placed = found.select("*", first.alias("begin"), F.when(after_prefix, F.struct((F.col("place") - 1).alias("place"), F.lit("operand").alias("slot"))).when(under.isNotNull(), F.struct(under["place"].alias("place"), F.when(under["place"] < F.col("place"), "right").otherwise("left").alias("slot"))).otherwise(F.struct(F.col("group").alias("place"), F.when(F.col("group").isNull(), "root").otherwise("expression").alias("slot"))).alias("up"))
    placed = placed.filter(~F.col("role").isin("close", "opener"))
    kind = F.when(F.col("role") == "binary", "Binary").when(F.col("role") == "prefix", "Unary").when(F.col("role") == "open", "Grouping").when(F.col("type") == "Identifier", "Identifier").otherwise("Literal")
    return placed.select(
        "scene_name", F.col("statement").alias("token_idx"), F.col("token_idx").alias("node"), (F.col("begin") + F.col("up.place")).cast("int").alias("parent"), F.col("up.slot").alias("slot"), kind.alias("kind"),
        F.when(F.col("role").isin("binary", "prefix"), F.col("shown")).alias("operator"), F.when(F.col("role") == "operand", F.col("shown")).alias("value"),
    )


def expressions(tokens: DataFrame, statements: tuple[str, ...]) -> DataFrame:
    """Rows (scene_name, token_idx, type, postfix, error): the expression of each statement that has one, in postfix order, prefix operators marked with a tilde; or the error that it cannot be parsed for, with null for the order."""
    found = grouped(with_roles(lexemes(tokens, statements)), failed=True)
    # Where each comes out: operands at once; operators at the nearest looser one on their right, or where their group ends; prefix operators after what they stand before.
    end, far = F.col("closed"), F.lit(1 << 30)
    within = Window.partitionBy(*_EXPRESSION, "depth", "group").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    # The group that an open parenthesis begins is closed at the first place after it of its own depth.
    closes = F.first(F.when(F.col("role") == "close", F.struct("place", "depth")), ignorenulls=True).over(Window.partitionBy(*_EXPRESSION, F.when(F.col("role") == "open", F.col("depth") + 1).otherwise(F.col("depth"))).orderBy("place", F.col("role") == "opener").rowsBetween(1, Window.unboundedFollowing))
    found = found.withColumn("own_close", F.when(F.col("role") == "open", closes["place"]))
    target = F.first(F.when(F.col("role").isin("operand", "open"), F.coalesce("own_close", "place")), ignorenulls=True).over(within)
    out = F.when(F.col("role") == "operand", F.struct(F.col("place").alias("at"), F.lit(0).alias("phase"), F.col("place").alias("order"))).when(F.col("role") == "prefix", F.struct(target.alias("at"), F.lit(2).alias("phase"), (-F.col("place")).alias("order"))).when(F.col("role") == "binary", F.struct(F.coalesce(F.col("above_right")["place"], end, far).alias("at"), F.lit(1).alias("phase"), (-F.col("place")).alias("order")))
    told = found.select(*_EXPRESSION, "of", "error", out.alias("out"), F.when(F.col("role") == "prefix", F.concat(F.lit("~"), "shown")).otherwise(F.col("shown")).alias("word")).filter("out is not null or error is not null")
    words = F.array_sort(F.collect_list(F.when(F.col("out").isNotNull(), F.struct("out", "word"))))
    whole = told.groupBy(*_EXPRESSION, "of").agg(words.alias("words"), F.max("error").alias("error"))
    return whole.select("scene_name", F.col("statement").alias("token_idx"), F.col("of").alias("type"), F.when(F.col("error").isNull(), F.array_join(F.transform("words", lambda x: x["word"]), " ")).alias("postfix"), "error")
