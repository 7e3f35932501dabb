"""The dimension of token types, and the reading of type declarations from source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.script import KEYWORDS, OPERATORS, STRUCTURAL, WORDS
from ..sources.kept import kept
from .statements import INNER, STATEMENTS

#: Folders that a module's path may go up, and braces within braces that are looked into.
STEPS_UP, NESTED = 8, 4


def token_types(spark: SparkSession) -> DataFrame:
    """Rows (type, origin, mode, parsed): every token type the scanner makes. origin is keyword, text or expression."""
    rows = {t: ("keyword", m) for t, m in KEYWORDS.values()} | {t: ("text", None) for t in STRUCTURAL}
    rows |= {t: ("expression", None) for t in [*OPERATORS.values(), *WORDS.values(), "NumberLiteral", "StringLiteral", "Identifier"]}
    return spark.createDataFrame([(t, origin, mode, t in (*STATEMENTS, *INNER)) for t, (origin, mode) in sorted(rows.items())], "type string, origin string, mode string, parsed boolean")


def _statements(content: Column) -> Column:
    """The statements of a source text, without the blanks around them: what stands between semicolons or ends of lines."""
    return F.filter(F.transform(F.split(content, "[;\n]"), lambda x: F.regexp_replace(F.trim(F.translate(x, "\t\r", "  ")), " +", " ")), lambda x: x != "")


def _quoted(text: Column) -> Column:
    """What stands in the first quotes of a text, null without any."""
    return F.get(F.split(F.translate(text, '"`', "''"), "'"), F.lit(1))


def exported_modules(sources: DataFrame) -> DataFrame:
    """From rows (path, content), rows (path, module): what each file exports from elsewhere."""
    of = F.filter(_statements(F.col("content")), lambda x: F.replace(x, F.lit(" "), F.lit("")).startswith("export*from"))
    return sources.select("path", F.explode(F.transform(of, _quoted)).alias("module")).filter("module is not null")


def module_edges(sources: DataFrame, root: str) -> DataFrame:
    """Rows (path, next): the file that each export of an index file, or of root, leads to.

    A module of a/index.ts is a/<module>.ts, or a/<module>/index.ts where there is no such file; ../ goes up. Modules without a file are left out, and so is what a file named
    *token.ts, or any other but an index file, exports. Files are found by equality of paths, of which a module has two.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    target = F.concat(folder, F.regexp_replace("module", r"^(?:\./)+", ""))
    for _ in range(STEPS_UP):
        target = F.regexp_replace(target, r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./", "")
    exporting = sources.filter((F.col("path").endswith("index.ts") | (F.col("path") == root)) & ~F.col("path").endswith("token.ts"))
    wanted = exported_modules(exporting).select("path", target.alias("target")).distinct()
    either = F.explode(F.array(F.struct(F.lit(0).alias("choice"), F.when(F.regexp_like("target", F.lit(r"\.[^./]+$")), F.col("target")).otherwise(F.concat("target", F.lit(".ts"))).alias("file")), F.struct(F.lit(1).alias("choice"), F.concat(F.regexp_replace("target", r"\.ts$", ""), F.lit("/index.ts")).alias("file"))))
    files = sources.select(F.col("path").alias("file")).distinct()
    found = wanted.select("path", "target", either.alias("x")).select("path", "target", "x.*").join(files, "file")
    return found.groupBy("path", "target").agg(F.min_by("file", "choice").alias("next")).select("path", "next").distinct()


def reachable_files(sources: DataFrame, root: str) -> DataFrame:
    """Rows (path, depth): the files that root exports from, directly or through others, each once at its least distance; cycles end where they began.

    One join for each step away from root: of what the last step has found with the edges. Edges and steps are kept, so no step makes earlier ones again. (A recursive
    common table expression would follow every path, of which there may be many more than files, as Spark's knows no UNION without ALL.)
    """
    edges = kept(module_edges(sources, root))
    step = kept(sources.filter(F.col("path") == root).select("path", F.lit(0).alias("depth")).distinct())
    found, depth = step, 0
    while not step.isEmpty():
        depth += 1
        step = kept(step.select("path").join(edges, "path").select(F.col("next").alias("path")).distinct().join(found, "path", "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(step)
    return found


def _body(text: Column) -> Column:
    """What stands from the text's beginning to the brace that closes it, without what stands in braces within."""
    opens = lambda x: F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))
    pieces = F.split(text, "[}]")
    # The k-th closing brace is the one if k - 1 have been opened before it.
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("opened"), F.lit(-1).alias("end"))
    end = F.aggregate(pieces, begin, lambda so_far, x: F.struct((so_far["at"] + 1).alias("at"), (so_far["opened"] + opens(x)).alias("opened"), F.when((so_far["end"] < 0) & (so_far["opened"] + opens(x) == so_far["at"]), so_far["at"]).otherwise(so_far["end"]).alias("end")))["end"]
    body = F.array_join(F.slice(pieces, F.lit(1), F.when(end < 0, F.size(pieces)).otherwise(end + 1)), "}")
    for _ in range(NESTED):
        body = F.regexp_replace(body, r"\{[^{}]*\}", "")
    return body


def declared_types(sources: DataFrame) -> DataFrame:
    """Rows (name, type): the token interfaces, one of each name (of the first path), with their first type literal; null without one.

    A text is cut at the word interface; what stands before the first brace is the head, and up to the brace that closes it the members, those of inner braces left out.
    """
    pieces = F.slice(F.split("content", r"\binterface\b"), F.lit(2), F.lit(1 << 30))
    found = sources.select("path", F.posexplode(pieces).alias("place", "piece")).select("path", "place", F.split(F.trim(F.substring_index("piece", "{", 1)), r"\s+").alias("head"), _body(F.expr("substring(piece, locate('{', piece) + 1)")).alias("body"))
    found = found.filter((F.get("head", F.lit(1)) == "extends") & (F.get("head", F.lit(2)) == "Token") & F.get("head", F.lit(0)).endswith("Token"))
    member = F.get(F.filter(F.split("body", "[;,\n]"), lambda x: (F.trim(F.substring_index(x, ":", 1)) == "type") & (F.locate(":", x) > 0)), F.lit(0))
    named = found.select("path", "place", F.get("head", F.lit(0)).alias("name"), _quoted(member).alias("type"))
    return named.groupBy("name").agg(F.min_by(F.struct("type"), F.struct("path", "place")).alias("first")).select("name", "first.type")


def union_text(types: DataFrame) -> DataFrame:
    """One row (declaration): the literals of declared_types as a union, in order; types without a literal are left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct(F.lower("name").alias("by"), "name", "type"))))
    return types.agg(F.concat_ws(" | ", F.transform(ordered, lambda x: F.concat(F.lit("'"), x["type"], F.lit("'")))).alias("declaration"))
