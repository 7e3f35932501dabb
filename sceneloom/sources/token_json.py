"""Tokens as JSON: one line a token, one line a scene with all its tokens, or one pretty-printed array of scenes, each an array of tokens.

The pretty form is written and read by many tasks: no scene, and no file, has to fit in one. Its reader needs no line to hold more than one token, which any pretty printer sees to. Lines are
cut at the ends of blocks of bytes, as for any text, and pass once for the depth of brackets and once for the tokens; the depth at a block's beginning is a running sum over a row for each block, and so are the numbers
of scenes and tokens begun before it. Only tokens that blocks cut in two meet by a shuffle; no line is kept. Brackets in strings do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.scanner import TOKEN
from .kept import delete_folder, kept, stored

#: Names of the nested form, whose `value` is a text, a number or a truth value.
NAMES = {"scene_name": "sceneName", "line_number": "lineNumber", "raw_value": "rawValue", "raw_text": "rawText", "has_multi_replace": "hasMultiReplace"}
#: Tokens of a file of the pretty form.
FILE_TOKENS = 100_000


def write_tokens(tokens: DataFrame, path: str) -> None:
    """One JSON object a token; fields that a token doesn't have are left out."""
    tokens.write.mode("overwrite").json(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN).json(path)


def nested_by_scene(tokens: DataFrame) -> DataFrame:
    """Rows (scene_name, tokens): each scene's tokens as one JSON array, in order. A scene has to fit in memory.

    Fields that a token doesn't have are left out; a literal's value has its own type.
    """
    as_value = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("value"))))
    value = F.coalesce(*map(as_value, ("value_str", "value_num", "value_bool")))
    plain = F.to_json(F.struct(*[F.col(c).alias(NAMES.get(c, c)) for c in TOKEN.fieldNames() if c not in ("token_idx", "value_str", "value_num", "value_bool")]))
    whole = F.when(F.coalesce("value_str", F.col("value_num").cast("string"), F.col("value_bool").cast("string")).isNotNull(), F.concat(F.expr("left(plain, length(plain) - 1)"), F.lit(","), F.expr("substring(value, 2)"))).otherwise(F.col("plain"))
    told = tokens.withColumns({"value": value, "plain": plain}).select("scene_name", "token_idx", whole.alias("token"))
    ordered = F.array_sort(F.collect_list(F.struct("token_idx", "token")))
    return told.groupBy("scene_name").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["token"]), ","), F.lit("]")).alias("tokens"))


def write_nested(tokens: DataFrame, path: str) -> None:
    """Text files with a line for each scene, its tokens as an array."""
    nested_by_scene(tokens).select("tokens").write.mode("overwrite").text(path)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Tokens in the columns of TOKEN, from lines that each hold the array of one scene, or files with an array of those."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s*\[\s*\[", "[[").alias("value"))
    return tokens_of(text.select(F.explode(F.when(F.col("value").startswith("[["), F.from_json("value", "array<array<string>>")).otherwise(F.transform(F.filter(F.split("value", "\n"), lambda x: x != ""), lambda x: F.from_json(x, "array<string>")))).alias("scene")))


def _told(column: str) -> Column:
    """A column of TOKEN as JSON, whole numbers without a fraction."""
    value, kind = F.col(column), TOKEN[column].dataType.simpleString()
    if kind == "string":
        return F.rtrim(F.substring(F.to_json(F.struct(value.alias("v"))), 6, 1 << 30), F.lit("}"))  # a quotation mark stands before the brace
    text = value.cast("string")
    if kind != "double":
        return text
    return F.when(text.isin("NaN", "Infinity", "-Infinity"), F.concat(F.lit('"'), text, F.lit('"'))).when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text)


def write_pretty(tokens: DataFrame, path: str, compression: str = "none") -> None:
    """One array of arrays, two blanks a level, in the files of a folder: one after the other, by name, they are the text. Scenes are in the order of their names.

    Fields that a token doesn't have are left out; a literal's value has its own type. An empty table makes an empty array. compression is one of those that Spark's texts know.
    """
    spark = tokens.sparkSession
    tokens, copy = stored(tokens.select(TOKEN.fieldNames()), "tokens")  # what they are made of is read once, not for the ends, the ranges and the text again
    values = ("value_str", "value_num", "value_bool")
    order = ["type", "scene_name", "line_number", "position", "indent", "content", "value", "raw_value", "raw_text", "has_multi_replace"]
    own = lambda c, name: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'      "{name}": '), _told(c)))
    fields = [F.coalesce(*[own(v, "value") for v in values]) if c == "value" else own(c, NAMES.get(c, c)) for c in order]
    ends = tokens.groupBy("scene_name").agg(F.count(F.lit(1)).alias("n"), F.min("token_idx").alias("first"), F.max("token_idx").alias("last"))
    # A missing name comes first.
    n, least, most = ends.agg(F.sum("n"), F.min(F.struct("scene_name"))["scene_name"], F.max(F.struct("scene_name"))["scene_name"]).first()
    if n is None:
        spark.createDataFrame([("[]",)], "value string").write.mode("overwrite").text(path, compression=compression)
    else:
        name = F.col("scene_name")
        # A row for each end comes to the token that it is of with the rows that are dealt out for the files, so tokens are dealt once.
        marks = ends.select("scene_name", F.explode(F.array(*[F.struct(F.col(c).alias("token_idx"), F.lit(c == "first").alias("begins"), F.lit(c == "last").alias("ends")) for c in ("first", "last")])).alias("x")).select("scene_name", "x.*", F.lit(False).alias("told"))
        ranged = tokens.withColumn("told", F.lit(True)).unionByName(marks, allowMissingColumns=True).repartitionByRange(n // FILE_TOKENS + 1, "scene_name", "token_idx")
        one = Window.partitionBy("scene_name", "token_idx")
        ranged = ranged.withColumns({c: F.max(c).over(one) for c in ("begins", "ends")}).filter("told").sortWithinPartitions("scene_name", "token_idx")
        begin = F.when(F.col("begins"), F.when(name.eqNullSafe(F.lit(least)), "[\n  [\n").otherwise("  [\n")).otherwise("")
        end = F.when(F.col("ends"), F.when(name.eqNullSafe(F.lit(most)), "\n  ]\n]").otherwise("\n  ],")).otherwise(",")
        text = F.concat(begin, F.lit("    {\n"), F.concat_ws(",\n", *fields), F.lit("\n    }"), end)
        ranged.select(text.alias("value")).write.mode("overwrite").text(path, compression=compression)
    delete_folder(spark, copy)


@contextmanager
def _cut_alike(spark: SparkSession) -> Iterator[None]:
    """Within, files are cut into the same blocks by each read, however many cores there are by then."""
    key = "spark.sql.files.minPartitionNum"
    unset = spark.conf.get(key, None) is None
    if unset:
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(key)


def taken_apart(lines: DataFrame) -> DataFrame:
    """From the lines of blocks (value, by, whole, block, depth), in order, rows (block, kind, begun, number, open, json).

    kind is W for a whole token, T for the beginning of one that the block's end cuts, H for what a block has of one begun before it, and S for the block itself. begun counts
    the scenes begun in the block up to the row, number the tokens since the last of them, or since the block's beginning; open is whether the block has a T. Of a block, only the lines of the last token begun are held.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, depth, total, base, begun = None, 0, 0, 0, 0
        held, at = [], None  # lines of the open token, or of the last one; its begun and number, None for one begun before the block

        def rows(kinds, begins, numbers, opens, texts):
            n = len(kinds)
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), pa.array(kinds, pa.string()), pa.array(begins, pa.int32()), pa.array(numbers, pa.int64()), pa.array(opens, pa.bool_()), texts], names=["block", "kind", "begun", "number", "open", "json"])

        def last(kind):
            text = "\n".join(x for part in held for x in part.to_pylist())
            return rows([kind], [at[0] if at else 0], [at[1] if at else None], [None], pa.array([text], pa.string()))

        def ended():
            cut = at is not None and depth >= 3
            if held:
                yield last("H" if at is None else "T" if cut else "W")
            yield rows(["S"], [begun], [total - base], [cut], pa.array([None], pa.string()))

        for batch in batches:
            blocks = batch.column(3)
            if blocks.null_count:
                raise ValueError("files were cut into other blocks, or were changed, between two reads")
            numbers = blocks.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for start, stop in zip(edges, edges[1:], strict=False):
                if numbers[start] != block:
                    if block is not None:
                        yield from ended()
                    block, depth, total, base, begun, held, at = int(numbers[start]), batch.column(4)[start].as_py(), 0, 0, 0, [], None
                own = batch.slice(start, stop - start)
                by, whole = (own.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                deep = depth + np.cumsum(by, dtype=np.int64)
                was = deep - by
                scene = (was < 2) & (deep >= 2)
                token = ((was <= 2) & (deep >= 3)) | ((was == 2) & whole)
                inside = token | (was >= 3)
                tokens, scenes = total + np.cumsum(token), begun + np.cumsum(scene)
                bases = np.maximum(np.maximum.accumulate(np.where(scene, tokens - token, 0)), base)
                lines = own.column(0).cast(pa.string()).filter(pa.array(inside))
                first = np.flatnonzero(token[inside])
                if len(first):
                    if first[0]:
                        held.append(lines[: first[0]])
                    if held:
                        yield last("H" if at is None else "W")
                    if len(first) > 1:
                        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), lines), "\n")
                        n, there = len(first) - 1, np.flatnonzero(token)[:-1]
                        yield rows(["W"] * n, scenes[there], (tokens - 1 - bases)[there], [None] * n, texts)
                    there = np.flatnonzero(token)[-1]
                    held, at = [lines[first[-1] :]], (int(scenes[there]), int((tokens - 1 - bases)[there]))
                elif len(lines):
                    held.append(lines)
                depth, total, base, begun = int(deep[-1]), int(tokens[-1]), int(bases[-1]), int(scenes[-1])
        if block is not None:
            yield from ended()

    return lines.mapInArrow(of, "block int, kind string, begun int, number long, open boolean, json string")


def read_pretty(spark: SparkSession, path: str) -> DataFrame:
    """Tokens in the columns of TOKEN from what write_pretty() writes, or from a file or files that hold such an array, pretty-printed in any way with one token a line at most.

    All is read here; the tokens are in the shared folder, as columns.
    """
    of = ["file_path", "file_block_start"]
    lines = spark.read.text(path).select("value", *[f"_metadata.{c}" for c in of])
    has = lambda x: F.contains("value", F.lit(x))
    bare = F.when(has('"'), F.regexp_replace("value", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")).otherwise(F.col("value"))
    lines = lines.withColumn("bare", F.when(has("{") | has("}") | has("[") | has("]"), bare).otherwise(""))
    count = lambda brackets: F.length("bare") - F.length(F.translate("bare", brackets, ""))
    lines = lines.withColumns({"by": count("[{") - count("]}"), "whole": F.contains("bare", F.lit("{")) & (count("[{") == count("]}"))}).drop("bare")
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731 - over a row for each block
    with _cut_alike(spark):
        blocks = lines.groupBy(*of).agg(F.sum("by").alias("by"))
        blocks = kept(blocks.select(*of, F.row_number().over(Window.orderBy(*of)).alias("block"), F.coalesce(F.sum("by").over(before(*of)), F.lit(0)).cast("int").alias("depth")))
        parts = taken_apart(lines.join(F.broadcast(blocks), of, "left").select("value", "by", "whole", "block", "depth"))
        is_whole = F.col("kind") == "W"
        parts = parts.select("block", "kind", "begun", "number", "open", F.when(~is_whole, F.col("json")).alias("text"), F.when(is_whole, _object("json")).alias("json"), F.col("number").alias("token_idx"))
        found, _ = stored(fields_of(parts, "block", "kind", "begun", "number", "open", "text"))
    of_block = found.filter("kind = 'S'").select("block", "begun", "number", F.col("open").cast("int").alias("open"))
    so_far = of_block.withColumns({"tokens": F.coalesce(F.sum("number").over(before("block")), F.lit(0)), "opened": F.coalesce(F.sum("open").over(before("block")), F.lit(0))})
    # The tokens of the scene that a block begins in: those of all blocks before it, but for those before the last block in which a scene begins.
    carried = kept(so_far.select("block", "opened", (F.col("tokens") - F.coalesce(F.max(F.when(F.col("begun") > 0, F.col("tokens"))).over(before("block")), F.lit(0))).alias("carried")))
    found = found.filter("kind <> 'S'").join(F.broadcast(carried), "block").withColumn("token_idx", (F.col("number") + F.when(F.col("begun") == 0, F.col("carried")).otherwise(0)).cast("int"))
    cut = found.filter("kind in ('T', 'H')").groupBy((F.col("opened") + F.when(F.col("kind") == "T", 1).otherwise(0)).alias("nth"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    cut = cut.agg(F.max(F.when(F.col("kind") == "T", F.col("token_idx"))).alias("token_idx"), text.alias("text")).select("token_idx", _object("text").alias("json"))
    return found.filter("kind = 'W'").select(TOKEN.fieldNames()).unionByName(fields_of(cut))


def _object(column: str) -> Column:
    """From a text, what begins with its first opening brace and ends with its last closing one."""
    return F.expr(f"substring({column}, locate('{{', {column}), length({column}) - length(substring_index({column}, '}}', -1)) - locate('{{', {column}) + 1)")


def tokens_of(nested: DataFrame) -> DataFrame:
    """From rows (scene), arrays of JSON objects, tokens in the columns of TOKEN; what `value` holds goes by its type."""
    return fields_of(nested.select(F.posexplode("scene").alias("token_idx", "json")))


def fields_of(found: DataFrame, *more: str) -> DataFrame:
    """From rows (token_idx, json), tokens in the columns of TOKEN. more are columns that come too."""
    names = {c: NAMES.get(c, c) for c in TOKEN.fieldNames()[2:] if not c.startswith("value_")} | {"scene_name": NAMES["scene_name"], "value": "value"}
    # An object is taken apart once, all its fields as texts.
    found = found.select("token_idx", *more, F.from_json("json", ", ".join(f"{n} string" for n in names.values())).alias("own"))
    field = lambda c: F.col(f"own.{names[c]}").cast(TOKEN[c].dataType).alias(c)
    value, kind = F.col("own.value"), F.col("own.type")
    values = {"value_num": F.when(kind == "NumberLiteral", value).cast("double"), "value_bool": F.when(kind == "BooleanLiteral", value).cast("boolean"), "value_str": F.when(~kind.isin("NumberLiteral", "BooleanLiteral"), value)}
    return found.select(field("scene_name"), F.col("token_idx"), *[values[c].alias(c) if c in values else field(c) for c in TOKEN.fieldNames()[2:]], *more)
