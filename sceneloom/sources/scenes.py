"""Scenes: scripts as rows (scene_name, source_url, content), and the filters that apply to whole scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.script import BLANK_JAVA, MISSING_SCENE

SCENE = T.StructType([T.StructField("scene_name", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("content", T.StringType())])


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """One scene for each text file of a folder or pattern, named as the file without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_url"), F.col("value").alias("content"))
    return files.select(F.regexp_extract("source_url", r"([^/]*?)(?:\.txt)?$", 1).alias("scene_name"), "source_url", "content")


class ScenePartition(InputPartition):
    def __init__(self, name: str):
        self.name = name


class HttpScenes(DataSource):
    """Scenes by HTTP: `spark.read.format("http_scenes").option("base", url).option("names", "startup,first").load()`.

    Each name is a partition of its own, fetched from <base>/scenes/<name>.txt. The status is not looked at: what an error
    response holds is the content, for `without_missing` to drop. `timeout` is the seconds that a response may take, 60 if not given.
    """

    @classmethod
    def name(cls) -> str:
        return "http_scenes"

    def schema(self) -> T.StructType:
        return SCENE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.seconds = options["base"].rstrip("/"), float(options.get("timeout", "60"))
        self.names = [n.strip() for n in options.get("names", "").split(",") if n.strip()]

    def partitions(self) -> list[ScenePartition]:
        return [ScenePartition(n) for n in self.names]

    def read(self, partition: ScenePartition):
        import urllib.error
        import urllib.request

        url = f"{self.base}/scenes/{partition.name}.txt"
        try:
            with urllib.request.urlopen(url, timeout=self.seconds) as response:
                body = response.read()
        except urllib.error.HTTPError as error:
            body = error.read()
        yield partition.name, url, body.decode("utf-8", "replace")


def without_missing(scenes: DataFrame) -> DataFrame:
    """Scenes but those whose content says that there is none. Scenes of null content stay; they have no lines."""
    return scenes.filter(~F.col("content").eqNullSafe(F.lit(MISSING_SCENE)))


def with_own_names(scenes: DataFrame) -> DataFrame:
    """scenes in which repeated names are followed by ~2, ~3 and so on, in the order of their sources and contents.

    The scanner takes rows of one name for one scene, so names that may repeat go through this first.
    """
    place = F.row_number().over(Window.partitionBy("scene_name").orderBy("source_url", F.xxhash64("content")))
    return scenes.withColumn("scene_name", F.when(place > 1, F.concat_ws("~", "scene_name", place)).otherwise(F.col("scene_name")))


def scene_list(startup: DataFrame) -> DataFrame:
    """Rows (scene_name, place, listed): the scenes that a startup scene lists after *scene_list, in order, repeats kept.

    The list ends at the next asterisk. Without one, the last character is not part of it; without the keyword, what
    stands from the 11th character on is taken. An empty content is an error.
    """
    content = F.when(F.length("content") > 0, F.col("content")).otherwise(F.raise_error(F.lit("an empty scene has no scene list")))
    begin = F.locate("*scene_list", F.col("content"))
    begin = F.when(begin > 0, begin + 11).otherwise(11)
    end = F.expr("locate('*', content, begin)")
    end = F.when(end > 0, end).otherwise(F.length("content"))
    cut = startup.select("scene_name", content.alias("content")).withColumn("begin", begin).withColumn("end", end)
    cut = cut.withColumn("listed", F.expr("substring(content, begin, greatest(end - begin, 0))"))
    trimmed = F.transform(F.split("listed", "\n"), lambda x: F.regexp_replace(x, f"^{BLANK_JAVA}+|{BLANK_JAVA}+$", ""))
    return cut.select("scene_name", F.posexplode(F.filter(trimmed, lambda x: x != "")).alias("place", "listed"))


def implicit_control_flow(scenes: DataFrame) -> DataFrame:
    """Rows (scene_name, implicit_control_flow)."""
    return scenes.select("scene_name", F.contains("content", F.lit("*create implicit_control_flow true")).alias("implicit_control_flow"))
