"""File sources (S2, S3, S11, S12, P14): folders of text, rule files and skills, by Spark's readers."""

from __future__ import annotations

import functools
import pathlib
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions that a folder is read for.
EXTENSIONS = [
    "md", "mdx", "txt", "rst", "json", "yaml", "yml", "toml", "js", "ts", "jsx", "tsx", "py", "java", "go", "rs", "rb", "php", "c", "cpp", "h", "css",
]


def _any_case(extension: str) -> str:
    """A glob for an extension in any case; files are chosen before their bytes are read."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def read_tree(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """S2, S3. path, modified, size and text of every file below a folder with a listed extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(_any_case(e) for e in extensions or EXTENSIONS)}}}").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def glob_pattern(glob: str) -> str:
    """P14. A regular expression for a glob: ** any path, * any name, ? one character."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"(^|/){out}$"


def read_rules(spark: SparkSession, path: str, include: tuple[str, ...] = ("**/*.mdc", "**/*.md", "**/AGENTS.md", "**/.cursorrules"), exclude: tuple[str, ...] = ("**/node_modules/**", "**/.git/**", "**/dist/**")) -> DataFrame:
    """S11. Rule files with an id (8 digits of the path's md5), format and content. Names are chosen
    before files are read, folders by their paths."""
    names = {p.rsplit("/", 1)[-1] for p in include}
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", f"{{{','.join(sorted(names))}}}").load(path)
    kept = files.where(F.col("path").rlike("|".join(map(glob_pattern, include)))).where(~F.col("path").rlike("|".join(map(glob_pattern, exclude))))
    return kept.select(
        F.substring(F.md5("path"), 1, 8).alias("rule_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("format"),
        F.col("modificationTime").alias("last_modified"), F.decode("content", "UTF-8").alias("content"),
    )


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """S12. Skills: folders with a SKILL.md; name and description of its frontmatter (else the folder's
    name), and its text with those of references behind it."""
    files = read_tree(spark, path, ["md", "txt"])
    folder = F.regexp_extract("path", r"^(.*?)/(?:SKILL\.md|references/[^/]+)$", 1)
    parts = files.withColumn("folder", folder).where("folder <> ''").withColumn("main", F.col("path").endswith("/SKILL.md"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((~F.col("main")).alias("o"), "path", "text"))), lambda p: p["text"]), "\n\n")
    grouped = parts.groupBy("folder").agg(F.max(F.when(F.col("main"), F.col("text"))).alias("head"), body.alias("content")).where("head is not null")
    field = lambda name: F.nullif(F.trim(F.regexp_extract("head", rf"(?m)^{name}:\s*(.+)$", 1)), F.lit(""))
    return grouped.select(F.coalesce(field("name"), F.element_at(F.split("folder", "/"), -1)).alias("name"), field("description").alias("description"), "content")


def discover_skills(spark: SparkSession, paths: list[str], home: str = str(pathlib.Path.home())) -> DataFrame:
    """S12, R11. The skills of several folders (those that exist) with location: universal below an .agent folder, global below
    home, else project; and place, the number of the folder they were found in."""
    found = []
    for place, path in enumerate(paths):
        whole = path.replace("~", home, 1) if path.startswith("~") else path
        at = spark._jvm.org.apache.hadoop.fs.Path(whole)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            location = "universal" if ".agent" in whole else "global" if whole.removeprefix("file://").startswith(home) else "project"
            found.append(read_skills(spark, whole).select("*", F.lit(location).alias("location"), F.lit(place).alias("place")))
    none = spark.createDataFrame([], "name string, description string, content string, location string, place int")
    return functools.reduce(DataFrame.unionByName, found, none)


def skill_named(skills: DataFrame, name: str) -> DataFrame:
    """R11. The skill of a name; of several the one found last."""
    return skills.where(F.col("name") == name).orderBy(F.desc("place")).limit(1)


def backup_files(paths: list[str], folder: str, version: str) -> str:
    """K22. Copies of the files, each path once, in a new folder of that version; two files of one name
    keep both, the later with a number. Returns the folder. Runs on the driver: rule files are few."""
    into = pathlib.Path(folder) / re.sub("[:.]", "-", version)
    into.mkdir(parents=True)
    for source in dict.fromkeys(paths):
        name, target, n = pathlib.Path(source).name, into / pathlib.Path(source).name, 1
        while target.exists():
            target, n = into / f"{n}-{name}", n + 1
        shutil.copyfile(source, target)
    return str(into)
