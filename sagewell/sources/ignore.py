"""Ignore rules of a tree of files: rules are rows, joined to paths by the folders that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the files that hold rules (a fixed value).
IGNORE_FILE = ".gitignore"

#: Parts of a glob, in the order in which they are found, and the letter that stands for each meanwhile.
MARKS = [(r"\\([*?\[\]])", "\u0001$1"), (r"\[!", "[^"), (r"^\*\*/", "\u0002"), (r"/\*\*/", "/\u0002"), (r"/\*\*$", "/\u0003"), (r"(?<!\u0001)\*+", "\u0004"), (r"(?<!\u0001)\?", "\u0005")]
SPELLED = {"\u0001": "\\", "\u0002": "(?:[^/]+/)*", "\u0003": ".+", "\u0004": "[^/]*", "\u0005": "[^/]"}


def glob_regex(glob: Column | str) -> Column:
    """A glob as a regular expression for a whole relative path: ** is any number of folders, * and ? stay within
    one, [..] is a class of letters, and a backslash takes a letter as it is."""
    out = F.regexp_replace(glob, r"([.+^$(){}|])", r"\\$1")
    # letters that no path has stand for what comes in, so that no step meets what another one made
    for pattern, mark in MARKS:
        out = F.regexp_replace(out, pattern, mark)
    for mark, regex in SPELLED.items():
        out = F.replace(out, F.lit(mark), F.lit(regex))
    return F.concat(F.lit("^"), out, F.lit("$"))


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rules from lines of ignore files (folder, place, line): folder, place, keep, folders_only, regex.

    Blank lines and those that begin with # are none. ! takes back, a slash at the end means folders only; a slash
    before that ties a pattern to its folder, others match at any depth below it."""
    line = F.regexp_replace("line", r"(?<!\\\\)[ \t\r]+$", "")
    rows = lines.select("folder", "place", line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    rows = rows.withColumn("keep", F.startswith("line", F.lit("!"))).withColumn("line", F.regexp_replace("line", r"^!", ""))
    rows = rows.withColumn("folders_only", F.endswith("line", F.lit("/"))).withColumn("line", F.regexp_replace("line", r"/+$", ""))
    tied = F.contains("line", F.lit("/"))
    glob = F.when(tied, F.regexp_replace("line", r"^/", "")).otherwise(F.concat(F.lit("**/"), "line"))
    return rows.where("line <> ''").select("folder", "place", "keep", "folders_only", glob_regex(glob).alias("regex"))


def ignored(paths: DataFrame, rules: DataFrame, path: str = "file") -> DataFrame:
    """The distinct paths that rules ignore: path.

    A path's entries are its folders and itself. Each distinct entry meets the rules of the folders above it by a join
    on the folder; of the rules that match, the last one of the deepest folder decides. A path is ignored if any
    of its entries is: what lies in an ignored folder can't be taken back. Null paths are left out.
    """
    parts = F.split(path, "/")
    upto = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    entries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(upto(i).alias("entry"), (i < F.size(parts)).alias("is_folder")))
    held = paths.where(F.col(path).isNotNull()).select(path).distinct().select(path, F.explode(entries).alias("e")).select(path, "e.*")
    each = held.select("entry", "is_folder").distinct()
    steps = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.struct(F.when(i == 0, "").otherwise(F.array_join(F.slice(steps, 1, F.greatest(i, F.lit(1))), "/")).alias("folder"), F.array_join(F.slice(steps, i + 1, F.size(steps)), "/").alias("below"), i.alias("depth")))
    met = each.select("entry", "is_folder", F.explode(above).alias("a")).select("entry", "is_folder", "a.*").join(rules, "folder")
    hits = met.where((F.col("is_folder") | ~F.col("folders_only")) & F.expr("below RLIKE regex"))
    last = hits.groupBy("entry", "is_folder").agg(F.max_by(~F.col("keep"), F.struct("depth", "place")).alias("out")).where("out")
    return held.join(last.select("entry", "is_folder"), ["entry", "is_folder"], "left_semi").select(path).distinct()


def read_rules(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all ignore files below a folder: folder, place, line. Spark lists no hidden files, so the store is
    asked for their names; there are as many as folders that people wrote rules for."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top, found = store.makeQualified(base).toString().rstrip("/"), []
    listed = store.listFiles(base, True)
    while listed.hasNext():
        at = listed.next().getPath()
        if at.getName() == IGNORE_FILE:
            source = store.open(at)
            text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8", "replace")
            source.close()
            folder = at.getParent().toString()[len(top) :].strip("/")
            found += [(folder, i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(found, "folder string, place int, line string")
