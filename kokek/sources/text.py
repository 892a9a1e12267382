"""Text in and out: tokens, lexicons, gold analyses."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kokek.checkpoints import cut

#: ASCII punctuation other than the apostrophe, which is deleted; Unicode blanks.
PUNCTUATION = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
BLANKS = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]+"
GOLD = "word string, root string, suffixes array<struct<name string, form string, makes string>>, final_pos string"


#: Each punctuation character and each blank; one table turns them all into spaces.
_SEPARATORS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() or re.fullmatch(PUNCTUATION, c))


def tokens_of(text: Column, turkish: bool = False) -> Column:
    """Lower-case tokens: apostrophes vanish, other punctuation separates. ``turkish`` lowers I to ı."""
    old, new = ("Iİ", "ıi") if turkish else ("", "")
    plain = F.translate(text, old + _SEPARATORS + "'’", new + " " * len(_SEPARATORS))
    return F.array_remove(F.split(F.lower(plain), " "), "")


def tokenize(docs: DataFrame, turkish: bool = False) -> DataFrame:
    return docs.select("doc_id", F.posexplode(tokens_of(F.col("text"), turkish)).alias("pos", "token"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stripped lines; blank ones go, a missing file has none."""
    return read_lines(spark, path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def draw_words(lexicon: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` words (all, if there are fewer) in the order of a seeded hash; reruns agree."""
    return lexicon.select("word").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "word")), "word").limit(n)


def delete_words(lexicon: DataFrame, gone: DataFrame) -> DataFrame:
    return lexicon.join(gone, "word", "left_anti")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("doc_id"), F.col("value").alias("text"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 0), token of a text file or of all files of a folder in the order of their names. Files are
    read in splits by all cores: tokens are counted for each split, whose place in the file Spark knows, and
    sums of the counts before it give the positions."""
    lines = read_lines(spark, path)
    if "value" not in lines.columns or not lines.inputFiles():
        return spark.createDataFrame([], "pos long, token string")
    at = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    own = at.select("file", "block", "line", tokens_of(F.col("value")).alias("tokens")).where("size(tokens) > 0")
    # A row for each split; a window over them sees as many rows as there are splits.
    splits = own.groupBy("file", "block").agg(F.sum(F.size("tokens")).alias("n"), F.min("line").alias("least"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    splits = cut(splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("before")))
    inside = F.coalesce(F.sum(F.size("tokens")).over(Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = own.withColumn("inside", inside).join(F.broadcast(splits), ["file", "block"])
    return begun.select((F.col("before") + F.col("inside")).alias("begin"), F.posexplode("tokens").alias("k", "token")).select((F.col("begin") + F.col("k")).alias("pos"), "token")


def write_ordered(lines: DataFrame, path: str) -> None:
    """Writes ``value`` in the order of ``pos``: part files follow each other by their names."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "pos").sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)


def parse_gold(lines: DataFrame) -> DataFrame:
    """Gold rows of JSON lines in ``value``; blank and malformed ones are skipped, missing suffixes
    are an empty list."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    rows = lines.select(F.from_json("value", f"{GOLD}, malformed string", options).alias("g")).select("g.*")
    rows = rows.where("malformed is null and word is not null").drop("malformed")
    return rows.withColumn("suffixes", F.coalesce("suffixes", F.array().cast("array<struct<name:string,form:string,makes:string>>")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file or folder in ``value``; of a missing one, none."""
    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows of a JSON-lines file (see ``parse_gold``); none if there is no file."""
    return parse_gold(read_lines(spark, path))


def append_gold(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def fresh(name: str) -> str:
    """A folder name that no other run has."""
    return f"{name}-{uuid.uuid4().hex}"


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """The complete outputs of Spark (folders with _SUCCESS) in a folder; none if it is not there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at)]
    return sorted(str(p) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def last_output(spark: SparkSession, folder: str) -> int:
    """The greatest number that names a complete output in a folder, -1 without one."""
    names = [path.rsplit("/", 1)[-1] for path in files_in(spark, folder)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_counter(spark: SparkSession, n: int, path: str) -> None:
    """Replaces the integer that ``read_counter`` reads."""
    write_text(spark.createDataFrame([(str(n),)], "value string"), path)


def read_counter(spark: SparkSession, path: str) -> int:
    """The integer in a file; anything else counts as 0."""
    try:
        row = spark.read.text(path, wholetext=True).selectExpr("coalesce(try_cast(trim(value) AS int), 0) AS n").first()
    except Exception:  # a missing file is an ordinary state of a new session
        return 0
    return row.n if row else 0
