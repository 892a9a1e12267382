"""A dictionary that is kept in a folder and loses words now and then.

``lexicon/N`` holds all words and ``tables/N`` the tables made of them. Words that are deleted later are not
written out of either: ``log/N/K`` has, as one output of one job, the words that went and those rows of the
tables that changed with them. Readers lay the log over the tables by broadcasts, as its size is bounded:
beyond the bound, everything is written anew as ``N + 1``. Nothing is ever overwritten that a reader may hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kokek.checkpoints import cut
from kokek.functions import lexicon as made
from kokek.functions.forms import StemRule
from kokek.sources import text as source

#: Words that are deleted through the log at once: the rows that depend on them are some hundred times as many.
AT_ONCE = 2_000
#: Rows and outputs of a log, beyond which the dictionary is written anew.
LOG_ROWS, LOG_PARTS = 200_000, 64

_SCHEMAS = {
    "flags": "word string, noun boolean, verb boolean, soft boolean",
    "surfaces": "surface string, cand_ord int, lemma string, noun boolean, verb boolean",
    "profile": "kind string, head string, lengths array<int>",
}
_VALUES = "word string, surface string, kind string, head string, noun boolean, verb boolean, soft boolean, cand_ord int, lemma string, lengths array<int>"
_LOG = f"entry int, live boolean, {_VALUES}, part string"


class Dictionary:
    """The dictionary under ``folder``, empty where there is none. One session at a time may delete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def create(self, words: DataFrame) -> None:
        """Makes ``words`` (column word) the dictionary, unless there is one."""
        if self._last("lexicon") < 0:
            words.select("word").write.mode("overwrite").text(f"{self.folder}/lexicon/0")

    def _last(self, part: str) -> int:
        return source.last_output(self.spark, f"{self.folder}/{part}")

    def base(self) -> int:
        return max(self._last("lexicon"), 0)

    def version(self) -> str:
        """By what name results of this dictionary can be kept."""
        n = self.base()
        return f"{n}.{self._last(f'log/{n}')}"

    def log(self) -> DataFrame | None:
        """Every entry since the words were last written, None without any: the words that went (part words),
        the keys of table rows that do not hold any more, and, ``live``, the rows in their place."""
        n = self.base()
        k = self._last(f"log/{n}")
        return None if k < 0 else self.spark.read.schema(_LOG).parquet(*(f"{self.folder}/log/{n}/{i}" for i in range(k + 1)))

    def words(self) -> DataFrame:
        words, log = source.read_lexicon(self.spark, f"{self.folder}/lexicon/{self.base()}"), self.log()
        return words if log is None else source.delete_words(words, F.broadcast(log.where("part = 'words'").select("word")))

    def table(self, name: str) -> DataFrame:
        """A table of the present words: flags, surfaces or profile, as ``Lexicon`` asks for it."""
        table, log = self._base_table(name), self.log()
        if log is None:
            return table
        keys = made.KEYS[name]
        own = log.where(F.col("part") == name)
        newest = own.groupBy(*keys).agg(F.max("entry").alias("entry"))
        rows = own.where("live").join(F.broadcast(newest), [*keys, "entry"], "left_semi").select(*table.columns)
        return made.overlaid(table, newest.select(*keys), rows)

    def lexicon(self, rules: dict[str, StemRule] | None = None) -> made.Lexicon:
        return made.Lexicon(self.words(), rules, self.table)

    def _base_table(self, name: str) -> DataFrame:
        """The table of the words as they were last written, made when it is first asked for."""
        n = self.base()
        folder = f"{self.folder}/tables/{n}"
        if name not in [path.rsplit("/", 1)[-1] for path in source.files_in(self.spark, folder)]:
            before = {k: self._base_table(k) for k in list(made.MADE)[: list(made.MADE).index(name)]}
            words = source.read_lexicon(self.spark, f"{self.folder}/lexicon/{n}")
            self._write(made.MADE[name](words, before), name, n)
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}")

    def _write(self, table: DataFrame, name: str, n: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/tables/{n}/{name}")

    def delete(self, gone: DataFrame) -> int:
        """Takes the words in ``gone`` out and returns how many of them the dictionary had. Null, repeated and
        unknown words count for nothing."""
        hit = cut(self.words().join(gone.select("word").distinct(), "word", "left_semi"))
        n = hit.count()
        if n > AT_ONCE:
            self._rewrite(source.delete_words(self.words(), hit), {})
        elif n:
            self._append(hit)
            log = self.log()
            if self._last(f"log/{self.base()}") + 1 >= LOG_PARTS or log.limit(LOG_ROWS + 1).count() > LOG_ROWS:
                self.compact()
        return n

    def _append(self, hit: DataFrame) -> None:
        tables = {name: self.table(name) for name in made.MADE}
        left = source.delete_words(self.words(), F.broadcast(hit))
        base = self.base()
        k = self._last(f"log/{base}") + 1
        parts = [self._entry(hit, "words", False)]
        for name, (keys, rows) in made.changes(left, hit, tables).items():
            parts += [self._entry(keys, name, False), self._entry(rows, name, True)]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        # What a failed run has left under this number is not complete, and is replaced.
        every.withColumn("entry", F.lit(k)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/{base}/{k}")

    @staticmethod
    def _entry(rows: DataFrame, part: str, live: bool) -> DataFrame:
        fields = [field.split() for field in _VALUES.split(", ")]
        values = rows.selectExpr(*(f"CAST({name if name in rows.columns else 'NULL'} AS {kind}) AS {name}" for name, kind in fields))
        return values.withColumns({"live": F.lit(live), "part": F.lit(part)})

    def compact(self) -> None:
        """Writes words and tables anew with the log's changes made, so that the next log is empty."""
        self._rewrite(self.words(), {name: self.table(name) for name in made.MADE})

    def _rewrite(self, words: DataFrame, tables: dict[str, DataFrame]) -> None:
        """The tables first: the new number counts once its words are there."""
        n = self.base() + 1
        source.remove(self.spark, f"{self.folder}/tables/{n}")  # of a run that failed before its words were written
        for name, table in tables.items():
            self._write(table, name, n)
        words.write.mode("overwrite").text(f"{self.folder}/lexicon/{n}")
