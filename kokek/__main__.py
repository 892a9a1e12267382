"""``python -m kokek FOLDER [COMMAND ...]``: the working modes from a command line or a menu."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kokek.checkpoints import cut
from kokek.operators.render import option_view, parse_choices
from kokek.session import Session
from kokek.sources import text as source

HELP = """eval WORD ...        the best analysis of each word
options WORD         all analyses of a word, numbered for choosing
train WORD NUMBERS   confirms the analyses with these numbers and learns from them
auto N               options of N words drawn from the dictionary
relearn              learns all confirmed analyses again
sample FILE OUT      annotates a text file
delete WORD ...      removes words from the dictionary
stats                counts and losses
save                 keeps what was learnt so far, whatever is answered on leaving
help, quit

A word by itself lists its analyses and asks for the numbers of the right ones (s skips it, q leaves). On leaving,
what was learnt since the last save is kept or forgotten; every tenth example saves."""

#: Examples after which the menu saves.
SAVED = 10


def _table(rows: DataFrame) -> list[str]:
    return ["\t".join("" if v is None else str(v) for v in r) for r in rows.collect()]


def _options(session: Session, words: DataFrame) -> DataFrame:
    return option_view(session.analyze(words).withColumn("score", F.coalesce("score", F.lit(0.0)))).orderBy("word", "line")


def run(session: Session, line: str) -> list[str]:
    """The lines that answer one command; its name may be written in any case."""
    name, *rest = line.split() or [""]
    spark, name = session.spark, name.lower()
    words = lambda: spark.createDataFrame([(w.lower(),) for w in rest], "word string")
    if name == "eval" and rest:
        return _table(session.evaluate(words()).select("word", "analysis", "score", "suffixes_str").orderBy("word"))
    if name == "options" and len(rest) == 1:
        return _table(_options(session, words()).select("line"))
    if name == "train" and len(rest) > 1:
        found = session.analyze(spark.createDataFrame([(rest[0].lower(),)], "word string"))
        ranked = option_view(found.withColumn("score", F.coalesce("score", F.lit(0.0)))).select("word", "cand_ord", F.substring_index("line", ".", 1).cast("int").alias("shown"))
        line = spark.createDataFrame([(" ".join(rest[1:]),)], "line string")
        chosen = line.select(F.explode(parse_choices(F.col("line"), found.count())).alias("shown")).join(ranked, "shown").select("word", "cand_ord")
        out = _table(session.train(chosen))
        return [*(out or ["no such choice"]), f"examples so far: {session.count()}"]
    if name == "auto" and len(rest) == 1 and rest[0].isdigit():
        drawn = cut(source.draw_words(session.words(), int(rest[0]), seed=session.count()))
        return _table(_options(session, drawn).select("word", "line"))
    if name == "relearn" and not rest:
        r = session.relearn().first()
        return [f"trained: {r.n_matched}", f"skipped: {r.n_skipped}", f"final loss: {session.stats().first().latest}", f"examples so far: {session.count()}", "batch training complete"]
    if name == "sample" and len(rest) == 2:
        session.sample_file(rest[0], rest[1])
        return [f"written: {rest[1]}"]
    if name == "delete" and rest:
        return [f"deleted: {session.delete(words())}"]
    if name == "stats" and not rest:
        return [f"{k}: {v}" for k, v in session.stats().first().asDict().items()] + [f"examples: {session.count()}"]
    return HELP.splitlines()


def _asked(session: Session, word: str, lines: Iterator[str]) -> str | None:
    """Lists a word's analyses and confirms those that the next line names: deleted, trained or skipped; None
    to leave."""
    answer = run(session, f"options {word}")
    if len(answer) < 2:
        print(f"{word}: {'one analysis only' if answer else 'no analysis'}")
        return "skipped"
    print("\n".join([word, *answer, "numbers of the right ones, s to skip, q to leave:"]))
    chosen = next(lines, "q").strip().lower()
    if chosen in ("q", "quit"):
        return None
    if chosen in ("s", "skip"):
        return "skipped"
    before = session.words().count()
    out = run(session, f"train {word} {chosen}")
    print("\n".join(out))
    return "skipped" if out[0] == "no such choice" else "deleted" if session.words().count() < before else "trained"


def _auto(session: Session, n: int, lines: Iterator[str]) -> list[str]:
    """Asks about words drawn from the dictionary, one after another, until ``n`` are done or it is left."""
    done: list[str] = []
    for r in cut(source.draw_words(session.words(), n, seed=session.count())).collect():  # as many as are asked about
        how = _asked(session, r.word, lines)
        if how is None:
            break
        done.append(how)
    return ["auto mode summary", f"processed: {len(done)}", f"deleted: {done.count('deleted')}", f"skipped: {done.count('skipped')}"]


def menu(session: Session, lines: Iterable[str]) -> None:
    """Answers commands and words; on leaving, the next line says whether to keep what was learnt (y or n)."""
    print(HELP)
    lines = iter(lines)
    kept, counted = session.snapshot(), session.count()
    names = {"eval", "options", "train", "relearn", "sample", "delete", "stats", "help"}
    for line in lines:
        words = line.strip().lower().split()
        how: str | None = ""
        if not words:
            continue
        if words[0] in ("quit", "q"):
            how = None
        elif words == ["save"]:
            kept, counted = session.snapshot(), session.count()
            print(f"saved: {kept}")
        elif words[0] == "auto" and len(words) == 2 and words[1].isdigit():
            print("\n".join(_auto(session, int(words[1]), lines)))
        elif len(words) == 1 and words[0] not in names:
            how = _asked(session, words[0], lines)
        else:
            print("\n".join(run(session, line)))
        if session.count() // SAVED > counted // SAVED or words[0] == "relearn":
            kept, counted = session.snapshot(), session.count()
        if how is None:
            break
    if session.snapshot() > kept:
        print("keep what was learnt? (y/n)")
        if next(lines, "y").strip().lower() != "y":
            print(f"forgotten: {session.discard(kept)}")


if __name__ == "__main__":
    if len(sys.argv) < 2:
        raise SystemExit(__doc__)
    session = Session(SparkSession.builder.appName("kokek").getOrCreate(), sys.argv[1])
    if len(sys.argv) > 2:
        print("\n".join(run(session, " ".join(sys.argv[2:]))))
    else:
        menu(session, sys.stdin)
