"""Repeated runs of lines by winnowing, with DataFrame operations only.

A window is the shortest run of whole lines with at least WORDS words that begins at a line (or, the other way, ends at it). The least line
hash of every window is its fingerprint. Two equal runs of at least WORDS words hold equal windows, so they share a fingerprint
at the same place: fingerprints that occur in one place only are left out after one small aggregate. Windows at the others
are joined by their whole content. The windows that begin in a repeated run extend a match to its first line, those that end in
it to its last, so that a later repeated run is deleted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runtally.llm.rows import kept

#: Words from which on a repeated run is deleted. A line has one word more than it has spaces.
WORDS = 50

_FIRST = -(1 << 63)


def _identity(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """What tells rows apart and orders them: the key (null first), then a hash of the text."""
    return F.coalesce(docs[key].cast("long"), F.lit(_FIRST)), F.xxhash64(docs[text])


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """o, th (the row), pos, h (hash), u (words) of every line; rows that repeat key and text count once."""
    order, hashed = _identity(docs, key, text)
    rows = docs.where(docs[text].isNotNull()).select(order.alias("o"), hashed.alias("th"), F.posexplode(F.split(docs[text], "\n")).alias("pos", "line"))
    words = F.length("line") - F.length(F.translate("line", " ", "")) + 1
    return rows.select("o", "th", "pos", F.xxhash64("line").alias("h"), words.cast("long").alias("u")).groupBy("o", "th", "pos").agg(
        F.first("h").alias("h"), F.first("u").alias("u"))


def windows(lined: DataFrame, words: int = WORDS) -> DataFrame:
    """o, th, i, j (first and last line), f (fingerprint), at (its line), w (hash of the content) of all full windows of both directions."""
    row = Window.partitionBy("o", "th")
    upto = F.sum("u").over(row.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    summed = lined.withColumn("e", upto).withColumn("b", F.col("e") - F.col("u"))
    ahead, back = row.orderBy("b").rangeBetween(0, words - 1), row.orderBy("e").rangeBetween(-(words - 1), 0)

    def over(frame, first, last):
        least = F.min(F.struct("h", "pos")).over(frame)
        return F.struct(first.alias("i"), last.alias("j"), least["h"].alias("f"), least["pos"].alias("at"),
                        F.xxhash64(F.collect_list("h").over(frame)).alias("w"), F.sum("u").over(frame).alias("n"))

    both = summed.select("o", "th", over(ahead, F.col("pos"), F.max("pos").over(ahead)).alias("x"), over(back, F.min("pos").over(back), F.col("pos")).alias("y"))
    return both.select("o", "th", F.explode(F.array("x", "y")).alias("z")).select("o", "th", "z.*").where(F.col("n") >= words).drop("n")


def repeated_runs(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """o, th, runs (array of first and last lines) to delete: maximal unions of windows that occurred before.

    A window occurs where the row is least, then the line; within a document an occurrence that overlaps the first is let be. Hot
    lines and passages are reduced to their first place by aggregates that combine before the shuffle.
    """
    every = windows(lines(docs, key, text), words)
    place = F.xxhash64("o", "th", "at")
    marks = every.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    shared = kept(marks.where("a <> z").select("f"))
    some = kept(every.join(shared, "f"))
    firsts = kept(some.groupBy("f", "w").agg(F.min(F.struct("o", "th", "i", "j")).alias("first"), F.max(F.struct("o", "th", "i")).alias("last")).where(
        "first.o <> last.o or first.th <> last.th or first.i <> last.i").select("f", "w", "first"))
    same = (F.col("o") == F.col("first.o")) & (F.col("th") == F.col("first.th"))
    later = some.join(firsts, ["f", "w"]).where(~(same & (F.col("i") <= F.col("first.j")))).select("o", "th", "i", "j").distinct()
    row = Window.partitionBy("o", "th").orderBy("i", "j")
    reach = F.max("j").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("new", F.coalesce(F.col("i") > reach + 1, F.lit(True)).cast("int"))
    runs = opened.withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0))).groupBy("o", "th", "run").agg(
        F.min("i").alias("i"), F.max("j").alias("j"))
    return runs.groupBy("o", "th").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("runs"))


def _applied(docs: DataFrame, words: int, key: str, text: str) -> tuple[DataFrame, Column, Column]:
    """Rows as (row, o, th, runs), and the columns of all lines and of those that stay."""
    order, hashed = _identity(docs, key, text)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), order.alias("o"), hashed.alias("th"))
    runs = kept(repeated_runs(docs, words, key, text))
    found = rows.join(runs, ["o", "th"], "left")
    every = F.split(F.col("row")[text], "\n")
    stay = F.when(F.col("runs").isNull(), every).otherwise(F.filter(every, lambda x, p: ~F.exists("runs", lambda r: p.between(r["i"], r["j"]))))
    return found, every, stay


def delete_repeats(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows, all their columns, without later repeated runs of lines; rows of which nothing is left go.

    Null texts and texts without such runs stay as they are. ``n_chars``, if there, is counted anew where lines go. Rows that
    repeat key and text are treated alike; rows with a null key come before all others; an empty table gives an empty result.
    """
    found, _, stay = _applied(docs, words, key, text)
    changed = found.withColumn("stay", F.when(F.col("runs").isNotNull(), stay)).where(F.col("runs").isNull() | (F.size("stay") > 0))
    new = F.array_join("stay", "\n")

    def column(c: str) -> Column:
        old = F.col("row")[c]
        if c == text:
            old = F.when(F.col("runs").isNull(), old).otherwise(new)
        elif c == n_chars:
            old = F.when(F.col("runs").isNull(), old).otherwise(F.length(new).cast(docs.schema[c].dataType))
        return old.alias(c)

    return changed.select(*[column(c) for c in docs.columns])


def report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars_left, left_sha256 of every row: what stays of its text; a null text has no lines and stays null."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, every, stay = _applied(few, words, "doc_id", "text")
    left = found.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(F.size(F.when(F.col("row.text").isNotNull(), every)), F.lit(0)).alias("lines"), stay.alias("stay"), F.col("row.text").isNull().alias("none"))
    text = F.when(~F.col("none"), F.array_join("stay", "\n"))
    return left.select("doc_id", F.when(F.col("none"), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"),
                       F.when(F.col("none"), 0).otherwise(F.col("lines") - F.size("stay")).cast("long").alias("n_removed"),
                       F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("left_sha256"))
