"""Quality rules per document and cross-document line frequency, in DataFrame functions.

Lines are normalised (trimmed, A-Z lowered, digits to 0) and hashed. For each host and line the
distinct documents that hold it are counted; documents of equal text count once, so copies do
not turn their own lines into boilerplate. A line above the limit - in ``least_documents`` of the
host's distinct documents or, on small hosts, in more than ``line_percent`` of them and at least
``fewest_documents`` - is removed everywhere but in the first document that holds it. A document
is depleted and rejected when more than ``depleted_percent`` of its words are removed, or when
lines are removed and fewer than ``least_words`` words are left.

Rows: a null text has no words and fails the base rules. Null hosts are one host. Repeated
rows get equal results; texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.bitmaps import BITS, bitmap, may_hold
from cohortlake.llm.words import SPACES, bind, count_words, fold_ascii, split_words, trim_spaces
from cohortlake.operators.skew import join_null_safe, skew_join
from cohortlake.session import materialize

SYMBOLS = "#*$%&|<>"
FEW_REPEATS = 32


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that stands twice or more in the text.

    Window hashes are sorted once; equal neighbours are repeats. With few of them their places
    are looked up; with many, hashes are sorted together with their places.
    """

    def covered(places: Column) -> Column:
        """Words in the union of the windows at ascending places."""
        return bind(
            places,
            lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(
                F.aggregate(
                    p,
                    F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
                    lambda acc, x: F.struct(
                        x.alias("last"), (acc["n"] + F.least(F.lit(width), x - acc["last"])).alias("n")
                    ),
                    lambda acc: acc["n"],
                )
            ),
        )

    def by_lookup(windows: Column, repeats: Column) -> Column:
        return bind(
            repeats,
            lambda r: covered(
                F.filter(
                    F.transform(windows, lambda h, i: F.when(F.array_contains(r, h), i)), lambda x: x.isNotNull()
                )
            ),
        )

    def by_sorting(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hit = bind(
            placed,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        F.coalesce(F.try_element_at(s, k + 2)["h"] == x["h"], F.lit(False))
                        | ((k > 0) & (F.element_at(s, F.greatest(k, F.lit(1)))["h"] == x["h"])),
                        x["i"],
                    ),
                ),
                lambda x: x.isNotNull(),
            ),
        )
        return covered(F.sort_array(hit))

    def repeats_of(windows: Column) -> Column:
        return F.array_distinct(
            bind(
                F.sort_array(windows),
                lambda s: F.filter(s, lambda h, k: (k > 0) & (F.element_at(s, F.greatest(k, F.lit(1))) == h)),
            )
        )

    def count(windows: Column) -> Column:
        return bind(
            repeats_of(windows),
            lambda r: F.when(F.size(r) == 0, F.lit(0))
            .when(F.size(r) <= FEW_REPEATS, by_lookup(windows, r))
            .otherwise(by_sorting(windows)),
        )

    def windows_of(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - (width - 1)),
            lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]),
        )

    return F.when(F.size(words) < width, F.lit(0)).otherwise(bind(windows_of(words), count)).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    """Counts of one document's text."""
    content = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(content, "\n", -1), lambda x: trim_spaces(x) != "")
    numbers = bind(
        split_words(content),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    return {
        "numbers": numbers,
        "word_chars": F.char_length(_without(content, SPACES)).cast("long"),
        "n_symbols": (F.char_length(content) - F.char_length(_without(content, SYMBOLS))).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def line_hash(line: Column) -> Column:
    """Hash of the normalised line."""
    return F.xxhash64(F.regexp_replace(fold_ascii(trim_spaces(line)), "[0-9]", "0"))


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines whose hashes are in ``dropped``; unchanged where that is null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: (trim_spaces(x) == "") | ~F.array_contains(dropped, line_hash(x)))
    return F.when(dropped.isNull(), text).otherwise(F.array_join(lines, "\n"))


def frequent_lines(
    df: DataFrame, host: str, text: str, id_col: str, line_percent: int, least_documents: int, fewest_documents: int
) -> DataFrame:
    """``host, line, first_id, lines`` of the lines above the limit."""
    lines = _lines(df, host, text, id_col)
    distinct = lines.groupBy("host", "line", "content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    per_line = distinct.groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("documents"), F.min("id").alias("first_id"), F.sum("rows").alias("rows")
    )
    hosts = (
        df.select(F.col(host).alias("host"), F.xxhash64(text).alias("content"))
        .groupBy("host", "content")
        .agg(F.lit(1).alias("one"))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("host_documents"))
    )
    # Only lines of many documents meet the host table, so no host is hot there.
    often = materialize(per_line.where(F.col("documents") >= min(least_documents, fewest_documents)), "often")
    counted = skew_join(often, materialize(hosts, "hosts"), ["host"])
    large_share = (F.col("documents") >= fewest_documents) & (
        F.col("documents") * 100 > F.col("host_documents") * line_percent
    )
    return counted.where((F.col("documents") >= least_documents) | large_share).select("host", "line", "first_id", "rows")


def _lines(df: DataFrame, host: str, text: str, id_col: str) -> DataFrame:
    """``id, host, content, line``: the lines with a word of each document, hashed."""
    normal = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: trim_spaces(x) != "")
    return df.select(
        F.col(id_col).alias("id"), F.col(host).alias("host"), F.xxhash64(text).alias("content"),
        F.explode(F.transform(normal, line_hash)).alias("line"),
    )


def _without_frequent(rows: DataFrame, lines: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``dropped``, the hashes of their removed lines, null for none.

    Two bitmaps of fixed size come before the joins: one keeps nearly all lines out that are not frequent, one the
    texts that lose no line. Those stay where they are; the others are shuffled once, by one plan at any size.
    """
    line = F.xxhash64("host", "line")
    possible = lines.where(may_hold(bitmap(frequent.select(line), bits), line, bits))
    found = skew_join(possible, frequent, ["host", "line"], rows="rows")
    # A document's removed lines are bounded by its text; repeated rows share one row here.
    removed = materialize(
        found.where(~F.coalesce(F.col("id") == F.col("first_id"), F.lit(False)))
        .groupBy("id", "host", "content")
        .agg(F.collect_set("line").alias("dropped")),
        "removed",
    )
    text = F.xxhash64("id", "content")
    loses = may_hold(bitmap(removed.select(text), bits), text, bits)
    moved = join_null_safe(rows.where(loses).hint("merge"), removed, ["id", "host", "content"], "left")
    return moved.unionByName(rows.where(~loses).withColumn("dropped", F.lit(None).cast("array<long>")))


def _verdicts(
    df: DataFrame,
    carried: list[str],
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    least_words: int = 50,
    repeat_percent: int = 50,
    line_percent: int = 10,
    least_documents: int = 20,
    fewest_documents: int = 5,
    depleted_percent: int = 50,
    bits: int = BITS,
) -> DataFrame:
    """What ``judge`` says of each row, and ``carried``: a struct of these columns of the table."""
    often = frequent_lines(df, host, text, id_col, line_percent, least_documents, fewest_documents)
    frequent = materialize(often, "frequent")
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(host).alias("host"),
        F.xxhash64(text).alias("content"),
        F.col(text).alias("whole"),
        F.struct(F.lit(0).alias("_none"), *carried).alias("carried"),
        *[c.alias(name) for name, c in base_counts(F.col(text)).items()],
    ).select("*", "numbers.*")
    dropped = _without_frequent(rows, _lines(df, host, text, id_col), frequent, bits)
    joined = dropped.withColumn("clean_text", without_lines(F.col("whole"), F.col("dropped")))
    gone = F.when(F.col("dropped").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_words") - count_words(F.col("clean_text")))
    failed = (F.col("n_words") < least_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent
    )
    short = (F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < least_words)
    depleted = short | (F.col("removed_words") * 100 > F.col("n_words") * depleted_percent)
    return joined.withColumn("removed_words", gone).select(
        "id", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "clean_text", "carried",
    )


def judge(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``id, content`` (a hash of the text), the base counts, ``removed_words``, ``base_failed``, ``kept``, ``clean_text``.

    ``clean_text`` is the text without its removed lines. ``limits``: those of ``_verdicts``.
    """
    return _verdicts(df, [], id_col, text, host, **limits).drop("carried")


def keep_good(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of the documents that pass, their texts without the removed lines."""
    others = [c for c in df.columns if c != text]
    verdicts = _verdicts(df, others, id_col, text, host, **limits)
    columns = [(F.col("clean_text") if c == text else F.col("carried")[c]).alias(c) for c in df.columns]
    # A filter on ``kept`` would be pushed below, and all that it stands for computed twice.
    row = F.struct(F.col("kept").alias("good"), F.struct(*columns).alias("row"))
    return verdicts.select(F.inline(F.filter(F.array(row), lambda r: r["good"]))).select("row.*")
