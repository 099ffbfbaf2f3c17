"""Secret scans: candidates from patterns, false positives removed by a random forest.

A candidate is the value after a telling word with ``=`` or ``:`` (quoted or up to white space, from ``SHORT``
characters on), the password in ``scheme://user:password@host``, or a run of at least ``LEAST`` key characters
inside a word. Its features are its length, character transitions, dictionary coverage, path shape and neighbouring
words; a forest trained from labelled findings gives the probability that it is a secret. The dictionary is counted
from trusted texts. DataFrame functions and Spark's own forest only.

Rows: null and empty texts have no candidates. A null id is an id like others. Each candidate is one row, so repeated rows
repeat theirs, and a value that stands in a word twice is two rows. Texts are read whole; a long text only means more
candidates. Of candidates of equal kind and length in a labelled text the greater by code points, then the later, carries
the label. An empty table has no candidates and is returned by ``redact`` as it is. Extra columns stay; names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Collection, Sequence
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.words import bind, fold_ascii, free_name, split_words
from cohortlake.session import materialize

LEAST = 12
SHORT = 6
CORE = f"[A-Za-z0-9+/_\\-]{{{LEAST},}}"
TRAINING_ROWS = 12_000
DICTIONARY_WORDS = 4_000
SHELVES = 64
MASK = "[SECRET]"
FEATURES = [
    "length", "digits", "uppers", "lowers", "marks", "distinct", "turns", "vowels", "longest_letters", "part_length", "is_hex",
    "only_digits", "covered", "known_words", "path", "address", "after_sign", "assigned", "in_address", "called", "media",
    "secret_word", "harmless_word", "known_start",
]

# Word parts frequent in plain text of four languages.
GROUPS = (
    "tion the and ing ent ion her for tha nth int ere ter est ers ati hat ate all eth hes ver his oft ith fth sth oth "
    "res ont com per con pro pre ess men ive ect der die und ein sch ich nde cht ung gen lich heit keit ber für auf "
    "les que ent ait ous eau elle eux est dans pour une ment re de la el los las cion ado mente ando para por "
    "th he in er an re on at en nd or es st ti wh ed of is it al ar to nt sh ea ou ha le ly be as"
).split()
# Words frequent in names of programs.
CODE_WORDS = (
    "get set add new all the for from with list map item items index count size length name type value values key node "
    "file path data text string number user account page view model table column row query request response result "
    "error message handler event state config option default parse format write read open close load save update "
    "delete create build make find search filter sort group merge split join render client server service manager "
    "factory context session cache buffer stream thread test check is has can on to of by id url http json html"
).split()
SECRET_WORDS = "token|secret|password|passwd|pwd|passphrase|apikey|api_key|api-key|access_key|auth|bearer|credential|private_key|client_secret"
HARMLESS_WORDS = "commit|sha1|sha256|sha-1|md5|hash|digest|checksum|revision|rev|uuid|guid|build|version|isbn|invoice|order|phone|card|etag|blob|tree"
KNOWN_STARTS = "^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|eyJ|npm_|hf_)"


# A telling word that ends in a sign, and the value behind it.
SIGN = f"(?i:{SECRET_WORDS})s?[\"']?(?:=>|:=|[=:])"
INLINE = f"{SIGN}[\"'`]?([^\\s\"'`]{{{SHORT},}})"
INLINE_ADDRESS = f"{SIGN}([^\\s\"'`&#]{{{SHORT},}})"
TOLD = f"(?i:{SECRET_WORDS})s?[\"']? ?(?:=>|:=|[=:])$"
PASSWORD = f"://[^\\s/:@]*:([^\\s@]{{{SHORT},}})@"
TRAILING = "[\"'`,;)\\]}>]+[.]?$"


class Scanner(NamedTuple):
    """A trained forest and the dictionary its features use."""

    forest: RandomForestClassificationModel
    dictionary: tuple[str, ...]


def count_dictionary(df: DataFrame, text: str = "text", size: int = DICTIONARY_WORDS) -> tuple[str, ...]:
    """The ``size`` words of three letters or more that stand in most texts; ties by code point. Counted over all texts."""
    words = F.array_distinct(F.filter(split_words(F.lower(text)), lambda w: w.rlike("^\\p{L}{3,}$")))
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return tuple(r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect())


def _values(word: Column, previous: Column) -> Column:
    """Values in the word that a telling word or an address points at."""

    def taken(pattern: str) -> Column:
        return F.regexp_extract(word, pattern, 1)

    inline = F.when(word.contains("://"), taken(INLINE_ADDRESS)).otherwise(taken(INLINE))
    told = F.when(previous.rlike(TOLD), F.regexp_extract(word, f"^[\"'`(]*([^\"'`]{{{SHORT},}})", 1)).otherwise("")
    trimmed = F.transform(F.array(inline, told), lambda v: F.regexp_replace(v, TRAILING, ""))
    every = F.array_distinct(F.concat(trimmed, F.array(taken(PASSWORD))))
    return F.filter(every, lambda v: F.char_length(v) >= SHORT)


def candidates(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, place, word, before, core, previous, following, assigned``: candidates with their neighbours."""
    telling = F.col(text).rlike(f"(?i:{SECRET_WORDS})s?[\"']?\\s?[=:]|{PASSWORD}")
    place = F.when(F.coalesce(F.col(text).rlike(CORE) | telling, F.lit(False)), F.col(text))

    def near(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(F.char_length(w) >= SHORT, i)), lambda i: i.isNotNull())
        found = F.transform(
            hits,
            lambda i: F.struct(
                i.alias("place"),
                F.element_at(words, i + 1).alias("word"),
                F.concat_ws(" ", F.try_element_at(words, F.when(i > 1, i - 1)), F.try_element_at(words, F.when(i > 0, i))).alias("previous"),
                F.coalesce(F.try_element_at(words, i + 2), F.lit("")).alias("following"),
            ),
        )
        return F.filter(
            found, lambda x: x["word"].rlike(CORE) | x["previous"].rlike(TOLD) | x["word"].rlike(f"{SIGN}|{PASSWORD}")
        )

    rows = df.select(F.col(id_col).alias("id"), F.explode(bind(split_words(place), near)).alias("c")).select("id", "c.*")
    valued = rows.withColumn("values", _values(F.col("word"), F.col("previous")))
    runs = F.filter(
        F.regexp_extract_all("word", F.lit(CORE), F.lit(0)), lambda r: ~F.exists("values", lambda v: v.contains(r))
    )
    cores = F.concat(
        F.transform("values", lambda v: F.struct(v.alias("core"), F.lit(True).alias("assigned"))),
        F.transform(runs, lambda r: F.struct(r.alias("core"), F.lit(False).alias("assigned"))),
    )
    each = valued.select("id", "place", "word", "previous", "following", F.inline(cores))
    return each.withColumn("before", F.expr("left(word, locate(core, word) - 1)"))


def _lookup(words: Collection[str]) -> Callable[[Column], Column]:
    """Whether a word is among these: on the shelf of its checksum, one string each, so a plan holds few literals."""
    shelves = [" "] * SHELVES
    for w in sorted(words):
        shelves[zlib.crc32(w.encode()) % SHELVES] += w + " "
    books = F.array(*[F.lit(s) for s in shelves])
    return lambda x: F.get(books, (F.crc32(x.cast("binary")) % SHELVES).cast("int")).contains(F.concat(F.lit(" "), x, F.lit(" ")))


def with_features(found: DataFrame, dictionary: Sequence[str] = ()) -> DataFrame:
    """Numbers the forest decides by; see ``FEATURES``."""
    core, n = F.col("core"), F.char_length("core").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(core, F.lit(pattern)) / n

    turns = "(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"
    around = fold_ascii(F.concat_ws(" ", "previous", "before"))
    covered = 1 - F.char_length(F.regexp_replace(F.lower(core), "|".join(sorted(GROUPS, key=lambda w: (-len(w), w))), "")) / n
    parts = F.transform(F.regexp_extract_all(core, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), lambda x: F.lower(x))
    known = _lookup({*dictionary, *CODE_WORDS})
    letters = F.aggregate(
        F.filter(parts, known), F.lit(0), lambda total, x: total + F.char_length(x)
    )
    values = {
        "length": F.least(n, F.lit(200.0)),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(core, ""))) / n,
        "turns": share(turns),
        "vowels": share("[aeiouAEIOU]"),
        "longest_letters": F.array_max(F.transform(F.split(core, "[^A-Za-z]+"), lambda x: F.char_length(x))) / n,
        "part_length": F.regexp_count(core, F.lit("[A-Za-z]")) / F.greatest(F.size(parts), F.lit(1)),
        "is_hex": core.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "only_digits": core.rlike("^[0-9_\\-+]+$").cast("double"),
        "covered": covered,
        "known_words": letters / n,
        "path": (core.rlike("^/?([A-Za-z_\\-]+/)+") | F.col("word").rlike("\\.[a-z]{2,4}[.,;]?$")).cast("double"),
        "address": F.col("word").rlike("://|@|^www[.]").cast("double"),
        "after_sign": (F.col("before").rlike("[=:][\"']?$") | F.col("previous").rlike("[=:]$")).cast("double"),
        "assigned": F.col("assigned").cast("double"),
        "in_address": F.col("before").rlike("://[^/@]*:$").cast("double"),
        "called": F.expr("substr(word, locate(core, word) + char_length(core))").rlike("^[(\\[]").cast("double")
        + core.rlike("[(\\[]").cast("double"),
        "media": F.col("before").rlike("(image|font|audio|video|application)/[a-z0-9+.\\-]+;base64,$").cast("double"),
        "secret_word": around.rlike(f"({SECRET_WORDS})").cast("double"),
        "harmless_word": around.rlike(f"(^|[^a-z])({HARMLESS_WORDS})([^a-z]|$)").cast("double"),
        "known_start": core.rlike(KNOWN_STARTS).cast("double"),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})


def example_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings to start from: ``id, text, label``, one candidate in each text.

    Secrets are hash values in the known shapes, with and without telling words; the rest are
    what scanners report wrongly: revisions, checksums, identifiers, paths, addresses, card and
    order numbers, long words.
    """
    base = spark.range(rows).select("id", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512).alias("h"))
    h = F.col("h")
    alnum = F.translate(F.base64(F.unhex(h)), "+/=", "xY")
    upper = F.translate(F.upper(alnum), "0189", "ABCD")
    pick = [F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10).cast("int") for k in range(6)]
    parts = F.array(*[F.lit(w) for w in GROUPS])
    names = F.array(*[F.lit(w) for w in CODE_WORDS])

    def drawn(of: Column, size: int, seed: int) -> Column:
        return F.element_at(of, F.pmod(F.conv(F.substring(h, seed, 3), 16, 10).cast("int"), F.lit(size)) + 1)

    def word(seed: int, n: int) -> Column:
        return F.concat(*[drawn(parts, len(GROUPS), seed + 2 * k) for k in range(n)])

    def name(seed: int, n: int, sign: str) -> Column:
        """An identifier: half of its words from the fixed list, half made up."""
        each = [drawn(names, len(CODE_WORDS), seed + 3 * k) if k % 2 else word(seed + 3 * k, 2) for k in range(n)]
        return F.concat_ws(sign, *each) if sign else F.concat(each[0], *[F.initcap(w) for w in each[1:]])

    digits = F.translate(F.substring(h, 90, 12), "abcdef", "123456")
    simple = F.concat(word(20, 3), F.substring(digits, 1, 1), F.substring(h, 30, 1), F.substring(digits, 2, 2))
    mixed = F.concat(
        F.initcap(word(20, 2)), F.lit("@"), F.substring(alnum, 9, 3), F.lit("."), word(26, 1), F.lit("!"), F.substring(digits, 3, 4)
    )
    plain = [word(40, 2), word(50, 2)]
    key = F.element_at(F.array(*[F.lit(w) for w in SECRET_WORDS.split("|")]), F.pmod(pick[1], F.lit(SECRET_WORDS.count("|") + 1)) + 1)
    harmless = F.element_at(F.array(*[F.lit(w) for w in HARMLESS_WORDS.split("|")]), F.pmod(pick[1], F.lit(HARMLESS_WORDS.count("|") + 1)) + 1)
    size = F.pmod(pick[2], F.lit(34)) + 16
    shapes = [
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16))),
        (1, F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36))),
        (1, F.concat(F.lit("sk_live_"), F.substring(alnum, 5, 24))),
        (1, F.concat(F.lit("AIza"), F.substring(alnum, 3, 35))),
        (1, F.concat(key, F.lit(' = "'), F.expr("left(h, size)"), F.lit('"'))),
        (1, F.concat(key, F.lit("="), F.expr("left(h, size)"))),
        (1, F.concat(key, F.lit(": "), F.expr("left(alnum, size)"))),
        (1, F.concat(key, F.lit("="), F.expr("left(alnum, size)"))),
        (1, F.concat(F.lit("bearer "), F.expr("left(alnum, size)"))),
        (1, F.concat(key, F.lit("="), simple)),
        (1, F.concat(key, F.lit(": "), simple)),
        (1, F.concat(key, F.lit(": "), mixed)),
        (1, F.concat(key, F.lit(" = '"), mixed, F.lit("'"))),
        (1, F.concat(F.lit("postgres://"), word(80, 1), F.lit(":"), simple, F.lit("@"), word(84, 2), F.lit("/db"))),
        (1, F.concat(F.lit("mysql://"), word(80, 1), F.lit(":"), F.substring(alnum, 7, 9), F.lit("@"), word(84, 2), F.lit("/db"))),
        (1, F.concat(key, F.lit("="), F.substring(h, 1, 8))),
        (0, F.concat(harmless, F.lit(" "), F.substring(h, 1, 40))),
        (0, F.concat(key, F.lit(": "), word(60, 4))),
        (0, F.concat(key, F.lit(": "), drawn(names, len(CODE_WORDS), 60), drawn(names, len(CODE_WORDS), 64))),
        (0, F.concat(key, F.lit(" = "), name(60, 3, ""), F.lit("()"))),
        (0, F.concat(key, F.lit("="), name(60, 3, "_"), F.lit("(x)"))),
        (0, name(60, 4, "")),
        (0, name(60, 7, "")),
        (0, name(60, 4, "_")),
        (0, F.concat(name(60, 3, ""), F.lit("."), name(75, 3, ""), F.lit("(a,b)"))),
        (0, F.concat(F.lit('src="data:image/png;base64,'), F.substring(F.base64(F.unhex(F.concat(h, h))), 1, 150), F.lit('"'))),
        (0, F.concat(F.lit("url(data:font/woff2;base64,"), F.substring(F.base64(F.unhex(h)), 1, 80), F.lit(")"))),
        (0, F.concat(harmless, F.lit(": "), F.substring(h, 1, 32))),
        (0, F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))),
        (0, word(60, 6)),
        (0, F.concat(F.initcap(word(70, 7)), F.lit("."))),
        (0, F.upper(word(70, 7))),
        (0, F.concat(word(60, 4), F.lit("-"), word(80, 4))),
        (0, F.concat(F.lit("/"), word(60, 2), F.lit("/"), word(66, 2), F.lit("/"), word(72, 3), F.lit(".py"))),
        (0, F.concat(F.lit("https://"), word(60, 3), F.lit(".example/"), word(66, 3), F.lit("/"), word(72, 3))),
        (0, F.translate(F.substring(h, 1, 16), "abcdef", "123456")),
        (0, F.concat(word(60, 5), F.lit("_"), word(80, 2), F.pmod(pick[3], F.lit(100)).cast("string"))),
        (0, F.concat(word(60, 3), F.lit("."), F.substring(h, 1, 2), F.lit("@mail.example.com/"), word(80, 5))),
        (0, F.concat(F.lit("file "), F.substring(h, 1, 40), F.lit(".json"))),
    ]
    base = base.select(
        "id", "h", alnum.alias("alnum"), size.alias("size"), F.pmod("id", F.lit(len(shapes))).alias("shape"), *[p.alias(f"p{k}") for k, p in enumerate(plain)]
    )
    label = F.element_at(F.array(*[F.lit(good) for good, _ in shapes]), F.col("shape").cast("int") + 1)
    body = F.when(F.col("shape") == 0, shapes[0][1])
    for k, (_, shape) in enumerate(shapes[1:], 1):
        body = body.when(F.col("shape") == k, shape)
    return base.select("id", F.concat_ws(" ", "p0", body, "p1").alias("text"), label.cast("double").alias("label"))


def train(labelled: DataFrame, dictionary: Sequence[str] = (), rows: int = TRAINING_ROWS) -> Scanner:
    """A scanner from ``id, text, label``; at most ``rows`` findings are used. ``dictionary``: see ``count_dictionary``.

    The longest candidate of a text carries its label, values of telling words before others.
    """
    # Written in between: the forest reads its rows many times, and the plans of what made them are long.
    labelled = materialize(labelled.select("id", "text", "label"), "labelled")
    texts = labelled.orderBy(F.xxhash64("id", "text")).limit(rows)
    found = candidates(texts, "id", "text")
    columns = ["place", "word", "previous", "following", "core", "before", "assigned"]
    widest = F.max_by(F.struct(*columns), F.struct("assigned", F.char_length("core"), "core", "place"))
    one = found.groupBy("id").agg(widest.alias("c")).select("id", "c.*").join(labelled.select("id", "label"), "id")
    one = materialize(one, "labelled-candidates")
    numbers = materialize(_numbers(one, dictionary).select(*FEATURES, "label"), "findings")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(numbers)
    forest = RandomForestClassifier(numTrees=40, maxDepth=8, seed=11, featureSubsetStrategy="onethird")
    return Scanner(forest.fit(vectors.select("features", "label")), tuple(dictionary))


def _numbers(found: DataFrame, dictionary: Sequence[str]) -> DataFrame:
    """The features, with the mark of an assigned value kept beside its number."""
    return with_features(found.withColumn("is_value", F.col("assigned")), dictionary)


def _judged(df: DataFrame, scanner: Scanner, id_col: str, text: str, threshold: float) -> DataFrame:
    numbers = _numbers(candidates(df, id_col, text), scanner.dictionary)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(numbers)
    probability = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scanner.forest.transform(vectors).withColumn("chance", probability).withColumn("is_secret", F.col("chance") >= threshold)


def scan(
    df: DataFrame,
    scanner: Scanner,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """``id, place, core, probability, is_secret`` of every candidate; ``place``: its word's number from 0."""
    judged = _judged(df, scanner, id_col, text, threshold)
    return judged.select("id", "place", "core", F.col("chance").alias("probability"), "is_secret")


def _quoted(value: Column) -> Column:
    """A pattern for exactly this text."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def redact(
    df: DataFrame,
    scanner: Scanner,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """The table with every found secret replaced by ``MASK``; no row goes, other columns stay.

    A secret of ``LEAST`` characters or more goes wherever it stands in the text; a shorter one, which may
    be a word of its own elsewhere, where it follows what it was found behind.
    """
    names = free_name(df, "found_content", "found_secrets")
    keyed = df.select(F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    last = F.element_at(F.split(F.col("previous"), " "), -1)
    lead = F.when(
        F.col("is_value") & ~F.col("before").rlike(f"{SIGN}|:$"), F.concat(_quoted(last), F.lit("[\\x20\\x09-\\x0D]+"), _quoted(F.col("before")))
    ).otherwise(_quoted(F.col("before")))
    size = F.char_length("core")
    pattern = F.when(size < LEAST, F.concat(F.lit("("), lead, F.lit(")"), _quoted(F.col("core"))))
    found = _judged(keyed, scanner, "content", "text", threshold).where("is_secret")
    each = found.groupBy("id").agg(F.collect_set(F.struct(size.alias("n"), F.col("core").alias("c"), F.coalesce(pattern, F.lit("")).alias("p"))).alias("cores"))
    # A document's secrets are bounded by its text; equal texts share one row here.
    secrets = materialize(
        each.select(
            F.col("id").alias(names["found_content"]),
            F.reverse(F.array_sort("cores")).alias(names["found_secrets"]),
        ),
        "secrets",
    )
    joined = df.join(secrets, F.xxhash64(text) == F.col(names["found_content"]), "left")
    clean = F.aggregate(
        F.coalesce(names["found_secrets"], F.array().cast("array<struct<n:int,c:string,p:string>>")),
        F.col(text),
        lambda t, s: F.when(s["p"] == "", F.replace(t, s["c"], F.lit(MASK))).otherwise(
            F.regexp_replace(t, s["p"], F.lit("$1" + MASK))
        ),
    )
    return joined.withColumn(text, clean).select(df.columns)
