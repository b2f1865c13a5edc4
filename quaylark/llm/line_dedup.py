"""Exact set-similarity join over the lines of all documents; later matches go.

A line's tokens are its distinct words, as written, between ASCII white space. Lines with equal sets are one
class, shown by its first line; only classes are joined. Tokens are ordered by rarity: a coarse logarithm of
the count of all tokens of the corpus by hashed bucket, least first, ties by hash. Two sets at the threshold
share a token of the prefixes that their sizes ask for, the shorter one's index prefix and the longer one's
probe prefix; length, position and a parity signature drop most pairs in the join's condition. Every match
between classes is verified on the words themselves. One match is enough: before the join each line meets the
first lines with its rarest tokens, and lines that match there are only met as the earlier one. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import fresh, released, staged, within

#: Buckets of the corpus count of tokens: a bound on what every task gets.
BUCKETS = 1 << 18
#: Lines of more words have a parity signature of 128 bits, others of 64.
LONG = 64
#: Of so many tokens at most of its index prefix each line meets the first lines, before the join.
RAREST = 8
#: Lets a lambda read the levels, which are a scalar subquery.
IN_LAMBDA = "spark.sql.analyzer.allowSubqueryExpressionsInLambdasOrHigherOrderFunctions"
WHERE = ["id", "line_no"]


def _spaced(text: Column) -> Column:
    """text with white space other than the newline as spaces; most texts hold none and stay as they are. They are
    looked for in the bytes, which takes a fraction of the time that it takes in a string."""
    held = lambda c: F.contains(text.cast("binary"), F.lit(c))
    other = held(b"\t") | held(b"\r") | held(b"\x0b") | held(b"\x0c")
    return F.when(other, F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text)


def words(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(line, " "), ""))


def _bucket(hashed: Column) -> Column:
    """The bucket of a word, by its xxhash64."""
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _levels(texts: DataFrame) -> Column:
    """An array of BUCKETS levels, 0 to 127, that rise with the logarithm of a bucket's count of tokens over all
    texts, in the highest byte of longs, as a scalar subquery: it is no part of the plan's text."""
    all_words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")
    counts = texts.select(F.explode(all_words).alias("word")).select(_bucket(F.xxhash64("word")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    level = F.coalesce(F.least(F.floor(F.log2("c") * 3), F.lit(127)), F.lit(0)).cast("long")
    every = texts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.shiftleft(level, 56).alias("level"))
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    some = every.groupBy(F.shiftright("bucket", 10).alias("part")).agg(ordered("bucket", "level").alias("levels"))
    return some.agg(F.flatten(ordered("part", "levels"))).scalar()


def _exploded(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _before(x: str, y: str) -> Column:
    """Whether line x is earlier than line y."""
    return (F.col(f"{x}.id") < F.col(f"{y}.id")) | ((F.col(f"{x}.id") == F.col(f"{y}.id")) & (F.col(f"{x}.line_no") < F.col(f"{y}.line_no")))


def _few_apart(percent: int, words: Column | None = None) -> Column:
    """Whether x and y, of so many words together, can match by their parities: a bit in which the parities of x and y differ is a word that one of them lacks."""
    differ = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    (a, b), (c, d) = ((F.col(f"{x}.bits"), F.col(f"{x}.more")) for x in "xy")
    fold = lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))
    apart = F.when(b.isNotNull() & d.isNotNull(), differ(a, c) + differ(b, d)).otherwise(differ(fold(a, b), fold(c, d)))
    both = F.col("x.n") + F.col("y.n") if words is None else words
    return apart * (100 + percent) <= both * (100 - percent)


def _pairs(met: DataFrame, earlier: str = "x", later: str = "y") -> DataFrame:
    return met.select(F.col(f"{earlier}.id").alias("a"), F.col(f"{earlier}.line_no").alias("a_no"), F.col(f"{later}.id").alias("b"), F.col(f"{later}.line_no").alias("b_no"))


def _named(pairs: DataFrame) -> DataFrame:
    """(id, line_no) of the lines in pairs, written."""
    a, b = (pairs.select(F.col(x).alias("id"), F.col(f"{x}_no").alias("line_no")) for x in "ab")
    return staged(a.distinct().unionByName(b.distinct()).distinct())


def _picked(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(id, line_no, words, n) of the lines in named. Filters drop most other texts and lines where they are read;
    what they let through is shuffled and joined."""
    lines = within(_exploded(within(texts, named, ["id"])), named, WHERE)
    # an inner join, as a semi join would be pushed below the filters; a row that repeats an id has lines of
    # the same numbers: all of them stand for the number
    picked = lines.join(named, WHERE).select(*WHERE, words(F.col("line")).alias("words"))
    return staged(picked.withColumn("n", F.size("words")))


def _beside(pairs: DataFrame, lines: DataFrame, *columns: str) -> DataFrame:
    """pairs with columns of both lines; one line's travel with the pair, the other's wait there."""
    for side in "ab":
        own = lines.select(F.col("id").alias(side), F.col("line_no").alias(f"{side}_no"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        pairs = pairs.join(own, [side, f"{side}_no"])
    return pairs


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(id, line_no) once, of the later lines of the pairs whose words match; drops pairs."""
    named = _named(pairs)
    lines = _picked(texts, named)
    shared = F.size(F.array_intersect("a_words", "b_words"))
    match = shared * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent
    out = staged(_beside(pairs, lines, "n", "words").where(match).select(F.col("b").alias("id"), F.col("b_no").alias("line_no")).distinct())
    released(pairs, named, lines)
    return out


def _sets(texts: DataFrame, percent: int) -> DataFrame:
    """(id, line_no, n, set, set2, prefix, bits, more) of each line. A word counts in the parity bits, or in more if
    its hash is below 0 and the line has over LONG words."""
    spark, levels = texts.sparkSession, _levels(texts)
    # a lambda is interpreted, so its time is that of its parts: levels come shifted, places stay longs. Never null,
    # so that arrays of keys are sorted as longs
    key = lambda h: F.coalesce(F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 8))
    # two spaces leave an empty word
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    lines = _exploded(texts).select(*WHERE, hashes.alias("hashes"))
    before = spark.conf.get(IN_LAMBDA, None)
    spark.conf.set(IN_LAMBDA, "true")
    try:
        lines = lines.select(*WHERE, "hashes", F.sort_array(F.transform("hashes", key)).alias("keys"))
    finally:
        spark.conf.unset(IN_LAMBDA) if before is None else spark.conf.set(IN_LAMBDA, before)
    n = F.size("keys")
    # of fewer words than joins, only equal sets match; at 100 percent none joins
    joins = n >= -(-percent // (100 - percent)) if percent < 100 else F.lit(False)
    prefix = F.slice("keys", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    # sorted with a 0 of their own, the hashes below 0 come before it: no lambda has to tell them apart
    halves = F.when(joins & (n > LONG), F.sort_array(F.concat("hashes", F.array(F.lit(0).cast("long")))))
    lines = lines.select("*", halves.alias("halves")).select("*", F.array_position("halves", F.lit(0).cast("long")).cast("int").alias("zero"))
    words = F.when(n > LONG, F.slice("halves", F.col("zero") + 1, n)).otherwise(F.col("hashes"))
    lines = lines.select("*", words.alias("one"), F.slice("halves", 1, F.col("zero") - 1).alias("other"))
    bit = F.lit([-(1 << 63) if i == 63 else 1 << i for i in range(64)]).cast("array<bigint>")
    flip = lambda a, h: a.bitwiseXOR(F.get(bit, h.bitwiseAND(F.lit(63).cast("long"))))
    bits, more = (F.aggregate(x, F.lit(0).cast("long"), flip) for x in ("one", "other"))
    return staged(lines.select(*WHERE, n.alias("n"), F.xxhash64("keys").alias("set"), F.hash("keys").alias("set2"), F.when(joins, prefix).alias("prefix"), F.when(joins, bits).alias("bits"), F.when(joins, more).alias("more")))


def _hubs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of each class and the first lines with its rarest tokens. In a group of near copies most lines match one
    of these, so that few are left to meet the whole group."""
    by = classes.select("first.*", "n", "bits", "more", F.explode(F.array_compact(F.array(*[f"t{i}" for i in range(RAREST)]))).alias("token"))
    line = F.struct(*WHERE, "n", "bits", "more")
    first = by.groupBy("token").agg(F.min(line).alias("x"), F.count(F.lit(1)).alias("lines")).where("lines > 1").select("token", "x")
    met = by.select("token", line.alias("y")).join(first, "token")
    close = (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & _few_apart(percent) & _before("x", "y")
    return staged(_pairs(met.where(close)).distinct())


def _last_indexed(n: Column, percent: int) -> Column:
    """The last place of the index prefix: a line of n words and a match with as many or more share a token up to it."""
    return n - F.ceil(n * (2 * percent) / (100 + percent))


def _joined(lines: DataFrame, percent: int) -> DataFrame:
    """Pairs of lines (id, line_no, n, bits, more, prefix, open) that share a prefix token and whose later one is open;
    x is the one with fewer words, or the earlier of as many."""
    # words, place and open in one long: rows are as narrow as can be where they are shuffled and sorted
    tokens = lines.select(*WHERE, "n", "bits", "more", "open", F.posexplode("prefix").alias("at", "token"))
    shape = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 1)).bitwiseOR(F.col("open").cast("long"))
    own = tokens.select(*WHERE, "bits", "more", shape.alias("shape"), "token")
    x = tokens.where(F.col("at") <= _last_indexed(F.col("n"), percent)).select(*WHERE, "bits", "more", shape.alias("shape"), "token").alias("x")
    n = {i: F.shiftright(f"{i}.shape", 32) for i in "xy"}
    at = {i: F.shiftright(F.col(f"{i}.shape").bitwiseAND(F.lit((1 << 32) - 1)), 1) for i in "xy"}
    is_open = {i: F.col(f"{i}.shape").bitwiseAND(F.lit(1).cast("long")) == 1 for i in "xy"}
    # the words from the shared token on are as many as the overlap needs, in both
    rest = lambda a, b: n[a] * 100 - at[a] * (100 + percent) >= n[b] * percent
    near = rest("x", "y") & rest("y", "x") & (n["x"] <= n["y"])
    first = _before("x", "y")
    # of lines with as many words each is x once and y once
    kept = F.when(first, is_open["y"]).otherwise(is_open["x"] & (n["x"] < n["y"]) & _before("y", "x"))
    met = x.join(own.alias("y"), (F.col("x.token") == F.col("y.token")) & near & _few_apart(percent, n["x"] + n["y"]) & kept)
    swap = lambda c, one, other: F.when(first, F.col(f"{one}.{c}")).otherwise(F.col(f"{other}.{c}"))
    return staged(met.select(swap("id", "x", "y").alias("a"), swap("line_no", "x", "y").alias("a_no"), swap("id", "y", "x").alias("b"), swap("line_no", "y", "x").alias("b_no")).distinct())


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90) -> DataFrame:
    """(id, line_no) of every line with an earlier match, line_no from 0; earlier is by (id, line_no).

    Lines are cut at newlines, words at other ASCII white space. A match shares at least percent of both lines'
    distinct words (Jaccard), whether or not the earlier line has gone itself. Equal sets match by a hash of 56 bits
    of each word and 96 of the set, others by their words. Lines without a word match nothing. Null texts
    have no lines; rows with a null id take no part; rows that repeat an id are numbered alike, and a
    line of theirs goes if it does in one of them. Other columns are ignored."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _spaced(F.col(f"`{text_col}`").cast("string")).alias("text")).where("id is not null and text is not null")
    made = _sets(texts, percent)
    sets, name = made.where("n > 0"), ["set", "set2", "n"]
    tokens = [F.first(F.when(_last_indexed(F.col("n"), percent) >= i, F.get("prefix", i))).alias(f"t{i}") for i in range(RAREST)]
    classes = staged(sets.groupBy(*name).agg(F.min(F.struct(*WHERE)).alias("first"), F.first("bits").alias("bits"), F.first("more").alias("more"), *tokens, F.count(F.lit(1)).alias("copies")))
    copied = classes.where("copies > 1").select(*name, "first")
    copies = staged(sets.select(*WHERE, *name).join(copied, name).where(F.struct(*WHERE) > F.col("first")).select(*WHERE).distinct())
    early = _verified(_hubs(classes.where("bits is not null"), percent), texts, percent)
    released(classes)
    # copies don't join; lines with a match already are only met by others
    known = copies.withColumn("copy", F.lit(True)).unionByName(early.withColumn("copy", F.lit(False)))
    lines = sets.where("bits is not null").select(*WHERE, "n", "bits", "more", "prefix").join(known, WHERE, "left")
    lines = staged(lines.where("copy is null or not copy").select("*", F.col("copy").isNull().alias("open")).drop("copy"))
    released(made)
    pairs = _joined(lines, percent)
    released(lines)
    # a copy of a line that goes is a copy
    return copies.unionByName(early).unionByName(_verified(pairs, texts, percent)).distinct()


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", percent: int = 90) -> DataFrame:
    """The rows of docs without the lines of duplicate_lines; all other columns as they are, but for
    length_col, the new text's characters where lines went. A row that loses lines and keeps no word
    goes. A text that loses nothing stays as it is, null and empty ones too."""
    gone, key = fresh(docs, "gone"), fresh(docs, "key")
    lines = duplicate_lines(docs, id_col, text_col, percent).groupBy("id").agg(F.collect_set("line_no").alias(gone)).withColumnRenamed("id", key)
    out = docs.join(lines, docs[f"`{id_col}`"].cast("long") == F.col(key), "left")
    text = F.col(f"`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    out = out.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(kept)).where(F.col(gone).isNull() | text.rlike(r"[^\x20\x09-\x0D]"))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(gone).isNull(), F.col(f"`{length_col}`")).otherwise(F.length(text)).cast(docs.schema[length_col].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
