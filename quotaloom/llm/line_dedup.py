"""Line dedup across documents by a deletion-neighbourhood join; DataFrame operations only.

Lines are compared in lower case with white space runs as one space.  A line goes if an earlier line (by document id, text
hash, line number) is equal, or is within one word of it (a word changed, added or left out) and both have at least
MIN_WORDS words.  Lines without words stay and take no part.

Two lines within one word agree in the first or in the last half of the shorter one.  So each distinct line gives the
hashes of its halves, for its own length and for one word less; only lines that share one with another line emit their
deletion neighbourhood: the hash of the line without word i, for every i.  The hashes are xors of hashed (word, place)
pairs, so all of a line's variants come from running xors in time linear in its length.  Equal variants join (the same
place left out: a changed word; a variant equal to a whole line: an added word), each takes its earliest line, and the
words of both lines are then compared.  All grouping is by minima that combine before they are shuffled.

Null texts stay null and have no lines.  A null id sorts last.  Rows with equal ids and texts count as one document: each
of them keeps what the others keep.  Other columns pass through, under any name but those of the four columns added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.llm import common

MIN_WORDS = 8
#: words of a half that are hashed; fewer make more lines emit, never lose one
HALF = 24
LAST = (1 << 63) - 1
DOC, LINE = ("ld_id", "ld_hash"), "ld_line"
HALVES = ("head", "tail", "head_less", "tail_less")


def normal(line: Column) -> Column:
    odd = F.lit(False)
    for white in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(white)
    # the pattern only where there is something to replace
    return F.trim(F.when(odd, F.regexp_replace(F.lower(line), "[\\x09-\\x0D ]+", " ")).otherwise(F.lower(line)))


def word_count(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def half_keys(norm: Column, n: Column) -> list[Column]:
    """Hashes of the first and the last half (of HALF words at most) among lines of n words, and of one word less."""
    def first_words(count: Column) -> Column:
        return F.call_function("substring_index", norm, F.lit(" "), count.cast("int"))

    out = []
    for size in (n, n - 1):
        half = F.floor(size / 2)
        out += [F.xxhash64(F.lit("head"), size.cast("int"), first_words(F.least(half, F.lit(HALF)))),
                F.xxhash64(F.lit("tail"), size.cast("int"), first_words(-F.least(size - half, F.lit(HALF))))]
    enough = [n >= MIN_WORDS] * 2 + [n > MIN_WORDS] * 2
    return [F.when(ok, key).alias(name) for ok, key, name in zip(enough, out, HALVES)]


def with_place(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The documents, written once and dealt by document, so that later joins with lines move the lines only."""
    others = F.struct(*(c for c in docs.columns if c != text)).alias("row")  # whatever they are called
    rows = docs.select(others, F.col(text).cast("string").alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias(DOC[0]),
                       F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias(DOC[1]))
    spark, name = docs.sparkSession, f"lines_{uuid.uuid4().hex}"
    writer = rows.repartition(common.shuffle_width(spark), *DOC).write.bucketBy(common.shuffle_width(spark), *DOC).format("parquet")
    writer.option("path", f"{common.checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def lines_of(rows: DataFrame) -> DataFrame:
    lines = rows.select(*DOC, F.posexplode(F.split("text", "\n")).alias(LINE, "line"))
    lines = lines.select(*DOC, LINE, normal(F.col("line")).alias("norm"))
    return lines.withColumns({"key": F.xxhash64("norm"), "key2": F.hash("norm")})


def place() -> Column:
    return F.struct(*DOC, LINE)


def variants(lines: DataFrame) -> DataFrame:
    """tag, v1, v2, whole, no for each word left out of each candidate line, and for the whole line."""
    words = lines.select("no", "n", "has_head", "has_tail", "has_head_less", "has_tail_less", F.posexplode("words").alias("i", "word"))
    line = common.Window.partitionBy("no")
    before, upto = line.orderBy("i").rowsBetween(common.Window.unboundedPreceding, -1), line.orderBy("i").rowsBetween(common.Window.unboundedPreceding, 0)
    for k in (1, 2):
        here, moved = F.xxhash64(F.lit(k), "word", "i"), F.xxhash64(F.lit(k), "word", F.col("i") - 1)
        words = words.withColumns({f"h{k}": here, f"m{k}": moved})
    for k in (1, 2):
        words = words.withColumns({
            f"whole{k}": F.bit_xor(f"h{k}").over(line), f"all{k}": F.bit_xor(f"m{k}").over(line),
            f"before{k}": F.coalesce(F.bit_xor(f"h{k}").over(before), F.lit(0)), f"upto{k}": F.bit_xor(f"m{k}").over(upto)})
    left_out = [F.col(f"before{k}").bitwiseXOR(F.col(f"all{k}")).bitwiseXOR(F.col(f"upto{k}")) for k in (1, 2)]

    def entry(when: Column, tag: Column, hashes: list[Column], whole: bool) -> Column:
        return F.when(when, F.struct(tag.alias("tag"), hashes[0].alias("v1"), F.shiftright(hashes[1], 32).cast("int").alias("v2"), F.lit(whole).alias("whole")))

    half, half_less = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2)
    changed = F.when(F.col("i") >= half, F.col("has_head")).otherwise(F.col("has_tail"))
    added = F.when(F.col("i") >= half_less, F.col("has_head_less")).otherwise(F.col("has_tail_less"))
    entries = F.array(
        entry(changed, F.col("i"), left_out, False), entry(added, F.lit(-1), left_out, False),
        entry((F.col("i") == 0) & (F.col("has_head") | F.col("has_tail")), F.lit(-1), [F.col("whole1"), F.col("whole2")], True))
    return words.select("no", F.explode(F.array_compact(entries)).alias("e")).select("no", "e.*")


def within_one_word(a: Column, b: Column) -> Column:
    """a has as many words as b, or one more."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x != y), True)
    at, rest = differs.cast("int"), F.size(a)
    equal = (F.size(a) == F.size(b)) & ((at == 0) | (F.slice(a, at + 1, rest) == F.slice(b, at + 1, rest)))
    longer = (F.size(a) == F.size(b) + 1) & ((at == 0) | (F.slice(a, at + 1, rest) == F.slice(b, F.greatest(at, F.lit(1)), rest)))
    return equal | longer


def near_lines(distinct: DataFrame, base: DataFrame) -> DataFrame:
    """spot, partner: first places of lines within one word of a line that comes earlier, and the earliest such line."""
    long = distinct.where(F.col("n") >= MIN_WORDS)
    keys = long.select("key", F.posexplode(F.array(*HALVES)).alias("which", "half")).where("half is not null")
    shared = keys.groupBy("half").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("half")
    flags = keys.join(shared, "half").groupBy("key").agg(*(F.max(F.col("which") == k).alias(f"has_{name}") for k, name in enumerate(HALVES)))
    flags = common.materialize(flags.join(long.select("key", "first.*"), "key").drop("key"))
    # candidate lines get numbers that rise with their places: one number moves and is compared instead of a place
    placed = flags.repartitionByRange(common.shuffle_width(base.sparkSession), *DOC, LINE).sortWithinPartitions(*DOC, LINE)
    flags = common.materialize(placed.withColumn("no", F.monotonically_increasing_id()))
    texts = lines_of(base.join(flags.select(*DOC).distinct(), list(DOC), "left_semi").dropDuplicates(list(DOC)))
    # written where their numbers belong, so that words are numbered and hashed without moving
    lines = common.kept_by("no", texts.join(flags, [*DOC, LINE]).select(
        "no", *DOC, LINE, F.split("norm", " ").alias("words"), word_count(F.col("norm")).alias("n"), *(f"has_{x}" for x in HALVES)))
    found = common.materialize(variants(lines))
    best = found.groupBy("tag", "v1", "v2").agg(
        F.min("no").alias("any"), F.min(F.when(F.col("whole"), F.col("no"))).alias("first_whole"),
        F.min(F.when(~F.col("whole"), F.col("no"))).alias("first_part"), F.count("*").alias("k")).where("k > 1")
    other = F.when(F.col("tag") >= 0, F.col("any")).when(F.col("whole"), F.col("first_part")).otherwise(F.col("first_whole"))
    pairs = found.join(best, ["tag", "v1", "v2"]).withColumn("partner", other).where("partner < no")
    pairs = pairs.groupBy("no").agg(F.min("partner").alias("partner"))
    own, theirs = F.col("own"), F.col("theirs")
    checked = pairs.join(lines.select("no", place().alias("spot"), F.col("words").alias("own")), "no").join(
        lines.select(F.col("no").alias("partner"), place().alias("earlier"), F.col("words").alias("theirs")), "partner")
    checked = checked.where(within_one_word(own, theirs) | within_one_word(theirs, own))
    return checked.select("spot", F.col("earlier").alias("partner"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of docs with the text that is left, and ld_lines, ld_removed, ld_near (numbers of lines), ld_words_left."""
    base = with_place(docs, text, doc_id)
    lines = lines_of(base)
    n = word_count(F.col("norm"))
    keyed = lines.select("key", "key2", place().alias("spot"), n.alias("n"), *half_keys(F.col("norm"), n))
    distinct = common.materialize(keyed.groupBy("key", "key2").agg(
        F.min("spot").alias("first"), F.max("spot").alias("last"), F.min("n").alias("n"), *(F.min(x).alias(x) for x in HALVES)).where(
            "n > 0").withColumn("again", F.col("first") != F.col("last")).drop("last"))
    near = common.materialize(near_lines(distinct, base))
    repeated = distinct.where("again").select("key", "key2", "first")
    again = lines.select("key", "key2", place().alias("spot")).join(repeated, ["key", "key2"]).where("spot <> first").select("spot", F.lit(0).alias("near"))
    gone = again.unionByName(near.select("spot", F.lit(1).alias("near"))).groupBy("spot").agg(F.max("near").alias("near"))
    by_doc = gone.select("spot.*", "near").groupBy(*DOC).agg(F.sort_array(F.collect_list(LINE)).alias("ld_gone"), F.sum("near").alias("ld_near"))
    out = base.join(by_doc, list(DOC), "left")
    # columns of their own, so that they are made once for a row and not once for each removed line
    every, gone_at, edges = F.col("ld_every"), F.col("ld_gone"), F.col("ld_edges")
    out = out.withColumn("ld_every", F.when(gone_at.isNotNull(), F.split("text", "\n")))
    # what is kept lies between neighbouring removed lines; array places count from 1
    out = out.withColumn("ld_edges", F.concat(F.array(F.lit(-1)), gone_at, F.array(F.size(every))))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda j: F.slice(
        every, F.element_at(edges, j) + 2, F.element_at(edges, j + 1) - F.element_at(edges, j) - 1)))
    out = out.withColumn("ld_text", F.when(gone_at.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    counts = {"ld_lines": n_lines, "ld_removed": F.coalesce(F.size(gone_at), F.lit(0)), "ld_near": F.coalesce("ld_near", F.lit(0))}
    counts = {k: F.when(F.col("text").isNull(), F.lit(0)).otherwise(v).cast("long") for k, v in counts.items()}
    out = out.withColumns(counts).withColumn("ld_words_left", F.coalesce(F.col("ld_text").rlike("[^\\x09-\\x0D ]"), F.lit(False)))
    added = ("ld_lines", "ld_removed", "ld_near", "ld_words_left")
    return out.select(*(F.col("ld_text").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in added), *added)
