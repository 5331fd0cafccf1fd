"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A paragraph (the text between line feeds) hashes to a vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo a power of two.  So the
fingerprint doesn't depend on the order of the paragraphs, that of two documents
together is the sum of theirs (``added``), and a paragraph is inserted or deleted
by adding or subtracting its own vector (``added``, ``removed``): nothing else of
the document is read again.

A vector has two parts.  ``IDENTITY`` lanes of 32 bits are the paragraph's SHA-256:
equal sums mean equal multisets of paragraphs, for all that isn't forged.  In the
other ``LANES`` lanes every different pair of neighbouring words of the paragraph adds
a sign at one place, both drawn from the pair's MD5.  The inner product of two such
vectors estimates how many pairs two documents share; ``likeness`` is twice that
product over the sum of both squared lengths, with a standard error of some 0.09.

Everything is DataFrame functions.  Entries of vectors are exploded and summed in the
task that holds the text.  For a table with each row's neighbour, texts go over the
network once, dealt by ranges of ids; the last row of every range goes along with
the range behind it as well, so that each row finds its neighbour in its own task.

Defined results: a null text is an empty one; an empty text is one empty
paragraph.  Order of documents is by id, null ids below all others, ties by a hash
of the text; rows alike in both are neighbours of each other.  A single document is
its own neighbour.  An empty table gives an empty result; other columns, whatever
their names, are not read.  Paragraphs longer than ``BLOCK`` code points are cut
into blocks of that size for their word pairs alone, so that no array of words is
longer than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lanes of the identity part and of the likeness part, and the power that every lane is taken modulo of.
IDENTITY, LANES, MODULUS = 8, 128, 1 << 32
#: Code points of a block of words.
BLOCK = 8192
#: Ranges of ids for each shuffle partition, so that tasks have even numbers of them.
RANGES = 4


def pairs(block: Column) -> Column:
    """Neighbouring words, joined, each pair once; nothing stands before the first and after the last. Words end at single spaces."""
    words, edge = F.split(block, " "), F.array(F.lit(""))
    return F.array_distinct(F.zip_with(F.concat(edge, words), F.concat(words, edge), lambda v, w: F.concat(v, F.lit(" "), w)))


def _entries(rows: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """``_lane`` and ``_value`` of every entry of the vectors of the paragraphs of a text."""
    lines = rows.select(*kept, F.explode(F.split(F.col(text), "\n")).alias("_line"))
    blocks = F.when(F.length("_line") <= BLOCK, F.array("_line")).otherwise(F.regexp_extract_all("_line", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    # one part for the paragraph's digest, and one for each of its blocks of words
    digest = F.array(F.struct(F.sha2("_line", 256).alias("digest"), F.lit(None).cast("string").alias("words")))
    parts = lines.select(*kept, F.explode(F.concat(digest, F.transform(blocks, lambda b: F.struct(F.lit(None).cast("string").alias("digest"), b.alias("words"))))).alias("_part"))
    whole = F.col("_part.digest").isNotNull()
    pieces = F.array(*(F.substring("_part.digest", 8 * k + 1, 8) for k in range(IDENTITY)))
    units = parts.select(*kept, whole.alias("_whole"), F.posexplode(F.when(whole, pieces).otherwise(pairs(F.col("_part.words")))).alias("_at", "_unit"))
    drawn = F.when(F.col("_whole"), F.col("_unit")).otherwise(F.substring(F.md5("_unit"), 1, 2))
    drawn = units.select(*kept, "_whole", "_at", F.conv(drawn, 16, 10).cast("bigint").alias("_drawn"))
    lane = F.when(F.col("_whole"), F.col("_at")).otherwise(IDENTITY + (F.col("_drawn") % LANES).cast("int"))
    value = F.when(F.col("_whole"), F.col("_drawn")).when(F.col("_drawn") >= LANES, 1).otherwise(-1)
    return drawn.select(*kept, lane.alias("_lane"), value.cast("bigint").alias("_value"))


def summed(rows: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """The fingerprint, ``lanes``, of the texts of all rows alike in the kept columns."""
    sums = _entries(rows, text, kept).groupBy(*kept, "_lane").agg(F.sum("_value").alias("_value"))
    listed = sums.groupBy(*kept).agg(F.collect_list("_lane").alias("_lanes"), F.collect_list("_value").alias("_values"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(IDENTITY + LANES - 1)), lambda k: F.pmod(F.coalesce(F.get("_values", F.array_position("_lanes", k).cast("int") - 1), F.lit(0)), F.lit(MODULUS)))
    return listed.select(*kept, dense.alias("lanes"))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of two documents together, or of one after inserting what ``b`` is the fingerprint of."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint after deleting paragraphs that ``b`` is the fingerprint of."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def written(lanes: Column) -> Column:
    """Eight hexadecimal digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _product(a: Column, b: Column) -> Column:
    half = MODULUS // 2
    signed = lambda x: (F.pmod(x + half, F.lit(MODULUS)) - half).cast("double")
    terms = F.zip_with(F.slice(a, IDENTITY + 1, LANES), F.slice(b, IDENTITY + 1, LANES), lambda x, y: signed(x) * signed(y))
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1: 1 for equal multisets of paragraphs, else by the word pairs they share; six digits."""
    both = _product(a, a) + _product(b, b)
    shared = F.when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _product(a, b) * 2 / both)))
    return F.when(F.slice(a, 1, IDENTITY) == F.slice(b, 1, IDENTITY), 1.0).otherwise(F.round(shared, 6))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``lanes`` of every id; rows that share an id count as one document of all their paragraphs."""
    named = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return summed(named, "_text", ["_id"])


def _beside_next(docs: DataFrame) -> DataFrame:
    """Rows (``_id``, ``_text``) with ``_range``, ``_row`` and ``_next``, the text of the next lower id.

    ``_own`` is false for the rows that only lend their text to the range behind
    theirs.  The last rows of the ranges, one a range, go through the driver.
    """
    spark = docs.sparkSession
    placed = docs.withColumn("_place", F.struct("_id", F.xxhash64("_text").alias("_hash")))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = placed.select("_place").repartitionByRange(ranges, "_place").groupBy(F.spark_partition_id()).agg(F.max("_place").alias("_place"))
    ends = [r["_json"] for r in ends.orderBy("_place").select(F.to_json("_place", {"ignoreNullFields": "false"}).alias("_json")).collect()]
    number, last = F.lit(0), F.lit(True)
    if ends:
        step = max(1, int(len(ends) ** 0.5))
        kind = placed.schema["_place"].dataType.simpleString()
        listed = lambda found, depth: F.from_json(F.lit(found), "array<" * depth + kind + ">" * depth)
        coarse = listed(f"[{','.join(ends[step - 1 :: step])}]", 1)
        fine = listed("[" + ",".join(f"[{','.join(ends[i : i + step])}]" for i in range(0, len(ends), step)) + "]", 2)
        before = lambda some: F.size(F.filter(some, lambda e: e < F.col("_place")))
        placed = placed.withColumn("_block", before(coarse)).withColumn("_inner", before(F.get(fine, "_block")))
        number = F.col("_block") * step + F.col("_inner")
        last = F.get(F.get(fine, "_block"), "_inner") == F.col("_place")
    own = F.struct(number.alias("_range"), F.lit(True).alias("_own"))
    lent = F.struct(((number + 1) % max(1, len(ends))).alias("_range"), F.lit(False).alias("_own"))
    dealt = placed.select("_id", "_text", "_place", F.inline(F.when(last, F.array(own, lent)).otherwise(F.array(own))).alias("_range", "_own"))
    order = Window.partitionBy("_range").orderBy("_own", "_place")
    return dealt.select("_range", F.row_number().over(order).alias("_row"), "_own", "_id", "_text", F.lag("_text").over(order).alias("_next"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of an edited text, and how like both and the next document's are.

    The edited text has the last half of the code points replaced by as many from
    the start of the next document in descending order of ids.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    beside = _beside_next(rows).withColumn("_n", F.length("_text").cast("bigint"))
    half = F.floor(F.col("_n") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("_n").cast("int") - half), F.substring("_next", F.lit(1), half))
    both = beside.withColumn("_edited", F.when(F.col("_own"), edited)).withColumn("_sha", F.unhex(F.sha2("_edited", 256)))
    kept = ["_range", "_row", "_own", "_id", "_n", "_sha"]
    lanes = summed(both.select(*kept, F.posexplode(F.array("_text", "_edited")).alias("_side", "_body")), "_body", [*kept, "_side"])
    one = lambda side: F.max(F.when(F.col("_side") == side, F.col("lanes")))
    found = lanes.groupBy(*kept).agg(one(0).alias("_a"), one(1).alias("_b"))
    found = found.withColumn("_c", F.lag("_a").over(Window.partitionBy("_range").orderBy("_row"))).where("_own")
    return found.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.lower(F.hex("_sha")).alias("edited_sha256"), written(F.col("_a")).alias("fingerprint"), written(F.col("_b")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("_c")).alias("near_next"),
    )
