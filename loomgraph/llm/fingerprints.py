"""Document fingerprints: a homomorphic hash of a multiset of paragraphs.

A text is the multiset of its paragraphs (pieces between line feeds). Each paragraph has
a wide vector, and the vectors are added component by component modulo 2**16:

* 32 dense lanes hold hash digits of the paragraph (two chained SHA-256), so
  that equal sums mean equal multisets but for chance;
* ``LEVELS`` x ``CELLS`` sparse cells hold hash digits of the paragraph's sentences, each
  sentence in one cell. A sentence is on level k with probability 3/4 ** (k+1), so that
  texts of any length have a level where most cells hold one sentence at most.

Sums do not depend on order, and a paragraph is inserted or deleted by adding or
subtracting its vector (``combine``). The likeness of two fingerprints is the share of
equal cells among those in use in either, on the levels that are not crowded; it
estimates the Jaccard similarity of the sentence sets.

Everything is SQL functions, evaluated row by row; nothing is exploded or grouped.

Edge cases: a null text counts as empty, which is one empty paragraph; a document that
is alone is its own next one; rows without a doc_id come last, by their text; rows that
share a doc_id are ordered by their text; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.tables import Scratch

LANES, LEVELS, CELLS = 32, 8, 32
#: Sums are modulo this power of two.
MODULUS = 1 << 16
#: A level counts if at most so many cells are in use.
CROWD = 20
#: Cells of the doc_id histogram that deals documents into ranges (bounded: it is broadcast),
#: and documents in a range.
ID_CELLS, RANGE_ROWS, NULL_RANGES = 16_384, 2_000, 64


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.replace(text, F.lit(". "), F.lit(".\n")), "\n", -1), lambda s: s != "")


def _digits(hexes: Column, at: Column | int, n: int) -> Column:
    """The number of ``n`` hexadecimal digits from place ``at`` (from 0)."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(hexes, at + 1, F.lit(n)), 16, 10).cast("int")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x, lambda a: (a % MODULUS).cast("int"))


def lanes(text: Column) -> Column:
    """The dense part: sums of the digits of all paragraphs' hashes."""
    first = F.transform(paragraphs(text), lambda p: F.sha2(p, 256))
    wide = F.transform(first, lambda h: F.concat(h, F.sha2(F.concat(h, F.lit("+")), 256)))
    # Held once for each row by the outer array, not computed for each lane.
    return F.flatten(F.transform(F.array(wide), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: _sum(F.transform(all_, lambda h: _digits(h, k * 4, 4))))))


def cells(text: Column) -> Column:
    """The sparse part, level by level."""

    def placed(s: Column) -> Column:
        h = F.sha2(s, 256)
        x = _digits(h, 0, 4)
        level = F.lit(LEVELS - 1)
        for k in range(LEVELS - 2, -1, -1):
            level = F.when(x % 4 ** (k + 1) != 0, F.lit(k)).otherwise(level)
        return F.struct(level.alias("level"), (_digits(h, 4, 4) % CELLS).alias("cell"), _digits(h, 8, 4).alias("value"))

    def one_level(on_level: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: _sum(F.transform(F.filter(on_level, lambda e: e["cell"] == c), lambda e: e["value"])))

    def every(all_: Column) -> Column:
        levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.filter(all_, lambda e: e["level"] == k))
        return F.flatten(F.transform(levels, one_level))

    return F.flatten(F.transform(F.array(F.transform(sentences(text), placed)), every))


def vector(text: Column) -> Column:
    """The fingerprint of a text as numbers below 2**16."""
    return F.concat(lanes(text), cells(text))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or with ``sign`` -1 of the first without the second."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(MODULUS)))


def text_of(vec: Column) -> Column:
    """Four hexadecimal digits for each number."""
    return F.array_join(F.transform(vec, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the sentence sets, from 0 to 1."""
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda k: F.aggregate(
            F.zip_with(F.slice(a, k * CELLS + LANES + 1, F.lit(CELLS)), F.slice(b, k * CELLS + LANES + 1, F.lit(CELLS)), lambda x, y: F.struct(((x != 0) | (y != 0)).cast("int").alias("used"), ((x == y) & (x != 0)).cast("int").alias("same"))),
            F.struct(F.lit(0).alias("used"), F.lit(0).alias("same")),
            lambda acc, e: F.struct((acc["used"] + e["used"]).alias("used"), (acc["same"] + e["same"]).alias("same")),
        ),
    )
    calm = F.filter(levels, lambda e: e["used"] <= CROWD)
    used = F.aggregate(calm, F.lit(0), lambda s, e: s + e["used"])
    same = F.aggregate(calm, F.lit(0), lambda s, e: s + e["same"])
    bare = F.when(F.slice(a, 1, LANES) == F.slice(b, 1, LANES), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(used > 0, same / used).otherwise(bare)


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, range, next): each text and the next one by descending doc_id, after the last the first.

    Ranges of doc_id come from a histogram of bounded size; rows move once, to their
    range, and only the first text of each range is needed by another.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = (bounds["low"] or 0), (bounds["high"] or 0)
    step = max(1, -(-(high - low + 1) // ID_CELLS))
    cell = F.expr(f"(doc_id - {low}L) div {step}L").cast("int")
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").groupBy(cell.alias("cell")).count()
    map_ = scratch.put("ranges", counts.select("cell", F.expr(f"coalesce(sum(count) over (order by cell rows between unbounded preceding and 1 preceding), 0) div {RANGE_ROWS}").alias("range")))
    null_range = -1 - F.pmod(F.xxhash64("text"), F.lit(NULL_RANGES))
    dealt = texts.withColumn("cell", cell).join(F.broadcast(map_), "cell", "left")  # ID_CELLS rows at most
    dealt = dealt.select("doc_id", "text", F.coalesce("range", null_range).alias("range"))
    order = [F.col("doc_id").desc(), F.col("text")]
    own = Window.partitionBy("range").orderBy(*order)
    return dealt.select("doc_id", "text", "range", F.row_number().over(own).alias("turn"), F.lead("text").over(own).alias("next"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    The edited text has the last half of the characters replaced by the first as many
    of the next document. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(docs, scratch)
    print_ = rows.withColumn("v", vector(F.col("text")))
    own = Window.partitionBy("range").orderBy("turn")
    linked = print_.withColumn("next_v", F.lead("v").over(own))
    # The last of a range goes on with the first of the next range that has rows.
    firsts = rows.where("turn = 1").select("range", F.col("text").alias("first_text"))
    firsts = scratch.put("firsts", firsts)
    turn = Window.orderBy(F.col("range").desc())
    following = firsts.select("range", F.lead("range").over(turn).alias("after"), F.max("range").over(Window.partitionBy()).alias("top"))
    following = following.select(F.col("range").alias("of"), F.coalesce("after", "top").alias("after"))
    after = following.join(firsts, F.col("after") == F.col("range")).select("of", "first_text")
    joined = linked.join(after, linked["range"] == after["of"], "left")
    last = F.col("next").isNull()
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    nearby = F.coalesce("next", "first_text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(nearby, F.lit(1), half))
    staged = joined.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "v",
        F.when(last, vector(F.col("first_text"))).otherwise(F.col("next_v")).alias("next_v"),
    )
    staged = staged.withColumn("edited_v", vector(F.col("edited")))
    return staged.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("v")).alias("fingerprint"), text_of(F.col("edited_v")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("edited_v")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )
