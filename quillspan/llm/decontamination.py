"""Operator 1, benchmark decontamination: a stored positional inverted index and phrase queries on it.

`build_index` reads the texts once and writes the index: a posting (term, row, pos) for every token. Every
task writes a segment of its own as it reads, so nothing is shuffled, sorted or held. Terms and rows are 64-bit
hashes: a term's of the word, a row's of doc_id and text. An index can be asked by many queries; each reads the
stored terms, not the texts. (Terms are spread evenly over the hashes, so sorted segments would not let a lookup skip any.)

A phrase query looks up the rarest terms of each test window, shifts their positions by the terms'
offsets, and intersects the shifted lists: equal shifts mean that the terms stand at the right distance.
Only the alignments that survive are looked up for all their terms. A proximity query starts from the
rarest terms' postings too, keeps the places with the second rarest one near, and asks there for the rest.
Everything is DataFrame and SQL functions.

Defined results: a null or empty text has no words, hits nothing and is not contaminated; an item
with no words has no windows; an item below the window length is one window; repeated items count as one
id; there is a result row for each input row: rows that share a doc_id, a null one too, are judged apart, and
repeated rows alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, only, row_key

#: Fixed by the contract: what separates words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHARE, RAREST, SLOP = 13, 20, 2, 5


def words(text) -> F.Column:
    """The words of a text, an empty array for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.array_remove(parts, "")


def build_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored index (term, row, pos) of docs(doc_id, text), in segments that lie in the order of the texts."""
    texts = only(docs, "doc_id", "text").select(row_key().alias("row"), words(F.col("text")).alias("w"))  # else each token would hash its text
    tokens = texts.select("row", F.posexplode("w").alias("pos", "word"))
    return scratch.keep(tokens.select(F.xxhash64("word").alias("term"), "row", "pos"))


def item_tokens(items: DataFrame) -> DataFrame:
    """(item_id, item, item_len, j, term) of items(item_id, text); rows that repeat an item are judged on their own."""
    got = only(items, "item_id", "text").distinct().select(F.col("item_id").cast("string").alias("item_id"), F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("w"))
    placed = got.where(F.size("w") > 0).select("item_id", "item", F.size("w").alias("item_len"), F.posexplode("w").alias("j", "word"))
    return placed.select("item_id", "item", "item_len", "j", F.xxhash64("word").alias("term"))


def anchors(tokens: DataFrame, frequency: DataFrame, window: int, rarest: int) -> DataFrame:
    """(item, want): for the windows of each item, the distinct sets of their `rarest` rarest terms, as (j, term).

    A term that the corpus lacks makes its window unanswerable; such windows are left out.
    """
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - window + 1), F.greatest(F.lit(0), F.least(F.col("j"), F.col("item_len") - window)))).alias("k")
    placed = tokens.join(frequency, "term", "left").select("item", "j", "term", F.coalesce("n", F.lit(0)).alias("n"), starts)
    per = placed.groupBy("item", "k").agg(F.min("n").alias("least"), F.slice(F.sort_array(F.collect_list(F.struct("n", "j", "term"))), 1, rarest).alias("r"))  # a window's terms
    want = F.sort_array(F.transform("r", lambda x: F.struct(x["j"].alias("j"), x["term"].alias("term"))))
    return per.where("least > 0").select("item", want.alias("want")).distinct()


def find_phrases(index: DataFrame, tokens: DataFrame, scratch: Scratch, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Exact phrase matches (row, item_id, item, pos): words at pos of a row lie in an occurrence of a window of the item."""
    frequency = scratch.keep(index.join(tokens.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")))
    anchor = scratch.keep(anchors(tokens, frequency, window, rarest).select("item", F.xxhash64("item", "want").alias("set"), F.size("want").alias("need"), F.inline("want")))
    # a set of rarest terms is found where all its terms' lists, shifted by their offsets, meet
    shifted = index.join(anchor, "term").select("row", "item", "set", "need", (F.col("pos") - F.col("j")).alias("shift"), "j")
    met = shifted.groupBy("row", "item", "set", "need", "shift").agg(F.count_distinct("j").alias("got")).where("got = need")
    candidates = scratch.keep(met.select("row", "item", "shift").distinct())
    # the rest of the terms: shift their lists likewise; a run of `window` (or the whole item) is an occurrence
    asked = candidates.join(tokens, "item").select("row", "item", "item_id", "item_len", "shift", "j", "term", (F.col("j") + F.col("shift")).alias("pos"))
    there = index.join(candidates.select("row").distinct(), "row", "left_semi").join(tokens.select("term").distinct(), "term", "left_semi").distinct()
    hit = asked.join(there, ["row", "pos", "term"])
    along = Window.partitionBy("row", "item", "item_id", "shift")
    runs = hit.withColumn("run", F.col("j") - F.row_number().over(along.orderBy("j")))
    long = runs.withColumn("length", F.count("*").over(Window.partitionBy("row", "item", "item_id", "shift", "run")))
    return long.where(F.col("length") >= F.least(F.lit(window), F.col("item_len"))).select("row", "item_id", "item", "pos")


def find_near(index: DataFrame, phrases: DataFrame, scratch: Scratch, slop: int = SLOP) -> DataFrame:
    """Proximity matches (row, item_id, first_pos): all distinct terms of a phrase(item_id, text) within their number plus `slop` words.

    `first_pos` is where the first such stretch of the row begins.
    """
    wanted = item_tokens(phrases).select("item_id", "item", "term").distinct()
    n = index.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("item", "item_id")
    ranked = wanted.join(n, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.withColumn("r", F.row_number().over(w.orderBy("n", "term"))).withColumn("terms", F.count("*").over(w)).withColumn("least", F.min("n").over(w))
    ranked = scratch.keep(ranked.where("least > 0").select("item_id", "item", "term", "r", "terms"))
    span = F.col("terms") + F.lit(slop)
    # what is near is in the same stretch of `width` words or in one beside it, so long texts are not met all with all
    width = int(ranked.agg(F.max("terms")).first()[0] or 1) + slop
    stretch = lambda pos: F.floor(pos / F.lit(width))
    beside = F.explode(F.array(*[stretch(F.col("at")) + d for d in (-1, 0, 1)])).alias("cell")
    lead = index.join(ranked.where("r = 1"), "term").select("item_id", "item", "terms", "row", F.col("pos").alias("at"))
    second = index.join(ranked.where("r = 2"), "term").select("item", F.col("item_id").alias("id2"), "row", F.col("pos").alias("p2"), stretch(F.col("pos")).alias("cell"))
    both = lead.where("terms > 1").select("*", beside).join(second, ["item", "row", "cell"]).where(F.col("item_id").eqNullSafe(F.col("id2")) & (F.abs(F.col("p2") - F.col("at")) < span))
    lead = scratch.keep(both.select(lead.columns).union(lead.where("terms = 1")).distinct())
    rest = index.join(lead.select("row").distinct(), "row", "left_semi").select("row", "term", "pos", stretch(F.col("pos")).alias("cell")).distinct()
    around = lead.select("*", beside).join(ranked.select("item", F.col("item_id").alias("id2"), "term"), "item").where(F.col("item_id").eqNullSafe(F.col("id2")))
    close = around.join(rest, ["row", "term", "cell"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    # a stretch begins at one of the terms' places and holds the lead; the places around a lead are bounded by the span
    spots = close.groupBy("item_id", "item", "row", "terms", "at").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("spots"))
    holds = lambda s: F.size(F.array_distinct(F.transform(F.filter("spots", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + span)), lambda x: x["term"]))) == F.col("terms")
    first = spots.select("item_id", "row", F.array_min(F.transform(F.filter("spots", holds), lambda x: x["pos"])).alias("first_pos"))
    return first.where("first_pos is not null").groupBy("item_id", "row").agg(F.min("first_pos").cast("long").alias("first_pos"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, rarest: int = RAREST, slop: int | None = SLOP) -> DataFrame:
    """Per row of docs: doc_id, row, n_words, n_hit, n_items, items (sorted ids as strings), contaminated, n_near.

    n_near counts the items all whose terms stand near one another in the row; null if `slop` is None.
    """
    scratch = Scratch(docs.sparkSession, "op1")
    index, tokens = build_index(docs, scratch), scratch.keep(item_tokens(items))
    found = scratch.keep(find_phrases(index, tokens, scratch, window, rarest))
    hit = found.groupBy("row").agg(F.count_distinct("pos").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    if slop is not None:
        near = scratch.keep(find_near(index, items, scratch, slop)).groupBy("row").agg(F.count_distinct("item_id").alias("n_near"))
        hit = hit.join(near, "row", "full")
    sizes = index.groupBy("row").agg(F.count("*").alias("n")).join(docs.groupBy(row_key().alias("row")).agg(F.count("*").alias("m")).where("m > 1"), "row", "left")
    words_of = sizes.select("row", F.expr("n div coalesce(m, 1)").alias("n_words"))
    rows = only(docs, "doc_id", "text").select("doc_id", row_key().alias("row"))
    out = rows.join(words_of, "row", "left").join(hit, "row", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)).cast("long")).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_near = F.coalesce("n_near", F.lit(0)).cast("long") if slop is not None else F.lit(None).cast("long")
    return out.select("doc_id", "row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), n_near.alias("n_near"))


def clean_docs(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """docs without the contaminated rows; all columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "op1-clean")
    bad = scratch.keep(contamination(docs, items, **{"slop": None} | settings).where("contaminated").select("row").distinct())
    return docs.join(bad, row_key() == bad["row"], "left_anti")
