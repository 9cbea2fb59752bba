"""A stored positional index of lexemes: weighted fields, best documents by block bounds, and cover density.

A document's title and body are one row of places: the title's words first. An
index is a folder of Parquet: a row for each lexeme and block of documents, in
ranges of lexemes, with the largest weight that a document of the block has.
Blocks hold documents of about one length, so most of them can't hold a good
one and are never scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.batches import by_words
from ..functions.stemming import with_lexemes
from ..tables import shuffle_partitions, stacked, stored

#: What an occurrence in the title and in the body counts.
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
DOCS_PER_BLOCK = 8
#: Times k documents that are scored first, so that their k-th is a good one.
PROBE = 4
#: Length classes an octave; blocks of a class have documents of like length.
CLASSES = 4
ROUNDING = 1e-9


def analyzed(docs: DataFrame, title: Column | None = None, body: Column | None = None, stems: bool = True) -> DataFrame:
    """(doc_id, n_title, lexemes): the lexemes of title and body by place; stop words leave gaps.

    Without ``stems`` a word is its own lexeme and leaves no gap. ``body`` is the column ``text`` by default, and there is no title.
    """
    body = F.col("text") if body is None else body
    head = T.tokens(F.lit("") if title is None else title)
    rows = docs.select("doc_id", F.size(head).alias("n_title"), F.concat(head, T.tokens(body)).alias("words"))
    return (with_lexemes(rows) if stems else rows.withColumn("lexemes", F.col("words"))).select("doc_id", "n_title", "lexemes")


def inverted(rows: DataFrame) -> DataFrame:
    """(lexeme, block, doc_id, n_title, weight, places) of each row (doc_id, block, n_title, lexemes): a document's places, gathered where it is read."""

    def work(batches):
        for batch in (part for whole in batches for part in by_words(whole, "lexemes")):
            lists, title = batch.column("lexemes"), np.asarray(batch.column("n_title"))
            words = lists.flatten()
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(1, len(words) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            there = np.asarray(words.is_valid())
            row, place, coded = row[there], place[there], pc.dictionary_encode(words.drop_null())
            code = np.asarray(coded.indices)
            order = np.lexsort((code, row))  # stable: places stay in order
            row, place, code = row[order], place[order], code[order]
            first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(code) != 0)]) if len(row) else np.empty(0, np.int64)
            weight = np.add.reduceat(np.where(place <= title[row], TITLE_WEIGHT, BODY_WEIGHT), first) if len(row) else np.empty(0)
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(place, pa.int32()))
            own = pa.array(row[first])
            columns = [coded.dictionary.take(pa.array(code[first])), *(batch.column(c).take(own) for c in ("block", "doc_id", "n_title")), pa.array(weight), places]
            yield pa.RecordBatch.from_arrays(columns, names)

    made = [StructField("lexeme", StringType()), *(rows.schema[c] for c in ("block", "doc_id", "n_title")), StructField("weight", DoubleType()), StructField("places", ArrayType(IntegerType()))]
    names = [f.name for f in made]
    return rows.mapInArrow(work, StructType(made))


def write_index(rows: DataFrame, path: str, docs_per_block: int = DOCS_PER_BLOCK, only: DataFrame | None = None) -> DataFrame:
    """Write the index of analyzed() documents below ``path`` and read it again.

    (lexeme, block, max_weight, docs, entries of (doc_id, n_title, weight, places)).
    A class of lengths is dealt into as many blocks as its documents need, by
    id, so a block's size is bounded however common a lexeme is, and a lexeme
    of many blocks is spread over files. Equal ids are one document of several rows.
    With ``only`` (lexeme), an index for known questions: every document is
    inverted and dealt into the same blocks, but other lexemes' postings, which
    no question meets, are not written.
    """
    level = F.floor(F.log2(F.size("lexemes") + 1) * CLASSES)
    postings = inverted(rows.select("doc_id", level.alias("block"), "n_title", "lexemes")).withColumnRenamed("block", "level")
    postings = postings if only is None else postings.join(only.select("lexeme").distinct(), "lexeme", "left_semi").select(*postings.columns)
    # Classes are counted and ranges cut by a look at all rows, so these are written before and texts are analyzed once.
    postings = stored(postings, "postings")
    classes = postings.groupBy("level").agg(F.ceil(F.countDistinct("doc_id") / docs_per_block).alias("blocks"))  # 125 rows at most, as lists have 2**31 places
    block = F.col("level") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    dealt = postings.join(F.broadcast(classes), "level").withColumn("block", block).drop("level", "blocks")
    ranged = dealt.repartitionByRange(shuffle_partitions(rows.sparkSession), "lexeme", "block")
    entry = F.struct("doc_id", "n_title", "weight", "places")
    blocks = ranged.groupBy("lexeme", "block").agg(F.max("weight").alias("most"), F.sum("weight").alias("all"), F.collect_list(entry).alias("entries"))
    docs = F.size(F.array_distinct("entries.doc_id"))
    bound = F.when(docs == F.size("entries"), F.col("most")).otherwise(F.col("all"))  # rows of one id count together
    blocks = blocks.select("lexeme", "block", bound.alias("max_weight"), docs.cast("long").alias("docs"), "entries")
    blocks.sortWithinPartitions("lexeme", "block").write.option("compression", "zstd").parquet(path)
    return read_index(rows.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lexemes_of(queries: DataFrame, text: str = "text", stems: bool = True) -> DataFrame:
    """(query_id, lexeme) of each query's words, without stop words."""
    rows = queries.select("query_id", T.tokens(F.col(text)).alias("words"))
    if stems:
        return with_lexemes(rows).select("query_id", F.explode("lexemes").alias("lexeme")).filter("lexeme is not null").distinct()
    return rows.select("query_id", F.explode(F.array_except("words", T.words_literal(T.QUESTION_STOP_WORDS))).alias("lexeme"))


def block_bounds(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, block, bound, docs): no document of the block weighs more for the query, and at least ``docs`` of them weigh something."""
    known = index.select("lexeme", "block", "max_weight", "docs").join(terms, "lexeme")
    return known.groupBy("query_id", "block").agg(F.sum("max_weight").alias("bound"), F.max("docs").alias("docs"))


def weights_of(index: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, doc_id, raw): the weight of every document with a lexeme of the query in its ``blocks`` (query_id, block)."""
    wanted = blocks.select("query_id", "block").join(terms, "query_id")
    found = index.select("lexeme", "block", F.transform("entries", lambda e: F.struct(e["doc_id"].alias("doc_id"), e["weight"].alias("weight"))).alias("entries"))
    each = found.join(wanted, ["lexeme", "block"]).select("query_id", F.explode("entries").alias("e"))
    return each.groupBy("query_id", F.col("e.doc_id").alias("doc_id")).agg(F.sum("e.weight").alias("raw"))


def best_documents(index: DataFrame, terms: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, doc_id, fts_score, lexical_rank): the k best documents of each query (query_id, lexeme), and no other block scored than needed.

    First blocks are scored in order of their bounds, until they hold PROBE
    times k documents; the weight of the k-th best of these is the least that counts.
    Then blocks whose bound reaches it are scored. Ties go to the smaller id,
    so a block that can only reach a tie is scored too.
    """
    terms = terms.distinct()
    bounds = stored(block_bounds(index, terms), "block-bounds")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = bounds.withColumn("before", F.coalesce(F.sum("docs").over(by_bound), F.lit(0))).filter(F.col("before") < PROBE * k)
    scored = stored(weights_of(index, terms, first), "best-blocks")
    best = Window.partitionBy("query_id").orderBy(F.desc("raw"))
    least = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", F.col("raw").alias("least"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    rest = rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROUNDING))
    every = stacked(scored, weights_of(index, terms, rest))
    score = every.withColumn("fts_score", F.round(F.col("raw") / (F.col("raw") + 1), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("fts_score"), "doc_id")
    return score.withColumn("lexical_rank", F.row_number().over(order)).filter(F.col("lexical_rank") <= k).drop("raw")


def clause_parts(parsed: DataFrame, stems: bool = True) -> DataFrame:
    """(query_id, parts): each clause of parse_questions() as lexemes with their distances from the first; clauses of stop words say nothing.

    A clause of several words is a phrase, quoted or not (``NIST-600``).
    """
    each = parsed.select("query_id", F.explode("clauses").alias("clause")).select("query_id", T.tokens(F.col("clause")).alias("words"))
    each = with_lexemes(each) if stems else each.withColumn("lexemes", F.col("words"))
    placed = F.filter(F.transform("lexemes", lambda x, i: F.struct(i.alias("at"), x.alias("lexeme"))), lambda p: p["lexeme"].isNotNull())
    each = each.withColumn("placed", placed).filter("size(placed) > 0")
    parts = F.transform("placed", lambda p: F.struct((p["at"] - F.col("placed")[0]["at"]).alias("at"), p["lexeme"].alias("lexeme")))
    return each.select("query_id", parts.alias("parts")).distinct()


def cover_density(index: DataFrame, parts: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, doc_id, fts_score, covers, lexical_rank): documents by their minimal covers, for clauses (query_id, parts) joined by OR.

    A cover is a stretch of places that holds a clause and no shorter stretch
    that holds one: an occurrence of a word, or of a phrase with no word clause
    and no other phrase inside. It counts the harmonic mean of the weights of
    the query's lexemes in it, divided by one more than its places without one.
    The score is r / (r + 1) of their sum.
    """
    lexemes = parts.select("query_id", F.explode("parts.lexeme").alias("lexeme"), (F.size("parts") == 1).alias("single"))
    lexemes = lexemes.groupBy("query_id", "lexeme").agg(F.max("single").alias("single"))
    entries = index.join(lexemes.select("lexeme").distinct(), "lexeme", "left_semi").select("lexeme", F.explode("entries").alias("e"))
    weight = F.when(F.col("at") <= F.col("n_title"), TITLE_WEIGHT).otherwise(BODY_WEIGHT)
    places = entries.select("lexeme", "e.doc_id", "e.n_title", F.explode("e.places").alias("at")).withColumn("weight", weight).drop("n_title")
    alone = lexemes.filter("single").select("query_id", "lexeme")
    words = entries.select("lexeme", "e.doc_id", "e.weight", F.size("e.places").alias("covers")).join(alone, "lexeme")
    words = words.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("raw"), F.sum("covers").alias("covers"))
    phrases = phrase_covers(places, parts.filter(F.size("parts") > 1), lexemes)
    rows = stacked(words, phrases).groupBy("query_id", "doc_id").agg(F.sum("raw").alias("raw"), F.sum("covers").alias("covers"))
    rows = rows.withColumn("fts_score", F.round(F.col("raw") / (F.col("raw") + 1), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("fts_score"), "doc_id")
    ranked = rows.withColumn("lexical_rank", F.row_number().over(order)).filter(F.col("lexical_rank") <= k)
    return ranked.select("query_id", "doc_id", "fts_score", "covers", "lexical_rank")


def phrase_spans(places: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, doc_id, first, last): where the parts of phrases stand at their distances; ``places`` is (lexeme, doc_id, at).

    The longest lexeme of a phrase is looked up, and the others where they must be.
    """
    longest = F.array_max(F.transform("parts", lambda p: F.struct(F.length(p["lexeme"]).alias("n"), (-p["at"]).alias("back"), p["lexeme"].alias("lexeme"))))
    keyed = phrases.withColumn("best", longest).select("query_id", "parts", F.col("best.lexeme").alias("lexeme"), (-F.col("best.back")).alias("ahead"))
    found = places.join(keyed, "lexeme").select("query_id", "parts", "doc_id", (F.col("at") - F.col("ahead")).alias("first")).filter("first > 0")
    due = found.select("*", F.explode("parts").alias("p")).select("query_id", "parts", "doc_id", "first", F.col("p.lexeme").alias("lexeme"), (F.col("first") + F.col("p.at")).alias("at"))
    there = due.join(places.select("doc_id", "at", "lexeme"), ["doc_id", "at", "lexeme"]).groupBy("query_id", "parts", "doc_id", "first").agg(F.count(F.lit(1)).alias("n"))
    last = F.col("first") + F.element_at("parts", -1)["at"]
    return there.filter(F.col("n") == F.size("parts")).select("query_id", "doc_id", "first", last.alias("last")).distinct()


def phrase_covers(places: DataFrame, phrases: DataFrame, lexemes: DataFrame) -> DataFrame:
    """(query_id, doc_id, raw, covers) of the phrases' minimal covers; ``lexemes`` is (query_id, lexeme, single) of all clauses.

    Phrases are looked for among their own lexemes' places; other places only matter in documents that have a phrase.
    """
    spoken = phrases.select(F.explode("parts.lexeme").alias("lexeme")).distinct()
    spans = stored(phrase_spans(places.join(spoken, "lexeme", "left_semi"), phrases), "spans")
    there = places.join(spans.select("doc_id").distinct(), "doc_id", "left_semi")
    inside = spans.withColumn("at", F.explode(F.sequence("first", "last"))).join(there, ["doc_id", "at"]).join(lexemes, ["query_id", "lexeme"])
    held = inside.groupBy("query_id", "doc_id", "first", "last").agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("weight")).alias("inverse"), F.max("single").alias("holds_word")
    )
    before = Window.partitionBy("query_id", "doc_id").orderBy("last", F.desc("first")).rowsBetween(Window.unboundedPreceding, -1)
    least = held.withColumn("before", F.max("first").over(before)).filter(~F.col("holds_word") & (F.col("before").isNull() | (F.col("before") < F.col("first"))))
    noise = F.col("last") - F.col("first") + 1 - F.col("n")
    return least.groupBy("query_id", "doc_id").agg(F.sum(F.col("n") / F.col("inverse") / (1 + noise)).alias("raw"), F.count(F.lit(1)).alias("covers"))
