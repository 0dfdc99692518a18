"""Problem 9: reading level, by vocabulary coverage and sentence complexity, calibrated in SQL on rated documents.

Words are ranked by frequency, each language by itself, since a word's rank says nothing about words of another language.
The coverage rank of a document is the size of the smallest frequency-ranked vocabulary that covers the share COVER of
its words: easy texts get by with few words, demanding ones need rarer ones. With the words per sentence, the complexity
of its sentences, it makes two measures (both as logarithms), which the ratings calibrate in SQL: in every language each
band gets the median of either measure over the documents rated with it, each measure the median deviation from its
band's median as its unit, and a document the band that is nearest in units. Medians, since raters are sometimes a band
off; a band with fewer than RATED ratings in a language is none there (what raters a band off leave), and a language
with fewer than two bands is calibrated by all ratings.

Languages are the two-letter codes that at least LANGUAGE of the documents with a code have; others are one group. A document
without a code gets the language whose TOP most frequent words it holds most of.

Plan: texts are exploded twice, once to count and once to measure. The ranks of the HEAD most frequent words of each
language are broadcast (at most HEAD / LANGUAGE rows, by the definition of a rank). A document whose coverage rank lies
beyond is measured again by a shuffled join with all ranks, so the result is exact. Frequency ranks come from the
histogram of counts, not from a global sort of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.session import cut, spread

COVER, LANGUAGE, TOP, HEAD, RATED = 0.5, 0.02, 100, 5_000, 5
_STOP = r"[.!?]+([ \t\n\f\r]|\z)|\n[ \t\n\f\r]*\n|\n[ \t\n\f\r]*[-*#0-9]"
_BEYOND = 2**62
MEASURES = ("coverage", "sentence")


def _words(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.filter(F.split(F.lower("t"), r"[^\p{L}]+"), lambda w: w != "")).alias("w"))


def _languages(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with their language, and (language, w, n): how often its words occur in them."""
    seen = base.where("code is not null").groupBy("code").count().collect()  # at most 26 x 26 codes
    least = LANGUAGE * sum(r["count"] for r in seen)
    common = sorted((r["code"] for r in seen if r["count"] >= least), key=lambda c: (-next(r["count"] for r in seen if r["code"] == c), c))
    known = base.where("code is not null").withColumn("language", F.when(F.col("code").isin(common), F.col("code")).otherwise("other")).drop("code")
    count = cut(_words(known, "language").groupBy("language", "w").agg(F.count(F.lit(1)).alias("n")))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.col("n").desc(), "w"))
    top = count.withColumn("i", place).where(F.col("i") <= TOP).select("language", "w")  # TOP rows per language
    none = base.where("code is null").drop("code")
    hits = _words(none, "doc_id").join(F.broadcast(top), "w").groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "language"))["language"].alias("language"))
    guessed = none.join(best, "doc_id", "left").withColumn("language", F.coalesce("language", F.lit(common[0] if common else "other")))
    more = _words(guessed, "language").groupBy("language", "w").agg(F.count(F.lit(1)).alias("n"))
    every = cut(count.unionByName(more).groupBy("language", "w").agg(F.sum("n").alias("n")))
    return known.unionByName(guessed.select(*known.columns)), every


def measures(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(doc_id, language, words, coverage_rank, coverage, sentence_words, sentence) of the documents with words.

    Words are runs of letters in lower case; rank r says that r words of the language are at least as frequent, so ties
    share the larger rank; coverage and sentence are the logarithms of the coverage rank and the words per sentence. Null
    and empty texts and texts without letters have no row. Rows that repeat an id are taken together, in the first of their
    languages. Texts are taken whole. An empty table gives no rows. Without ``lang`` all are of one language.
    """
    code = F.lower(F.trim(F.col(f"`{lang}`"))) if lang else F.lit(None).cast("string")
    code = F.when(code.rlike("^[a-z][a-z]([-_]|$)"), F.substring(code, 1, 2))
    base = spread(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("t"), code.alias("code")).where("doc_id is not null").where(F.col("t").rlike(r"\p{L}")))
    texts, count = _languages(base)
    by_n = Window.partitionBy("language").orderBy(F.col("n").desc())
    rank_of = count.groupBy("language", "n").agg(F.count(F.lit(1)).alias("m")).select("language", "n", F.sum("m").over(by_n).alias("rank"))  # a row per distinct count
    ranks = cut(count.join(rank_of, ["language", "n"]).select("language", "w", "rank"))
    sentences = F.size(F.filter(F.split("t", _STOP), lambda x: x.rlike(r"\p{L}")))
    counted = texts.select("doc_id", "language", F.greatest(sentences, F.lit(1)).alias("s"), "t")  # below the explosion: once per text

    def per_document(exploded: DataFrame) -> DataFrame:
        per = exploded.groupBy("doc_id", "language", "s").agg(F.count(F.lit(1)).alias("words"), F.expr(f"percentile_disc({COVER}) within group (order by rank)").cast("long").alias("coverage_rank"))
        return per.groupBy("doc_id").agg(F.min("language").alias("language"), F.sum("s").alias("s"), F.sum("words").alias("words"), F.max("coverage_rank").alias("coverage_rank"))

    head = F.broadcast(ranks.where(F.col("rank") <= HEAD))
    each = _words(counted, "doc_id", "language", "s").join(head, ["language", "w"], "left").withColumn("rank", F.coalesce("rank", F.lit(_BEYOND)))
    first = cut(per_document(each))
    far = first.where(F.col("coverage_rank") == _BEYOND).select("doc_id")
    again = per_document(_words(counted.join(far, "doc_id", "left_semi"), "doc_id", "language", "s").join(ranks, ["language", "w"]))
    doc = first.where(F.col("coverage_rank") < _BEYOND).unionByName(again)
    log = lambda x: F.round(F.log(x.cast("double")), 6)
    ratio = F.round(F.col("words") / F.col("s"), 6)
    return doc.select("doc_id", "language", "words", "coverage_rank", log(F.col("coverage_rank")).alias("coverage"), ratio.alias("sentence_words"), log(ratio).alias("sentence"))


def calibrate(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(language, measure, unit, band, middle) from (doc_id, band), the language "" standing for all of them.

    Null bands and unknown documents don't count. At most 2 x 4 rows per language.
    """
    rated = measured.join(labels.where("band is not null").select("doc_id", "band"), "doc_id")
    enough = rated.groupBy("language", "band").count().where(F.col("count") >= RATED)
    own = rated.join(enough.select("language", "band"), ["language", "band"])
    many = enough.groupBy("language").count().where("count > 1").select("language")
    both = own.join(many, "language").select("language", "band", *MEASURES).unionByName(rated.select(F.lit("").alias("language"), "band", *MEASURES))
    long = both.select("language", "band", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES))).alias("e")).select("language", "band", "e.*")
    middle = long.groupBy("language", "measure", "band").agg(F.expr("percentile(x, 0.5)").alias("middle"))
    unit = long.join(middle, ["language", "measure", "band"]).groupBy("language", "measure").agg(F.expr("percentile(abs(x - middle), 0.5)").alias("unit"))
    return middle.join(unit, ["language", "measure"]).select("language", "measure", F.greatest("unit", F.lit(0.05)).alias("unit"), "band", "middle")


def levels(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """The measures with the band whose medians are nearest, in units; ties go to the lower band. No labels: null."""
    per = calibrate(measured, labels).groupBy("language", "band").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("middle", "unit")))).alias("m"))
    model = per.groupBy("language").agg(F.collect_list(F.struct("band", "m")).alias("model"))  # a row per language, of at most four bands
    every = model.where("language = ''").select(F.col("model").alias("common"))
    far = lambda x: sum((F.abs(F.col(n) - x["m"][n]["middle"]) / x["m"][n]["unit"] for n in MEASURES), F.lit(0.0))
    nearest = F.array_min(F.transform(F.coalesce("model", "common"), lambda x: F.struct(far(x).alias("d"), x["band"].alias("band"))))["band"]
    return measured.join(F.broadcast(model), "language", "left").join(F.broadcast(every), F.lit(True), "left").withColumn("band", nearest).select(*measured.columns, "band")  # one row
