"""Problem 5: text that looks the same in one consistent form.

The text is exploded to positioned code points, joined with the (static, broadcast) decomposition and look-alike
tables, combining marks are ordered by class and recomposed, and the strings are rebuilt.

How it stays cheap: a text of plain ASCII is its own form and never leaves its row. Of the others only the characters
that can change are exploded one by one; a run of ASCII that nothing can alter stays one element. The rows are hash
partitioned by their key once, before the explosion, so the join (broadcast) and the rebuilding aggregation run in
place: one shuffle of the non-ASCII texts, none of the code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.llm import lookalikes as L
from thicket.session import cut

_CONTROL = r"[\x00-\x08\x0E-\x1F\x7F]"
_MAP_TYPE = T.StructType(
    [
        T.StructField("__ctx", T.StringType()),
        T.StructField("__s", T.StringType()),
        T.StructField("__out", T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("k", T.IntegerType())]))),
    ]
)


def _patterns() -> tuple[str, str, str, str]:
    inv = L.invisible_class()
    cyr, grk = L.native_only("cyrillic"), L.native_only("greek")
    around = rf"[\p{{L}}\p{{M}}{inv}]*+"
    before = rf"[\p{{L}}\p{{M}}{inv}]*"
    word = "|".join(f"{before}[{native}]{around}" for native in (cyr, grk))
    run = rf"[\x00-\x7F]*[\x00-\x40\x5B-\x60\x7B-\x7F](?![\p{{M}}{inv}])|[A-Za-z]+(?![\p{{M}}{inv}])"
    cluster = rf"(?s:.)[{inv}]*\p{{M}}[\p{{M}}{inv}]*"
    return f"{word}|{run}|{cluster}|(?s:.)", f"[{cyr}]", f"[{grk}]", rf"^(?s:.)[{inv}]*\p{{M}}"


def mapping(spark: SparkSession) -> DataFrame:
    """The static tables as a DataFrame (about 17,000 rows, whatever the corpus)."""
    return spark.createDataFrame([(a, b, c) for a, b, c in L.mapping_rows()], _MAP_TYPE)


def _compose(parts: Column) -> Column:
    """Array of (character, class) -> array of composed characters: marks sorted by class, then joined to their base."""
    comp = L.compositions()
    table = F.map_from_arrays(F.split(F.lit("\x01".join(comp)), "\x01"), F.split(F.lit("\x01".join(comp.values())), "\x01"))
    starts = F.filter(F.transform(parts, lambda x, i: F.when((x["k"] == 0) | (i == 0), i)), lambda i: i.isNotNull())

    def segment(s: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(starts, j + 1), F.size(parts))
        base = F.when(F.get(parts, s)["k"] == 0, 1).otherwise(0)  # none where the text begins with marks
        marks = F.array_sort(F.transform(F.slice(parts, s + 1 + base, stop - s - base), lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["c"].alias("c"))))
        begin = F.struct(F.when(base == 1, F.get(parts, s)["c"]).otherwise("").alias("b"), F.lit("").alias("rest"), F.lit(0).alias("last"))

        def step(a: Column, m: Column) -> Column:
            joined = F.when((a["last"] == 0) | (a["last"] < m["k"]), F.try_element_at(table, F.concat(a["b"], m["c"])))
            return F.when(
                joined.isNotNull(), F.struct(joined.alias("b"), a["rest"].alias("rest"), a["last"].alias("last"))
            ).otherwise(F.struct(a["b"].alias("b"), F.concat(a["rest"], m["c"]).alias("rest"), m["k"].alias("last")))

        return F.when(stop - s == 1, F.get(parts, s)["c"]).otherwise(F.aggregate(marks, begin, step, lambda a: F.concat(a["b"], a["rest"])))

    return F.transform(starts, segment)


def consistent_form(df: DataFrame, key: list[str], text: str, out: str = "canonical") -> DataFrame:
    """A row (key..., out) for every row of ``df``; non-ASCII rows that repeat key and text come out once.

    Same form: full-width and half-width letters and digits, ligatures, styled letters, look-alike letters of other
    scripts, composed and decomposed accents, spaces and hyphens of other kinds, invisible characters. Different
    forms: other case, accents, digits, punctuation, raised digits. A word that holds a letter only Cyrillic or
    Greek has is a word of that script: its look-alike Latin letters become letters of that script.

    Null text: null. Empty text, or text of invisible characters only: empty. Very long text: whole, one row.
    An empty table: no rows. Other columns, whatever their names, are not read.
    Null keys are kept as a key.
    """
    keys = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)]
    names = [f"__k{i}" for i in range(len(key))]
    back = [F.col(n).alias(k) for n, k in zip(names, key)]
    base = df.select(*keys, F.col(f"`{text}`").alias("__t"))
    plain_one = base.where(F.col("__t").isNull() | ~F.col("__t").rlike(r"[^\x00-\x7F]"))
    plain = plain_one.select(*back, F.regexp_replace("__t", _CONTROL, "").alias(out))

    pieces, cyr, grk, cluster = _patterns()
    parts_n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: small in bytes, the texts are large once exploded
    tricky = base.where(F.col("__t").rlike(r"[^\x00-\x7F]")).select(*names, F.xxhash64("__t").alias("__h"), F.regexp_replace("__t", _CONTROL, "").alias("__t")).repartition(parts_n, *names, "__h")

    def element(p: Column) -> Column:
        ctx = F.when(~p.rlike(r"[^\x00-\x7F]") & ~p.rlike("^.$"), F.lit("run")).when(p.rlike(cyr), F.lit("cyrillic")).when(p.rlike(grk), F.lit("greek")).when(p.rlike(cluster), F.lit("cluster")).otherwise(F.lit("latin"))
        chars = F.when((ctx == "run") | (F.length(p) == 1), F.array(p)).otherwise(F.regexp_extract_all(p, F.lit("(?s)."), 0))
        return F.transform(chars, lambda c: F.struct(ctx.alias("ctx"), c.alias("s")))

    rows = tricky.select(*names, "__h", F.posexplode(F.flatten(F.transform(F.regexp_extract_all("__t", F.lit(pieces), 0), element))).alias("__p", "__e"))
    joined = rows.select(*names, "__h", "__p", F.col("__e.ctx").alias("__ctx"), F.col("__e.s").alias("__s")).join(F.broadcast(mapping(df.sparkSession)), ["__ctx", "__s"], "left")
    given = F.coalesce("__out", F.array(F.struct(F.col("__s").alias("c"), F.lit(0).alias("k"))))
    parts = F.flatten(F.transform(F.array_sort(F.collect_set(F.struct(F.col("__p").alias("p"), given.alias("o")))), lambda x: x["o"]))
    rebuilt = joined.groupBy(*names, "__h").agg(parts.alias("__parts"))
    marked = F.exists("__parts", lambda x: x["k"] > 0)
    form = F.when(marked, F.array_join(_compose(F.col("__parts")), "")).otherwise(F.array_join(F.transform("__parts", lambda x: x["c"]), ""))
    return plain.unionByName(rebuilt.select(*back, form.alias(out)))


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, whose texts look the same but are not equal as stored.

    Null and empty texts take no part. Equal copies are no pair with each other, but each is one with every row of
    another stored form. Rows are compared by 128-bit digests, never by text; forms stored in one way only drop out
    in a pre-aggregated pass, and what is left is an equi-join that adaptive execution splits where a form is hot.
    Rows with a null key take no part. Empty table: no rows.
    """
    base = df.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__t")).where("__id is not null and __t <> ''")
    digest = lambda c: F.unhex(F.md5(c))
    forms = cut(consistent_form(base.withColumn("__d", digest("__t")), ["__id", "__d"], "__t").select("__id", F.col("__d").alias("__stored"), digest("canonical").alias("__form")))
    mixed = forms.groupBy("__form").agg(F.min("__stored").alias("__a"), F.max("__stored").alias("__b")).where("__a <> __b").select("__form")
    left = forms.join(mixed, "__form", "left_semi")
    a, b = left.select("__form", F.col("__id").alias("id_a"), F.col("__stored").alias("__sa")), left.select("__form", F.col("__id").alias("id_b"), F.col("__stored").alias("__sb"))
    return a.join(b, "__form").where("id_a < id_b and __sa <> __sb").select("id_a", "id_b").distinct()
