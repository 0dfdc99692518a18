"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm import chunker, curves, mixing, neardup, packing, pii, readability, scans, tokens, unify
from thicket.operators import vectors
from thicket.session import cut
from thicket.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _two_tables(spark: SparkSession, d: str, chunk_field: str = "content_to_embed") -> dict[str, DataFrame]:
    return {
        "loaded_docs": table(spark, d, "loaded_docs").select(F.col("load_id").alias("row_key"), F.col("markdown_content").alias("text")),
        "chunks": table(spark, d, "chunks").select(F.col("row_id").alias("row_key"), F.col(chunk_field).alias("text")),
    }


def _each(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for tab, df in parts.items():
        df = df.select(F.lit(tab).alias("tab"), *df.columns)
        out = df if out is None else out.unionByName(df)
    return out


def _near_duplicates(spark: SparkSession, d: str) -> neardup.Links:
    is_table = F.coalesce(F.col("metadata.is_table_summary"), F.lit(False))
    rows = table(spark, d, "chunks").select("row_id", is_table.alias("kind"), F.when(is_table, F.col("raw_payload")).otherwise(F.col("content_to_embed")).alias("text"))
    return neardup.near_duplicates(rows, "row_id", "text", "kind", threshold=0.7)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(_near_duplicates(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_near_duplicates(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(table(spark, d, "loaded_docs"), "load_id", "markdown_content")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "loaded_docs"), "load_id", "markdown_content")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = {r["tab"]: r for r in table(spark, d, "size_limits").collect()}  # fixed: a row for each table
    return _each({tab: chunker.split_oversized(df, "row_key", "text", limits[tab]["max_chars"], limits[tab]["overlap_chars"]) for tab, df in _two_tables(spark, d).items()})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("pieces > 1 and piece_no = 1").select("tab", "row_key")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return curves.mutual(curves.close_vectors(table(spark, d, "chunks"), "row_id", "embedding", size=64, least=0.9), k=10)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar rows of every 50th row (the stated set of searches), among all rows; exact, tile by tile."""
    v = curves.usable(table(spark, d, "chunks"), "row_id", "embedding", 64)
    hit = vectors.top_k(v.where("id % 50 = 0"), v, 11, 64).where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return hit.withColumn("rank", rank).where("rank <= 10").select(F.col("query_id").alias("row_id"), F.col("id").alias("neighbour"), "rank", F.round("score", 6).alias("cosine"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _each({tab: unify.same_look_pairs(df, "row_key", "text") for tab, df in _two_tables(spark, d).items()})


def p5_consistent_form(spark: SparkSession, d: str) -> DataFrame:
    return _each({tab: unify.consistent_form(df, ["row_key"], "text") for tab, df in _two_tables(spark, d).items()})


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _each(_two_tables(spark, d, "raw_payload"))
    return rows, pii.spans(rows, ["tab", "row_key"], "text", table(spark, d, "known_names"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d)[1].select("tab", "row_key", "pii_type", "start_pos")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _personal(spark, d)
    return pii.redact(rows, ["tab", "row_key"], "text", cut(found))


def _packed(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    sizes = cut(tokens.sized(table(spark, d, "documents"), "doc_id", "text"))
    windows = table(spark, d, "packing_windows").collect()  # fixed: two rows
    return [(w["window_id"], w["capacity_tokens"], packing.pack(sizes, w["capacity_tokens"])) for w in windows]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _union([df.select(F.lit(w).alias("window_id"), *df.columns) for w, _, df in _packed(spark, d)])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packed(spark, d).where("pieces > 1").select("window_id", "doc_id").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _union([packing.report(df, c).select(F.lit(w).alias("window_id"), F.lit(c).alias("capacity_tokens"), "*") for w, c, df in _packed(spark, d)])


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(tokens.sized(table(spark, d, "documents"), "doc_id", "text", "source"))
    return mixing.mix(sizes, table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where("short").select("source")


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.levels(cut(readability.measures(table(spark, d, "documents"), "doc_id", "text", "lang")), table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("band = 4").select("doc_id")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_consistent_form": p5_consistent_form, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_packed": p7_packed, "p7_report": p7_report, "p8_found": p8_found, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found, "p9_levels": p9_levels}
_P9 = r"""
    WITH docs AS (SELECT doc_id, text, CASE WHEN regexp_matches(lower(trim(lang)), '^[a-z][a-z]([-_]|$)') THEN substr(lower(trim(lang)), 1, 2) END AS code FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '\pL')),
    codes AS (SELECT code, count(*) AS n FROM docs WHERE code IS NOT NULL GROUP BY code QUALIFY n >= 0.02 * sum(n) OVER ()),
    w AS (SELECT doc_id, code, unnest(string_split_regex(lower(text), '[^\pL]+')) AS w FROM docs),
    known AS (SELECT CASE WHEN code IN (SELECT code FROM codes) THEN code ELSE 'other' END AS language, w, count(*) AS n FROM w WHERE w <> '' AND code IS NOT NULL GROUP BY ALL),
    top AS (SELECT language, w FROM known QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, w) <= 100),
    hits AS (SELECT doc_id, language, count(*) AS n FROM w JOIN top USING (w) WHERE code IS NULL GROUP BY ALL),
    best AS (SELECT doc_id, language FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, language) = 1),
    told AS (
        SELECT doc_id, text, CASE WHEN code IN (SELECT code FROM codes) THEN code WHEN code IS NOT NULL THEN 'other' ELSE coalesce(b.language, (SELECT code FROM codes ORDER BY n DESC, code LIMIT 1), 'other') END AS language
        FROM docs LEFT JOIN best b USING (doc_id)
    ),
    tok AS (SELECT doc_id, language, w FROM w JOIN told USING (doc_id) WHERE w <> ''),
    cnt AS (SELECT language, w, count(*) AS n FROM tok GROUP BY ALL),
    hist AS (SELECT language, n, sum(count(*)) OVER (PARTITION BY language ORDER BY n DESC) AS rank FROM cnt GROUP BY language, n),
    tr AS (SELECT doc_id, language, rank, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS i, count(*) OVER (PARTITION BY doc_id) AS words FROM tok JOIN cnt USING (language, w) JOIN hist USING (language, n)),
    sen AS (SELECT doc_id, greatest(1, len(list_filter(string_split_regex(text, '[.!?]+([ \t\n\f\r]|\z)|\n[ \t\n\f\r]*\n|\n[ \t\n\f\r]*[-*#0-9]'), lambda x: regexp_matches(x, '\pL')))) AS s FROM docs),
    r AS (SELECT doc_id, any_value(language) AS language, any_value(words)::BIGINT AS words, (max(rank) FILTER (i = ceil(words * 0.5::DOUBLE)))::BIGINT AS coverage_rank, round(any_value(words)::DOUBLE / any_value(s), 6) AS sentence_words FROM tr JOIN sen USING (doc_id) GROUP BY doc_id),
    m AS (SELECT *, round(ln(coverage_rank::DOUBLE), 6) AS coverage, round(ln(sentence_words), 6) AS sentence FROM r),
    rated AS (SELECT m.language, band, coverage, sentence FROM m JOIN reading_labels USING (doc_id) WHERE band IS NOT NULL),
    enough AS (SELECT language, band FROM rated GROUP BY ALL HAVING count(*) >= 5),
    lab AS (
        SELECT r.* FROM rated r JOIN enough USING (language, band) WHERE language IN (SELECT language FROM enough GROUP BY language HAVING count(*) > 1)
        UNION ALL SELECT '', band, coverage, sentence FROM rated
    ),
    mid AS (SELECT language, band, quantile_cont(coverage, 0.5) AS c, quantile_cont(sentence, 0.5) AS s FROM lab GROUP BY language, band),
    unit AS (SELECT language, greatest(quantile_cont(abs(coverage - c), 0.5), 0.05) AS uc, greatest(quantile_cont(abs(sentence - s), 0.5), 0.05) AS us FROM lab JOIN mid USING (language, band) GROUP BY language),
    near AS (
        SELECT doc_id, arg_min(mid.band, (abs(m.coverage - c) / uc + abs(m.sentence - s) / us, mid.band)) AS band
        FROM m JOIN mid ON mid.language = CASE WHEN m.language IN (SELECT language FROM unit) THEN m.language ELSE '' END JOIN unit ON unit.language = mid.language GROUP BY doc_id
    ),
    out AS (SELECT doc_id, language, words, coverage_rank, coverage, sentence_words, sentence, band FROM m LEFT JOIN near USING (doc_id))"""

SQL: dict[str, str] = {
    "p4_found": """
        WITH v AS (SELECT row_id AS id, embedding::DOUBLE[] AS v FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM v a JOIN v b ON a.id <> b.id),
        n AS (SELECT a, b, score, rank() OVER (PARTITION BY a ORDER BY score DESC) AS rank FROM s),
        k AS (SELECT a, b FROM n WHERE rank <= 10 AND score >= 0.9)
        SELECT x.a AS id_a, x.b AS id_b FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "p9_levels": f"{_P9} SELECT * FROM out",
    "p9_found": f"{_P9} SELECT doc_id FROM out WHERE band = 4",
    "p4_neighbours": """
        WITH v AS (SELECT row_id AS id, embedding::DOUBLE[] AS v FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.id AS row_id, c.id AS neighbour, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, neighbour)::INT AS rank FROM s QUALIFY rank <= 10)
        SELECT row_id, neighbour, rank, round(score, 6) AS cosine FROM r""",
    "p3_found": """
        SELECT 'loaded_docs' AS tab, load_id AS row_key FROM loaded_docs, size_limits WHERE tab = 'loaded_docs' AND length(markdown_content) > max_chars
        UNION ALL
        SELECT 'chunks' AS tab, row_id AS row_key FROM chunks, size_limits WHERE tab = 'chunks' AND length(content_to_embed) > max_chars""",
}
