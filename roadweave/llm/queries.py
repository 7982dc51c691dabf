"""Registered queries of the corpus operators: thin wrappers that derive the result columns."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from roadweave.llm import audit, binary, decontamination, language, mixing, pages, periods, quality, secrets, simhash, substrings, tokens, winnowing
from roadweave.session import table

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = quality.score(docs, quality.fit(docs, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


ORACLE_SQL["op7_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class FROM totals),
steps AS (
    SELECT *, class + 1 AS weight,
        CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS DOUBLE) AS rest,
        CAST(sum(class + 1) OVER () - coalesce(sum(class + 1) OVER w, 0) AS DOUBLE) AS open
    FROM ranked WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / (class + 1), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(arg_min(rest / open, CAST(source_size AS DOUBLE) / weight) FILTER (rest / open * weight <= 3 * source_size), 0.0) AS l FROM steps),
targets AS (SELECT source, class, source_size, least(weight * l, CAST(3 * source_size AS DOUBLE)) AS target FROM steps, level),
placed AS (
    SELECT doc_id, s.size, t.source_size, t.target, t.class,
        CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
shared AS (SELECT *, least(CASE WHEN target > 0 THEN start / target ELSE 0.0 END, 1.0) AS u FROM placed)
SELECT doc_id, size, source_size, target,
    CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) + greatest(0, least(size, floor(target) - start - 2 * source_size)) AS BIGINT) AS taken,
    CAST(floor(1e6 * CASE class
        WHEN 0 THEN CASE WHEN u <= 0.625 THEN 2 * u / (1.5 + sqrt(greatest(2.25 - 2 * u, 0.0))) ELSE 0.5 + 2 * (u - 0.625) / (1.0 + sqrt(greatest(1.0 - 2 * (u - 0.625), 0.0))) END
        WHEN 1 THEN 2 * u / 2.0
        ELSE CASE WHEN u <= 0.375 THEN 2 * u / (0.5 + sqrt(0.25 + 2 * u)) ELSE 0.5 + 2 * (u - 0.375) / (1.0 + sqrt(1.0 + 2 * (u - 0.375))) END
    END) AS BIGINT) AS position_ppm
FROM shared
"""


@query
def op7_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    placed = mixed.orderBy("position", "doc_id")
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.floor(1e6 * F.col("position")).cast("long").alias("position_ppm"))


@query
def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_winnowing(spark, sf_dir):
    found = winnowing.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.as_text(F.col("choices")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_choices")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op6_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.find(docs, secrets.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op5_token_counts(spark, sf_dir):
    return tokens.count(table(spark, sf_dir, "documents"))


@query
def op10_token_output(spark, sf_dir):
    return binary.round_trip(table(spark, sf_dir, "documents"))


@query
def op3_main_text(spark, sf_dir):
    found = table(spark, sf_dir, "pages")
    return pages.extract(found, pages.fit(found))


@query
def op8_substrings(spark, sf_dir):
    kept = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs.where(~aside)))
    return found.select("doc_id", F.coalesce(aside, F.lit(False)).alias("held_out"), "lang_pred", "score", "distant")


ORACLE_SQL["op12_filter_orders"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
masked AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(worded.doc_id > first, false)::INT AS mask
    FROM worded JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
groups AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS before FROM orders, range(1, 6) s(step)),
told AS (
    SELECT part, filter_order, step, bit,
        sum(n) FILTER ((mask & (before | bit)) = 0) AS kept, sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS removed,
        sum(n) FILTER ((mask & before) > 0 AND (mask & bit) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS good_lost, sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS toxic_lost
    FROM groups, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM told
"""


@query
def op12_filter_orders(spark, sf_dir):
    return audit.orders_of_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_echo(doc_id, words):
    """Of every tenth document by checksum the words from some place on repeat with a period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op13_periodic_runs(spark, sf_dir):
    found = periods.find(table(spark, sf_dir, "documents"), with_echo)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return told.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
