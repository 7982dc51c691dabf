"""Document fingerprints by winnowing, with DataFrame functions only.

Tokens are the words [^\\x20\\x09-\\x0D]+, those over 16 characters in pieces of
16. A hash is taken of every K consecutive tokens; in every window of W hashes
the smallest is chosen, of equal ones the rightmost; each choice is kept with its
position. Two texts that share K + W - 1 tokens in a row share a choice.

A choice is one number: 32 bits of hash above the token position counted down
from 2^31, so that the smallest number is the smallest hash furthest right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
W = 8
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
LOW = 2**31 - 1


def with_choices(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds out: array<long> of choices in text order. Null or empty text: an empty array;
    fewer than k tokens: one hash of all; fewer than w hashes: the smallest of all."""
    t, g = f"{out}_t", f"{out}_g"
    df = df.withColumn(t, F.expr(rf"regexp_extract_all(coalesce({text}, ''), r'{TOKEN}', 0)"))
    last = lambda column, width: F.sequence(F.lit(0), F.size(column) - width)
    pack = lambda h, at: F.shiftleft(h.bitwiseAND(F.lit(2**32 - 1)), 31).bitwiseOR(F.lit(LOW) - at)
    gram = lambda i: pack(F.xxhash64(*[F.get(F.col(t), i + j) for j in range(k)]), i.cast("long"))
    few = F.when(F.size(t) > 0, F.array(pack(F.xxhash64(F.array_join(t, " ")), F.lit(0).cast("long")))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(g, F.when(F.size(t) >= k, F.transform(last(F.col(t), k), gram)).otherwise(few))
    least = lambda i: F.least(*[F.get(F.col(g), i + j) for j in range(w)])
    some = F.when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(F.col(g))
    return df.withColumn(out, F.when(F.size(g) > w, F.array_distinct(F.transform(last(F.col(g), w), least))).otherwise(some)).drop(t, g)


def as_text(choices: Column) -> Column:
    """hash:position of each choice, hashes in hexadecimal, joined by spaces."""
    return F.lower(F.array_join(F.transform(choices, lambda v: F.concat(F.hex(F.shiftright(v, 31)), F.lit(":"), (F.lit(LOW) - v.bitwiseAND(F.lit(LOW))).cast("string"))), " "))


def hashes(choices: Column) -> Column:
    return F.array_distinct(F.transform(choices, lambda v: F.shiftright(v, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common hashes over the hashes of both (Dice); both empty: 1."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def with_next(docs: DataFrame, columns, parts: int) -> DataFrame:
    """docs(key long not null, ...) -> adds next_<c> of the row with the next larger key (ties: by the
    columns' order); the last row gets the first. Each row goes to one range of keys; the first row of
    a range also goes, as a guest, to the range before it, so no step sees all rows in one task.
    Ranges are dealt by number, one to a partition."""
    at = [i / parts for i in range(1, parts)]
    found = docs.agg(F.min("key").alias("low"), F.expr(f"approx_percentile(key, array({', '.join(map(repr, at))}), 10000)").alias("cuts") if at else F.array().alias("cuts")).first()
    if found["low"] is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    cuts = sorted(set(found["cuts"] or []) - {found["low"]})
    bounds = F.expr(f"array({', '.join(f'{c}L' if c > -(2**63) else 'bigint(-9223372036854775808)' for c in cuts)})") if cuts else F.array().cast("array<long>")
    part = F.size(F.filter(bounds, lambda b: b <= F.col("key")))
    guest = F.when(F.array_contains(bounds, F.col("key")), F.col("part") - 1).when(F.col("key") == found["low"], F.lit(len(cuts)))
    place = F.when(guest.isNull(), F.array(F.struct(F.col("part").alias("range"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("part").alias("range"), F.lit(0).alias("guest")), F.struct(guest.alias("range"), F.lit(1).alias("guest")))
    )
    rows = docs.withColumn("part", part).withColumn("place", F.explode(place))
    rows = rows.select("*", "place.range", "place.guest").drop("part", "place").repartitionById(parts, "range")
    return rows


def fingerprints(docs: DataFrame, parts: int | None = None, k: int = K, w: int = W) -> DataFrame:
    """docs(doc_id, text) -> per row: doc_id, text, n_chars, edited (the last quarter of the code points
    replaced by the beginning of the next document), choices, edited_choices, near_edited, near_next.

    A null text counts as empty. Null doc_ids come first in order. Rows that repeat a doc_id follow one
    another, by text. One document is its own next. An empty table gives an empty table. Very long texts are
    fingerprinted whole, in one row. Other columns aren't looked at.
    """
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text"], parts)
    if "range" not in rows.columns:
        rows = rows.withColumns({"range": F.lit(0), "guest": F.lit(0)}).drop("next_text")
    rows = with_choices(rows, "text", "choices", k, w)
    rows = rows.withColumn("hashes", hashes(F.col("choices")))
    following = Window.partitionBy("range").orderBy("guest", "key", "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(following), "next_hashes": F.lead("hashes").over(following)}).where("guest = 0").drop("range", "guest", "key")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substr("text", F.lit(1), n - quarter), F.substr(F.coalesce("next_text", "text"), F.lit(1), quarter))}).drop("next_text")
    rows = with_choices(rows, "edited", "edited_choices", k, w)
    near_next = likeness(F.col("hashes"), F.coalesce("next_hashes", "hashes"))
    rows = rows.withColumns({"near_edited": likeness(F.col("hashes"), hashes(F.col("edited_choices"))), "near_next": near_next})
    return rows.drop("hashes", "next_hashes")
