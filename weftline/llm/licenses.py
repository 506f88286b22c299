"""License scan with built-in functions only: MinHash bands over overlapping windows, then exact containment.

A text becomes the array of hashes of its word n-grams (words: runs of letters and digits, lower case).  Windows of
``WINDOW`` n-grams start at every half window.  The signature of a window is its minimum under each of ``BANDS``
permutations (a mask that is xor-ed to the hashes); each minimum is a band of its own.  A template gives the bands of a
window at every position, so a run of one and a half windows that is copied unchanged makes some text window equal to a
template window, and a window with one changed word in it (similarity 0.52) still meets its template in one of 8 bands
with probability 0.997, as does every other window of the copy.  Templates too short for that are notices of a few
words: their window is a single n-gram, whose signature is that n-gram, and which collides with certainty.

Bands that meet nominate (document, template); the nomination holds if the document contains the share ``percent`` of
the template's n-grams exactly.  Everything happens within the row of the document: there is no shuffle, and nothing is
broadcast but the templates themselves, a list of the program that is worked through in parts of bounded size.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.license_templates import TEMPLATES

N = 5
WINDOW = 16
BANDS = 8
MAX_KEYS = 50_000  # band keys of templates in one pass


def words(text: str) -> Column:
    """The lower-case words of a text; a null text has none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def gram_hashes(col: str, n: int) -> Column:
    """Hashes of the ``n``-grams of a word array in order; fewer words make one n-gram of them all, none make none."""
    size = F.size(col)
    each = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice(col, i, n)))
    return (
        F.when(size >= n, each).when(size > 0, F.array(F.xxhash64(F.slice(col, 1, n)))).otherwise(F.array().cast("array<bigint>"))
    )


def mask(band: int) -> int:
    """The permutation of a band, as a 64-bit mask (an additive sequence with the golden ratio)."""
    x = (band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def band_keys(grams: str, starts: Column, window: int, bands: int) -> Column:
    """For each window start (from 1) and band the key of that band."""
    def of(b: int) -> Column:
        return F.transform(starts, lambda s: F.array_min(F.transform(F.slice(grams, s, window), lambda h: h.bitwiseXOR(F.lit(mask(b))))))

    return F.concat(*[of(b) for b in range(bands)])


def block_minima(blocks: str, band: int) -> Column:
    """The minimum of each block under the permutation of a band."""
    return F.transform(blocks, lambda x: F.array_min(F.transform(x, lambda h: h.bitwiseXOR(F.lit(mask(band))))))


def window_minima(least: str) -> Column:
    """The same for windows of two neighbouring blocks; the last block is a window alone."""
    return F.transform(least, lambda x, i: F.least(x, F.get(least, i + 1)))


def template_rows(spark: SparkSession, templates: list[tuple[str, str]], n: int, window: int, bands: int) -> list[dict]:
    """For each template with a word its n-grams, its length in words if below ``n`` (else 0), and its band keys."""
    plain = [(i, str(name), str(text)) for i, (name, text) in enumerate(templates) if re.search(r"[^\W_]", str(text))]
    if not plain:
        return []
    listed = F.from_json(F.lit(json.dumps([{"t": i, "license": a, "text": b} for i, a, b in plain])), "array<struct<t int, license string, text string>>")
    rows = spark.range(1).select(F.explode(listed).alias("x")).select("x.*").withColumn("w", words("text"))
    rows = rows.where(F.size("w") > 0).withColumn("run", gram_hashes("w", n))
    starts = F.sequence(F.lit(1), F.size("run") - (window - 1))
    keys = F.when(F.size("run") >= window + window // 2, band_keys("run", starts, window, bands)).otherwise(F.col("run"))
    short = F.when(F.size("w") < n, F.size("w")).otherwise(0)
    rows = rows.select("t", "license", F.array_distinct("run").alias("grams"), short.alias("short"), F.array_distinct(keys).alias("keys"))
    return [r.asDict() for r in rows.orderBy("t").collect()]


def _passes(rows: list[dict]) -> list[list[dict]]:
    """The templates in parts of at most ``MAX_KEYS`` band keys; a longer template is a part alone."""
    out: list[list[dict]] = []
    room = 0
    for r in rows:
        if len(r["keys"]) > room or not out:
            out.append([])
            room = MAX_KEYS
        out[-1].append(r)
        room -= len(r["keys"])
    return out


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, n: int = N, percent: int = 80, window: int = WINDOW,
    bands: int = BANDS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """License templates whose word ``n``-grams a document contains to ``percent`` / 100 or more.

    Returns ``(doc_id, template, license, n_found, n_grams, first_word)``, one row for each match: number of the template
    in the list, n-grams found, n-grams of the template, and the 1-based word at which the first of them begins.
    A template of fewer than ``n`` words is one n-gram of all its words, looked for among the text's runs of that many
    words; one without a word is left out.  Null and empty texts match nothing, repeated rows give repeated matches, an
    empty table or list gives none, other columns are ignored.
    """
    spark = docs.sparkSession
    listed = template_rows(spark, TEMPLATES if templates is None else templates, n, window, bands)
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"))
    base = base.withColumn("w", words("__text")).withColumn("grams", gram_hashes("w", n))
    none, half = F.array().cast("array<bigint>"), window // 2
    short = sorted({r["short"] for r in listed} - {0})
    for k in short:
        base = base.withColumn(f"short{k}", F.when(F.size("w") >= k, gram_hashes("w", k)).otherwise(none))
    starts = F.when(F.size("grams") >= half, F.sequence(F.lit(1), F.size("grams"), F.lit(half))).otherwise(F.array().cast("array<int>"))
    base = base.withColumn("blocks", F.transform(starts, lambda s: F.slice("grams", s, half)))
    base = base.select("doc_id", "grams", *[f"short{k}" for k in short], *[block_minima("blocks", b).alias(f"m{b}") for b in range(bands)])
    singles = [F.col("grams"), *[F.col(f"short{k}") for k in short]]
    base = base.select("doc_id", F.array(*singles).alias("sources"), F.concat(*[window_minima(f"m{b}") for b in range(bands)], *singles).alias("keys"))
    out = None
    for part in _passes(listed) or [[]]:
        known = ", ".join(f"{k}L" for k in sorted({k for r in part for k in r["keys"]}))
        rows = [r | {"source": 1 + ([0, *short].index(r["short"]))} for r in part]
        kind = "array<struct<t int, license string, grams array<bigint>, keys array<bigint>, source int>>"
        table = F.from_json(F.lit(json.dumps(rows)), kind)
        met = base.withColumn("met", F.expr(f"filter(keys, k -> k IN ({known or 'NULL'}))"))
        named = F.when(F.size("met") > 0, F.filter(table, lambda x: F.arrays_overlap(x["keys"], F.col("met"))))
        # explode_outer: a filter on the generator's input would be pushed down and compute all of the above twice
        found = met.select("doc_id", "sources", F.explode_outer(named).alias("x"))
        source = F.element_at("sources", F.col("x.source"))
        found = found.select("doc_id", "x", source.alias("s"), F.array_intersect("x.grams", source).alias("same"))
        found = found.where("x IS NOT NULL").where(F.size("same") * 100 >= F.size("x.grams") * percent)
        found = found.select(
            "doc_id", F.col("x.t").alias("template"), F.col("x.license").alias("license"), F.size("same").cast("bigint").alias("n_found"),
            F.size("x.grams").cast("bigint").alias("n_grams"), F.array_min(F.transform("same", lambda h: F.array_position("s", h))).alias("first_word"),
        )
        out = found if out is None else out.union(found)
    return out
