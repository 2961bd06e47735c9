"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (what lies between line feeds, empty ones too) hashes to a wide
vector: ``EXACT`` lanes of 32 bits from SHA-256, and ``2 * PACKED`` lanes that
count, over the paragraph's shingles of three words, how often a bit of the
shingle's MD5 is set. A document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo 2**32. So order does not matter, equal multisets of paragraphs have equal fingerprints, and a
paragraph is inserted or deleted by adding or subtracting its vector
(:func:`plus`, :func:`minus`). The lanes are no defence against texts made to
collide.

Shingles are padded at a paragraph's start, so one of two words has two. A count
c among n shingles gives a sum of signs n - 2c; the cosine of two such vectors
of sums estimates the cosine of the shingle multisets (:func:`likeness`), with
a standard deviation of about (1 - c**2) / sqrt(112).

All work is DataFrame expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lanes of the paragraphs' own hashes; longs of two 32-bit counters each; longs of counters from one half of an MD5.
EXACT, PACKED, HALF = 16, 56, 28
PAIR = 0x0000000100000001
LINE, GAP = "\n", r"[\x20\x09-\x0D]+"
#: Range buckets for each shuffle partition, and at most.
BUCKETS_PER_PARTITION, MAX_BUCKETS = 4, 20_000


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE)


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, GAP), lambda w: w != "")


def _shingles(words: str) -> Column:
    """The three words that end at each word, with empty words before the first."""

    def at(i: Column) -> Column:
        before = [F.coalesce(F.get(words, i - k), F.lit("")) for k in (2, 1)]
        return F.concat_ws(" ", *before, F.get(words, i))

    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.size(words) - 1), at)).otherwise(F.array().cast("array<string>"))


def _digits(text: Column, first: int, n: int) -> Column:
    """``n`` hexadecimal digits, 15 at most, as a long."""
    return F.conv(F.substring(text, first, n), 16, 10).cast("long")


def paragraph_vectors(rows: DataFrame, keys: list[str], paragraph: str = "paragraph") -> DataFrame:
    """``keys`` and fp: the sum of the vectors of all ``paragraph`` rows that share the keys.

    One pass: each paragraph becomes a row for itself and a row per shingle,
    summed in place where the rows already lie by one of the keys.
    """
    rows = rows.select(*keys, F.col(paragraph).alias("_p"), _words(F.col(paragraph)).alias("_w"))
    own = F.array(F.struct(F.lit(True).alias("whole"), F.col("_p").alias("s")))
    parts = F.transform(_shingles("_w"), lambda s: F.struct(F.lit(False).alias("whole"), s.alias("s")))
    rows = rows.select(*keys, F.inline(F.concat(own, parts)))
    digest = F.when(F.col("whole"), F.concat(F.sha2(F.concat(F.lit("0:"), "s"), 256), F.sha2(F.concat(F.lit("1:"), "s"), 256))).otherwise(F.md5("s"))
    rows = rows.select(*keys, "whole", digest.alias("_d"))
    rows = rows.select(
        *keys, "whole", "_d", F.when(~F.col("whole"), _digits(F.col("_d"), 1, 15)).alias("_h0"), F.when(~F.col("whole"), _digits(F.col("_d"), 16, 15)).alias("_h1")
    )
    exact = [_low(F.sum(F.when(F.col("whole"), _digits(F.col("_d"), 1 + 8 * k, 8)))) for k in range(EXACT)]
    counts = [
        F.coalesce(F.sum(F.shiftrightunsigned(f"_h{k // HALF}", k % HALF).bitwiseAND(F.lit(PAIR))), F.lit(0).cast("long")).alias(f"_c{k}")
        for k in range(PACKED)
    ]
    summed = rows.groupBy(*keys).agg(
        F.count_if(~F.col("whole")).alias("_n"), *(e.alias(f"_e{k}") for k, e in enumerate(exact)), *counts
    )
    fp = F.struct(
        F.col("_n").alias("n"), F.array(*(F.col(f"_e{k}") for k in range(EXACT))).alias("exact"), F.array(*(F.col(f"_c{k}") for k in range(PACKED))).alias("counts")
    )
    return summed.select(*keys, fp.alias("fp"))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _moved(a: Column, b: Column, sign: int) -> Column:
    def lanes(x: Column, y: Column) -> Column:
        return F.shiftleft(_low(_high(x) + sign * _high(y)), 32).bitwiseOR(_low(_low(x) + sign * _low(y)))

    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"),
        F.zip_with(a["exact"], b["exact"], lambda x, y: _low(x + sign * y)).alias("exact"),
        F.zip_with(a["counts"], b["counts"], lanes).alias("counts"),
    )


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), _moved(a, b, 1))


def minus(a: Column, b: Column) -> Column:
    """``a`` without the paragraphs of ``b``; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), _moved(a, b, -1))


def to_text(fp: Column) -> Column:
    """A fingerprint as 1,032 hexadecimal digits: number of shingles, exact lanes, counters."""
    put = lambda n: lambda x: F.lower(F.lpad(F.hex(x), n, "0"))
    return F.concat(put(8)(_low(fp["n"])), F.array_join(F.transform(fp["exact"], put(8)), ""), F.array_join(F.transform(fp["counts"], put(16)), ""))


def from_text(text: Column) -> Column:
    """The inverse of :func:`to_text` for documents of fewer than 2**32 shingles."""
    number = lambda start, n: F.conv(F.substring(text, start, n), 16, 10).cast("long")
    count = lambda k: F.shiftleft(number(137 + 16 * k, 8), 32).bitwiseOR(number(145 + 16 * k, 8))
    fp = F.struct(
        number(1, 8).alias("n"), F.array(*(number(9 + 8 * k, 8) for k in range(EXACT))).alias("exact"), F.array(*(count(k) for k in range(PACKED))).alias("counts")
    )
    return F.when(text.isNotNull(), fp)


def signs(fp: Column) -> Column:
    """The sums of signs as doubles, from -n to n each."""
    lane = lambda count: (fp["n"] - 2 * count).cast("double")
    return F.flatten(F.transform(fp["counts"], lambda x: F.array(lane(_low(x)), lane(_high(x)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, signs_a: Column, signs_b: Column) -> Column:
    """From 0 to 1: 1 for equal fingerprints, else the clipped cosine of the sums of signs; 0 beside one without words."""
    norm = F.sqrt(dot(signs_a, signs_a) * dot(signs_b, signs_b))
    cosine = F.coalesce(F.try_divide(dot(signs_a, signs_b), norm), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), 9))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (n, exact, counts) of its whole text.

    A null text is an empty one: a single empty paragraph. Repeated rows and
    null ids each give a row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    texts = rows.select(F.sha2("_t", 256).alias("_k"), "_t").distinct()
    found = paragraph_vectors(texts.select("_k", F.explode(paragraphs(F.col("_t"))).alias("paragraph")), ["_k"])
    return rows.select("doc_id", F.sha2("_t", 256).alias("_key")).join(found, F.col("_key") == F.col("_k")).select("doc_id", "fp")


def _buckets(rows: DataFrame, key: Column) -> str:
    """The least key of each of some ranges of about as many rows, in order, as JSON; their number doesn't grow with the rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(key.alias("k")).select("k.*")
    ranges = keys.repartitionByRange(min(MAX_BUCKETS, BUCKETS_PER_PARTITION * parts), *keys.columns)
    found = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys.columns)).alias("k")).select("k.*").collect()
    return json.dumps([r.asDict() for r in sorted(found)])


def _bounds(text: str) -> Column:
    return F.from_json(F.lit(text), "array<struct<a int, b bigint, c string>>")


def _bucket_of(key: Column, bounds: str, n: int) -> Column:
    """The range that a key is in, by binary search."""
    table = _bounds(bounds)
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(max(1, n).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step < n) & (F.get(table, lo + step) <= key), lo + step).otherwise(lo))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third of code points replaced by as many (or
    all) from the start of the next document: by descending doc_id, null ids
    last, equal ids by the MD5 of their text; the last document's next is the
    first. Repeated rows are documents of their own, next to each other.

    Texts are shuffled once: into ranges of the order, of which the first row is
    also sent to the range before. All that follows is summed where the ranges
    lie; paragraphs that both texts share are hashed once. Null texts are empty; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    key = F.struct(F.isnull("doc_id").cast("int").alias("a"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("b"), F.md5("_t").alias("c"))
    bounds = _buckets(rows, key)
    n = max(1, bounds.count("{"))
    rows = rows.withColumn("_key", key)
    rows = rows.withColumn("_at", _bucket_of(F.col("_key"), bounds, n))
    before, least = F.pmod(F.col("_at") - 1, F.lit(n)), F.get(_bounds(bounds), F.col("_at")) == F.col("_key")
    place = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    both = F.when(least, F.array(place(F.col("_at"), 0), place(before, 1))).otherwise(F.array(place(F.col("_at"), 0)))
    rows = rows.select("doc_id", "_t", "_key", F.inline(both))
    order = W.partitionBy("bucket").orderBy("guest", "_key")
    rows = rows.select("doc_id", "_t", "bucket", "guest", F.row_number().over(order).alias("row"), F.lead("_t").over(order).alias("_next"))
    chars = F.length("_t")
    third = F.floor(chars / 3).cast("int")
    mine = F.col("guest") == 0
    rows = rows.withColumn("n_chars", chars.cast("long")).withColumn("_start", F.when(mine, F.substring("_t", F.lit(1), chars - third)).otherwise(F.col("_t")))
    rows = rows.withColumn("_put", F.when(mine, F.substring("_next", F.lit(1), third)))
    rows = rows.withColumn("edited_sha256", F.sha2(F.concat("_start", "_put"), 256)).withColumn("_ps", paragraphs(F.col("_start")))
    # what both texts share, and what each has from the paragraph of the first change on
    open_ = F.element_at("_ps", -1)
    shared = F.when(mine, F.slice("_ps", F.lit(1), F.size("_ps") - 1)).otherwise(F.col("_ps"))
    kind = lambda k, ps: F.struct(F.lit(k).alias("part"), ps.alias("ps"))
    own, put = paragraphs(F.concat(open_, F.substring("_t", chars - third + 1, third))), paragraphs(F.concat(open_, F.col("_put")))
    texts = F.when(mine, F.array(kind(0, shared), kind(1, own), kind(2, put))).otherwise(F.array(kind(0, shared)))
    keys = ["bucket", "row", "guest", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(*keys, F.inline(texts)).select(*keys, "part", F.explode("ps").alias("paragraph"))
    found = paragraph_vectors(rows, [*keys, "part"])
    found = found.groupBy(*keys).agg(*(F.max(F.when(F.col("part") == k, F.col("fp"))).alias(f"_p{k}") for k in range(3)))
    with_shared = lambda k: F.coalesce(plus(F.col("_p0"), F.col(f"_p{k}")), f"_p{k}", "_p0")
    found = found.withColumns({"_f": with_shared(1), "_g": with_shared(2)})
    found = found.withColumn("_n", F.lead("_f").over(W.partitionBy("bucket").orderBy("row"))).filter("guest = 0")
    found = found.withColumns({f"_s{x}": signs(F.col(f"_{x}")) for x in "fgn"})
    near = lambda x: likeness(F.col("_f"), F.col(f"_{x}"), F.col("_sf"), F.col(f"_s{x}"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("_f")).alias("fingerprint"), to_text(F.col("_g")).alias("edited_fingerprint"),
        near("g").alias("near_edited"), near("n").alias("near_next"),
    )


def fingerprint_sql() -> str:
    """The rows of :func:`edit_fingerprints` over ``documents`` in DuckDB's SQL."""
    hexed = lambda x, n: f"lpad(lower(to_hex({x})), {n}, '0')"
    exact = [f"(sum(('0x' || substr(sha256('{k // 8}:' || p), {1 + 8 * (k % 8)}, 8))::bigint) % {1 << 32})::bigint as e{k}" for k in range(EXACT)]
    bit = lambda k, high: f"(h{k // HALF} >> {k % HALF + 32 * high}) & 1"
    lanes = [f"coalesce(sum({bit(k, high)}), 0)::bigint as {'lh'[high]}{k}" for k in range(PACKED) for high in (0, 1)]
    sign = ", ".join(f"(n - 2 * coalesce({x}{k}, 0))::double" for k in range(PACKED) for x in "lh")
    text = " || ".join([hexed("n", 8), *(hexed(f"e{k}", 8) for k in range(EXACT)), *(hexed(f"coalesce({x}{k}, 0)", 8) for k in range(PACKED) for x in "hl")])
    near = lambda x: f"""case when f.fp = {x}.fp then 1.0 else round(greatest(0.0, least(1.0, coalesce(
      list_dot_product(f.s, {x}.s) / nullif(sqrt(list_dot_product(f.s, f.s) * list_dot_product({x}.s, {x}.s)), 0), 0.0))), 9) end"""  # noqa: E731
    return f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id desc nulls last, md5(coalesce(text, ''))) as i from documents),
x as (select *, coalesce(lead(t) over (order by i), first_value(t) over (order by i)) as u, coalesce(lead(i) over (order by i), 1) as j from d),
e as (select *, left(t, length(t) - length(t) // 3) || left(u, length(t) // 3) as v from x),
texts as (select i, 0 as edited, t from e union all select i, 1, v from e),
ps as (select i, edited, unnest(string_split(t, chr(10))) as p from texts),
strong as (select i, edited, {", ".join(exact)} from ps group by i, edited),
ws as (select i, edited, list_filter(regexp_split_to_array(p, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from ps),
ks as (select i, edited, w, unnest(generate_series(1, len(w))) as k from ws),
ss as (select i, edited, md5(case when k > 2 then w[k - 2] else '' end || ' ' || case when k > 1 then w[k - 1] else '' end || ' ' || w[k]) as m from ks),
hs as (select i, edited, ('0x' || substr(m, 1, 15))::bigint as h0, ('0x' || substr(m, 16, 15))::bigint as h1 from ss),
sketch as (select i, edited, count(*) as m, {", ".join(lanes)} from hs group by i, edited),
f as (select i, edited, {text} as fp, [{sign}] as s from (select *, coalesce(m, 0) as n from strong left join sketch using (i, edited)))
select e.doc_id, length(e.t) as n_chars, sha256(e.v) as edited_sha256, f.fp as fingerprint, g.fp as edited_fingerprint,
  {near("g")} as near_edited, {near("h")} as near_next
from e join f on f.i = e.i and f.edited = 0 join f g on g.i = e.i and g.edited = 1 join f h on h.i = e.j and h.edited = 0
"""
