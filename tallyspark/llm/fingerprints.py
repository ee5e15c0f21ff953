"""Document fingerprints: SpotSigs, DataFrame functions only.

A signature is a common word (the anchor) with the chain of the next two
content words.  A text's fingerprint is the sorted set of its hashed
signatures.  The query compares each text with its edit and with the next
document by plain Jaccard.  near_duplicates(), a library function that no query
uses, prunes by set length: sets whose lengths differ by more than the
threshold allows aren't compared.

Defined results: null text counts as empty; an empty text's fingerprint is the
empty string; a text without anchors takes chains of all its words, and one of
fewer than two words the hash of the whole text; two empty sets have likeness
1, an empty and a full one 0.  Rows are ordered by id descending, nulls last,
then text; a table of one row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, unused

#: Common words of the four languages.
COMMON = (
    "the of and to in a is that it for was on with as be by this are or at from an he "
    "de la que et le les des en un une du est pour dans qui par pas sur au avec "
    "der die und das den von zu mit sich ist im dem nicht ein eine als auf für auch es "
    "el los del las se por con para al lo como su"
).split()

#: Documents that a bucket of neighbours should hold, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 2000, 512


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of a text's spot signatures."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def chains(ws: Column) -> Column:
        content = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(COMMON), F.lit(-1)).otherwise(i)), lambda i: i >= 0)

        def spots(c: Column) -> Column:
            n = F.size(c)

            def spot(i: Column, j: Column) -> Column:
                after_anchor = (i > 0) & ((j == 0) | (F.get(c, j - 1) < i - 1)) & (j + 1 < n)
                return F.when(after_anchor, F.hash(F.get(ws, i - 1), F.get(ws, i), F.get(ws, F.get(c, j + 1))))

            return F.filter(F.transform(c, spot), lambda h: h.isNotNull())

        return bound(content, spots)

    def fallback(ws: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.hash(F.get(ws, i), F.get(ws, i + 1)))
        alone = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text)))
        return F.when(F.size(ws) >= 2, pairs).otherwise(alone)

    found = bound(words, lambda ws: bound(chains(ws), lambda s: F.when(F.size(s) > 0, s).otherwise(fallback(ws))))
    return F.array_sort(F.array_distinct(found))


def rendered(sigs: Column) -> Column:
    """A fingerprint as text: eight hex digits for each signature, ascending."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds signatures (array) and fingerprint (string)."""
    return df.withColumn("signatures", signatures(F.col(text))).withColumn("fingerprint", rendered(F.col("signatures")))


def length_partition(n: Column, threshold: float = 0.8) -> Column:
    """Sets whose Jaccard reaches the threshold lie in the same or in neighbouring partitions by length."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(1 / threshold))).cast("int")


def near_duplicates(df: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of texts with different fingerprints whose sets reach the threshold: (a, b, likeness), by least ids of equal fingerprints.

    Of each set the signatures up to its prefix length, rarest first, are
    joined within length partitions; candidates are compared by Jaccard.
    """
    sets = fingerprints(df.select(F.col(key).alias("id"), F.col(text).alias("t")), "t").where(F.size("signatures") > 0)
    sets = sets.groupBy("fingerprint").agg(F.min("id").alias("id"), F.first("signatures").alias("s")).select("id", "s", F.size("s").alias("n"))
    spots = sets.select("id", "n", F.explode("s").alias("h"))
    order = Window.partitionBy("id").orderBy("df", "h")
    rare = spots.join(spots.groupBy("h").agg(F.count("*").alias("df")), "h").withColumn("r", F.row_number().over(order))
    rare = rare.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    band = length_partition(F.col("n"), threshold)
    own = rare.select("h", F.col("id").alias("a"), F.col("n").alias("na"), band.alias("band"))
    seen = rare.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(band, band + 1)).alias("band"))
    fits = (F.col("nb") <= F.col("na")) & (F.col("nb") >= F.col("na") * threshold) & ((F.col("nb") < F.col("na")) | (F.col("b") < F.col("a")))
    pairs = own.join(seen, ["h", "band"]).where(fits).select("a", "b").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))
    compared = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return compared.where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def with_next(df: DataFrame, columns: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """Adds columns of the next row in descending key order; the row after the last is the first.

    Neighbours meet in buckets of the key's range, so one shuffle serves, no
    task sees all rows, and the first row of the next bucket is copied to each.
    """
    at, is_copy, rank = unused(df, "_bucket", "_copy", "_r")
    keys = df.agg(F.count("*").alias("n")).first()["n"]
    n = max(1, min(MAX_BUCKETS, -(-keys // BUCKET_ROWS)))
    bounds = []
    if n > 1:
        bounds = sorted(set(df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    base = df.withColumn(at, F.coalesce(F.when(F.col(key).isNull(), F.lit(0)).otherwise(bucket), F.lit(0)))
    heads = {r[0]: r[1] for r in base.groupBy(at).agg(F.max(key)).collect()}  # one row for each bucket
    used = sorted(heads)
    above = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}  # where a bucket's first row is the next of the last
    rows = base.withColumn(is_copy, F.lit(0))
    tops = [h for h in heads.values() if h is not None]
    if used:
        same = F.lit(False)
        moved = F.lit(None).cast("int")
        if tops:
            same = F.col(key).isin(tops)
        if None in heads.values():
            same = same | F.col(key).isNull()
        moved = F.element_at(F.create_map(*(F.lit(x) for kv in above.items() for x in kv)), F.col(at))
        first = Window.partitionBy(at).orderBy(F.col(key).desc_nulls_last(), *_ties(df))
        copies = base.where(same).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
        rows = rows.unionByName(copies.withColumn(at, moved).withColumn(is_copy, F.lit(1)))
    order = Window.partitionBy(at).orderBy(is_copy, F.col(key).desc_nulls_last(), *_ties(df))
    out = rows.withColumns({name: F.lead(value).over(order) for name, value in columns.items()})
    return out.where(F.col(is_copy) == 0).drop(is_copy, at)


def _ties(df: DataFrame) -> list[str]:
    return [c for c in ("text",) if c in df.columns]


def edited(df: DataFrame) -> DataFrame:
    """For doc_id and text: fingerprints of each text, of its edited text (its last third replaced by the next document's start) and their likeness."""
    docs = fingerprints(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long")))
    docs = with_next(docs.drop("fingerprint"), {"next_text": F.col("text"), "next_signatures": F.col("signatures")})
    third = F.floor(F.col("n_chars") / 3).cast("int")
    docs = docs.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third)))
    docs = docs.select("doc_id", "n_chars", "signatures", "next_signatures", "edited_text", signatures(F.col("edited_text")).alias("edited_signatures"))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        rendered(F.col("signatures")).alias("fingerprint"),
        rendered(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
