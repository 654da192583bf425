"""Document fingerprints: a canonical exact digest.

A text is brought to one form (Unicode compatibility composition, full case
folding, runs of white space as one space), and two xxhash64 digests of that
form make 128 bits.  Texts in one bucket of equal digests are then compared
byte for byte: grouping on digest and form, with partial aggregation, leaves
one row for each different form, so a bucket of copies never meets in a task.
Should two forms share a digest, all but the first get its number as a suffix:
equal fingerprints always mean equal forms, and equal forms equal fingerprints.

Everything is DataFrame and SQL functions (composition and case folding are those of
the ICU library that Spark brings along, called through ``java_method``).

Rows: a null text counts as empty, and empty texts have one fingerprint;
repeated rows have equal fingerprints; rows with one doc_id follow each other
by text in the document order, null doc_ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

_SPACE = r"[\s\u0085   -     　]+"


def canonical(text: Column) -> Column:
    """The form that is compared."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    # full folding; of upper() and lower() in a row the optimizer keeps only the last
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.trim(F.regexp_replace(folded, _SPACE, " "))


def digests(form: Column) -> Column:
    """128 bits as struct(a, b): xxhash64 under two seeds."""
    return F.struct(F.xxhash64(F.lit(1), form).alias("a"), F.xxhash64(F.lit(2), form).alias("b"))


def shown(digest: Column, number: Column | None = None) -> Column:
    both = F.concat(*[F.lower(F.lpad(F.hex(digest[x]), 16, "0")) for x in ("a", "b")])
    return both if number is None else F.when(number > 1, F.concat(both, F.lit("-"), number.cast("string"))).otherwise(both)


def collisions(forms: DataFrame) -> DataFrame:
    """forms: digest, form.  The forms that share a digest with another, numbered from 1; nearly always none."""
    different = forms.groupBy("digest", "form").agg(F.count("*").alias("n"))
    shared = different.groupBy("digest").agg(F.count("*").alias("forms")).where("forms > 1").select("digest")
    return different.join(shared, "digest", "left_semi").select("digest", "form", F.row_number().over(Window.partitionBy("digest").orderBy("form")).alias("number"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with the column fingerprint, to which a column of this name gives way."""
    docs, back = common.apart(docs, ("doc_id", "text"), ("fingerprint",))
    hashed = docs.withColumn("_form", canonical(common.text_of())).withColumn("_digest", digests(F.col("_form")))
    multi = hashed.select("_digest").groupBy("_digest").agg(F.count("*").alias("n")).where("n > 1").select("_digest")
    known = common.cut(collisions(hashed.join(multi, "_digest", "left_semi").select(F.col("_digest").alias("digest"), F.col("_form").alias("form"))))
    return back(_numbered(hashed, known, "_digest", "_form", "fingerprint").drop("_form", "_digest"))


def _numbered(df: DataFrame, known: DataFrame, digest: str, form: str, name: str) -> DataFrame:
    if known.isEmpty():
        return df.withColumn(name, shown(F.col(digest)))
    number = known.select(F.col("digest").alias("_d"), F.col("form").alias("_f"), F.col("number").alias("_n"))
    joined = df.join(number, (df[digest] == F.col("_d")) & (df[form] == F.col("_f")), "left")
    return joined.withColumn(name, shown(F.col(digest), F.col("_n"))).drop("_d", "_f", "_n")


def edited(text: Column, following: Column) -> Column:
    """The last half of a text replaced by as much of the head of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Each row with the struct next of the row after it in descending doc_id (after the last: the first).

    Rows are dealt into ranges of doc_id, several for each task; only a range's
    own order and the first row of the range after it are needed.
    """
    spark = docs.sparkSession
    ranges = 4 * common.partitions(spark)
    at = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", at, 50 * ranges).alias("b")).head()["b"] or []
    bounds = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    dealt = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))))
    row = F.struct(*carry)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    # the first rows of ranges: a row or a few for each range
    tops = dealt.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    heads = dealt.join(F.broadcast(tops.withColumnRenamed("_range", "_r")), (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = heads.groupBy("_range").agg(F.max_by(row, "text").alias("head"))
    names = tops.select("_range", F.lead("_range").over(Window.orderBy(F.desc("_range"))).alias("_after"), F.max("_range").over(Window.partitionBy(F.lit(1))).alias("_first"))
    names = names.select("_range", F.coalesce("_after", "_first").alias("_after"))
    after = names.join(heads.withColumnRenamed("_range", "_after"), "_after").select("_range", "head")
    w = Window.partitionBy("_range").orderBy(*order)
    # column by column: a struct would go through the shuffle beside its fields
    rows = dealt.select("*", *[F.lead(c).over(w).alias(f"_next_{c}") for c in carry], F.lead(F.lit(True)).over(w).alias("_has")).join(after, "_range", "left")
    following = F.when(F.col("_has"), F.struct(*[F.col(f"_next_{c}").alias(c) for c in carry])).otherwise(F.col("head"))
    return rows.withColumn("next", following).drop("_range", "head", "_has", *[f"_next_{c}" for c in carry])


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts and their edited texts, and what the fingerprints have in common."""
    texts = docs.select("doc_id", common.text_of().alias("text"))

    def frame(known: DataFrame | None) -> DataFrame:
        base = texts.withColumn("form", canonical(F.col("text"))).withColumn("digest", digests(F.col("form")))
        base = base.drop("form") if known is None else _numbered(base, known, "digest", "form", "fingerprint").drop("form")
        carry = ["doc_id", "text", "digest"] + ["fingerprint"] * (known is not None)
        out = with_next(base, carry).withColumn("edited_text", edited(F.col("text"), F.col("next.text")))
        out = out.withColumn("edited_form", canonical(F.col("edited_text"))).withColumn("edited_digest", digests(F.col("edited_form")))
        out = out.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited_text", 256)})
        keep = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", F.col("next.doc_id").alias("next_id"), F.col("next.digest").alias("next_digest")]
        if known is not None:
            out = _numbered(out, known, "edited_digest", "edited_form", "edited_fingerprint")
            keep = keep[:3] + ["fingerprint", "edited_fingerprint", F.col("next.fingerprint").alias("next_fingerprint")]
        return out.select(*keep)

    rows = common.stored(frame(None), "fingerprints")
    # byte comparison, of the rows in buckets of two and more
    every = rows.select("digest").union(rows.select("edited_digest"))
    multi = every.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    multi = common.stored(multi, "multi")
    own = common.sized(common.stored(rows.join(multi, "digest", "left_semi").select("doc_id").distinct(), "own"))
    by_edit = common.stored(rows.join(multi.withColumnRenamed("digest", "edited_digest"), "edited_digest", "left_semi").select("doc_id", "next_id").distinct(), "by-edit")
    plain = texts.join(own, "doc_id", "left_semi").select(canonical(F.col("text")).alias("form"))
    nexts = common.sized(by_edit.select("next_id").distinct())
    following = texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("following")).join(nexts, "next_id", "left_semi")
    changed = texts.join(common.sized(by_edit), "doc_id").join(following, "next_id").select(canonical(edited(F.col("text"), F.col("following"))).alias("form"))
    forms = plain.union(changed).select(digests(F.col("form")).alias("digest"), "form")
    known = common.cut(collisions(forms))
    if known.isEmpty():
        named = rows.select("doc_id", "n_chars", "edited_sha256", *[shown(F.col(d)).alias(n) for d, n in (("digest", "fingerprint"), ("edited_digest", "edited_fingerprint"), ("next_digest", "next_fingerprint"))])
    else:
        named = frame(known)
    alike = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "next_fingerprint").alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint all documents and their edited texts."""
    return compare(common.table(spark, sf_dir, "documents"))
