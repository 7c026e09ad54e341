"""Canonical exact fingerprints and groups of equal documents, in DataFrame functions only.

The canonical form is NFKC with full case folding, white space folded to single spaces and none at the ends.
The fingerprint is 128 bits of xxhash64 under two seeds. Rows meet in narrow digest buckets first; only
buckets with several rows are compared byte by byte, by grouping on digest and canonical text together, which
is combined before the shuffle, so a hot text costs one row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

#: Digests up to which the list of buckets with several rows is broadcast; beyond it the join shuffles.
BROADCAST_DIGESTS = 1_000_000


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty. ICU's composition and folding are reached by java_method, a built-in SQL function."""
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    # folding may take compositions apart
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def digest(form: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), form)), 16, "0")))


def _text_key(text: Column) -> Column:
    """Tells raw texts apart in narrow rows."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _forms(docs: DataFrame, prints: DataFrame, digest_of: Callable[[Column], Column]) -> DataFrame:
    """fingerprint, form, form_rank, group_id, copies, written, of the digests that several rows of prints (doc_id, text_key, fingerprint) share."""
    shared = prints.select("fingerprint").groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    keys = materialize(prints.join(shared, "fingerprint", "left_semi").select("text_key").distinct())
    few = keys.count() <= BROADCAST_DIGESTS
    again = docs.select("doc_id", "text").join(F.broadcast(keys) if few else keys, _text_key(F.col("text")) == F.col("text_key"), "left_semi")
    again = again.select("doc_id", canonical(F.col("text")).alias("form")).select("doc_id", "form", digest_of(F.col("form")).alias("fingerprint"))
    forms = materialize(again.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies")))
    release(keys)
    clash = forms.groupBy("fingerprint").agg(F.count("*").alias("forms")).filter("forms > 1")
    ranked = forms.join(clash, "fingerprint", "left_semi").withColumn("form_rank", F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")) - 1)
    whole = forms.join(clash, "fingerprint", "left_anti").withColumn("form_rank", F.lit(0))
    out = materialize(whole.unionByName(ranked))
    release(forms)
    return out


def exact_groups(docs: DataFrame, digest_of: Callable[[Column], Column] = digest) -> DataFrame:
    """fingerprint, form_rank, group_id, copies of every canonical form that several rows of docs (doc_id, text) have, or whose digest several rows share.

    group_id is the least doc_id of the group (null if all are null). form_rank is 0 but for a digest that
    different forms share: those are told apart by their bytes and numbered in byte order. Null and empty
    texts are one form. An empty table gives no rows.
    """
    prints = materialize(docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), digest_of(canonical(F.col("text"))).alias("fingerprint")))
    out = _forms(docs, prints, digest_of).select("fingerprint", "form_rank", "group_id", "copies")
    release(prints)
    return out


def _with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (doc_id, text, fingerprint) with next_text, next_fingerprint: of the next row in descending doc_id, after the last of the first.

    Rows that share an id are ordered by a hash of their text; null ids come last. Rows are dealt out by
    ranges of ids, and the first row of each range is copied into the range before it.
    """
    ids = rows.select("doc_id")
    shares = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 10_000).alias("b")).first()["b"] or []
    bounds = F.array(*map(F.lit, sorted(set(found)))) if found else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), buckets + 1).otherwise(F.size(F.filter(bounds, lambda b: b > F.col("doc_id"))))
    heads = {r["bucket"]: r["head"] for r in ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt = rows.withColumn("bucket", bucket).withColumn("copy", F.lit(0))
    # at most a row for each range
    before = {b: order[i - 1] for i, b in enumerate(order)}
    known = [b for b in order if heads[b] is not None]
    # a flat map: one branch for each range would nest too deeply
    kind = ids.schema["doc_id"].dataType
    at = F.element_at(F.create_map(*(v for b in known for v in (F.lit(heads[b]).cast(kind), F.lit(before[b])))), F.col("doc_id")) if known else F.lit(None).cast("int")
    if len(known) < len(order):
        at = F.when(F.col("doc_id").isNull(), before[order[-1]]).otherwise(at)
    wanted = F.col("doc_id").isin([heads[b] for b in known]) if known else F.lit(False)
    if len(known) < len(order):
        wanted = wanted | F.col("doc_id").isNull()
    first = rows.filter(wanted).withColumn("bucket", at).groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text", "fingerprint", "h"), "h").alias("r"))
    first = first.select("r.doc_id", "r.text", "r.fingerprint", "r.h", "bucket", F.lit(1).alias("copy"))
    w = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), "h")
    both = dealt.unionByName(first).select("doc_id", "text", "fingerprint", "copy", F.lead("text").over(w).alias("next_text"), F.lead("fingerprint").over(w).alias("next_fingerprint"))
    return both.filter("copy = 0").drop("copy")


def fingerprint_report(docs: DataFrame, digest_of: Callable[[Column], Column] = digest) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id for every row of docs (doc_id, text).

    The edited text has its last third replaced by the beginning of the next row's text in descending
    doc_id. An exact fingerprint's likeness is 1 or 0. group_id is the least doc_id with the same canonical
    form: forms that share a digest by chance are told apart by their bytes. Null counts as the empty text;
    repeated rows are in one group; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("fingerprint", digest_of(canonical(F.col("text"))))
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    out = _with_next(rows, buckets).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint", _text_key(F.col("text")).alias("text_key"))
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", digest_of(canonical(F.col("edited"))).alias("edited_fingerprint"), "next_fingerprint", "text_key")
    # the texts' canonical forms are made once; from here on rows are narrow
    out = materialize(out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"), "text_key"))
    forms = _forms(docs, out.select("doc_id", "text_key", "fingerprint"), digest_of)
    groups = forms.groupBy("fingerprint").agg(F.min("group_id").alias("group_id"), F.max("form_rank").alias("last"))
    own = F.col("group_id")
    out = out.join(groups, "fingerprint", "left")
    clash = forms.join(groups.filter("last > 0").select("fingerprint"), "fingerprint", "left_semi")
    if not clash.isEmpty():
        # the texts of these digests alone: each one's form tells its group
        texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", _text_key(F.col("text")))
        texts = texts.join(out.filter("last > 0").select("text_key").distinct(), "text_key", "left_semi").select("text_key", canonical(F.col("text")).alias("form"))
        by_text = texts.join(clash.select("form", F.col("group_id").alias("form_group")), "form").groupBy("text_key").agg(F.min("form_group").alias("form_group"))
        out = out.join(by_text, "text_key", "left")
        own = F.when(F.col("last") > 0, F.col("form_group")).otherwise(F.col("group_id"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce(own, "doc_id").alias("group_id"))
