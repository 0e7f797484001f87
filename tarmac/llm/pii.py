"""Personal data and the terms that reveal it, by information content.

Direct identifiers (email, ip, card, phone) are found by pattern. Each
distinct identifier is a protected entity e. The corpus says how strongly a
term t reveals it by where both are said: with document frequencies over all
documents,

    IC(e) = -log2 p(e)      PMI(e, t) = log2 p(e, t) / (p(e) p(t))

and the share PMI / IC is how much of e's information t gives away (1: t
is said only where e is, and e can be told from it). Wherever it stands, a
mention of a term that reaches ``GENERALISE`` is generalised to a placeholder,
from ``REMOVE`` on it is removed. A term must be said together with e in
``SUPPORT`` different texts, so copies of one document do not make their words
revealing.

Only DataFrame functions are used. Positions are code points: between two
matches lies the piece that splitting by the same pattern gives, so starts
are running sums of piece and match lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import join_small, packed, stage, text_of, unpacked

#: The patterns of the result's definition, anchored so that a search never starts twice in one run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap conditions without which a pattern cannot match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
ORDER = {k: i for i, k in enumerate([*PATTERNS, "term"])}
TERM = r"(?<!\S)\p{L}{4,}(?=[,.;:!?]*(?:\s|$))"
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Documents for which a staged table has one file: of small inputs in many partitions, few files.
FILE_DOCS = 20_000
HITS = "array<struct<kind string, i int, gap int, value string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(0), F.length(back) - 1), lambda i: F.substring(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    small = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
    return (F.when(kind == "ip", value.rlike(small)).when(kind == "card", _luhn(value))
            .when(kind == "phone", F.length(_digits(value)).between(10, 15)).otherwise(F.lit(True)))


def _hits(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text_key, hits) per row: every match with the length of the text before it."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_of().alias("text"))
    for kind, pattern in PATTERNS.items():
        need = F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("text").rlike("[0-9](?:[ -]?[0-9]){13}")
        rows = rows.withColumn(f"m_{kind}", F.when(need, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)))

    def of(kind: str) -> Column:
        p = F.col(f"p_{kind}")
        each = F.transform(f"m_{kind}", lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(p[i]).alias("gap"), m.alias("value")))
        return F.when(F.size(f"m_{kind}") > 0, each).otherwise(F.array().cast(HITS))

    return rows.select("uid", "doc_id", F.md5("text").alias("text_key"), F.concat(*map(of, PATTERNS)).alias("hits"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.md5(text_of()).alias("text_key"), text_of().alias("text"))


def _of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, text): the texts of ``docs`` whose key is in ``keys`` (key), once each."""
    return join_small(_texts(docs), keys, F.col("text_key") == F.col("key"), "left_semi").dropDuplicates(["text_key"])


def _said(texts: DataFrame) -> DataFrame:
    """(text_key, term): the different words of each row."""
    return texts.select("text_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))


def _mentions(texts: DataFrame) -> DataFrame:
    """(text_key, term, start, end): the places of the words that ``pattern`` finds in each text."""
    m, pattern = F.col("m"), F.col("pattern")
    cut = texts.select("text_key", F.regexp_extract_all("text", pattern, F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("p"))
    each = cut.where(F.size("m") > 0).select("text_key", F.posexplode(F.arrays_zip(F.slice("p", F.lit(1), F.size("m")).alias("gap"), m.alias("word"))).alias("i", "x"))
    run = Window.partitionBy("text_key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.length("x.gap") + F.length("x.word")).over(run))
    return placed.select("text_key", F.lower("x.word").alias("term"), (F.col("end") - F.length("x.word")).alias("start"), "end")


def _few(df: DataFrame, name: str, total: int) -> DataFrame:
    return stage(df.coalesce(1 + total // FILE_DOCS), name)


def _revealing(docs: DataFrame, spans: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share) of the terms that reach the lower threshold, and (text_key, term): who says a term that was in question."""
    # One row per text and entity, with the number of documents that have the text.
    texts = spans.select("text_key", "entity", "uid").distinct().groupBy("text_key", "entity").agg(F.count("*").alias("copies"))
    entities = texts.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("with_entity")).where(F.col("texts") >= SUPPORT)
    protected = _few(texts.join(entities.drop("texts"), "entity"), "pii-entities", total)
    own = _said(_of_keys(docs, protected.select(F.col("text_key").alias("key")).distinct()))
    joint = protected.join(own, "text_key").groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("both"), F.max("with_entity").alias("with_entity"))
    joint = _few(joint.where(F.col("texts") >= SUPPORT), "pii-joint", total)
    asked = _few(joint.select(F.col("term").alias("asked")).distinct(), "pii-terms", total)
    said = _few(join_small(_said(_texts(docs)), asked, F.col("term") == F.col("asked"), "left_semi"), "pii-said", total)
    terms = said.groupBy("term").agg(F.count("*").alias("with_term"))
    pmi = F.log2(F.col("both") * F.lit(float(total)) / (F.col("with_entity") * F.col("with_term")))
    share = F.try_divide(pmi, -F.log2(F.col("with_entity") / F.lit(float(total))))
    return joint.join(terms, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE), said


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (uid, doc_id, text_key) and their spans (uid, kind, start, end, share; share is null for direct identifiers)."""
    total = docs.count()
    hits = _few(_hits(docs), "pii-hits", total)
    rows = hits.select("uid", "doc_id", "text_key")
    each = hits.where(F.size("hits") > 0).select("uid", "text_key", F.explode("hits").alias("h")).select("uid", "text_key", "h.*")
    order = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(order)).withColumn("start", F.col("end") - F.length("value"))
    each = each.where(valid(F.col("kind"), F.col("value"))).withColumn("entity", F.concat_ws(":", "kind", F.lower("value")))
    spans = _few(each.select("uid", "text_key", "kind", "start", "end", "entity"), "pii-spans", total)
    share, said = _revealing(docs, spans, total)
    share = _few(share.groupBy(F.col("term").alias("reveals")).agg(F.max("share").alias("share")), "pii-shares", total)
    # Terms are letters only, so they stand for themselves in a pattern.
    own = join_small(said, share, F.col("term") == F.col("reveals"), "inner").groupBy(F.col("text_key").alias("key")).agg(F.array_join(F.sort_array(F.collect_set("term")), "|").alias("all"))
    any_of = F.concat(F.lit(r"(?iu)(?<!\S)(?:"), F.col("all"), F.lit(r")(?=[,.;:!?]*(?:\s|$))"))
    keys = _few(own.select("key", any_of.alias("pattern")), "pii-keys", total)
    saying = join_small(_texts(docs), keys, F.col("text_key") == F.col("key"), "inner").dropDuplicates(["text_key"])
    found = join_small(_mentions(saying), share, F.col("term") == F.col("reveals"), "inner").select(F.col("text_key").alias("key"), "start", "end", "share")
    terms = join_small(rows, _few(found, "pii-mentions", total), F.col("text_key") == F.col("key"), "inner")
    direct = spans.select("uid", "kind", "start", "end", F.lit(None).cast("double").alias("share"))
    return rows, direct.unionByName(terms.select("uid", F.lit("term").alias("kind"), "start", "end", "share"))


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null text counts as empty: no spans, and the digest of the empty string.
    Repeated rows are each reported. An empty table gives an empty result.
    """
    rows, spans = find_spans(docs)
    none = F.lit(None)
    # Rows without spans come along, so that one grouping serves all.
    every = rows.select("uid", "doc_id", none.cast("string").alias("kind"), none.cast("bigint").alias("start"), none.cast("bigint").alias("end"))
    every = every.unionByName(spans.select("uid", none.cast(docs.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end"))
    place = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), ORDER.items(), F.when(F.lit(False), -1))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", place.alias("place"), "kind", "end"))
    lists = every.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("all"))

    def text(keep) -> Column:
        picked = F.filter("all", keep) if keep else F.col("all")
        return F.array_join(F.transform(picked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return lists.select("doc_id", *map(count, PATTERNS), F.sha2(text(lambda s: s["kind"] != "term"), 256).alias("base_sha256"),
                        text(None).alias("spans"), count("term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced: [EMAIL], [IP], [CARD],
    [PHONE]; revealing terms by [TERM], or by nothing from ``REMOVE`` on. Of
    overlapping spans the earlier (then longer) one is replaced."""
    rows, spans = find_spans(docs)
    order = Window.partitionBy("uid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    free = spans.withColumn("reach", F.max("end").over(order)).where(F.col("reach").isNull() | (F.col("start") >= F.col("reach")))
    new = F.when(F.col("kind") != "term", F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).when(F.col("share") >= REMOVE, "").otherwise("[TERM]")
    plan = free.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end", new.alias("new")))).alias("_spans")).join(rows, "uid")
    plan = plan.groupBy("doc_id", "text_key").agg(F.first("_spans").alias("_spans")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_spans")
    done = packed(docs, "doc_id", "text").join(plan, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.md5(text_of())), "left")
    s = F.col("_spans")
    parts = F.transform("_spans", lambda x, i: F.concat(F.substring("text", F.coalesce(F.get(s, i - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get(s, i - 1)["end"], F.lit(0))), x["new"]))
    tail = F.substring("text", F.element_at(s, -1)["end"] + 1, F.length("text"))
    text = F.when(s.isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return unpacked(done, docs, text=text)
