"""Personal data: candidate spans, boosted trees, calibrated thresholds; built-in functions and MLlib only.

Strict generators find the base spans, which always count once their check
holds. Loose generators propose more spans, which may overlap. Boosted trees
score those by format and context. They learn what a kind looks like from
candidates that lie on its base spans, once as they stand and once without what
made them strict (a number without its plus and country, an address in words);
and what it does not look like from candidates on base spans of other kinds, and
from those that their format or context rules out: dates, numbers of orders and
versions, card numbers that fail their check, addresses without a domain. A
threshold per loose generator is set on scores by trees that did not see the
candidate, and what reaches it is added. A candidate that touches base spans is scored by what they leave of it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastline.llm.tables import cut, sha256_hex

#: kind, what a text must have for the pattern to be tried, pattern. Possessive
#: repeats and the look-behind keep long runs linear; they match the same spans
#: as the plain patterns, since what follows a run is never in its class.
BASE = (
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
LOOSE = (
    ("contact", r"@|\(at\)|\[at\]",
     r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+"),
    ("number", r"[0-9]", r"(?<![A-Za-z0-9])[+(]?[0-9](?:[().\x20-]{0,2}+[0-9]){5,}+(?![A-Za-z0-9])"),
)
#: What a number is not: a date, or something its text calls by another name.
DATE = r"^(?:(?:19|20)[0-9]{2}[-. ](?:0?[1-9]|1[0-2])(?:[-. ][0-3]?[0-9])?|[0-3]?[0-9][-. ][01]?[0-9][-. ](?:19|20)[0-9]{2})$"
OTHER_NUMBER = r"(?i)(?:order|invoice|ticket|case|item|serial|model|version|release|isbn|page|part|ref(?:erence)?|id|no|nr)[.:#]{0,2} ?#?$"
#: The kind under which an accepted loose candidate is listed.
LISTED = {"contact": "email", "number": "phone"}
ORDER = ("email", "ip", "card", "phone")
PRECISION, BINS = 0.95, 50
TREES = dict(maxIter=10, maxDepth=4, stepSize=0.3, seed=7, labelCol="label", featuresCol="features", weightCol="weight")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn() -> str:
    d = "reverse(regexp_replace(value, '[^0-9]', ''))"
    x = f"cast(substring({d}, i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (acc, i) -> acc + if(i % 2 = 0, {x} * 2 - if({x} > 4, 9, 0), {x})) % 10 = 0"


def _valid() -> Column:
    """The check of a strict generator; loose ones have none."""
    n = F.length(_digits(F.col("value")))
    return (F.when(F.col("gen") == "email", True)
            .when(F.col("gen") == "ip", F.expr(r"forall(split(value, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"))
            .when(F.col("gen") == "card", n.between(16, 19) & F.when(n.between(16, 19), F.expr(_luhn())).otherwise(False))
            .when(F.col("gen") == "phone", n.between(8, 15)).otherwise(True))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, gen, start, end, value, before, after) of every match; code points.

    Pieces between the matches and the matches themselves give the offsets: a
    running sum per document and generator, over rows with a match only.
    """
    text = F.col("text").cast("string")
    every = F.array(*(F.struct(F.lit(gen).alias("gen"), F.when(F.col("text").rlike(gate), F.split("text", rx, -1)).alias("pieces"),
                               F.when(F.col("text").rlike(gate), F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("found"))
                      for gen, gate, rx in (*BASE, *LOOSE)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(r"[0-9@]|\(at\)|\[at\]"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.inline(every)).where("size(found) > 0")
    zipped = F.arrays_zip(F.col("found").alias("value"), F.slice("pieces", F.lit(1), F.size("found")).alias("piece"),
                          F.slice("pieces", F.lit(2), F.size("found")).alias("next"))
    rows = rows.select("doc_id", "text_key", "gen", F.posexplode(zipped).alias("at", "z")).select(
        "doc_id", "text_key", "gen", "at", F.col("z.value").alias("value"), F.length("z.piece").alias("skip"),
        F.right("z.piece", F.lit(24)).alias("before"), F.left("z.next", F.lit(8)).alias("after")).distinct()
    order = Window.partitionBy("doc_id", "text_key", "gen").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skip") + F.length("value")).over(order)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).where(_valid()).select(
        "doc_id", "text_key", "gen", "start", "end", "value", "before", "after")


FEATURES = ("is_number", "length", "digits", "letters", "dots", "dashes", "spaces", "parens", "at_sign", "plus", "groups", "longest", "head", "tail",
            "word_before", "mark_after", "hint", "dated", "named")


def features(rows: DataFrame) -> DataFrame:
    """Format and context as numbers; none of them is a check of a strict generator."""
    v = F.col("value")

    def count(chars: str) -> Column:
        return F.length(v) - F.length(F.translate(v, chars, ""))

    groups = F.filter(F.split(v, "[^0-9A-Za-z]+"), lambda g: g != "")
    made = {
        "is_number": (F.col("gen") == "number").cast("double"), "length": F.length(v), "digits": count("0123456789"),
        "letters": F.length(v) - F.length(F.regexp_replace(v, "[A-Za-z]", "")), 
        "dots": count(".") + (F.length(v) - F.length(F.regexp_replace(v, r"[(\[]dot[)\]]", ""))) / 5, "dashes": count("-"), "spaces": count(" "),
        "parens": count("()"), "at_sign": count("@"), "plus": F.when(v.startswith("+") | F.col("before").rlike(r"\+[0-9]? ?$"), 1).otherwise(0), "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "head": F.coalesce(F.length(F.try_element_at(groups, F.lit(1))), F.lit(0)),
        "tail": F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)), "word_before": F.when(F.col("before").rlike("[A-Za-z]{2,} $"), 1).otherwise(0),
        "dated": F.when(v.rlike(DATE), 1).otherwise(0), "named": F.when(F.col("before").rlike(OTHER_NUMBER), 1).otherwise(0),
        "mark_after": F.when(F.col("after").rlike("^[.,;:!?]"), 1).otherwise(0),
        "hint": F.when(F.lower("before").rlike("tel|phone|call|fax|mobile|mail|contact|card|visa|ip"), 1).otherwise(0)}
    return rows.withColumns({k: made[k].cast("double") for k in FEATURES})


def _blocks(rows: DataFrame) -> DataFrame:
    """A span stands under each block of 64 code points it touches, so that joins have plain keys."""
    return rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))))


def with_base(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans, and loose candidates with ``spans``: the base spans they touch, in order."""
    strict, loose = found.where(F.col("gen").isin(*ORDER)), found.where(~F.col("gen").isin(*ORDER))
    null_id = F.col("doc_id").isNull()
    spans = _blocks(strict).select(F.coalesce("doc_id", F.lit(-1)).alias("d"), null_id.alias("dn"), F.col("text_key").alias("t"), F.col("block").alias("b"),
                                   F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("gen").alias("kind")).alias("span"))
    keyed = _blocks(loose).withColumns({"d": F.coalesce("doc_id", F.lit(-1)), "dn": null_id}).withColumnsRenamed({"text_key": "t", "block": "b"})
    touches = (F.col("span.s") < F.col("end")) & (F.col("span.e") > F.col("start"))
    met = keyed.join(spans, ["d", "dn", "t", "b"], "left").groupBy("doc_id", F.col("t").alias("text_key"), "gen", "start", "end", "value", "before", "after").agg(
        F.array_sort(F.collect_set(F.when(touches, F.col("span")))).alias("spans"))
    return strict, met


def labelled(loose: DataFrame) -> DataFrame:
    """Candidates of known kind with ``label``: whether they are of the kind their generator lists.

    A candidate on a base span of that kind also counts in the form that no strict generator finds.
    """
    overlap = lambda s: F.least(F.col("end"), s["e"]) - F.greatest(F.col("start"), s["s"])

    def lies_on(*kinds: str) -> Column:
        return F.exists("spans", lambda s: s["kind"].isin(*kinds) & (overlap(s) * 5 >= (F.col("end") - F.col("start")) * 4))

    digits, free = F.length(_digits(F.col("value"))), F.size("spans") == 0
    number, contact = F.col("gen") == "number", F.col("gen") == "contact"
    other = F.col("value").rlike(DATE) | (digits > 15) | F.col("before").rlike(OTHER_NUMBER)
    label = (F.when(number & lies_on("phone"), 1.0).when(number & lies_on("card", "ip"), 0.0).when(number & free & other, 0.0)
             .when(contact & lies_on("email"), 1.0).when(contact & free & ~F.col("value").rlike(r"\.|dot"), 0.0))
    known = loose.withColumn("label", label.cast("double")).where("label is not null")
    bare = F.when(number, F.regexp_replace("value", r"^\+(?:[0-9]{1,3}(?=[^0-9]))?[\x20.-]*", "")).otherwise(F.regexp_replace("value", "@", " (at) "))
    masked = known.where("label = 1").withColumn("value", bare).where(contact | (F.length(_digits(F.col("value"))) >= 7))
    return known.withColumn("form", F.lit(0)).unionByName(masked.withColumn("form", F.lit(1)))


def open_pieces(loose: DataFrame) -> DataFrame:
    """What base spans leave of each candidate, where it still fits its generator."""
    start = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("free"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["s"] > acc["at"], F.array(F.struct(acc["at"].alias("a"), s["s"].alias("b")))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
        return F.struct(F.greatest(acc["at"], s["e"]).alias("at"), F.concat(acc["free"], gap).alias("free"))

    ends = F.concat("spans", F.array(F.struct(F.col("end").alias("s"), F.col("end").alias("e"), F.lit("").alias("kind"))))
    rows = loose.withColumn("piece", F.explode(F.aggregate(ends, start, step, lambda acc: acc["free"])))
    text = F.substring(F.col("value"), F.col("piece.a") - F.col("start") + 1, F.col("piece.b") - F.col("piece.a"))
    fitting = F.coalesce(*(F.when(F.col("gen") == gen, F.regexp_extract("text", rx, 0)) for gen, _, rx in LOOSE))
    rows = rows.withColumn("text", text).withColumn("fit", fitting).where("fit <> ''")
    rows = rows.withColumn("at", F.col("piece.a") + F.expr("position(fit, text)") - 1)
    lead = F.concat("before", F.left("value", (F.col("at") - F.col("start")).cast("int")))
    rest = F.concat(F.right("value", F.greatest(F.lit(0), F.col("end") - F.col("at") - F.length("fit")).cast("int")), F.col("after"))
    return rows.select("doc_id", "text_key", "gen", F.col("at").alias("start"), (F.col("at") + F.length("fit")).alias("end"), F.col("fit").alias("value"),
                       F.right(lead, F.lit(24)).alias("before"), F.left(rest, F.lit(8)).alias("after")).distinct()


def _fit(rows: DataFrame):
    """Boosted trees over weighted rows. Up to so many rows MLlib proposes its splits from all of them, not from a draw."""
    return GBTClassifier(**TREES, maxBins=32 if (n := rows.count()) <= 10_000 else math.ceil(math.sqrt(n))).fit(rows)


def train(known: DataFrame):
    """(model, {generator: (threshold, precision, recall)}) from all labelled
    candidates, or None where no half of them holds both classes.

    Candidates of equal features are one row with their number as its weight. Each
    half, drawn by hash, is scored by trees that learned from the other one; a threshold
    lies halfway below the least of these scores from which on the precision reaches ``PRECISION``;
    precision and recall are those at the threshold. The model itself learns from both halves."""
    draw = F.xxhash64("doc_id", "start", "gen")  # both forms of a candidate fall into one half
    equal = features(known).groupBy("gen", "label", *FEATURES, F.pmod(draw, F.lit(2)).alias("fold")).agg(F.count("*").cast("double").alias("weight"))
    rows = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(equal).select("gen", "label", "features", "fold", "weight"), "pii-labelled")
    classes = {(r["fold"], r["label"]) for r in rows.select("fold", "label").distinct().collect()}
    able = [k for k in (0, 1) if {(k, 0.0), (k, 1.0)} <= classes]
    if not able:
        return None
    score = F.floor(vector_to_array("probability")[1] * (BINS - 1))
    scored = [_fit(rows.where(F.col("fold") == k)).transform(rows.where(F.col("fold") == 1 - k)).select("gen", "label", "weight", score.alias("bin")) for k in able]
    bins = reduce(DataFrame.unionByName, scored).groupBy("gen", "bin").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("hits")).collect()
    model = _fit(rows)
    limits = {}
    for gen, _, _ in LOOSE:
        own = sorted((r for r in bins if r["gen"] == gen), key=lambda r: -r["bin"])
        n = hits = 0
        for b, below in zip(own, [*(r["bin"] for r in own[1:]), 0]):
            n, hits = n + b["n"], hits + b["hits"]
            if hits >= PRECISION * n:  # any limit above the next score gives the same; the middle leaves most room
                limits[gen] = ((b["bin"] + below) / 2 / (BINS - 1), hits / n, hits / sum(r["hits"] for r in own))
    return model, limits


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, start, end, base) of all selected spans, without repeats."""
    strict, loose = with_base(cut(candidates(docs), "pii-candidates"))
    base = strict.select("doc_id", "text_key", F.col("gen").alias("kind"), "start", "end", F.lit(True).alias("base"))
    loose = cut(loose, "pii-loose")
    trained = train(labelled(loose))
    if trained is None:
        return base
    model, limits = trained
    free = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(open_pieces(loose)))
    limit = F.coalesce(*(F.when(F.col("gen") == g, F.lit(float(x))) for g, (x, _, _) in limits.items()), F.lit(2.0))
    added = model.transform(free).where(vector_to_array("probability")[1] >= limit).select(
        "doc_id", "text_key", F.coalesce(*(F.when(F.col("gen") == g, F.lit(k)) for g, k in LISTED.items())).alias("kind"), "start", "end", F.lit(False).alias("base"))
    return base.unionByName(added)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all): one row per row of ``docs``.

    Null and empty texts have no spans. Rows that repeat doc_id and text have
    the same spans. A null doc_id is kept. Other columns play no part. Texts
    are never shuffled.
    """
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind")).cast("int")
    item = F.struct(rank.alias("k"), "start", "end")
    found = find_spans(docs).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("dn"), F.col("text_key").alias("t")).agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in ORDER),
        F.collect_set(F.when(F.col("base"), item)).alias("base"), F.collect_set(item).alias("all"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(-1))).withColumn("dn", F.col("doc_id").isNull())
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")
    return rows.join(found, ["d", "dn", "t"], "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ORDER),
        sha256_hex(_listed(F.coalesce("base", none))).alias("base_sha256"), _listed(F.coalesce("all", none)).alias("spans"))
