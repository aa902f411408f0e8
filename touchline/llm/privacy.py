"""Personal data: patterned entities and the terms that reveal them (built-in functions only).

Emails, IP addresses, payment cards and phone numbers are found by pattern. A term is a run of letters outside of
them. Texts of the whole corpus that hold both estimate how much of an entity's information a term gives away:
their pointwise mutual information log P(entity | term) / P(entity), as a share of the entity's own information
-log P(entity). Terms above a threshold are generalised to the class of their form, above a higher one removed,
wherever they stand in the texts that mention that entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, table, written
from .exact_dedup import probe
from .mixing import let

KINDS = ("email", "ip", "card", "phone")
ADDED = ("general", "remove")
# The same matches as the plain patterns, leftmost first: a lookbehind keeps the search from starting again
# inside a run of characters that has failed, and nothing gives back what it has taken, so that long runs
# take linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Stands for the characters of mentions, where terms are looked for; a word that touches it is no term.
MASK = "\uffff"
NO_TERM = r"\p{L}\x{FFFF}"
TERM = rf"(?<![{NO_TERM}])\p{{L}}++(?!\x{{FFFF}})"
#: A term needs so many texts that mention the entity, and to give away at least these shares of its information.
SUPPORT, GENERALISE, REMOVE = 2, 0.75, 0.9


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>>: the matches with their places in code points (end exclusive). The pieces
    between matches give the places."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def located(b: Column) -> Column:
        m, p = b["m"], b["p"]
        widths = F.zip_with(m, F.slice(p, 1, F.size(m)), lambda x, y: F.struct(F.length(y).alias("gap"), F.length(x).alias("own")))
        starts = F.aggregate(
            widths,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct((a["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(a["out"], a["at"] + x["gap"]).alias("out")),
        )["out"]
        return let(
            starts,
            lambda s: F.transform(m, lambda x, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), x.alias("value"))),
        )

    return let(both, located)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        return F.forall(short, lambda x: (F.length(x) <= 3) & (F.when(F.length(x) <= 3, x).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,end:int,value:string>>"


def mentions(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    hint = text.rlike("[0-9]") if kind == "card" else F.contains(text, F.lit(HINTS[kind]))
    return F.when(hint, found).otherwise(F.array().cast(_SPANS))


def _entity(kind: str, value: Column) -> Column:
    """What mentions in different spellings have in common."""
    if kind == "ip":
        value = F.array_join(F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ".")
    elif kind in ("card", "phone"):
        value = F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), F.lower(value))


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda x: _entity(kind, x["value"]))


def masked(text: Column, base: Column) -> Column:
    """The text with MASK for each character of the base spans, and nowhere else."""
    text = F.translate(text, MASK, " ")
    spans = F.array_sort(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def put(a: Column, x: Column) -> Column:
        from_ = F.greatest(x["start"], a["at"])
        out = F.concat(a["out"], F.substring(text, a["at"] + 1, from_ - a["at"]), F.repeat(F.lit(MASK), x["end"] - from_))
        return F.when(x["end"] <= a["at"], a).otherwise(F.struct(x["end"].alias("at"), out.alias("out")))

    filled = let(F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(base) > 0, filled).otherwise(text)


def _forms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _lowered(forms: Column) -> Column:
    return F.array_distinct(F.transform(forms, F.lower))


def _joined(spans: Column) -> Column:
    """spans: array<struct<kind:int, start:int, end:int>>, written kind:start:end in order."""
    names = F.array(*(F.lit(k) for k in KINDS + ADDED))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, row_no, base and added (arrays of kind, start, end in code points; kinds count
    through KINDS and ADDED) and sanitised, the text without them.

    Null texts count as empty. Matches of different kinds may overlap; words that overlap any of them are not
    terms. A text counts once for each of its terms and entities, repeated rows each. Texts and words of any
    length are read whole. Other columns are ignored; an empty table gives no rows.
    """
    src = docs.select(quoted(key).alias("key"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    found = src.select("key", "text", *(mentions(F.col("text"), k).alias(k) for k in KINDS))
    base = F.flatten(F.array(*(_of_kind(F.col(k), n) for n, k in enumerate(KINDS))))
    entities = F.array_distinct(F.flatten(F.array(*(_entities(k) for k in KINDS))))
    rows = found.select("key", "text", F.monotonically_increasing_id().alias("row_no"), base.alias("base"), entities.alias("entities"))
    rows = written(rows.select("key", "row_no", "base", "entities", masked(F.col("text"), F.col("base")).alias("masked")), "privacy-base")
    texts = F.lit(float(max(1, rows.count())))

    # Entities of a single text can't reach SUPPORT; a bounded bit filter leaves nearly all of them out early.
    holders = rows.filter(F.size("entities") > 0)
    shared = holders.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("mentioned")).filter(F.col("mentioned") >= SUPPORT)
    shared = written(shared, "privacy-shared")
    near = written(holders.select("row_no", "entities", _forms(F.col("masked")).alias("forms")), "privacy-words")
    near = probe(near.select("row_no", F.explode("entities").alias("digest"), "forms"), shared.select(F.col("entity").alias("digest"))).filter("maybe")
    near = near.select("row_no", F.col("digest").alias("entity"), "forms")
    # A text counts once for each of its entities and terms; partial counts meet, however common a pair is.
    pairs = near.select("entity", F.explode(_lowered(F.col("forms"))).alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= SUPPORT)
    together = written(together, "privacy-pairs")
    # How many texts of the whole corpus hold each such term.
    top = together.groupBy("term").agg(F.max("together").alias("top"))
    words = rows.select(F.explode(_lowered(_forms(F.col("masked")))).alias("digest"))
    total = probe(words, top.select(F.col("term").alias("digest"))).filter("maybe").groupBy(F.col("digest").alias("term")).agg(F.count("*").alias("total"))
    # Terms that no entity can claim, however rare, go before the join: a common word's pairs don't meet in a task.
    least = F.pow(F.lit(float(SUPPORT)) / texts, F.lit(1 - GENERALISE))
    total = written(top.join(total, "term").filter(F.col("top") >= least * F.col("total")).select("term", "total"), "privacy-totals")
    given_away = 1 + F.log(F.col("together") / F.col("total")) / F.log(texts / F.col("mentioned"))
    telling = (
        probe(together.withColumn("digest", F.col("term")), total.select(F.col("term").alias("digest")))
        .filter("maybe")
        .join(total, "term")
        .join(shared, "entity")
        # An entity of all texts has no information to give away.
        .filter((F.col("mentioned") < texts) & (given_away >= GENERALISE))
        .select("entity", "term", F.when(given_away >= REMOVE, len(KINDS) + 1).otherwise(len(KINDS)).alias("kind"))
    )
    telling = written(telling, "privacy-telling")
    # A term of several entities of a text takes the strictest verdict.
    pair = F.concat("entity", F.lit(MASK), "term")
    asked = near.select("row_no", "entity", F.explode("forms").alias("form")).withColumn("term", F.lower("form"))
    asked = probe(asked.withColumn("digest", pair), telling.select(pair.alias("digest"))).filter("maybe").drop("digest", "maybe")
    verdicts = asked.join(telling, ["entity", "term"]).groupBy("row_no", "form").agg(F.max("kind").alias("kind"))
    verdicts = written(verdicts.groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("form", "kind"))).alias("verdict")), "privacy-verdicts")
    pattern = F.concat(F.lit(f"(?<![{NO_TERM}])(?:"), F.array_join(F.map_keys("verdict"), "|"), F.lit(f")(?![{NO_TERM}])"))
    places = F.transform(
        matches(F.col("masked"), pattern),
        lambda x: F.struct(F.element_at("verdict", x["value"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    # Only texts that may have a verdict are shuffled to it.
    flagged = probe(rows.select("key", "row_no", "base", "masked", F.col("row_no").alias("digest")), verdicts.select(F.col("row_no").alias("digest"))).drop("digest")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    judged = flagged.filter("maybe").join(verdicts, "row_no", "left").withColumn("added", F.when(F.col("verdict").isNull(), none).otherwise(places))
    every = judged.drop("verdict").unionByName(flagged.filter("not maybe").withColumn("added", none))
    return every.select(F.col("key").alias(key), "row_no", "base", "added", sanitised(F.col("masked"), F.col("base"), F.col("added")).alias("sanitised"))


def _class_of(term: Column) -> Column:
    """What a generalised term is replaced by: the class of its form."""
    capital = F.substring(term, 1, 1)
    named = (capital == F.upper(capital)) & (capital != F.lower(capital))
    return F.when(named & (F.length(term) > 1) & (term == F.upper(term)), F.lit("<ACRONYM>")).when(named, F.lit("<NAME>")).otherwise(F.lit("<WORD>"))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """The text with <EMAIL> and the like for base spans, the class of its form (<NAME>, <ACRONYM> or <WORD>) for
    generalised terms, and without removed ones. Of spans that overlap the first is replaced, the longest of those
    that start together."""
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS), F.lit(None).cast("string"), F.lit(""))
    spans = F.array_sort(F.transform(F.concat(base, added), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(a: Column, x: Column) -> Column:
        mark = F.coalesce(F.get(marks, x["kind"]), _class_of(F.substring(text, x["start"] + 1, -x["back"] - x["start"])))
        kept = F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), mark)
        return F.when(x["start"] < a["at"], a).otherwise(F.struct((-x["back"]).alias("at"), kept.alias("out")))

    filled = let(F.aggregate(spans, start, put), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(base) + F.size(added) > 0, filled).otherwise(text)


def query(spark, sf_dir):
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(count_of(F.col("base"), n).alias(f"n_{k}") for n, k in enumerate(KINDS)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )
