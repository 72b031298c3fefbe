"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base patterns find the seed entities, whole spans of one or more words.  The
word before a seed and the word after it are lexical patterns; every other
token with a digit or an @, and every run of tokens that are numbers, is an
unseen instance of the patterns next to it if no base span overlaps it.
Patterns and instances form a graph whose scores Spark computes in rounds: a
pattern's score is the mean score of its distinct instances, an instance's
score is that of the patterns that vouch for it (noisy or), for a kind whose
form it has.  Unseen instances of confident patterns are added as spans.  Base
spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domus.llm.common import cut, lower_ascii, text_or_empty
from domus.llm.spans import find_spans

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  A run of the first class is only tried at
# its start or right after a match, and repeats are possessive where nothing
# that follows could take characters back, so long runs stay linear and find
# the same matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"  # runs of 14 to 19 digits
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"[0-9][0-9().+/-]*+(?=[^\s0-9A-Za-z@]*+(?:\s|$))"  # up to a word's end, but for signs
# numbers with a space between them, else a word with a digit or an @
TOKEN = rf"(?<![^\s])(?:[+(]*+{NUMBER}(?:\x20[+(]*+{NUMBER})++|[^\s0-9@]*+[0-9@][^\s]*+)"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column, width: int = 19) -> Column:
    """Luhn check of a digit string of at most ``width`` digits."""
    padded = F.lpad(digits, width, "0")
    total = F.lit(0)
    for i in range(width):
        d = F.substring(padded, i + 1, 1).cast("int")
        if (width - 1 - i) % 2:
            d = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        total = total + d
    return total % 10 == 0


def _ip_ok(c: Column) -> Column:
    part = lambda i: F.regexp_replace(F.element_at(F.split(c, r"\."), i), "^0+", "")
    ok = F.lit(True)
    for i in range(1, 5):
        ok = ok & F.when(F.length(part(i)) > 3, False).when(F.length(part(i)) == 0, True) \
            .otherwise(part(i).cast("int") <= 255)
    return ok


def passes(kind: Column, value: Column) -> Column:
    """The checks a base match must pass besides its pattern."""
    n = F.length(_digits(value))
    return (F.when(kind == "ip", _ip_ok(value))
            .when(kind == "card", F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False))
            .when(kind == "phone", n.between(10, 15)).otherwise(True))


def has_form(kind: Column, token: Column) -> Column:
    """Whether an unseen instance is written as the kind's entities are."""
    return (F.when(kind.isin("card", "phone"), token.rlike(r"^[\x20()+./0-9-]+$"))
            .when(kind == "ip", token.rlike(r"^[0-9A-Fa-f.:]+$") & token.rlike("[.:]"))
            .otherwise(token.rlike("[A-Za-z]")))


def bootstrap(instances: DataFrame, rounds: int = 2, confidence: float = 0.9, support: int = 5) -> DataFrame:
    """(token, kind): unseen identifiers that confident patterns vouch for.

    ``instances`` has pattern, token and seed, the kind of a base span or
    null, one row per occurrence and pattern.  A pattern counts each distinct
    token once, so copies of a text add nothing.  A pattern is confident with
    a score of at least ``confidence`` and at least ``support`` distinct
    instances found before.  Hot patterns combine inside each task (sum and
    count), and the graph joins are plain equi-joins.
    """
    edges = cut(instances.select("pattern", "token", "seed").where((F.col("pattern") != "") & (F.col("token") != ""))
                .distinct(), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where(F.col("seed").isNotNull()).groupBy("pattern", F.col("seed").alias("kind")) \
        .agg(F.count("*").cast("double").alias("s"), F.count("*").alias("known"))
    unseen = edges.where(F.col("seed").isNull()).select("pattern", "token")
    scored = seeds
    for i in range(rounds):
        good = scored.where(F.col("known") >= support).join(sizes, "pattern") \
            .select("pattern", "kind", (F.col("s") / F.col("n")).alias("p")).where(F.col("p") >= confidence)
        fresh = unseen.join(good, "pattern").where(has_form(F.col("kind"), F.col("token"))) \
            .groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9))))))
                                          .alias("score"))
        best = fresh.groupBy("token").agg(F.max(F.struct("score", "kind")).alias("b")) \
            .select("token", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        found = cut(best, f"pii-round{i}")
        more = unseen.join(found, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("known"))
        scored = seeds.union(more).groupBy("pattern", "kind").agg(F.sum("s").alias("s"), F.sum("known").alias("known"))
    return found.where(F.col("score") >= confidence).select("token", "kind")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2,
             confidence: float = 0.9, support: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).  rows: ``docs``' id, text and a content key; spans:
    (doc_id, content, kind, start, end, value, base) for each distinct
    (doc_id, text).

    Null texts count as empty and have no spans.  Rows with a null id are
    handled like others (keys match null-safely).  Repeated rows share their
    spans.  Added spans never overlap a base span.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .withColumn("content", F.sha2(F.col("text").cast("binary"), 256))
    rules = [("email", EMAIL, ("@",)), ("ip", IP, (".",)), ("card", CARD_RUN, ()), ("phone", PHONE, ("+",)),
             ("token", TOKEN, ())]
    hits = cut(find_spans(rows, ["doc_id", "content"], rules, context=48)
               .where((F.col("kind") == "token") | passes(F.col("kind"), F.col("value"))), "pii-hits")
    base = hits.where("kind <> 'token'").select("doc_id", "content", "kind", "start", "end", "value",
                                                F.lit(True).alias("base"))
    # base spans that begin before a token's end and end after its start, over the spans of one document
    is_base = F.col("kind") != "token"
    w = Window.partitionBy("doc_id", "content").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(w.orderBy("start", ~is_base))) \
        .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(w.orderBy(F.desc("start"), ~is_base)))
    free = placed.where(~is_base & (F.coalesce("reach", "start") <= F.col("start")) & (F.coalesce("next", "end") >= F.col("end")))
    lead = F.length(F.regexp_extract("value", r"^[^0-9A-Za-z@+(]*", 0))
    core = F.regexp_replace(F.regexp_replace("value", r"^[^0-9A-Za-z@+(]+", ""), r"[^0-9A-Za-z]+$", "")
    tokens = free.select("doc_id", "content", (F.col("start") + lead).alias("start"), core.alias("token"), "before", "after")
    normal = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("value"))).otherwise(lower_ascii(F.col("value")))
    left = F.concat(F.lit("< "), lower_ascii(F.regexp_extract("before", r"([^\s]+)\s*+$", 1)))
    right = F.concat(F.lit("> "), lower_ascii(F.regexp_extract("after", r"^[^\s0-9A-Za-z]*+\s++([^\s]+)", 1)))
    instances = hits.where(is_base).select(F.concat("kind", F.lit(" "), normal).alias("token"), F.col("kind").alias("seed"),
                                           "before", "after") \
        .union(tokens.select("token", F.lit(None).cast("string"), "before", "after")) \
        .select("token", "seed", F.explode(F.array(left, right)).alias("pattern")).where(F.length("pattern") > 2)
    unseen = bootstrap(instances, rounds, confidence, support)
    added = tokens.join(unseen, "token").select("doc_id", "content", "kind", "start",
                                                (F.col("start") + F.length("token")).alias("end"),
                                                F.col("token").alias("value"), F.lit(False).alias("base")).distinct()
    return rows, base.unionByName(added)


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; overlapping spans give
    one mark, of the kind that starts first.  Rows without spans stay as they
    are (null texts stay null)."""
    _, spans = find_pii(docs, id_col, text_col)
    marks = spans.groupBy("doc_id", "content").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_pii_marks")) \
        .select(F.col("doc_id").alias("_pii_d"), F.col("content").alias("_pii_c"), "_pii_marks")
    keyed = docs.withColumn("_pii_key", F.sha2(text_or_empty(text_col).cast("binary"), 256))
    text, zero = F.col(text_col), F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        gap = F.substring(text, acc["at"].cast("int") + 1, (m["start"] - acc["at"]).cast("int"))
        return F.when(m["start"] >= acc["at"], F.struct(
            m["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.upper(m["kind"]), F.lit("]")).alias("out"))) \
            .otherwise(F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("_pii_marks", start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return keyed.join(marks, keyed[id_col].eqNullSafe(marks["_pii_d"]) & (keyed["_pii_key"] == marks["_pii_c"]), "left") \
        .withColumn(text_col, F.when(F.col("_pii_marks").isNotNull(), done).otherwise(text)) \
        .select(*docs.columns)
