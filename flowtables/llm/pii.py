"""Personal data by seed patterns and bootstrapped contexts, in DataFrame functions only.

Four exact patterns give the seed entities. The word before and the word after an entity are
lexical patterns; patterns and identifier-like tokens form a graph that is scored in rounds.
A pattern is trusted for a kind if nearly all that is known of its tokens is of that kind.
Unknown tokens in a trusted pattern that could be of its kind are discovered; they are known
from then on, wherever they stand, and seed further patterns, until nothing new is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.llm.spans import masked, matches
from flowtables.session import written

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}

# Each pattern finds what its plain form finds, in time linear in the text and without
# recursion: a match can only start at the start of a run or where the last match ended, and
# characters that would need a repeated group are exchanged beforehand.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\."
         r"[A-Za-z0-9.-]*[A-Za-z0-9-]")
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9][0-9 -]*[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Identifier-like: a run with a digit or an at sign that ends with a letter or digit.
TOKEN = (r"(?<![A-Za-z0-9@._+-])[A-Za-z0-9@._+-]*[0-9@](?:[A-Za-z0-9@._+-]*[A-Za-z0-9])?")
WORD_BEFORE = r"(\p{L}+)[^\p{L}\p{N}]*$"
WORD_AFTER = r"^[^\p{L}\p{N}]*(\p{L}+)"
#: What a discovered token of a kind looks like at the least.
SHAPES = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9]+(?:\.[0-9]+){2,}$", "card": r"^[0-9][0-9-]{11,}$",
          "phone": r"^\+?[0-9][0-9.-]{6,}$"}


def where(found: Column, condition: Column, kind: str) -> Column:
    return F.when(condition, found).otherwise(F.array().cast(found_type())).alias(kind)


def found_type() -> str:
    return "array<struct<start:int,end:int,found:string,before:string,after:string>>"


def small_number(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(digits) <= 3, digits.cast("int") <= 255).otherwise(F.lit(False))


def luhn(digits: Column) -> Column:
    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(place % 2 == 0, digit).when(double > 9, double - 9).otherwise(double)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return total % 10 == 0


def card(found: Column) -> Column:
    digits = F.regexp_replace(found, "[ -]", "")
    return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))


def base_matches(text: Column) -> dict[str, Column]:
    """The valid matches of each kind. A text is searched only if it holds the least a match needs."""
    emails = matches(text, EMAIL, F.regexp_replace(text, r"\.(?=\.)", "%"))
    ips = F.filter(matches(text, IP), lambda m: F.forall(F.split(m["found"], r"\."), small_number))
    cards = F.filter(matches(text, CARD, F.regexp_replace(text, "[ -](?=[ -])", "x")),
                     lambda m: card(m["found"]))
    phones = F.filter(matches(text, PHONE), lambda m: F.length(
        F.regexp_replace(m["found"], "[^0-9]", "")).between(8, 15))
    return {
        "email": where(emails, text.rlike(r"@[A-Za-z0-9-]+\."), "email"),
        "ip": where(ips, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "ip"),
        "card": where(cards, text.rlike("[0-9](?:[ -]?[0-9]){15}"), "card"),
        "phone": where(phones, text.contains("+"), "phone"),
    }


def located(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with ``_base`` and ``_tokens``: (kind, start, end, value, patterns)."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def details(found: Column, kind: str | None) -> Column:
        return F.transform(found, lambda m: F.struct(
            F.lit(kind).cast("string").alias("kind"), m["start"].alias("start"),
            m["end"].alias("end"), F.lower(m["found"]).alias("value"),
            F.array(F.concat(F.lower(F.regexp_extract(m["before"], WORD_BEFORE, 1)), F.lit(" _")),
                    F.concat(F.lit("_ "), F.lower(F.regexp_extract(m["after"], WORD_AFTER, 1)))
                    ).alias("patterns")))

    kinds = base_matches(whole)
    tokens = where(F.filter(matches(whole, TOKEN), lambda m: F.length(m["found"]).between(5, 64)),
                   whole.rlike("[0-9@]"), "tokens")
    found = documents.withColumns({f"_{kind}": column for kind, column in kinds.items()})
    found = found.withColumn("_tokens", tokens)
    found = found.withColumn("_base", F.concat(*[details(F.col(f"_{k}"), k) for k in KINDS]))
    return found.withColumn("_tokens", F.filter(
        details(F.col("_tokens"), None), lambda t: ~F.exists("_base", lambda b: (
            (b["start"] < t["end"]) & (b["end"] > t["start"]))))
    ).drop(*[f"_{kind}" for kind in KINDS])


def discovered(spans: DataFrame, least_support: int, trust: float) -> DataFrame:
    """The (value, kind) that (kind, value, patterns) spans give beyond the kinds they come with.

    A pattern's score for a kind is the share of its distinct known tokens that are of the kind,
    where an unknown token that cannot be of the kind is known to be something else. With
    ``least_support`` tokens of the kind and a score of at least ``trust``, its unknown tokens that
    could be of the kind get it; of several kinds the best scored one, then the later name. A
    known token keeps its kind, so the rounds end; each brings at least one new token.
    """
    edges = (spans.select(F.explode("patterns").alias("pattern"), "value", "kind")
             .where("length(pattern) > 2").groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    fits = F.array_compact(F.array(*[F.when(F.col("value").rlike(SHAPES[kind]), kind) for kind in KINDS]))
    edges = written(edges.withColumn("fits", fits), "pii")
    open_edges = F.col("kind").isNotNull() | (F.size("fits") > 0)
    others = written(edges.where(~open_edges).groupBy("pattern")
                     .agg(F.count(F.lit(1)).alias("others")), "pii")
    edges = edges.where(open_edges)
    known = edges.where("kind IS NOT NULL").groupBy("value").agg(F.max("kind").alias("known"))
    rounds: list[DataFrame] = []
    while True:
        labelled = edges.drop("kind").join(known, "value", "left")
        own = {kind: F.col("known") == kind for kind in KINDS}
        against = {kind: F.col("known").isNull() & ~F.array_contains("fits", kind) for kind in KINDS}
        counted = labelled.groupBy("pattern").agg(F.count("known").alias("known"), F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.count_if(own[kind]).alias("seeds"),
                     F.count_if(against[kind]).alias("against")) for kind in KINDS]).alias("each"))
        each = (counted.join(others, "pattern", "left").withColumn("each", F.explode("each"))
                .withColumn("score", F.col("each.seeds") / (
                    F.col("known") + F.col("each.against") + F.coalesce("others", F.lit(0)))))
        trusted = written(each.where((F.col("each.seeds") >= least_support) & (F.col("score") >= trust))
                          .select("pattern", "each.kind", "score"), "pii")
        found = (labelled.where("known IS NULL").join(trusted, "pattern")
                 .where(F.array_contains("fits", F.col("kind")))
                 .groupBy("value").agg(F.max(F.struct("score", "kind"))["kind"].alias("known")))
        found = written(found, "pii")
        rounds.append(found)
        if found.isEmpty():
            break
        known = known.unionByName(found)
    values = rounds[0]
    for found in rounds[1:]:
        values = values.unionByName(found)
    return values.withColumnRenamed("known", "kind")


def find(documents: DataFrame, text: str = "text", base: str = "base_spans",
         spans: str = "spans", least_support: int = 5, trust: float = 0.9) -> DataFrame:
    """``documents`` with two arrays of (kind, start, end), by kind in the order of ``KINDS``, then
    start: the matches of the exact patterns, and these with the tokens that :func:`discovered`
    knows, wherever they stand.

    Positions are code points, the end exclusive. Null and empty texts have no spans; repeated
    rows and null ids are judged row by row; columns named as a result are replaced; an empty
    table gives no rows. The spans are written once to the shared folder with the documents;
    scoring works on distinct (pattern, token) pairs, combined before each shuffle, so a
    frequent word is an ordinary group.
    """
    table = written(located(documents.drop(base, spans), text)
                    .withColumn("_row", F.monotonically_increasing_id()), "pii")
    seen = table.select(F.explode(F.concat("_base", "_tokens")).alias("s")).select("s.*")
    values = discovered(seen, least_support, trust)
    tokens = (table.where(F.size("_tokens") > 0)
              .select("_row", F.explode("_tokens").alias("s")).select("_row", "s.start", "s.end", "s.value"))
    added = written(tokens.join(values, "value").groupBy("_row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("_added")), "pii")

    def ordered(found: Column) -> Column:
        order = F.create_map(*[F.lit(v) for pair in zip(KINDS, range(len(KINDS))) for v in pair])
        placed = F.transform(found, lambda s: F.struct(
            order[s["kind"]].alias("place"), s["start"].alias("start"), s["end"].alias("end"),
            s["kind"].alias("kind")))
        return F.transform(F.array_sort(placed), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    exact = F.transform("_base", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if added.isEmpty():  # nothing to join; the result is the same
        result = table.withColumn("_added", F.array().cast(
            "array<struct<kind:string,start:int,end:int>>"))
    else:
        result = table.join(added, "_row", "left")
    return (result.withColumn(base, ordered(exact))
            .withColumn(spans, ordered(F.concat(exact, F.coalesce(
                "_added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))))
            .drop("_base", "_tokens", "_row", "_added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """``documents`` with each span of ``find`` replaced by a label such as <EMAIL>; null stays null."""
    found = find(documents, text, "_exact", "_spans", **options)
    labels = F.create_map(*[F.lit(v) for pair in LABELS.items() for v in pair])
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return (found.withColumn("_spans", by_start)
            .withColumn(text, F.when(F.size("_spans") == 0, F.col(text)).otherwise(
                masked(F.col(text), F.col("_spans"), lambda s: labels[s["kind"]])))
            .drop("_exact", "_spans"))
