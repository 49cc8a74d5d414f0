"""Information-theoretic sanitisation of personal data; DataFrame functions only.

Entities are the values of the base kinds: e-mail addresses, IP addresses, card numbers,
phone numbers. The whole corpus tells how strongly a term reveals an entity: with counts
over all documents, PMI(e; t) = log(N n(e,t) / (n(e) n(t))) against the entity's own
information IC(e) = log(N / n(e)). A term with PMI >= ``disclosure`` * IC, seen with the
entity in ``support`` different texts at least discloses it; the query's ``support`` of 1 judges
entities of a single text too, the functions' default leaves them out. Its occurrences in all texts, with the entity or without it, become spans of
kind ``term``. ``sanitise`` replaces entities by their kind,
generalises disclosing numbers and names to their class, and removes other disclosing terms.

Counts cover all documents, copies included; texts that hold an entity are kept once, by
their SHA-256 and content, with their number of copies, so a group of copies costs one row.

Defined cases. A null text counts as empty: no spans. Ids may be null or repeated. An empty
table gives an empty result. Offsets are code points, ends exclusive. Terms are runs of
characters other than ASCII non-alphanumerics, lower-cased, of any length (``LEAST_TERM``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions.spans import literal, places
from bibloom.llm.common import column, documents, sha256, span_text, text_of, tidy, whole_row, written

SUPPORT = 3
DISCLOSURE = 0.95
LEAST_TERM = 1
KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:int,end:int>"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_matches(df: DataFrame, name: str, text: str, pattern: str, when: str) -> DataFrame:
    """Adds ``name``: the matches as (value, start, end), in time linear in their number; text, pattern and when are SQL."""
    return df.withColumn(name, F.expr(places(text, pattern, when)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, its digits summed."""
    at = F.split(F.reverse(digits), "")
    doubled = F.transform(at, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def base_spans(df: DataFrame, text: str, name: str = "entities") -> DataFrame:
    """Adds ``name``: (kind, start, end, value) of the base kinds by start, then in the order of KINDS.

    Inner dots of hosts and separators of card numbers are first marked by a control
    character of the same length, so that each pattern is a plain run of characters and long
    texts cannot exhaust the matcher's stack; possessive runs behind a look-behind keep it linear.
    """
    t = F.col(text)
    clean = F.translate(t, "\u0001", "\u0002")
    df = df.withColumn("__host", F.when(t.contains("@"), F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\u0001")))
    df = df.withColumn("__number", F.when(t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", "\u0001")))
    df = with_matches(df, "__email", "__host", literal(r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"), "__host IS NOT NULL")
    df = with_matches(df, "__ip", text, literal(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), f"{text} RLIKE {literal(r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]')}")
    df = with_matches(df, "__card", "__number", literal(r"[0-9][0-9\x01]*+"), f"__number RLIKE {literal(r'[0-9][0-9\x01]{11}')}")
    df = with_matches(df, "__phone", text, literal(r"\+[0-9][\x20().0-9-]+[0-9]"), f"contains({text}, '+')")
    part_ok = lambda p: p.cast("double") <= 255
    length = lambda s: F.length(_digits(s["value"]))
    keep = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), part_ok),
        "card": lambda s: F.when(length(s).between(12, 19), luhn(_digits(s["value"]))).otherwise(False),
        "phone": lambda s: length(s).between(9, 15),
    }
    def ranked(rank: int) -> Column:
        kept = F.filter(f"__{KINDS[rank]}", keep[KINDS[rank]])
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))

    parts = [ranked(rank) for rank in range(len(KINDS))]
    listed = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(F.get(listed, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.withColumn(name, spans).drop("__host", "__number", *[f"__{k}" for k in KINDS])


def terms_of(text: Column) -> Column:
    words = F.split(F.translate(text, UPPER, LOWER), SEPARATORS)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= LEAST_TERM))


def may_hold(text: Column) -> Column:
    """Cheap marks without which a text has no entity; most texts go by them."""
    email = text.contains("@") & text.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]")
    phone = text.contains("+") & text.rlike(r"\+[0-9][\x20().0-9-]")
    return email | phone | text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]") | text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")


def entity_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(sha, content, entities, copies): each different text that holds an entity, once."""
    texts = docs.select(text_of(text_col).alias("content")).filter(may_hold(F.col("content")))
    held = base_spans(texts, "content").withColumn("sha", F.unhex(sha256(F.col("content"))))
    once = held.groupBy("sha", "content").agg(F.first("entities").alias("entities"), F.count(F.lit(1)).alias("copies"))
    # after the grouping: a filter pushed below base_spans would work its columns out several times
    return once.filter(F.size("entities") > 0)


def strong_terms(docs: DataFrame, held: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(sha, x, y, term, copies) of texts that hold entities, and (x, y, term, leaks): the terms that disclose an entity of class (x, y).

    Entities of the same texts have the same counts with every term, so they are judged once,
    as a class named by two hashes of its texts; a text of many entities costs no product of
    entities and terms. ``leaks`` says that the term also stands in texts without the entity.
    """
    value = lambda s: F.concat_ws(":", s["kind"], F.lower(F.substring("content", s["start"] + 1, s["end"] - s["start"])))
    named = held.select("sha", "copies", F.explode(F.array_distinct(F.transform("entities", value))).alias("entity"))
    texts = F.count(F.lit(1)).alias("texts")
    entities = named.groupBy("entity").agg(
        F.sum("copies").alias("n_e"), texts, F.bit_xor(F.xxhash64("sha")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sha")).alias("y")
    ).filter(F.col("texts") >= support)
    classes = named.select("sha", "entity").join(entities.drop("texts"), "entity").groupBy("sha", "x", "y").agg(F.max("n_e").alias("n_e"))
    pairs = held.select("sha", "content", "copies").join(classes, "sha").select("sha", "copies", "x", "y", "n_e", F.explode(terms_of(F.col("content"))).alias("term"))
    together = pairs.groupBy("x", "y", "term").agg(F.sum("copies").alias("n_et"), F.max("n_e").alias("n_e"), texts).filter(F.col("texts") >= support)
    everywhere = docs.select(F.explode(terms_of(text_of(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = float(max(docs.count(), 1))
    pmi = F.log(F.lit(total) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    strong = together.join(everywhere, "term").filter(pmi >= disclosure * F.log(F.lit(total) / F.col("n_e")))
    return pairs, written(strong.select("x", "y", "term", (F.col("n_t") > F.col("n_et")).alias("leaks")))


def disclosing_terms(docs: DataFrame, held: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(sha, terms) of every text that holds a disclosing term, and (sha, content) of those that hold no entity."""
    pairs, strong = strong_terms(docs, held, text_col, support, disclosure)
    own = pairs.select("sha", "x", "y", "term").join(strong.select("x", "y", "term"), ["x", "y", "term"]).select("sha", "term")
    by_text = lambda terms: terms.groupBy("sha").agg(F.collect_set("term").alias("terms"))
    leaking = strong.filter("leaks").select("term").distinct()
    texts = docs.select(text_of(text_col).alias("content")).withColumn("sha", F.unhex(sha256(F.col("content"))))
    if leaking.isEmpty():
        return by_text(own), texts.limit(0)
    there = texts.select("sha", F.explode(terms_of(F.col("content"))).alias("term")).join(written(leaking), "term").select("sha", "term")
    terms = written(by_text(own.unionByName(there)))
    without = terms.select("sha").join(held.select("sha"), "sha", "left_anti")
    return terms, texts.join(written(without), "sha", "left_semi").groupBy("sha").agg(F.first("content").alias("content"))


def text_spans(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(sha, content, entities, spans): all spans of each different text that holds an entity or a disclosing term."""
    held = written(entity_texts(docs, text_col))
    terms, without = disclosing_terms(docs, held, text_col, support, disclosure)
    texts = held.select("sha", "content", "entities").unionByName(without.withColumn("entities", F.array().cast(f"array<{SPAN}>")))
    joined = texts.join(terms, "sha", "left")
    inside = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    # terms have word characters only, so they need no quoting
    pattern = F.concat(F.lit(f"(?<!{inside})(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(f")(?!{inside})"))
    joined = joined.select("*", F.translate("content", UPPER, LOWER).alias("__lowered"), pattern.alias("__pattern"))
    joined = with_matches(joined, "__term", "__lowered", "__pattern", "size(terms) > 0")
    free = F.filter("__term", lambda s: ~F.exists("entities", lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"])))
    added = F.transform(free, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = F.array(*map(F.lit, (*KINDS, "term")))
    ranked = F.array_sort(F.transform(F.concat("entities", added), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("sha", "content", "entities", spans.alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(id, entities, spans) of every row."""
    with tidy(docs.sparkSession):
        # a table, so that the join with all rows can split a hot text
        spans = written(text_spans(docs, text_col, support, disclosure).select("sha", "entities", "spans"))
    rows = docs.select(column(id_col), F.unhex(sha256(text_of(text_col))).alias("sha"))
    none = F.array().cast(f"array<{SPAN}>")
    return rows.join(spans, "sha", "left").select(id_col, F.coalesce("entities", none).alias("entities"), F.coalesce("spans", none).alias("spans"))


def generalised(kind: Column, value: Column) -> Column:
    """What stands for a span: an entity's kind; a disclosing number's or name's class; nothing for other terms."""
    return (
        F.when(kind != "term", F.concat(F.lit("["), F.upper(kind), F.lit("]")))
        .when(value.rlike("^[0-9]+$"), "[NUMBER]")
        .when(value.rlike(r"^\p{Lu}"), "[NAME]")
        .otherwise("")
    )


def sanitise(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with the text of every row sanitised; other rows and columns stay as they are."""
    found = text_spans(docs, text_col, support, disclosure)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        value = F.substring("content", s["start"] + 1, s["end"] - s["start"])
        fresh = F.concat(acc["out"], F.substring("content", acc["at"] + 1, s["start"] - acc["at"]), generalised(s["kind"], value))
        return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    folded = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("content"), acc["at"] + 1, F.length("content"))))
    texts = found.select(F.col("sha").alias("s"), folded.alias("out"))
    keyed = docs.select(whole_row(docs).alias("row"), F.unhex(sha256(text_of(text_col))).alias("sha"))
    joined = keyed.join(texts, F.col("sha") == F.col("s"), "left")
    own = lambda c: F.col("row").getField(c)
    return joined.select(*[F.coalesce("out", own(c)).alias(c) if c == text_col else own(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), support=1)
    count = lambda kind: F.size(F.filter("entities", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        sha256(span_text(F.col("entities"))).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
