"""Secret scanning over an incremental ledger of blobs.

Every text is content-addressed: its blob is the SHA-256 of its bytes. A ledger holds, for
each blob, which rule versions have scanned it and the spans they found. A scan looks up the
blobs of all versions, reads only those (blob, rule version) pairs that the ledger lacks,
each blob once however many paths carry it, adds them to the ledger, and joins the spans
back to every path.

Defined cases. A null text counts as empty and has no spans. Ids may be null or repeated;
each row gets the spans of its own text. An empty table gives an empty result. Raising a
rule's version scans every blob for that rule again and for no other rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import column, documents, sha256, span_text, text_of, tidy, whole_row, written

SPAN = "struct<kind:string,start:int,end:int>"
#: Blobs with findings, a few spans each, that a join may broadcast
BROADCAST_ROWS = 100_000
LEDGER = f"blob binary, rules array<string>, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts where ``group`` has at least ``least`` characters. ``needs``: one of these must occur in a text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in the order that breaks ties of a start
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# kinds that this scan adds
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyJ",)),
)
RULES = BASE + ADDED
# runs shorter than 24 never count and maximal runs don't overlap, so the scan may skip them
FASTER = {r"[0-9a-f]+": r"[0-9a-f]{24,}"}


def find_spans(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every match that counts, by start, then in the order of the rules."""
    found = []
    for rank, (rule, pattern) in enumerate(rules):
        if rule.needs and not any(x in text for x in rule.needs):
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), rank, m.end(), rule.kind))
    found.sort()
    return [(kind, start, end) for start, _, end, kind in found]


def compiled(rule: Rule) -> tuple[Rule, re.Pattern]:
    return rule, re.compile(FASTER.get(rule.pattern, rule.pattern) if rule.least >= 24 else rule.pattern, re.ASCII)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_of(text_col)
    return docs.select(column(id_col).alias("path"), F.unhex(sha256(text)).alias("blob"), text.alias("content"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, path, todo): one path for each blob that some rule version has not scanned."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    first = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return first.withColumn("todo", wanted)
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    todo = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    return first.join(done, "blob", "left").select("blob", "path", todo.alias("todo")).filter(F.size("todo") > 0)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: the pairs scanned now, with their spans."""
    known = {r.key: compiled(r) for r in rules}

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(texts: pd.Series, todo: pd.Series) -> pd.Series:
        return pd.Series([find_spans(t, [known[k] for k in keys]) for t, keys in zip(texts, todo)], dtype=object)

    todo = unseen(versions, ledger, rules).select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
    read = versions.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")))
    scanned = read.select("blob", F.col("todo").alias("rules"), spans("content", "todo").alias("spans"))
    # a row that repeats a path and its text was scanned twice
    return scanned.groupBy("blob", "rules").agg(F.any_value("spans").alias("spans"))


def spans_of_paths(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans): the spans of the rules in force, for every row."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    hit = ledger.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all"))
    ranked = F.array_sort(
        F.array_distinct(F.transform("all", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    )
    hit = hit.select("blob", F.transform(F.filter(ranked, lambda s: s["rank"] > 0), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))
    none = F.array().cast(f"array<{SPAN}>")
    return versions.select("path", "blob").join(hit, "blob", "left").select("path", "blob", F.coalesce("found", none).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans of every row, new ledger rows). Append the latter to the ledger for the next scan.

    A ledger that already scanned a blob under an older version of a rule keeps that row;
    give spans_of_paths a ledger without it if the rule's earlier findings are void.
    """
    versions = blobs(docs, id_col, text_col)
    with tidy(docs.sparkSession):
        # a table, so that the join with all paths can split a hot blob
        added = written(scan_unseen(versions, ledger, rules))
    current = added if ledger is None else ledger.unionByName(added)
    return spans_of_paths(versions, current, rules).withColumnRenamed("path", id_col), added


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by [SECRET]; all rows and columns stay."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([mask(t, s) for t, s in zip(texts, spans)], dtype=object)

    found = scan(docs, None, RULES, id_col, text_col)[1].filter(F.size("spans") > 0)
    found = found.select(F.col("blob").alias("b"), "spans")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = docs.select(whole_row(docs).alias("row"), F.unhex(sha256(text_of(text_col))).alias("blob"))
    joined = keyed.join(F.broadcast(found) if few else found, F.col("blob") == F.col("b"), "left")
    text = F.col("row").getField(text_col)
    done = F.when(F.col("spans").isNull(), text).otherwise(masked(F.when(F.col("spans").isNotNull(), text).otherwise(""), F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))))
    return joined.select(*[done.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def mask(text: str, spans, word: str = "[SECRET]") -> str:
    """Overlapping spans become one mask."""
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start >= at:
            out += [text[at:start], word]
        at = max(at, end)
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    """Two scans with a ledger between: the base rules, then all rules, of which only the added ones are unseen."""
    docs = documents(spark, sf_dir)
    ledger = scan(docs, None, BASE)[1]
    found = scan(docs, ledger, RULES)[0]
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        sha256(span_text(base)).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.lower(F.hex("blob")).alias("blob_sha256"),
    )
