"""Secret scan over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger
has a row for each (blob, rule version) ever scanned; only pairs it lacks are
scanned, each blob once however many paths or versions hold it, and findings are
joined back to all paths. Only SQL functions are used.

Positions come from splitting the text at the matches: a match starts after all
pieces and matches before it, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import fresh_dir, settled


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if the given group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds, in the order in which equal starts are listed.
BASE = (
    Rule(
        "assign",
        "("
        + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token"))
        + f"|{_either_case('api')}_?{_either_case('key')}"
        + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=6,
    ),
    # runs of one class: asking for the least length in the pattern finds the same matches
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("signed_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", "[a-z][a-z0-9+.-]{1,20}://[^\\s/:@]{1,64}:[^\\s/@]{3,64}@"),
)
RULES = BASE + ADDED
RULE_VERSION = "2"
SPAN = "struct<start:bigint,stop:bigint,kind:string,rank:int>"


#: Matches whose places are worked out one after the other; the next ones begin from a sum over these.
_RUN = 128


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """Array of the rule's spans in the text, end exclusive.

    Matches are taken in runs of bounded length, so that the arrays that grow stay short and the time
    follows the number of matches.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    deciding = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    rows = F.arrays_zip(whole.alias("whole"), deciding.alias("deciding"), between.alias("gap"))
    none = F.array().cast(f"array<{SPAN}>")

    def length(row: Column) -> Column:
        return (row["gap"] + F.coalesce(F.length(row["whole"]), F.lit(0))).cast("long")

    def step(done: Column, row: Column) -> Column:
        start = done["at"] + row["gap"]
        stop = done["at"] + length(row)
        span = F.struct(
            start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank")
        )
        found = F.length(row["deciding"]) >= rule.least
        return F.struct(
            stop.cast("long").alias("at"),
            F.when(found, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    def by_runs(rows: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _RUN).cast("int"))
        zero = F.lit(0).cast("long")

        def run(k: Column) -> Column:
            return F.slice(rows, k * _RUN + 1, _RUN)

        sums = F.transform(numbers, lambda k: F.aggregate(run(k), zero, lambda total, row: total + length(row)))
        start = F.array().cast("array<bigint>")
        begins = F.aggregate(
            sums,
            F.struct(zero.alias("at"), start.alias("list")),
            lambda done, n: F.struct((done["at"] + n).alias("at"), F.concat(done["list"], F.array(done["at"])).alias("list")),
        )["list"]
        return _let(
            begins,
            lambda begin: F.flatten(
                F.transform(
                    numbers,
                    lambda k: F.aggregate(run(k), F.struct(F.get(begin, k).alias("at"), none.alias("spans")), step)["spans"],
                )
            ),
        )

    return F.when(text.rlike(rule.pattern), _let(rows, by_runs)).otherwise(none)


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules by start, then by the order of the rules."""
    return F.array_sort(F.concat(*(spans_of(rule, rank, text) for rank, rule in enumerate(rules))), _by_start)


def _by_start(a: Column, b: Column) -> Column:
    key = lambda s: s["start"] * 64 + s["rank"]
    return F.signum(key(a) - key(b)).cast("int")


def versions_of(docs: DataFrame, path: str, text: str) -> DataFrame:
    """``path, blob, text``: a NULL text is the empty blob."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(whole, 256).alias("blob"), whole.alias("text"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows ``blob, rule_version, spans``: one for each blob not yet scanned with these rules."""
    keyed = versions.withColumn("row", F.xxhash64("path", "blob"))
    # of each blob one version is read; copies are folded to a number before anything moves
    chosen = keyed.groupBy("blob").agg(F.min("row").alias("row"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        chosen = chosen.join(seen, "blob", "left_anti")
    chosen = settled(chosen, "unseen-blobs")
    texts = keyed.join(chosen.select("row").hint("shuffle_hash"), "row", "left_semi")
    scanned = texts.select("blob", F.lit(RULE_VERSION).alias("rule_version"), scan_text(F.col("text"), rules).alias("spans"))
    # rows repeated in full share path and blob
    return scanned.dropDuplicates(["blob"])


def update_ledger(docs: DataFrame, ledger_path: str, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scans what the ledger lacks, appends it, and returns the whole ledger.

    ``ledger_path`` may not exist yet. Calling it again with the same texts scans nothing.
    """
    spark = docs.sparkSession
    try:
        ledger = spark.read.parquet(ledger_path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        ledger = None
    scan_unseen(versions_of(docs, path, text), ledger).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def findings(docs: DataFrame, ledger_path: str | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``path, blob, spans`` for every row of ``docs``, in the order of start and rule.

    Without a ledger path a new ledger is begun in the shared folder. NULL texts count
    as empty and have no spans; repeated rows stay; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    ledger = update_ledger(docs, ledger_path or fresh_dir(spark, "ledger"), path, text)
    found = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    paths = versions_of(docs, path, text).select("path", "blob")
    joined = paths.join(found, "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(each, ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every finding in their text replaced, rule after rule.

    Each rule's result is a column of its own before the next, so that no rule is
    worked out more than once.
    """
    for rule in rules:
        own, pattern = F.col(text), F.lit(rule.pattern)
        rows = F.arrays_zip(
            F.split(own, rule.pattern, -1).alias("gap"),
            F.regexp_extract_all(own, pattern, F.lit(0)).alias("whole"),
            F.regexp_extract_all(own, pattern, F.lit(rule.group)).alias("deciding"),
        )
        parts = F.transform(
            rows,
            lambda r, least=rule.least: F.concat(
                r["gap"],
                F.when(F.length(r["deciding"]) >= least, F.lit(mark)).otherwise(F.coalesce(r["whole"], F.lit(""))),
            ),
        )
        docs = docs.withColumn(text, F.when(own.rlike(rule.pattern), F.array_join(parts, "")).otherwise(own))
    return docs
