"""Text expressions: stripping, tokens, bags of words, cosine, refusals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark an answer as a refusal (compared in lower case).
REFUSAL_PHRASES = (
    "i don't know",
    "i do not know",
    "i'm not sure",
    "i am not sure",
    "cannot answer",
    "can't answer",
    "unable to",
    "no information",
    "as an ai",
    "i cannot",
)

# Every character Unicode counts as white space, plus the four
# information separators.  Spark's plain ``trim`` only removes U+0020.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
TOKEN = "[a-z0-9]+"
KEY_WIDTH = 64


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACES))


def normalise(text: Column) -> Column:
    """Strip, lower-case and turn every run of white space into one blank."""
    return strip(F.regexp_replace(F.lower(text), SPACE_RUN, " "))


def bounded_key(text: Column) -> Column:
    """A stand-in of at most 71 characters with the same equality.

    Long texts become a tagged SHA-256, so that grouping on whole answers
    shuffles a fixed width per row.  The tag cannot start a token.
    """
    return F.when(F.length(text) > KEY_WIDTH, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def tokens(text: Column) -> Column:
    """All runs of ASCII letters and digits, lower-cased.  Other scripts give none."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bag(words: Column) -> Column:
    """Token counts of one row as ``array<struct<token, tf>>``, sorted by token.

    Run-length encoding of the sorted array: the counts need no shuffle.
    """
    def encode(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return _let(
            starts,
            lambda p: F.transform(
                p,
                lambda at, k: F.struct(
                    F.get(s, at).alias("token"),
                    (F.coalesce(F.get(p, k + 1), F.size(s)) - at).cast("int").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<token:string,tf:int>>")
    return F.when(F.size(words) == 0, empty).otherwise(_let(F.sort_array(words), encode))


def bag_norm(counts: Column) -> Column:
    """Euclidean length of a bag."""
    square = F.aggregate(counts, F.lit(0.0), lambda acc, e: acc + e["tf"].cast("double") * e["tf"])
    return F.sqrt(square)


def shared_tokens(left: Column, right: Column) -> Column:
    """Distinct tokens two bags have in common."""
    return F.array_intersect(
        F.transform(left, lambda e: e["token"]), F.transform(right, lambda e: e["token"])
    )


def bag_cosine(left: Column, right: Column) -> Column:
    """Cosine of two bags in one row; 0 if either is empty.

    The sorted concatenation puts equal tokens next to each other (each bag
    holds a token once), so the dot product is a single pass.
    """
    def dot(s: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(s) - 1),
            F.lit(0.0),
            lambda acc, i: acc
            + F.when(
                F.get(s, i)["token"] == F.get(s, i - 1)["token"],
                (F.get(s, i)["tf"] * F.get(s, i - 1)["tf"]).cast("double"),
            ).otherwise(0.0),
        )

    merged = F.sort_array(F.concat(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        _let(merged, dot) / (bag_norm(left) * bag_norm(right))
    )


def is_refusal(text: Column, n_tokens: Column | None = None) -> Column:
    """Fewer than two tokens, or any refusal phrase."""
    lowered = F.lower(text)
    hit = (F.size(tokens(text)) if n_tokens is None else n_tokens) < 2
    for phrase in REFUSAL_PHRASES:
        hit = hit | lowered.contains(phrase)
    return hit


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
