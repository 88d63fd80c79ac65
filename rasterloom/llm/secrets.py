"""Secret scan with DataFrame functions only: fixed patterns, and sliding-window Shannon entropy.

Candidates are runs of at least WINDOW token characters. A window slides over a candidate; counts of its characters are
updated for the one that leaves and the one that enters, and with them the sum of n*log2(n), which gives the window's
entropy. Each character class has its own threshold. A candidate's span runs from its first window over the threshold
to the end of its last. Candidates on the allow-list (decimal numbers, UUIDs, documented example keys, words and slugs and
paths all of whose parts are words by their pairs of letters, short numbers or years) are suppressed, as are those inside a span of a fixed pattern.

Positions come from splitting a text at a pattern's matches: the pieces' and matches' lengths add up to code points.
Everything is a projection: one pass, no shuffle, no state between rows.

Defined cases: null text counts as empty and has no spans; a null doc_id is kept; repeated rows are scanned each; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Kinds in their order, with pattern, what is measured and the least length of that.
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Character classes with the least entropy, in bits, of a window that counts as a secret.
CLASSES = ((r"^[0-9a-f]+$|^[0-9A-F]+$", 2.9), (r"^[A-Z0-9]+$|^[a-z0-9]+$", 3.3), (r"", 3.6))
#: Pairs of small letters that words of English, German, French and Spanish (nearly) never hold.
UNUSUAL = (
    r"b[dfghknqvwxz]|c[bfgjmnqvwxz]|d[kqvz]|f[cgjkmqvwxz]|g[djqxyz]|h[dfjqx]|i[jy]|j[bcdfghijklmnqrtvwxyz]"
    r"|k[bcdfghjkmoqrtvxyz]|l[hjkmnqwxz]|m[cdfghjkqrtvwxz]|n[j]|o[hyz]|p[gjkmqvwxz]|q[abcdefghijklmnopqrstvwxyz]"
    r"|r[jx]|s[vxz]|t[j]|u[jy]|v[bcdfghjklmnpqrstuvwxyz]|w[bcdfgjkmqtuvwxyz]|x[bdfghjknsuwxyz]|y[fjkquvxyz]"
    r"|z[dfghjklmnpqrvwxyz]")
#: What is no part of a slug or path of plain words: such pairs, letters beside digits, inner capitals, lone letters in a row, numbers but short ones and years.
_NO_WORDS = UNUSUAL + r"|[A-Za-z][0-9A-Z]|[0-9][A-Za-z]|(?<![A-Za-z])[A-Za-z][-_/][A-Za-z](?![A-Za-z])|(?<![0-9])(?!(?:19|20)[0-9]{2}(?![0-9]))[0-9]{3}"
#: Decimals, UUIDs, documented example keys, and slugs and paths of plain words.
ALLOWED = r"^[0-9]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|EXAMPLE(KEY)?={0,2}$|^(?!.*(?:" + _NO_WORDS + r"))[A-Za-z0-9/_-]+$"

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """start, end, the match and a group of it, for all matches in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["found"])
        row = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("found"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(state["rows"], F.array(row)).alias("rows"))

    zipped = F.transform(found, lambda m, i: F.struct(F.element_at(gaps, i + 1).alias("gap"), m.alias("found"), F.element_at(part, i + 1).alias("part")))
    kinds = "array<struct<start:int,kind:int,end:int,found:string,part:string>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("rows"))
    listed = F.aggregate(zipped, empty, add, lambda s: s["rows"])
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast(kinds))


def _base(text: Column, kind: int) -> Column:
    _, pattern, group, least = KINDS[kind]
    rows = F.filter(_matches(text, pattern, kind, group), lambda r: F.length(r["part"]) >= least)
    return F.transform(rows, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"))).cast(_SPANS)


def _entropy_span(row: Column) -> Column:
    """The span of a candidate's windows over its class's threshold; end 0 if there are none."""
    text = row["found"]
    logs = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 1)])
    least = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(text.rlike(pattern), F.lit(bits)).otherwise(least)
    codes = F.transform(F.split(text, "", -1), F.ascii)
    limit = WINDOW * (math.log2(WINDOW) - least)  # entropy = log2(W) - sum / W

    def count(state: Column, i: Column) -> Column:
        """State after the i-th character has entered and the one WINDOW before it has left."""
        inn = F.element_at(codes, i)
        out = F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(-1))
        counts = state["counts"]
        n_in, n_out = F.element_at(counts, inn + 1), F.when(out >= 0, F.element_at(counts, F.greatest(out, F.lit(0)) + 1)).otherwise(F.lit(0))
        moved = inn != out
        total = F.when(moved, state["total"] + F.element_at(logs, F.least(n_in + 1, F.lit(WINDOW)) + 1) - F.element_at(logs, n_in + 1)
                       + F.when(out >= 0, F.element_at(logs, F.greatest(n_out - 1, F.lit(0)) + 1) - F.element_at(logs, n_out + 1)).otherwise(F.lit(0.0))).otherwise(state["total"])
        after = F.when(moved, F.transform(counts, lambda n, c: n + (c == inn).cast("int") - (c == out).cast("int"))).otherwise(counts)
        hot = (i >= WINDOW) & (total <= limit + 1e-9)
        return F.struct(after.alias("counts"), total.alias("total"), F.when(hot & state["first"].isNull(), i - WINDOW).otherwise(state["first"]).alias("first"), F.when(hot, i).otherwise(state["last"]).alias("last"))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    ended = F.aggregate(F.sequence(F.lit(1), F.length(text)), start, count, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    return F.transform(F.array(ended), lambda e: F.struct((row["start"] + F.coalesce(e["first"], F.lit(0))).alias("start"), F.lit(3).alias("kind"), F.when(e["last"].isNull(), 0).otherwise(row["start"] + e["last"]).alias("end")))[0]


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("entropy"))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text, and arrays of spans (start, kind, end): `base` of the fixed patterns, `added` by entropy."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[_base(F.col("text"), k).alias(KINDS[k][0]) for k in range(3)], _matches(F.col("text"), CANDIDATE, 3).alias("candidates"))
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    open_ = F.filter("candidates", lambda c: ~c["found"].rlike(ALLOWED) & ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    added = F.filter(F.transform(open_, _entropy_span), lambda s: s["end"] > 0)
    return rows.withColumn("added", F.when(F.size("candidates") > 0, added.cast(_SPANS)).otherwise(F.array().cast(_SPANS)))


def query(spark, sf_dir):
    found = scan(common.documents(spark, sf_dir))
    return found.select(
        "doc_id", *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.concat("base", "added")).alias("spans"))
