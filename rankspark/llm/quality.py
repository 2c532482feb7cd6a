"""Quality rules with risk-controlled cutoffs (operator 8); DataFrame functions only.

Counts of each text come from array functions. A document that passes the fixed base rules is judged by further rules
of the form "value above a cutoff". A verdict is a set of cutoffs, one a rule at most, that rejects what any of them
hits. It is selected on the labelled documents, stratum by stratum, and certified as a whole: if its true rate of
rejecting good documents were ``RISK`` or more, as few rejections as were seen would have at most a certain probability -
an exact binomial tail. Verdicts are tested in chains of fixed order; the first failure ends a chain, which needs no
further correction. The first chain tightens one rule after the other, in the order of ``CUTOFFS``, and keeps each at its
tightest; it has half of ``DOUBT`` divided by the strata. Each later rule alone is a chain too; these share the other
half evenly. Of the certified verdicts, the one with the most bad documents less ``PRICE`` times the good ones rejected
is taken, the earliest of equals; a verdict without a gain stays off.

A trial is one text of a stratum: copies of a text, repeated rows and repeated labels count once, and a text that any
label calls good is good.

Defined results: null text has no word and fails the base; a null stratum is the stratum ''; labels of unknown documents
and null labels do not count; with no labels every document that passes the base is kept; repeated rows are judged alike;
null ids have no label; a text is counted whole in its row, so its words must fit a task; other columns of both tables
are left out; no document gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import stored

#: Largest share of good documents that a verdict may reject, and the chance that a certificate is wrong.
RISK, DOUBT, PRICE = 0.02, 0.05, 10
# The rules in the order of the first chain, with their cutoffs from the loosest.
CUTOFFS = {
    "symbol_share": [0.5, 0.3, 0.2, 0.15, 0.1, 0.05],
    "dup_line_share": [0.8, 0.6, 0.5, 0.4, 0.3],
    "repeat_share": [0.19, 0.16, 0.13, 0.1],
    "mean_word": [30.0, 20.0, 15.0, 12.0],
    "tiny_word": [-1.5, -2.0, -2.5],
}

_SPACE = r"[\x20\x09-\x0D]+"


def text_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and __n_lines (lines with a word)."""
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__w", F.filter(F.split("__t", _SPACE), lambda w: w != ""))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    five = F.transform(F.sequence(F.lit(1), F.size("__w") - 4), lambda i: F.xxhash64(*[F.element_at("__w", i + k) for k in range(5)]))
    df = df.withColumn("__h", F.when(F.size("__w") >= 5, five).otherwise(F.array().cast("array<bigint>")))
    # Windows that occur twice: neighbours of the sorted (hash, place) list; only texts with a repeat are sorted.
    sorted_ = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("__s", sorted_)
    near = lambda x, k, d: F.coalesce(F.get("__s", k + d).getField("h") == x["h"], F.lit(False))
    again = F.filter(F.transform("__s", lambda x, k: F.when(near(x, k, -1) | near(x, k, 1), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("__r", F.sort_array(again))
    covered = F.aggregate("__r", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("__n_lines"),
    )


def _values() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "__n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word": share("word_chars", "n_words"),
        "tiny_word": -share("word_chars", "n_words"),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable, summed term by term from logarithms."""
    import math

    start, odds = n * math.log1p(-p), math.log(p / (1 - p))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + odds).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + odds)).alias("s"))
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.struct(start.cast("double").alias("t"), F.exp(start).alias("s")), step, lambda a: a["s"])
    return F.when(k == 0, F.exp(start)).otherwise(more)


def verdicts() -> list[tuple[int, float, dict[str, float]]]:
    """(chain, the chain's share of the doubt, cutoffs) of all verdicts, each chain in its order."""
    rules, out, tight = list(CUTOFFS), [], {}
    for r in rules:
        out += [(0, 0.5, tight | {r: c}) for c in CUTOFFS[r]]
        tight = tight | {r: CUTOFFS[r][-1]}
    for chain, r in enumerate(rules[1:], 1):
        out += [(chain, 0.5 / (len(rules) - 1), {r: c}) for c in CUTOFFS[r]]
    return out


def select_cutoffs(labelled: DataFrame, risk: float = RISK, doubt: float = DOUBT, price: float = PRICE) -> DataFrame:
    """(stratum, rule, cutoff) of the rules that are on. ``labelled``: __stratum, __good (boolean), the rules' values."""
    every = verdicts()

    def hits(cutoffs: dict[str, float]) -> Column:
        out = F.lit(False)
        for r, c in cutoffs.items():
            out = out | (F.col(r) > c)
        return out

    each = F.array(*[F.struct(F.lit(chain).alias("chain"), F.lit(share).alias("share"), hits(cutoffs).alias("hit")) for chain, share, cutoffs in every])
    long = labelled.select("__stratum", "__good", F.posexplode(each).alias("step", "x")).select("__stratum", "__good", "step", "x.*")
    seen = long.groupBy("__stratum", "chain", "share", "step").agg(F.sum(F.col("__good").cast("long")).alias("n"), F.sum((F.col("__good") & F.col("hit")).cast("long")).alias("k"), F.sum((~F.col("__good") & F.col("hit")).cast("long")).alias("bad"))
    strata = labelled.select("__stratum").distinct().agg(F.count("*").alias("__strata"))
    seen = seen.join(strata)
    limit = F.lit(doubt) * F.col("share") / F.col("__strata")
    ok = (F.col("k") < F.col("n") * risk) & (binomial_tail(F.col("n"), F.when(F.col("k") < F.col("n") * risk, F.col("k")).otherwise(F.lit(0).cast("long")), risk) <= limit)
    so_far = Window.partitionBy("__stratum", "chain").orderBy("step")
    seen = seen.withColumn("ok", F.min(F.when(ok, 1).otherwise(0)).over(so_far)).where("ok = 1").withColumn("gain", F.col("bad") - price * F.col("k")).where("gain > 0")
    best = seen.groupBy("__stratum").agg(F.max_by("step", F.struct("gain", -F.col("step"))).alias("step"))
    table = F.array(*[F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff")) for r, c in cutoffs.items()]) for _, _, cutoffs in every])
    return best.select("__stratum", F.explode(F.get(table, F.col("step"))).alias("x")).select("__stratum", "x.*")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", **limits: float) -> DataFrame:
    """Per row: the id, the counts, base_failed, kept and the cutoffs that were applied."""
    counts = text_counts(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.struct(F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(5), F.col(text_col))).alias("same")), "text").drop("text")
    counts = counts.withColumnRenamed("stratum", "__stratum").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    counts = stored(counts)
    valued = counts.withColumns(_values())
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("__good")).where("__good IS NOT NULL")
    good = known.groupBy("id").agg(F.max("__good").alias("__good"))
    trials = valued.where("NOT base_failed").join(good, "id").groupBy("__stratum", "same").agg(F.max("__good").alias("__good"), *[F.first(r).alias(r) for r in CUTOFFS])
    cutoffs = select_cutoffs(trials, **limits)
    wide = cutoffs.groupBy("__stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in CUTOFFS])
    fine = F.lit(True)
    for r in CUTOFFS:
        fine = fine & F.coalesce(F.col(r) <= F.col(f"cutoff_{r}"), F.lit(True))
    return valued.join(wide, "__stratum", "left").select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"), *[f"cutoff_{r}" for r in CUTOFFS])
