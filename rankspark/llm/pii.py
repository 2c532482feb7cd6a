"""Personal data by bootstrapped contextual extraction (operator 12); DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. What they find seeds the search for
identifiers that no base pattern covers, by the words around them:

- A text is a list of tokens; a token with a digit or an at sign is an identifier token. A candidate is a longest run of
  identifier tokens with one space between them. Other tokens are plain.
- A candidate or plain token stands in up to three lexical patterns: the token on its left, the two tokens on its left,
  and the tokens on both sides (lower case; identifier tokens are all alike, what is left of one
  is not looked at, and the ends of the text count as a token).
- The graph has an edge for each different (pattern, value). A candidate that holds entities of exactly one kind is a seed
  of it. A pattern's confidence for a kind is the sum of its values' scores over the number of its values, plain tokens
  and seeds of other kinds included; an undecided candidate of the kind's form counts half.
  A pattern counts with at least ``SUPPORT`` values of the kind and a confidence of ``CONFIDENCE``.
- A candidate that is no seed and has the form of the kind (digits, or an at sign) takes the score 1 - product of
  (1 - confidence) over its patterns that count, for its best kind. Scores and confidences are computed ``ROUNDS`` times in
  turn, so that what was found induces further patterns.
- Candidates with a score of ``ACCEPT`` or more become spans, wherever they occur.

A pattern of common words stands before thousands of plain tokens and so gets no confidence; only fixed phrases do. Edges
are made distinct by (pattern, value) before anything is counted, so copies of a text count once and no key is hot.

Defined results: null text is empty; an empty text has no span; repeated rows and repeated ids give one row each; other
columns are left out, whatever their names; spans of a kind that repeat are listed once; no row gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import stored

# The kinds in their order and their patterns. Repeats are possessive, and a match begins at the end of the
# one before or where no such character stands before it, so that long runs are read once; the matches stay the same.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match of the kind holds at least; other texts are not searched.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Least values of a kind in a pattern that counts, its least confidence, rounds, and the score of an accepted candidate.
SUPPORT, CONFIDENCE, ROUNDS, ACCEPT = 3, 0.6, 3, 0.6
#: Least digits of a candidate of each kind; an e-mail address has an at sign instead.
DIGITS = {"ip": 4, "card": 12, "phone": 6}
_T = r"[A-Za-z0-9@._%+()\x{80}-\x{10FFFF}-]"
_NOT_T = r"[^A-Za-z0-9@._%+()\x{80}-\x{10FFFF}-]++"
_PLAIN = r"[A-Za-z._%+()\x{80}-\x{10FFFF}-]*+"
CANDIDATE = rf"(?<!{_T}){_PLAIN}[0-9@]{_T}*+(?:\x20{_PLAIN}[0-9@]{_T}*+)*+"
_TRIM_LEFT, _TRIM_RIGHT = r"^[@._%)-]*+", r"[@._%+(-]*$"
BLOCK, CLASSES = 128, 16


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


#: A control character that no pattern holds marks both ends of a match; where a text has it, another one stands for it.
MARK, OTHER = "\x01", "\x02"


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at its matches: a gap, a match, a gap and so on. One pass, however many matches there are."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def matches(text: Column, pattern: str, worth: Column) -> Column:
    """(start, value, before, after) of all matches, in code points, with the text up to the match before and after; none
    in a text that is not ``worth`` a search.

    Starts are running sums; they are carried over blocks of matches, so that a text with very many stays cheap.
    """

    def placed(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(x) - 2, F.lit(2))
        rows = F.transform(at, lambda i: F.struct(F.length(F.get(x, i - 1)).alias("gap"), F.length(F.get(x, i)).alias("size")))
        blocks = _let(rows, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), lambda b: F.slice(r, b * BLOCK + 1, BLOCK)))
        return _let(_let(blocks, _starts), lambda s: F.transform(at, lambda i, k: F.struct(F.get(s, k).alias("start"), F.get(x, i).alias("value"), F.get(x, i - 1).alias("before"), F.get(x, i + 1).alias("after"))))

    none = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit("").alias("value"), F.lit("").alias("before"), F.lit("").alias("after"))), lambda _: F.lit(False))
    return F.when(worth, _let(_parts(text, pattern), lambda x: F.when(F.size(x) > 1, placed(x)).otherwise(none))).otherwise(none)


def _starts(blocks: Column) -> Column:
    longs = F.array().cast("array<bigint>")
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, r: s + r["gap"] + r["size"])
    zero = F.struct(F.lit(0).cast("long").alias("at"), longs.alias("out"))
    offsets = F.aggregate(blocks, zero, lambda s, b: F.struct((s["at"] + total(b)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def inside(b: Column, offset: Column) -> Column:
        first = F.struct(offset.alias("at"), longs.alias("out"))
        return F.aggregate(b, first, lambda s, r: F.struct((s["at"] + r["gap"] + r["size"]).alias("at"), F.array_append(s["out"], s["at"] + r["gap"]).alias("out")), lambda s: s["out"])

    return _let(offsets, lambda o: F.flatten(F.transform(blocks, lambda b, i: inside(b, F.get(o, i)))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is an entity."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255")))
        return F.forall(F.split(value, r"\."), part)
    least, most = (14, 19) if kind == "card" else (10, 15)
    right = lambda d: F.when(F.length(d).between(least, most), _luhn(d) if kind == "card" else F.lit(True)).otherwise(F.lit(False))
    return _let(_digits(value), right)


def _holds_one(kind: str, text: Column) -> Column:
    """Whether a text has an entity of the kind."""
    return F.exists(F.transform(_parts(text, KINDS[kind]), lambda v, i: F.when(i % 2 == 1, v)), lambda v: F.coalesce(F.when(v.isNotNull(), holds(kind, v)), F.lit(False)))


def _entity(kind: str) -> Callable[[Column], Column]:
    return lambda m: holds(kind, m["value"])


def _base(text: Column, digit: Column) -> Column:
    """(start, order, end) of all base spans, in order. ``digit``: whether the text has one, found once for all patterns."""
    each = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        worth = text.contains(NEEDED[kind]) & (F.lit(True) if kind == "email" else digit)
        good = F.filter(matches(text, pattern, worth), _entity(kind))
        each.append(F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), (m["start"] + F.length(m["value"])).alias("end"))))
    return F.array_sort(F.concat(*each))


def _words(text: Column) -> Column:
    """The tokens in lower case. Identifier tokens, and only they, hold a 0: one stands for their digits and at signs."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[0-9@]++", "0"), _NOT_T), "")


def _hashed(word: Column) -> Column:
    """What patterns see of a token of ``_words``: its hash, 0 of an identifier token."""
    return F.when(word.contains("0"), F.lit(0).cast("long")).otherwise(F.xxhash64(word))


#: What stands for a token before the first and after the last one.
EDGE = 1


def _patterns(left2: Column, left: Column, right: Column) -> Column:
    return F.array(F.xxhash64(F.lit(0), left), F.xxhash64(F.lit(1), left2, left), F.xxhash64(F.lit(2), left, right))


def _candidates(text: Column, digit: Column) -> Column:
    """(start, end, value, kind of the seed or -1, whether it is one, forms, left token, patterns) of all candidates."""

    def one(m: Column, i: Column) -> Column:
        lead = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], _TRIM_LEFT, ""))
        core = F.regexp_replace(F.regexp_replace(m["value"], _TRIM_LEFT, ""), _TRIM_RIGHT, "")
        kinds = F.filter(F.array(*[F.when(_holds_one(k, m["value"]), order) for order, k in enumerate(KINDS)]), lambda k: k.isNotNull())
        edge = F.when(i == 0, EDGE).otherwise(0).cast("long")
        back = lambda t, d: F.when(F.size(t) >= d, _hashed(F.get(t, F.size(t) - d))).otherwise(edge)
        left = _let(_words(m["before"]), lambda t: F.struct(back(t, 2).alias("two"), back(t, 1).alias("one")))
        return F.struct(m["start"].alias("start"), lead.alias("lead"), core.alias("value"), kinds.alias("kinds"), left.alias("left"), m["after"].alias("after"), i.alias("i"))

    def finish(x: Column, n: Column) -> Column:
        right = _let(_words(x["after"]), lambda t: F.when(F.size(t) > 0, _hashed(F.get(t, F.lit(0)))).otherwise(F.when(x["i"] == n - 1, EDGE).otherwise(0).cast("long")))
        start = x["start"] + x["lead"]
        digits = F.length(_digits(x["value"]))
        return F.struct(
            start.alias("start"), (start + F.length(x["value"])).alias("end"), F.sha2(x["value"], 256).alias("value"), F.when(F.size(x["kinds"]) == 1, F.get(x["kinds"], 0)).otherwise(-1).alias("kind"), (F.size(x["kinds"]) > 0).alias("seed"),
            F.array(x["value"].contains("@"), *[digits >= DIGITS[k] for k in ("ip", "card", "phone")]).alias("forms"), x["left"]["one"].alias("left"), _patterns(x["left"]["two"], x["left"]["one"], right).alias("patterns"),
        )

    return _let(F.transform(matches(text, CANDIDATE, digit | text.contains("@")), one), lambda xs: F.filter(F.transform(xs, lambda x: finish(x, F.size(xs))), lambda x: x["end"] > x["start"]))


def _plain_tokens(texts: DataFrame) -> DataFrame:
    """(value, left2, left, right) of all plain tokens; ``texts`` has the column __text."""
    tokens = texts.select(F.transform(_words(F.col("__text")), _hashed).alias("t"))
    each = tokens.select("t", F.posexplode_outer("t").alias("at", "value")).where("value <> 0")  # outer: no filter that would make the tokens twice
    near = lambda d: F.coalesce(F.get("t", F.col("at") + d), F.lit(EDGE).cast("long"))
    return each.select("value", F.when(near(-1) == 0, F.lit(0).cast("long")).otherwise(near(-2)).alias("left2"), near(-1).alias("left"), near(1).alias("right"))


def _plain_edges(tokens: DataFrame) -> DataFrame:
    """(value, pattern) of plain tokens."""
    return tokens.select("value", F.explode(_patterns(F.col("left2"), F.col("left"), F.col("right"))).alias("pattern"))


def learn(candidates: DataFrame, plain: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(value, kind) of the accepted candidates. ``candidates``: value, kind, seed, forms, left, patterns; ``plain``: value, left2, left, right."""
    each = candidates.groupBy("value").agg(F.max("seed").alias("seed"), F.min("kind").alias("low"), F.max("kind").alias("kind"), F.max("forms").alias("forms"))
    # A value that is a seed of several kinds, or of one here and none there, is a seed of no kind.
    values = each.select("value", "seed", F.when(F.col("low") == F.col("kind"), F.col("kind")).otherwise(-1).alias("kind"), "forms")
    edges = candidates.select("value", "left", F.explode("patterns").alias("pattern")).distinct()  # a pattern has one left token
    likely = stored(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.min("left").alias("left")).where(F.col("n") >= support))
    # A confidence is n / (n + bare) at most, for n values of candidates and ``bare`` plain ones. Where the plain values of
    # one hash class in ``CLASSES`` are too many for that, the others need not be counted: the result is the same.
    some = _plain_edges(plain.where(F.pmod("value", F.lit(CLASSES)) == 0)).join(likely.select("pattern"), "pattern").distinct().groupBy("pattern").agg(F.count("*").alias("some"))
    able = F.coalesce("some", F.lit(0)) * confidence <= F.col("n") * (1 - confidence) + 1e-6
    likely = stored(likely.join(some, "pattern", "left").where(able).select("pattern", "left"))
    edges = stored(edges.join(likely.select("pattern"), "pattern").join(values, "value").select("pattern", "value", "seed", "kind", "forms"))
    # Few patterns are left: only tokens behind the left token of one get patterns.
    behind = plain.join(likely.select("left"), "left", "left_semi")
    bare = stored(_plain_edges(behind).join(likely.select("pattern"), "pattern").distinct().groupBy("pattern").agg(F.count("*").alias("bare")))
    found = None
    for _ in range(rounds):
        scored = edges.join(found, "value", "left") if found is not None else edges.withColumn("got", F.lit(None).cast("int")).withColumn("score", F.lit(None).cast("double"))
        sums = []
        for k in range(len(KINDS)):
            score = F.when(F.col("kind") == k, 1.0).when(~F.col("seed") & (F.col("got") == k), F.col("score")).otherwise(0.0)
            open_ = F.when(~F.col("seed") & F.col("got").isNull(), F.when(F.get("forms", k), 0.5).otherwise(1.0)).otherwise(1.0)
            sums += [F.sum(score).alias(f"s{k}"), F.sum((score >= accept).cast("int")).alias(f"c{k}"), F.sum(open_).alias(f"w{k}")]
        rated = scored.groupBy("pattern").agg(*sums).join(bare, "pattern", "left").fillna(0, ["bare"])
        kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("c"), (F.col(f"s{k}") / (F.col(f"w{k}") + F.col("bare"))).alias("conf")) for k in range(len(KINDS))]))
        good = rated.select("pattern", kinds.alias("x")).select("pattern", "x.*").where((F.col("c") >= support) & (F.col("conf") >= confidence)).select("pattern", "k", "conf")
        reached = edges.where(~F.col("seed")).join(good, "pattern").where(F.get("forms", F.col("k")))
        rate = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-12)))))
        best = Window.partitionBy("value").orderBy(F.desc("score"), "got")
        each_kind = reached.groupBy("value", F.col("k").alias("got")).agg(rate.alias("score")).where(F.col("score") >= accept)
        found = stored(each_kind.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth"))
    return found.select("value", F.col("got").alias("kind"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """Per row: the id, ``base`` and ``spans``, arrays of (start, order of the kind, end)."""
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    searched = texts.withColumn("__digit", F.col("__text").rlike("[0-9]"))
    rows = stored(searched.select(F.monotonically_increasing_id().alias("row"), "id", _base(F.col("__text"), F.col("__digit")).alias("base"), _candidates(F.col("__text"), F.col("__digit")).alias("candidates")))
    candidates = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    found = learn(candidates, _plain_tokens(texts), **limits)
    more = candidates.where(~F.col("seed")).select("row", "value", "start", "end").join(found, "value")
    more = more.groupBy("row").agg(F.collect_set(F.struct("start", F.col("kind").alias("order"), "end")).alias("more"))
    out = rows.drop("candidates").join(more, "row", "left")
    return out.select(F.col("id").alias(id_col), "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def query(df: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long")
    return find(df).select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
