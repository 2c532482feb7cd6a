"""Resolution of not-modified revisit records (operator 1); DataFrame functions only.

A revisit is joined to the latest strictly earlier full response (status 200) of its canonical URL. Both kinds are
ordered together in windows over (URL, span of time), and what an earlier span leaves is carried over from a table
with one row for each URL and span, so a URL with very many captures is spread over its spans. Only ids and times
travel through the windows; headers are fetched afterwards, a response's once for each share of its revisits.

Validators: if both have an entity tag, the tags decide (weak comparison); else, if both have a last-modified date,
the dates decide; else there is none to check. On a mismatch the body must not be used and nothing is merged.
Merged headers are the response's, replaced or extended by those that a 304 may carry (``PERMITTED``).

Defined results: a null or unparsable URL stands for itself and a null one matches nothing; records of other types
are ignored; a revisit without an earlier response is ``unresolved``; among responses of one time the largest id counts
(a null one is the smallest; of equal ids the larger hash of the row). Null ids are ids like others. Repeated revisits are
resolved one by one, repeated responses count once. Other columns are left out; no record gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import row_key, shuffle_partitions

# Header fields that a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Seconds of a span.
SPAN = 86_400


def _unescaped(text: Column) -> Column:
    """Percent triplets of unreserved characters as the characters, other triplets in upper case (RFC 3986, section 6.2.2)."""
    pieces = F.split(text, "%", -1)

    def one(x: Column) -> Column:
        code = F.substring(x, 1, 2)
        sign = F.char(F.conv(code, 16, 10).cast("int"))
        rest = F.substr(x, F.lit(3))
        kept = F.concat(F.when(sign.rlike("^[A-Za-z0-9._~-]$"), sign).otherwise(F.concat(F.lit("%"), F.upper(code))), rest)
        return F.when(code.rlike("^[0-9A-Fa-f]{2}$"), kept).otherwise(F.concat(F.lit("%"), x))

    return F.when(F.instr(text, "%") == 0, text).otherwise(F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), one), "")))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments (RFC 3986, section 5.2.4)."""

    def step(kept: Column, x: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(x == ".", kept).when(x == "..", up).otherwise(F.concat(kept, F.array(x)))

    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    whole = F.concat(F.lit("/"), F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), whole).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Without scheme, user, fragment, a leading www., the scheme's default port and dot segments; host in lower case.

    Percent triplets are normal, query parts sorted and empty ones left out, a last slash is dropped.
    """
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    scheme, host = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), "^.*@", "")
    port = lambda n: F.regexp_replace(host, f":({n})?$", "")
    host = F.when(scheme == "http", port(80)).when(scheme == "https", port(443)).otherwise(F.regexp_replace(host, ":$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(_without_dots(_unescaped(part(3))), "/$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(_unescaped(part(4)), "&"), lambda x: x != "")), "&")
    return F.when(host == "", url).otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _field(headers: str, name: str) -> Column:
    return F.element_at(F.col(headers), name)


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per revisit. ``records``: record_id, kind (response or revisit), url, at (epoch seconds), status, headers.

    ``headers`` is a map with lower-case names. Columns: record_id, response_id, canonical_url, verdict (resolved,
    unverified, mismatch or unresolved) and merged (map; null unless resolved or unverified).
    """
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("\n", e["key"], F.coalesce(e["value"], F.lit("\0")))))
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("u"), F.col("at").cast("long").alias("at"), "status", "headers")
    rows = rows.select("*", F.struct(*row_key("record_id", "kind", "u", "at", "status")).alias("k"), F.xxhash64(F.array_join(pairs, "\r")).alias("h"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    marks = rows.where(F.col("u").isNotNull() & F.col("at").isNotNull() & (full | (F.col("kind") == "revisit"))).select("k", "u", "at", F.when(full, F.struct("at", "record_id", "k", "h")).alias("full"), F.floor(F.col("at") / span).alias("span"))
    before = Window.partitionBy("u").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("u", "span").agg(F.max("full").alias("tail")).select("u", "span", F.max("tail").over(before).alias("carried"))
    earlier = Window.partitionBy("u", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = marks.select("k", "u", "span", F.col("full").isNull().alias("asks"), F.max("full").over(earlier).alias("inside")).where("asks")
    # Rows are linked by a hash of the whole row, so null and repeated ids neither lose nor multiply rows.
    found = F.coalesce("inside", "carried")
    links = inside.join(carried, ["u", "span"], "left").select("k", found.getField("k").alias("full_k"), found.getField("h").alias("full_h")).distinct()
    # A response that very many revisits name, and the revisits that name none, are dealt over as many shares as there are tasks.
    share = F.pmod(F.xxhash64("k"), F.lit(shuffle_partitions(records.sparkSession))).cast("int").alias("share")
    asked = rows.where(F.col("kind") == "revisit").select("k", share, "record_id", F.col("u").alias("canonical_url"), F.col("headers").alias("theirs"))
    answers = rows.where(full).select(F.col("k").alias("full_k"), F.col("h").alias("full_h"), F.col("record_id").alias("response_id"), F.col("headers").alias("ours")).dropDuplicates(["full_k", "full_h"])
    wanted = links.where("full_k IS NOT NULL").select("full_k", "full_h", share).distinct()
    both = asked.join(links, "k", "left").join(wanted.join(answers, ["full_k", "full_h"]), ["full_k", "full_h", "share"], "left")
    tag = lambda h: F.regexp_replace(_field(h, "etag"), "^W/", "")
    when = lambda h: _field(h, "last-modified")
    same = F.coalesce(tag("ours") == tag("theirs"), when("ours") == when("theirs"))
    verdict = F.when(F.col("full_k").isNull(), "unresolved").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    newer = F.map_filter(F.coalesce("theirs", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter(F.coalesce("ours", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(newer), k))
    return both.select("record_id", "response_id", "canonical_url", verdict.alias("verdict"), F.when(verdict.isin("resolved", "unverified"), F.map_concat(kept, newer)).alias("merged"))
