"""Source divergence against a plain Python version on odd rows."""

import re
from collections import Counter, defaultdict

from rankspark.llm import divergence


def plain(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    rows_with, count, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        rows_with.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (k, t), n in rows_with.items() if k == lang and n >= least]
        share = lambda cs: {t: 1 + 10**9 * (c + 2) // (sum(cs.values()) + 2 * len(kept)) for t, c in cs.items()}
        c = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        p = {s: share(c[s]) for s in sources}
        q = share({t: sum(c[s][t] for s in sources) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if c[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def test_odd_rows(spark):
    rows = [
        ("Ab ab É é ß\x00x", "en", "s1"), ("ab É 漢字 😀x", "en", "s1"), ("ab Éb cd", "en", "s2"), ("AB cd", "en", None), ("cd cd cd cd", "en", None), ("ab", "en", "s3"),
        (None, "en", "s4"), ("", "en", "s5"), ("123 4", "en", "s5"), (None, None, None), ("zz", "fr", "a"), ("yy", "fr", "b"), ("yy", "de", "only"), ("yy yy", "de", "only"),
        ("ab ab", "en", "s1"), ("ab ab", "en", "s1"), ("xx " * 50_000 + "ab", "en", "s2"), ("xx", "en", "s1"),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, source string, term int, count int, rank int")
    got = sorted(tuple(r) for r in divergence.audit(df, least=2, top=2).collect())
    assert got == plain(rows, 2, 2)
    assert {r[2] for r in got} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in got
    assert divergence.audit(df.where("false")).collect() == []


def test_shares_beyond_a_long(spark):
    df = spark.createDataFrame([(10**11, 3 * 10**11, 5)], "c long, n long, v long")
    assert df.select(divergence.share("c", "n", "v")).first()[0] == 1 + 10**9 * (10**11 + 2) // (3 * 10**11 + 10)
