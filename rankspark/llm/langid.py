"""Rank-order language profiles (operator 2).

A profile is a language's ``top`` most frequent letter n-grams (1 to 3 code points, lower case, every run of other
characters one blank), ranked by count. A document is given the language whose profile has the least out-of-place
distance to the document's own ranked list: the sum of rank differences, ``top`` for an n-gram that the profile
lacks. Counting runs over all learning rows: each task sums its own rows, one shuffle sums the tasks. The driver gets
``top`` rows a language and no more.

Defined results: a null text, or one without a letter, is ``und`` with score 0; null languages teach nothing; with
no learning row every text is ``und``. Ties go to the language that sorts first. An empty table gives no rows, repeated
rows are judged one by one, a caller's columns lang_pred, score and closeness are replaced. Long texts are read whole;
a task works on about ``BATCH_BYTES`` of text, or on one longer text, at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import lean, slices

#: N-grams of a profile and of a document.
TOP = 300
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_codes(text: str) -> np.ndarray:
    """All 1-, 2- and 3-grams of a text as integers of 21 bits a code point; those of blanks alone are left out."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint64)
    blank = points == 32
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    two = points[:-1] << np.uint64(21) | points[1:]
    three = two[:-1] << np.uint64(21) | points[2:]
    return np.concatenate([points[points != 32], two, three])


def ranked(text: str, top: int) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, smaller code first among equals."""
    codes, n = np.unique(gram_codes(text), return_counts=True)
    return codes[np.argsort(-n, kind="stable")[:top]]


def learn_profiles(df: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the given rows, rank from 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches, "__text"):
            langs = np.array(b.column(0).to_pylist(), object)
            texts = b.column(1).to_pylist()
            for lang in set(langs.tolist()):
                codes, n = np.unique(np.concatenate([gram_codes(texts[i]) for i in np.flatnonzero(langs == lang)]), return_counts=True)
                if lang in sums:
                    both, back = np.unique(np.concatenate([sums[lang][0], codes]), return_inverse=True)
                    codes, n = both, np.bincount(back, np.concatenate([sums[lang][1], n]), len(both)).astype(np.int64)
                sums[lang] = codes, n
        for lang, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    rows = df.selectExpr(f"`{lang_col}` AS __lang", f"`{text_col}` AS __text").where("__lang IS NOT NULL AND __text IS NOT NULL")
    counts = rows.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    # Compared as it is, so that each task keeps its own first rows before the shuffle.
    return counts.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= top).select("lang", "gram", (F.col("__place") - 1).alias("rank"))


def predict(df: DataFrame, profiles: list[tuple[str, int, int]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """``df`` with lang_pred, score (0 to 1: the runner-up's share of the two least distances) and closeness (0 to 1)."""
    langs = sorted({p[0] for p in profiles})
    codes = np.unique(np.array([p[1] for p in profiles], np.int64).view(np.uint64))
    ranks = np.full((max(1, len(langs)), len(codes) + 1), -1, np.int32)
    for lang, gram, rank in profiles:
        ranks[langs.index(lang), np.searchsorted(codes, np.uint64(gram))] = rank

    def judge(text: str | None) -> tuple[str, float, float]:
        own = ranked(text, top) if text else np.empty(0, np.uint64)
        if not len(own) or not langs:
            return UNDETERMINED, 0.0, 0.0
        at = np.searchsorted(codes, own)
        at[(at == len(codes)) | (codes[np.minimum(at, len(codes) - 1)] != own)] = len(codes)
        theirs = ranks[:, at]
        far = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(own)))).sum(1)
        order = np.argsort(far, kind="stable")
        best, most = int(far[order[0]]), top * len(own)
        other = int(far[order[1]]) if len(langs) > 1 else most
        return langs[order[0]], other / (best + other) if best + other else 1.0, 1 - best / most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            got = [judge(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            lang, score, close = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.float64())], [*b.schema.names, "lang_pred", "score", "closeness"])

    clash = [c for c in df.columns if c.lower() in ("lang_pred", "score", "closeness")]
    df = df.drop(*clash)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lean(run), f"{schema}, lang_pred string, score double, closeness double")


def identify(df: DataFrame, learn_from: Column, lang_col: str = "lang", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), top: int = TOP) -> DataFrame:
    """Learn from the rows where ``learn_from`` holds and predict every row from its text alone.

    The result has the ``keep`` columns, lang_pred, score and closeness.
    """
    rows = learn_profiles(df.where(learn_from), lang_col, text_col, top).collect()  # top rows a language
    kept = list(dict.fromkeys([*keep, text_col]))
    out = predict(df.select(*kept), [tuple(r) for r in rows], text_col, top)
    return out if text_col in keep else out.drop(text_col)
