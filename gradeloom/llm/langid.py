"""Language identification by a bit-sliced Bloom filter of character trigrams.

One table of slots serves all languages: bit b of a slot belongs to the filter of language b.
The AND of an n-gram's k slots is the mask of the languages that may contain it, so one probe
answers for all of them (for up to 64; each further 64 languages are one more word in every slot). Per document the bits are counted by language, each count is corrected
for its filter's false positives, and the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, groups

WORD = 64


@dataclass
class LanguageFilters:
    languages: list[str]
    slots: np.ndarray  # words x slots: masks of languages
    hashes: int
    false_positive: np.ndarray  # by language
    usual: int  # index of the most frequent training language


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Exact codes of all trigrams with a letter in the middle, and how many each piece has.

    Texts are lower-cased and everything but letters counts as a word edge.
    """
    lowered = [p.lower() for p in pieces]
    points = np.frombuffer(("\n" + "".join(p + "\n" for p in lowered)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    middle = np.flatnonzero(letter)
    codes = (points[middle - 1] << np.uint64(42)) | (points[middle] << np.uint64(21)) | points[middle + 1]
    ends = np.cumsum([len(p) + 1 for p in lowered])
    upto = np.searchsorted(middle, ends)
    return codes, np.diff(upto, prepend=0)


def _slots(codes: np.ndarray, n_slots: int, hashes: int) -> list[np.ndarray]:
    """k slots of each code by double hashing (multiply and shift)."""
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    first, step = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [((first + np.uint64(j) * step) & np.uint64(n_slots - 1)).astype(np.int64) for j in range(hashes)]


def fit(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 20_000,
    n_slots: int = 1 << 20,
    hashes: int = 3,
    min_count: int = 2,
    min_share: float = 0.3,
) -> LanguageFilters:
    """Learn the filters from rows with a language.

    `max_rows` bounds the sample of labelled rows, and `n_slots` the filters, whatever the input: the share of slots in use is what
    the false positives are reckoned from. An n-gram enters a language's filter if it was seen `min_count` times there and its share in
    that language is at least `min_share` of its largest share in any. All languages of the sample are learned. Rows without a
    language or a text teach nothing. No usable row: a model without languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = bounded_sample(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), "id", max_rows)

    def count(frames):
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                for _, pieces in groups(part["text"].tolist()):
                    codes, n = np.unique(trigrams(pieces)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})

    grams = rows.select("text", "lang").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).persist()
    totals = [(r["lang"], r["n"]) for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()]
    languages = [lang for lang, _ in totals]
    words = max(1, -(-len(languages) // WORD))
    kind = next(np.dtype(t) for t in ("u1", "u2", "u4", "u8") if len(languages) <= np.dtype(t).itemsize * 8 or t == "u8")
    slots = np.zeros((words, n_slots), kind)
    if not languages:
        grams.unpersist()
        return LanguageFilters([], slots, hashes, np.zeros(0), 0)
    numbers = grams.sparkSession.createDataFrame([(lang, k, float(n)) for k, (lang, n) in enumerate(totals)], "lang string, k int, total double")
    shares = grams.where(F.col("n") >= min_count).join(F.broadcast(numbers), "lang").select("code", "k", (F.col("n") / F.col("total")).alias("share"))
    of = shares.groupBy("code").agg(F.collect_list(F.struct("k", "share")).alias("of"), F.max("share").alias("most"))
    of = of.select("code", F.expr(f"transform(filter(of, x -> x.share >= {min_share} * most), x -> x.k)").alias("of"))
    of = of.select("code", F.explode("of").alias("k"))

    def place(frames):
        for frame in frames:
            word, bit = np.divmod(frame["k"].to_numpy(), WORD)
            mask = (np.uint64(1) << bit.astype(np.uint64)).view(np.int64)
            for at in _slots(frame["code"].to_numpy().astype(np.uint64), n_slots, hashes):
                yield pd.DataFrame({"word": word, "slot": at, "mask": mask})

    # at most n_slots rows for each 64 languages, whatever the input
    filled = of.mapInPandas(place, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    grams.unpersist()
    slots[filled["word"].to_numpy(np.int64), filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64).astype(kind)
    fill = np.array([np.count_nonzero(slots[b // WORD] >> kind.type(b % WORD) & kind.type(1)) / n_slots for b in range(len(languages))])
    return LanguageFilters(languages, slots, hashes, fill**hashes, max(range(len(totals)), key=lambda k: (totals[k][1], totals[k][0])))


def predict_texts(model: LanguageFilters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; `und` and 0 without a letter."""
    n_lang = len(model.languages)
    seen, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), max(1, n_lang)))
    for at, pieces in groups(texts):
        codes, n = trigrams(pieces)
        if not len(codes):
            continue
        places = _slots(codes, model.slots.shape[1], model.hashes)
        np.add.at(seen, at, n)
        ends = np.cumsum(n)
        for word in range(-(-n_lang // WORD)):
            mask = model.slots[word][places[0]]
            for slot in places[1:]:
                mask &= model.slots[word][slot]
            for b in range(word * WORD, min(n_lang, (word + 1) * WORD)):
                running = np.concatenate(([0], np.cumsum((mask >> mask.dtype.type(b % WORD)) & mask.dtype.type(1), dtype=np.int64)))
                np.add.at(hits[:, b], at, running[ends] - running[ends - n])
    if not n_lang:
        return ["und"] * len(texts), np.zeros(len(texts))
    true = np.clip((hits - seen[:, None] * model.false_positive) / (1 - np.minimum(model.false_positive, 0.999)), 0, None)
    best = np.where(true.max(axis=1) > 0, true.argmax(axis=1), model.usual)
    score = np.where(seen > 0, np.clip(true.max(axis=1) / np.maximum(seen, 1), 0, 1), 0.0)
    return [model.languages[b] if s else "und" for b, s in zip(best, seen, strict=True)], score


def predict(docs: DataFrame, model: LanguageFilters, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every row's whole text: (id, lang_pred, score).

    Null or letterless text: `und`, score 0. Nothing known in a text: the most frequent training language, score 0.
    Ties go to the language that sorts first. Repeated rows and ids give a row each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames):
        for frame in frames:
            names, scores = predict_texts(shared.value, frame["text"].tolist())
            yield pd.DataFrame({"id": frame["id"], "lang_pred": names, "score": scores})

    # ids travel as text: pandas has no integers with nulls
    scored = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(score, "id string, lang_pred string, score double")
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "lang_pred", "score")
